"""Registered queries do the whole job on inputs larger than their operators' budgets."""

import os
import random

import pytest

from accordant.functions.text import lcs
from accordant.operators import chance, neighbours
from accordant.plans import agreement


@pytest.fixture
def large_pairs(spark, tmp_path):
    """One group over the exact budget (40 x 40 label sets), one within it."""
    rows = [(i, "p", "q", [f"a{i}"], [f"b{i}"]) for i in range(40)] + [(100 + i, "p", "r", ["x"], [f"y{i % 2}"]) for i in range(4)]
    spark.createDataFrame(rows, "row_id long, rater_a_id string, rater_b_id string, rater_a array<string>, rater_b array<string>").write.parquet(f"{tmp_path}/rater_pairs.parquet")
    return str(tmp_path)


def test_chance_has_every_group(spark, large_pairs):
    assert 40 * 40 > chance.MAX_EXACT
    got = {(r["rater_a_id"], r["rater_b_id"]): r for r in agreement.QUERIES["c_all"](spark, large_pairs).collect()}
    assert set(got) == {("p", "q"), ("p", "r")}
    assert got["p", "q"]["n_pairs"] == 1600 and got["p", "q"]["most"] == pytest.approx(1 / 1600, abs=1e-9) and got["p", "q"]["weight"] == pytest.approx(1, abs=1e-9)
    assert got["p", "r"]["n_pairs"] == 2 and got["p", "r"]["most"] == 0.5


SMALL, SMALLEST = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def like(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b))


def test_terms_meet_all_at_once():
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcdé 😀") for _ in range(n)) for n in [0, 1, 2, 5, 30, 63, 64, 65, 127, 128, 129, 200] * 3]
    rng.shuffle(texts)
    held = neighbours.Terms(texts)
    for a in [*texts, "zz", "z" * 70 + "a"]:
        assert held.lcs(a).tolist() == [lcs(a, b) for b in texts]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("chunks", [(512, 8192), (7, 50)])
def test_lexical_neighbours_of_the_concepts_are_those_of_all_pairs(spark, monkeypatch, chunks):
    monkeypatch.setattr(neighbours, "QUERIES_AT_ONCE", chunks[0])
    monkeypatch.setattr(neighbours, "CONCEPTS_AT_ONCE", chunks[1])
    rows = [r for r in agreement._concepts(spark, SMALL).collect() if r["preferred_term"] is not None]
    forms = lambda r: [x for x in (r["preferred_term"], *(r["synonyms"] or ())) if x is not None]
    want = {}
    for r in rows:
        if r["ord"] % 20 == 0:
            others = [x for x in rows if x["taxonomy"] == r["taxonomy"] and x["code"] != r["code"]]
            pool = sorted(others, key=lambda x: (-like(r["preferred_term"], x["preferred_term"]), x["code"]))[:50]
            mean = {x["code"]: sum(like(a, b) for a in forms(r) for b in forms(x)) / len(forms(r)) / len(forms(x)) for x in pool}
            want[r["code"]] = sorted(mean.values(), reverse=True)[:10]
    got = {}
    for r in agreement.QUERIES["n_lexical"](spark, SMALL).orderBy("rank").collect():
        got.setdefault(r["code"], []).append(r["similarity"])
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c]) for c in want)


def test_every_vector_has_a_cost_to_every_label(spark, tmp_path, monkeypatch):
    rows = [(i, label, v) for i, (label, v) in enumerate([("x", [1.0, 0.0]), ("x", [1.0, 0.0]), ("y", [0.0, 2.0]), ("y", [0.0, 4.0]), ("y", None)])]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {(i, label): float((i < 2) != (label == "x")) for i in range(4) for label in "xy"}
    for most in (agreement.MOST_LABELS, 1):
        monkeypatch.setattr(agreement, "MOST_LABELS", most)
        got = {(r["vec_id"], r["label"]): r["cost"] for r in agreement.QUERIES["x_label_mean_costs"](spark, str(tmp_path)).collect()}
        assert got == want


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
def test_ablation_scores_thirty_layouts(spark):
    per = agreement.QUERIES["a_rows"](spark, SMALLEST).groupBy("row_id", "measure").count().collect()
    assert per and {r["count"] for r in per} == {30}
    summary = agreement.QUERIES["a_summary"](spark, SMALLEST).collect()
    assert sum(r["matrices"] for r in summary) == len(per)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["s_populations", "x_synthetic_predictions"])
def test_populations_of_every_taxonomy(spark, name):
    per = {(r["taxonomy"], r["seed"]): r["count"] for r in agreement.QUERIES[name](spark, SMALL).groupBy("taxonomy", "seed").count().collect()}
    assert per == {(t, seed): 100 for t in ("icd11", "mesh") for seed in range(52, 82)}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_results_of_every_taxonomy(spark):
    got = {(r["taxonomy"], r["seed"], r["measure"]) for r in agreement.QUERIES["x_synthetic_results"](spark, SMALL).collect()}
    assert got == {(t, seed, m) for t in ("icd11", "mesh") for seed in range(52, 82) for m in ("levenshtein", "bipartite_levenshtein")}
