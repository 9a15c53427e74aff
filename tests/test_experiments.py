import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.functions.distances import exact_match
from accordant.operators import distribution, measures, synthetic
from accordant.plans import experiments

M = measures.MEASURES


@pytest.fixture(scope="module")
def made(spark):
    rows = [(i, f"C{i}", f"term {i}", [f"word{i}", f"name{i} of it"]) for i in range(40)]
    concepts = spark.createDataFrame(rows, "ord int, code string, preferred_term string, synonyms array<string>")
    return synthetic.populations(concepts, [1, 2, 3], samples=25)


def test_synthetic_results(made):
    out = experiments.synthetic_results(made, [M["set_jaccard"], M["bipartite_jaccard"]])
    rows = out.collect()
    assert sorted({(r["measure"], r["matching"]) for r in rows}) == [("bipartite_jaccard", "greedy"), ("bipartite_jaccard", "hungarian"), ("set_jaccard", "none")]
    assert len(rows) == 9 and all(0 <= r["true_average_agreement"] <= 1 for r in rows)
    assert all(r["mae_average_agreement"] == pytest.approx(abs(r["average_agreement"] - r["true_average_agreement"])) for r in rows)
    long = experiments.errors(out, experiments.COEFFICIENTS)
    assert long.count() == 45 and {r[0] for r in long.select("measure").distinct().collect()} == {"set_jaccard", "bipartite_jaccard", "bipartite_jaccard (greedy)"}


def test_predictions(made):
    rows = experiments.predictions(made, M["bipartite_levenshtein"]).collect()
    assert len(rows) == 75
    for r in rows:
        assert r["distance"] <= r["distance_greedy"] + 1e-9
        if r["true_match"]:
            assert len(r["true_assignment"]) == r["rater_a_set_size"]
    plain = experiments.predictions(made, M["levenshtein"])
    assert "cost" not in plain.columns and plain.filter("distance is null").count() == 0


@pytest.fixture(scope="module")
def items(spark):
    rows = [("k1", 0, "red rash", ["a"]), ("k1", 1, "red rash", ["a"]), ("k2", 0, "blue spot", ["b"]), ("k2", 1, "red rash", ["a", "b"]), ("k2", 2, "blue spot", None)]
    return spark.createDataFrame(rows, "key string, slot int, caption string, category array<string>")


def test_real_results(items):
    r = experiments.real_results(items, [M["exact_match"]]).first()
    assert r["average_agreement"] == pytest.approx((1 + 1 / 3) / 2)
    got = sorted((x["key"], x["s"], x["t"], x["distance"]) for x in experiments.real_predictions(items, M["exact_match"]).collect())
    assert got == [("k1", 0, 1, 0.0), ("k2", 0, 1, 1.0), ("k2", 0, 2, 0.0), ("k2", 1, 2, 1.0)]
    chance = experiments.chance_rows(items, M["exact_match"]).collect()
    assert sum(x["weight"] for x in chance) == pytest.approx(1.0) and {x["key"] for x in chance} == {"k1", "k2"}
    pairs = items.select(F.array("caption").alias("a"), F.array("caption").alias("b"))
    assert experiments.timing(pairs, M["exact_match"])["n_pairs"] == 2


def test_pointwise_ks(spark):
    o, e = [0.1, 0.5, 0.5], [0.2, 0.4, 0.6, 0.8]
    rows = [("g", "observed", v, 1.0) for v in o] + [("g", "expected", v, 1.0) for v in e]
    got = distribution.ks_pointwise(spark.createDataFrame(rows, "g string, kind string, value double, weight double"), ["g"]).first()["ks"]
    assert got == pytest.approx(np.mean([1 - (sum(x <= v for x in e) + 1) / 5 for v in o]))


def test_matrices_and_chunks(spark):
    rows = [(str(i // 2), ["ab"[i % 3 % 2]], i, f"w{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "item string, labels array<string>, pos long, worker string")
    full = {(r["i"], r["j"]): r["d"] for r in distribution.distance_matrix(df, exact_match).collect()}
    assert len(full) == 66 and full[3, 1] == float(rows[3][1] != rows[1][1])
    asked = spark.createDataFrame([(1, 3), (3, 1), (5, 2)], "i long, j long")
    assert {(r["i"], r["j"]): r["d"] for r in distribution.distance_matrix(df, exact_match, asked).collect()} == {k: full[k] for k in [(3, 1), (5, 2)]}
    drawn = distribution.different_item_pairs(df, 10, seed=1)
    assert 5 <= drawn.count() <= 10
    pairs = distribution.same_item_pairs(df.withColumn("g", F.lit("g")), ["g"])
    chunks = distribution.chunks_by_error(df.select("item", F.lit(0.0).alias("error")), 3)
    out = distribution.alpha_by_chunk(pairs, chunks, 0.5, exact_match).collect()
    assert len(out) == 2 and all(r["alpha"] == pytest.approx(1 - r["observed"] / 0.5) for r in out)
