import random

import pytest
from pyspark.sql import functions as F

from accordant.functions.text import lcs
from accordant.operators import neighbours, synthetic

SCHEMA = "ord int, code string, preferred_term string, synonyms array<string>, parent_codes array<string>, hierarchy_key array<string>, candidate string, key string"


def concepts(spark, rows):
    return spark.createDataFrame([(i, c, t, s, p, k, "x", "y") for i, (c, t, s, p, k) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def family(spark):
    rows = [("A", "a", ["a1"], ["P1"], ["1"]), ("B", "b", ["b1"], ["P1", "P1"], ["1.1"]), ("C", "c", ["c1"], ["P1", "P2"], None), ("D", "d", ["d1"], ["P2"], []), ("E", "e", None, None, ["2"]), ("F", "f", ["f1"], ["1", "1.1", None, "X"], ["3"])]
    return concepts(spark, rows)


def test_siblings(family):
    got = {(r["code"], r["candidate"]) for r in neighbours.siblings(family).collect()}
    assert got == {("A", "B"), ("A", "C"), ("B", "A"), ("B", "C"), ("C", "A"), ("C", "B"), ("C", "D"), ("D", "C")}
    index = {r["code"]: r["candidates"] for r in neighbours.sibling_index(family).collect()}
    assert index["C"] == ["A", "B", "D"] and index["E"] == [] and len(index) == 6


def test_children_and_ancestors(spark, family):
    assert sorted(map(tuple, neighbours.children(family).collect())) == [("A", "F"), ("B", "F")]
    titles = spark.createDataFrame([("P1", "first"), ("X", "outer")], "code string, title string")
    above = spark.createDataFrame([("X", "P1"), ("P1", "P0")], "code string, parent string")
    got = {(r["code"], r["candidate"], r["hop"]) for r in neighbours.ancestors(family, 2, titles, above).collect()}
    assert {x for x in got if x[0] == "F"} == {("F", "A", 1), ("F", "B", 1), ("F", "X", 1), ("F", "P1", 2)}
    assert {x for x in got if x[0] == "D"} == set() and ("A", "P1", 1) in got
    one = {(r["code"], r["candidate"]) for r in neighbours.ancestors(family, 1).collect()}
    assert one == {("F", "A"), ("F", "B")}


def test_lexical_recall_against_all_pairs(spark):
    rng = random.Random(0)
    parts = ["derm", "plas", "kera", "vaso", "lich", "sebo", "peri", "onyc", "thro", "cyst"]
    ends = ["itis", "osis", "oma", "pathy", "emia"]
    names = list(dict.fromkeys("".join(rng.sample(parts, 3)) + rng.choice(ends) for _ in range(700)))
    rows = [(f"C{i}", n, [n[:-2]], [], []) for i, n in enumerate(names)]
    df = concepts(spark, rows)
    got = {}
    for r in neighbours.lexical_neighbours(df.filter("ord % 20 = 0"), df, top_k=10).collect():
        got.setdefault(r["code"], []).append(r["similarity"])
    sim = lambda a, b: 2 * lcs(a, b) / (len(a) + len(b))
    hits = total = 0
    for i in range(0, len(names), 20):
        mean = lambda j: sum(sim(x, y) for x in (names[i], names[i][:-2]) for y in (names[j], names[j][:-2])) / 4
        coarse = sorted((j for j in range(len(names)) if j != i), key=lambda j: -sim(names[i], names[j]))[:50]
        best = sorted((mean(j) for j in coarse), reverse=True)[:10]
        found = sorted(got[f"C{i}"], reverse=True)
        hits += sum(s >= best[-1] - 1e-9 for s in found)
        total += 10
    assert hits / total >= 0.9


def test_lexical_edges(spark):
    df = concepts(spark, [("A", "same", None, None, None), ("B", "same", ["x"], None, None), ("C", None, None, None, None), ("D", "", None, None, None), ("E", "zz", None, None, None)])
    got = [(r["code"], r["candidate"]) for r in neighbours.lexical_neighbours(df, df).collect()]
    assert sorted(got) == [("A", "B"), ("B", "A")]


def pool(spark, n):
    return concepts(spark, [(f"C{i}", f"term {i}", [f"s{i}", f"t{i}"], [f"P{i // 3}"], []) for i in range(n)])


def test_populations_follow_the_level(spark):
    out = synthetic.populations(pool(spark, 60), list(range(30)), samples=40, least=2, most=5)
    per = out.select("seed", "agreement_level", F.size(F.array_intersect("rater_a_concepts", "rater_b_concepts")).alias("i"), F.size(F.array_union("rater_a_concepts", "rater_b_concepts")).alias("u")).groupBy("seed").agg(F.avg(F.col("i") / F.col("u")).alias("j"), F.first("agreement_level").alias("l"))
    assert per.select(F.avg(F.abs(F.col("j") - F.col("l")))).first()[0] < 0.08
    again = synthetic.populations(pool(spark, 60), [3, 7], samples=40)
    assert sorted(map(str, again.filter("seed = 7").collect())) == sorted(map(str, out.filter("seed = 7").collect()))
    assert out.filter("size(rater_a) < 2 or size(rater_a) > 5 or size(rater_b) > 5").count() == 0


def test_negatives_come_from_the_candidates(spark):
    c = pool(spark, 30)
    near = neighbours.sibling_index(c)
    out = synthetic.populations(c, [1, 2], samples=50, mode="single", negatives=near)
    group = F.floor(F.regexp_extract(F.get("rater_a_concepts", 0), r"\d+", 0).cast("int") / 3)
    other = F.floor(F.regexp_extract(F.get("rater_b_concepts", 0), r"\d+", 0).cast("int") / 3)
    assert out.filter(group != other).count() == 0 and out.filter("rater_a_concepts <> rater_b_concepts").count() > 0


def test_small_pools_are_errors(spark):
    for bad in (pool(spark, 0), pool(spark, 1)):
        with pytest.raises(ValueError):
            synthetic.populations(bad, [1])
    with pytest.raises(ValueError):
        synthetic.populations(pool(spark, 9), [1], mode="other")


def test_true_assignment(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["a", "a", "c"]), ([], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(synthetic.true_assignment(F.col("a"), F.col("b"))).collect()]
    assert [tuple(p) for p in got[0]] == [(0, 0), (2, 1)] and got[1] == [] and got[2] is None


def test_shared_counts_are_unbiased(spark):
    draws = spark.range(4000).select(synthetic.uniform("test", "id").alias("u"))
    for level in (0.1, 0.5, 0.83):
        k = synthetic.shared_count(F.lit(level), F.lit(4), F.lit(5), F.col("u"))
        mean = draws.select(F.avg(k / (9 - k))).first()[0]
        assert mean == pytest.approx(level if level < 0.8 else 0.8, abs=0.02)


def test_samples_have_different_concepts_evenly(spark):
    out = synthetic.populations(pool(spark, 7), [5], samples=2000, least=3, most=3)
    assert out.filter(F.size(F.array_distinct("rater_a_concepts")) < 3).count() == 0
    first = [r["count"] for r in out.groupBy(F.get("rater_a_concepts", 0)).count().collect()]
    assert len(first) == 7 and min(first) > 220 and max(first) < 350
    assert out.filter(F.size(F.array_distinct("rater_b_concepts")) < F.size("rater_b_concepts")).count() == 0
    words = out.select(F.explode(F.arrays_zip("rater_b", "rater_b_concepts")).alias("x"))
    assert words.filter(F.substring("x.rater_b", 2, 9) != F.substring("x.rater_b_concepts", 6, 9)).count() == 0


def test_pools_apart(spark):
    c = pool(spark, 12).withColumn("kind", F.when(F.col("ord") < 5, "x").otherwise("y"))
    out = synthetic.populations(c, [1, 2], samples=20, by=["kind"])
    assert {(r["kind"], r["seed"]): r["count"] for r in out.groupBy("kind", "seed").count().collect()} == {(k, s): 20 for k in "xy" for s in (1, 2)}
    terms = {k: set() for k in "xy"}
    for r in out.collect():
        terms[r["kind"]] |= set(r["rater_a_concepts"]) | set(r["rater_b_concepts"])
    assert terms["x"] == {f"term {i}" for i in range(5)} and terms["y"] == {f"term {i}" for i in range(5, 12)}


def test_an_exhausted_pool_repeats(spark):
    out = synthetic.populations(pool(spark, 2), [1], samples=50, least=2, most=5)
    assert out.count() == 50 and out.filter("size(rater_a) <> 2 or size(rater_b) < 2").count() == 0
