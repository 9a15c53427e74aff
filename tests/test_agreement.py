import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.operators import agreement, chance, distribution, measures, summaries

M = measures.MEASURES
TWO = "g string, item_id long, rater_a array<string>, rater_b array<string>, a string, labels string, pos string"
#: Ratings of the worked example of Fleiss (1971), raters of 10 items over 5 categories.
FLEISS = [(0, 0, 0, 0, 14), (0, 2, 6, 4, 2), (0, 0, 3, 5, 6), (0, 3, 9, 2, 0), (2, 2, 8, 1, 1), (7, 7, 0, 0, 0), (3, 2, 6, 3, 0), (2, 5, 3, 2, 2), (6, 5, 2, 1, 0), (0, 2, 2, 3, 7)]


def two(spark, groups, measure="exact_match", **kw):
    rows = [(g, i, [a] if isinstance(a, str) else a, [b] if isinstance(b, str) else b, "x", "y", "z") for g, pairs in groups.items() for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, TWO)
    return {(r["g"], r["matching"]): r for r in agreement.two_raters(df, ["g"], M[measure], **kw).collect()}


def test_worked_examples(spark):
    got = two(
        spark,
        {
            "table": [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15,
            "perfect": [("A", "A")] * 3 + [("B", "B")] * 7,
            "chance": [("X", "X")] * 25 + [("X", "Y")] * 25 + [("Y", "X")] * 25 + [("Y", "Y")] * 25,
            "opposite": [("A", "B")] * 10 + [("B", "A")] * 10,
            "one label": [("A", "A")] * 4,
            "never": [("A", "B")] * 3,
            "nulls": [(None, []), (None, None)],
        },
    )
    assert len(got) == 7
    value = lambda g: tuple(got[g, "none"][c] for c in ("average_agreement", "cohens_kappa", "scotts_pi"))
    assert value("table") == pytest.approx((0.7, 0.4, 0.195 / 0.495))
    assert value("perfect") == pytest.approx((1, 1, 1)) and value("one label") == (1, 1, 1)
    assert value("chance") == pytest.approx((0.5, 0, 0)) and value("opposite") == pytest.approx((0, -1, -1))
    assert value("never") == pytest.approx((0, 0, -1)) and value("nulls") == (1, 1, 1)
    assert all(0 <= r["ks"] <= 1 and 0 <= r["sigma"] <= 1 for r in got.values())


def test_soft_kappa(spark):
    rows = {"t": [("diabetes", "diabetes mellitus"), ("asthma", "asthma"), ("migraine", "headache")]}
    r = two(spark, rows, "jaccard", distribution=False)["t", "none"]
    assert (r["average_agreement"], r["cohens_kappa"]) == pytest.approx((0.5, 0.4))


def test_strategies_and_chance_measure(spark):
    rows = {"t": [(["kidney failure", "cough"], ["renal failure", "cough"]), (["fever"], ["high fever", "chills"]), (["a b", "b c"], ["c b", "a a"])]}
    got = two(spark, rows, "bipartite_levenshtein", chance_measure=M["exact_match"])
    assert set(got) == {("t", "hungarian"), ("t", "greedy")}
    assert got["t", "greedy"]["average_agreement"] <= got["t", "hungarian"]["average_agreement"] + 1e-12
    assert got["t", "greedy"]["n_items"] == 3


def sides(spark, n, groups=("g",)):
    rows = [(g, [f"{s}{i}"], i) for g in groups for s in "ab" for i in range(n)]
    df = spark.createDataFrame(rows, "g string, labels array<string>, pos long")
    return df.filter("labels[0] like 'a%'"), df.filter("labels[0] like 'b%'")


@pytest.mark.parametrize(("n", "options", "pairs"), [(100, {}, 300), (40, {}, 300), (400, {}, 300), (100, {"shuffles": 5}, 500), (20, {"max_exact": 400}, 400), (50, {"target": 60}, 60)])
def test_drawn_pairs(spark, n, options, pairs):
    left, right = sides(spark, n, ("g", "h"))
    out = chance.chance_pairs(left, right, ["g"], **options).groupBy("g").agg(F.sum("weight").alias("w"), F.sum(F.round(F.col("weight") * pairs)).alias("n")).collect()
    assert [(round(r["w"], 9), r["n"]) for r in out] == [(1.0, pairs)] * 2
    again = chance.chance_pairs(left, right, ["g"], **options)
    first = sorted(map(str, chance.chance_pairs(left.repartition(3), right, ["g"], **options).collect()))
    assert sorted(map(str, again.collect())) == first


def test_drawn_chance_is_near_the_exact(spark):
    rng = random.Random(0)
    rows = [(["abc"[min(2, int(rng.random() * 4))]], [rng.choice("abc")]) for _ in range(2000)]
    exact = two(spark, {"g": rows}, distribution=False)["g", "none"]["cohens_kappa"]
    drawn = two(spark, {"g": rows}, distribution=False, max_exact=1)["g", "none"]["cohens_kappa"]
    assert drawn == pytest.approx(exact, abs=0.12)


def long(spark, items):
    rows = [("g", str(i), s, labels if isinstance(labels, list) else [labels], "x") for i, item in enumerate(items) for s, labels in enumerate(item)]
    return spark.createDataFrame(rows, "g string, item string, slot int, labels array<string>, a string")


def test_many_raters(spark):
    r = agreement.many_raters(long(spark, [[c for c, n in zip("abcde", item) for _ in range(n)] for item in FLEISS]), ["g"], M["exact_match"], distribution=False).first()
    assert (r["average_agreement"], r["fleiss_kappa"]) == pytest.approx((0.378, 0.210), abs=5e-4)
    r = agreement.many_raters(long(spark, ["AAB", "ABB", "AB", "BA"]), ["g"], M["exact_match"]).first()
    assert (r["average_agreement"], r["cohens_kappa"], r["fleiss_kappa"]) == pytest.approx((1 / 6, -1 / 6, -2 / 3))
    r = agreement.many_raters(long(spark, ["AA", "BBB", "AAAA"]), ["g"], M["set_jaccard"]).first()
    assert (r["average_agreement"], r["cohens_kappa"], r["fleiss_kappa"]) == (1, 1, 1)


def test_two_of_many_equal_two(spark):
    rng = random.Random(2)
    pairs = [(rng.choice("abc"), rng.choice("abc")) for _ in range(40)]
    a = two(spark, {"g": pairs}, distribution=False)["g", "none"]
    b = agreement.many_raters(long(spark, pairs), ["g"], M["exact_match"], distribution=False).first()
    assert (a["average_agreement"], a["cohens_kappa"], a["scotts_pi"]) == pytest.approx((b["average_agreement"], b["cohens_kappa"], b["fleiss_kappa"]))


@pytest.mark.parametrize("name", ["exact_match", "jaccard", "set_jaccard", "masi"])
def test_keys_give_the_exact_chance(spark, name):
    rng = random.Random(5)
    some = lambda: rng.sample(["red rash", "rash", "cyst", "red cyst", "scale"], rng.randint(0, 3))
    pairs = {"g": [(some(), some()) for _ in range(60)], "h": [([], []), (["x"], [])]}
    a, b = two(spark, pairs, name, distribution=False), two(spark, pairs, name, distribution=False, max_exact=10**6)
    for k in a:
        for c in ("n_items", "average_agreement", "cohens_kappa", "scotts_pi"):
            assert a[k][c] == pytest.approx(b[k][c])
    items = [[some() for _ in range(rng.randint(2, 4))] for _ in range(25)]
    x = agreement.many_raters(long(spark, items), ["g"], M[name], distribution=False).first()
    y = agreement.many_raters(long(spark, items), ["g"], M[name], distribution=False, max_exact=10**6).first()
    assert x[2:] == pytest.approx(y[2:])


def test_empty_frames(spark):
    empty = spark.createDataFrame([], TWO)
    assert agreement.two_raters(empty, ["g"], M["set_jaccard"]).count() == 0
    assert agreement.many_raters(long(spark, []), ["g"], M["set_jaccard"]).count() == 0


def samples(spark, observed, expected):
    rows = [("g", "observed", float(v), 1.0) for v in observed] + [("g", "expected", float(v), w) for v, w in expected]
    return spark.createDataFrame(rows, "g string, kind string, value double, weight double")


def test_sigma_and_ks(spark):
    s = samples(spark, [0.0] * 5, [(k / 5, 1.0) for k in range(1, 6)])
    assert distribution.sigma_by_group(s, ["g"]).first()["sigma"] == 1.0
    assert distribution.ks_by_group(s, ["g"]).first()["ks"] > 0.9
    constant = samples(spark, [1 / 3] * 4, [(1 / 3, 0.1)] * 10)
    assert distribution.sigma_by_group(constant, ["g"]).first()["sigma"] == 0.0
    assert distribution.ks_by_group(constant, ["g"]).first()["ks"] == 0.0


def test_quantile_and_frequencies():
    assert distribution.quantile(np.array([1.0, 2.0]), np.array([1, 1]), 0.05) == pytest.approx(1.05)
    x = np.array([0.3, 0.1, 0.9])
    n = np.array([2, 3, 1])
    assert distribution.quantile(x, n, 0.37) == pytest.approx(np.quantile(np.repeat(x, n), 0.37))
    assert distribution.frequencies(np.array([0.3, 0.1])).tolist() == [3, 1]
    assert distribution.frequencies(np.array([1.0, 1e9])).sum() <= distribution.CAP + 1 and len(distribution.frequencies(np.array([]))) == 0


def test_sigma_against_a_plain_density():
    rng = np.random.default_rng(1)
    o, e = rng.random(30) * 0.5, rng.random(200)
    h = e.std(ddof=1) * len(e) ** -0.2
    cdf = lambda x: 0.5 * (1 + math.erf(x / 2**0.5))
    want = np.mean([np.mean([cdf((d - x) / h) - cdf(-x / h) for x in e]) < 0.05 for d in o])
    assert distribution.sigma(o, np.ones(30), e, np.ones(200)) == pytest.approx(want)


def test_krippendorff_by_brute_force(spark):
    rng = random.Random(4)
    rows = [("g", str(i), f"w{k}", [rng.choice("ab")], i * 5 + k) for i in range(12) for k in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "g string, item string, worker string, labels array<string>, pos long")
    r = distribution.krippendorff(df, ["g"], M["exact_match"]).first()
    plain = distribution.krippendorff(df, ["g"], measures.Measure("plain", M["exact_match"].pair)).first()
    assert tuple(plain)[1:] == pytest.approx(tuple(r)[1:])
    same = [x[3] != y[3] for x in rows for y in rows if x[4] > y[4] and x[1] == y[1]]
    other = [x[3] != y[3] for x in rows for y in rows if x[4] > y[4] and x[1] != y[1]]
    assert (r["observed"], r["expected"]) == pytest.approx((np.mean(same), np.mean(other)))
    assert r["alpha"] == pytest.approx(1 - np.mean(same) / np.mean(other))


def test_chunks(spark):
    df = spark.createDataFrame([(f"i{k:02d}", float(k % 7)) for k in range(14)] * 2, "item string, error double")
    out = distribution.chunks_by_error(df, 4).collect()
    sizes = sorted([sum(r["chunk"] == c for r in out) for c in {r["chunk"] for r in out}], reverse=True)
    assert sizes == [5, 5, 4] and max(r["error"] for r in out if r["chunk"] == 1) <= min(r["error"] for r in out if r["chunk"] == 3)
    with pytest.raises(ValueError):
        distribution.chunks_by_error(df, 2)


def test_errors_and_significance(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.5, 1.0), (None, 1.0)], "v double, t double")
    r = df.select(summaries.absolute_error(F.col("v"), F.col("t")).alias("a"), summaries.percent_error(F.col("v"), F.col("t")).alias("p")).collect()
    assert r[0]["a"] == 0.5 and math.isnan(r[0]["p"]) and r[1]["p"] == 50.0 and r[2]["a"] is None
    rng = np.random.default_rng(0)
    rows = [("g", m, s, float(base + rng.random() * 0.01), 0.0) for m, base in (("best", 0.1), ("worse", 0.5), ("alike", 0.1005)) for s in range(30)]
    rows += [("g", "sparse", 0, 0.3, float("nan")), ("h", "alone", 1, 0.2, 1.0)]
    t = spark.createDataFrame(rows, "g string, measure string, seed long, mae double, mape double")
    out = {(r["g"], r["measure"]): r for r in summaries.significance(t, ["g"]).collect()}
    assert out["g", "worse"]["significant"] and out["g", "worse"]["best_measure"] == "best" and out["g", "best"]["is_best"]
    assert math.isnan(out["g", "sparse"]["p_value"]) and not out["g", "sparse"]["significant"] and out["h", "alone"]["is_best"]
    e = {(r["g"], r["measure"]): r for r in summaries.error_table(t, ["g"]).collect()}
    assert e["g", "sparse"]["mean_mape"] is None and e["h", "alone"]["std_mae"] == 0.0
    named = spark.createDataFrame([("m", "greedy"), ("m", "hungarian"), ("m", None)], "a string, b string").select(summaries.strategy_name(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in named] == ["m (greedy)", "m", "m"]


def test_error_function():
    import math

    x = np.concatenate([np.linspace(-7, 7, 20_001), [0.0, -0.0, 1e-300, 40.0, -40.0, np.inf]])
    assert np.abs(distribution.erf(x) - [math.erf(v) for v in x]).max() < 1e-12
