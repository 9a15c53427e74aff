import random
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from accordant.functions import distances as d
from accordant.functions.text import label_set, lcs, words
from accordant.operators.measures import MEASURES


def apply(spark, measure, rows):
    df = spark.createDataFrame([(i, a, b, 0) for i, (a, b) in enumerate(rows)], "i int, a array<string>, b array<string>, distance int")
    out = df.select("i", measure(label_set(F.col("a")), label_set(F.col("b"))).alias("d")).orderBy("i").collect()
    return [r["d"] for r in out]


PAIRS = [MEASURES[n].pair for n in ("exact_match", "jaccard", "set_jaccard", "masi", "levenshtein", "indel", "lcsseq")]


@pytest.mark.parametrize("measure", PAIRS)
def test_empty_rule(spark, measure):
    got = apply(spark, measure, [(None, None), ([], [None]), (["x"], []), (None, ["x"]), (["x"], ["x"]), (["b", "a", "a"], ["a", "b"]), (["x y"], ["q"])])
    assert got == [0.0, 0.0, 1.0, 1.0, 0.0, 0.0, pytest.approx(1.0)]


@pytest.mark.parametrize(
    ("measure", "a", "b", "want"),
    [
        (d.set_jaccard, ["fever", "cough"], ["fever", "chills"], 2 / 3),
        (d.set_jaccard, ["diabetes mellitus"], ["mellitus fever"], 1.0),
        (d.masi, ["kidney failure"], ["acute kidney failure"], 1 - 2 / 3 * 0.67),
        (d.masi, ["acute renal failure"], ["acute kidney failure"], 1 - 2 / 4 * 0.33),
        (d.levenshtein, ["cat"], ["cots"], 2 / 4),
        (d.levenshtein, ["été"], ["ete"], 2 / 3),
        (d.indel, ["cat"], ["cots"], 3 / 7),
        (d.lcs_distance, ["kitten"], ["sitting"], 3 / 7),
        (d.word_jaccard, ["Acute Fever"], ["fever"], 1 / 2),
        (d.exact_match, ["a", "b"], ["b", "a"], 0.0),
    ],
)
def test_known_values(spark, measure, a, b, want):
    assert apply(spark, measure, [(a, b)]) == [pytest.approx(want)]


def test_very_long_labels(spark):
    assert apply(spark, d.lcs_distance, [(["ab" * 20_000], ["a" * 20_000])]) == [pytest.approx(0.5)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcé🙂", max_size=14), st.text(alphabet="abcé🙂", max_size=14))
def test_lcs_is_that_of_the_recursion(a, b):
    @lru_cache(None)
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return f(i + 1, j + 1) + 1 if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

    assert lcs(a, b) == f(0, 0)


def test_words(spark):
    rows = [('He said "no", Dr. X.', ["he", "said", "``", "no", "''", ",", "dr.", "x", "."]), ("don't we'll (go)", ["do", "n't", "we", "'ll", "(", "go", ")"]), ("3,000 mg; x", ["3,000", "mg", ";", "x"]), ("", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = [r["w"] for r in df.select("i", words(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got[1:] == [w for _, w in rows[1:]]
    assert got[0][:6] == rows[0][1][:6] and got[0][-1] == "."


def test_model_costs(spark):
    df = spark.createDataFrame(
        [(0.5, 0.5, "0.9, 1.4", 'x {"y_entails_x": 0.25, "x_entails_y": 2}'), (None, None, "nonsense", None), (0.3, None, "1", "{}"), (None, 0.2, None, '{"x_entails_y":\n0.5}')],
        "y double, n double, spoken string, js string",
    )
    r = df.select(
        d.answer_cost(F.col("y"), F.col("n")).alias("a"), d.entailment_cost(F.col("y"), F.col("n")).alias("e"), d.directed_cost(F.col("y"), F.col("n")).alias("c"),
        d.logit_cost(F.col("y"), F.col("n")).alias("l"), d.spoken_costs(F.col("spoken")).alias("s"), d.json_costs(F.col("js")).alias("j"),
    ).collect()
    assert [x["a"] for x in r] == [0.5, 0.5, 0.0, 1.0]
    assert [x["e"] for x in r] == [pytest.approx(0.5), 1.0, 1.0, 1.0]
    assert [x["c"] for x in r] == [pytest.approx(0.5), 1.0, 1.0, 1.0]
    assert [x["l"] for x in r] == [0.5, 0.5, 0.5, 0.5]
    assert [tuple(x["s"]) for x in r] == [(pytest.approx(0.1), 0.0), (0.5, 0.5), (0.5, 0.5), (0.5, 0.5)]
    assert [tuple(x["j"]) for x in r] == [(0.75, 0.0), (0.5, 0.5), (0.5, 0.5), (0.5, 0.5)]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([2.0, 0.0], [-1.0, 0.0])], "u array<float>, v array<float>")
    assert [x[0] for x in v.select(d.cosine_cost(F.col("u"), F.col("v"))).collect()] == [pytest.approx(1 - 0.5**0.5), 1.0, pytest.approx(2.0)]


def test_symmetry(spark):
    random.seed(1)
    rows = [([random.choice("abc") * random.randint(1, 3) for _ in range(3)], [random.choice("abc") for _ in range(2)]) for _ in range(30)]
    for m in PAIRS:
        assert apply(spark, m, rows) == pytest.approx(apply(spark, m, [(b, a) for a, b in rows]))
