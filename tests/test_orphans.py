import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from accordant.functions.keys import code_key, number_key
from accordant.operators import orphans

DAY = datetime(2024, 1, 1)


def run(spark, keys, refs):
    k = spark.createDataFrame(keys, "key string, s timestamp_ntz, u timestamp_ntz")
    r = spark.createDataFrame(refs, "id long, ref string, t timestamp_ntz, h string, start string")
    found = orphans.find_orphans(
        k.select(*orphans.key_rows(F.lit("d"), F.col("key"), F.col("s"), F.col("u"))),
        r.select("id", "ref", *orphans.reference_rows(F.lit("d"), F.col("ref"), F.col("t"))),
        ["id", "ref"],
    )
    return sorted((x["id"], x["fate"]) for x in found.collect())


def at(d):
    return DAY + timedelta(days=d)


def test_fates(spark):
    keys = [("a", at(1), at(5)), ("a", at(10), None), ("b", at(3), None), (None, at(0), None), ("c", None, at(2)), ("b", at(3), None)]
    refs = [(1, "a", 0), (2, "a", 1), (3, "a", 5), (4, "a", 7), (5, "a", 10), (6, "b", 2), (7, "x", 3), (8, None, 3), (9, "c", 1), (10, "c", 2), (11, "b", None), (7, "x", 3)]
    got = run(spark, keys, [(i, r, None if d is None else at(d), None, None) for i, r, d in refs])
    assert got == [(1, "late"), (3, "deleted"), (4, "deleted"), (6, "late"), (7, "missing"), (7, "missing"), (8, "missing"), (10, "deleted"), (11, "late")]


def test_empty_sides(spark):
    assert run(spark, [], [(1, "a", at(1), None, None)]) == [(1, "missing")]
    assert run(spark, [("a", at(1), None)], []) == []


@pytest.mark.parametrize("most", [500_000, 7])
def test_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(orphans, "REFS_PER_GROUP", most)  # 7: every range is crowded and split
    rng = random.Random(3)
    keys = [(f"k{rng.randint(0, 20)}", at(rng.randint(0, 50)), at(rng.randint(50, 90)) if rng.random() < 0.7 else None) for _ in range(60)]
    refs = [(i, "k1" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}", at(rng.randint(0, 100)), None, None) for i in range(400)]
    want = []
    for i, ref, t, *_ in refs:
        own = [(s, u) for k, s, u in keys if k == ref]
        if not any(s <= t and (u is None or t < u) for s, u in own):
            want.append((i, "missing" if not own else "late" if all(s > t for s, _ in own) else "deleted"))
    assert run(spark, keys, refs) == sorted(want)


def test_key_forms(spark):
    df = spark.createDataFrame([(" ab.1\t",), (" ",), ("0010",), ("+10.0",), ("10",), ("0",), ("0.50",), (None,), ("000",)], "c string")
    got = df.select(code_key(F.col("c")).alias("a"), number_key(F.col("c")).alias("b")).collect()
    assert [r["a"] for r in got] == ["AB.1", None, "0010", "+10.0", "10", "0", "0.50", None, "000"]
    assert [r["b"] for r in got] == ["AB.1", None, "10", "10", "10", "0", "0.50", None, "0"]


def test_periods(spark):
    df = spark.createDataFrame([("t", "2024-01", "a", "late"), ("t", "2024-01", "a", "late"), ("t", "2024-02", "b", "missing")], "tbl string, loaded_month string, ref string, fate string")
    got = {(r["loaded_month"], r["n"], r["n_keys"]) for r in orphans.by_period(df).collect()}
    assert got == {("2024-01", 2, 1), ("2024-02", 1, 1)}
