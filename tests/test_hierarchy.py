import random

import pytest
from pyspark.sql import functions as F

from accordant.operators import hierarchy
from accordant.operators.hierarchy import Hierarchy

SCHEMA = "group string, code string, key string, keys array<string>, parents array<string>, version long, id long, path string"


def build(spark, rows):
    full = [(g, c, None if c is None else c.strip().upper() or None, [] if keys is None else keys, parents, i, 1, "x") for i, (g, c, keys, parents) in enumerate(rows)]
    return Hierarchy(spark.createDataFrame(full, SCHEMA))


def test_small_forest_and_cycles(spark):
    h = build(
        spark,
        [
            ("m", "A", ["1"], None),
            ("m", "B", ["1.1"], ["1"]),
            ("m", "C", None, ["9", "B", "A"]),
            ("m", "D", None, ["E"]),
            ("m", "E", None, ["D", "A"]),
            ("m", "F", None, ["D"]),
            ("m", "S", None, ["S"]),
            ("m", None, None, ["A"]),
            ("n", "A", None, ["B"]),
            ("m", "b ", ["1.1"], ["1", None, "1"]),
        ],
    )
    assert sorted(map(tuple, h.cycles().collect())) == [("m", "D", "D"), ("m", "D", "E"), ("m", "S", "S")]
    paths = {(r["group"], r["code"]): (r["path"], r["depth"], r["root"]) for r in h.paths().collect()}
    assert paths["m", "C"] == (["A", "b ", "C"], 2, "A") and paths["m", "A"] == (["A"], 0, "A")
    assert paths["n", "A"] == (["A"], 0, "A") and paths["m", "S"] == (["S"], 0, "S")
    assert paths["m", "F"][0] is None and paths["m", "D"][1] is None
    pairs = sorted((r["code"], r["descendant"]) for r in h.descendants().collect())
    assert pairs == [("A", "C"), ("A", "D"), ("A", "E"), ("A", "F"), ("A", "b "), ("D", "E"), ("D", "F"), ("E", "D"), ("E", "F"), ("b ", "C")]


def test_empty(spark):
    h = build(spark, [])
    assert (h.cycles().count(), h.paths().count(), h.descendants().count()) == (0, 0, 0)


def strong(edges, nodes):
    reach = {u: set() for u in nodes}
    for u in nodes:
        todo = list(edges.get(u, ()))
        while todo:
            v = todo.pop()
            if v not in reach[u]:
                reach[u].add(v)
                todo.extend(edges.get(v, ()))
    return {(min(v for v in reach[u] if u in reach[v]), u) for u in nodes if u in reach[u]}


@pytest.mark.parametrize(("seed", "at_once"), [(0, 10_000), (1, 10_000), (2, 30)])
def test_many_ranges_against_brute_force(spark, monkeypatch, seed, at_once):
    monkeypatch.setattr(hierarchy, "NODES_PER_RANGE", 7 if at_once > 100 else 20)
    monkeypatch.setattr(hierarchy, "LINKS_AT_ONCE", at_once)
    rng = random.Random(seed)
    n = 120 if at_once > 100 else 60
    names = [f"N{i:03d}" for i in range(n)]
    parents = {names[i]: [names[j] for j in ([rng.randrange(i)] if i else []) + ([rng.randrange(n)] if rng.random() < 0.08 else [])] for i in range(n)}
    order = names[:]
    rng.shuffle(order)
    h = build(spark, [("g", c, None, parents[c]) for c in order])
    assert h.ranges > 2
    assert {(r["cycle_code"], r["code"]) for r in h.cycles().collect()} == strong(parents, names)
    reach = {u: set() for u in names}
    for u in names:
        todo = list(parents[u])
        while todo:
            v = todo.pop()
            if v not in reach[u]:
                reach[u].add(v)
                todo.extend(parents[v])
    got = [(r["code"], r["descendant"]) for r in h.descendants().collect()]
    assert len(got) == len(set(got)) and set(got) == {(v, u) for u in names for v in reach[u] if v != u}
    for r in h.paths().collect():
        way, at = [], r["code"]
        while at is not None and at not in way:
            way.append(at)
            at = next((p for p in parents[at] if p != at), None)
        assert r["path"] == (way[::-1] if at is None else None)


def test_chain_and_star(spark):
    chain = [("g", f"C{i:05d}", None, [f"C{i - 1:05d}"] if i else None) for i in range(3000)]
    star = [("s", "R", None, None)] + [("s", f"L{i}", None, ["R"]) for i in range(3000)]
    h = build(spark, chain + star)
    assert h.cycles().count() == 0
    top = h.paths().agg(F.max("depth").alias("d"), F.count(F.lit(1)).alias("n")).first()
    assert (top["d"], top["n"]) == (2999, 6001)


def test_heights_and_odd_links():
    sets = hierarchy.Sets(6)
    for a, b in ((0, 1), (1, 2), (3, 2), (0, 4), (4, 2)):
        sets.link(a, b, 1)
    heights = [sets.find(i)[1] for i in range(5)]
    assert [h - heights[0] for h in heights] == [0, 1, 2, 1, 1] and not sets.odd[sets.find(0)[0]]
    sets.link(2, 0, 1)  # closes a cycle
    sets.link(5, 3, 1)
    assert sets.odd[sets.find(5)[0]]


def test_no_cycles_without_the_forest(spark, monkeypatch):
    h = build(spark, [("m", "A", None, ["B"]), ("m", "B", None, ["A"])])
    assert h.cycles().count() == 2
    monkeypatch.setattr(hierarchy, "forest", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        h.cycles()


def test_a_group_is_never_above_its_bound(spark, monkeypatch):
    """Random codes with two parents each: what is left after the ranges is contracted by rounds until it fits."""
    monkeypatch.setattr(hierarchy, "NODES_PER_RANGE", 300)
    monkeypatch.setattr(hierarchy, "LINKS_AT_ONCE", 700)
    rng = random.Random(1)
    number = [((i // 300) << hierarchy.SHIFT) + i % 300 for i in range(1500)]
    rows = [(number[i], number[rng.randrange(i)]) for i in range(1, 1500) for _ in range(2)]
    seen, contracted = [], hierarchy._contracted
    monkeypatch.setattr(hierarchy, "_contracted", lambda links, turn=0: (seen.append(links.count()), contracted(links, turn))[1])
    got = hierarchy.forest(spark.createDataFrame(rows, "u long, p long"), 5).select("x", "root").distinct().collect()
    assert len({r["root"] for r in got}) == 1 and {r["x"] for r in got} == set(number)
    assert len(seen) > 1 and seen[0] > 700 >= seen[-1]


def test_a_long_chain_has_no_odd_link(spark, monkeypatch):
    n = 100_000
    chain = spark.range(1, n).select(F.col("id").alias("u"), (F.col("id") - 1).alias("p"))
    sets = hierarchy.forest(chain, 1)
    assert sets.agg(F.max("height") - F.min("height")).first()[0] == n - 1 and sets.filter("odd").isEmpty()
