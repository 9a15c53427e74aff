import itertools
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.operators import ablation, matching, measures
from accordant.operators.matching import greedy, least_cost, soft_dice


def brute(c):
    n, m = len(c), len(c[0])
    if n > m:
        return brute([list(x) for x in zip(*c)])
    return min(sum(c[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n))


@pytest.mark.parametrize("seed", range(60))
def test_least_cost(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 5), rng.randint(1, 6)
    c = [[rng.choice([rng.random(), 0.5, -0.2]) for _ in range(m)] for _ in range(n)]
    pairs = least_cost(c)
    assert len(pairs) == min(n, m) and sum(c[i][j] for i, j in pairs) == pytest.approx(brute(c))
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    assert soft_dice(c, greedy(c)) >= soft_dice(c, pairs) - 1e-12


def test_greedy_can_lose():
    c = [[0, 0.4], [0.1, 1]]
    assert least_cost(c) == [(0, 1), (1, 0)] and greedy(c) == [(0, 0), (1, 1)]


def test_infinite_costs():
    inf = float("inf")
    assert least_cost([[inf, 1.0], [1.0, inf]]) == [(0, 1), (1, 0)]
    with pytest.raises(ValueError):
        least_cost([[inf]])


def test_frames(spark):
    df = spark.createDataFrame([(1, [[0.0, 0.4], [0.1, 1.0]], 5), (2, None, 5), (3, [], 5), (4, [[0.5]], 5)], "id int, cost array<array<double>>, d_greedy int")
    r = {x["id"]: x for x in df.select("id", "cost", matching.match("cost").alias("m")).select("id", "m.*", matching.under(F.col("cost"), F.col("m.greedy")).alias("again"), matching.confident(F.col("cost"), F.col("m.hungarian")).alias("firm")).collect()}
    assert (r[1]["d_hungarian"], r[1]["d_greedy"], r[1]["again"]) == (pytest.approx(0.25), pytest.approx(0.5), pytest.approx(0.5))
    assert [tuple(p) for p in r[1]["hungarian"]] == [(0, 1), (1, 0)] and [tuple(p) for p in r[1]["firm"]] == [(1, 0)]
    assert r[2]["d_greedy"] is None and r[3]["d_greedy"] is None and r[4]["d_greedy"] == 0.5


@pytest.mark.parametrize("name", ["bipartite_jaccard", "bipartite_levenshtein", "bipartite_indel", "bipartite_lcsseq"])
def test_string_measures(spark, name):
    pairs = spark.createDataFrame([([], []), (["x"], []), (["a", "b"], ["a", "b"]), (["red rash"], ["green", "red rash"])], "a array<string>, b array<string>")
    got = {(tuple(r["a"]), tuple(r["b"]), r["matching"]): r["distance"] for r in measures.score_pairs(pairs, measures.MEASURES[name]).collect()}
    assert len(got) == 8 and got[(), (), "greedy"] == 0.0 and got[("x",), (), "hungarian"] == 1.0
    assert got[("a", "b"), ("a", "b"), "greedy"] == 0.0
    assert got[("red rash",), ("green", "red rash"), "hungarian"] == pytest.approx(1 - 2 / 3)


def test_costs_from_a_table(spark):
    pairs = spark.createDataFrame([(["a", "b"], ["c", "b"])], "a array<string>, b array<string>")
    costs = spark.createDataFrame([("a", "c", 0.2), ("b", "c", 0.3)], "x string, y string, cost double")
    m = measures.MEASURES["nli"]
    got = {r["matching"]: r["distance"] for r in measures.score_pairs(pairs, m, costs).collect()}
    assert got["hungarian"] == pytest.approx(1 - 2 * (0.8 + 1.0) / 4)
    single = measures.score_pairs(pairs, measures.MEASURES["nli_single"], costs).collect()
    assert [(r["matching"], round(r["distance"], 6)) for r in single] == [("none", 0.1)]
    with pytest.raises(ValueError):
        measures.score_pairs(pairs, m)


def test_registry():
    assert {m.name for m in measures.for_mode("single")} >= {"exact_match", "nli_single"} and not any(m.single for m in measures.for_mode("set"))
    assert measures.MEASURES["nli"].strategies == ("hungarian", "greedy") and measures.MEASURES["masi"].strategies == ("none",)
    assert len(measures.MEASURES) == 27


def decisive(cost):
    return bool(ablation.decisive(np.array([cost], float))[0])


def test_decisive():
    assert decisive([[0.1, 0.9], [0.8, 0.2]])
    assert not decisive([[0.5, 0.5], [0.5, 0.5]])
    assert not decisive([[0.1, 0.1], [0.9, 0.2]])
    assert decisive([[0.3]]) and decisive([[0.1, 0.5, 0.9]]) and decisive([[0.1], [0.5]])
    assert not decisive([[0.2, 0.9], [0.2, 0.8]]) and decisive([[0.2, 0.9], [0.3, 0.8]])


def second_best(cost):
    """How much worse the next assignment is, by trying all of them."""
    wide = cost if len(cost) <= len(cost[0]) else [list(c) for c in zip(*cost)]
    totals = sorted(sum(wide[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(wide[0])), len(wide)))
    return totals[1] - totals[0] if len(totals) > 1 else float("inf")


def has_rival(cost):
    free = {(i, j): x for i, row in enumerate(cost) for j, x in enumerate(row)}
    for i, j in greedy(cost):
        if any(x <= free[i, j] + ablation.TOLERANCE for at, x in free.items() if at != (i, j)):
            return True
        free = {at: x for at, x in free.items() if at[0] != i and at[1] != j}
    return False


@pytest.mark.parametrize("shape", [(1, 1), (1, 4), (2, 2), (3, 3), (3, 5), (4, 2), (5, 4), (5, 5)])
def test_margins_against_all_assignments(shape):
    rng = random.Random(5)
    costs = [[[rng.choice([0.1, 0.25, 0.4, rng.random()]) for _ in range(shape[1])] for _ in range(shape[0])] for _ in range(60)]
    want = [second_best(c) > ablation.TOLERANCE and not has_rival(c) for c in costs]
    assert ablation.decisive(np.array(costs)).tolist() == want


def test_stacked_assignments_against_all():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (2, 5), (5, 2), (4, 4), (5, 6)):
        stack = np.where(rng.random((200, n, m)) < 0.4, 0.5, rng.random((200, n, m)) - 0.2)
        best = matching.best_cells(stack)
        for c, cells in zip(stack.tolist(), best.tolist()):
            assert sum(c[x // m][x % m] for x in cells) == pytest.approx(brute(c)) and cells == sorted(cells)
            assert len({x // m for x in cells}) == len({x % m for x in cells}) == min(n, m)


def test_decisive_matrices_do_not_hang_on_order():
    rng = np.random.default_rng(3)
    stack = rng.random((80, 3, 4))
    stack = stack[ablation.decisive(stack)]
    true = rng.random((len(stack), 12)) < 0.3
    for found in ablation.hits(stack, true, np.arange(len(stack)), 12):
        assert (found == found[:, :1]).all()


def test_layouts_are_permutations():
    order = ablation.layouts(np.arange(50) - 25, 30, 4)
    assert (np.sort(order, 2) == np.arange(4)).all() and (order[:, 0] == np.arange(4)).all()
    assert len({tuple(o) for o in order[:, 1:].reshape(-1, 4).tolist()}) == 24


def test_stacks_leave_out_what_is_no_matrix():
    import pyarrow as pa

    cost = pa.array([None, [], [[]], [[0.1, 0.2], [0.3]], [[1.0]], [[0.1, 0.2]], [None], [[None]], [[float("nan")]], [[3.0]]], pa.list_(pa.list_(pa.float64())))
    got = {tuple(at.tolist()): stack.tolist() for at, stack in matching.stacks(cost)}
    assert got == {(4, 9): [[[1.0]], [[3.0]]], (5,): [[[0.1, 0.2]]]}
    assert {tuple(at.tolist()) for at, _ in matching.stacks(cost.slice(4, 2))} == {(0,), (1,)}


def test_ablation(spark):
    t = "array<struct<i:int,j:int>>"
    df = spark.createDataFrame(
        [(1, "m", [[0.0, 0.4], [0.1, 1.0]], [(0, 1), (1, 0)], "x"), (2, "m", [], [(0, 0)], "x"), (3, "m", [[0.1]], [], "x"), (4, "n", [[0.2, 0.2]], [(0, 1)], "x"), (5, "n", None, None, "x")],
        f"id int, measure string, cost array<array<double>>, truth {t}, decisive string",
    )
    rows = ablation.run(df, ["id", "measure"], permutations=6)
    assert sorted({r["id"] for r in rows.collect()}) == [1, 4] and rows.count() == 12
    out = {r["measure"]: r for r in ablation.summarise(rows, ["id"]).collect()}
    assert (out["m"]["recall_hungarian"], out["m"]["recall_greedy"], out["m"]["decisive"], out["m"]["unstable"]) == (1.0, 0.0, 1.0, 0.0)
    assert out["n"]["unstable"] == 1.0 and out["n"]["decisive"] == 0.0
    assert "measure" in ablation.format_summary([r.asDict() for r in out.values()])
    assert ablation.summarise(ablation.run(df.filter("id = 2"), ["id", "measure"]), ["id"]).count() == 0
