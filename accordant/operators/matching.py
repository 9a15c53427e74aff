"""Distances by matching the labels of two sets one to one.

A pair of sets has a cost for each pair of labels.  The least-cost assignment and the greedy one come out of one pass
over the matrix, and so do the distances under both: one minus the soft Dice overlap of the matched labels.

Matrices of one shape are a stack, and both algorithms go through all of a stack at once: a step of the search for
augmenting paths, or of the greedy choice, is a few array operations however many matrices there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.functions import distances
from accordant.functions.text import lcs

Matrix = list[list[float]]
#: Below this cost a matched pair counts as confident.
CONFIDENT, CONFIDENT_EMBEDDING = 1 / 3, 0.9


def best_columns(costs: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of least total cost; -1 throughout where none has a finite cost.

    ``costs`` is a stack (matrix, row, column) with at least as many columns as rows.  Rows join one by one, each over
    a shortest augmenting path in costs reduced by potentials; of equally near columns the first goes first.
    """
    count, n, m = costs.shape
    row_of, column_of = np.full((count, m), -1), np.full((count, n), -1)
    u, v = np.zeros((count, n)), np.zeros((count, m))
    possible = np.ones(count, bool)
    everyone = np.arange(count)
    for row in range(n):
        far, via = np.full((count, m), np.inf), np.full((count, m), -1)
        closed = np.zeros((count, m), bool)
        length, end = np.zeros(count), np.full(count, -1)
        live, at = everyone[possible], np.full(count, row)
        while len(live):
            here = at[live]
            reach = length[live, None] + costs[live, here] - u[live, here, None] - v[live]
            nearer = ~closed[live] & (reach < far[live])
            far[live] = np.where(nearer, reach, far[live])
            via[live] = np.where(nearer, here[:, None], via[live])
            open_ = np.where(closed[live], np.inf, far[live])
            column = open_.argmin(1)
            length[live] = open_[np.arange(len(live)), column]
            stuck = np.isinf(length[live])
            possible[live[stuck]] = False
            live, column = live[~stuck], column[~stuck]
            closed[live, column] = True
            owner = row_of[live, column]
            end[live[owner < 0]] = column[owner < 0]
            at[live] = owner
            live = live[owner >= 0]
        done = everyone[possible]
        # potentials of the rows and columns on the way, so that reduced costs stay at zero or above
        b, c = np.nonzero(closed & possible[:, None])
        slack, owner = length[b] - far[b, c], row_of[b, c]
        u[done, row] += length[done]
        np.add.at(u, (b[owner >= 0], owner[owner >= 0]), slack[owner >= 0])
        v[b, c] -= slack
        column = end[done]
        while len(done):
            taker = via[done, column]
            row_of[done, column] = taker
            left = column_of[done, taker]
            column_of[done, taker] = column
            more = taker != row
            done, column = done[more], left[more]
    column_of[~possible] = -1
    return column_of


def greedy_cells(costs: np.ndarray, tolerance: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The cells (row times columns plus column) that a greedy choice takes in its order, and whether a step had a rival.

    Cheapest cell first, of equal ones the first by row and column; its row and column are then out.  A rival is
    another cell still in that costs at most ``tolerance`` more.
    """
    count, n, m = costs.shape
    left = np.minimum(costs, np.finfo(float).max)
    taken, tied = np.empty((count, min(n, m)), np.int64), np.zeros(count, bool)
    each = np.arange(count)
    for step in range(min(n, m)):
        flat = left.reshape(count, n * m)
        cell = flat.argmin(1)
        taken[:, step] = cell
        tied |= (flat <= flat[each, cell, None] + tolerance).sum(1) > 1
        left[each, cell // m, :] = np.inf
        left[each, :, cell % m] = np.inf
    return taken, tied


def best_cells(costs: np.ndarray) -> np.ndarray:
    """The cells of a least-cost assignment in the order of their rows; -1 where there is none of finite cost."""
    count, n, m = costs.shape
    if n <= m:
        columns = best_columns(costs)
        return np.where(columns < 0, -1, np.arange(n) * m + columns)
    rows = best_columns(costs.transpose(0, 2, 1))
    return np.sort(np.where(rows < 0, -1, rows * m + np.arange(m)), axis=1)


def least_cost(cost: Matrix) -> list[tuple[int, int]]:
    """An assignment of least total cost, rows in order."""
    if not cost or not cost[0]:
        return []
    cells = best_cells(np.array([cost], float))[0].tolist()
    if cells[0] < 0:
        raise ValueError("no assignment has a finite cost")
    return [divmod(c, len(cost[0])) for c in cells]


def greedy(cost: Matrix) -> list[tuple[int, int]]:
    """The cells of the greedy choice in its order."""
    if not cost or not cost[0]:
        return []
    return [divmod(c, len(cost[0])) for c in greedy_cells(np.array([cost], float))[0][0].tolist()]


def stacks(cost: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the matrices of each shape in an array of lists of lists, and their stack.

    Null and empty matrices, those whose rows differ in length and those with a null or NaN cost are left out.
    """
    if isinstance(cost, pa.ChunkedArray):
        cost = cost.combine_chunks()
    n = pc.fill_null(pc.list_value_length(cost), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = cost.flatten()
    width = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = rows.flatten().to_numpy(zero_copy_only=False).astype(float)
    some = np.flatnonzero(n)
    if not len(some):
        return
    first = np.cumsum(n) - n
    least, most = np.minimum.reduceat(width, first[some]), np.maximum.reduceat(width, first[some])
    even = (least == most) & (least > 0)
    some, m = some[even], least[even]
    start = (np.cumsum(width) - width)[first[some]]
    shape = np.stack([n[some], m])
    for k in np.unique(shape, axis=1).T:
        of = np.flatnonzero((shape == k[:, None]).all(0))
        stack = values[start[of][:, None] + np.arange(k[0] * k[1])].reshape(-1, *k)
        sound = ~np.isnan(stack).any((1, 2))
        if sound.any():
            yield some[of[sound]], stack[sound]


def soft_dice(cost: Matrix, pairs: list[tuple[int, int]]) -> float:
    """The distance under an assignment; unmatched labels count against it."""
    return 1.0 - 2.0 * sum(1.0 - cost[i][j] for i, j in pairs) / (len(cost) + len(cost[0]))


_PAIRS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))
MATCHED = T.StructType(
    [T.StructField("d_hungarian", T.DoubleType()), T.StructField("d_greedy", T.DoubleType()), T.StructField("hungarian", _PAIRS), T.StructField("greedy", _PAIRS)]
)


def _lists(count: int, found: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.Array:
    """Lists of pairs from (places, cells, columns) of each shape; null for a place that none has."""
    size = np.zeros(count, np.int64)
    for at, cells, _ in found:
        size[at] = cells.shape[1]
    upto = np.concatenate([[0], np.cumsum(size)])
    i, j = np.empty(upto[-1], np.int32), np.empty(upto[-1], np.int32)
    for at, cells, m in found:
        to = upto[at][:, None] + np.arange(cells.shape[1])
        i[to], j[to] = np.divmod(cells, m)
    pairs = pa.StructArray.from_arrays([pa.array(i), pa.array(j)], ["i", "j"])
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pairs, mask=pa.array(size == 0))


@F.arrow_udf(MATCHED)
def match(cost: pa.Array) -> pa.Array:
    """Both assignments of a cost matrix and the distances under them; null for a null, empty, uneven or NaN matrix and
    one that no assignment covers at a finite cost."""
    count = len(cost)
    distance = [np.full(count, np.nan), np.full(count, np.nan)]
    found: tuple[list, list] = ([], [])
    for at, stack in stacks(cost):
        b, n, m = stack.shape
        best = best_cells(stack)
        finite = best[:, 0] >= 0
        at, stack, best = at[finite], stack[finite], best[finite]
        for k, cells in enumerate((best, greedy_cells(stack)[0])):
            value = np.take_along_axis(stack.reshape(len(stack), n * m), cells, 1)
            distance[k][at] = 1.0 - 2.0 * (1.0 - value).sum(1) / (n + m)
            found[k].append((at, cells, m))
    sides = [pa.array(d, mask=np.isnan(d)) for d in distance] + [_lists(count, f) for f in found]
    return pa.StructArray.from_arrays(sides, [f.name for f in MATCHED.fields])


def under(cost: Column, pairs: Column) -> Column:
    """The distance under any assignment given as array<struct<i, j>>, JVM-side."""
    quality = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (1.0 - F.get(F.get(cost, p["i"]), p["j"])))
    return 1.0 - 2.0 * quality / (F.size(cost) + F.size(F.get(cost, 0)))


def confident(cost: Column, pairs: Column, threshold: float = CONFIDENT) -> Column:
    return F.filter(pairs, lambda p: F.get(F.get(cost, p["i"]), p["j"]) < threshold)


Edge = Callable[[Column, Column], Column]


def matrix(a: Column, b: Column, edge: Edge) -> Column:
    """Costs of every label of ``a`` with every label of ``b`` by a built-in expression."""
    return F.transform(a, lambda x: F.transform(b, lambda y: edge(x, y)))


@lru_cache(maxsize=200_000)
def _common(x: str, y: str) -> int:
    return lcs(x, y)


def _text_matrix(kind: str):
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def cost(x: str, y: str) -> float:
            n = _common(x, y) if x <= y else _common(y, x)
            if kind == "indel":
                return (len(x) + len(y) - 2 * n) / max(len(x) + len(y), 1)
            return 1.0 - n / max(len(x), len(y), 1) if x or y else 0.0

        return pd.Series([[[cost(x, y) for y in q] for x in p] for p, q in zip(a, b)])

    return run


#: Cost matrices of the matching measures over strings.
MATRICES: dict[str, Edge] = {
    "bipartite_jaccard": lambda a, b: matrix(a, b, distances.text_words),
    "bipartite_levenshtein": lambda a, b: matrix(a, b, distances.text_levenshtein),
    "bipartite_indel": lambda a, b: _text_matrix("indel")(a, b),
    "bipartite_lcsseq": lambda a, b: _text_matrix("lcs")(a, b),
}
