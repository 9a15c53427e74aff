"""Observed against expected distances: alpha, sigma and the one-sided Kolmogorov-Smirnov statistic.

Samples are frequency tables (value, freq), never expanded.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.operators.measures import total_agreement
from accordant.storage import written

THRESHOLD = 0.05
CAP = 100_000
#: A sample whose variance is below this has no kernel density.
SINGULAR = 1e-30
#: The error function is cubic between knots, with its own slopes there: off by less than 1e-13.
_STEP, _KNOTS = 1 / 1024, 6 * 1024
_AT = np.array([math.erf(i * _STEP) for i in range(_KNOTS + 1)])
_SLOPE = np.exp(-((np.arange(_KNOTS + 1) * _STEP) ** 2)) * (2 / math.sqrt(math.pi)) * _STEP
#: Differences that one step of the kernel density holds.
AT_ONCE = 4_000_000


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of every element."""
    size = np.minimum(np.abs(x), _KNOTS * _STEP) / _STEP
    i = np.minimum(size.astype(np.int64), _KNOTS - 1)
    t = size - i
    a, b, p, q = _AT[i], _AT[i + 1], _SLOPE[i], _SLOPE[i + 1]
    return np.copysign(a + t * (p + t * (3 * (b - a) - 2 * p - q + t * (2 * (a - b) + p + q))), x)


def frequencies(weights: np.ndarray, cap: int = CAP) -> np.ndarray:
    """Whole frequencies in proportion to positive weights, about ``cap`` in all at most."""
    if not len(weights):
        return weights.astype(int)
    n = np.rint(weights / weights.min()).astype(np.int64)
    total = n.sum()
    return np.maximum(1, np.rint(n * (cap / total)).astype(np.int64)) if total > cap else n


def sigma(observed: np.ndarray, n_observed: np.ndarray, expected: np.ndarray, n_expected: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Share of observed distances that a Gaussian kernel density of the expected ones puts below ``threshold``."""
    total = n_expected.sum()
    mean = (expected * n_expected).sum() / total
    variance = (n_expected * (expected - mean) ** 2).sum() / (total - 1) if total > 1 else 0.0
    if variance > SINGULAR:
        h = math.sqrt(variance) * total ** (-1 / 5)
        share, wide = n_expected / total, h * math.sqrt(2)
        zero = (erf(-expected / wide) * share).sum()
        rows = max(1, AT_ONCE // max(1, len(expected)))
        below = [0.5 * (erf((observed[k : k + rows, None] - expected) / wide) @ share - zero) for k in range(0, len(observed), rows)]
        bad = np.concatenate(below) < threshold if below else np.zeros(0, bool)
    else:
        bad = observed < quantile(expected, n_expected, threshold)
    return float((n_observed * bad).sum() / n_observed.sum())


def quantile(values: np.ndarray, freq: np.ndarray, q: float) -> float:
    """The linearly interpolated quantile of a frequency table."""
    order = np.argsort(values)
    values, upto = values[order], np.cumsum(freq[order])
    place = q * (upto[-1] - 1)
    low, part = int(math.floor(place)), place - math.floor(place)
    at = lambda i: values[np.searchsorted(upto, min(i, upto[-1] - 1), side="right")]
    return float(at(low) + part * (at(low + 1) - at(low)))


def sigma_by_group(samples: DataFrame, group: list[str]) -> DataFrame:
    """group, sigma.  ``samples`` has kind (observed or expected), value and weight; equal values are added first."""
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema.fields}
    table = samples.filter("weight > 0").groupBy(*group, "kind", "value").agg(F.sum("weight").alias("weight"), F.min("weight").alias("least"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        o, e = pdf[pdf["kind"] == "observed"], pdf[pdf["kind"] == "expected"]
        got = float("nan")
        if len(o) and len(e):
            n = np.rint(e["weight"].to_numpy() / e["least"].min()).astype(np.int64)
            if n.sum() > CAP:
                n = np.maximum(1, np.rint(n * (CAP / n.sum())).astype(np.int64))
            got = sigma(o["value"].to_numpy(), o["weight"].to_numpy(), e["value"].to_numpy(), n)
        return pd.DataFrame([[*pdf[group].iloc[0], got]], columns=[*group, "sigma"])

    return table.groupBy(*group).applyInPandas(one, ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "sigma double"]))


def ks_by_group(samples: DataFrame, group: list[str]) -> DataFrame:
    """group, ks: the largest excess of the observed over the expected distribution function.

    Running sums go over distinct values within a group.
    """
    side = lambda k: F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0.0))
    by_value = samples.groupBy(*group, "value").agg(side("observed").alias("o"), side("expected").alias("e"))
    upto = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    run = by_value.withColumn("fo", F.sum("o").over(upto) / F.sum("o").over(whole)).withColumn("fe", F.sum("e").over(upto) / F.sum("e").over(whole))
    return run.groupBy(*group).agg(F.max(F.col("fo") - F.col("fe")).alias("ks"))


def ks_pointwise(samples: DataFrame, group: list[str]) -> DataFrame:
    """group, ks: the mean over observed distances of one minus the p-value of that one distance against the expected.

    Against n expected distances of which k are no larger, the one-sided exact p-value of a single one is
    (k + 1) / (n + 1).
    """
    side = lambda k: F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0.0))
    by_value = samples.groupBy(*group, "value").agg(side("observed").alias("o"), side("expected").alias("e"))
    upto = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by_value.withColumn("k", F.sum("e").over(upto)).withColumn("n", F.sum("e").over(Window.partitionBy(*group)))
    return run.groupBy(*group).agg((F.sum(F.col("o") * (1 - (F.col("k") + 1) / (F.col("n") + 1))) / F.sum("o")).alias("ks"))


def different_item_pairs(annotations: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """About ``n`` pairs a, b of labels of different items, drawn by seeded hash ranks: two top-n lists, paired by rank.

    ``annotations`` has item, labels and pos.  Pairs of the same item that the draw brings together are left out.
    """
    ranked = []
    for name in "ab":
        order = Window.orderBy(F.xxhash64(F.lit(seed), F.lit(name), "pos"), "pos")
        top = annotations.orderBy(F.xxhash64(F.lit(seed), F.lit(name), "pos"), "pos").limit(n)  # a distributed top-n
        ranked.append(top.select("item", F.col("labels").alias(name), F.row_number().over(order).alias("rank")))
    x, y = ranked[0].alias("x"), ranked[1].alias("y")
    return x.join(y, "rank").filter(F.col("x.item") != F.col("y.item")).select("a", "b")


def distance_matrix(annotations: DataFrame, distance, pairs: DataFrame | None = None) -> DataFrame:
    """i, j, d with i > j of annotations (pos, labels): all pairs, or those of ``pairs`` (i, j) in either order.

    All pairs are as many as their definition says; ask for pairs where annotations are many.
    """
    x, y = annotations.select(F.col("pos").alias("i"), F.col("labels").alias("a")), annotations.select(F.col("pos").alias("j"), F.col("labels").alias("b"))
    if pairs is None:
        both = x.join(y, F.col("i") > F.col("j"))
    else:
        both = pairs.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j")).distinct().join(x, "i").join(y, "j")
    return both.select("i", "j", distance(F.col("a"), F.col("b")).alias("d"))


def alpha_by_chunk(pairs: DataFrame, chunks: DataFrame, expected: float, distance) -> DataFrame:
    """chunk, observed, alpha of same-item pairs (item, a, b) by their item's chunk, against one expected distance."""
    met = pairs.join(chunks.select("item", "chunk"), "item").groupBy("chunk").agg(F.avg(distance(F.col("a"), F.col("b"))).alias("observed"))
    return met.withColumn("alpha", alpha(F.col("observed"), F.lit(expected)))


def alpha(observed_mean: Column, expected_mean: Column) -> Column:
    return 1.0 - observed_mean / expected_mean


def same_item_pairs(annotations: DataFrame, group: list[str]) -> DataFrame:
    """Both labels, items and workers of every pair of annotations of an item, each pair once.

    ``annotations`` has the group, item, worker, labels and pos (unique).
    """
    x, y = annotations.alias("x"), annotations.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in [*group, "item"]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    both = x.join(y, on & (F.col("x.pos") > F.col("y.pos")))
    return both.select(
        *[F.col(f"x.{g}").alias(g) for g in group], F.col("x.item").alias("item"), F.col("x.worker").alias("worker_a"), F.col("y.worker").alias("worker_b"),
        F.col("x.labels").alias("a"), F.col("y.labels").alias("b"),
    )


def krippendorff(annotations: DataFrame, group: list[str], measure) -> DataFrame:
    """group, observed, expected, alpha with all pairs of different items, from counts of label sets.

    The sum over pairs of different items is the sum over all pairs less that over pairs of the same item; the former
    takes one row per two distinct label sets, whatever the number of annotations, or with a measure that has keys
    only the sets that share one.
    """
    d = measure.pair(F.col("a"), F.col("b"))
    same = same_item_pairs(annotations, group).groupBy(*group).agg(F.sum(d).alias("s"), F.count(F.lit(1)).alias("n"))
    n = annotations.groupBy(*group, "labels").agg(F.count(F.lit(1)).alias("c"))
    x, y = n.select(*group, F.col("labels").alias("a"), F.col("c").alias("ca")), n.select(*group, F.col("labels").alias("b"), F.col("c").alias("cb"))
    rows = n.groupBy(*group).agg(F.sum("c").alias("m"))
    if measure.keys is not None:
        agreed = total_agreement(x.withColumnRenamed("ca", "n_a"), y.withColumnRenamed("cb", "n_b"), group, measure)
        total = rows.join(agreed, group).select(*group, ((F.col("m") * F.col("m") - F.col("agreement")) / 2).alias("all"))
    else:
        total = x.join(y, group).groupBy(*group).agg((F.sum(d * F.col("ca") * F.col("cb")) / 2).alias("all"))
    both = total.join(same, group).join(rows, group)
    observed = F.col("s") / F.col("n")
    others = (F.col("m") * (F.col("m") - 1)) / 2 - F.col("n")
    expected = (F.col("all") - F.col("s")) / others
    return both.select(*group, observed.alias("observed"), expected.alias("expected"), alpha(observed, expected).alias("alpha"))


def chunks_by_error(errors: DataFrame, per_chunk: int = 4) -> DataFrame:
    """item, error, chunk: items in the order of their mean error in near-equal chunks, the larger ones first.

    ``errors`` has item and error; a chunk has at least three items.
    """
    if per_chunk < 3:
        raise ValueError("a chunk needs three items at least")
    ranked, n = ranked_globally(errors.groupBy("item").agg(F.avg("error").alias("error")), ["error", "item"])
    chunks = max(1, n // per_chunk)
    small, larger = divmod(n, chunks)
    edge = larger * (small + 1)
    place = F.col("rank")
    chunk = F.when(place < edge, F.floor(place / (small + 1))).otherwise(larger + F.floor((place - edge) / max(small, 1)))
    return ranked.select("item", "error", (chunk + 1).cast("int").alias("chunk"))


def ranked_globally(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``rank`` (from 0) in the order of the columns, and the number of rows.

    Rows are sorted in ranges; the ranges' sizes, one number each, give their first ranks.
    """
    ranges = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    ranges = ranges.withColumn("_range", F.shiftrightunsigned("_id", 33))
    sizes = sorted((r["_range"], r["n"]) for r in ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    firsts, total = [], 0
    for number, n in sizes:
        firsts.append((number, total))
        total += n
    base = df.sparkSession.createDataFrame(firsts, "_range long, _base long")  # a row per range
    low = F.col("_id") - F.shiftleft("_range", 33)
    return ranges.join(F.broadcast(base), "_range").withColumn("rank", F.col("_base") + low).drop("_id", "_range", "_base"), total
