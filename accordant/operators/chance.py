"""Pairs of label sets that chance would bring together, with weights, for any number of groups at once.

Per group, the distinct label sets of either side are counted.  If the product of their numbers is within the budget,
all pairs come out with the product of their frequencies (a join of the counts on the group).  Else pairs of rows are
drawn: rows of either side are ranked by a seeded hash and equal ranks are paired, so a sample of 300 pairs costs a
top-300 of each side, never a sort of a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordant.storage import written

MAX_EXACT = 1000
#: A budget that every group is within.
UNBOUNDED = 2**62
MIN_SHUFFLES = 3
TARGET = 300


def _counts(side: DataFrame, group: list[str], name: str) -> DataFrame:
    return side.groupBy(*group, F.col("labels").alias(name)).agg(F.count(F.lit(1)).alias(f"n_{name}"))


def chance_pairs(
    left: DataFrame,
    right: DataFrame,
    group: list[str],
    max_exact: int = MAX_EXACT,
    shuffles: int | None = None,
    target: int = TARGET,
    min_shuffles: int = MIN_SHUFFLES,
    seed: int = 0,
) -> DataFrame:
    """group, a, b, weight.  ``left`` and ``right`` have the group columns, ``labels`` (a label set) and ``pos``.

    ``pos`` tells rows apart and makes the draw repeatable.  With ``shuffles`` every row of either side is used that
    often and nothing is cut to ``target``.  Weights of a group sum to one.
    """
    a, b = _counts(left, group, "a"), _counts(right, group, "b")
    sizes = (
        a.groupBy(*group).agg(F.count(F.lit(1)).alias("da"), F.sum("n_a").alias("na"))
        .join(b.groupBy(*group).agg(F.count(F.lit(1)).alias("db"), F.sum("n_b").alias("nb")), group)
    )
    sizes = written(sizes, "sizes")  # a row per group
    fits = F.col("da") * F.col("db") <= max_exact
    kinds = sizes.agg(F.max(fits).alias("some"), F.min(fits).alias("all")).first()
    exact = sizes.filter(fits)
    every = (
        exact.join(a, group).join(b, group)
        .select(*group, "a", "b", ((F.col("n_a") / F.col("na")) * (F.col("n_b") / F.col("nb"))).alias("weight"))
    )
    if kinds["all"] is None or kinds["all"]:
        return every
    drawn = sizes.filter(~fits).withColumn("n", F.least("na", "nb"))
    if shuffles is not None:
        drawn = drawn.withColumn("rounds", F.lit(shuffles)).withColumn("most", F.col("n"))
    else:
        # a group of the target's size or more gives it in one round; smaller ones are shuffled several times
        few = F.greatest(F.lit(min_shuffles), F.ceil(F.lit(target) / F.col("n")).cast("int"))
        drawn = drawn.withColumn("rounds", F.when(F.col("n") >= target, F.lit(1)).otherwise(few)).withColumn("most", F.least("n", F.lit(target)))
    drawn = drawn.select(*group, "rounds", "most")

    def ranked(side: DataFrame, name: str) -> DataFrame:
        rows = side.join(drawn, group).withColumn("round", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
        order = Window.partitionBy(*group, "round").orderBy(F.xxhash64(F.lit(seed), F.lit(name), "round", "pos"), "pos")
        rows = rows.withColumn("rank", F.row_number().over(order))
        if shuffles is None:
            rows = rows.filter(F.col("rank") <= target)
        return rows.filter(F.col("rank") <= F.col("most")).select(*group, "round", "rank", F.col("labels").alias(name))

    pairs = ranked(left, "a").join(ranked(right, "b"), [*group, "round", "rank"])
    if shuffles is None:
        order = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed + 1), "round", "rank"), "round", "rank")
        pairs = pairs.withColumn("keep", F.row_number().over(order)).filter(F.col("keep") <= target)
    per = pairs.groupBy(*group, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    totals = per.groupBy(*group).agg(F.sum("n").alias("all"))
    sampled = per.join(totals, group).select(*group, "a", "b", (F.col("n") / F.col("all")).alias("weight"))
    return every.unionByName(sampled) if kinds["some"] else sampled


def pooled(sides: list[DataFrame], group: list[str]) -> DataFrame:
    """The sides as one, for coefficients that pool all raters."""
    return reduce(DataFrame.unionByName, [s.select(*group, "labels", F.xxhash64(F.lit(i), "pos").alias("pos")) for i, s in enumerate(sides)])
