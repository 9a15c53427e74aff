"""The registry of measures, and scoring each distinct pair of label sets once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions import distances
from accordant.functions.text import word_set
from accordant.operators import matching


@dataclass(frozen=True)
class Measure:
    """``pair`` gives a distance, or ``matrix`` a cost matrix to be matched; tags say what a measure needs.

    ``keys`` gives an array of keys of a set, so that sets without a common key are at distance 1: sums of agreement
    over all pairs then only need the pairs that share one.
    A measure over a model has neither: its costs come from a table (x, y, cost), see ``matching_costs``.
    """

    name: str
    pair: Callable[[Column, Column], Column] | None = None
    matrix: Callable[[Column, Column], Column] | None = None
    keys: Callable[[Column], Column] | None = None
    single: bool = False
    threshold: float = matching.CONFIDENT
    tags: frozenset[str] = field(default_factory=frozenset)

    @property
    def strategies(self) -> tuple[str, ...]:
        return ("none",) if self.single or self.pair is not None else ("hungarian", "greedy")

    @property
    def base(self) -> str:
        return self.name.removesuffix("_single")


def _build() -> dict[str, Measure]:
    simple = frozenset({"simple"})
    whole = lambda a: F.array(F.xxhash64(a))
    own = lambda a: F.when(F.size(a) == 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform(a, lambda x: F.xxhash64(x)))
    by_word = lambda a: own(word_set(a))
    out = [
        Measure("exact_match", distances.exact_match, keys=whole, tags=simple),
        Measure("jaccard", distances.word_jaccard, keys=by_word, tags=simple),
        Measure("set_jaccard", distances.set_jaccard, keys=own, tags=simple),
        Measure("masi", distances.masi, keys=by_word, tags=simple),
        Measure("levenshtein", distances.levenshtein, tags=simple),
        Measure("indel", distances.indel, tags=simple),
        Measure("lcsseq", distances.lcs_distance, tags=simple),
    ]
    for name, costs in matching.MATRICES.items():
        out.append(Measure(name, matrix=costs, tags=simple))
    for name in ("bipartite_embedding", "bipartite_qwen3_embedding"):
        out.append(Measure(name, threshold=matching.CONFIDENT_EMBEDDING, tags=frozenset({"model"})))
    for name in ("nli", "mdeberta_nli"):
        out.append(Measure(name, tags=frozenset({"model", "cacheable"})))
    for name in ("log_prob", "verbalized_prob", "local_log_prob", "local_verbalized_prob"):
        out.append(Measure(name, tags=frozenset({"language_model", "cacheable"})))
    for m in [m for m in out if m.tags & {"model", "language_model"}]:
        out.append(Measure(f"{m.name}_single", single=True, threshold=m.threshold, tags=m.tags))
    return {m.name: m for m in out}


MEASURES = _build()


def register(measure: Measure) -> None:
    MEASURES[measure.name] = measure


def for_mode(mode: str) -> list[Measure]:
    """Measures for single labels (no matching) or for sets (no ``_single``)."""
    if mode == "single":
        return [m for m in MEASURES.values() if m.strategies == ("none",)]
    return [m for m in MEASURES.values() if not m.single]


def score_pairs(pairs: DataFrame, measure: Measure, costs: DataFrame | None = None) -> DataFrame:
    """``pairs`` (a, b: distinct label sets) with ``matching`` and ``distance``, one row per strategy.

    Pairs that need no measure never reach Python.  ``costs`` has x <= y and cost for measures without an expression;
    a pair of labels that it lacks costs 1.
    """
    if measure.pair is not None:
        return pairs.select("a", "b", F.lit("none").alias("matching"), measure.pair(F.col("a"), F.col("b")).alias("distance"))
    known = pairs.withColumn("d", distances.trivial(F.col("a"), F.col("b")))
    easy = known.filter("d is not null").select("a", "b", F.col("d").alias("h"), F.col("d").alias("g"))
    hard = known.filter("d is null").select("a", "b")
    if measure.matrix is not None:
        hard = hard.withColumn("cost", measure.matrix(F.col("a"), F.col("b")))
    else:
        if costs is None:
            raise ValueError(f"{measure.name} needs a table of costs")
        hard = matching_costs(hard, costs)
    hard = hard.withColumn("m", matching.match("cost")).select("a", "b", F.col("m.d_hungarian").alias("h"), F.col("m.d_greedy").alias("g"))
    both = easy.unionByName(hard)
    ways = [("none", "h")] if measure.single else [("hungarian", "h"), ("greedy", "g")]
    return both.select("a", "b", F.explode(F.array(*[F.struct(F.lit(n).alias("matching"), F.col(c).alias("distance")) for n, c in ways])).alias("x")).select("a", "b", "x.*")


def total_agreement(left: DataFrame, right: DataFrame, group: list[str], measure: Measure) -> DataFrame:
    """group, agreement: the sum of n_a n_b (1 - distance) over all pairs of sets, from the pairs with a common key.

    ``left`` has the group, a and n_a, ``right`` the group, b and n_b, one row a set.
    """
    x = left.select(*group, "a", "n_a", F.explode(F.array_distinct(measure.keys(F.col("a")))).alias("key"))
    y = right.select(*group, "b", "n_b", F.explode(F.array_distinct(measure.keys(F.col("b")))).alias("key"))
    met = x.join(y, [*group, "key"]).select(*group, "a", "b", "n_a", "n_b").distinct()
    return met.groupBy(*group).agg(F.sum(F.col("n_a") * F.col("n_b") * (1 - measure.pair(F.col("a"), F.col("b")))).alias("agreement"))


def matching_costs(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with a cost matrix from an unordered table of label costs: every edge is looked up once."""
    edges = pairs.select("a", "b", F.posexplode("a").alias("i", "p")).select("a", "b", "i", "p", F.posexplode("b").alias("j", "q"))
    keyed = edges.withColumn("x", F.least("p", "q")).withColumn("y", F.greatest("p", "q"))
    table = costs.select("x", "y", F.col("cost").alias("c"))
    found = keyed.join(table, ["x", "y"], "left").withColumn("c", F.when(F.col("p") == F.col("q"), F.lit(0.0)).otherwise(F.coalesce("c", F.lit(1.0))))
    rows = found.groupBy("a", "b", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "c"))), lambda s: s["c"]).alias("row"))
    return rows.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda s: s["row"]).alias("cost"))
