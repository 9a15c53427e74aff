"""Agreement coefficients of two or many raters, for all groups and matching strategies in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.text import label_set
from accordant.operators.chance import chance_pairs, pooled
from accordant.operators.distribution import ks_by_group, sigma_by_group
from accordant.operators import measures
from accordant.operators.measures import Measure, score_pairs
from accordant.storage import written


def chance_agreement(left: DataFrame, right: DataFrame, group: list[str], measure: Measure) -> DataFrame:
    """group, ae: exact agreement by chance of a measure with keys, whatever the number of distinct sets."""
    a = left.groupBy(*group, F.col("labels").alias("a")).agg(F.count(F.lit(1)).alias("n_a"))
    b = right.groupBy(*group, F.col("labels").alias("b")).agg(F.count(F.lit(1)).alias("n_b"))
    sizes = a.groupBy(*group).agg(F.sum("n_a").alias("na")).join(b.groupBy(*group).agg(F.sum("n_b").alias("nb")), group)
    found = sizes.join(measures.total_agreement(a, b, group, measure), group, "left")
    return found.select(*group, (F.coalesce("agreement", F.lit(0.0)) / (F.col("na") * F.col("nb"))).alias("ae"))


def corrected(observed: Column, expected: Column) -> Column:
    """Agreement beyond chance; where chance agrees always, one if the raters do and else minus infinity."""
    return F.when(expected >= 1.0, F.when(observed >= 1.0, 1.0).otherwise(float("-inf"))).otherwise(
        (observed - expected) / F.when(expected < 1.0, 1.0 - expected)
    )


def distances_of(pairs: DataFrame, measure: Measure, costs: DataFrame | None = None) -> DataFrame:
    """a, b, matching, distance of the distinct pairs, each computed once."""
    return _scored([pairs], measure, costs)


def _scored(uses: list[DataFrame], measure: Measure, costs: DataFrame | None) -> DataFrame:
    """Distances of the distinct pairs of all uses, each computed once."""
    distinct = reduce(DataFrame.unionByName, [u.select("a", "b") for u in uses]).distinct()
    return written(score_pairs(distinct, measure, costs), "distances")


def two_raters(
    rows: DataFrame,
    group: list[str],
    measure: Measure,
    a: str = "rater_a",
    b: str = "rater_b",
    key: str = "item_id",
    chance_measure: Measure | None = None,
    costs: DataFrame | None = None,
    distribution: bool = True,
    **chance: int,
) -> DataFrame:
    """group, matching, average_agreement, cohens_kappa, scotts_pi and, with ``distribution``, sigma and ks.

    A null label array is the empty set.  Every row is an item, repeated rows too.  ``chance`` takes the options of
    ``chance_pairs``; a chance measure without matching lends its distances to every strategy.  Without distribution,
    chance measure and options, measures with keys get the exact chance agreement at any size.
    """
    kept = [*group, "a", "b", "pos"]
    base = rows.select(*group, label_set(F.col(a)).alias("a"), label_set(F.col(b)).alias("b"), F.xxhash64(F.col(key), a, b).alias("pos")).select(*kept)
    left, right = base.select(*group, F.col("a").alias("labels"), "pos"), base.select(*group, F.col("b").alias("labels"), "pos")
    both = pooled([left, right], group)
    if measure.keys is not None and chance_measure is None and not distribution and not chance:
        seen = base.groupBy(*group, "a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("distance", measure.pair(F.col("a"), F.col("b")))
        ao = seen.groupBy(*group).agg((F.sum(F.col("n") * (1 - F.col("distance"))) / F.sum("n")).alias("average_agreement"), F.sum("n").alias("n_items"))
        ae = chance_agreement(left, right, group, measure).withColumnRenamed("ae", "ae_kappa")
        pe = chance_agreement(both, both, group, measure).withColumnRenamed("ae", "ae_pi")
        return ao.join(ae, group).join(pe, group).select(
            *group, F.lit("none").alias("matching"), "n_items", "average_agreement",
            corrected(F.col("average_agreement"), F.col("ae_kappa")).alias("cohens_kappa"),
            corrected(F.col("average_agreement"), F.col("ae_pi")).alias("scotts_pi"),
        )
    separate = written(chance_pairs(left, right, group, **chance), "chance")
    together = written(chance_pairs(both, both.withColumn("pos", F.xxhash64(F.lit("other"), "pos")), group, **chance), "pooled")
    other = chance_measure or measure
    if chance_measure is None:
        observed_d = chance_d = _scored([base, separate, together], measure, costs)
    else:
        observed_d, chance_d = _scored([base], measure, costs), _scored([separate, together], other, costs)
        if other.strategies == ("none",) and measure.strategies != ("none",):
            chance_d = chance_d.drop("matching").withColumn("matching", F.explode(F.array(*[F.lit(s) for s in measure.strategies])))
    seen = base.groupBy(*group, "a", "b").agg(F.count(F.lit(1)).alias("n")).join(observed_d, ["a", "b"])
    keys = [*group, "matching"]
    ao = seen.groupBy(*keys).agg((F.sum(F.col("n") * (1 - F.col("distance"))) / F.sum("n")).alias("average_agreement"), F.sum("n").alias("n_items"))
    expected = separate.join(chance_d, ["a", "b"])
    ae = expected.groupBy(*keys).agg(F.sum(F.col("weight") * (1 - F.col("distance"))).alias("ae_kappa"))
    pe = together.join(chance_d, ["a", "b"]).groupBy(*keys).agg(F.sum(F.col("weight") * (1 - F.col("distance"))).alias("ae_pi"))
    out = ao.join(ae, keys).join(pe, keys).select(
        *keys, "n_items", "average_agreement",
        corrected(F.col("average_agreement"), F.col("ae_kappa")).alias("cohens_kappa"),
        corrected(F.col("average_agreement"), F.col("ae_pi")).alias("scotts_pi"),
    )
    if distribution:
        samples = seen.select(*keys, F.lit("observed").alias("kind"), F.col("distance").alias("value"), F.col("n").cast("double").alias("weight")).unionByName(
            expected.select(*keys, F.lit("expected").alias("kind"), F.col("distance").alias("value"), "weight")
        )
        samples = written(samples, "samples")
        out = out.join(sigma_by_group(samples, keys), keys).join(ks_by_group(samples, keys), keys)
    return out


def rater_pairs(long: DataFrame, group: list[str]) -> DataFrame:
    """group, item, s, t, a, b of each two slots s < t of an item.  ``long`` has item, slot and labels."""
    sets = long.select(*group, "item", "slot", label_set(F.col("labels")).alias("labels"))
    x, y = sets.alias("x"), sets.alias("y")
    on = reduce(lambda p, q: p & q, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in [*group, "item"]])
    both = x.join(y, on & (F.col("x.slot") < F.col("y.slot")))
    return both.select(*[F.col(f"x.{c}").alias(c) for c in [*group, "item"]], F.col("x.slot").alias("s"), F.col("y.slot").alias("t"), F.col("x.labels").alias("a"), F.col("y.labels").alias("b"))


def many_raters(long: DataFrame, group: list[str], measure: Measure, costs: DataFrame | None = None, distribution: bool = True, **chance: int) -> DataFrame:
    """group, matching, average_agreement (mean of items' means), cohens_kappa (mean over slot pairs), fleiss_kappa.

    ``long`` has item, slot and labels; items may have any number of slots.  With ``distribution``, sigma and ks use
    the pooled chance sample.  Exact chance agreement at any size as for two raters.
    """
    pairs = written(rater_pairs(long, group), "pairs")
    pos = lambda c: F.xxhash64("item", c).alias("pos")
    labels = long.select(*group, label_set(F.col("labels")).alias("labels"), F.xxhash64("item", "slot").alias("pos"))
    close = lambda e: F.abs(e - 1.0) <= 1e-9
    sure = lambda o, e: F.when(close(e), F.when(close(o), 1.0)).otherwise((o - e) / F.when(~close(e), 1.0 - e))
    if measure.keys is not None and not distribution and not chance:
        slots = [*group, "s", "t"]
        seen = pairs.groupBy(*slots, "item", "a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("ao", 1 - measure.pair(F.col("a"), F.col("b")))
        ao = seen.groupBy(*group, "item").agg(F.avg("ao").alias("ao")).groupBy(*group).agg(F.avg("ao").alias("average_agreement"), F.count(F.lit(1)).alias("n_items"))
        slot_ae = chance_agreement(pairs.select(*slots, F.col("a").alias("labels")), pairs.select(*slots, F.col("b").alias("labels")), slots, measure)
        kappa = seen.groupBy(*slots).agg(F.avg("ao").alias("o")).join(slot_ae, slots).groupBy(*group).agg(F.avg(sure(F.col("o"), F.col("ae"))).alias("cohens_kappa"))
        pe = chance_agreement(labels, labels, group, measure)
        return ao.join(kappa, group).join(pe, group).select(
            *group, F.lit("none").alias("matching"), "n_items", "average_agreement", "cohens_kappa", sure(F.col("average_agreement"), F.col("ae")).alias("fleiss_kappa")
        )
    together = written(chance_pairs(labels, labels.withColumn("pos", F.xxhash64(F.lit("other"), "pos")), group, **chance), "pooled")
    slots = [*group, "s", "t"]
    separate = written(
        chance_pairs(pairs.select(*slots, F.col("a").alias("labels"), pos("s")), pairs.select(*slots, F.col("b").alias("labels"), pos("t")), slots, **chance), "chance"
    )
    d = _scored([pairs, together, separate], measure, costs)
    keys = [*group, "matching"]
    seen = pairs.join(d, ["a", "b"])
    item = seen.groupBy(*keys, "item").agg(F.avg(1 - F.col("distance")).alias("ao"))
    ao = item.groupBy(*keys).agg(F.avg("ao").alias("average_agreement"), F.count(F.lit(1)).alias("n_items"))
    pe = together.join(d, ["a", "b"])
    pooled_ae = pe.groupBy(*keys).agg(F.sum(F.col("weight") * (1 - F.col("distance"))).alias("ae"))
    slot_ao = seen.groupBy(*slots, "matching").agg(F.avg(1 - F.col("distance")).alias("o"))
    slot_ae = separate.join(d, ["a", "b"]).groupBy(*slots, "matching").agg(F.sum(F.col("weight") * (1 - F.col("distance"))).alias("e"))
    kappa = slot_ao.join(slot_ae, [*slots, "matching"]).groupBy(*keys).agg(F.avg(sure(F.col("o"), F.col("e"))).alias("cohens_kappa"))
    out = ao.join(pooled_ae, keys).join(kappa, keys).select(
        *keys, "n_items", "average_agreement", "cohens_kappa", sure(F.col("average_agreement"), F.col("ae")).alias("fleiss_kappa")
    )
    if distribution:
        samples = seen.select(*keys, F.lit("observed").alias("kind"), F.col("distance").alias("value"), F.lit(1.0).alias("weight")).unionByName(
            pe.select(*keys, F.lit("expected").alias("kind"), F.col("distance").alias("value"), "weight")
        )
        samples = written(samples, "samples")
        out = out.join(sigma_by_group(samples, keys), keys).join(ks_by_group(samples, keys), keys)
    return out


def default_strategy(scores: DataFrame, measure: Measure) -> DataFrame:
    return scores.filter(F.col("matching") == measure.strategies[0])
