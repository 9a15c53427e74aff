"""Whole experiments: measures on synthetic populations of known agreement, and on real items with several annotators."""

from __future__ import annotations

import time
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.functions.text import label_set
from accordant.operators import agreement, chance, matching, measures, summaries, synthetic
from accordant.operators.measures import Measure
from accordant.storage import written

COEFFICIENTS = ["average_agreement", "cohens_kappa", "scotts_pi", "sigma", "ks"]
MANY_COEFFICIENTS = ["average_agreement", "cohens_kappa", "fleiss_kappa", "sigma", "ks"]


def _against_truth(scores: DataFrame, truth: DataFrame, on: list[str], coefficients: list[str]) -> DataFrame:
    """Scores with the true ones, and absolute and percent errors of each coefficient."""
    known = truth.select(*on, *[F.col(c).alias(f"true_{c}") for c in coefficients])
    both = scores.join(known, on)
    for c in coefficients:
        both = both.withColumn(f"mae_{c}", summaries.absolute_error(F.col(c), F.col(f"true_{c}"))).withColumn(f"mape_{c}", summaries.percent_error(F.col(c), F.col(f"true_{c}")))
    return both


def synthetic_results(made: DataFrame, chosen: Iterable[Measure], costs: DataFrame | None = None, chance_measure: Measure | None = None, group: list[str] | None = None, **options: int) -> DataFrame:
    """seed, measure, matching, the five coefficients, the true ones and the errors.

    ``made`` is what ``synthetic.populations`` gives; the truth scores the concepts themselves by set overlap.
    All populations are scored in one plan per measure.  ``group`` has the columns of a population, ``seed`` if not given.
    """
    group = group or ["seed"]
    made = written(made, "populations")
    truth = agreement.two_raters(made, group, measures.MEASURES["set_jaccard"], a="rater_a_concepts", b="rater_b_concepts", key="sample_index", **options)
    truth = written(truth, "truth")
    out = []
    for m in chosen:
        scores = agreement.two_raters(made, group, m, key="sample_index", chance_measure=chance_measure, costs=costs, **options)
        # a row per population and matching; written, so that no plan spans several measures
        out.append(written(_against_truth(scores, truth, group, COEFFICIENTS).withColumn("measure", F.lit(m.name)), "scores"))
    return reduce(DataFrame.unionByName, out)


def errors(results: DataFrame, coefficients: list[str]) -> DataFrame:
    """metric, measure (with its strategy if that is not the default one), seed, mae, mape: one row per error."""
    name = summaries.strategy_name(F.col("measure"), F.col("matching")).alias("measure")
    long = results.select(
        name, "seed", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"mae_{c}").alias("mae"), F.col(f"mape_{c}").alias("mape")) for c in coefficients])).alias("x")
    )
    return long.select("measure", "seed", "x.*")


def predictions(made: DataFrame, measure: Measure, group: list[str] | None = None) -> DataFrame:
    """The columns of a population (``group``, seed if not given), agreement_level, sample_index, sets, distance and, for a matching measure, cost, both assignments, the
    distances under the greedy and the true assignment, and whether the sets are the same concepts."""
    a, b = F.col("rater_a"), F.col("rater_b")
    base = made.select(
        *(group or ["seed"]), "agreement_level", "sample_index", "rater_a", "rater_b", F.size("rater_a").alias("rater_a_set_size"), F.size("rater_b").alias("rater_b_set_size"),
        (label_set(F.col("rater_a_concepts")) == label_set(F.col("rater_b_concepts"))).alias("true_match"),
        synthetic.true_assignment(F.col("rater_a_concepts"), F.col("rater_b_concepts")).alias("true_assignment"),
    )
    if measure.pair is not None:
        return base.withColumn("distance", measure.pair(label_set(a), label_set(b)))
    scored = base.withColumn("cost", measure.matrix(a, b)).withColumn("m", matching.match("cost"))
    return scored.select(
        *base.columns, "cost", F.col("m.d_hungarian").alias("distance"), F.col("m.d_greedy").alias("distance_greedy"),
        matching.under(F.col("cost"), F.col("true_assignment")).alias("distance_true"), F.col("m.hungarian").alias("assignment"), F.col("m.greedy").alias("greedy_assignment"),
        matching.confident(F.col("cost"), F.col("m.hungarian"), measure.threshold).alias("confident"),
    )


def real_results(items: DataFrame, chosen: Iterable[Measure], costs: DataFrame | None = None, **options: int) -> DataFrame:
    """measure, matching, coefficients on captions, the true ones on categories, and the errors.

    ``items`` has key, slot, caption and category, as ``annotations.items`` gives them.
    """
    group = "corpus"
    captions = items.select(F.lit("all").alias(group), F.col("key").alias("item"), "slot", F.array("caption").alias("labels"))
    categories = items.select(F.lit("all").alias(group), F.col("key").alias("item"), "slot", F.col("category").alias("labels"))
    truth = written(agreement.many_raters(categories, [group], measures.MEASURES["set_jaccard"], **options), "truth")
    out = []
    for m in chosen:
        scores = agreement.many_raters(captions, [group], m, costs, **options)
        out.append(_against_truth(scores, truth, [group], MANY_COEFFICIENTS).withColumn("measure", F.lit(m.name)))
    return reduce(DataFrame.unionByName, out).orderBy("mae_average_agreement", "measure", "matching")


def real_predictions(items: DataFrame, measure: Measure, costs: DataFrame | None = None) -> DataFrame:
    """key, s, t, matching, distance of each two annotators of an item by their captions; equal pairs are scored once."""
    pairs = agreement.rater_pairs(items.select(F.col("key").alias("item"), "slot", F.array("caption").alias("labels")), [])
    scored = agreement.distances_of(pairs, measure, costs)
    return pairs.join(scored, ["a", "b"]).select(F.col("item").alias("key"), "s", "t", "matching", "distance")


def chance_rows(items: DataFrame, measure: Measure, costs: DataFrame | None = None, **options: int) -> DataFrame:
    """matching, key (an item that has the first set), weight, distance of the pooled chance sample of captions."""
    labels = items.select("key", "slot", label_set(F.array("caption")).alias("labels")).withColumn("pos", F.xxhash64("key", "slot")).withColumn("corpus", F.lit("all"))
    pairs = written(chance.chance_pairs(labels, labels.withColumn("pos", F.xxhash64(F.lit("other"), "pos")), ["corpus"], **options), "chance")
    owner = labels.groupBy(F.col("labels").alias("a")).agg(F.min("key").alias("key"))
    return pairs.join(agreement.distances_of(pairs, measure, costs), ["a", "b"]).join(owner, "a").select("matching", "key", "weight", "distance")


def timing(pairs: DataFrame, measure: Measure, costs: DataFrame | None = None) -> dict:
    """measure, n_pairs, elapsed_seconds, pairs_per_second of scoring the distinct pairs once."""
    distinct = written(pairs.select("a", "b").distinct(), "pairs")
    n, began = distinct.count(), time.perf_counter()
    measures.score_pairs(distinct, measure, costs).write.format("noop").mode("overwrite").save()
    took = time.perf_counter() - began
    return {"measure": measure.name, "n_pairs": n, "elapsed_seconds": took, "pairs_per_second": n / took}
