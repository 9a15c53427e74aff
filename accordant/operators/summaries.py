"""Errors against a known truth, their summaries, and paired permutation tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS, ALPHA = 1000, 0.05


def absolute_error(value: Column, truth: Column) -> Column:
    return F.abs(value - truth)


def percent_error(value: Column, truth: Column) -> Column:
    """NaN where the truth is zero."""
    return F.when(truth == 0, float("nan")).otherwise(F.abs(value - truth) / F.abs(F.when(truth != 0, truth)) * 100.0)


def strategy_name(measure: Column, matching: Column) -> Column:
    return F.when(matching.isin("none", "hungarian") | matching.isNull(), measure).otherwise(F.concat(measure, F.lit(" ("), matching, F.lit(")")))


def error_table(rows: DataFrame, group: list[str]) -> DataFrame:
    """group, measure, mean_mae, std_mae (population), mean_mape (NaN ones left out), n.  ``rows`` has mae and mape."""
    known = F.when(~F.isnan("mape"), F.col("mape"))
    return rows.groupBy(*group, "measure").agg(
        F.avg("mae").alias("mean_mae"), F.stddev_pop("mae").alias("std_mae"), F.avg(known).alias("mean_mape"), F.count(F.lit(1)).alias("n")
    )


def permutation_p(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, seed: int = 0) -> float:
    """Two-sided p of the mean difference of paired samples, by random signs; the observed one counts."""
    d = x - y
    signs = np.random.default_rng(seed).integers(0, 2, (rounds, len(d)), dtype=np.int8) * 2 - 1
    means = np.abs((signs * d).mean(axis=1))
    return float(((means >= abs(d.mean()) - 1e-12).sum() + 1) / (rounds + 1))


def significance(rows: DataFrame, group: list[str], rounds: int = ROUNDS, alpha: float = ALPHA, seed: int = 0) -> DataFrame:
    """group, measure, mean_mae, p_value, significant, is_best, best_measure: every measure against the best of its group.

    ``rows`` has measure, seed and mae, one row a seed.  The best has the least mean error (the first by name among
    equals).  Fewer than two common seeds give NaN.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    means = rows.groupBy(*group, "measure").agg(F.avg("mae").alias("mean_mae"))
    whole = Window.partitionBy(*group)
    best = means.withColumn("best_measure", F.min(F.struct("mean_mae", "measure")).over(whole)["measure"])
    other = rows.join(best, [*group, "measure"])
    reference = other.filter("measure = best_measure").select(*group, "seed", F.col("mae").alias("best_mae"))
    paired = other.join(reference, [*group, "seed"], "left")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        is_best = first["measure"] == first["best_measure"]
        common = pdf.dropna(subset=["best_mae"]).sort_values("seed")
        p = float("nan") if is_best or len(common) < 2 else permutation_p(common["mae"].to_numpy(), common["best_mae"].to_numpy(), rounds, seed)
        return pd.DataFrame([[*first[group], first["measure"], first["mean_mae"], p, bool(p < alpha), is_best, first["best_measure"]]],
                            columns=[*group, "measure", "mean_mae", "p_value", "significant", "is_best", "best_measure"])

    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), "measure string, mean_mae double, p_value double, significant boolean, is_best boolean, best_measure string"])
    out = paired.groupBy(*group, "measure").applyInPandas(one, schema)
    return out.withColumn("p_value", F.coalesce("p_value", F.lit(float("nan"))))  # pandas hands NaN over as null
