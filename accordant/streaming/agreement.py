"""Observed agreement over a stream: an additive aggregate, kept per event-time window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.text import label_set
from accordant.operators.measures import Measure


def windowed_agreement(stream: DataFrame, measure: Measure, time: str, window: str = "30 days", late: str = "7 days", group: list[str] | None = None, a: str = "rater_a", b: str = "rater_b") -> DataFrame:
    """window_start, group, n_items, average_agreement.  Rows later than the watermark are dropped by the engine.

    ``measure`` must have a pair expression, so a batch stays in the JVM.  Works on batch frames as well.
    """
    if measure.pair is None:
        raise ValueError(f"{measure.name} has no pair expression")
    group = group or []
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark(time, late)
    scored = timed.select(*group, time, measure.pair(label_set(F.col(a)), label_set(F.col(b))).alias("d"))
    out = scored.groupBy(F.window(time, window), *group).agg(F.count(F.lit(1)).alias("n_items"), F.avg(1 - F.col("d")).alias("average_agreement"))
    return out.select(F.col("window.start").alias("window_start"), *group, "n_items", "average_agreement")


_STATE = "n long, agreed double"
_OUT = "key string, n_items long, average_agreement double"


def running_agreement(stream: DataFrame, measure: Measure, key: Column, a: str = "rater_a", b: str = "rater_b") -> DataFrame:
    """key, n_items, average_agreement after each batch that has rows of the key; the state is two numbers a key."""
    if measure.pair is None:
        raise ValueError(f"{measure.name} has no pair expression")
    scored = stream.select(key.cast("string").alias("key"), (1 - measure.pair(label_set(F.col(a)), label_set(F.col(b)))).alias("agreement"))

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, agreed = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, agreed = n + len(pdf), agreed + float(pdf["agreement"].sum())
        state.update((n, agreed))
        yield pd.DataFrame([(keys[0], n, agreed / n if n else None)], columns=["key", "n_items", "average_agreement"])

    return scored.groupBy("key").applyInPandasWithState(update, _OUT, _STATE, "update", "NoTimeout")
