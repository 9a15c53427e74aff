from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from accordant.operators.measures import MEASURES
from accordant.streaming.agreement import running_agreement, windowed_agreement

SCHEMA = "id long, at timestamp, rater_a array<string>, rater_b array<string>, key string"


def rows(spark):
    t = datetime(2024, 1, 1)
    data = [(i, t + timedelta(days=i), ["a"], ["a"] if i % 2 else ["b"], f"k{i % 3}") for i in range(60)] + [(99, None, None, [], None)]
    return spark.createDataFrame(data, SCHEMA)


def test_stream_equals_batch(spark, tmp_path):
    df = rows(spark)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windowed_agreement(stream, MEASURES["set_jaccard"], "at", "10 days", "365 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["window_start"], r["n_items"], r["average_agreement"]) for r in spark.table("windows").collect()}
    want = {(r["window_start"], r["n_items"], r["average_agreement"]) for r in windowed_agreement(df, MEASURES["set_jaccard"], "at", "10 days").filter("window_start is not null").collect()}
    assert got == want and sum(n for _, n, _ in got) == 60


def test_running_state(spark, tmp_path):
    rows(spark).filter("key is not null").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running_agreement(stream, MEASURES["exact_match"], F.col("key")).writeStream.format("memory").queryName("running").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(180)
    last = spark.table("running").groupBy("key").agg(F.max_by("average_agreement", "n_items").alias("a"), F.max("n_items").alias("n")).collect()
    assert sorted((r["key"], r["n"], r["a"]) for r in last) == [("k0", 20, 0.5), ("k1", 20, 0.5), ("k2", 20, 0.5)]


def test_matching_measures_are_refused(spark):
    with pytest.raises(ValueError):
        windowed_agreement(rows(spark), MEASURES["bipartite_jaccard"], "at")
