"""Predictions, cost matrices and pair costs: readers, writers and the cache of label costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["dataset", "mode", "negative_mode", "agreement_level", "seed", "sample_index"]
#: What ties a matrix to the prediction that has its true pairs.
TRUTH_KEY = ["dataset", "negative_mode", "measure", "agreement_level", "seed", "sample_index"]
MATRIX_SCHEMA = "dataset string, mode string, negative_mode string, agreement_level double, seed long, measure string, sample_index int, cost array<array<double>>"
PAIR_SCHEMA = "measure string, reasoning boolean, x string, y string, cost double"
PREDICTION_SCHEMA = (
    "dataset string, mode string, negative_mode string, agreement_level double, seed long, measure string, chance_measure string, reasoning boolean, "
    "sample_index int, rater_a_set_size int, rater_b_set_size int, rater_a string, rater_b string, distance double, true_match boolean, true_assignment string"
)
_LINKS = "array<array<int>>"


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped or plain JSON lines; a torn line is left out, a truncated file gives what it holds."""
    return spark.read.schema(MATRIX_SCHEMA).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").json(path)


def write_matrices(matrices: DataFrame, path: str) -> None:
    """JSON lines with costs to six places."""
    rounded = F.transform("cost", lambda row: F.transform(row, lambda c: F.bround(c, 6)))
    matrices.select(*[c for c in ["dataset", "mode", "negative_mode", "agreement_level", "seed", "measure", "sample_index"]], rounded.alias("cost")).write.json(path, compression="gzip", mode="overwrite")


def read_pair_costs(spark: SparkSession, path: str) -> DataFrame:
    """Pair costs with when their file was written."""
    rows = spark.read.schema(PAIR_SCHEMA).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").json(path)
    return rows.select(*[f.name for f in rows.schema.fields], F.col("_metadata.file_modification_time").alias("written_at"))


def append_pair_costs(costs: DataFrame, path: str) -> None:
    costs.select("measure", "reasoning", "x", "y", "cost").write.json(path, compression="gzip", mode="append")


def read_predictions(spark: SparkSession, path: str, reasoning: bool | None = None) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=PREDICTION_SCHEMA, multiLine=True, escape='"', mode="PERMISSIVE")
    return rows if reasoning is None else rows.filter(F.coalesce("reasoning", F.lit(False)) == reasoning)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, or CSV with a header; arrays become JSON text in CSV."""
    if kind == "parquet":
        df.write.parquet(path, mode="overwrite")
        return
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.csv(path, header=True, mode="overwrite", escape='"')


def output_suffix(mode: str, draft: bool = False, chance: str | None = None, reasoning: bool = False) -> str:
    """The tail of a run's file names."""
    tail = "_uniform" if mode == "set" else ""
    tail += "_draft" if draft else f"_chance-{chance}" if chance else ""
    return tail + ("_reasoning" if reasoning else "")


# --- label costs


def base_measure(c: Column) -> Column:
    return F.regexp_replace(c, "_single$", "")


def unordered(p: Column, q: Column) -> list[Column]:
    """The smaller of two labels, and the larger."""
    return [F.least(p, q).alias("x"), F.greatest(p, q).alias("y")]


def with_true_pairs(matrices: DataFrame, predictions: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """Matrices with ``truth`` (array<struct<i, j>>), the non-empty true assignment of the sample of the same ``TRUTH_KEY``.

    Of several predictions of a key the last by row_id counts.
    """
    truths = (
        predictions.filter("sample_index is not null and true_assignment is not null and true_assignment <> ''")
        .groupBy(*TRUTH_KEY)
        .agg(F.max_by("true_assignment", "row_id").alias("t"))
        .withColumn("truth", F.transform(F.from_json("t", _LINKS), lambda p: F.struct(F.get(p, 0).alias("i"), F.get(p, 1).alias("j"))))
        .filter(F.size("truth") > 0)
        .drop("t")
    )
    wanted = matrices.filter(F.col("measure").isin(measures)) if measures is not None else matrices
    return wanted.filter((F.size("cost") > 0) & (F.size(F.get("cost", 0)) > 0)).join(truths, TRUTH_KEY)


def matrix_costs(matrices: DataFrame, predictions: DataFrame, at: Column, reasoning: bool | None = None) -> DataFrame:
    """measure, x, y, cost, at: the labels of the prediction of the same key and measure with each cell's cost.

    Matrices whose shape is not that of the label lists are left out; ``unmatched_matrices`` counts them.  With
    ``reasoning`` only predictions of runs with it (or without it, null counting as without) are taken.
    """
    if reasoning is not None:
        predictions = predictions.filter(F.coalesce("reasoning", F.lit(False)) == reasoning)
    words = predictions.filter("rater_a is not null and rater_b is not null").groupBy(*KEY, "measure").agg(F.max_by(F.struct("rater_a", "rater_b"), "row_id").alias("w"))
    words = words.select(*KEY, base_measure(F.col("measure")).alias("measure"), F.from_json("w.rater_a", "array<string>").alias("a"), F.from_json("w.rater_b", "array<string>").alias("b"))
    met = matrices.withColumn("measure", base_measure(F.col("measure"))).withColumn("at", at).join(words, [*KEY, "measure"])
    fit = met.filter((F.size("cost") == F.size("a")) & (F.size(F.get("cost", 0)) == F.size("b")))
    rows = fit.select("measure", "at", "a", "b", F.posexplode("cost").alias("i", "row"))
    cells = rows.select("measure", "at", F.get("a", F.col("i")).alias("p"), "b", F.posexplode("row").alias("j", "cost"))
    return cells.select("measure", *unordered(F.col("p"), F.get("b", F.col("j"))), "cost", "at")


def newest(costs: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """One cost for each key: the last by ``at``, the largest among equals."""
    return costs.groupBy(*keys).agg(F.max_by("cost", F.struct(at, "cost")).alias("cost"))


def load_costs(matrices: DataFrame, predictions: DataFrame, pair_costs: DataFrame | None = None, reasoning: bool = False, at: str = "loaded_at", measures: list[str] | None = None) -> DataFrame:
    """measure, x, y, cost: the newest cost of each pair of labels out of matrices and of pair costs, as one history.

    ``pair_costs`` is what ``read_pair_costs`` gives.  Runs with reasoning and without are kept apart.  Null costs and
    labels are left out; of equally new costs the largest counts.
    """
    costs = matrix_costs(matrices, predictions, F.col(at).cast("timestamp"), reasoning)
    if pair_costs is not None:
        own = pair_costs.filter(F.coalesce("reasoning", F.lit(False)) == reasoning)
        costs = costs.unionByName(own.select(base_measure(F.col("measure")).alias("measure"), *unordered(F.col("x"), F.col("y")), "cost", F.col("written_at").cast("timestamp").alias("at")))
    costs = costs.filter("cost is not null and x is not null and y is not null")
    return newest(costs.filter(F.col("measure").isin(measures)) if measures is not None else costs, ["measure", "x", "y"])


def unmatched_matrices(matrices: DataFrame, predictions: DataFrame) -> DataFrame:
    """reason, n: matrices without a prediction of their key and measure, and those of another shape."""
    words = predictions.filter("rater_a is not null").groupBy(*KEY, "measure").agg(F.max_by(F.struct("rater_a_set_size", "rater_b_set_size"), "row_id").alias("w"))
    met = matrices.join(words, [*KEY, "measure"], "left")
    reason = F.when(F.col("w").isNull(), "unmatched").when((F.size("cost") != F.col("w.rater_a_set_size")) | (F.size(F.get("cost", 0)) != F.col("w.rater_b_set_size")), "shape_mismatch").otherwise("used")
    return met.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def fresh_costs(costs: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Costs that the cache lacks: what is to be appended."""
    return costs.join(cache.select(*keys).distinct(), keys, "left_anti")


def latest_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
