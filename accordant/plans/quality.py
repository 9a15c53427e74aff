"""The data-quality operators over this project's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions.keys import code_key, number_key, stripped
from accordant.operators import hierarchy, orphans, packed, parsing


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{name}.parquet")


# --- several values packed in one field

FIELDS = ["skin_concept", "hierarchical_disease_label"]


def packed_values(spark: SparkSession, where: str) -> DataFrame:
    rows = table(spark, where, "derm1_rows")
    return packed.unpack(rows, "row_id", FIELDS, packed.source_of(F.col("filename")), {"skin_concept": "no visual concepts"})


def packed_delimiters(spark: SparkSession, where: str) -> DataFrame:
    rows = table(spark, where, "derm1_rows")
    found = packed.infer_delimiters(rows.select(packed.source_of(F.col("filename")).alias("source"), *FIELDS), FIELDS)
    return found.select("field", "source", F.array_join("delimiters", "|").alias("delimiters"))


# --- rows that fail to parse


def unsound_lines(spark: SparkSession, where: str) -> DataFrame:
    parsed = parsing.parse_lines(table(spark, where, "raw_lines"), ["line_id"])
    return parsed.filter(F.col("defect").isNotNull()).select("line_id", "defect")


def sound_predictions(spark: SparkSession, where: str) -> DataFrame:
    parsed = parsing.parse_lines(table(spark, where, "raw_lines"), ["line_id"])
    records = parsing.typed_records(parsed, ["line_id"], parsing.PREDICTIONS)
    return records.withColumns({c: F.array_join(c, "|") for c in ("rater_a", "rater_b")})


def sound_concepts(spark: SparkSession, where: str) -> DataFrame:
    parsed = parsing.parse_lines(table(spark, where, "raw_lines"), ["line_id"])
    return parsing.typed_records(parsed, ["line_id"], parsing.ICD11)


def recovered_records(spark: SparkSession, where: str) -> DataFrame:
    """The lines as whole files: where records start, how many lines they span and what is wrong with them."""
    return parsing.recover(table(spark, where, "raw_lines")).withColumn("n_fields", F.size("fields")).drop("fields")


# --- references to records that do not exist

_SAMPLE = ["dataset", "mode", "negative_mode", "agreement_level", "seed", "sample_index"]


def _sample_key() -> Column:
    # null in any part makes the key null: nothing equals it
    return F.concat(*[F.concat(F.col(c).cast("string"), F.lit("\x1f")) for c in _SAMPLE])


def _references(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    concepts, pt, llt = (table(spark, where, t) for t in ("concepts", "meddra_pt", "meddra_llt"))
    matrices, predictions = table(spark, where, "cost_matrices"), table(spark, where, "predictions")
    month = F.date_format("loaded_at", "yyyy-MM").alias("loaded_month")
    taxonomy = F.concat(F.lit("concepts/"), F.coalesce("taxonomy", F.lit("")))
    names = F.concat(F.array("code"), F.coalesce("hierarchy_key", F.array().cast("array<string>")))
    keys = [
        concepts.select("taxonomy", "loaded_at", "retired_at", F.explode(names).alias("name")).select(
            *orphans.key_rows(taxonomy, number_key(F.col("name")), F.col("loaded_at"), F.col("retired_at"))
        ),
        pt.select(*orphans.key_rows(F.lit("pt"), number_key(F.col("pt_code")), F.col("loaded_at"), F.col("retired_at"))),
        predictions.select(*orphans.key_rows(F.lit("sample"), _sample_key(), F.col("loaded_at"), F.col("retired_at"))),
    ]

    def refs(df: DataFrame, name: str, ref: Column, domain: Column, key: Column) -> DataFrame:
        return df.select(
            F.lit(name).alias("tbl"), "row_id", ref.alias("ref"), month, *orphans.reference_rows(domain, key, F.col("loaded_at"))
        )

    parents = concepts.select("row_id", "taxonomy", "loaded_at", F.explode(F.array_distinct("parent_codes")).alias("ref"))
    found = [
        refs(parents.filter(stripped(F.col("ref")) != ""), "concepts", F.col("ref"), taxonomy, number_key(F.col("ref"))),
        refs(llt.filter(stripped(F.col("pt_code")) != ""), "meddra_llt", F.col("pt_code"), F.lit("pt"), number_key(F.col("pt_code"))),
        refs(matrices.filter(F.col("sample_index").isNotNull()), "cost_matrices", F.col("sample_index").cast("string"), F.lit("sample"), _sample_key()),
    ]
    return reduce(DataFrame.unionByName, keys), reduce(DataFrame.unionByName, found)


def orphan_references(spark: SparkSession, where: str) -> DataFrame:
    keys, refs = _references(spark, where)
    return orphans.find_orphans(keys, refs, ["tbl", "row_id", "ref", "loaded_month"])


def orphans_by_month(spark: SparkSession, where: str) -> DataFrame:
    return orphans.by_period(orphan_references(spark, where))




# --- parent-child links to full hierarchies


def concept_hierarchy(spark: SparkSession, where: str) -> hierarchy.Hierarchy:
    rows = table(spark, where, "concepts")
    names = F.concat(F.array("code"), F.coalesce("hierarchy_key", F.array().cast("array<string>")))
    return hierarchy.Hierarchy(
        rows.select(
            F.col("taxonomy").alias("group"),
            "code",
            code_key(F.col("code")).alias("key"),
            F.array_compact(F.transform(names, code_key)).alias("keys"),
            F.transform(F.coalesce("parent_codes", F.array().cast("array<string>")), code_key).alias("parents"),
            F.struct("loaded_at", "row_id").alias("version"),
        )
    )


def concept_cycles(spark: SparkSession, where: str) -> DataFrame:
    return concept_hierarchy(spark, where).cycles().withColumnRenamed("group", "taxonomy")


def concept_paths(spark: SparkSession, where: str) -> DataFrame:
    paths = concept_hierarchy(spark, where).paths()
    # a depth of -1 where there is no path
    return paths.select(F.col("group").alias("taxonomy"), "code", F.array_join("path", " > ").alias("path"), F.coalesce("depth", F.lit(-1)).alias("depth"), "root")


def concept_descendants(spark: SparkSession, where: str) -> DataFrame:
    return concept_hierarchy(spark, where).descendants().withColumnRenamed("group", "taxonomy")
