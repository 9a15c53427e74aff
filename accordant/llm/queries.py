"""Queries of the corpus operators over this project's tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.llm import bpe, labels, mixing, spans
from accordant.llm.consensus import Consensus
from accordant.storage import written


def _table(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{name}.parquet")


# --- consensus from several annotators' labels


def _readings(spark: SparkSession, where: str) -> tuple[DataFrame, dict[int, str]]:
    """Votes of each annotator's first reading of each item that names a term: a later row is no second opinion."""
    words, names = labels.vocabulary(_table(spark, where, "label_terms"))
    rows, pairs = _table(spark, where, "annotation_rows"), _table(spark, where, "rater_pairs")
    none = F.lit(None).cast("string")
    read = [rows.select(F.lit("annotation_rows").alias("tbl"), F.col("item_key").alias("item"), F.col("source").alias("annotator"), F.col("category").alias("labels"), "caption", F.struct("ord", "row_id").alias("place"))]
    for side in ("rater_a", "rater_b"):
        read.append(
            pairs.select(F.lit("rater_pairs").alias("tbl"), F.col("item_id").cast("string").alias("item"), F.col(f"{side}_id").alias("annotator"), F.col(side).alias("labels"), none.alias("caption"), F.struct(F.col("pass_no").alias("ord"), "row_id").alias("place"))
        )
    every = read[0].unionByName(read[1]).unionByName(read[2]).filter("item is not null")
    chosen = every.select("tbl", "item", "annotator", "place", labels.resolved(F.col("labels"), F.col("caption"), words).alias("votes"))
    first = chosen.filter(F.size("votes") > 0).groupBy("tbl", "item", "annotator").agg(F.min_by("votes", "place").alias("votes"))
    kind, term = labels.votes(F.col("x"))
    alike = F.size(F.filter("votes", lambda v: labels.votes(v)[0] == kind))  # votes of one kind divide one
    votes = first.select("tbl", "item", "annotator", "votes", F.explode("votes").alias("x")).select("tbl", "item", "annotator", kind.alias("kind"), term.alias("term"), (F.lit(1.0) / alike).alias("share"))
    return written(votes, "readings"), names


def consensus_of(spark: SparkSession, where: str) -> Consensus:
    return Consensus(_readings(spark, where)[0], shared=True)


def p1_items(spark: SparkSession, where: str) -> DataFrame:
    """tbl, item, consensus, confidence, agreement, n_annotators of every item that is to have a label."""
    votes, names = _readings(spark, where)
    found = Consensus(votes, shared=True).labels()
    rows, pairs = _table(spark, where, "annotation_rows"), _table(spark, where, "rater_pairs")
    items = (
        rows.filter("item_key is not null and source is not null")
        .groupBy("item_key")
        .agg(F.min("source").alias("a"), F.max("source").alias("b"))
        .filter("a <> b")
        .select(F.lit("annotation_rows").alias("tbl"), F.col("item_key").alias("item"))
        .unionByName(pairs.filter("item_id is not null").select(F.lit("rater_pairs").alias("tbl"), F.col("item_id").cast("string").alias("item")).distinct())
    )
    text = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map(F.lit(0), F.lit(""))
    return items.join(found, ["tbl", "item"], "left").select(
        "tbl", "item", text[F.col("term")].alias("consensus"), "confidence", "agreement", F.coalesce("n_annotators", F.lit(0)).alias("n_annotators")
    )


def p1_found(spark: SparkSession, where: str) -> DataFrame:
    return p1_items(spark, where).select("tbl", "item", "consensus")


def p1_reliability(spark: SparkSession, where: str) -> DataFrame:
    return consensus_of(spark, where).reliability


# --- encoding of the whole corpus with a public tokenizer


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The file of ranks, in the folder named by ACCORDANT_TOKENIZERS or in /opt/tokenizers."""
    return os.path.join(os.environ.get("ACCORDANT_TOKENIZERS", "/opt/tokenizers"), name)


def p6_ids(spark: SparkSession, where: str) -> DataFrame:
    return bpe.encode(_table(spark, where, "documents"), "doc_id", vocabulary_path())


def p6_decoded(spark: SparkSession, where: str) -> DataFrame:
    """Every text out of its ids again: equal to the text, null as empty."""
    return bpe.decode(p6_ids(spark, where), "doc_id", vocabulary_path())


P6_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


# --- mixing sources to target weights


def _mix(spark: SparkSession, where: str) -> mixing.Mix:
    return mixing.Mix(_table(spark, where, "documents"), _table(spark, where, "mix_targets"), vocabulary_path())


def p7_mix(spark: SparkSession, where: str) -> DataFrame:
    return _mix(spark, where).selection()


def p7_shares(spark: SparkSession, where: str) -> DataFrame:
    return _mix(spark, where).report()


# --- long exact spans shared between records


def p8_found(spark: SparkSession, where: str) -> DataFrame:
    return spans.SharedSpans(_table(spark, where, "documents"), F.col("loaded_at")).pairs()


def p8_coverage(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, n_chars, class_id, shared_chars and share of every document; null and short texts share nothing."""
    docs = _table(spark, where, "documents")
    found = spans.SharedSpans(docs, F.col("loaded_at"), every=True).coverage()
    every = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    return every.join(found.drop("n_chars"), "doc_id", "left").select(
        "doc_id", "n_chars", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("share", F.lit(0.0)).alias("share")
    )


def p8_classes(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, class_id (of copies) and n_links (other classes with a common span) of each document of span length."""
    shared = spans.SharedSpans(_table(spark, where, "documents"), F.col("loaded_at"))
    links = shared.class_links()
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return shared.classes.join(degree, "rep", "left").select("doc_id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


P8_FOUND = """
WITH w AS (
  SELECT DISTINCT doc_id, md5(substr(text, i, 200)) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)
)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.s = b.s AND a.doc_id < b.doc_id
"""
P8_COVERAGE = """
WITH w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
common AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT doc_id, i, i + 200 AS e, coalesce(max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT DISTINCT doc_id, i FROM w JOIN common USING (s))),
n AS (SELECT doc_id, sum(greatest(e - greatest(i, before), 0)) AS shared FROM m GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM documents WHERE length(text) >= 200)
SELECT d.doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(shared, 0) AS BIGINT) AS shared_chars,
  CASE WHEN shared IS NULL THEN 0.0 ELSE shared / length(text) END AS share
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
P8_CLASSES = """
WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT DISTINCT class_id, md5(substr(text, i, 200)) AS s FROM (SELECT class_id, text, unnest(range(1, length(text) - 198)) AS i FROM k WHERE doc_id = class_id)),
n AS (SELECT a.class_id, count(DISTINCT b.class_id) AS n FROM w a JOIN w b ON a.s = b.s AND a.class_id <> b.class_id GROUP BY a.class_id)
SELECT k.doc_id, k.class_id, coalesce(n, 0) AS n_links FROM k LEFT JOIN n ON n.class_id = k.class_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_items, p1_reliability, p6_ids, p6_decoded, p7_mix, p7_shares, p8_found, p8_coverage, p8_classes)
}
ORACLES: dict[str, str] = {"p6_decoded": P6_DECODED, "p8_found": P8_FOUND, "p8_coverage": P8_COVERAGE, "p8_classes": P8_CLASSES}
