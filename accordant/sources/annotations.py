"""Corpora with several annotators an item: image captions, dictated readings and free descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.functions.keys import stripped
from accordant.functions.text import folded

#: What stands for no category.
NO_CATEGORY = {"disease_label": ["no definitive diagnosis"], "skin_concept": ["no visual concepts"]}


def _prefixed(tags: Column, prefix: str) -> Column:
    return F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.concat(F.lit(prefix), t))


def category(row_field: str) -> Column:
    """The set of case-folded tags of ``disease_label``, ``skin_concept`` or ``both``; null where there is none."""
    if row_field == "both":
        named = [_prefixed(category(f), f + ":") for f in NO_CATEGORY]
        union = F.array_sort(F.array_union(*named))
        return F.when(F.size(union) > 0, union)
    text = folded(stripped(F.coalesce(F.col(row_field), F.lit(""))))
    if row_field == "disease_label":
        tags = F.array(text)
    else:
        tags = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), stripped), lambda t: t != "")))
    return F.when((text != "") & ~text.isin(NO_CATEGORY[row_field]) & (F.size(tags) > 0), tags)


def parent_label(hierarchy: Column, leaf: Column) -> Column:
    """The comma-separated hierarchy without the leaf, in any case; null if nothing is left."""
    parts = F.filter(F.transform(F.split(hierarchy, ","), stripped), lambda p: (p != "") & (folded(p) != folded(stripped(leaf))))
    joined = F.array_join(parts, ", ")
    return F.when(joined != "", joined)


def usable(rows: DataFrame) -> DataFrame:
    """Rows with a path, a caption and a hash, and their archive (the path's first segment)."""
    kept = rows.filter("phash is not null and phash <> '' and filename like '%/%'").withColumn("caption", stripped(F.col("caption")))
    return kept.filter("caption <> ''").withColumn("archive", F.substring_index("filename", "/", 1))


def derm1_concepts(rows: DataFrame) -> DataFrame:
    """Images with two captions or more: the first is the preferred term, the others synonyms, the first parent counts.

    Captions that differ in case only are one.  ``rows`` has row_id, phash, filename, caption, disease_label and
    hierarchical_disease_label.
    """
    good = usable(rows).withColumn("key", folded(F.col("caption")))
    once = good.groupBy("phash", "key").agg(F.min(F.struct("row_id", "caption")).alias("x"))
    captions = once.groupBy("phash").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["caption"]).alias("captions"), F.min("x.row_id").alias("ord"))
    parent = parent_label(F.col("hierarchical_disease_label"), F.col("disease_label"))
    parents = good.filter(stripped(F.col("disease_label")) != "").withColumn("parent", parent).filter("parent is not null").groupBy("phash").agg(F.min_by("parent", "row_id").alias("parent"))
    return (
        captions.filter(F.size("captions") >= 2)
        .join(parents, "phash", "left")
        .select(
            "ord", F.col("phash").alias("code"), F.get("captions", 0).alias("preferred_term"), F.slice("captions", 2, F.size("captions")).alias("synonyms"),
            F.array_compact(F.array("parent")).alias("parent_codes"), F.array().cast("array<string>").alias("hierarchy_key"),
        )
    )


def derm1_annotations(rows: DataFrame, field: str) -> DataFrame:
    """key, caption, category, source, ord of rows with a category whose image is in two archives or more."""
    tagged = usable(rows).withColumn("category", category(field)).filter("category is not null")
    wide = tagged.groupBy("phash").agg(F.min("archive").alias("a"), F.max("archive").alias("b")).filter("a <> b").select("phash")
    return tagged.join(wide, "phash", "left_semi").select(F.col("phash").alias("key"), "caption", "category", F.col("archive").alias("source"), F.col("row_id").alias("ord"))


def items(annotations: DataFrame, least: int = 2) -> DataFrame:
    """key, slot, source, caption, category: the first row of each source of an item with ``least`` sources or more."""
    first = annotations.groupBy("key", "source").agg(F.min_by(F.struct("ord", "caption", "category"), F.struct("ord", "caption")).alias("x"))
    per = Window.partitionBy("key")
    return (
        first.select("key", "source", "x.*")
        .withColumn("n", F.count(F.lit(1)).over(per))
        .filter(F.col("n") >= least)
        .withColumn("slot", F.row_number().over(per.orderBy("ord", "source")) - 1)
        .select("key", "slot", "source", "caption", "category")
    )


def hash_cache(spark: SparkSession, path: str) -> DataFrame:
    """filename, phash of a two-column file; rows that don't parse are left out."""
    return spark.read.csv(path, schema="filename string, phash string", mode="DROPMALFORMED").filter("filename is not null and phash is not null")


def certain_labels(certainty: list[str], boolean: list[str]) -> Column:
    """Lower-case names of the columns with a positive whole number or the word true."""
    given = [F.when(F.trim(F.col(f"`{c}`")).try_cast("int") > 0, F.lit(c.lower())) for c in certainty]
    given += [F.when(F.lower(F.trim(F.col(f"`{c}`"))) == "true", F.lit(c.lower())) for c in boolean]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*given))))


def reflacx_annotations(metadata: dict[int, DataFrame], texts: DataFrame, labels: dict[int, tuple[list[str], list[str]]], max_rows: int | None = None) -> DataFrame:
    """key, caption, category, source, ord of items with two readings or more.

    ``metadata`` has by phase id, dicom_id, eye_tracking_data_discarded and label columns; the row limit comes before
    discarded rows go.  ``texts`` has id and text.  An item in two phases is an error.
    """
    out = None
    for phase, rows in sorted(metadata.items()):
        taken = rows.limit(max_rows) if max_rows is not None else rows
        kept = taken.filter(F.lower(F.trim(F.coalesce("eye_tracking_data_discarded", F.lit("")))) != "true")
        part = kept.select(F.lit(phase).alias("phase"), "id", F.col("dicom_id").alias("key"), certain_labels(*labels[phase]).alias("category"))
        out = part if out is None else out.unionByName(part)
    twice = out.groupBy("key").agg(F.countDistinct("phase").alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError("phases share items")
    read = out.join(texts.filter(F.trim("text") != ""), "id")
    several = read.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("key")
    return read.join(several, "key", "left_semi").select("key", F.trim("text").alias("caption"), "category", F.col("id").alias("source"), F.col("id").alias("ord"))


def passion_annotations(rows: DataFrame, subjects: DataFrame) -> DataFrame:
    """key, caption, category, source, ord from img_path and descr1..4; subjects has subject_id, diagnosis, conditions."""
    subject = F.regexp_extract("img_path", r"^(.*)_[^_]*$", 1)
    long = rows.select("img_path", subject.alias("subject_id"), F.explode(F.array(*[F.struct(F.lit(f"descr{i}").alias("source"), F.col(f"descr{i}").alias("caption")) for i in range(1, 5)])).alias("x")).select("img_path", "subject_id", "x.*")
    filled = long.filter("trim(caption) <> ''")
    several = filled.groupBy("img_path").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("img_path")
    tags = F.array_sort(F.array_distinct(F.filter(F.array(F.lower(F.trim("diagnosis")), F.lower(F.trim("conditions"))), lambda t: t != "")))
    known = subjects.select("subject_id", F.coalesce(tags, F.array().cast("array<string>")).alias("category"))
    return filled.join(several, "img_path", "left_semi").join(known, "subject_id").select(F.col("img_path").alias("key"), F.trim("caption").alias("caption"), "category", "source", F.col("source").alias("ord"))


def wanted_members(rows: DataFrame) -> DataFrame:
    """member, filename: the names under which an archive may hold an image, its path and its path without the archive.

    A name that is some image's whole path is that image's; else the image of the smallest path has it.
    """
    named = rows.filter("filename is not null").select("filename")
    short = named.filter("filename like '%/%'").select(F.expr("substr(filename, instr(filename, '/') + 1)").alias("member"), F.lit(1).alias("rank"), "filename")
    both = named.select(F.col("filename").alias("member"), F.lit(0).alias("rank"), "filename").unionByName(short.filter("member <> ''"))
    return both.groupBy("member").agg(F.min(F.struct("rank", "filename")).alias("x")).select("member", "x.filename")


def with_hashes(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """``rows`` with the ``phash`` of their file out of the cache (filename, phash), null where it has none."""
    one = cache.filter("filename is not null").groupBy("filename").agg(F.max("phash").alias("phash"))
    return rows.drop("phash").join(one, "filename", "left")


def append_hashes(found: DataFrame, cache: DataFrame, path: str) -> None:
    """Appends to the cache's folder the hashes of files that it lacks."""
    fresh = found.select("filename", "phash").filter("filename is not null and phash is not null").dropDuplicates(["filename"])
    fresh.join(cache.select("filename"), "filename", "left_anti").write.csv(path, header=True, mode="append")
