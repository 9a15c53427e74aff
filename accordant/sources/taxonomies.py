"""Taxonomies as concepts: ICD-11 lists, MedDRA files and MeSH XML.

A concept has ord, code, preferred_term, synonyms, parent_codes and hierarchy_key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUPINGS = [f"Grouping{i}" for i in range(1, 6)]
ICD11_SCHEMA = ", ".join(f"`{c}` string" for c in ["Foundation URI", "Code", "BlockId", "Title", "ClassKind", *GROUPINGS])
NO_TERMS = "array<string>"


def clean_title(c: Column) -> Column:
    """Without outer white space, quotes and the leading dashes of a level."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r'^"+|"+$', ""), r"^[- ]+", ""))


def read_icd11(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the tab-separated list with their order; a byte order mark is no part of the first header."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=ICD11_SCHEMA, enforceSchema=True, encoding="UTF-8", quote='"', escape='"')
    rows = raw.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c.replace(" ", "_")) for c in ["Foundation URI", "Code", "BlockId", "Title", "ClassKind", *GROUPINGS]])
    return rows.withColumn("ord", F.monotonically_increasing_id())


def icd11_parents(rows: DataFrame) -> DataFrame:
    """code, parent of categories: the dotted prefix if that is a category, else the deepest grouping."""
    category = rows.filter("ClassKind = 'category' and Code <> ''")
    prefix = F.regexp_extract("Code", r"^(.*)\.[^.]*$", 1)
    known = category.select(F.col("Code").alias("prefix")).distinct()
    deepest = F.coalesce(*[F.when(F.col(g) != "", F.col(g)) for g in reversed(GROUPINGS)])
    found = category.withColumn("prefix", prefix).join(known.withColumn("known", F.lit(True)), "prefix", "left")
    return found.select(F.col("Code").alias("code"), F.when(F.col("known"), F.col("prefix")).otherwise(deepest).alias("parent")).filter("parent is not null")


def icd11_concepts(rows: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Categories with a code and synonyms (code, synonyms); the last of equal codes counts."""
    last = Window.partitionBy("Code").orderBy(F.desc("ord"))
    category = rows.filter("ClassKind = 'category' and Code <> ''").withColumn("n", F.row_number().over(last)).filter("n = 1")
    parents = icd11_parents(rows).groupBy("code").agg(F.max("parent").alias("parent"))
    return (
        category.select("ord", F.col("Code").alias("code"), clean_title(F.col("Title")).alias("preferred_term"))
        .join(synonyms.filter(F.size("synonyms") > 0), "code")
        .join(parents, "code", "left")
        .select("ord", "code", "preferred_term", "synonyms", F.array_compact(F.array("parent")).alias("parent_codes"), F.array("code").alias("hierarchy_key"))
    )


def icd11_titles(rows: DataFrame) -> DataFrame:
    """code, title of blocks (by their block id) and categories."""
    code = F.when(F.col("ClassKind") == "block", F.col("BlockId")).when(F.col("ClassKind") == "category", F.col("Code"))
    return rows.select(code.alias("code"), clean_title(F.col("Title")).alias("title")).filter("code <> ''")


def icd11_above(rows: DataFrame) -> DataFrame:
    """code, parent: neighbouring groupings give edges between blocks; a category's own parent replaces them."""
    path = F.filter(F.array(*GROUPINGS), lambda g: g != "")
    edges = rows.select(path.alias("p")).filter(F.size("p") > 1)
    blocks = edges.select(F.explode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("parent"), F.slice("p", 2, F.size("p") - 1).alias("code"))).alias("e"))
    blocks = blocks.select("e.code", "e.parent").distinct()
    own = icd11_parents(rows)
    return blocks.join(own.select("code"), "code", "left_anti").unionByName(own)


def icd11_codes(rows: DataFrame) -> DataFrame:
    """code, entity (the last segment of the foundation URI) of categories."""
    return rows.filter("ClassKind = 'category' and Code <> '' and Foundation_URI <> ''").select(F.col("Code").alias("code"), F.element_at(F.split("Foundation_URI", "/"), -1).alias("entity"))


def terms(synonym: Column, inclusion: Column) -> Column:
    """Trimmed labels of two lists of terms in order, each once."""
    both = F.concat(F.coalesce(synonym, F.array().cast(NO_TERMS)), F.coalesce(inclusion, F.array().cast(NO_TERMS)))
    return F.array_distinct(F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x != ""))


def read_dollar(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A file of fields that end in dollar signs."""
    parts = F.split(F.col("value"), r"\$")
    return spark.read.text(path).select(*[F.trim(F.get(parts, i)).alias(c) for i, c in enumerate(columns)]).filter(f"{columns[0]} <> ''")


#: Leading fields of the MedDRA files.
LLT, PT, LINK = ["llt_code", "llt_name", "pt_code", "w1", "w2", "w3", "w4", "w5", "w6", "llt_currency"], ["pt_code", "pt_name", "w1", "pt_soc_code"], ["parent", "code"]


def meddra_concepts(pt: DataFrame, llt: DataFrame, hlt_pt: DataFrame | None = None) -> DataFrame:
    """Preferred terms with a current lower-level term of another name; parents from links (parent, code) if given.

    ``ord`` is the place of the term's first row in the file, or its least ``ord`` where ``pt`` has one.
    """
    names = llt.filter("llt_currency = 'Y' and pt_code is not null")
    order = F.col("ord") if "ord" in pt.columns else F.monotonically_increasing_id()  # of the file
    first = pt.filter("pt_code is not null").withColumn("ord", order).groupBy("pt_code").agg(F.min("pt_name").alias("pt_name"), F.min("ord").alias("ord"))
    other = names.join(first, "pt_code").filter("llt_name <> pt_name")
    synonyms = other.groupBy("pt_code").agg(F.array_sort(F.collect_set("llt_name")).alias("synonyms"))
    out = first.join(synonyms, "pt_code")
    if hlt_pt is not None:
        out = out.join(hlt_pt.groupBy(F.col("code").alias("pt_code")).agg(F.array_sort(F.collect_set("parent")).alias("parents")), "pt_code", "left")
    parents = F.coalesce("parents", F.array().cast(NO_TERMS)) if hlt_pt is not None else F.array().cast(NO_TERMS)
    return out.select(
        "ord", F.col("pt_code").alias("code"), F.col("pt_name").alias("preferred_term"), "synonyms",
        parents.alias("parent_codes"), F.array().cast(NO_TERMS).alias("hierarchy_key"),
    )


def meddra_titles(*levels: DataFrame) -> DataFrame:
    """code, title of the levels above preferred terms, each with two columns."""
    out = [x.toDF("code", "title") for x in levels]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def meddra_links(*levels: DataFrame) -> DataFrame:
    """code, parent of the levels above preferred terms, from frames of ``LINK`` columns; blank ends are no link.

    A code that several levels name as a child has the parents of the last one given.
    """
    out = None
    for level in levels:
        links = level.select("code", "parent").filter("trim(code) <> '' and trim(parent) <> ''").distinct()
        out = links if out is None else out.join(links.select("code").distinct(), "code", "left_anti").unionByName(links)
    return out


#: The parts of a MeSH descriptor record that are read.
MESH_SCHEMA = """_DescriptorClass string, DescriptorUI string, DescriptorName struct<String:string>,
TreeNumberList struct<TreeNumber:array<string>>,
ConceptList struct<Concept:array<struct<_PreferredConceptYN:string,
TermList:struct<Term:array<struct<_RecordPreferredTermYN:string,String:string>>>>>>"""


def mesh_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Descriptors of class 1: other terms of preferred concepts are synonyms, tree numbers less their last part parents."""
    raw = spark.read.format("xml").option("rowTag", "DescriptorRecord").schema(MESH_SCHEMA).load(path)
    preferred = F.filter("ConceptList.Concept", lambda c: c["_PreferredConceptYN"] == "Y")
    every = F.flatten(F.transform(preferred, lambda c: c["TermList"]["Term"]))
    name = F.col("DescriptorName.String")
    other = F.filter(every, lambda t: (F.coalesce(t["_RecordPreferredTermYN"], F.lit("N")) != "Y") & (t["String"] != name))
    keys = F.coalesce(F.col("TreeNumberList.TreeNumber"), F.array().cast(NO_TERMS))
    above = F.transform(F.filter(keys, lambda k: k.contains(".")), lambda k: F.regexp_replace(k, r"\.[^.]*$", ""))
    return (
        raw.filter("_DescriptorClass = '1'")
        .select(
            F.monotonically_increasing_id().alias("ord"), F.col("DescriptorUI").alias("code"), name.alias("preferred_term"),
            F.array_distinct(F.transform(other, lambda t: t["String"])).alias("synonyms"),
            F.array_sort(F.array_distinct(above)).alias("parent_codes"), keys.alias("hierarchy_key"),
        )
        .filter(F.size("synonyms") > 0)
    )


def open_codes(codes: DataFrame, done: DataFrame) -> DataFrame:
    """The codes whose synonyms are not written yet: where a crawl that broke off goes on.  Null codes are none."""
    return codes.select("code").filter("code is not null").distinct().join(done.select("code"), "code", "left_anti")


def append_synonyms(found: DataFrame, path: str) -> None:
    """code and synonyms as JSON lines behind what the folder holds; an empty list marks a code as done too."""
    found.select("code", F.coalesce("synonyms", F.array().cast(NO_TERMS)).alias("synonyms")).write.json(path, mode="append", ignoreNullFields=False)
