"""Concepts near others: siblings, ancestors, children and lexical neighbours, as edge tables.

``concepts`` has code, preferred_term, synonyms, parent_codes and hierarchy_key (arrays), and ord.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordant.functions.text import lcs_length


def _parents(concepts: DataFrame) -> DataFrame:
    return concepts.select("code", F.posexplode("parent_codes").alias("place", "parent")).filter("parent is not null")


def siblings(concepts: DataFrame) -> DataFrame:
    """code, candidate: other concepts with a common parent, each once.  A parent's children meet in pairs, as asked."""
    edges = _parents(concepts).select("code", "parent").distinct()
    other = edges.withColumnRenamed("code", "candidate")
    return edges.join(other, "parent").filter("code <> candidate").select("code", "candidate").distinct()


def sibling_index(concepts: DataFrame) -> DataFrame:
    """code and the sorted array of its siblings, empty where there are none."""
    found = siblings(concepts).groupBy("code").agg(F.sort_array(F.collect_list("candidate")).alias("candidates"))
    return concepts.select("code").distinct().join(found, "code", "left").select("code", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def ancestors(concepts: DataFrame, hops: int = 2, titles: DataFrame | None = None, above: DataFrame | None = None) -> DataFrame:
    """code, candidate, hop: concepts (or titled classes outside the pool) up to ``hops`` links above.

    ``titles`` has code and title of classes that are no concepts, ``above`` code and parent of theirs.  A candidate
    counts at its least hop; a concept may turn up among its own ancestors where links make a circle.
    """
    spark = concepts.sparkSession
    key = concepts.select(F.explode("hierarchy_key").alias("key"), "code", "ord").filter("key is not null")
    key = key.groupBy("key").agg(F.max_by("code", "ord").alias("named"))
    up = concepts.select(F.col("code").alias("named"), F.explode("parent_codes").alias("next")).filter("next is not null")
    empty = spark.createDataFrame([], "code string, title string")
    titles = empty if titles is None else titles
    outside = spark.createDataFrame([], "code string, parent string") if above is None else above
    frontier = _parents(concepts).select("code", F.col("parent").alias("at")).distinct()
    found, visited = [], frontier
    for hop in range(1, hops + 1):
        met = frontier.join(key, F.col("at") == F.col("key"), "left")
        titled = met.filter("named is null").join(titles.select(F.col("code").alias("at")), "at", "left_semi")
        found.append(met.filter("named is not null").select("code", F.col("named").alias("candidate"), F.lit(hop).alias("hop")))
        found.append(titled.select("code", F.col("at").alias("candidate"), F.lit(hop).alias("hop")))
        if hop == hops:
            break
        higher = met.filter("named is not null").join(up, "named").select("code", F.col("next").alias("at"))
        higher = higher.unionByName(met.join(outside.withColumnRenamed("code", "at"), "at").select("code", F.col("parent").alias("at")))
        frontier = higher.distinct().join(visited, ["code", "at"], "left_anti")
        visited = visited.unionByName(frontier)
    return reduce(DataFrame.unionByName, found).groupBy("code", "candidate").agg(F.min("hop").alias("hop"))


def children(concepts: DataFrame) -> DataFrame:
    """code, candidate, one row for each key of the concept that the child's parents name (so a child may come twice)."""
    keys = concepts.select("code", F.explode("hierarchy_key").alias("key"))
    named = _parents(concepts).select(F.col("code").alias("candidate"), F.col("parent").alias("key"))
    return keys.join(named, "key").filter("code <> candidate").select("code", "candidate")


def hierarchy_edges(concepts: DataFrame, direction: str, hops: int = 1, titles: DataFrame | None = None, above: DataFrame | None = None) -> DataFrame:
    """code, candidate by direction: ``parent`` (up to ``hops`` links above) or ``children``; another one is an error."""
    if direction == "parent":
        return ancestors(concepts, hops, titles, above).select("code", "candidate")
    if direction == "children":
        return children(concepts).distinct()
    raise ValueError(f"direction must be parent or children, not {direction!r}")


def _similarity(x: str, y: str):
    total = F.length(x) + F.length(y)
    return F.when(total == 0, 1.0).otherwise(2.0 * lcs_length(F.col(x), F.col(y)) / F.greatest(total, F.lit(1)))


#: Terms of a block that one task scores against each other, at most about so many on either side.
QUERIES_AT_ONCE, CONCEPTS_AT_ONCE = 512, 8192
MOST_TASKS = 1000


class Terms:
    """Terms as columns of characters, shortest first, so that one term meets all of them at a time."""

    def __init__(self, terms: list[str]):
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.ids = {c: i + 1 for i, c in enumerate(sorted(set("".join(terms))))}
        self.columns = np.zeros((int(self.sizes[-1]) if len(terms) else 0, len(terms)), dtype=np.int64)
        for k, i in enumerate(self.order):
            self.columns[: sizes[i], k] = [self.ids[c] for c in terms[i]]
        self.starts = np.searchsorted(self.sizes, np.arange(len(self.columns)), side="right")

    def lcs(self, a: str) -> np.ndarray:
        """``text.lcs`` of ``a`` and each term, in words of 64 bits with a carry between them."""
        width = -(-len(a) // 64)
        where = np.zeros((width, len(self.ids) + 1), dtype=np.uint64)
        for i, c in enumerate(a):
            if c in self.ids:
                where[i // 64, self.ids[c]] |= np.uint64(1 << i % 64)
        row = np.full((width, len(self.sizes)), ~np.uint64(0))
        for column, start in zip(self.columns, self.starts):
            at, carry = column[start:], None
            for w in range(width):
                old = row[w, start:]
                hit = old & where[w][at]
                new = old + hit
                over = new < hit
                if carry is not None:
                    new += carry
                    over |= new < carry
                carry = over.astype(np.uint64) if w + 1 < width else None
                row[w, start:] = new | (old & ~hit)
        out = np.empty(len(self.sizes), dtype=np.int64)
        out[self.order] = sum((np.bitwise_count(~row[w] & np.uint64((1 << min(64, len(a) - 64 * w)) - 1)).astype(np.int64) for w in range(width)), np.zeros(len(self.sizes), dtype=np.int64))
        return out


def most_like(codes: list[str], terms: list[str], candidates: list[str], others: list[str], pool: int) -> Iterator[tuple[str, str, float]]:
    """code, candidate, similarity of the ``pool`` candidates most like each code's term, by candidate among equals."""
    table, names = Terms(others), np.array(candidates, dtype=object)
    lengths = np.array([len(t) for t in others], dtype=np.int64)
    place = np.empty(len(names), dtype=np.int64)
    place[np.argsort(names, kind="stable")] = np.arange(len(names))
    for code, term in zip(codes, terms):
        total = lengths + len(term)
        like = np.where(total == 0, 1.0, 2.0 * table.lcs(term) / np.maximum(total, 1))
        at = np.flatnonzero((like > 0) & (names != code))
        if len(at) > pool:
            at = at[like[at] >= np.partition(like[at], -pool)[-pool]]
        for i in at[np.lexsort((place[at], -like[at]))][:pool]:
            yield code, names[i], float(like[i])


def _coarse(queries: DataFrame, concepts: DataFrame, pool: int, block: list[str]) -> DataFrame:
    """block, code, candidate: the pool of each query.  Chunks of queries meet chunks of concepts, every one of the block's."""
    term = lambda df, name: df.filter("preferred_term is not null").select(*block, F.col("code").alias(name), F.col("preferred_term").alias("term"))
    q, c = term(queries, "code"), term(concepts, "candidate")

    def chunks(df: DataFrame, most: int) -> tuple[int, int]:
        found = df.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("blocks")).first()
        return max(1, -(-(found["n"] or 0) // most)), found["blocks"]

    (n_q, blocks), (n_c, _) = chunks(q, QUERIES_AT_ONCE), chunks(c, CONCEPTS_AT_ONCE)
    part = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    held = lambda df, name, at, n: df.groupBy(*block, part(name, n).alias(at)).agg(F.collect_list(F.struct(name, "term")).alias(f"{name}s"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = held(q, "code", "of_q", n_q).withColumn("of_c", every(n_c))
    met = held(c, "candidate", "of_c", n_c).withColumn("of_q", every(n_q))
    cells = asked.join(met, [*block, "of_q", "of_c"]).repartition(max(1, min(MOST_TASKS, blocks * n_q * n_c)))
    named = cells.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(block)], F.col("codes.code").alias("codes"), F.col("codes.term").alias("terms"), F.col("candidates.candidate").alias("candidates"), F.col("candidates.term").alias("others"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                head = [getattr(row, f"k{i}") for i in range(len(block))]
                out = [(*head, *x) for x in most_like(list(row.codes), list(row.terms), list(row.candidates), list(row.others), pool)]
                yield pd.DataFrame(out, columns=[*block, "code", "candidate", "like"])

    kinds = {f.name: f.dataType.simpleString() for f in q.schema.fields}
    near = named.mapInPandas(score, ", ".join([*(f"`{k}` {kinds[k]}" for k in block), "code string, candidate string, like double"]))
    most = Window.partitionBy(*block, "code").orderBy(F.desc("like"), "candidate")
    return near.withColumn("k", F.row_number().over(most)).filter(F.col("k") <= pool).select(*block, "code", "candidate")


def lexical_neighbours(queries: DataFrame, concepts: DataFrame, top_k: int = 10, pool: int | None = None, block: list[str] | None = None) -> DataFrame:
    """code, candidate, similarity, rank of the ``top_k`` concepts most like each query.

    The preferred terms most like the query's (``pool`` of them, 50 or five times ``top_k`` at least) are ranked again
    by the mean similarity of all forms of both.  Similarity is 2 LCS / sum of lengths.  The pool is taken out of all
    concepts, by code among equals; terms without a common letter are no neighbours.  With ``block`` columns only
    concepts of equal values meet.
    """
    pool = pool or max(5 * top_k, 50)
    block = block or []
    coarse = _coarse(queries, concepts, pool, block)
    forms = lambda df, name, f: df.select(F.col("code").alias(name), F.explode(F.array_compact(F.concat(F.array("preferred_term"), F.coalesce("synonyms", F.array().cast("array<string>"))))).alias(f))
    pairs = coarse.join(forms(queries, "code", "x"), "code").join(forms(concepts, "candidate", "y"), "candidate")
    scored = pairs.withColumn("s", _similarity("x", "y")).groupBy(*block, "code", "candidate").agg(F.avg("s").alias("similarity"))
    best = Window.partitionBy(*block, "code").orderBy(F.desc("similarity"), "candidate")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)
