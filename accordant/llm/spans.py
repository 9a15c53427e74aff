"""Long exact spans that texts share, found through a log-structured index of window hashes.

Every text is winnowed: of each 100 consecutive hashes of 101 characters the smallest is kept, so any run of 200 equal
characters in two texts leaves a common hash, and about one character in fifty is kept.  The hashes of a batch of
texts become an immutable run: a table bucketed by hash and sorted within buckets.  A new batch is joined with itself
and, by sort-merge joins that need no shuffle of the history, with each earlier run; every hit is verified on the
characters around it; then runs of the same level are compacted into one of the next, so n batches leave O(log n)
runs.

Skew: texts that are copies are one class and indexed once.  A hash that more than ``HOT`` classes share (a set phrase
shorter than 200 characters may well be in a third of all texts) is not joined in pairs; there the 200-character
windows around it are hashed and grouped, which only brings together texts that do share a span.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.llm.windows import code_points, mix, window_hashes, winnow
from accordant.storage import _remove, new_path, written

SPAN = 200
GRAM = 101
WINDOW = SPAN - GRAM + 1
HOT = 200
FANOUT = 2
BLOCK_CHARS = 1_000_000
RUN = "h long, chain long, doc_id long, pos int"


def _prints(docs: list[int], texts: list[str]) -> dict[str, np.ndarray]:
    points = [code_points(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in points])])
    text, pos, h = winnow(np.concatenate(points), starts, GRAM, WINDOW)
    doc = np.array(docs, np.int64)[text]
    # the pick before, if it is in the same text: two texts with the same pick before at the same distance already
    # agree from there to here, so a pair is only tried at the first pick of each stretch that it shares
    chain = mix((doc.astype(np.uint64) << np.uint64(20)) ^ pos.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    if len(h) > 1:
        follows = text[1:] == text[:-1]
        gap = (pos[1:] - pos[:-1]).astype(np.uint64)
        chain[1:] = np.where(follows, mix(h[:-1] + gap * np.uint64(0x9E3779B97F4A7C15)), chain[1:])
    return {"h": h.view(np.int64), "chain": chain.view(np.int64), "doc_id": doc, "pos": pos.astype(np.int32)}


def fingerprints(docs: DataFrame) -> DataFrame:
    """h, chain, doc_id and pos of the picks of each text of at least ``SPAN`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= BLOCK_CHARS:
                    yield pa.RecordBatch.from_pydict(_prints(ids, texts))
                    ids, texts, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_pydict(_prints(ids, texts))

    return docs.filter(F.length("text") >= SPAN).select("doc_id", "text").mapInArrow(run, RUN)


class Index:
    """Runs of fingerprints in a folder, oldest first; ``add`` takes the next batch, ``compact`` merges runs.

    A run is one parquet file for each bucket of hashes, sorted by hash, and is never changed.  ``manifest-N.json``
    names the runs that count, the one with the largest N is valid: whoever opens the folder later, in another session
    too, goes on from there, and a batch that died half-way left nothing that counts.  Without a folder the index is a
    temporary one.  Runs are read as bucketed, sorted tables, so a batch meets the history by merge joins that neither
    shuffle nor sort it.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, every: bool = False):
        self.spark, self.every = spark, every
        self.folder = folder or new_path(spark, "index")
        # a table with one file a bucket is read in its order
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.version, state = self._manifest()
        self.buckets = state["buckets"] if state else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = [(level, run) for level, run in state["runs"]] if state else []
        self.token = uuid.uuid4().hex[:12]
        for _, run in self.runs:
            spark.sql(f"CREATE TABLE {self._table(run)} (h BIGINT, chain BIGINT, doc_id BIGINT, pos INT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")

    def _path(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _manifest(self) -> tuple[int, dict | None]:
        files, at = self._path()
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        numbers = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not numbers:
            return 0, None
        text = self.spark.read.text(f"{self.folder}/manifest-{max(numbers):08d}.json", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def _commit(self) -> None:
        self.version += 1
        files, at = self._path(f"manifest-{self.version:08d}.json")
        out = files.create(at, False)  # of two writers one fails here
        out.write(bytearray(json.dumps({"buckets": self.buckets, "runs": self.runs}).encode()))
        out.close()

    def _table(self, run: str) -> str:
        return f"spans_{self.token}_{run.replace('-', '_')}"

    def _write(self, prints: DataFrame, level: int) -> tuple[int, str]:
        run = f"run-{uuid.uuid4().hex[:12]}"
        (
            prints.select("h", "chain", "doc_id", "pos")
            .repartition(self.buckets, "h")
            .sortWithinPartitions("h")
            .write.bucketBy(self.buckets, "h")
            .sortBy("h")
            .option("path", f"{self.folder}/{run}")
            .saveAsTable(self._table(run))
        )
        return level, run

    def _read(self, run: tuple[int, str]) -> DataFrame:
        return self.spark.table(self._table(run[1]))

    def _drop(self, run: tuple[int, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run[1])}")
        _remove(self.spark, f"{self.folder}/{run[1]}")

    def add(self, prints: DataFrame) -> DataFrame:
        """Indexes a batch; a, b, pos_a, pos_b of its hits within itself and in the history (not yet verified).

        Only hashes of the batch are counted and looked up in the history.  Hits on hashes with more than ``HOT``
        entries are left to ``entries``: these hashes are in ``hot_hashes``, null if there are none.
        """
        new = self._write(prints, 0)
        fresh, all_runs = self._read(new), [*self.runs, new]
        own = fresh.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        counts = [own] + [self._read(r).join(own.select("h").hint("merge"), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n")) for r in self.runs]
        hot = written(reduce(DataFrame.unionByName, counts).groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT).select("h"), "hot")
        self.hot_hashes = None if hot.isEmpty() else hot
        cold = (lambda df: df) if self.hot_hashes is None else (lambda df: df.join(hot, "h", "left_anti"))
        hits = [self._join(cold(fresh), cold(fresh), F.col("x.doc_id") < F.col("y.doc_id"))]
        hits += [self._join(cold(fresh), cold(self._read(r)), F.lit(True)) for r in self.runs]
        found = written(reduce(DataFrame.unionByName, hits), "hits")
        self.runs = all_runs
        self._commit()
        return found

    def _join(self, x: DataFrame, y: DataFrame, which: Column) -> DataFrame:
        if not self.every:
            which = which & (F.col("x.chain") != F.col("y.chain"))
        x, y = x.alias("x").hint("merge"), y.alias("y")
        both = x.join(y, (F.col("x.h") == F.col("y.h")) & which)
        return both.select(
            F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.pos").alias("pos_a"), F.col("y.pos").alias("pos_b")
        )

    def entries(self, hashes: DataFrame) -> DataFrame:
        """doc_id and pos of every entry, old or new, of the given hashes."""
        return reduce(DataFrame.unionByName, [self._read(r).join(hashes, "h", "left_semi") for r in self.runs]).select("doc_id", "pos")

    def links(self, batch: DataFrame, docs: DataFrame) -> DataFrame:
        """a < b of each pair of a text of ``batch`` and another, old or new, with a common span; indexes the batch.

        ``docs`` has doc_id and text of all texts, those of the batch included.  Doc_ids must be new to the index.
        """
        met = verify(self.add(fingerprints(batch)), docs).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if self.hot_hashes is not None:
            windows = written(hot_windows(self.entries(self.hot_hashes), docs), "windows")
            new = batch.select("doc_id")
            pairs = hot_pairs(windows, docs)
            met = met.unionByName(pairs.join(new.withColumnRenamed("doc_id", "a"), "a", "left_semi")).unionByName(pairs.join(new.withColumnRenamed("doc_id", "b"), "b", "left_semi").select("a", "b"))
        return met.distinct()

    def compact(self) -> None:
        """Merges runs as long as ``FANOUT`` of them share a level; files of merged runs go once the manifest is written."""
        level, old = 0, []
        while any(r[0] >= level for r in self.runs):
            same = [r for r in self.runs if r[0] == level]
            if len(same) >= FANOUT:
                # read as plain files: as bucketed tables they would be laid side by side, not merged
                plain = self.spark.read.schema(RUN).parquet(*[f"{self.folder}/{run}" for _, run in same])
                merged = self._write(plain, level + 1)
                self.runs = [r for r in self.runs if r[0] != level] + [merged]
                old += same
            level += 1
        if old:
            self._commit()
        for r in old:
            self._drop(r)

    def close(self, delete: bool = False) -> None:
        """Forgets the tables; with ``delete`` the files go as well."""
        for r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(r[1])}")
        self.runs = []
        if delete:
            _remove(self.spark, self.folder)


def _context(pos: str) -> list[Column]:
    """The characters around a hit that a span of ``SPAN`` can reach, and the place of the hit within them."""
    left = F.greatest(F.col(pos) - (SPAN - GRAM), F.lit(0))
    return [F.col("text").substr(left + 1, F.col(pos) - left + F.lit(SPAN)), F.col(pos) - left]


_RUN = T.StructType([T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType())])


@F.pandas_udf(_RUN)
def _extent(text_a: pd.Series, at_a: pd.Series, text_b: pd.Series, at_b: pd.Series) -> pd.DataFrame:
    """How many characters before and from the hit on are equal."""
    out = []
    for a, i, b, j in zip(text_a, at_a, text_b, at_b):
        n, m = 0, min(i, j)
        while n < m and a[i - 1 - n] == b[j - 1 - n]:
            n += 1
        x, y = a[i:], b[j:]
        if x[: len(y)] == y[: len(x)]:
            r = min(len(x), len(y))
        else:
            r = next(k for k, (c, d) in enumerate(zip(x, y)) if c != d)
        out.append((n, r))
    return pd.DataFrame(out, columns=["before", "after"])


_extent = _extent.asNondeterministic()  # a filter on the extent must not compare twice


def verify(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b, start_a, start_b, length of the hits with at least ``SPAN`` equal characters around them.

    A run may be longer than the stretch looked at: ``length`` is at most ``2 * SPAN - 2``.
    """
    text = docs.select("doc_id", "text")
    one = hits.join(text.withColumnRenamed("doc_id", "a"), "a").select("a", "b", "pos_a", "pos_b", _context("pos_a")[0].alias("ta"), _context("pos_a")[1].alias("ia"))
    two = one.join(text.withColumnRenamed("doc_id", "b"), "b").select("a", "b", "pos_a", "pos_b", "ta", "ia", _context("pos_b")[0].alias("tb"), _context("pos_b")[1].alias("ib"))
    seen = two.withColumn("run", _extent("ta", "ia", "tb", "ib"))
    return seen.filter((F.col("run.before") + F.col("run.after") >= SPAN) & (F.col("run.after") >= GRAM)).select(
        "a", "b",
        (F.col("pos_a") - F.col("run.before")).alias("start_a"),
        (F.col("pos_b") - F.col("run.before")).alias("start_b"),
        (F.col("run.before") + F.col("run.after")).alias("length"),
    )


def hot_windows(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """w, v (two hashes of a window of ``SPAN`` characters), doc_id, start and the character before it, around entries."""
    asked = entries.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                points = code_points(text)
                wanted = np.unique(np.concatenate([np.arange(max(0, p - WINDOW + 1), p + 1) for p in at]))
                wanted = wanted[wanted <= len(points) - SPAN]
                w, v = window_hashes(points, SPAN)[wanted], window_hashes(points, SPAN, 1)[wanted]
                before = np.where(wanted > 0, points[wanted - 1].astype(np.int64), -1)
                yield pa.RecordBatch.from_pydict(
                    {"w": w.view(np.int64), "v": v.view(np.int64), "doc_id": np.full(len(w), doc), "start": wanted.astype(np.int32), "before": before}
                )

    return docs.join(asked, "doc_id").select("doc_id", "text", "at").mapInArrow(run, "w long, v long, doc_id long, start int, before long")


def hot_pairs(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """a < b of each pair with a common window, met at the first window of a common stretch only and compared by character."""
    first = windows.groupBy("w", "v").agg(F.min("before").alias("low"), F.max("before").alias("high"), F.min("doc_id").alias("d"), F.max("doc_id").alias("e"))
    first = first.filter((F.col("d") != F.col("e")) & ((F.col("low") != F.col("high")) | (F.col("low") == -1))).select("w", "v")
    some = windows.join(first, ["w", "v"], "left_semi")
    x, y = some.alias("x"), some.alias("y")
    new = (F.col("x.before") != F.col("y.before")) | (F.col("x.before") == -1)
    both = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.doc_id") < F.col("y.doc_id")) & new)
    at = both.groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).agg(F.min(F.struct(F.col("x.start").alias("i"), F.col("y.start").alias("j"))).alias("at"))
    slice_ = lambda c: F.col("text").substr(F.col(c) + 1, F.lit(SPAN))
    text = docs.select("doc_id", "text")
    one = at.join(text.withColumnRenamed("doc_id", "a"), "a").select("a", "b", "at.j", slice_("at.i").alias("p"))
    return one.join(text.withColumnRenamed("doc_id", "b"), "b").filter(F.col("p") == slice_("j")).select("a", "b")


class SharedSpans:
    """Spans of ``SPAN`` characters or more that occur in several of the given documents.

    ``docs`` has doc_id (unique) and text; ``arrival`` orders the batches in which the index takes them.  Null and
    short texts share nothing.  Copies are found by digest and length and are one class, whose smallest doc_id
    represents it.  Other columns don't matter.
    """

    def __init__(self, docs: DataFrame, arrival: Column, batches: int = 3, every: bool = False):
        self.spark = docs.sparkSession
        long = docs.filter(F.length("text") >= SPAN)
        keyed = long.select("doc_id", F.length("text").alias("n_chars"), F.md5(F.encode("text", "utf-8")).alias("digest"), F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), arrival).alias("arrival"))
        classes = keyed.groupBy("digest", "n_chars").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        self.classes = written(keyed.join(classes, ["digest", "n_chars"]).drop("digest"), "classes")
        reps = self.classes.filter("doc_id = rep").select("doc_id", "arrival")
        cuts = reps.agg(F.percentile_approx("arrival", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
        number = reduce(lambda a, b: a + b, [(F.coalesce(F.col("arrival"), F.lit(0)) > c).cast("int") for c in cuts], F.lit(0))
        # one pass over the texts of all representatives; batches are read from it
        self.docs = long.join(reps, "doc_id", "left_semi").select("doc_id", "text")
        prints = fingerprints(long.select("doc_id", "text")).join(reps.select("doc_id", number.alias("batch")), "doc_id")
        self.prints = written(prints.select("h", "chain", "doc_id", "pos", "batch"), "fresh")
        self.index = Index(self.spark, every=every)
        hits, hot = [], []
        for i in range(batches):
            hits.append(self.index.add(self.prints.filter(F.col("batch") == i)))
            if self.index.hot_hashes is not None:
                hot.append(self.index.hot_hashes)
            if i < batches - 1:
                self.index.compact()
        self.hot = bool(hot)
        if hot:
            entries = self.index.entries(reduce(DataFrame.unionByName, hot).distinct())
            self.hot_windows = written(hot_windows(entries, self.docs), "windows")
        self.hits = reduce(DataFrame.unionByName, hits)
        self.index.close(delete=True)

    def spans(self) -> DataFrame:
        return verify(self.hits, self.docs)

    def class_links(self) -> DataFrame:
        """a < b of each pair of representatives with a common span."""
        met = self.spans().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if self.hot:
            met = met.unionByName(hot_pairs(self.hot_windows, self.docs))
        return met.distinct()

    def pairs(self) -> DataFrame:
        """doc_id_a < doc_id_b of each pair of documents with a common span, copies included."""
        links = self.class_links()
        members = self.classes.select("doc_id", "rep", "copies")
        shared = members.filter("copies > 1").select("doc_id", "rep")
        x, y = shared.alias("x"), shared.alias("y")
        within = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.doc_id") < F.col("y.doc_id"))).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
        left = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("da"))
        right = members.select(F.col("rep").alias("b"), F.col("doc_id").alias("db"))
        across = links.join(left, "a").join(right, "b").select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"))
        return within.unionByName(across).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))

    def coverage(self) -> DataFrame:
        """doc_id, n_chars, class_id, shared_chars, share: how much of each text is in spans that occur elsewhere.

        A text with copies is shared as a whole.  Needs an index built with ``every``, which meets every pick of a
        common stretch, so that the stretches looked at cover it.
        """
        found = self.spans()
        parts = found.select(F.col("a").alias("rep"), F.col("start_a").alias("lo"), (F.col("start_a") + F.col("length")).alias("hi")).unionByName(
            found.select(F.col("b").alias("rep"), F.col("start_b").alias("lo"), (F.col("start_b") + F.col("length")).alias("hi"))
        )
        if self.hot:
            common = self.hot_windows.groupBy("w", "v").agg(F.min("doc_id").alias("d"), F.max("doc_id").alias("e")).filter("d <> e").select("w", "v")
            own = self.hot_windows.join(common, ["w", "v"], "left_semi")
            parts = parts.unionByName(own.select(F.col("doc_id").alias("rep"), F.col("start").alias("lo"), (F.col("start") + SPAN).alias("hi")))
        covered = merged_length(parts.distinct(), "rep")
        whole = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long")
        return self.classes.join(covered, "rep", "left").select(
            "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("rep").alias("class_id"), whole.alias("shared_chars"), (whole / F.col("n_chars")).alias("share")
        )


def merged_length(parts: DataFrame, key: str) -> DataFrame:
    """key and ``covered``, the length of the union of its intervals [lo, hi)."""
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("hi").over(before), F.lit(0))
    gain = F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.col("reach")), F.lit(0))
    return parts.withColumn("reach", reach).groupBy(key).agg(F.sum(gain).alias("covered"))
