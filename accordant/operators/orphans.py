"""References to records that are not there, found by binary search in sorted arrays of keys per range.

Keys are hashed to 64 bits and the hash space is cut into equal ranges (the hash is uniform, so equal ranges hold
equal numbers of distinct keys).  The keys of a range form one sorted array; batches of references probe it with
``numpy.searchsorted``.  A range whose references are many (one key may draw a third of them) is split: its references
are dealt over several groups and its array of keys goes to each.  A second hash of the key tells apart keys whose
first hashes are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOREVER = np.iinfo(np.int64).max
BEFORE = np.iinfo(np.int64).min
KEYS_PER_RANGE = 250_000
REFS_PER_GROUP = 500_000


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's zone makes of one without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)


def _hashes(domain: Column, key: Column) -> list[Column]:
    return [F.xxhash64(domain, key).alias("h"), F.xxhash64(key, domain, F.lit(7)).alias("g")]


def key_rows(domain: Column, key: Column, start: Column, end: Column | None = None) -> list[Column]:
    """Columns of a key table.  A null start means always there before ``end``, a null end means never retired."""
    until = F.lit(FOREVER) if end is None else F.coalesce(micros(end), F.lit(FOREVER))
    return [*_hashes(domain, key), F.coalesce(micros(start), F.lit(BEFORE)).alias("start"), until.alias("until"), key.isNotNull().alias("use")]


def reference_rows(domain: Column, key: Column, at: Column) -> list[Column]:
    """Columns of a reference table: a null key is found nowhere, a null instant is before every start but null."""
    return [*_hashes(domain, key), F.coalesce(micros(at), F.lit(BEFORE)).alias("t"), key.isNotNull().alias("use")]


def probe(keys: dict[str, np.ndarray], refs: dict[str, np.ndarray]) -> np.ndarray:
    """The fate of each reference: 0 there, 1 missing, 2 late, 3 deleted."""
    n = len(refs["h"])
    fate = np.ones(n, np.int8)
    if not len(keys["h"]) or not n:
        return fate
    order = np.lexsort((keys["start"], keys["g"], keys["h"]))
    h, g, start, until = (keys[c][order] for c in ("h", "g", "start", "until"))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    rank, first = np.cumsum(new) - 1, np.flatnonzero(new)
    kh, kg = h[first], g[first]
    at = np.searchsorted(kh, refs["h"])  # the first key with this hash
    top = len(kh) - 1
    found = np.zeros(n, bool)
    place = np.minimum(at, top)
    for _ in range(len(kh)):  # more than once only where 64-bit hashes of different keys are equal
        same = kh[place] == refs["h"]
        hit = same & (kg[place] == refs["g"])
        found |= hit
        go = same & ~found & (place < top)
        if not go.any():
            break
        place = np.where(go, place + 1, place)
    found &= refs["use"]
    # the latest end among the intervals of a key that begin no later: a running maximum that starts anew at each key
    ends, end_rank = np.unique(until, return_inverse=True)
    running = np.maximum.accumulate(rank * len(ends) + end_rank) - rank * len(ends)
    times = np.unique(start)
    probe_time = np.searchsorted(times, refs["t"], side="right")  # starts that are not later
    combined = rank * (len(times) + 1) + np.searchsorted(times, start) + 1
    last = np.searchsorted(combined, place * (len(times) + 1) + probe_time, side="right") - 1
    begun = found & (last >= 0) & (rank[np.maximum(last, 0)] == place)
    fate[found & ~begun] = 2
    fate[begun] = np.where(ends[running[last[begun]]] > refs["t"][begun], 0, 3)
    return fate


_FATES = np.array(["there", "missing", "late", "deleted"], object)


def _arrays(table: pa.Table, names: list[str]) -> dict[str, np.ndarray]:
    return {n: table.column(n).to_numpy(zero_copy_only=False) for n in names}


def find_orphans(keys: DataFrame, refs: DataFrame, payload: list[str]) -> DataFrame:
    """``payload`` columns and ``fate`` (missing, late or deleted) of each reference without a record at its instant.

    ``keys`` has the columns of ``key_rows``, ``refs`` those of ``reference_rows`` and ``payload``.  A key is there
    from ``start`` until just before ``until``.  Repeated references come out each; repeated keys count once; with no
    keys every reference is missing, with no references nothing comes out.
    """
    spark = keys.sparkSession
    keys = keys.filter("use").select("h", "g", "start", "until")
    counts = keys.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    floor = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = max(floor, -(-counts // KEYS_PER_RANGE))
    # the top 31 bits of the hash, scaled: equal ranges of the hash space
    range_of = F.shiftright(F.shiftrightunsigned("h", 33) * F.lit(ranges), 31).cast("int")
    keys, refs = keys.withColumn("r", range_of), refs.withColumn("r", range_of)
    crowded = {x["r"]: -(-x["n"] // REFS_PER_GROUP) for x in refs.groupBy("r").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > REFS_PER_GROUP).collect()}
    if crowded:
        pieces = F.coalesce(F.create_map(*[F.lit(x) for kv in crowded.items() for x in kv])[F.col("r")], F.lit(1))
    else:
        pieces = F.lit(1)
    # dealt by a hash of the row, so that a task that runs again deals alike
    refs = refs.withColumn("s", F.pmod(F.xxhash64(F.lit(17), *payload), pieces).cast("int"))
    keys = keys.withColumn("s", F.explode(F.sequence(F.lit(0), (pieces - 1).cast("int"))))
    kinds = {f.name: f.dataType.simpleString() for f in refs.schema.fields}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        fate = probe(_arrays(left, ["h", "g", "start", "until"]), _arrays(right, ["h", "g", "t", "use"]))
        lost = np.flatnonzero(fate)
        out = right.select(payload).take(pa.array(lost))
        return out.append_column("fate", pa.array(_FATES[fate[lost]], pa.string()))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in payload), "fate string"])
    return keys.groupBy("r", "s").cogroup(refs.groupBy("r", "s")).applyInArrow(run, schema)


def by_period(orphans: DataFrame, table: str = "tbl", period: str = "loaded_month") -> DataFrame:
    """Orphans per table, period and fate."""
    return orphans.groupBy(table, period, "fate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ref").alias("n_keys"))


