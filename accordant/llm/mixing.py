"""A mix of texts whose sources have target shares of the tokens.

A text that several sources hold (copies under different names) is one text with a membership pattern.  The tokens of
the texts of each pattern are counted; a flow network routes them:

    start -> pattern   one arc per use of its texts: capacity the pattern's tokens, cost 0, 1, 2, ... (convex, so a
                       second use is only made where a first one is not enough), as many arcs as its texts may be used
    pattern -> source  for each source that holds it
    source -> end      the source's quota

The total is the largest at which every source that has texts meets its quota, unless one is given.  It is found from
least cuts: the sources that a total starves have so many tokens between them, which bounds the total, and the next try
is at that bound.

Of a pattern, texts are taken in the order of a seeded hash: use k of a pattern covers the first F_k of its tokens, cut
into one stretch per source.  A text that lies within a stretch is used for it.  What the text across a stretch's end
leaves open is filled from the texts not used so far in this use, the largest that fit first, with one that is a little
too long at the end if that comes nearer; so where short texts are left a stretch misses its length by next to none.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.bpe import count_tokens
from accordant.llm.flow import Network
from accordant.storage import written

#: The graph is solved on the driver: at most so many sources and membership patterns.  Of more patterns the ones with the
#: most tokens keep theirs; texts of the others count for one of their sources, by hash, under the same cap.
MOST_SOURCES = 2_000
MOST_PATTERNS = 20_000
#: Texts of each size class, the first in hash order, that a gap may be filled from.
FILLERS = 64
#: Slices of the hash order whose token sums are prefix-summed apart from the texts within them.
SLICES = 4096


def source_key(c: Column) -> Column:
    """A source's name without case, outer white space and the choice of blank, hyphen or underscore; blank is null."""
    key = F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\p{Z}_-]+", "_")
    return F.when(key != "", key)


def members(pattern: tuple[str, ...]) -> list[str]:
    """The sources of a pattern; a last entry with the cap of texts that count for one source is none."""
    return [s for s in pattern if not s.startswith("\x00")]


def solve(patterns: dict[tuple[str, ...], int], weights: dict[str, float], uses: dict[tuple[str, ...], int], total: int | None) -> tuple[int, list[tuple[tuple[str, ...], int, dict[str, int]]]]:
    """The total and, for each pattern and use (from 1), the tokens that go to each source."""

    def build(amount: int) -> tuple[Network, int, int, list, int]:
        net = Network()
        start, end = net.node(), net.node()
        quota = {s: floor(amount * w) for s, w in weights.items()}
        sources = {s: net.node() for s in weights}
        for s, node in sources.items():
            net.arc(node, end, quota[s])
        arcs = []
        for p, tokens in patterns.items():
            node = net.node()
            layers = [net.arc(start, node, tokens, k) for k in range(uses[p])]
            arcs.append((p, layers, {s: net.arc(node, sources[s], tokens * uses[p]) for s in members(p)}))
        return net, start, end, arcs, sources, sum(quota.values())

    if total is None:
        total = _largest(build, patterns, weights, uses)
    net, start, end, arcs, *_ = build(total)
    net.run(start, end)
    out = []
    for p, layers, to in arcs:
        rest = {s: net.flow(a) for s, a in to.items()}
        for k, layer in enumerate(layers, 1):
            room, cut = net.flow(layer), {}
            for s in sorted(rest):
                take = min(room, rest[s])
                if take:
                    cut[s], rest[s], room = take, rest[s] - take, room - take
            if cut:
                out.append((p, k, cut))
    return total, out


def _largest(build: Callable, patterns: dict[tuple[str, ...], int], weights: dict[str, float], uses: dict[tuple[str, ...], int]) -> int:
    """The largest total whose quotas, rounded down, can all be met."""

    def starved(amount: int) -> set[str]:
        net, start, end, _, sources, want = build(amount)
        if net.run(start, end)[0] == want:
            return set()
        fed = net.reached(start)
        return {s for s, node in sources.items() if node not in fed}

    room = lambda some: sum(t * uses[p] for p, t in patterns.items() if some & set(p))
    total = floor(room(set(weights)) / (sum(weights.values()) or 1.0))
    while some := starved(total):
        total = min(total - 1, floor(room(some) / sum(weights[s] for s in some)))
    # rounding down leaves less than one token a source
    low, high = total, total + ceil(len(weights) / min((w for w in weights.values() if w > 0), default=1.0))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (low, middle - 1) if starved(middle) else (middle, high)
    return low


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """Texts that fill the gap of one stretch: at most ``FILLERS`` of each power of two are there to choose from."""
    pdf = pdf.sort_values(["n_tokens", "digest"], ascending=[False, True])
    left, taken = int(pdf["gap"].iloc[0]), []
    for i, n in enumerate(pdf["n_tokens"]):
        if n <= left:
            left -= n
            taken.append(i)
    rest = pdf.drop(pdf.index[taken])
    if left and len(rest):
        off = (rest["n_tokens"] - left).abs()
        if off.min() < left:
            return pd.concat([pdf.iloc[taken], rest.loc[[off.idxmin()]]])[["p", "k", "part", "digest"]]
    return pdf.iloc[taken][["p", "k", "part", "digest"]]


class Mix:
    """``docs`` has doc_id, text and source; ``targets`` has source, weight and max_repeats.

    Null and empty texts (no tokens) and texts none of whose sources has a positive weight are not used.  A text is
    used at most as often as the strictest of its sources with a positive weight allows.  Copies are one text, whose
    smallest doc_id of each source stands for it there.  Source names are compared by ``source_key``; of equal ones in
    ``targets`` the first by name counts.  With no texts or no targets the result is empty.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, vocabulary: str, total: int | None = None, seed: int = 0):
        self.spark, self.seed = docs.sparkSession, seed
        rows = targets.select("source", source_key(F.col("source")).alias("key"), F.col("weight").cast("double"), F.col("max_repeats").cast("int")).limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        self.targets = {}
        for r in sorted((r for r in rows if r["key"] is not None), key=lambda r: r["source"]):
            self.targets.setdefault(r["key"], (r["source"], max(r["weight"] or 0.0, 0.0), max(r["max_repeats"] if r["max_repeats"] is not None else 1, 0)))
        wanted = [k for k, (_, w, m) in self.targets.items() if w > 0 and m > 0]
        held = docs.select("doc_id", source_key(F.col("source")).alias("key"), "text").filter(F.col("key").isin(wanted) & (F.length("text") > 0)) if wanted else docs.select("doc_id", F.lit("").alias("key"), "text").filter("false")
        # texts travel once, to be counted where they are read; only digests are shuffled
        counted = count_tokens(held.withColumn("digest", F.sha2(F.encode("text", "utf-8"), 256)), ["doc_id", "key", "digest"], vocabulary)
        owned = counted.groupBy("digest", "key").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
        self.texts = written(
            owned.groupBy("digest").agg(
                F.sort_array(F.collect_list("key")).alias("pattern"),  # at most the sources
                F.map_from_entries(F.collect_list(F.struct("key", "doc_id"))).alias("doc_of"),
                F.max("n_tokens").alias("n_tokens"),
                F.min("doc_id").alias("first_doc"),
            ),
            "texts",
        )
        self.texts = self.texts.withColumn("held", F.col("pattern"))
        sums = self.texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).orderBy(F.desc("n"), "pattern").limit(MOST_PATTERNS + 1).collect()
        if len(sums) > MOST_PATTERNS:
            kept = self.spark.createDataFrame([(r["pattern"], True) for r in sums[:MOST_PATTERNS]], "pattern array<string>, kept boolean")
            caps = F.create_map(*[F.lit(x) for k, (_, _, m) in self.targets.items() for x in (k, m)])
            strictest = F.array_min(F.transform("pattern", lambda k: caps[k]))
            one = F.array(F.get("pattern", F.pmod(F.xxhash64("digest"), F.size("pattern")).cast("int")), F.concat(F.lit("\x00"), strictest.cast("string")))
            self.texts = written(self.texts.join(F.broadcast(kept), "pattern", "left").withColumn("pattern", F.when(F.col("kept"), F.col("pattern")).otherwise(one)).drop("kept"), "texts")
            sums = self.texts.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).collect()  # the kept ones, and sources times caps
        self.patterns = {tuple(r["pattern"]): r["n"] for r in sorted(sums, key=lambda r: r["pattern"])}
        present = {s for p in self.patterns for s in members(p)}
        mass = sum(self.targets[s][1] for s in present) or 1.0
        weights = {s: self.targets[s][1] / mass for s in sorted(present)}
        uses = {p: int(p[-1][1:]) if p[-1].startswith("\x00") else min(self.targets[s][2] for s in p) for p in self.patterns}
        self.weights = weights
        self.total, self.plan = solve(self.patterns, weights, uses, total)

    def _placed(self) -> DataFrame:
        """The texts with the number ``p`` of their pattern and the place ``at`` of their first token in its hash order."""
        names = self.spark.createDataFrame([(list(p), i) for i, p in enumerate(self.patterns)], "pattern array<string>, p int")
        order = F.xxhash64("digest", F.lit(self.seed))
        texts = self.texts.join(F.broadcast(names), "pattern").withColumn("order", order).withColumn("slice", F.shiftrightunsigned("order", 52).cast("int"))  # at most MOST_PATTERNS rows and a few
        per = texts.groupBy("p", "slice").agg(F.sum("n_tokens").alias("n"))  # at most patterns times SLICES rows
        before = Window.partitionBy("p").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        base = per.select("p", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("p", "slice").orderBy("order", "digest").rowsBetween(Window.unboundedPreceding, -1)
        placed = texts.join(base, ["p", "slice"]).withColumn("at", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        return placed.select("p", "at", "order", "digest", "n_tokens", "doc_of")

    def selection(self) -> DataFrame:
        """doc_id, source, n_tokens, uses: how often each text is used for each source."""
        number = {p: i for i, p in enumerate(self.patterns)}
        rows = []
        for p, k, cut in self.plan:
            ends, at = [], 0
            for s, tokens in cut.items():
                ends.append((s, at, at + tokens))
                at += tokens
            cuts = [(lo, hi) for _, lo, hi in ends]
            rows += [(number[p], k, i, len(ends), s, lo, hi, cuts) for i, (s, lo, hi) in enumerate(ends)]
        schema = "p int, k int, part int, parts int, key string, lo long, hi long, cuts array<struct<lo:long,hi:long>>"
        stretches = self.spark.createDataFrame(rows, schema)  # as many as the plan has: patterns times uses times sources
        placed = written(self._placed(), "placed")
        small = len(rows) <= MOST_PATTERNS
        met = placed.join(F.broadcast(stretches) if small else stretches, "p")
        end = F.col("at") + F.col("n_tokens")
        inside = met.filter((F.col("at") >= F.col("lo")) & (end <= F.col("hi")))
        got = inside.groupBy("p", "k", "part").agg(F.sum("n_tokens").alias("got"))
        gaps = written(stretches.join(got, ["p", "k", "part"], "left").select("p", "k", "part", (F.col("hi") - F.col("lo") - F.coalesce("got", F.lit(0))).alias("gap")).filter("gap > 0"), "gaps")
        # a text that no stretch of its use holds whole may fill the gap of one of them
        free = met.filter(~F.exists("cuts", lambda c: (F.col("at") >= c["lo"]) & (end <= c["hi"])) & (F.pmod(F.xxhash64("digest", "k"), "parts") == F.col("part")))
        fits = free.join(F.broadcast(gaps) if small else gaps, ["p", "k", "part"]).filter(F.col("n_tokens") < 2 * F.col("gap"))
        size = F.floor(F.log2(F.col("n_tokens"))).cast("int")
        few = Window.partitionBy("p", "k", "part", "size").orderBy("order", "digest")
        fits = fits.withColumn("size", size).withColumn("n", F.row_number().over(few)).filter(F.col("n") <= FILLERS)
        chosen = fits.select("p", "k", "part", "gap", "n_tokens", "digest").groupBy("p", "k", "part").applyInPandas(_fill, "p int, k int, part int, digest string")
        fill = met.join(chosen, ["p", "k", "part", "digest"], "left_semi")
        used = inside.select("key", "n_tokens", "doc_of").unionByName(fill.select("key", "n_tokens", "doc_of"))
        return used.groupBy(F.col("doc_of")[F.col("key")].alias("doc_id"), "key", "n_tokens").agg(F.count(F.lit(1)).alias("uses")).select("doc_id", F.col("key").alias("source"), "n_tokens", "uses")

    def report(self) -> DataFrame:
        """source, weight, target_share, share, n_texts, n_uses, n_tokens of each target, those without texts included.

        ``target_share`` is the weight over the weights of the sources that have texts, which is what the mix aims at;
        it is 0 for the others.
        """
        got = self.selection().groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("uses").alias("n_uses"), F.sum(F.col("uses") * F.col("n_tokens")).alias("n_tokens"))
        rows = [(k, name, w, self.weights.get(k, 0.0), m) for k, (name, w, m) in self.targets.items()]
        all_sources = self.spark.createDataFrame(rows, "key string, source string, weight double, target_share double, max_repeats int")
        all_tokens = F.sum("n_tokens").over(Window.partitionBy())  # a row per target
        return (
            all_sources.join(got.withColumnRenamed("source", "key"), "key", "left")
            .select("source", "weight", "max_repeats", "target_share", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_texts", "n_uses", "n_tokens")])
            .withColumn("share", F.when(all_tokens > 0, F.col("n_tokens") / all_tokens).otherwise(0.0))
        )
