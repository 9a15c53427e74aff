"""Parent-child links of unknown depth: paths, depths, roots, descendants and cycles.

Links are merged in a disjoint-set forest whose offsets are heights: a parent is one step above its child, so every
node has a height over the root of its set.  A link within a set that agrees with the heights of its ends changes
nothing; one that doesn't is a ring of unequal sides, and every directed cycle has such a link, since its steps all go
up and yet come back.

* Over first parents only (one link a node), a set is a tree, whose root is its one node without a parent and whose
  depths are the differences of heights, or it holds a cycle.
* Over all links, cycles can only be in sets with a link that disagrees.  Their links are told apart by strongly
  connected components, set by set, since a disagreeing link may as well close a diamond.

A forest is built in three steps.  Each range of nodes merges its own links (``_merged``).  Only nodes that several
ranges met go on, each as a link to its local root.  What is left is merged at once if it is at most ``LINKS_AT_ONCE``
links, and else contracted by rounds: every node points to its smallest neighbour, pointers are followed by doubling,
and the stars become nodes.  So no task ever holds more than a range or ``LINKS_AT_ONCE`` links, whatever the shape.

Paths are built along the index of parents by doubling: in each round a node's known stretch gets that of the node it
ends at, so a path of n steps takes log2(n) rounds and no task holds more than single paths.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.storage import written

NODES_PER_RANGE = 50_000
#: Doublings of paths in one plan; each reads what came before twice.
DOUBLINGS = 2
#: Links that one task merges or searches.
LINKS_AT_ONCE = 300_000
SHIFT = 33  # bits of monotonically_increasing_id below the partition's number


def numbered(nodes: DataFrame, sort_key: list[Column], rows: int | None = None) -> tuple[DataFrame, int]:
    """``nodes`` with a number ``id`` whose high bits are its range in the order of ``sort_key``; the number of ranges."""
    rows = nodes.count() if rows is None else rows
    ranges = max(1, -(-rows // NODES_PER_RANGE))
    spread = nodes.repartitionByRange(ranges, *sort_key).withColumn("id", F.monotonically_increasing_id())
    return written(spread, "nodes"), ranges


# --- the weighted disjoint-set forest


class Sets:
    """Disjoint sets of 0 .. n - 1 with the height of each element over the root of its set."""

    def __init__(self, n: int):
        self.up, self.over, self.size = list(range(n)), [0] * n, [1] * n
        self.odd = [False] * n  # of a root: its set has a link that disagrees

    def find(self, x: int) -> tuple[int, int]:
        """The root of x and the height of x over it; the way there is shortened."""
        up, over = self.up, self.over
        way = []
        while up[x] != x:
            way.append(x)
            x = up[x]
        height = 0
        for y in reversed(way):
            height += over[y]
            up[y], over[y] = x, height
        return x, height

    def link(self, a: int, b: int, step: int) -> None:
        """b is ``step`` higher than a."""
        (x, h), (y, k) = self.find(a), self.find(b)
        if x == y:
            if k - h != step:
                self.odd[x] = True
            return
        # y is h + step - k higher than x
        gap = h + step - k
        if self.size[x] < self.size[y]:
            x, y, gap = y, x, -gap
        self.up[y], self.over[y] = x, gap
        self.size[x] += self.size[y]
        self.odd[x] = self.odd[x] or self.odd[y]


_SETS = "x long, root long, height long, odd boolean"


def _merged(table: pa.Table) -> pa.Table:
    """Each node of the links u -> p, its set's root, its height over the root and whether the set has an odd link."""
    u, p, step = (table.column(c).to_numpy() for c in ("u", "p", "step"))
    nodes, at = np.unique(np.concatenate([u, p]), return_inverse=True)
    sets = Sets(len(nodes))
    for a, b, w in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), step.tolist()):
        sets.link(a, b, w)
    found = [sets.find(i) for i in range(len(nodes))]
    root = np.fromiter((r for r, _ in found), np.int64, len(found))
    return pa.table({"x": nodes, "root": nodes[root], "height": np.fromiter((h for _, h in found), np.int64, len(found)), "odd": np.array(sets.odd, bool)[root]})


def _composed(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Sets whose roots ``upper`` merged further; a root that ``upper`` doesn't know stays."""
    above = upper.select(F.col("x").alias("root"), F.col("root").alias("top"), F.col("height").alias("more"), F.col("odd").alias("odd_above"))
    return lower.join(above, "root", "left").select(
        "x", F.coalesce("top", "root").alias("root"), (F.col("height") + F.coalesce("more", F.lit(0))).alias("height"), (F.col("odd") | F.coalesce("odd_above", F.lit(False))).alias("odd")
    )


def forest(links: DataFrame, ranges: int) -> DataFrame:
    """x, root, height, odd of every node of the links u -> p (p is a step higher); a node may come several times.

    All rows of a set have the same root; ``odd`` is true in at least one of its rows if some link of it disagrees with
    the heights, and the heights of such a set mean nothing.
    """
    own = links.select("u", "p", F.lit(1).cast("long").alias("step"), F.shiftright("u", SHIFT).alias("g"))
    local = written(own.groupBy("g").applyInArrow(lambda t: _merged(t), _SETS), "forest")
    if ranges <= 1:
        return local
    met = local.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("x")
    left = local.filter("x <> root").join(met, "x", "left_semi").select(F.col("root").alias("u"), F.col("x").alias("p"), F.col("height").alias("step"))
    return _composed(local, _contracted(written(left, "links")))


def _contracted(links: DataFrame, turn: int = 0) -> DataFrame:
    """The forest of links u -> p with any steps, at once or after a round of stars."""
    if links.count() <= LINKS_AT_ONCE:
        return written(links.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(lambda t: _merged(t), _SETS), "merged")
    both = links.filter("u <> p").select(F.col("u").alias("x"), F.col("p").alias("y"), (-F.col("step")).alias("w")).unionByName(
        links.filter("u <> p").select(F.col("p").alias("x"), F.col("u").alias("y"), F.col("step").alias("w"))
    )
    # numbers mixed anew each round: no order of theirs makes a round idle
    rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c), c)
    pick = both.filter(rank(F.col("y")) < rank(F.col("x"))).groupBy("x").agg(F.min_by(F.struct(F.col("y").alias("root"), F.col("w").alias("height")), rank(F.col("y"))).alias("s"))
    stars = written(pick.select("x", "s.root", "s.height"), "stars")
    while True:  # pointers by doubling
        far = stars.select(F.col("x").alias("root"), F.col("root").alias("top"), F.col("height").alias("more"))
        jumped = stars.join(far, "root", "left")
        moved = written(jumped.select("x", F.coalesce("top", "root").alias("root"), (F.col("height") + F.coalesce("more", F.lit(0))).alias("height"), F.col("top").isNotNull().alias("moved")), "stars")
        stars = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break

    def end(df: DataFrame, c: str) -> DataFrame:
        at = stars.select(F.col("x").alias(c), F.col("root").alias(f"{c}_root"), F.col("height").alias(f"{c}_height"))
        met = df.join(at, c, "left")
        return met.withColumn(f"{c}_root", F.coalesce(f"{c}_root", c)).withColumn(f"{c}_height", F.coalesce(f"{c}_height", F.lit(0)))

    turned = end(end(links, "u"), "p").select(F.col("u_root").alias("u"), F.col("p_root").alias("p"), (F.col("u_height") + F.col("step") - F.col("p_height")).alias("step"))
    turned = written(turned.distinct().filter("u <> p or step <> 0"), "links")
    above = _contracted(turned, turn + 1)
    every = stars.unionByName(stars.select(F.col("root").alias("x"), "root", F.lit(0).cast("long").alias("height")).distinct()).withColumn("odd", F.lit(False))
    alone = above.join(every.select("x"), "x", "left_anti")
    return _composed(every, above).unionByName(alone)


# --- strongly connected components


def _index(u: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node numbers, and the parents of each as places: an index into one array."""
    nodes = np.unique(np.concatenate([u, p]))
    a, b = np.searchsorted(nodes, u), np.searchsorted(nodes, p)
    order = np.argsort(a, kind="stable")
    return nodes, np.searchsorted(a[order], np.arange(len(nodes) + 1)), b[order]


def strong(first: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Strongly connected components, numbered so that parents' components come first (or are the same)."""
    n = len(first) - 1
    first, parents = first.tolist(), parents.tolist()
    seen, low, comp = [0] * n, [0] * n, [-1] * n
    clock = count = 0
    stack: list[int] = []
    for root in range(n):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        stack.append(root)
        work = [(root, first[root])]
        while work:
            v, i = work.pop()
            if i < first[v + 1]:
                work.append((v, i + 1))
                w = parents[i]
                if not seen[w]:
                    clock += 1
                    seen[w] = low[w] = clock
                    stack.append(w)
                    work.append((w, first[w]))
                elif comp[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == seen[v]:
                while True:
                    w = stack.pop()
                    comp[w] = count
                    if w == v:
                        break
                count += 1
    return np.array(comp, np.int64)


def _strong_labels(table: pa.Table) -> pa.Table:
    """The nodes on cycles of the links u -> p with the smallest node of their component."""
    u, p = table.column("u").to_numpy(), table.column("p").to_numpy()
    nodes, first, parents = _index(u, p)
    comp = strong(first, parents)
    size = np.bincount(comp)
    loops = np.zeros(len(size), bool)
    loops[comp[np.searchsorted(nodes, u[u == p])]] = True
    smallest = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(smallest, comp, nodes)
    on = (size[comp] > 1) | loops[comp]
    return pa.table({"u": nodes[on], "label": smallest[comp[on]]})


def _trimmed(links: DataFrame) -> DataFrame:
    """The links that are left when nodes without a way in or without a way out go, again and again."""
    n = links.count()
    while True:
        links = written(links.join(links.select(F.col("p").alias("u")).distinct(), "u", "left_semi").join(links.select(F.col("u").alias("p")).distinct(), "p", "left_semi"), "core")
        left = links.count()
        if left == n:
            return links
        n = left


def _strong_by_rounds(links: DataFrame) -> DataFrame:
    """u and label of the nodes on cycles, by rounds of joins: for one set of more links than a task may hold.

    Every node takes the largest number that reaches it; a node that keeps its own is a head, and what reaches a head
    among the nodes that took its number is the head's component.  It goes, and the rest begins again.
    """
    found = []
    links = _trimmed(links)
    while not links.isEmpty():
        colour = written(links.select("u").distinct().withColumn("c", F.col("u")), "colour")
        while True:
            # a node's colour goes up its links
            sent = links.join(colour, "u").groupBy(F.col("p").alias("u")).agg(F.max("c").alias("new"))
            step = written(colour.join(sent, "u", "left").select("u", F.greatest("c", F.coalesce("new", "c")).alias("c"), (F.coalesce("new", "c") > F.col("c")).alias("moved")), "colour")
            colour = step.drop("moved")
            if step.filter("moved").isEmpty():
                break
        same = links.join(colour, "u").join(colour.select(F.col("u").alias("p"), F.col("c").alias("cp")), "p").filter("c = cp").select("u", "p", "c")
        same = written(same, "same")
        inside = fresh = written(colour.filter("u = c"), "inside")
        while True:  # against the links, from the heads down
            fresh = written(same.join(fresh.select(F.col("u").alias("p")), "p").select("u", "c").distinct().join(inside, ["u", "c"], "left_anti"), "inside")
            if fresh.isEmpty():
                break
            inside = written(inside.unionByName(fresh), "inside")
        found.append(inside.select("u", F.col("c").alias("label")))
        links = _trimmed(written(links.join(inside.select("u"), "u", "left_anti").join(inside.select(F.col("u").alias("p")), "p", "left_anti"), "links"))
    every = reduce(DataFrame.unionByName, found) if found else links.select("u", F.col("p").alias("label"))
    first = every.groupBy("label").agg(F.min("u").alias("first"), F.count(F.lit(1)).alias("n"))
    return every.join(first, "label").select("u", F.col("first").alias("label"))


def cycles(edges: DataFrame, ranges: int) -> DataFrame:
    """``edges``: u, p.  Gives the nodes u that reach themselves, with a label that their component shares."""
    sets = forest(edges, ranges)
    odd = written(sets.filter("odd").select("root").distinct(), "odd")
    empty = edges.select("u", F.col("p").alias("label")).filter("false")
    if odd.isEmpty():
        return empty
    member = sets.join(odd, "root", "left_semi").groupBy("x").agg(F.first("root").alias("root"))
    links = written(edges.join(member.withColumnRenamed("x", "u"), "u").select("root", "u", "p"), "odd_links")
    sizes = links.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    large = [r["root"] for r in sizes.filter(F.col("n") > LINKS_AT_ONCE).collect()]  # at most all links over LINKS_AT_ONCE
    total = sizes.filter(F.col("n") <= LINKS_AT_ONCE).agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-2 * total // LINKS_AT_ONCE))
    small = links.filter(~F.col("root").isin(large)) if large else links
    packed = small.withColumn("g", F.pmod(F.xxhash64("root"), F.lit(bins)))
    parts = [written(packed.groupBy("g").applyInArrow(lambda t: _strong_labels(t), "u long, label long"), "cyclic")]
    parts += [_strong_by_rounds(links.filter(F.col("root") == root).select("u", "p")) for root in large]
    return reduce(DataFrame.unionByName, parts)


# --- records with lists of parent keys


class Hierarchy:
    """Nodes and links from records with a code, further keys and a list of parent keys.

    ``records`` has group (links stay within), code, key (normal form of the code; null rows are left out), keys (normal
    forms of all names), parents (normal forms, in order), version (the largest of a key counts, then the largest row).
    Blank or null parents, parents that no record has and repeated parents give no link.  A record that names itself
    is a cycle of one.  An empty table gives empty results.
    """

    def __init__(self, records: DataFrame):
        latest = (
            records.filter(F.col("key").isNotNull())
            .groupBy("group", "key")
            .agg(F.max_by(F.struct("code", "keys", "parents"), "version").alias("x"))
            .select("group", "key", "x.code", "x.keys", "x.parents")
        )
        first = F.coalesce(F.array_min("keys"), F.col("key"))
        self.nodes, self.ranges = numbered(latest, [F.col("group"), first, F.col("key")])
        names = self.nodes.select("group", "id", F.explode(F.array_distinct(F.concat(F.array("key"), F.coalesce("keys", F.array().cast("array<string>"))))).alias("name"))
        links = self.nodes.select("group", F.col("id").alias("u"), F.posexplode("parents").alias("place", "name")).filter("name is not null")
        self.edges = written(
            links.join(names.filter("name is not null").withColumnRenamed("id", "p"), ["group", "name"])
            .groupBy("u", "p")
            .agg(F.min("place").alias("place")),
            "edges",
        )

    def cycles(self) -> DataFrame:
        """group, cycle_code (the smallest code of the component), code of each node that reaches itself."""
        on = cycles(self.edges.select("u", "p"), self.ranges)
        named = on.join(self.nodes.select(F.col("id").alias("u"), "group", "code"), "u")
        smallest = named.groupBy("label").agg(F.min("code").alias("cycle_code"))
        return named.join(smallest, "label").select("group", "cycle_code", "code")

    def places(self) -> DataFrame:
        """u, p (the first parent, null for a root), depth and root (its number) of every node, over first parents.

        The depth is -1 and the root null for a node on or below a cycle.  A set of n nodes is a tree if it has n - 1
        links, i.e. one node without a parent, and else holds a cycle.
        """
        first = self.edges.filter("u <> p").groupBy("u").agg(F.min_by("p", F.struct("place", "p")).alias("p"))
        links = written(self.nodes.select(F.col("id").alias("u")).join(first, "u", "left"), "links")
        sets = forest(links.filter("p is not null"), self.ranges).groupBy("x").agg(F.first("root").alias("set"), F.first("height").alias("height"))
        placed = written(links.join(sets.withColumnRenamed("x", "u"), "u", "left").select("u", "p", F.coalesce("set", "u").alias("set"), F.coalesce("height", F.lit(0)).alias("height")), "placed")
        tops = placed.filter("p is null").select("set", F.col("u").alias("root"), F.col("height").alias("top"))
        depth = F.coalesce(F.col("top") - F.col("height"), F.lit(-1)).cast("int")
        return placed.join(tops, "set", "left").select("u", "p", depth.alias("depth"), "root")

    def _climbed(self, step: Column) -> DataFrame:
        """u, depth, root and seg: ``step`` of each node from the root down to u, null on or below a cycle."""
        named = self.nodes.select(F.col("id").alias("u"), F.array(step).alias("seg"))
        # the stretch of each node begins just below ``p``, the node that the next round goes on from
        known = written(self.places().join(named, "u"), "stretches")
        rounds = int(known.agg(F.max("depth")).first()[0] or 0).bit_length()
        for k in range(1, rounds + 1):
            over = known.filter("depth >= 0").select(F.col("u").alias("p"), F.col("p").alias("next"), F.col("seg").alias("above"))
            grown = known.join(over, "p", "left")
            more = F.col("above").isNotNull() & (F.col("depth") >= 0)
            known = grown.select("u", F.when(more, F.col("next")).otherwise(F.col("p")).alias("p"), "depth", "root", F.when(more, F.concat("above", "seg")).otherwise(F.col("seg")).alias("seg"))
            if k % DOUBLINGS == 0 and k < rounds:
                known = written(known, "stretches")
        return known.select("u", "depth", "root", F.when(F.col("depth") >= 0, F.col("seg")).alias("seg"))

    def paths(self) -> DataFrame:
        """group, code, path (codes from the root), depth (0 for a root), root; all null for a node on or below a cycle.

        The way up takes the first parent in the list that is a record other than the node itself.
        """
        up = self._climbed(F.col("code")).select("u", "depth", "seg")
        return self.nodes.select(F.col("id").alias("u"), "group", "code").join(up, "u").select(
            "group", "code", F.col("seg").alias("path"), F.when(F.col("depth") >= 0, F.col("depth")).alias("depth"), F.get("seg", 0).alias("root")
        )

    def descendants(self) -> DataFrame:
        """group, code, descendant: every pair of different nodes joined by a way up, over all parents.

        The paths over first parents give most pairs at once.  Other links (further parents, and all links of nodes on
        or below cycles) are jumps: climb a path, take one such link.  Pairs grow by one jump a round until none is
        new, so the rounds are as many as a way has jumps, not as it has steps.
        """
        up = self._climbed(F.col("id")).filter("seg is not null")
        tree = written(up.select(F.explode("seg").alias("a"), F.col("u").alias("d")), "tree")
        tree = written(tree.unionByName(self.nodes.select(F.col("id").alias("a"), F.col("id").alias("d"))).distinct(), "pairs")
        first = up.select(F.col("u"), F.get("seg", F.size("seg") - 2).alias("p"))
        other = self.edges.select("u", "p").filter("u <> p").join(first, ["u", "p"], "left_anti")
        jumps = written(tree.join(other.withColumnRenamed("u", "a"), "a").select("d", F.col("p").alias("q")).distinct(), "jumps")
        found, fresh = [tree], tree
        while True:
            reached = jumps.join(fresh.select("a", F.col("d").alias("q")), "q").select("a", "d").distinct()
            for known in found:
                reached = reached.join(known, ["a", "d"], "left_anti")
            fresh = written(reached, "pairs")
            if fresh.isEmpty():
                break
            found.append(fresh)
            if len(found) > 4:
                found = [written(reduce(DataFrame.unionByName, found), "pairs")]
        pairs = reduce(DataFrame.unionByName, found).filter("a <> d")
        name = self.nodes.select("id", "group", "code")
        named = pairs.join(name.withColumnRenamed("id", "a"), "a").join(self.nodes.select(F.col("id").alias("d"), F.col("code").alias("descendant")), "d")
        return named.select("group", "code", "descendant")
