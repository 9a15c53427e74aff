"""One label per item from annotators who disagree, by moments of triplets of annotators.

Model: annotator i knows the label of an item with probability r_i and otherwise draws one from the marginal
distribution q.  Two annotators then agree with probability r_i r_j + (1 - r_i r_j) c, where c is the chance agreement
sum(q^2), so agreement corrected for chance, (a - c) / (1 - c), estimates r_i r_j, and of any three annotators

    r_i = sqrt(A_ia A_ib / A_ab).

The reliability of an annotator is the median of the estimates from all pairs (a, b) of anchors, the ``ANCHORS`` most
active annotators, weighted by the shared items.  Votes are combined by log-odds: a vote for l counts
log(1 + r_i / ((1 - r_i) q_l)), on top of log q_l.

Errors need not be chance: some annotators mix up the same two labels.  From a first round of consensus, the label that
errors on k favour beyond chance, over all annotators, is taken as the partner of k, and the rate s_i at which i names
the partner as a further moment; a vote for l then also counts log(1 + s_i / ((1 - r_i - s_i) q_l)) for the labels whose
partner is l.

A reading with several labels leaves open which is meant.  Votes of such a ``kind`` carry the fraction f of their
annotator's r and s, estimated by moments as well: their corrected agreement with others' sure votes over the sum of
r_i r_j of the pairs.

Each item is only paired with anchors, so the work is linear in the votes however many annotators an item has.  An
annotator whom no triplet of anchors reaches gets one moment over all annotators whose reliability is known.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.storage import written

ANCHORS = 64
LEAST, MOST = 0.02, 0.98
DEFAULT = 0.5  # of an annotator who shares too few items with others
PARTNER_SHARE = 0.25  # of the errors beyond chance on a label, for a partner
UNNAMED = 1e-6  # chance of a label that no sure vote names
SHRINK = 5.0  # items' worth of the mean reliability blended into each estimate


def shares(votes: DataFrame) -> DataFrame:
    """tbl, item, annotator, kind, term, share: several readings of one kind by an annotator divide one vote."""
    counted = votes.groupBy("tbl", "item", "annotator", "kind", "term").agg(F.sum("n").alias("n"))
    total = votes.groupBy("tbl", "item", "annotator", "kind").agg(F.sum("n").alias("total"))
    return counted.join(total, ["tbl", "item", "annotator", "kind"]).select("tbl", "item", "annotator", "kind", "term", (F.col("n") / F.col("total")).alias("share"))


def triplets(own: np.ndarray, weight: np.ndarray, anchors: np.ndarray, anchor_weight: np.ndarray) -> tuple[float, int]:
    """The weighted median of sqrt(A_ia A_ib / A_ab) over pairs of anchors, and the number of pairs used."""
    a, b = np.triu_indices(len(own), 1)
    bottom = anchors[a, b]
    w = 1.0 / (1.0 / np.maximum(weight[a], 1e-9) + 1.0 / np.maximum(weight[b], 1e-9) + 1.0 / np.maximum(anchor_weight[a, b], 1e-9))
    use = (weight[a] > 0) & (weight[b] > 0) & (anchor_weight[a, b] > 0) & (bottom > 0.01)
    if not use.any():
        return float("nan"), 0
    square = own[a[use]] * own[b[use]] / bottom[use]
    w = w[use] * bottom[use] ** 2
    order = np.argsort(square, kind="stable")
    upto = np.cumsum(w[order])
    middle = square[order][np.searchsorted(upto, upto[-1] / 2)]
    return float(np.sqrt(max(middle, 0.0))), int(use.sum())


class Consensus:
    """``votes`` has tbl, item, annotator, kind, term and n (times read).  Votes of the kind ``sure`` are first choices.

    Null terms and items are no votes.  Annotators' names are compared as they are; a null one is an annotator like
    others.  Without votes every result is empty.  With ``shared`` the votes are known to be one row a term and have
    their share of an annotator's vote instead of n.
    """

    def __init__(self, votes: DataFrame, shared: bool = False):
        self.spark = votes.sparkSession
        known = votes.filter("term is not null and item is not null").withColumn("annotator", F.coalesce("annotator", F.lit("")))
        self.all = known if shared else written(shares(known), "votes")
        self.votes = self.all.filter("kind = 'sure'")
        named = written(self.votes.groupBy("term").agg(F.sum("share").alias("n")), "named")
        sums = named.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same")).first()
        total = sums["n"] or 1.0
        self.marginal = named.select("term", (F.col("n") / total).alias("q"))
        self.chance = (sums["same"] or 0.0) / total**2
        self._reliability()

    def _agreement(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """n and agreement of each annotator of ``left`` with each of ``right`` over the items of both."""
        x, y = left.alias("x"), right.alias("y")
        both = x.join(y, (F.col("x.tbl") == F.col("y.tbl")) & (F.col("x.item") == F.col("y.item")) & (F.col("x.annotator") != F.col("y.annotator")))
        weight = F.col("x.share") * F.col("y.share")
        return both.groupBy(F.col("x.annotator").alias("annotator"), F.col("y.annotator").alias("anchor")).agg(
            F.sum(weight).alias("n"), F.sum(F.when(F.col("x.term") == F.col("y.term"), weight).otherwise(0.0)).alias("agree")
        )

    def _reliability(self) -> None:
        active = self.votes.groupBy("annotator").agg(F.sum("share").alias("n"))
        names = [r["annotator"] for r in active.orderBy(F.desc("n"), "annotator").limit(ANCHORS).collect()]
        at = {a: k for k, a in enumerate(names)}
        stats = written(self._agreement(self.votes, self.votes.filter(F.col("annotator").isin(names))), "agreement")
        m = len(names)
        corrected, weight = np.zeros((m, m)), np.zeros((m, m))
        c = min(self.chance, 0.999)
        for r in stats.filter(F.col("annotator").isin(names)).collect():  # at most ANCHORS squared
            i, j = at[r["annotator"]], at[r["anchor"]]
            weight[i, j] = r["n"]
            corrected[i, j] = (r["agree"] / r["n"] - c) / (1 - c)

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            own, n = np.zeros(m), np.zeros(m)
            k = pdf["anchor"].map(at).to_numpy()
            n[k] = pdf["n"].to_numpy()
            own[k] = (pdf["agree"].to_numpy() / n[k] - c) / (1 - c)
            r, used = triplets(own, n, corrected, weight)
            return pd.DataFrame({"annotator": [pdf["annotator"].iloc[0]], "raw": [r], "shared": [n.sum()], "triplets": [used]})

        found = stats.groupBy("annotator").applyInPandas(one, "annotator string, raw double, shared double, triplets long")
        found = self._from_neighbours(written(found, "raw"), c)
        mean = found.filter("not isnan(raw)").agg((F.sum(F.col("raw") * F.col("shared")) / F.sum("shared")).alias("m")).first()["m"]
        mean = DEFAULT if mean is None else mean
        everyone = self.all.groupBy("annotator").agg(F.sum("share").alias("n"))
        r = F.when(F.col("raw").isNull() | F.isnan("raw"), F.lit(mean)).otherwise(
            (F.col("raw") * F.col("shared") + mean * SHRINK) / (F.col("shared") + SHRINK)
        )
        self.reliability = written(
            everyone.join(found, "annotator", "left").select(
                "annotator", F.greatest(F.least(r, F.lit(MOST)), F.lit(LEAST)).alias("reliability"), F.col("n").alias("n_items"), F.coalesce("triplets", F.lit(0)).alias("n_triplets")
            ),
            "reliability",
        )
        self.fractions = {"sure": 1.0}
        rate = self.reliability.select("annotator", "reliability")
        for kind in sorted(r["kind"] for r in self.all.select("kind").distinct().collect() if r["kind"] != "sure"):
            met = self._agreement(self.all.filter(F.col("kind") == kind), self.votes.filter(F.col("annotator").isin(names)))
            met = met.join(rate, "annotator").join(rate.select(F.col("annotator").alias("anchor"), F.col("reliability").alias("r")), "anchor")
            x = met.agg(F.sum((F.col("agree") - c * F.col("n")) / (1 - c)).alias("a"), F.sum(F.col("n") * F.col("reliability") * F.col("r")).alias("b")).first()
            self.fractions[kind] = float(min(max(x["a"] / x["b"], LEAST), 1.0)) if x["b"] else LEAST

    def _from_neighbours(self, found: DataFrame, c: float) -> DataFrame:
        """``found`` with the annotators that no triplet of anchors reaches, from everyone whose reliability is known.

        Agreement with known annotators j, corrected for chance, is r_i times the sum of their r_j, so one moment gives
        r_i.  Sums by item and term stand for the others, so no two annotators are paired.  Whom this reaches is known
        in the next round; who shares no item with anyone known stays without an estimate.
        """
        known = found.filter("raw is not null and not isnan(raw)")
        rest = self.votes.select("annotator").distinct().join(known, "annotator", "left_anti")
        while not rest.isEmpty():
            rated = self.votes.join(known.select("annotator", F.least(F.col("raw"), F.lit(MOST)).alias("r")), "annotator")
            items = rated.groupBy("tbl", "item").agg(F.sum("share").alias("every"), F.sum(F.col("share") * F.col("r")).alias("rated"))
            terms = rated.groupBy("tbl", "item", "term").agg(F.sum("share").alias("same"))
            open_ = self.votes.join(rest, "annotator", "left_semi").join(items, ["tbl", "item"]).join(terms, ["tbl", "item", "term"], "left")
            sums = open_.groupBy("annotator").agg(*[F.sum(F.col("share") * F.coalesce(x, F.lit(0.0))).alias(x) for x in ("every", "rated", "same")])
            raw = (F.col("same") - c * F.col("every")) / ((1 - c) * F.col("rated"))
            fresh = written(sums.filter("rated > 0").select("annotator", F.greatest(raw, F.lit(0.0)).alias("raw"), F.col("every").alias("shared"), F.lit(0).cast("long").alias("triplets")), "raw")
            if fresh.isEmpty():
                break
            known = written(known.unionByName(fresh), "raw")
            rest = written(rest.join(fresh, "annotator", "left_anti"), "rest")
        return known

    def _scores(self, mixing: bool) -> DataFrame:
        """tbl, item, term, s (log-odds), v (share of votes) and q of every label that a vote speaks for."""
        part = F.create_map(*[F.lit(x) for kv in self.fractions.items() for x in kv])[F.col("kind")]  # a few kinds
        first = self.all.join(self.mixing if mixing else self.reliability.withColumn("mix", F.lit(0.0)), "annotator").join(self.marginal, "term", "left")
        first = first.withColumn("reliability", part * F.col("reliability")).withColumn("mix", part * F.col("mix"))
        first = first.withColumn("rest", (1 - F.col("reliability") - F.col("mix")) * F.coalesce("q", F.lit(UNNAMED)))
        voted = F.when(F.col("kind") == "sure", F.col("share")).otherwise(0.0)
        scored = first.select("tbl", "item", "term", (F.col("share") * F.log(1 + F.col("reliability") / F.col("rest"))).alias("s"), voted.alias("v"))
        if mixing and self.partners is not None:
            # a vote for the partner of k speaks for k as well
            other = first.filter(F.col("mix") > 0).join(self.partners.select(F.col("partner").alias("term"), "truth"), "term")
            scored = scored.unionByName(
                other.select("tbl", "item", F.col("truth").alias("term"), (F.col("share") * F.log(1 + F.col("mix") / F.col("rest"))).alias("s"), F.lit(0.0).alias("v"))
            )
        per = scored.groupBy("tbl", "item", "term").agg(F.sum("s").alias("s"), F.sum("v").alias("v"))
        return per.join(self.marginal, "term", "left").withColumn("q", F.coalesce("q", F.lit(UNNAMED))).withColumn("s", F.col("s") + F.log("q"))

    def _confusions(self) -> None:
        """Partners of labels, and each annotator's rate of naming the partner, from a first round of consensus."""
        best = self._scores(False).groupBy("tbl", "item").agg(F.max(F.struct("s", (-F.col("term")).alias("t"))).alias("top"))
        known = self.votes.join(best.select("tbl", "item", (-F.col("top.t")).alias("truth")), ["tbl", "item"])
        counts = written(known.groupBy("annotator", "term", "truth").agg(F.sum("share").alias("n")).join(self.reliability, "annotator"), "confusions")
        # errors of everyone on each label, and the named label that they favour most beyond its chance
        wrong = counts.filter("truth <> term").groupBy("truth", "term").agg(F.sum("n").alias("n"))
        rate = wrong.join(self.marginal, "term").join(self.marginal.select(F.col("term").alias("truth"), F.col("q").alias("q_truth")), "truth", "left")
        total = rate.groupBy("truth").agg(F.sum("n").alias("total"))
        beyond = rate.join(total, "truth").withColumn("beyond", F.col("n") - F.col("total") * F.col("q") / (1 - F.coalesce("q_truth", F.lit(0.0))))
        top = beyond.groupBy("truth").agg(F.max(F.struct("beyond", (-F.col("term")).alias("t"), "n", "q")).alias("top"), F.sum(F.greatest("beyond", F.lit(0.0))).alias("over"))
        favoured = (F.col("top.beyond") >= PARTNER_SHARE * F.col("over")) & (F.col("top.beyond") > 3 * F.sqrt(F.greatest("top.n", F.lit(1.0))))
        partners = written(top.filter(favoured).select("truth", (-F.col("top.t")).alias("partner"), F.col("top.q").alias("q")), "partners")
        if partners.isEmpty():
            self.partners, self.mixing = None, self.reliability.withColumn("mix", F.lit(0.0))
            return
        self.partners = partners
        at = counts.join(partners, "truth")
        named = F.sum(F.when(F.col("term") == F.col("partner"), F.col("n")).otherwise(0.0))
        by_chance = F.sum(F.col("n") * (1 - F.col("reliability")) * F.col("q"))
        rate = at.groupBy("annotator").agg(((named - by_chance) / (F.sum("n") + SHRINK)).alias("rate"))
        mix = F.least(F.greatest(F.coalesce("rate", F.lit(0.0)), F.lit(0.0)), (1 - F.col("reliability")) * 0.95)
        self.mixing = written(self.reliability.join(rate, "annotator", "left").withColumn("mix", mix).drop("rate"), "mixing")

    def labels(self) -> DataFrame:
        """tbl, item, term, confidence (posterior of the label), n_annotators and agreement of each item with a vote.

        ``n_annotators`` and ``agreement`` (the share of pairs of annotators with the same choice, null for one
        annotator) are those of the sure votes.  Equal
        scores go to the smallest term.
        """
        self._confusions()
        best = self._scores(True).groupBy("tbl", "item").agg(
            F.max(F.struct("s", (-F.col("term")).alias("t"))).alias("top"),
            F.sum("q").alias("named"),
            F.sum(F.exp("s")).alias("mass"),
            F.sum("v").alias("n"),
            F.sum(F.col("v") * F.col("v")).alias("same"),
        )
        n = F.col("n")
        return best.select(
            "tbl",
            "item",
            (-F.col("top.t")).alias("term"),
            (F.exp("top.s") / (F.col("mass") + F.greatest(1 - F.col("named"), F.lit(0.0)))).alias("confidence"),
            F.round(n).cast("long").alias("n_annotators"),
            F.when(n > 1.5, (F.col("same") - n) / (n * (n - 1))).alias("agreement"),
        )
