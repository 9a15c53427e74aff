"""Distances between two label sets as column expressions, and what models' answers come to.

``a`` and ``b`` are arrays as ``text.label_set`` gives them.  All distances are from 0 to 1 unless stated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from accordant.functions.text import joined, lcs_length, word_set

Pair = Callable[[Column, Column], Column]


def _empty_rule(a: Column, b: Column, otherwise: Column) -> Column:
    """Two empty ones are 0 apart, one empty one is 1 from any other."""
    return F.when((a == 0) & (b == 0), 0.0).when((a == 0) | (b == 0), 1.0).otherwise(otherwise)


def trivial(a: Column, b: Column) -> Column:
    """The distance of pairs that need no measure (equal, or one empty), else null."""
    return F.when(a == b, 0.0).when((F.size(a) == 0) | (F.size(b) == 0), 1.0)


def exact_match(a: Column, b: Column) -> Column:
    return F.when(a == b, 0.0).otherwise(1.0)


def _overlap(x: Column, y: Column) -> tuple[Column, Column]:
    return F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))


def set_jaccard(a: Column, b: Column) -> Column:
    """Over whole labels; two empty sets are 0 apart."""
    inter, union = _overlap(a, b)
    return F.when(union == 0, 0.0).otherwise(1.0 - inter / F.greatest(union, F.lit(1)))


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = word_set(a), word_set(b)
    inter, union = _overlap(x, y)
    return _empty_rule(F.size(x), F.size(y), (union - inter) / F.greatest(union, F.lit(1)))


#: Weights of equal, contained, overlapping and disjoint sets.
MASI_EQUAL, MASI_SUBSET, MASI_OVERLAP, MASI_DISJOINT = 1.0, 0.67, 0.33, 0.0


def masi(a: Column, b: Column) -> Column:
    """Over word sets: 1 - Jaccard similarity times a weight for the way they overlap."""
    x, y = word_set(a), word_set(b)
    inter, union = _overlap(x, y)
    m = (
        F.when((inter == F.size(x)) & (inter == F.size(y)), MASI_EQUAL)
        .when(inter == F.least(F.size(x), F.size(y)), MASI_SUBSET)
        .when(inter > 0, MASI_OVERLAP)
        .otherwise(MASI_DISJOINT)
    )
    return _empty_rule(F.size(x), F.size(y), 1.0 - inter / F.greatest(union, F.lit(1)) * m)


def _longer(x: Column, y: Column) -> Column:
    return F.greatest(F.length(x), F.length(y), F.lit(1))


def text_levenshtein(x: Column, y: Column) -> Column:
    return F.levenshtein(x, y) / _longer(x, y)


def text_indel(x: Column, y: Column) -> Column:
    total = F.length(x) + F.length(y)
    return (total - 2 * lcs_length(x, y)) / F.greatest(total, F.lit(1))


def text_lcs(x: Column, y: Column) -> Column:
    return F.when(F.length(x) + F.length(y) == 0, 0.0).otherwise(1.0 - lcs_length(x, y) / _longer(x, y))


def text_words(x: Column, y: Column) -> Column:
    return word_jaccard(F.array(x), F.array(y))


def _on_texts(measure: Pair) -> Pair:
    def run(a: Column, b: Column) -> Column:
        x, y = joined(a), joined(b)
        return _empty_rule(F.length(x), F.length(y), measure(x, y))

    return run


levenshtein, indel, lcs_distance = map(_on_texts, (text_levenshtein, text_indel, text_lcs))

# --- costs from models' answers


def cosine_cost(u: Column, v: Column) -> Column:
    """1 - the dot product of the two vectors at length one; a zero vector stays zero."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    norm = lambda x: F.when(dot(x, x) == 0, 1.0).otherwise(F.sqrt(dot(x, x)))
    return 1.0 - dot(u, v) / (norm(u) * norm(v))


def entailment_cost(forward: Column, backward: Column) -> Column:
    """From the probabilities of entailment in both directions; a missing one is 0."""
    return 1.0 - F.sqrt(F.coalesce(forward, F.lit(0.0)) * F.coalesce(backward, F.lit(0.0)))


def directed_cost(forward: Column, backward: Column) -> Column:
    """From costs in both directions; a missing one is 1."""
    return 1.0 - F.sqrt((1.0 - F.coalesce(forward, F.lit(1.0))) * (1.0 - F.coalesce(backward, F.lit(1.0))))


def answer_cost(p_yes: Column, p_no: Column) -> Column:
    """From the probabilities of the answers yes and no: neither seen 0.5, only one seen 0 or 1."""
    return (
        F.when(p_yes.isNull() & p_no.isNull(), 0.5)
        .when(p_yes.isNull(), 1.0)
        .when(p_no.isNull(), 0.0)
        .when(p_yes + p_no == 0, 0.5)
        .otherwise(1.0 - p_yes / (p_yes + p_no))
    )


def logit_cost(yes: Column, no: Column) -> Column:
    """From the logits of yes and no; 0.5 where a logit is missing."""
    return F.coalesce(1.0 / (1.0 + F.exp(yes - no)), F.lit(0.5))


def _unit(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def spoken_costs(reply: Column) -> Column:
    """Struct of both directions' costs from a reply such as ``0.9, 0.4``; 0.5 each if it can't be read."""
    parts = F.split(reply, ",")
    p = [F.trim(F.get(parts, i)).try_cast("double") for i in (0, 1)]
    good = (F.size(parts) == 2) & p[0].isNotNull() & p[1].isNotNull()
    return F.struct(*[F.when(good, 1.0 - _unit(x)).otherwise(0.5).alias(n) for x, n in zip(p, ("forward", "backward"))])


def json_costs(reply: Column) -> Column:
    """The same from a reply that holds ``"y_entails_x": 0.9`` and ``"x_entails_y": 0.4`` somewhere."""
    out = []
    for key, name in (("y_entails_x", "forward"), ("x_entails_y", "backward")):
        p = F.regexp_extract(reply, f'(?s)"{key}"\\s*:\\s*(-?[0-9]*\\.?[0-9]+)', 1).try_cast("double")
        out.append(F.coalesce(1.0 - _unit(p), F.lit(0.5)).alias(name))
    return F.struct(*out)
