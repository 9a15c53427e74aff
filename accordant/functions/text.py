"""Label sets, word tokens and the longest common subsequence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def label_set(c: Column) -> Column:
    """Distinct non-null labels in code-point order; null is the empty set.  Equal sets are equal arrays."""
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(c))), F.array().cast("array<string>"))


def folded(c: Column) -> Column:
    """A text without case: lower after upper, so that a sharp s is two and a final sigma is like others."""
    return F.lower(F.upper(c))


def joined(c: Column) -> Column:
    """The labels of a set as one text."""
    return F.array_join(c, " ")


def words(text: Column) -> Column:
    """Word tokens of a lower-cased text: punctuation, quotes and contractions apart, as a treebank tokenizer cuts."""
    t = F.lower(text)
    rules = [
        (r"(^|[\s(\[{<])[\"“]", r"$1`` "),
        (r"[\"”]", r" '' "),
        (r"([^0-9\s]|^)([,:])|([,:])([^0-9]|$)", r"$1 $2$3 $4"),
        (r"\.\.\.+", " ... "),
        (r"([;@#\$%&?!()\[\]{}<>])", r" $1 "),
        (r"--", " -- "),
        (r"([^.])\.(['\")\]}>]*)\s*$", r"$1 . $2 "),
        (r"([^'\s])('s|'m|'d|'ll|'re|'ve|n't)(?=\s|$)", r"$1 $2"),
        (r"([^'\s])'(?=\s|$)", r"$1 ' "),
    ]
    for pattern, into in rules:
        t = F.regexp_replace(t, pattern, into)
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def word_set(labels: Column) -> Column:
    return F.array_distinct(words(joined(labels)))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit per character of ``a``, one addition per character of ``b``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else lcs(x, y) for x, y in zip(a, b)], dtype="Int32")
