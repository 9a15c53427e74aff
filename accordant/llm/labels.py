"""Spelled labels and captions resolved to the terms of a small fixed vocabulary."""

from __future__ import annotations

import re
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The vocabulary is held by every worker; more spellings than this are refused.
MOST_SPELLINGS = 200_000
CACHE_ENTRIES = 200_000
_WORD = re.compile(r"[^\W_]+")
#: Words before a term that deny it.
_DENIALS = re.compile(r"(?:\bnot|\bno|\bno sign of|\bno signs of|\bwithout|\brather than|\bexclude[sd]?|\binstead of)\s+$")

LONGEST_DENIAL = len("no signs of")


def compact(text: str) -> str:
    """A label without case, white space and marks."""
    return "".join(_WORD.findall(text.casefold()))


def _deletions(word: str, most: int) -> set[str]:
    out = {word}
    for k in range(1, most + 1):
        for cut in combinations(range(len(word)), k):
            out.add("".join(c for i, c in enumerate(word) if i not in cut))
    return out


def distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


class Vocabulary:
    def __init__(self, spellings: dict[str, int]):
        """``spellings``: written form -> term id; of equal compact forms the smallest term counts."""
        self.terms: dict[str, int] = {}
        for text, term in sorted(spellings.items(), key=lambda x: (x[1], x[0])):
            if key := compact(text):
                self.terms.setdefault(key, term)
        self.longest = max(map(len, self.terms), default=0)
        # the words that a spelling begins with, and the most words of such a spelling
        self.opening: dict[str, int] = {}
        for text in spellings:
            if parts := _WORD.findall(text.casefold()):
                self.opening[parts[0]] = max(self.opening.get(parts[0], 0), len(parts))
        self.near: dict[str, set[str]] | None = None
        self.cache: dict[str, int | None] = {}

    def _nearest(self, key: str) -> int | None:
        """The term within one slip (six letters or more) or two (ten or more); none if two terms are as near."""
        most = 2 if len(key) >= 10 else 1 if len(key) >= 6 else 0
        if not most:
            return None
        if self.near is None:
            self.near = {}
            for word in self.terms:
                if len(word) >= 6:
                    for d in _deletions(word, 2 if len(word) >= 10 else 1):
                        self.near.setdefault(d, set()).add(word)
        found = {w for d in _deletions(key, most) for w in self.near.get(d, ())}
        best = sorted((distance(key, w, most), self.terms[w]) for w in found)
        best = [x for x in best if x[0] <= most]
        return best[0][1] if best and all(t == best[0][1] for n, t in best if n == best[0][0]) else None

    def label(self, text: str | None) -> int | None:
        if not text:
            return None
        key = compact(text)
        if key in self.terms:
            return self.terms[key]
        if key not in self.cache:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[key] = self._nearest(key) if len(key) <= self.longest + 2 else None  # no spelling is within two slips
        return self.cache[key]

    def caption(self, text: str | None) -> int | None:
        """The first term that a text names and does not deny."""
        if not text:
            return None
        low = text.casefold()
        words = list(_WORD.finditer(low))
        i = 0
        while i < len(words):
            for n in range(min(self.opening.get(words[i].group(), 0), len(words) - i), 0, -1):
                term = self.terms.get("".join(w.group() for w in words[i : i + n]))
                if term is not None:
                    end = words[i].start()
                    space = end - (words[i - 1].end() if i else 0)
                    # white space of any length, and before it at most the longest denial and the character before that
                    if low[end - space : end].strip() or not _DENIALS.search(low[max(0, end - space - LONGEST_DENIAL - 1) : end]):
                        return term
                    i += n - 1
                    break
            i += 1
        return None


def vocabulary(terms: DataFrame) -> tuple[Vocabulary, dict[int, str]]:
    """From term_id, preferred_term and variants; the table's size is checked."""
    rows = terms.select("term_id", "preferred_term", "variants").limit(MOST_SPELLINGS + 1).collect()
    spellings: dict[str, int] = {}
    for r in sorted((r for r in rows if r["term_id"] is not None), key=lambda r: r["term_id"]):
        for text in [r["preferred_term"], *(r["variants"] or ())]:
            if text is not None:
                spellings.setdefault(text, r["term_id"])
    if len(spellings) > MOST_SPELLINGS:
        raise ValueError(f"more than {MOST_SPELLINGS} spellings")
    return Vocabulary(spellings), {r["term_id"]: r["preferred_term"] for r in rows if r["term_id"] is not None}


#: Kinds of votes, in the order of their numbers.
KINDS = ["sure", "besides", "first", "later"]
_SHIFT = 40  # a vote travels as one number: its kind above so many bits, its term below


def guesses(labels: list[str | None] | None, text: str | None, words: Vocabulary) -> list[tuple[str, int]]:
    """The terms of a reading.  One label, or the one that the caption names, is sure; else the order is a hint."""
    terms = list(dict.fromkeys(t for x in (labels if labels is not None else ()) if (t := words.label(x)) is not None))
    said = words.caption(text)
    if said is not None:
        return [("sure", said)] + [("besides", t) for t in terms if t != said]
    if len(terms) == 1:
        return [("sure", terms[0])]
    return [("first" if i == 0 else "later", t) for i, t in enumerate(terms)]


def resolved(labels: Column, caption: Column, words: Vocabulary) -> Column:
    """array<long> of the votes of a list of labels and a caption, see ``guesses``; ``votes`` takes them apart."""
    number = {k: i << _SHIFT for i, k in enumerate(KINDS)}

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(labels: pd.Series, caption: pd.Series) -> pd.Series:
        return pd.Series([[number[k] + t for k, t in guesses(some, text, words)] for some, text in zip(labels, caption)])

    # not deterministic as far as the optimizer goes: a filter on the result must not run it twice
    return run.asNondeterministic()(labels, caption)


def votes(packed: Column) -> tuple[Column, Column]:
    """kind and term of a vote."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.shiftright(packed, _SHIFT) + 1).cast("int"))
    return kind, packed.bitwiseAND(F.lit((1 << _SHIFT) - 1)).cast("int")
