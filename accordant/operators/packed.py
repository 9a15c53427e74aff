"""Several values packed in one field: infer the delimiters, split, explode with position.

Delimiters are inferred for each source of a field, from all its rows and no list of what is usual.  A field is cut at
every candidate; a candidate is scored on the pieces at its two sides:

* piece-count consistency: the share of the rows with the candidate in which it cuts off no empty inner piece, i.e.
  the number of pieces is the number of delimiters plus one; and the counts themselves: a delimiter makes lists of
  any length, or cuts most rows of its source in the same way.  A joint within some words (``scar-like``) cuts few
  rows, and these in two.  The share of rows with three pieces or more counts over ``LONG_SHARE``, that of all rows
  over ``COVERED_SHARE``, the larger of the two, at most one.
* piece type regularity: values of a list are of one kind, so the types of the pieces before a delimiter (how many
  words, with numbers or not, with marks or not) are as frequent behind it.  The mark of ``grade 2+ oedema`` always has
  a number before it and a word behind.  The score is the overlap of the two tables of types.
* freedom of the neighbours: a delimiter joins values freely, so the piece before says little about the piece behind.
  The comma of values like ``plaque, thick`` always stands between the same two pieces.  With the chances that two
  occurrences agree in the piece before (a), in the piece behind (b) and in both (c), the score is
  1 - (c - ab) / (max(a, b) - ab): 1 where both are independent, 0 where each piece fixes the other.  These chances
  have unbiased estimates however few the rows are; pieces are compared by a hash.

The score is consistency times the geometric mean of the two others.  A source with few rows borrows from the whole
field: its own score counts as many rows as it has, that of the field ``POOLED_ROWS``, and a field with hardly any
rows is near the neutral threshold itself.  A source uses the candidates that reach ``THRESHOLD``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.storage import written

#: Candidates: name and pattern.
CANDIDATES: list[tuple[str, str]] = [
    (",", r","),
    (";", r";"),
    ("|", r"\|"),
    ("->", r"->"),
    (">", r"(?<!-)>"),
    (" / ", r"(?<=\s)/(?=\s|$)|^/(?=\s)"),
    ("newline", r"[\n\r]+"),
    ("tab", r"\t"),
    ("»", r"»"),
    ("，", r"，"),
    ("；", r"；"),
    ("、", r"、"),
    ("&", r"&"),
    ("+", r"\+"),
    (":", r":"),
    ("-", r"-(?!>)"),
    ("~", r"~"),
    ("•", r"•"),
]
POOLED_ROWS = 40
NEUTRAL, NEUTRAL_ROWS = 0.6, 4
THRESHOLD = 0.6
LONG_SHARE, COVERED_SHARE = 0.15, 0.5
CELLS, TYPES = 128, 12
#: A mark with so many occurrences beside the same piece stands within a value.
CONSTANT = 0.75
_NAMES = [c[0] for c in CANDIDATES]
_NUMBER = {n: i for i, n in enumerate(_NAMES)}
_ALL = tuple(_NAMES)
_WRITTEN = {"/": " / ", "\t": "tab"}
#: White space of any kind, for patterns that the JVM runs.
_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
_SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


@lru_cache(maxsize=512)
def _scanner(delimiters: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    some = "|".join(f"(?:{p})" for n, p in CANDIDATES if n in delimiters) or r"(?!)"
    after = "|".join(f"(?:{p})" for n, p in CANDIDATES if n in delimiters and n != " / ") or r"(?!)"
    slash = r"|\s+/(?:\s|$)" if " / " in delimiters else ""
    return re.compile(f"({some})"), re.compile(rf"[\"'(]|{some}"), re.compile(rf"\s*(?:{after}|$){slash}")


def _quote_end(text: str, start: int, after: re.Pattern) -> int:
    """The place behind the quote that closes the one at ``start``; -1 if none does."""
    q, i = text[start], start + 1
    while True:
        j, b = text.find(q, i), text.find("\\", i)
        if j < 0:
            return -1
        if 0 <= b < j:
            i = b + 2
        elif j == start + 1 and after.match(text, j + 1):
            return j + 1
        elif text.startswith(q, j + 1):
            i = j + 2
        elif after.match(text, j + 1):
            return j + 1
        else:
            i = j + 1


def _paren_end(text: str, start: int) -> int:
    depth = 0
    for m in re.finditer(r"[()]", text[start:]):
        depth += 1 if m.group() == "(" else -1
        if not depth:
            return start + m.end()
    return -1


def cut(text: str, delimiters: tuple[str, ...]) -> list[str]:
    """Pieces as written, empty ones too, and between each two the delimiter that cut them apart.

    Nothing is cut within quotes that enclose a piece or within parentheses.
    """
    plain, tokens, after = _scanner(delimiters)
    if not ('"' in text or "'" in text or "(" in text):
        return plain.split(text)
    out, start, pos, dead = [], 0, 0, False
    while m := tokens.search(text, pos):
        c = m.group()
        if c in ('"', "'"):
            end = _quote_end(text, m.start(), after) if not text[start : m.start()].strip() else -1
            pos = end if end > 0 else m.end()
        elif c == "(":
            end = -1 if dead else _paren_end(text, m.start())
            dead = dead or end < 0
            pos = end if end > 0 else m.end()
        else:
            out += [text[start : m.start()], c]
            start = pos = m.end()
    out.append(text[start:])
    return out


def unwrap(piece: str) -> str:
    """A piece without outer white space, enclosing quotes and escapes."""
    piece = piece.strip()
    if len(piece) > 1 and piece[0] == piece[-1] and piece[0] in "\"'":
        q, inner = piece[0], piece[1:-1]
        if q == '"' and "\\" in inner:
            try:
                return str(json.loads(piece)).strip()
            except ValueError:
                pass
        inner = inner.replace(q + q, q)
        return re.sub(r"\\([\\\"'])", r"\1", inner).strip()
    return piece


def unbracket(text: str) -> str:
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == "[" and text[-1] == "]" else text


def split_values(text: str | None, delimiters: tuple[str, ...]) -> list[str]:
    """The non-empty values of one field, in order; null and blank give none."""
    if text is None or not text.strip():
        return []
    return [v for p in cut(unbracket(text), delimiters)[::2] if (v := unwrap(p))]


# --- scores of candidates

_WORDS = re.compile(r"\S+")


@lru_cache(maxsize=200_000)
def _code(piece: str) -> tuple[int, int]:
    """Content class and type of a piece."""
    piece = unwrap(piece).casefold()
    n_words = min(len(_WORDS.findall(piece)), 3) - 1
    kind = (n_words * 2 + any(c.isdigit() for c in piece)) * 2 + any(not c.isalnum() and not c.isspace() for c in piece)
    return zlib.crc32(piece.encode("utf-8", "replace")) % CELLS, kind


_COUNTED = pa.schema([("field", pa.string()), ("source", pa.string()), ("name", pa.int32()), ("code", pa.int32()), ("n", pa.int64())])
#: Codes of a candidate's counts: rows with it, sound rows, rows of three pieces or more, then types on the left and on
#: the right, then pairs of content classes.
_ROWS, _SOUND, _LONG, _LEFT = 0, 1, 2, 3
_RIGHT, _PAIRS = _LEFT + TYPES, _LEFT + 2 * TYPES
#: The number, in place of a candidate's, under which all rows of a source are counted.
_FILLED = len(_NAMES)


def _counts(fields: list[str]):
    size = _PAIRS + CELLS * CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per batch, source and candidate: rows, sound rows, and how often each two types of pieces are neighbours."""
        for batch in batches:
            sources: dict[str, int] = {}
            at = [sources.setdefault(s, len(sources)) for s in batch.column("source").to_pylist()]
            names = list(sources)
            for field in fields:
                found: list[int] = []
                for source, text in zip(at, batch.column(field).to_pylist()):
                    if text is None or not (text := unbracket(text)).strip():
                        continue
                    base = source * (_FILLED + 1)
                    found.append((base + _FILLED) * size + _ROWS)
                    parts = cut(text, _ALL)
                    if len(parts) < 3:
                        continue
                    pieces = [p.strip() for p in parts[::2]]
                    # a pair counts once a row, and a value next to itself says nothing
                    pairs, broken, seen = set(), set(), {}
                    last = len(pieces) - 1
                    for i, mark in enumerate(parts[1::2]):
                        name = _NUMBER[_WRITTEN.get(mark) or (mark if mark in _NUMBER else "newline")]
                        seen[name] = seen.get(name, 0) + 1
                        a, b = pieces[i], pieces[i + 1]
                        if a and b:
                            if a != b:
                                pairs.add((name, *_code(a), *_code(b)))
                        elif (not a and i > 0) or (not b and i + 1 < last):
                            broken.add(name)
                    for name, times in seen.items():
                        found.append((base + name) * size + _ROWS)
                        if times > 1:
                            found.append((base + name) * size + _LONG)
                        if name not in broken:
                            found.append((base + name) * size + _SOUND)
                    for name, x, left, y, right in pairs:
                        code = (base + name) * size
                        found += (code + _LEFT + left, code + _RIGHT + right, code + _PAIRS + x * CELLS + y)
                if found:
                    key, n = np.unique(np.array(found, np.int64), return_counts=True)
                    key, code = np.divmod(key, size)
                    source, name = np.divmod(key, _FILLED + 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([field] * len(key)), pa.array([names[s] for s in source]), pa.array(name, pa.int32()), pa.array(code, pa.int32()), pa.array(n)], schema=_COUNTED
                    )

    return run


def regularity(left: np.ndarray, right: np.ndarray) -> float:
    """How much the tables of types on both sides overlap, from 0 to 1."""
    if not left.sum():
        return NEUTRAL
    return float(np.minimum(left / left.sum(), right / right.sum()).sum())


def freedom(pairs: np.ndarray) -> float:
    """How little two neighbours say about each other, from 0 to 1: from a square table of content classes."""
    n = pairs.sum()
    if n < 2:
        return NEUTRAL
    agree = lambda t: float((t * (t - 1)).sum() / (n * (n - 1)))
    a, b, both = agree(pairs.sum(1)), agree(pairs.sum(0)), agree(pairs)
    if max(a, b) > CONSTANT:
        return 0.0
    if max(a, b) == 0.0:  # no piece came twice
        return NEUTRAL
    return min(max(1.0 - (both - a * b) / (max(a, b) - a * b), 0.0), 1.0)


def score(code: np.ndarray, n: np.ndarray, filled: int) -> tuple[int, float]:
    """Rows with a candidate and its score, from its counts by code and the number of all rows."""
    rows, sound, long = (int(n[code == k].sum()) for k in (_ROWS, _SOUND, _LONG))
    counts = np.bincount(code, n, _PAIRS + CELLS * CELLS)
    left, right, table = counts[_LEFT:_RIGHT], counts[_RIGHT:_PAIRS], counts[_PAIRS:].reshape(CELLS, CELLS)
    lists = (long + NEUTRAL_ROWS * LONG_SHARE) / (rows + NEUTRAL_ROWS) / LONG_SHARE
    consistent = sound / max(rows, 1) * min(1.0, max(lists, rows / max(filled, 1) / COVERED_SHARE))
    return rows, consistent * (regularity(left, right) * freedom(table)) ** 0.5


def _scores(pdf: pd.DataFrame) -> dict[str, tuple[int, float]]:
    name, code, n = (pdf[c].to_numpy() for c in ("name", "code", "n"))
    filled = int(n[name == _FILLED].sum())
    return {_NAMES[k]: score(code[name == k], n[name == k], filled) for k in np.unique(name) if k != _FILLED}


def infer_delimiters(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` has ``source`` and the fields.  Gives field, source, delimiters (sorted names), scores (map) and ``pattern``,
    the delimiters as one regular expression with the white space around them.  A candidate that does not occur in a
    source is not listed there.

    All rows are counted.  Sources without a text are not listed.  Only the scores of the candidates by field (a fixed
    number) come to the driver.
    """
    counted = rows.select("source", *fields).mapInArrow(_counts(fields), "field string, source string, name int, code int, n long")
    by_source = written(counted.groupBy("field", "source", "name", "code").agg(F.sum("n").alias("n")), "delimiters")
    by_field = by_source.groupBy("field", "name", "code").agg(F.sum("n").alias("n"))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(pdf["field"].iloc[0], name, (rows * x + NEUTRAL_ROWS * NEUTRAL) / (rows + NEUTRAL_ROWS)) for name, (rows, x) in _scores(pdf).items()]
        return pd.DataFrame(out, columns=["field", "name", "score"])

    pooled: dict[str, dict[str, float]] = {f: {} for f in fields}
    for r in by_field.groupBy("field").applyInPandas(whole, "field string, name string, score double").collect():
        pooled[r["field"]][r["name"]] = r["score"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        field, own = pdf["field"].iloc[0], _scores(pdf)
        mixed = {}
        for name, (n, mine) in sorted(own.items()):
            mixed[name] = (n * mine + POOLED_ROWS * pooled[field][name]) / (n + POOLED_ROWS)
        names = [name for name, x in mixed.items() if x >= THRESHOLD]
        return pd.DataFrame({"field": [field], "source": [pdf["source"].iloc[0]], "delimiters": [names], "scores": [mixed], "pattern": [jvm_pattern(names)]})

    return by_source.groupBy("field", "source").applyInPandas(one, "field string, source string, delimiters array<string>, scores map<string,double>, pattern string")


def jvm_pattern(delimiters: list[str]) -> str:
    """Any of the delimiters, those of one character as a class."""
    single = "".join(re.escape(n) for n in delimiters if len(n) == 1 and n not in ">-")
    some = [f"(?:{p})" for n, p in CANDIDATES if n in delimiters and (len(n) > 1 or n in ">-")]
    return "|".join([*([f"[{single}]"] if single else []), *some]).replace(r"\s", _SPACE) or "(?!)"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _split(text: pa.Array, delimiters: pa.Array) -> pa.Array:
    out = [None if t is None else split_values(t, tuple(d or ())) for t, d in zip(text.to_pylist(), delimiters.to_pylist())]
    return pa.array(out, pa.list_(pa.string()))


_split = _split.asNondeterministic()  # a filter on the values must not split twice


def source_of(path: Column) -> Column:
    """The first segment of a path; paths without one share the source ``''``."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit(""))


def values(text: Column, delimiters: Column, pattern: Column) -> Column:
    """The values of a field; fields without quotes and parentheses, most of them, don't leave the JVM."""
    plain = ~text.rlike("[\"'(\x01]")
    bare = lambda c: F.btrim(c, F.lit(_SPACES))
    inner = F.when(bare(text).startswith("[") & bare(text).endswith("]") & (F.length(bare(text)) > 1), F.regexp_replace(bare(text), r"^\[|\]$", "")).otherwise(bare(text))
    # a compiled pattern is kept as long as rows have the same one, which split alone doesn't do
    pieces = F.filter(F.transform(F.split(F.regexp_replace(inner, pattern, F.lit("\x01")), "\x01"), bare), lambda p: p != "")
    return F.coalesce(_split(F.when(~plain, text), delimiters), pieces)


def unpack(df: DataFrame, key: str, fields: list[str], source: Column, nothing: dict[str, str] | None = None) -> DataFrame:
    """One row for each value: the key, ``field_name``, ``pos`` (from 1 over non-empty values) and ``val``.

    Null and blank fields give no row, nor does a field whose only value is ``nothing[field]`` in any case.  Repeated
    rows and repeated values are kept.  Quotes that never close and parentheses that never close are ordinary
    characters.  Of a source with no text nothing is cut.  Other columns of ``df``, whatever their
    names, are not touched.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(source, F.lit("")).alias("source"), *fields)
    # written, so that its size is known: where it is small the rows are not shuffled to meet it
    found = written(infer_delimiters(rows, fields).select("field", "source", "delimiters", "pattern"), "sources")
    long = rows.select(
        "key", "source", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")
    ).select("key", "source", "x.field", "x.text")
    long = long.filter(F.col("text").isNotNull() & (F.trim("text") != ""))
    vals = values(F.col("text"), F.col("delimiters"), F.coalesce("pattern", F.lit("(?!)")))
    split = long.join(found, ["field", "source"], "left").select("key", "field", vals.alias("vals"))
    for field, word in (nothing or {}).items():
        split = split.filter(~((F.col("field") == field) & (F.size("vals") == 1) & (F.lower(F.get("vals", 0)) == word)))
    return split.select(
        F.col("key").alias(key), F.col("field").alias("field_name"), F.posexplode("vals").alias("pos", "val")
    ).withColumn("pos", F.col("pos") + 1)
