"""Delimited lines that may not parse: typed records for the sound ones, located errors for the others.

The grammar is parsed by recursive descent, one method per rule:

    text    := record (line-break record)*
    record  := field (separator field)*
    field   := quoted | bare
    quoted  := '"' (any character but '"' | '""')* '"'
    bare    := (any character but '"', separator, line break)*

An error is recorded with its place and the parser goes on at the next place where a record can start: the beginning
of a line that fits the feed's anchor pattern and from which a record with the right number of fields parses.  So one
broken quote costs the record it stands in, not the rest of the file.

``parse_lines`` takes each row as one record.  ``recover`` takes the rows as the lines of files, in which a record may
span lines and a broken quote runs on: files are parsed in blocks that begin at record starts, so neither a file nor a
record needs to fit one row, and no task holds a whole file.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CODE = re.compile(r"[A-Z0-9]+(?:\.[A-Z0-9]+)*")
_DIGITS = re.compile(r"[0-9]+")
_DECIMAL = re.compile(r"[0-9]+(?:\.[0-9]+)?")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]")


def _no_text(text: str) -> bool:
    return all(c.isspace() or unicodedata.category(c) == "Pd" for c in text)


def _icd11_value(v: list[str]) -> str | None:
    code, title, kind = v[1], v[3], v[4]
    if kind not in ("chapter", "block", "category"):
        return "ClassKind"
    if (not code and kind == "category") or (code and not _CODE.fullmatch(code)):
        return "Code"
    if _no_text(title) or _CONTROL.search(title):
        return "Title"
    return None


def _labels_ok(text: str) -> bool:
    try:
        labels = json.loads(text)
    except (ValueError, RecursionError):
        return False
    return isinstance(labels, list) and all(isinstance(x, str) and x.strip() for x in labels)


def _prediction_value(v: list[str]) -> str | None:
    if not _labels_ok(v[11]):
        return "rater_a"
    if not _labels_ok(v[12]):
        return "rater_b"
    if not _DIGITS.fullmatch(v[8]):
        return "sample_index"
    if not _DECIMAL.fullmatch(v[13]) or not 0 <= float(v[13]) <= 1:
        return "distance"
    return None


@dataclass(frozen=True)
class Feed:
    """A kind of file: its separator, columns, record-start pattern and value rules."""

    name: str
    separator: str
    columns: tuple[str, ...]
    anchor: re.Pattern
    invalid: Callable[[list[str]], str | None]
    types: dict[str, str] = field(default_factory=dict)


ICD11 = Feed(
    "icd11",
    "\t",
    ("Foundation URI", "Code", "BlockId", "Title", "ClassKind", *(f"Grouping{i}" for i in range(1, 6))),
    re.compile(r"(?:https?://[^\t\n]*)?\t"),
    _icd11_value,
)
PREDICTIONS = Feed(
    "predictions",
    ",",
    ("dataset", "mode", "negative_mode", "agreement_level", "seed", "measure", "chance_measure", "reasoning", "sample_index",
     "rater_a_set_size", "rater_b_set_size", "rater_a", "rater_b", "distance"),
    re.compile(r"[A-Za-z0-9_]+,(?:set|single),"),
    _prediction_value,
    {"agreement_level": "double", "seed": "bigint", "reasoning": "boolean", "sample_index": "bigint", "rater_a_set_size": "int",
     "rater_b_set_size": "int", "rater_a": "array<string>", "rater_b": "array<string>", "distance": "double"},
)
FEEDS = {f.name: f for f in (ICD11, PREDICTIONS)}


class _Broken(Exception):
    def __init__(self, at: int, what: str):
        self.at, self.what = at, what


@dataclass
class Record:
    """``defect`` is null or the first of quoting, columns, value; ``at`` is its place, ``detail`` says more."""

    start: int
    end: int
    fields: list[str] | None
    defect: str | None = None
    at: int | None = None
    detail: str | None = None


class Parser:
    def __init__(self, text: str, feed: Feed):
        self.text, self.feed = text, feed
        self.bare = re.compile(f"[^{re.escape(feed.separator)}\"\n]*")

    def records(self) -> Iterator[Record]:
        pos = 1 if self.text.startswith("﻿") else 0
        while True:
            record = self.record(pos)
            yield record
            if record.end >= len(self.text):
                return
            pos = record.end + 1

    def record(self, start: int) -> Record:
        try:
            fields, end = self.fields(start)
        except _Broken as broken:
            return Record(start, self.resume(start), None, "quoting", broken.at, broken.what)
        want = len(self.feed.columns)
        if len(fields) != want:
            return Record(start, end, fields, "columns", start, f"{len(fields)} fields, not {want}")
        if wrong := self.feed.invalid(fields):
            return Record(start, end, fields, "value", start, wrong)
        return Record(start, end, fields)

    def fields(self, pos: int) -> tuple[list[str], int]:
        out = []
        while True:
            value, pos = self.quoted(pos) if self.text.startswith('"', pos) else self.unquoted(pos)
            out.append(value)
            if not self.text.startswith(self.feed.separator, pos):
                break
            pos += 1
        if out[-1].endswith("\r") and (pos == len(self.text) or self.text[pos] == "\n"):
            out[-1] = out[-1][:-1]
        return out, pos

    def unquoted(self, pos: int) -> tuple[str, int]:
        end = self.bare.match(self.text, pos).end()
        if self.text.startswith('"', end):
            raise _Broken(end, "a quote within an unquoted field")
        return self.text[pos:end], end

    def quoted(self, start: int) -> tuple[str, int]:
        pos = start + 1
        while True:
            end = self.text.find('"', pos)
            if end < 0:
                raise _Broken(start, "a quote that never closes")
            if not self.text.startswith('"', end + 1):
                break
            pos = end + 2
        value, after = self.text[start + 1 : end].replace('""', '"'), end + 1
        if self.text.startswith("\r", after) and self.text[after + 1 : after + 2] in ("", "\n"):
            after += 1
        if after < len(self.text) and self.text[after] not in (self.feed.separator, "\n"):
            raise _Broken(after, "text after a closing quote")
        return value, after

    def resume(self, start: int) -> int:
        """The line break before the next validated record start, or the end of the text."""
        at = self.text.find("\n", start)
        while at >= 0:
            if self.feed.anchor.match(self.text, at + 1):
                try:
                    if len(self.fields(at + 1)[0]) == len(self.feed.columns):
                        return at
                except _Broken:
                    pass
            at = self.text.find("\n", at + 1)
        return len(self.text)


def parse_line(line: str, feed: Feed) -> Record:
    """One line as one record; what is left behind its end makes it a record with the wrong columns."""
    text = line.removeprefix("﻿")
    for end in ("\r\n", "\n", "\r"):
        if text.endswith(end):
            text = text.removesuffix(end)
            break
    parser = Parser(text, feed)
    record = parser.record(0)
    if record.end < len(text) and record.defect != "quoting":
        parser.text = text[record.end + 1 :]
        for later in parser.records():
            if later.defect == "quoting":
                return Record(0, record.end, None, "quoting", later.at + record.end + 1, later.detail)
        return Record(0, record.end, record.fields, "columns", record.end, "text after the record's end")
    return record


_PARSED = T.StructType(
    [
        T.StructField("defect", T.StringType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("detail", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StringType())),
    ]
)


@F.pandas_udf(_PARSED)
def _parse(line: pd.Series, feed: pd.Series) -> pd.DataFrame:
    out = []
    for text, name in zip(line, feed):
        if name not in FEEDS:
            out.append(("feed", 0, "unknown feed", None))
        elif text is None:
            out.append(("columns", 0, "null line", None))
        else:
            r = parse_line(text, FEEDS[name])
            out.append((r.defect, r.at, r.detail, r.fields if r.defect is None else None))
    return pd.DataFrame(out, columns=["defect", "at", "detail", "fields"])


_parse = _parse.asNondeterministic()  # a filter on the defect must not parse twice


def parse_lines(df: DataFrame, keys: list[str], line: str = "line", feed: str = "feed") -> DataFrame:
    """``keys``, ``feed``, ``defect``, ``at``, ``detail`` and ``fields`` of each row of ``df``.

    ``defect`` is null for a sound line, else ``quoting``, ``columns`` or ``value``, the first that applies; ``at`` is
    the place in the line.  A null line has the defect ``columns``, an empty one too (one field); a row of an unknown
    feed has the defect ``feed``.  Repeated lines are parsed each; other columns of ``df`` don't matter.
    """
    parsed = df.select(*keys, F.col(feed).alias("feed"), _parse(F.col(line), F.col(feed)).alias("parsed"))
    return parsed.select(*keys, "feed", "parsed.*")


def typed_records(parsed: DataFrame, keys: list[str], feed: Feed) -> DataFrame:
    """The sound records of one feed, a typed column for each of its columns."""
    out = []
    for i, name in enumerate(feed.columns):
        value, kind = F.get("fields", i), feed.types.get(name, "string")
        if kind.startswith("array"):
            value = F.from_json(value, kind)
        elif kind != "string":
            value = value.try_cast(kind)
        out.append(value.alias(name.replace(" ", "_")))
    return parsed.filter((F.col("feed") == feed.name) & F.col("defect").isNull()).select(*keys, *out)


#: Lines of a block; a record may span at most as many.
LINES_PER_BLOCK = 2000


def _line_end_off(text: str) -> str:
    text = text.removeprefix("\ufeff")
    for end in ("\r\n", "\n", "\r"):
        if text.endswith(end):
            return text.removesuffix(end)
    return text


def _block(table: pa.Table) -> pa.Table:
    """The records of one block of lines of a file, with the line they start in."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("line_no", "line_id", "line"))), key=lambda r: r[:2])
    name, feed = table.column("file_name")[0].as_py(), FEEDS[table.column("feed")[0].as_py()]
    lines = [_line_end_off(line or "") for _, _, line in rows]
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    out = []
    for r in Parser("\n".join(lines), feed).records():
        first, last = bisect_right(starts, r.start) - 1, bisect_right(starts, max(r.start, r.end - 1)) - 1
        out.append((name, feed.name, rows[first][0], rows[first][1], last - first + 1, r.defect, r.at - r.start if r.at is not None else None, r.detail, r.fields if r.defect is None else None))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), RECOVERED.types)], schema=RECOVERED)


RECOVERED = pa.schema(
    [("file_name", pa.string()), ("feed", pa.string()), ("line_no", pa.int64()), ("line_id", pa.int64()), ("n_lines", pa.int32()), ("defect", pa.string()), ("at", pa.int32()), ("detail", pa.string()), ("fields", pa.list_(pa.string()))]
)


def recover(df: DataFrame) -> DataFrame:
    """``RECOVERED`` rows: the records of the files that the lines of ``df`` make up, and where the parser stumbled.

    ``df`` has file_name, feed, line_no, line_id and line; lines go in the order of their number, of repeated ones by
    ``line_id``, and a null line is an empty one.  ``line_no`` and ``line_id`` are those of a record's first line,
    ``n_lines`` how many it spans, ``at`` the place of the defect in it.  Lines without a file or of an unknown feed
    give no row.  A block is ``LINES_PER_BLOCK`` lines; those before its first record start belong to the block before.
    """
    known = df.filter(F.col("feed").isin(*FEEDS) & F.col("file_name").isNotNull()).select("file_name", "feed", F.coalesce("line_no", F.lit(0)).cast("long").alias("line_no"), F.col("line_id").cast("long").alias("line_id"), "line")
    block = F.floor(F.col("line_no") / LINES_PER_BLOCK)
    marked = known.select("file_name", "feed", "line_no", block.alias("block"), _parse("line", "feed").alias("p"))
    sound = marked.filter(F.col("p.defect").isNull() | (F.col("p.defect") == "value"))
    first = sound.groupBy("file_name", "feed", "block").agg(F.min("line_no").alias("first"))
    placed = known.withColumn("block", block).join(first, ["file_name", "feed", "block"], "left")
    early = (F.col("line_no") < F.col("first")) & (F.col("block") > 0)
    placed = placed.withColumn("block", F.col("block") - early.cast("int")).drop("first")
    return placed.groupBy("file_name", "feed", "block").applyInArrow(lambda t: _block(t), "file_name string, feed string, line_no long, line_id long, n_lines int, defect string, at int, detail string, fields array<string>")
