import random

import pytest

from accordant.operators import parsing
from accordant.operators.parsing import FEEDS, ICD11, PREDICTIONS, Parser, parse_line, parse_lines, typed_records

GOOD = 'http://x/1\tAB1.2\t\t"- a ""b"" c"\tcategory\tB1\t\t\t\t'
PRED = 'icd11,set,random,0.5,7,nli,self,True,3,1,2,"[""a""]","[""b"", ""c \\""d\\""""]",0.25'


def icd(code="AB1", title="t", kind="category"):
    return f"http://x/1\t{code}\t\t{title}\t{kind}\t\t\t\t\t"


def pred(a='"[""a""]"', b="[]", index="3", distance="0.5"):
    return f"icd11,set,random,0.5,7,nli,self,True,{index},1,2,{a},{b},{distance}"


@pytest.mark.parametrize(
    ("line", "feed", "defect"),
    [
        (GOOD, "icd11", None),
        ("﻿" + GOOD + "\r", "icd11", None),
        (icd(title='"a\nb\tc"'), "icd11", None),
        (icd(title='"open'), "icd11", "quoting"),
        (icd(title='a"b'), "icd11", "quoting"),
        (icd(title='"a"b'), "icd11", "quoting"),
        (icd(title=' "a"'), "icd11", "quoting"),
        ("", "icd11", "columns"),
        ("a\tb", "icd11", "columns"),
        (GOOD + "\t", "icd11", "columns"),
        (icd() + "\n" + icd(), "icd11", "columns"),
        (icd(kind="Category"), "icd11", "value"),
        (icd(code=""), "icd11", "value"),
        (icd(code="", kind="block"), "icd11", None),
        (icd(code="A..B"), "icd11", "value"),
        (icd(code="a1"), "icd11", "value"),
        (icd(code="JGUЕ"), "icd11", "value"),
        (icd(title="- -"), "icd11", "value"),
        (icd(title=" "), "icd11", "value"),
        (icd(title="a�"), "icd11", "value"),
        (icd(title="a\x07"), "icd11", "value"),
        (PRED, "predictions", None),
        (pred(distance="1.0\r"), "predictions", None),
        (pred(distance="1.01"), "predictions", "value"),
        (pred(distance="1e-3"), "predictions", "value"),
        (pred(distance=""), "predictions", "value"),
        (pred(index="-3"), "predictions", "value"),
        (pred(index="٣"), "predictions", "value"),
        (pred(a='"[""""]"'), "predictions", "value"),
        (pred(a='"[""x"", null]"'), "predictions", "value"),
        (pred(a="{}"), "predictions", "value"),
        (pred(a='"[['), "predictions", "quoting"),
        (pred(a='"' + "[" * 100_000 + '"'), "predictions", "value"),
    ],
)
def test_first_defect(line, feed, defect):
    assert parse_line(line, FEEDS[feed]).defect == defect


def test_errors_are_located():
    bad = parse_line(icd(title='a"b'), ICD11)
    assert (bad.at, bad.detail) == (icd(title='a"b').index('"'), "a quote within an unquoted field")
    assert parse_line(icd(code=""), ICD11).detail == "Code"


def test_recovery_at_the_next_sound_record():
    text = "\n".join([icd(code="A1"), icd(code="A2", title='"open'), icd(code="A3", title='"x\ny"'), "junk", icd(code="A4")])
    got = [(r.defect, r.fields[1] if r.fields and len(r.fields) > 1 else None) for r in Parser(text, ICD11).records()]
    assert got == [(None, "A1"), ("quoting", None), (None, "A3"), ("columns", None), (None, "A4")]


def test_a_quote_that_closes_in_a_later_record_costs_one_record():
    text = "\n".join([pred(a='"open'), pred(), pred()])
    assert [r.defect for r in Parser(text, PREDICTIONS).records()] == ["quoting", None, None]


def test_lines_of_a_table(spark):
    schema = "line_id long, feed string, line string, defect string, fields string"
    rows = [(1, "icd11", GOOD, "x", "y"), (1, "icd11", GOOD, "x", "y"), (2, "predictions", PRED, None, None), (3, "icd11", None, None, None), (4, None, "x", None, None), (5, "other", "x", None, None)]
    parsed = parse_lines(spark.createDataFrame(rows, schema), ["line_id"])
    assert sorted((r["line_id"], r["defect"]) for r in parsed.collect() if r["defect"]) == [(3, "columns"), (4, "feed"), (5, "feed")]
    r = typed_records(parsed, ["line_id"], PREDICTIONS).first()
    assert (r["seed"], r["reasoning"], r["rater_b"], r["distance"]) == (7, True, ["b", 'c "d"'], 0.25)
    titles = [r["Title"] for r in typed_records(parsed, ["line_id"], ICD11).collect()]
    assert titles == ['- a "b" c'] * 2
    assert parse_lines(spark.createDataFrame([], schema), ["line_id"]).count() == 0


def lines(spark, texts, file="f", feed="icd11", start=1):
    return spark.createDataFrame([(file, feed, i, 100 + i, t, "x") for i, t in enumerate(texts, start)], "file_name string, feed string, line_no int, line_id long, line string, defect string")


def test_records_of_files(spark):
    broken = GOOD.replace("\t", '\t"oops ', 1)  # a quote that runs on into the lines behind
    half = GOOD.split("\t")
    half[3] = '"one ""title""\non two lines"'
    spans = "\t".join(half).split("\n")
    df = lines(spark, [GOOD, broken, GOOD, GOOD, *spans, GOOD, "a\tb", GOOD])
    got = [(r["line_no"], r["n_lines"], r["defect"]) for r in parsing.recover(df).orderBy("line_no").collect()]
    assert got == [(1, 1, None), (2, 1, "quoting"), (3, 1, None), (4, 1, None), (5, 2, None), (7, 1, None), (8, 1, "columns"), (9, 1, None)]


def test_without_resumption_records_are_lost(spark, monkeypatch):
    broken = GOOD.replace("\t", '\t"oops ', 1)
    table = lines(spark, [GOOD, broken, GOOD, GOOD]).toArrow()
    assert parsing._block(table).num_rows == 4
    monkeypatch.setattr(Parser, "resume", lambda self, start: len(self.text))
    assert parsing._block(table).num_rows == 2


def test_blocks_give_what_whole_files_give(spark, monkeypatch):
    rng = random.Random(4)
    broken = GOOD.replace("\t", '\t"oops ', 1)
    texts = rng.choices([GOOD, GOOD + "\r\n", broken, "", "a\tb", "\ufeff" + GOOD, None], [8, 2, 1, 1, 1, 1, 1], k=300)
    df = lines(spark, texts).unionByName(lines(spark, [GOOD] * 3, "g")).unionByName(lines(spark, [GOOD], "h", "other")).unionByName(lines(spark, [GOOD], None))
    shape = lambda out: sorted((r["file_name"], r["line_no"], r["n_lines"], r["defect"] or "", r["at"] or 0) for r in out.collect())
    whole = shape(parsing.recover(df))
    monkeypatch.setattr(parsing, "LINES_PER_BLOCK", 7)
    assert shape(parsing.recover(df)) == whole and {f for f, *_ in whole} == {"f", "g"}
    assert sum(n for f, _, n, *_ in whole if f == "f") == 300
    assert parsing.recover(df.filter("false")).count() == 0
