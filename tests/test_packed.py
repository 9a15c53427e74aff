import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.operators import packed
from accordant.operators.packed import freedom, regularity, split_values

USUAL = (",", ";", "|", "->", ">", " / ", "newline", "tab", "»", "，", "；", "、")


@pytest.mark.parametrize(
    ("text", "values"),
    [
        (None, []),
        ("  \t ", []),
        ("a, b;c|d", ["a", "b", "c", "d"]),
        ("a -> b > c » d", ["a", "b", "c", "d"]),
        ("a / b/c", ["a", "b/c"]),
        ("a\nb\tc，d；e、f", ["a", "b", "c", "d", "e", "f"]),
        ("a,,b,", ["a", "b"]),
        ("[a, b]", ["a", "b"]),
        ("['x', \"it's y\"]", ["x", "it's y"]),
        ('["so \\"h\\" p", "q"]', ['so "h" p', "q"]),
        ('"so ""h"" p";"a; b"', ['so "h" p', "a; b"]),
        ("'the \"coin\", large' | b", ['the "coin", large', "b"]),
        ("halo (a | b), c", ["halo (a | b)", "c"]),
        ("cat's-paw, dog's", ["cat's-paw", "dog's"]),
        ("a (b, c", ["a (b", "c"]),
        ('"open, b', ['"open', "b"]),
        (" x　,y", ["x", "y"]),
        ("'' , \"\"", []),
        ("(" * 2000 + "a, b", ["(" * 2000 + "a", "b"]),
    ],
)
def test_split(text, values):
    assert split_values(text, USUAL) == values


def test_delimiters_are_told_from_marks_within_values(spark):
    rng = np.random.default_rng(1)
    words = ["salt & pepper", "crust", "scale", "grade 2+ oedema", "flat-topped", "ulcer"]
    rows = [(f"s/{i}", sep.join(rng.choice(words, rng.integers(1, 6)))) for i, sep in enumerate(rng.choice([";", ", ", " / "], 400))]
    df = spark.createDataFrame(rows, "filename string, f string")
    found = packed.infer_delimiters(df.select(packed.source_of(F.col("filename")).alias("source"), "f"), ["f"]).first()
    assert {",", ";", " / "} <= set(found["delimiters"]) and not {"&", "+", "-"} & set(found["delimiters"])


def test_a_constant_neighbour_is_not_free():
    cells = np.zeros((packed.CELLS, packed.CELLS))
    cells[0, 3] = 1000
    assert freedom(cells) == 0.0
    assert freedom(np.diag(np.full(packed.CELLS, 100.0))) < 0.05
    assert freedom(np.full((packed.CELLS, packed.CELLS), 100.0)) > 0.95
    assert regularity(np.array([5, 0]), np.array([0, 9])) == 0.0 and regularity(np.array([4, 4]), np.array([9, 9])) == 1.0


def planted(rng, n):
    """Four sources: ; between values with commas, commas, &, and commas between values with an & of their own."""
    thick = ["plaque, thick", "papule, red", "scale, fine", "crust, dry", "ulcer, deep", "patch, pale", "nodule, firm"]
    plain = ["plaque", "papule", "scale", "crust", "ulcer", "patch", "nodule", "wheal"]
    joined = ["salt & pepper", "crust", "scale", "ulcer", "black & tan rim", "wheal", "patch"]
    out = []
    for source, words, sep in (("a", thick, "; "), ("b", plain, ", "), ("c", plain, " & "), ("d", joined, ", ")):
        for i in range(n):
            values = [str(v) for v in rng.choice(words, rng.integers(1, 6))]
            out.append((len(out), f"{source}/{i}", sep.join(values), values))
    return out


@pytest.mark.parametrize("n", [60, 150, 400])
def test_delimiters_come_out_by_source(spark, n):
    rows = planted(np.random.default_rng(n), n)
    df = spark.createDataFrame(rows, "row_id long, filename string, f string, want array<string>")
    source = packed.source_of(F.col("filename"))
    found = {r["source"]: r["delimiters"] for r in packed.infer_delimiters(df.select(source.alias("source"), "f"), ["f"]).collect()}
    assert found == {"a": [";"], "b": [","], "c": ["&"], "d": [","]}
    got = packed.unpack(df, "row_id", ["f"], source).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", "val"))).alias("x"))
    wrong = df.join(got, "row_id").filter(F.col("want") != F.col("x.val"))
    assert wrong.count() == 0 and got.count() == len(rows)


def test_without_inference_the_values_differ(spark):
    rows = planted(np.random.default_rng(2), 150)
    assert sum(split_values(text, USUAL) != want for _, _, text, want in rows) > len(rows) / 4


def test_a_joint_in_some_words_is_no_delimiter(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in ("acra", "pela", "vesi", "dermo", "stea") for b in ("oma", "itis", "emia", "osis")]
    rows = []
    for i in range(600):
        values = [str(v) for v in rng.choice(words, rng.integers(2, 6))]
        if i % 15 == 0:
            values[-1] += "-" + str(rng.choice(words))
        rows.append((f"s/{i}", " > ".join(values)))
    df = spark.createDataFrame(rows, "filename string, f string")
    assert packed.infer_delimiters(df.select(packed.source_of(F.col("filename")).alias("source"), "f"), ["f"]).first()["delimiters"] == [">"]


@pytest.mark.parametrize("text", ["a, b;c", " x　,y", "[a, b]", "[ ]", "[", "]", "\x1fa\xa0; b\x85", "a\r\nb\tc", "a / b/c", "/ a /", ",;,", "a,\\b", "x" * 50_000 + ",y", "a -> b>c"])
def test_both_ways_of_splitting_agree(spark, text):
    row = spark.createDataFrame([(text, list(USUAL), packed.jvm_pattern(list(USUAL)))], "t string, d array<string>, p string")
    assert row.select(packed.values(F.col("t"), F.col("d"), F.col("p"))).first()[0] == split_values(text, USUAL)


def test_unpack_edge_rows(spark):
    schema = "row_id long, filename string, skin string, other string, source string, key string, val int, pos int"
    rows = [
        (1, "a/x", "b;a; b", None, "p", "q", 1, 1),
        (1, "a/x", "b;a; b", None, "p", "q", 1, 1),
        (2, None, "No Visual Concepts ", "", "p", "q", 1, 1),
        (3, "x", None, "[z]", None, None, None, None),
        (4, "a/y", "w, " * 5000, "  ", None, None, None, None),
    ]
    words = ["a", "b", "c", "d"]  # what the source looks like otherwise
    rows += [(100 + i, "a/z", f"{words[i % 4]};{words[i // 4 % 4]};{words[i // 16]}, {words[(i + 1) % 4]}, {words[i // 4 % 4]}", None, None, None, None, None) for i in range(64)]
    out = packed.unpack(spark.createDataFrame(rows, schema), "row_id", ["skin", "other"], packed.source_of(F.col("filename")), {"skin": "no visual concepts"})
    assert out.columns == ["row_id", "field_name", "pos", "val"]
    got = out.collect()
    one = sorted((r["pos"], r["val"]) for r in got if r["row_id"] == 1)
    assert one == [(1, "b"), (1, "b"), (2, "a"), (2, "a"), (3, "b"), (3, "b")]
    assert [r for r in got if r["row_id"] == 2] == []
    assert [(r["field_name"], r["val"]) for r in got if r["row_id"] == 3] == [("other", "z")]
    assert sum(r["row_id"] == 4 for r in got) == 5000
    empty = spark.createDataFrame([], schema)
    assert packed.unpack(empty, "row_id", ["skin"], F.col("filename")).count() == 0
