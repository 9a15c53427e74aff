import gzip
import json

import pytest
from pyspark.sql import functions as F

from accordant.operators import neighbours
from accordant.sources import annotations, results, taxonomies

ICD = [
    "Foundation URI\tCode\tBlockId\tTitle\tClassKind\tGrouping1\tGrouping2\tGrouping3\tGrouping4\tGrouping5",
    "http://x/1\t\tB1\t- Block one\tblock\tT\t\t\t\t",
    'http://x/2\tA1\t\t"- - Cholera"\tcategory\tT\tB1\t\t\t',
    "http://x/3\tA1.0\t\t- - - Cholera, deep\tcategory\tT\tB1\t\t\t",
    "http://x/4\tA2.1\t\tLone\tcategory\tT\tB1\t\t\t",
    "http://x/5\t\t\tno code\tcategory\t\t\t\t\t",
]
MESH = """<Set>{}</Set>"""
RECORD = """<DescriptorRecord DescriptorClass="{cls}"><DescriptorUI>{ui}</DescriptorUI><DescriptorName><String>{name}</String></DescriptorName>
<TreeNumberList><TreeNumber>C01.2.3</TreeNumber><TreeNumber>C01.2.4</TreeNumber><TreeNumber>C09</TreeNumber></TreeNumberList>
<ConceptList><Concept PreferredConceptYN="Y"><TermList><Term RecordPreferredTermYN="Y"><String>{name}</String></Term>
<Term RecordPreferredTermYN="N"><String>other</String></Term><Term RecordPreferredTermYN="N"><String>{name}</String></Term></TermList></Concept>
<Concept PreferredConceptYN="N"><TermList><Term RecordPreferredTermYN="N"><String>narrow</String></Term></TermList></Concept></ConceptList></DescriptorRecord>"""


def test_icd11(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_bytes(b"\xef\xbb\xbf" + "\n".join(ICD).encode())
    rows = taxonomies.read_icd11(spark, str(path))
    assert rows.count() == 5
    parents = {(r["code"], r["parent"]) for r in taxonomies.icd11_parents(rows).collect()}
    assert parents == {("A1", "B1"), ("A1.0", "A1"), ("A2.1", "B1")}
    synonyms = spark.createDataFrame([("A1", ["the plague"]), ("A1.0", ["x", "y"]), ("A2.1", [])], "code string, synonyms array<string>")
    got = {r["code"]: r for r in taxonomies.icd11_concepts(rows, synonyms).collect()}
    assert set(got) == {"A1", "A1.0"} and got["A1"]["preferred_term"] == "Cholera" and got["A1.0"]["parent_codes"] == ["A1"] and got["A1"]["hierarchy_key"] == ["A1"]
    assert {(r["code"], r["title"]) for r in taxonomies.icd11_titles(rows).collect()} >= {("B1", "Block one"), ("A2.1", "Lone")}
    above = {(r["code"], r["parent"]) for r in taxonomies.icd11_above(rows).collect()}
    assert above == {("B1", "T")} | parents
    assert {(r["code"], r["entity"]) for r in taxonomies.icd11_codes(rows).collect()} == {("A1", "2"), ("A1.0", "3"), ("A2.1", "4")}
    df = spark.createDataFrame([([" a", "b", "a"], ["b", "", "c "]), (None, None)], "s array<string>, i array<string>")
    assert [r[0] for r in df.select(taxonomies.terms(F.col("s"), F.col("i"))).collect()] == [["a", "b", "c"], []]


def test_meddra(spark, tmp_path):
    (tmp_path / "llt.asc").write_text("1$low one$10$$$$$$$Y$$\n2$Top$10$$$$$$$Y$$\n3$old$10$$$$$$$N$$\n4$low$11$$$$$$$N$$\n")
    (tmp_path / "pt.asc").write_text("10$Top$$900$\n11$Other$$900$\n")
    (tmp_path / "link.asc").write_text("70$10$\n71$10$\n")
    llt, pt, link = (taxonomies.read_dollar(spark, str(tmp_path / f), c) for f, c in (("llt.asc", taxonomies.LLT), ("pt.asc", taxonomies.PT), ("link.asc", taxonomies.LINK)))
    r = taxonomies.meddra_concepts(pt, llt, link).collect()
    assert [(x["code"], x["synonyms"], x["parent_codes"], x["hierarchy_key"]) for x in r] == [("10", ["low one"], ["70", "71"], [])]
    assert taxonomies.meddra_titles(pt.select("pt_code", "pt_name"), link).count() == 4


def test_mesh(spark, tmp_path):
    path = tmp_path / "desc.xml"
    path.write_text(MESH.format(RECORD.format(cls=1, ui="D1", name="Fever") + RECORD.format(cls=3, ui="D2", name="Note")))
    r = taxonomies.mesh_concepts(spark, str(path)).collect()
    assert [(x["code"], x["preferred_term"], x["synonyms"], x["parent_codes"], x["hierarchy_key"]) for x in r] == [("D1", "Fever", ["other"], ["C01.2"], ["C01.2.3", "C01.2.4", "C09"])]


def test_derm(spark):
    schema = "row_id long, phash string, filename string, caption string, disease_label string, hierarchical_disease_label string, skin_concept string, archive string"
    rows = [
        (1, "h", "a/1", "One ", "Acne", "skin, Acne", "x, Y,x", "z"), (2, "h", "b/1", "one", None, None, "No visual concepts", "z"), (3, "h", "b/2", "two", "", None, " ", "z"),
        (4, "k", "a/2", "three", "no definitive diagnosis", None, None, "z"), (5, None, "a/3", "x", "A", None, None, "z"), (6, "h", "flat", "four", "B", None, None, "z"), (7, "h", "b/3", "  ", "B", "B", "q", "z"),
        (8, "h", "b/4", "five", "Acne", None, "q", "z"),
    ]
    df = spark.createDataFrame(rows, schema)
    r = annotations.derm1_concepts(df).collect()
    assert [(x["code"], x["preferred_term"], x["synonyms"], x["parent_codes"]) for x in r] == [("h", "One", ["two", "five"], ["skin"])]
    tags = {r["row_id"]: (r["d"], r["s"], r["b"]) for r in df.select("row_id", annotations.category("disease_label").alias("d"), annotations.category("skin_concept").alias("s"), annotations.category("both").alias("b")).collect()}
    assert tags[1] == (["acne"], ["x", "y"], ["disease_label:acne", "skin_concept:x", "skin_concept:y"])
    assert tags[2] == (None, None, None) and tags[4] == (None, None, None)
    got = annotations.derm1_annotations(df, "disease_label").collect()
    assert sorted((x["key"], x["source"], x["ord"]) for x in got) == [("h", "a", 1), ("h", "b", 8)]
    assert annotations.derm1_annotations(df.filter("false"), "both").count() == 0


def test_items(spark):
    rows = [("k", "c1", ["a"], "s", 2, 1), ("k", "c0", ["b"], "s", 1, 1), ("k", None, None, "t", 3, 1), ("m", "x", ["a"], "s", 1, 1), ("m", "y", ["a"], "s", 2, 1)]
    df = spark.createDataFrame(rows, "key string, caption string, category array<string>, source string, ord int, slot int")
    got = [(r["key"], r["slot"], r["source"], r["caption"]) for r in annotations.items(df).orderBy("slot").collect()]
    assert got == [("k", 0, "s", "c0"), ("k", 1, "t", None)]


def test_readings_and_descriptions(spark, tmp_path):
    schema = "id string, dicom_id string, eye_tracking_data_discarded string, `Edema` string, `Nodule` string, `Clear` string"
    one = spark.createDataFrame([("r1", "d1", "False", "3", "x", "True"), ("r2", "d1", "False", "0", "", "false"), ("r3", "d2", "True", "1", "1", None), ("r4", "d3", "False", "1", "1", None)], schema)
    texts = spark.createDataFrame([("r1", "first "), ("r2", "second"), ("r3", "x"), ("r4", " ")], "id string, text string")
    labels = {1: (["Edema", "Nodule"], ["Clear"]), 2: (["Edema"], [])}
    got = {(r["key"], r["source"]): (r["caption"], r["category"]) for r in annotations.reflacx_annotations({1: one}, texts, labels).collect()}
    assert got == {("d1", "r1"): ("first", ["clear", "edema"]), ("d1", "r2"): ("second", [])}
    with pytest.raises(ValueError):
        annotations.reflacx_annotations({1: one, 2: one}, texts, labels)
    rows = spark.createDataFrame([("p1_2.jpg", "a", " ", "b", None), ("p2_1.jpg", "a", None, None, None)], "img_path string, descr1 string, descr2 string, descr3 string, descr4 string")
    subjects = spark.createDataFrame([("p1", "Eczema", " Dry ")], "subject_id string, diagnosis string, conditions string")
    out = annotations.passion_annotations(rows, subjects).collect()
    assert sorted((r["key"], r["source"], r["category"]) for r in out) == [("p1_2.jpg", "descr1", ["dry", "eczema"]), ("p1_2.jpg", "descr3", ["dry", "eczema"])]
    (tmp_path / "h.csv").write_text("a/1,ff\nbroken\na/2,ee\n")
    assert annotations.hash_cache(spark, str(tmp_path / "h.csv")).count() == 2


KEYS = ("d", "set", "random", 0.5, 1)


def test_results_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(*KEYS, "nli", 0, [[0.1234567891, 0.5]]), (*KEYS, "nli", 1, [])], results.MATRIX_SCHEMA)
    results.write_matrices(m, str(tmp_path / "m"))
    with gzip.open(tmp_path / "m" / "torn.json.gz", "wt") as out:
        out.write(json.dumps({"dataset": "d", "measure": "nli", "cost": [[1.0]]}) + '\n{"dataset": "d", "cos')
    back = results.read_matrices(spark, str(tmp_path / "m"))
    assert back.count() == 3 and sorted(r["cost"] for r in back.collect())[1] == [[0.123457, 0.5]]
    costs = spark.createDataFrame([("nli", False, "a", "b", 0.2)], results.PAIR_SCHEMA)
    results.append_pair_costs(costs, str(tmp_path / "p"))
    results.append_pair_costs(costs.withColumn("cost", F.lit(0.9)), str(tmp_path / "p"))
    read = results.read_pair_costs(spark, str(tmp_path / "p"))
    assert read.count() == 2 and results.newest(read, ["measure", "reasoning", "x", "y"], "written_at").count() == 1
    assert results.fresh_costs(costs, read, ["measure", "x", "y"]).count() == 0
    p = spark.createDataFrame([(*KEYS, "nli", "self", True, 0, 1, 2, '["a, \\"x\\""]', '["b", "c"]', 0.5, False, "[[0, 1]]"), (*KEYS, "nli", None, None, 1, 1, 1, None, "[]", None, None, None)], results.PREDICTION_SCHEMA)
    results.write_table(p, str(tmp_path / "c"), "csv")
    again = results.read_predictions(spark, str(tmp_path / "c"))
    assert sorted(map(str, again.collect())) == sorted(map(str, p.collect()))
    assert results.read_predictions(spark, str(tmp_path / "c"), reasoning=True).count() == 1
    results.write_table(p, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2
    assert [results.output_suffix("set"), results.output_suffix("single", True, "x", True), results.output_suffix("set", chance="m")] == ["_uniform", "_draft_reasoning", "_uniform_chance-m"]


def test_costs_of_labels(spark):
    p = spark.createDataFrame(
        [(*KEYS, "nli_single", "self", True, 0, 1, 2, '["b"]', '["a", "b"]', 0.5, False, "[[0, 1]]", 1), (*KEYS, "nli_single", "self", True, 1, 1, 2, '["b"]', '["a", "b"]', 0.5, False, "[]", 2)],
        results.PREDICTION_SCHEMA + ", row_id long",
    )
    m = spark.createDataFrame([(*KEYS, "nli", 0, [[0.3, 0.0]], 1), (*KEYS, "nli", 0, [[0.4, 0.0]], 2), (*KEYS, "nli", 1, [[0.9]], 3), (*KEYS, "nli", 7, [[0.9]], 4), (*KEYS, "nli", 0, [], 5), (*KEYS, "nli", None, None, 6)], results.MATRIX_SCHEMA + ", row_id long")
    got = results.newest(results.matrix_costs(m, p, F.col("row_id")), ["measure", "x", "y"]).collect()
    assert sorted((r["measure"], r["x"], r["y"], r["cost"]) for r in got) == [("nli", "a", "b", 0.4), ("nli", "b", "b", 0.0)]
    same = p.withColumn("measure", F.lit("nli"))
    assert sorted(r["row_id"] for r in results.with_true_pairs(m, same).collect()) == [1, 2]
    assert {r["reason"]: r["n"] for r in results.unmatched_matrices(m, same).collect()} == {"used": 2, "shape_mismatch": 2, "unmatched": 2}


def test_true_pairs_go_by_measure_not_by_mode(spark):
    key = "dataset string, mode string, negative_mode string, measure string, agreement_level double, seed long, sample_index int"
    cost = spark.createDataFrame([("d", "set", "r", "m", 0.5, 1, 0, [[0.1]]), ("d", "set", "r", "n", 0.5, 1, 0, [[0.2]])], key + ", cost array<array<double>>")
    said = spark.createDataFrame([("d", "single", "r", "m", 0.5, 1, 0, "[[0, 0]]", 1)], key + ", true_assignment string, row_id long")
    got = results.with_true_pairs(cost, said).collect()
    assert [(r["measure"], [tuple(p) for p in r["truth"]]) for r in got] == [("m", [(0, 0)])]


def test_costs_of_matrices_and_pairs_are_one_history(spark):
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    key = ("d", "set", "r", 0.5, 1)
    p = spark.createDataFrame(
        [(*key, "nli", "self", False, 0, 1, 1, '["a"]', '["b"]', 0.5, False, "[]", 1), (*key, "nli", "self", True, 1, 1, 1, '["a"]', '["b"]', 0.5, False, "[]", 2)], results.PREDICTION_SCHEMA + ", row_id long"
    )
    m = spark.createDataFrame([(*key, "nli", 0, [[0.1]], day(2)), (*key, "nli", 1, [[0.9]], day(5))], results.MATRIX_SCHEMA + ", loaded_at timestamp")
    pairs = spark.createDataFrame(
        [("nli_single", False, "b", "a", 0.3, day(3)), ("nli", None, "a", "c", 0.4, day(1)), ("nli", True, "a", "c", 0.7, day(9)), ("nli", False, "a", "b", None, day(8))], results.PAIR_SCHEMA + ", written_at timestamp"
    )
    found = lambda **more: sorted((r["x"], r["y"], r["cost"]) for r in results.load_costs(m, p, **more).collect())
    assert found(pair_costs=pairs) == [("a", "b", 0.3), ("a", "c", 0.4)] and found() == [("a", "b", 0.1)]
    assert found(pair_costs=pairs, reasoning=True) == [("a", "b", 0.9), ("a", "c", 0.7)] and found(measures=["x"]) == []


def test_meddra_links_and_directions(spark):
    low = spark.createDataFrame([("G1", "H1"), ("G2", "H1"), ("G1", "H1"), ("", "H2"), ("G3", None), ("Q", "S")], "parent string, code string")
    high = spark.createDataFrame([("S1", "G1"), ("S2", "S")], "parent string, code string")
    got = sorted((r["code"], r["parent"]) for r in taxonomies.meddra_links(low, high).collect())
    assert got == [("G1", "S1"), ("H1", "G1"), ("H1", "G2"), ("S", "S2")]
    c = spark.createDataFrame([("A", "a", ["s"], ["k"], ["x"], 1), ("B", "b", ["t"], [], ["k"], 2)], "code string, preferred_term string, synonyms array<string>, parent_codes array<string>, hierarchy_key array<string>, ord int")
    edges = lambda way: [tuple(r) for r in neighbours.hierarchy_edges(c, way).collect()]
    assert edges("parent") == [("A", "B")] and edges("children") == [("B", "A")]
    with pytest.raises(ValueError):
        edges("up")


def test_members_and_hashes(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.jpg", "old", 1), ("y/a.jpg", None, 2), ("a.jpg", None, 3), ("z/b/c.jpg", None, 4), (None, None, 5)], "filename string, phash string, n int")
    got = {r["member"]: r["filename"] for r in annotations.wanted_members(rows).collect()}
    assert got == {"x/a.jpg": "x/a.jpg", "y/a.jpg": "y/a.jpg", "a.jpg": "a.jpg", "z/b/c.jpg": "z/b/c.jpg", "b/c.jpg": "z/b/c.jpg"}
    cache = spark.createDataFrame([("x/a.jpg", "p1"), ("x/a.jpg", "p0"), (None, "p9")], "filename string, phash string")
    assert {r["n"]: r["phash"] for r in annotations.with_hashes(rows, cache).collect()} == {1: "p1", 2: None, 3: None, 4: None, 5: None}
    annotations.append_hashes(spark.createDataFrame([("x/a.jpg", "q"), ("y/a.jpg", "r"), ("a.jpg", None)], "filename string, phash string"), cache, f"{tmp_path}/h")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/h", header=True).collect()] == [("y/a.jpg", "r")]


def test_a_crawl_goes_on(spark, tmp_path):
    codes = spark.createDataFrame([("A",), ("B",), (None,), ("B",)], "code string")
    taxonomies.append_synonyms(spark.createDataFrame([("A", None)], "code string, synonyms array<string>"), f"{tmp_path}/s")
    done = spark.read.schema("code string, synonyms array<string>").json(f"{tmp_path}/s")
    assert [tuple(r) for r in done.collect()] == [("A", [])]
    assert [r["code"] for r in taxonomies.open_codes(codes, done).collect()] == ["B"]
