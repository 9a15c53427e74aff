import os

import pytest

from accordant.llm import queries

WHERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(WHERE), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs(spark, name):
    df = queries.QUERIES[name](spark, WHERE)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_given_columns(spark):
    want = {
        "p1_found": [("tbl", "string"), ("item", "string"), ("consensus", "string")],
        "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p8_found": [("doc_id_a", "bigint"), ("doc_id_b", "bigint")],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, WHERE).dtypes == columns


def test_ids_are_those_of_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{WHERE}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["ids"] for r in queries.p6_ids(spark, WHERE).collect()}
    assert got == {i: t.encode(text, add_special_tokens=False).ids for i, text in docs.items()}
