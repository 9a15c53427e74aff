import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.llm import bpe
from accordant.llm.queries import vocabulary_path

P = pytest.importorskip("public_tokenizers")
PATH = vocabulary_path()


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    ids, counts = bpe.Encoder(PATH).batch(texts)
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts)]


def test_scan_composes_from_the_left():
    element, table, values, _ = bpe.monoid()
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 9, 5000)
    got = values[bpe.scan(element[symbols], table), bpe.START]
    state, want = bpe.START, []
    for c in symbols:
        state = bpe._step(state, c)[0]
        want.append(state)
    assert got.tolist() == want


def test_random_texts(library):
    random.seed(5)
    letters = "ab 's'd're'll 've't'm\n\t  \xa0 1²½é'S<|endoftext|>,.!?—你好́​\x1c\x85𝒳🙂ß　'"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    assert ours(texts) == library(texts)


@pytest.mark.parametrize("text", ["", " ", "\n\n", "a  ", "  a", "'", "''s", "don't we'll", "x" * 5000, "ab" * 30_000, " " * 4000 + "a", "\0\x01"])
def test_edges(library, text):
    assert ours([text, "", text]) == library([text, "", text])


def test_blocks_do_not_matter(monkeypatch):
    texts = ["one two", "", "three's", "four " * 20]
    want = ours(texts)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 5)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 2)
    assert ours(texts) == want


def test_merge_is_lowest_rank_first():
    rank = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"abc": 9}
    assert bpe.merge(b"abc", {**rank, b"abc": 9}) == [9]
    assert bpe.merge(b"abcab", rank) == [9, 4]


def test_frames(spark):
    schema = "doc_id long, text string, ids string, offsets string"
    df = spark.createDataFrame([(1, None, "x", None), (2, "", None, None), (3, "Hello, wörld 🙂", None, None), (3, "Hello, wörld 🙂", None, None)], schema)
    out = bpe.encode(df, "doc_id", PATH, offsets=True)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 4 and rows[1]["ids"] == [] and rows[2]["ids"] == []
    text = "Hello, wörld 🙂".encode()
    starts = rows[3]["offsets"] + [len(text)]
    tokens, _ = bpe._token_bytes(PATH)
    assert [text[a:b] for a, b in zip(starts, starts[1:])] == [tokens[i] for i in rows[3]["ids"]]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(out, "doc_id", PATH).collect()}
    assert back == {1: "", 2: "", 3: text.decode()}
    counts = bpe.count_tokens(df, ["doc_id"], PATH).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in counts)[:2] == [(1, 0), (2, 0)]
    assert bpe.encode(spark.createDataFrame([], schema), "doc_id", PATH).count() == 0
    assert bpe.decode(df.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), "doc_id", PATH).filter("text = ''").count() == 4
