import os
import random
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from accordant.llm import spans
from accordant.llm.windows import code_points, sliding_argmin, window_hashes, winnow

SCHEMA = "doc_id long, text string, at timestamp_ntz, a long, b long, rep string, n_chars string"


def test_argmin_is_the_rightmost_smallest():
    x = np.random.default_rng(0).integers(0, 3, 700).astype(np.uint32)
    for k, w in ((7, 10), (1, 1), (3, 100), (5, 693)):
        h = window_hashes(x, k)
        got = sliding_argmin(h, w)
        assert len(got) == max(0, len(h) - w + 1)
        for j, g in enumerate(got):
            part = h[j : j + w]
            assert g == j + np.flatnonzero(part == part.min())[-1]


def test_hash_depends_on_the_window_only():
    a, b = code_points("xxhello worldyy"), code_points("hello world")
    assert window_hashes(a, 5)[2:9].tolist() == window_hashes(b, 5).tolist()
    assert len(window_hashes(b, 99)) == 0


def test_windows_stay_within_a_text():
    texts = ["a" * 250, "b" * 10, "", "c" * 200]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, pos, _ = winnow(code_points("".join(texts)), starts, spans.GRAM, spans.WINDOW)
    assert set(text) == {0, 3} and pos.min() >= 0


def corpus(rng, n):
    """Texts of a small alphabet with planted common passages of 199 to 600 characters, copies and runs of one letter."""
    make = lambda size: "".join(rng.choice("abcdé🙂 ") for _ in range(size))
    passages = [make(k) for k in (199, 200, 201, 320, 600)]
    texts = []
    for _ in range(n):
        t = make(rng.randint(0, 500))
        for p in rng.sample(passages, rng.choice([0, 0, 1, 2])):
            t += p + make(rng.randint(0, 150))
        texts.append(t)
    return texts + [texts[3], texts[3], "z" * 260, "z" * 230, "y" + "z" * 199, None, "", texts[0][:50]]


def brute(texts):
    have = {i: {t[k : k + 200] for k in range(len(t) - 199)} for i, t in enumerate(texts) if t}
    pairs = {(i, j) for i, j in combinations(sorted(have), 2) if have[i] & have[j]}
    covered = {}
    for i, t in enumerate(texts):
        hit = np.zeros(len(t or ""), bool)
        for k in range(len(hit) - 199):
            if any(t[k : k + 200] in have[j] for j in have if j != i):
                hit[k : k + 200] = True
        covered[i] = int(hit.sum())
    return pairs, covered


@pytest.fixture(params=[200, 1])
def hot(request, monkeypatch):
    monkeypatch.setattr(spans, "HOT", request.param)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_coverage(spark, hot, seed):
    rng = random.Random(seed)
    texts = corpus(rng, 40)
    rows = [(i, t, datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 99)) if rng.random() < 0.9 else None, 1, 2, "r", "n") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs, covered = brute(texts)
    got = [(r["doc_id_a"], r["doc_id_b"]) for r in spans.SharedSpans(df, F.col("at")).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    out = spans.SharedSpans(df, F.col("at"), every=True).coverage().collect()
    assert {r["doc_id"]: r["shared_chars"] for r in out} == {i: covered[i] for i, t in enumerate(texts) if t and len(t) >= 200}


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spans.SharedSpans(empty, F.col("at")).pairs().count() == 0
    one = spark.createDataFrame([(1, "q" * 999, None, 0, 0, None, None)], SCHEMA)
    assert spans.SharedSpans(one, F.col("at")).pairs().count() == 0
    assert spans.SharedSpans(one, F.col("at"), every=True).coverage().first()["shared_chars"] == 0


def files(folder, run):
    return [f for f in os.listdir(f"{folder}/{run}") if f.endswith(".parquet")]


def test_runs_are_compacted(spark, tmp_path):
    index = spans.Index(spark, f"file://{tmp_path}/i", buckets=2)
    texts = corpus(random.Random(7), 12)
    for k in range(4):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if i % 4 == k], "doc_id long, text string")
        index.add(spans.fingerprints(docs))
        index.compact()
        assert all(len(files(f"{tmp_path}/i", run)) <= index.buckets for _, run in index.runs)
    assert [level for level, _ in index.runs] == [2] and len([d for d in os.listdir(tmp_path / "i") if d.startswith("run-")]) == 1
    total = index._read(index.runs[0]).count()
    assert total == spans.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    hashes = index._read(index.runs[0])
    plan = hashes.alias("x").hint("merge").join(hashes.alias("y"), "h")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Sort [" not in plan and "Exchange" not in plan
    index.close(delete=True)
    assert index.runs == [] and not os.path.exists(tmp_path / "i")


def test_an_index_goes_on_where_it_was_left(spark, hot, tmp_path):
    texts = corpus(random.Random(3), 24)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").filter("length(text) >= 200")
    found = set()
    for k in range(3):
        index = spans.Index(spark, f"file://{tmp_path}/i", buckets=3)  # as a later session would
        assert index.version >= k
        batch = docs.filter(F.col("doc_id") % 3 == k)
        got = [(r["a"], r["b"]) for r in index.links(batch, docs.filter(F.col("doc_id") % 3 <= k)).collect()]
        assert len(got) == len(set(got)) and not found & set(got)
        found |= set(got)
        index.compact()
        index.close()
    assert found == brute(texts)[0]
