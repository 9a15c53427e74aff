import numpy as np
import pytest

from accordant.llm import consensus
from accordant.llm.consensus import Consensus, triplets
from accordant.llm.labels import Vocabulary, distance, guesses, vocabulary

SCHEMA = "tbl string, item string, annotator string, kind string, term int, n int, share double, mix double"


def votes(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.0, 0.0) for r in rows], SCHEMA)


def test_triplets_recover_accuracies():
    r = np.array([0.9, 0.8, 0.5, 0.3])
    a = np.outer(r, r)
    n = np.full((4, 4), 100.0)
    np.fill_diagonal(n, 0)
    for i in range(4):
        assert triplets(a[i], n[i], a, n)[0] == pytest.approx(r[i])
    assert np.isnan(triplets(a[0], np.zeros(4), a, n)[0])


def test_recovery_of_labels_and_reliability(spark):
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 8, 600)
    skill = {"a": 0.95, "b": 0.9, "c": 0.85, "d": 0.3, "e": 0.3, "f": 0.3, "g": 0.0}
    rows = []
    for i, t in enumerate(truth):
        for who, p in skill.items():
            if rng.random() < 0.8:
                if who == "f" and rng.random() < 0.9:
                    said = t ^ 1  # mixes up neighbours
                else:
                    said = t if rng.random() < p else rng.integers(0, 8)
                rows.append(("t", str(i), who, "sure", int(said)))
    c = Consensus(votes(spark, rows))
    got = {int(r["item"]): r["term"] for r in c.labels().collect()}
    accuracy = np.mean([got[i] == truth[i] for i in got])
    plain = np.mean([np.bincount([v[4] for v in rows if v[1] == str(i)]).argmax() == truth[i] for i in range(600)])
    assert accuracy > 0.97 and accuracy > plain
    r = {x["annotator"]: x["reliability"] for x in c.reliability.collect()}
    assert all(abs(r[k] - skill[k]) < 0.1 for k in "abcdeg")
    assert {r["truth"]: r["partner"] for r in c.partners.collect()} == {k: k ^ 1 for k in range(8)}


def test_annotators_beyond_the_anchors(spark, monkeypatch):
    """Who meets no anchor is rated from those who do, however long the chain; who meets nobody gets the mean."""
    monkeypatch.setattr(consensus, "ANCHORS", 3)
    rng = np.random.default_rng(5)
    rows = []

    def read(items, **skill):
        for i in items:
            for who, p in skill.items():
                rows.append(("t", str(i), who, "sure", int(i % 6 if rng.random() < p else rng.integers(0, 6))))

    read(range(0, 900), a=0.9, b=0.9, c=0.8)
    read(range(700, 900), d=0.7)
    read(range(900, 1200), d=0.7, e=0.9, f=0.2)
    read(range(1200, 1400), e=0.9, g=0.6)
    read(range(2000, 2010), lonely=0.9)
    r = {x["annotator"]: x["reliability"] for x in Consensus(votes(spark, rows)).reliability.collect()}
    assert all(abs(r[k] - p) < 0.12 for k, p in dict(a=0.9, b=0.9, c=0.8, d=0.7, e=0.9, f=0.2, g=0.6).items())
    assert 0.5 < r["lonely"] < 0.9


def test_doubtful_kinds_count_in_part(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        for who in "abcd":
            rows.append(("t", str(i), who, "sure", int(i % 5)))
        rows.append(("t", str(i), "e", "first", int(i % 5 if rng.random() < 0.6 else (i + 1) % 5)))
    c = Consensus(votes(spark, rows))
    assert 0.35 < c.fractions["first"] <= 1.0
    assert {r["term"] for r in c.labels().filter("item = '3'").collect()} == {3}


def test_edges(spark):
    c = Consensus(votes(spark, []))
    assert c.labels().count() == 0 and c.reliability.count() == 0
    rows = [("t", "1", "a", "sure", 2), ("t", "1", "b", "sure", 1), ("t", "2", None, "sure", 1), ("t", "3", "a", "sure", None), ("t", None, "a", "sure", 1), ("t", "1", "a", "sure", 2)]
    got = {r["item"]: r for r in Consensus(votes(spark, rows)).labels().collect()}
    assert set(got) == {"1", "2"} and got["2"]["term"] == 1 and got["2"]["agreement"] is None and got["1"]["agreement"] == 0.0


def test_vocabulary(spark):
    df = spark.createDataFrame([(1, "steilonevoid keratosis", ["SAK5", "keratosis, steilonevoid"], "x"), (2, "cruilobuloma", None, "y"), (3, None, ["rash", None], "z")], "term_id int, preferred_term string, variants array<string>, extra string")
    words, names = vocabulary(df)
    assert names == {1: "steilonevoid keratosis", 2: "cruilobuloma", 3: None}
    for text, term in [(" Steilonevoid_keratosis.", 1), ("sak5", 1), ("SAK6", None), ("cruilbuloma", 2), ("cruiloubloma", 2), ("keratosis,-steilonevoid", 1), ("", None), (None, None), ("x" * 5000, None), ("rash", 3)]:
        assert words.label(text) == term
    for text, term in [("Not rash but cruilobuloma.", 2), ("Shown is SAK5, no sign of rash.", 1), ("keratosis, steilonevoid rather than cruilobuloma; 4 mm", 1), ("no rash", None), (None, None), ("a " * 20_000, None), ("no sign of" + " " * 90 + "rash", None), ("not: rash", 3), ("x" * 60 + " no rash, cruilobuloma", 2)]:
        assert words.caption(text) == term


def test_near_ties_are_unknown():
    words = Vocabulary({"abcdefg": 1, "abcdefh": 2})
    assert words.label("abcdefi") is None and words.label("abcdefgg") == 1
    assert distance("kitten", "sitting", 5) == 3 and distance("a", "abcdef", 2) == 3


def test_guesses():
    words = Vocabulary({"one": 1, "two": 2, "three": 3})
    assert guesses(["one"], None, words) == [("sure", 1)]
    assert guesses(["one", None, "two", "ONE"], None, words) == [("first", 1), ("later", 2)]
    assert guesses(["one", "two"], "it is two", words) == [("sure", 2), ("besides", 1)]
    assert guesses(None, "three", words) == [("sure", 3)] and guesses([], "", words) == []
