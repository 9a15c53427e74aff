import pytest
from pyspark.sql import functions as F

from accordant.llm.flow import Network
from accordant.llm.mixing import Mix, solve, source_key
from accordant.llm.queries import vocabulary_path

PATH = vocabulary_path()
DOCS = "doc_id long, text string, source string, n_tokens long, uses long, pattern string, p int"


def test_flow_is_largest_and_cheapest():
    net = Network()
    s, a, b, t = (net.node() for _ in range(4))
    cheap, dear = net.arc(s, a, 3, 0), net.arc(s, b, 3, 5)
    net.arc(a, t, 4), net.arc(b, t, 1), net.arc(b, a, 2, 1)
    assert net.run(s, t) == (5, 0 * 3 + 5 + 6)
    assert (net.flow(cheap), net.flow(dear)) == (3, 2)


def test_repeats_only_where_needed():
    patterns, weights, uses = {("a",): 100, ("b",): 10, ("a", "b"): 5}, {"a": 0.5, "b": 0.5}, {("a",): 2, ("b",): 3, ("a", "b"): 2}
    total, plan = solve(patterns, weights, uses, None)
    assert total == 81  # b: 3 * 10 + 2 * 5 = 40 and a rounding of one
    assert sum(n for p, k, cut in plan for s, n in cut.items() if s == "b") == 40
    assert all(k == 1 for p, k, cut in plan if p == ("a",))
    total, plan = solve(patterns, weights, uses, 20)
    assert {k for _, k, _ in plan} == {1}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "x", 0) for r in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


def test_shares_caps_and_overlap(spark):
    rows = [(i, f"text number {i} of the large source, quite long", "Big One" if i % 3 else " big-one") for i in range(900)]
    rows += [(1000 + i, f"small {i}", "small") for i in range(40)] + [(2000 + i, f"small {i}", "big_one") for i in range(10)]
    rows += [(3000, None, "small"), (3001, "", "small"), (3002, "lost", None), (3003, "lost too", "elsewhere"), (3004, "zero", "nothing")]
    aims = targets(spark, [("big_one", 3.0, 1), ("small", 1.0, 4), ("absent", 1.0, 2), ("nothing", 0.0, 5), ("bad", None, None)])
    mix = Mix(frame(spark, rows), aims, PATH)
    got = mix.selection().collect()
    by_text = {}
    text = {r[0]: r[1] for r in rows}
    for r in got:
        by_text[text[r["doc_id"]]] = by_text.get(text[r["doc_id"]], 0) + r["uses"]
    assert max(n for t, n in by_text.items() if t.startswith("text")) == 1
    both = {f"small {i}" for i in range(10)}
    assert all(n <= (1 if t in both else 4) for t, n in by_text.items() if t.startswith("small"))
    report = {r["source"]: r for r in mix.report().collect()}
    assert report["big_one"]["share"] == pytest.approx(0.75, abs=0.03) and report["small"]["share"] == pytest.approx(0.25, abs=0.03)
    assert report["absent"]["n_uses"] == 0 and report["nothing"]["n_uses"] == 0 and report["small"]["n_uses"] > report["small"]["n_texts"]
    again = Mix(frame(spark, rows[::-1]), aims, PATH).selection()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    other = Mix(frame(spark, rows), aims, PATH, total=400, seed=9)
    assert sum(r["n_tokens"] for r in other.report().collect()) == pytest.approx(400, abs=40)


def test_the_total_is_that_of_a_search():
    import random

    from accordant.llm import mixing

    rng = random.Random(8)
    for _ in range(40):
        names = "abcde"[: rng.randint(1, 5)]
        patterns = {tuple(sorted(rng.sample(names, rng.randint(1, len(names))))): rng.randint(1, 60) for _ in range(rng.randint(1, 7))}
        present = {s for p in patterns for s in p}
        raw = {s: rng.random() + 0.05 for s in sorted(present)}
        weights = {s: w / sum(raw.values()) for s, w in raw.items()}
        uses = {p: rng.randint(1, 3) for p in patterns}
        total, plan = solve(patterns, weights, uses, None)
        reached = lambda t: sum(n for _, _, cut in solve(patterns, weights, uses, t)[1] for n in cut.values()) == sum(int(t * w) for w in weights.values())
        assert reached(total) and not any(reached(t) for t in range(total + 1, total + 4))
        for p, k, cut in plan:
            assert sum(cut.values()) <= patterns[p] and k <= uses[p]


def test_long_texts_do_not_overshoot(spark):
    words = "lesion border pigment network scale crust "
    rows = [(i, f"{i} " + words * 200, "long") for i in range(12)] + [(100 + i, f"{i} " + words * (i % 9), "long") for i in range(200)]
    rows += [(1000 + i, f"short text {i} " + words, "short") for i in range(400)]
    mix = Mix(frame(spark, rows), targets(spark, [("long", 1.0, 1), ("short", 2.0, 1), ("none", 7.0, 1)]), PATH)
    report = {r["source"]: r for r in mix.report().collect()}
    for s, share in (("long", 1 / 3), ("short", 2 / 3), ("none", 0.0)):
        assert report[s]["target_share"] == pytest.approx(share) and report[s]["share"] == pytest.approx(share, abs=0.003)


def test_more_patterns_than_the_graph_takes(spark, monkeypatch):
    from accordant.llm import mixing

    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    names = ["a", "b", "c"]
    rows = [(i * 3 + j, f"text {i}", s) for i in range(60) for j, s in enumerate(names[: 1 + i % 3])] + [(900 + i, f"own {i}", "c") for i in range(30)]
    mix = Mix(frame(spark, rows), targets(spark, [("a", 1.0, 3), ("b", 1.0, 2), ("c", 1.0, 1)]), PATH)
    got = mix.selection().collect()
    text = {r[0]: r[1] for r in rows}
    uses = {}
    for r in got:
        uses[text[r["doc_id"]]] = uses.get(text[r["doc_id"]], 0) + r["uses"]
    strictest = {t: min({"a": 3, "b": 2, "c": 1}[s] for _, t2, s in rows if t2 == t) for t in uses}
    assert got and all(n <= strictest[t] for t, n in uses.items())
    assert {r["source"] for r in mix.report().collect() if r["n_uses"]} == {"a", "b", "c"}


def test_empty(spark):
    aims = targets(spark, [("a", 1.0, 1)])
    assert Mix(frame(spark, []), aims, PATH).selection().count() == 0
    assert [r["share"] for r in Mix(frame(spark, []), aims, PATH).report().collect()] == [0.0]
    assert Mix(frame(spark, [(1, "x", "a")]), targets(spark, []), PATH).selection().count() == 0


def test_source_names(spark):
    df = spark.createDataFrame([(" Derm-Caption\t",), ("derm  caption",), ("DERM_CAPTION",), (" ",), (None,)], "s string")
    assert [r[0] for r in df.select(source_key(F.col("s"))).collect()] == ["derm_caption"] * 3 + [None, None]
