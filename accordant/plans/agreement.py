"""The agreement operators over this project's tables, and the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordant.functions import distances
from accordant.functions.text import label_set, words
from accordant.operators import ablation, agreement, chance, distribution, matching, measures, neighbours, summaries, synthetic
from accordant.plans import experiments
from accordant.plans.quality import table
from accordant.sources import annotations, results, taxonomies
from accordant.storage import written
from accordant.streaming.agreement import windowed_agreement


def _pairs(spark: SparkSession, where: str) -> DataFrame:
    rows = table(spark, where, "rater_pairs")
    return rows.select("row_id", "item_id", "pass_no", "loaded_at", label_set(F.col("rater_a")).alias("a"), label_set(F.col("rater_b")).alias("b"))


#: Added before rounding on both sides, so that means of decimal fractions never end in an exact half.
OFF_HALF = 3.7e-11


def _rounded(c, n: int = 9):
    return F.round(c + OFF_HALF, n)


# --- distances of two label sets


def _distance(name: str):
    def run(spark: SparkSession, where: str) -> DataFrame:
        d = measures.MEASURES[name].pair(F.col("a"), F.col("b"))
        return _pairs(spark, where).select("row_id", _rounded(d).alias("distance"))

    return run


_SETS = """
sets AS (
  SELECT row_id, item_id, pass_no,
    list_sort(list_distinct(list_filter(coalesce(rater_a, []), lambda x: x IS NOT NULL))) AS a,
    list_sort(list_distinct(list_filter(coalesce(rater_b, []), lambda x: x IS NOT NULL))) AS b
  FROM rater_pairs
)"""


def _sql_distance(expression: str) -> str:
    return f"WITH {_SETS} SELECT row_id, round(({expression}) + 3.7e-11, 9) AS distance FROM sets"


_JACCARD = """CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 0.0
  ELSE 1.0 - len(list_filter({0}, lambda x: list_contains({1}, x))) / len(list_distinct(list_concat({0}, {1}))) END"""
_LEV = """CASE WHEN len(array_to_string(a, ' ')) = 0 AND len(array_to_string(b, ' ')) = 0 THEN 0.0
  WHEN len(array_to_string(a, ' ')) = 0 OR len(array_to_string(b, ' ')) = 0 THEN 1.0
  ELSE levenshtein(array_to_string(a, ' '), array_to_string(b, ' ')) / greatest(len(array_to_string(a, ' ')), len(array_to_string(b, ' '))) END"""


#: Word tokens of a text in SQL, as far as these labels need the rules: commas, colons and a last full stop.
_TOKENS = r"""list_filter(string_split_regex(regexp_replace(regexp_replace(lower({0}), '([^0-9\s]|^)([,:])|([,:])([^0-9]|$)', '\1 \2\3 \4', 'g'),
  '([^.])[.]\s*$', '\1 . '), '\s+'), lambda w: w <> '')"""
_WORDS = f"""
WITH {_SETS}, w AS (
  SELECT row_id, list_distinct({_TOKENS.format("array_to_string(a, ' ')")}) AS x, list_distinct({_TOKENS.format("array_to_string(b, ' ')")}) AS y FROM sets),
n AS (SELECT row_id, len(x) AS nx, len(y) AS ny, len(list_filter(x, lambda v: list_contains(y, v))) AS i, len(list_distinct(list_concat(x, y))) AS u FROM w)
SELECT row_id, round((CASE WHEN nx = 0 AND ny = 0 THEN 0.0 WHEN nx = 0 OR ny = 0 THEN 1.0 ELSE {{0}} END) + 3.7e-11, 9) AS distance FROM n
"""
WORD_JACCARD = _WORDS.format("(u - i) / u")
MASI = _WORDS.format("1.0 - i / u * CASE WHEN i = nx AND i = ny THEN 1.0 WHEN i = least(nx, ny) THEN 0.67 WHEN i > 0 THEN 0.33 ELSE 0.0 END")


def word_tokens(spark: SparkSession, where: str) -> DataFrame:
    """Word tokens of each label of the vocabulary."""
    terms = table(spark, where, "label_terms")
    labels = terms.select("term_id", F.explode(F.concat(F.array("preferred_term"), "variants")).alias("label"))
    return labels.select("term_id", "label", F.array_join(words(F.col("label")), "|").alias("tokens"))


WORD_TOKENS = r"""
SELECT term_id, label, array_to_string(list_filter(string_split(replace(lower(label), ',', ' , '), ' '), lambda w: w <> ''), '|') AS tokens
FROM (SELECT term_id, unnest(list_concat([preferred_term], variants)) AS label FROM label_terms)
"""

#: Length of the longest common subsequence of x and y: for each character of y the next row of the table over x.
_LCS = """list_last(list_reduce(list_prepend(list_transform(range(len({0}) + 1), lambda i: 0::BIGINT), list_transform(range(1, len({1}) + 1), lambda j: [j])),
  lambda r, j: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len({0}) + 1), lambda i: [i])),
    lambda n, i: list_append(n, greatest(r[i[1] + 1], list_last(n), r[i[1]] + ({0}[i[1]] = {1}[j[1]])::BIGINT)))))"""
_SUBSEQUENCE = f"""
WITH {_SETS}, t AS (SELECT row_id, array_to_string(a, ' ') AS x, array_to_string(b, ' ') AS y FROM sets), n AS (SELECT row_id, x, y, {_LCS.format("x", "y")} AS l FROM t)
SELECT row_id, round((CASE WHEN x = '' AND y = '' THEN 0.0 WHEN x = '' OR y = '' THEN 1.0 ELSE {{0}} END) + 3.7e-11, 9) AS distance FROM n
"""
INDEL = _SUBSEQUENCE.format("(len(x) + len(y) - 2 * l) / (len(x) + len(y))")
LCS = _SUBSEQUENCE.format("1 - l / greatest(len(x), len(y))")

# --- matching


def _matched(name: str):
    def run(spark: SparkSession, where: str) -> DataFrame:
        pairs = _pairs(spark, where)
        found = measures.score_pairs(pairs.select("a", "b").distinct(), measures.MEASURES[name])
        both = found.groupBy("a", "b").agg(
            F.max(F.when(F.col("matching") == "hungarian", F.col("distance"))).alias("d_hungarian"),
            F.max(F.when(F.col("matching") == "greedy", F.col("distance"))).alias("d_greedy"),
        )
        return pairs.join(both, ["a", "b"]).select("row_id", _rounded(F.col("d_hungarian")).alias("d_hungarian"), _rounded(F.col("d_greedy")).alias("d_greedy"))

    return run


# sets here have two labels at most: the best of two assignments, and the cheapest cell first
def _matched_sql(cost: str) -> str:
    return f"""
WITH {_SETS}, cells AS (
  SELECT row_id, len(a) AS n, len(b) AS m, a = b AS same,
    [[{cost} FOR j IN range(1, len(b) + 1)] FOR i IN range(1, len(a) + 1)] AS c
  FROM sets
), best AS (
  SELECT row_id, n, m, same, c,
    CASE WHEN n = 1 AND m = 1 THEN 1 - c[1][1]
      WHEN n = 1 THEN 1 - least(c[1][1], c[1][2]) WHEN m = 1 THEN 1 - least(c[1][1], c[2][1])
      ELSE 2 - least(c[1][1] + c[2][2], c[1][2] + c[2][1]) END AS q,
    CASE WHEN n = 2 AND m = 2 THEN 2 - (CASE WHEN least(c[1][1], c[2][2]) <= least(c[1][2], c[2][1])
          AND NOT (c[1][2] = least(c[1][1], c[2][2]) AND c[1][1] > c[1][2]) THEN c[1][1] + c[2][2] ELSE c[1][2] + c[2][1] END) END AS g
  FROM cells WHERE n > 0 AND m > 0
)
SELECT s.row_id,
  CASE WHEN s.a = s.b THEN 0.0 WHEN len(s.a) = 0 OR len(s.b) = 0 THEN 1.0 ELSE round((1 - 2 * q / (n + m)) + 3.7e-11, 9) END AS d_hungarian,
  CASE WHEN s.a = s.b THEN 0.0 WHEN len(s.a) = 0 OR len(s.b) = 0 THEN 1.0 ELSE round((1 - 2 * coalesce(g, q) / (n + m)) + 3.7e-11, 9) END AS d_greedy
FROM sets s LEFT JOIN best USING (row_id)
"""


MATCHED_LEVENSHTEIN = _matched_sql("levenshtein(a[i], b[j]) / greatest(len(a[i]), len(b[j]))")
MATCHED_JACCARD = _matched_sql(
    f"""1 - len(list_filter(list_distinct({_TOKENS.format('a[i]')}), lambda v: list_contains({_TOKENS.format('b[j]')}, v)))
      / len(list_distinct(list_concat({_TOKENS.format('a[i]')}, {_TOKENS.format('b[j]')})))"""
)

MATCHED_INDEL = _matched_sql(f"list_transform([{{'p': a[i], 'q': b[j]}}], lambda z: (len(z.p) + len(z.q) - 2 * ({_LCS.format('z.p', 'z.q')})) / (len(z.p) + len(z.q)))[1]")
MATCHED_LCS = _matched_sql(f"list_transform([{{'p': a[i], 'q': b[j]}}], lambda z: 1 - ({_LCS.format('z.p', 'z.q')}) / greatest(len(z.p), len(z.q)))[1]")


def matrix_assignments(spark: SparkSession, where: str) -> DataFrame:
    """Distances of stored cost matrices under both assignments, the JVM's and the kernel's, and confident matches."""
    rows = table(spark, where, "cost_matrices").filter((F.size("cost") > 0) & (F.size(F.get("cost", 0)) > 0)).select("row_id", "cost")
    m = rows.withColumn("m", matching.match("cost"))
    return m.select(
        "row_id",
        _rounded(F.col("m.d_hungarian")).alias("d_hungarian"),
        _rounded(F.col("m.d_greedy")).alias("d_greedy"),
        _rounded(matching.under(F.col("cost"), F.col("m.greedy"))).alias("d_again"),
        F.size(matching.confident(F.col("cost"), F.col("m.greedy"))).alias("n_confident"),
    )


def _matrices_sql(most: int) -> str:
    """Both assignments of matrices whose smaller side has at most ``most``: the least cost by columns taken so far, row after row, and the greedy cells one by one."""
    steps = ["s0 AS (SELECT row_id, 0 AS mask, 0.0::DOUBLE AS q FROM m)", "g0 AS (SELECT row_id, 0 AS rows, 0 AS cols, 0.0::DOUBLE AS q, 0 AS sure FROM m)"]
    for k in range(1, most + 1):
        steps.append(
            f"s{k} AS (SELECT row_id, mask | (1 << (l - 1)) AS mask, min(q + c) AS q FROM s{k - 1} JOIN cells USING (row_id) WHERE s = {k} AND mask & (1 << (l - 1)) = 0 GROUP BY ALL)"
        )
        steps.append(
            f"""g{k} AS (SELECT row_id, rows | (1 << (i - 1)) AS rows, cols | (1 << (j - 1)) AS cols, q + 1 - c AS q, sure + (c < 1 / 3.0::DOUBLE)::INT AS sure
              FROM g{k - 1} JOIN cells USING (row_id) WHERE rows & (1 << (i - 1)) = 0 AND cols & (1 << (j - 1)) = 0
              QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY c, i, j) = 1)"""
        )
    ends = lambda t, columns: " UNION ALL ".join(f"SELECT row_id, {columns} FROM {t}{k} JOIN m USING (row_id) WHERE least(n, w) = {k}" for k in range(1, most + 1))
    return f"""
WITH m AS (SELECT row_id, cost, len(cost) AS n, len(cost[1]) AS w FROM cost_matrices WHERE len(cost) > 0 AND len(cost[1]) > 0),
cells AS (
  SELECT row_id, i, j, cost[i][j] AS c, CASE WHEN n <= w THEN i ELSE j END AS s, CASE WHEN n <= w THEN j ELSE i END AS l
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM m), unnest(range(1, w + 1)) AS t(j)),
{", ".join(steps)},
best AS (SELECT row_id, min(q) AS q FROM ({ends("s", "q")}) GROUP BY row_id),
quick AS ({ends("g", "q, sure")})
SELECT row_id, round(1 - 2 * (least(n, w) - best.q) / (n + w) + 3.7e-11, 9) AS d_hungarian, round(1 - 2 * quick.q / (n + w) + 3.7e-11, 9) AS d_greedy,
  round(1 - 2 * quick.q / (n + w) + 3.7e-11, 9) AS d_again, CAST(sure AS INTEGER) AS n_confident
FROM m JOIN best USING (row_id) JOIN quick USING (row_id)
"""


MATRICES = _matrices_sql(5)


# --- coefficients


def _two_raters(name: str, with_distribution: bool = False):
    def run(spark: SparkSession, where: str) -> DataFrame:
        rows = table(spark, where, "rater_pairs")
        out = agreement.two_raters(rows, ["pass_no"], measures.MEASURES[name], key="row_id", distribution=with_distribution)
        rounded = [_rounded(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes]
        return out.select(*rounded)

    return run


def _two_raters_sql(d: str) -> str:
    """Cohen's and Scott's coefficients by pass with distance ``d`` of x.l and y.l."""
    return f"""
WITH {_SETS}, pooled AS (SELECT pass_no, a AS l FROM sets UNION ALL SELECT pass_no, b FROM sets),
ca AS (SELECT pass_no, a AS l, count(*) AS n FROM sets GROUP BY ALL), cb AS (SELECT pass_no, b AS l, count(*) AS n FROM sets GROUP BY ALL),
cp AS (SELECT pass_no, l, count(*) AS n FROM pooled GROUP BY ALL),
o AS (SELECT pass_no, count(*) AS n_items, avg(1 - ({d.format('a', 'b')})) AS ao FROM sets GROUP BY pass_no),
k AS (SELECT x.pass_no, sum(x.n * y.n * (1 - ({d.format('x.l', 'y.l')}))) / (sum(x.n * y.n)) AS ae FROM ca x JOIN cb y USING (pass_no) GROUP BY x.pass_no),
p AS (SELECT x.pass_no, sum(x.n * y.n * (1 - ({d.format('x.l', 'y.l')}))) / (sum(x.n * y.n)) AS ae FROM cp x JOIN cp y USING (pass_no) GROUP BY x.pass_no)
SELECT pass_no, 'none' AS matching, n_items, round((ao) + 3.7e-11, 6) AS average_agreement,
  CASE WHEN k.ae >= 1 THEN CASE WHEN ao >= 1 THEN 1.0 ELSE '-inf'::DOUBLE END ELSE round(((ao - k.ae) / (1 - k.ae)) + 3.7e-11, 6) END AS cohens_kappa,
  CASE WHEN p.ae >= 1 THEN CASE WHEN ao >= 1 THEN 1.0 ELSE '-inf'::DOUBLE END ELSE round(((ao - p.ae) / (1 - p.ae)) + 3.7e-11, 6) END AS scotts_pi
FROM o JOIN k USING (pass_no) JOIN p USING (pass_no)
"""


_EXACT = "CASE WHEN {0} = {1} THEN 0.0 ELSE 1.0 END"


def _long(spark: SparkSession, where: str) -> DataFrame:
    """Annotated images as items with a slot for each annotator."""
    rows = table(spark, where, "annotation_rows").filter("item_key is not null and source is not null")
    return annotations.items(rows.select(F.col("item_key").alias("key"), "caption", "category", "source", "ord"))


def items_of_sources(spark: SparkSession, where: str) -> DataFrame:
    return _long(spark, where).select("key", "slot", "source", "caption")


ITEMS = """
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY ord, source) - 1 AS INTEGER) AS slot, source, caption FROM (
  SELECT *, count(*) OVER (PARTITION BY key) AS n FROM (
    SELECT item_key AS key, source, caption, ord,
      row_number() OVER (PARTITION BY item_key, source ORDER BY ord, caption NULLS FIRST) AS k
    FROM annotation_rows WHERE item_key IS NOT NULL AND source IS NOT NULL)
  WHERE k = 1) WHERE n >= 2
"""


def many_raters(spark: SparkSession, where: str) -> DataFrame:
    long = _long(spark, where).select(F.lit("all").alias("corpus"), F.col("key").alias("item"), "slot", F.col("category").alias("labels"))
    out = agreement.many_raters(long, ["corpus"], measures.MEASURES["set_jaccard"], distribution=False)
    return out.select(*[_rounded(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def many_raters_distribution(spark: SparkSession, where: str) -> DataFrame:
    long = _long(spark, where).select(F.lit("all").alias("corpus"), F.col("key").alias("item"), "slot", F.col("category").alias("labels"))
    return agreement.many_raters(long, ["corpus"], measures.MEASURES["levenshtein"])


MANY_RATERS = f"""
WITH first AS (
  SELECT item_key AS item, source, category, ord, row_number() OVER (PARTITION BY item_key, source ORDER BY ord, caption NULLS FIRST) AS k
  FROM annotation_rows WHERE item_key IS NOT NULL AND source IS NOT NULL),
many AS (SELECT *, count(*) OVER (PARTITION BY item) AS n, row_number() OVER (PARTITION BY item ORDER BY ord, source) AS slot FROM first WHERE k = 1),
long AS (SELECT item, slot, list_sort(list_distinct(list_filter(coalesce(category, []), lambda x: x IS NOT NULL))) AS l FROM many WHERE n >= 2),
pairs AS (SELECT x.item, x.slot AS s, y.slot AS t, x.l AS a, y.l AS b FROM long x JOIN long y ON x.item = y.item AND x.slot < y.slot),
o AS (SELECT avg(ao) AS ao, count(*) AS n_items FROM (SELECT item, avg(1 - ({_JACCARD.format('a', 'b')})) AS ao FROM pairs GROUP BY item)),
c AS (SELECT l, count(*) AS n FROM long GROUP BY l),
p AS (SELECT sum(x.n * y.n * (1 - ({_JACCARD.format('x.l', 'y.l')}))) / sum(x.n * y.n) AS ae FROM c x CROSS JOIN c y),
ca AS (SELECT s, t, a AS l, count(*) AS n FROM pairs GROUP BY ALL), cb AS (SELECT s, t, b AS l, count(*) AS n FROM pairs GROUP BY ALL),
so AS (SELECT s, t, avg(1 - ({_JACCARD.format('a', 'b')})) AS ao FROM pairs GROUP BY s, t),
se AS (SELECT x.s, x.t, sum(x.n * y.n * (1 - ({_JACCARD.format('x.l', 'y.l')}))) / sum(x.n * y.n) AS ae FROM ca x JOIN cb y ON x.s = y.s AND x.t = y.t GROUP BY x.s, x.t)
SELECT 'all' AS corpus, 'none' AS matching, n_items, round((ao) + 3.7e-11, 6) AS average_agreement,
  (SELECT round((avg(CASE WHEN abs(ae - 1) <= 1e-9 THEN CASE WHEN abs(so.ao - 1) <= 1e-9 THEN 1.0 END ELSE (so.ao - ae) / (1 - ae) END)) + 3.7e-11, 6) FROM so JOIN se USING (s, t)) AS cohens_kappa,
  round(((ao - p.ae) / (1 - p.ae)) + 3.7e-11, 6) AS fleiss_kappa
FROM o CROSS JOIN p
"""


def krippendorff(spark: SparkSession, where: str) -> DataFrame:
    """Alpha of the annotated images by exact match of categories."""
    rows = _long(spark, where).select(
        F.lit("all").alias("corpus"), F.col("key").alias("item"), F.col("source").alias("worker"), label_set(F.col("category")).alias("labels"), F.xxhash64("key", "slot").alias("pos")
    )
    out = distribution.krippendorff(rows, ["corpus"], measures.MEASURES["exact_match"])
    return out.select("corpus", *[_rounded(F.col(c), 6).alias(c) for c in ("observed", "expected", "alpha")])


KRIPPENDORFF = f"""
WITH first AS (
  SELECT item_key AS item, source, category, row_number() OVER (PARTITION BY item_key, source ORDER BY ord, caption NULLS FIRST) AS k
  FROM annotation_rows WHERE item_key IS NOT NULL AND source IS NOT NULL),
long AS (SELECT item, source, list_sort(list_distinct(list_filter(coalesce(category, []), lambda x: x IS NOT NULL))) AS l,
  row_number() OVER (ORDER BY item, source) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY item) AS n FROM first WHERE k = 1) WHERE n >= 2),
d AS (SELECT x.item = y.item AS same, CASE WHEN x.l = y.l THEN 0.0 ELSE 1.0 END AS d FROM long x JOIN long y ON x.pos > y.pos),
m AS (SELECT avg(d) FILTER (same) AS o, avg(d) FILTER (NOT same) AS e FROM d)
SELECT 'all' AS corpus, round((o) + 3.7e-11, 6) AS observed, round((e) + 3.7e-11, 6) AS expected, round((1 - o / e) + 3.7e-11, 6) AS alpha FROM m
"""


def chance_sample(spark: SparkSession, where: str) -> DataFrame:
    """Exact chance pairs of every two people whose label sets are within the budget; ``chance_all`` has the others too."""
    rows = table(spark, where, "rater_pairs").select("row_id", "rater_a_id", "rater_b_id", label_set(F.col("rater_a")).alias("a"), label_set(F.col("rater_b")).alias("b"))
    group = ["rater_a_id", "rater_b_id"]
    sizes = rows.groupBy(*group).agg(F.countDistinct("a").alias("da"), F.countDistinct("b").alias("db"))
    small = rows.join(sizes.filter(F.col("da") * F.col("db") <= chance.MAX_EXACT), group, "left_semi")
    left, right = (small.select(*group, F.col(c).alias("labels"), F.col("row_id").alias("pos")) for c in "ab")
    pairs = chance.chance_pairs(left, right, group)
    return pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n_pairs"), _rounded(F.sum("weight")).alias("weight"), _rounded(F.max("weight")).alias("most"))


CHANCE = """
WITH s AS (
  SELECT rater_a_id, rater_b_id, list_sort(list_distinct(list_filter(coalesce(rater_a, []), lambda x: x IS NOT NULL))) AS a,
    list_sort(list_distinct(list_filter(coalesce(rater_b, []), lambda x: x IS NOT NULL))) AS b FROM rater_pairs),
ca AS (SELECT rater_a_id, rater_b_id, a AS l, count(*) AS n FROM s GROUP BY ALL), cb AS (SELECT rater_a_id, rater_b_id, b AS l, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT rater_a_id, rater_b_id, count(*) AS n FROM s GROUP BY ALL HAVING count(DISTINCT a) * count(DISTINCT b) <= 1000)
SELECT rater_a_id, rater_b_id, count(*) AS n_pairs, round((sum((x.n / t.n) * (y.n / t.n))) + 3.7e-11, 9) AS weight, round((max((x.n / t.n) * (y.n / t.n))) + 3.7e-11, 9) AS most
FROM ca x JOIN cb y USING (rater_a_id, rater_b_id) JOIN t USING (rater_a_id, rater_b_id) GROUP BY rater_a_id, rater_b_id
"""


def chance_all(spark: SparkSession, where: str) -> DataFrame:
    """Exact chance pairs of every two people: pairs come from counts of label sets, so no number of them is too large."""
    rows = table(spark, where, "rater_pairs").select("row_id", "rater_a_id", "rater_b_id", label_set(F.col("rater_a")).alias("a"), label_set(F.col("rater_b")).alias("b"))
    group = ["rater_a_id", "rater_b_id"]
    left, right = (rows.select(*group, F.col(c).alias("labels"), F.col("row_id").alias("pos")) for c in "ab")
    pairs = chance.chance_pairs(left, right, group, max_exact=chance.UNBOUNDED)
    return pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("n_pairs"), _rounded(F.sum("weight")).alias("weight"), _rounded(F.max("weight")).alias("most"))


CHANCE_ALL = """
WITH s AS (
  SELECT rater_a_id, rater_b_id, list_sort(list_distinct(list_filter(coalesce(rater_a, []), lambda x: x IS NOT NULL))) AS a,
    list_sort(list_distinct(list_filter(coalesce(rater_b, []), lambda x: x IS NOT NULL))) AS b FROM rater_pairs),
ca AS (SELECT rater_a_id, rater_b_id, a AS l, count(*) AS n FROM s GROUP BY ALL), cb AS (SELECT rater_a_id, rater_b_id, b AS l, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT rater_a_id, rater_b_id, count(*) AS n FROM s GROUP BY ALL)
SELECT rater_a_id, rater_b_id, count(*) AS n_pairs, round((sum((x.n / t.n) * (y.n / t.n))) + 3.7e-11, 9) AS weight, round((max((x.n / t.n) * (y.n / t.n))) + 3.7e-11, 9) AS most
FROM ca x JOIN cb y USING (rater_a_id, rater_b_id) JOIN t USING (rater_a_id, rater_b_id) GROUP BY rater_a_id, rater_b_id
"""


def drawn_chance_sample(spark: SparkSession, where: str) -> DataFrame:
    """The drawn sample where pairs exceed the budget: a few hundred pairs a group, equal weights by repetition."""
    rows = _pairs(spark, where)
    left, right = rows.select("pass_no", F.col("a").alias("labels"), F.col("row_id").alias("pos")), rows.select("pass_no", F.col("b").alias("labels"), F.col("row_id").alias("pos"))
    return chance.chance_pairs(left, right, ["pass_no"])


# --- errors, significance, ablation


def _errors(spark: SparkSession, where: str) -> DataFrame:
    """Per measure and seed: how far the mean agreement of a population's predictions is from its level."""
    rows = table(spark, where, "predictions").filter("distance is not null and not isnan(distance)")
    per = rows.groupBy("dataset", "mode", "negative_mode", "measure", "seed", "agreement_level").agg(F.avg(1 - F.col("distance")).alias("value"))
    return per.select(
        "dataset", "mode", "negative_mode", "measure", "seed",
        summaries.absolute_error(F.col("value"), F.col("agreement_level")).alias("mae"),
        summaries.percent_error(F.col("value"), F.col("agreement_level")).alias("mape"),
    )


def error_table(spark: SparkSession, where: str) -> DataFrame:
    out = summaries.error_table(_errors(spark, where), ["dataset", "mode"])
    return out.select("dataset", "mode", "measure", "n", *[_rounded(F.col(c), 6).alias(c) for c in ("mean_mae", "std_mae", "mean_mape")])


ERRORS = """
WITH e AS (
  SELECT dataset, mode, negative_mode, measure, seed, agreement_level AS t, avg(1 - distance) AS v
  FROM predictions WHERE CAST(distance AS VARCHAR) <> 'nan' GROUP BY ALL)
SELECT dataset, mode, measure, count(*) AS n, round((avg(abs(v - t))) + 3.7e-11, 6) AS mean_mae, round((stddev_pop(abs(v - t))) + 3.7e-11, 6) AS std_mae,
  round((avg(CASE WHEN t <> 0 THEN abs(v - t) / abs(t) * 100 END)) + 3.7e-11, 6) AS mean_mape
FROM e GROUP BY dataset, mode, measure
"""


def significance(spark: SparkSession, where: str) -> DataFrame:
    per_seed = _errors(spark, where).groupBy("dataset", "mode", "measure", "seed").agg(F.avg("mae").alias("mae"))
    return summaries.significance(per_seed, ["dataset", "mode"])


def ablation_rows(spark: SparkSession, where: str) -> DataFrame:
    met = results.with_true_pairs(table(spark, where, "cost_matrices"), table(spark, where, "predictions"))
    return ablation.run(met.drop("loaded_at"), ["row_id", "measure"])


def ablation_summary(spark: SparkSession, where: str) -> DataFrame:
    return ablation.summarise(ablation_rows(spark, where), ["row_id"])


def true_pairs(spark: SparkSession, where: str) -> DataFrame:
    met = results.with_true_pairs(table(spark, where, "cost_matrices"), table(spark, where, "predictions"))
    return met.select("row_id", F.size("truth").alias("n_true"))


TRUE_PAIRS = """
WITH t AS (
  SELECT dataset, negative_mode, measure, agreement_level, seed, sample_index, max_by(true_assignment, row_id) AS t FROM predictions
  WHERE sample_index IS NOT NULL AND true_assignment IS NOT NULL AND true_assignment <> '' GROUP BY ALL)
SELECT row_id, CAST(json_array_length(t) AS INTEGER) AS n_true
FROM cost_matrices JOIN t USING (dataset, negative_mode, measure, agreement_level, seed, sample_index)
WHERE len(cost) > 0 AND len(cost[1]) > 0 AND json_array_length(t) > 0
"""


def label_costs(spark: SparkSession, where: str) -> DataFrame:
    """The newest cost of each pair of labels of each measure, out of matrices and the predictions they belong to."""
    costs = results.matrix_costs(table(spark, where, "cost_matrices"), table(spark, where, "predictions"), F.struct("loaded_at", "row_id"))
    return results.newest(costs, ["measure", "x", "y"])


def matrix_fates(spark: SparkSession, where: str) -> DataFrame:
    return results.unmatched_matrices(table(spark, where, "cost_matrices"), table(spark, where, "predictions"))


MATRIX_FATES = """
WITH w AS (
  SELECT dataset, mode, negative_mode, agreement_level, seed, sample_index, measure,
    max_by({'a': rater_a_set_size, 'b': rater_b_set_size}, row_id) AS w
  FROM predictions WHERE rater_a IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN w IS NULL THEN 'unmatched' WHEN len(cost) <> w.a OR len(cost[1]) <> w.b THEN 'shape_mismatch' ELSE 'used' END AS reason, count(*) AS n
FROM cost_matrices LEFT JOIN w USING (dataset, mode, negative_mode, agreement_level, seed, sample_index, measure) GROUP BY 1
"""

# --- concepts


def _concepts(spark: SparkSession, where: str) -> DataFrame:
    """The last row of each code, links within the taxonomy."""
    rows = table(spark, where, "concepts").filter("code is not null")
    last = rows.groupBy("taxonomy", "code").agg(F.max_by(F.struct("ord", "preferred_term", "synonyms", "parent_codes", "hierarchy_key"), F.struct("loaded_at", "row_id")).alias("x"))
    tag = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.concat(F.col("taxonomy"), F.lit("/"), p))
    return last.select(
        F.concat("taxonomy", F.lit("/"), "code").alias("code"), "taxonomy", "x.ord", "x.preferred_term", "x.synonyms", tag(F.col("x.parent_codes")).alias("parent_codes"), tag(F.col("x.hierarchy_key")).alias("hierarchy_key")
    )


_CONCEPTS = """
c AS (
  SELECT taxonomy || '/' || code AS code, list_transform(coalesce(x.p, []), lambda p: taxonomy || '/' || p) AS parents, list_transform(coalesce(x.h, []), lambda p: taxonomy || '/' || p) AS keys, x.ord AS ord FROM (
    SELECT taxonomy, code, max_by({'p': parent_codes, 'h': hierarchy_key, 'ord': ord}, {'t': loaded_at, 'r': row_id}) AS x FROM concepts WHERE code IS NOT NULL GROUP BY taxonomy, code)
), e AS (SELECT DISTINCT code, unnest(parents) AS parent FROM c)"""


def concept_siblings(spark: SparkSession, where: str) -> DataFrame:
    return neighbours.siblings(_concepts(spark, where))


SIBLINGS = f"WITH {_CONCEPTS} SELECT DISTINCT x.code, y.code AS candidate FROM e x JOIN e y USING (parent) WHERE x.code <> y.code AND parent IS NOT NULL"


def concept_children(spark: SparkSession, where: str) -> DataFrame:
    return neighbours.children(_concepts(spark, where))


CHILDREN = f"""
WITH {_CONCEPTS}, k AS (SELECT code, unnest(keys) AS key FROM c), p AS (SELECT code AS candidate, unnest(parents) AS key FROM c)
SELECT k.code, p.candidate FROM k JOIN p USING (key) WHERE k.code <> p.candidate
"""


def concept_ancestors(spark: SparkSession, where: str) -> DataFrame:
    return neighbours.ancestors(_concepts(spark, where), hops=2)


ANCESTORS = f"""
WITH {_CONCEPTS}, k AS (SELECT key, max_by(code, ord) AS named FROM (SELECT code, ord, unnest(keys) AS key FROM c) WHERE key IS NOT NULL GROUP BY key),
one AS (SELECT e.code, named AS candidate, parent FROM e JOIN k ON e.parent = k.key),
two AS (SELECT one.code, k.named AS candidate FROM one JOIN e ON one.candidate = e.code JOIN k ON e.parent = k.key
  WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.code = one.code AND f.parent = e.parent))
SELECT code, candidate, min(hop) AS hop FROM (SELECT code, candidate, 1 AS hop FROM one UNION ALL SELECT code, candidate, 2 FROM two) GROUP BY code, candidate
"""


def concept_lexical(spark: SparkSession, where: str) -> DataFrame:
    """The ten nearest concepts by form of every concept whose place is divisible by 20, within its taxonomy."""
    concepts = _concepts(spark, where)
    return neighbours.lexical_neighbours(concepts.filter("ord % 20 = 0"), concepts, block=["taxonomy"])


def meddra_concepts(spark: SparkSession, where: str) -> DataFrame:
    found = taxonomies.meddra_concepts(table(spark, where, "meddra_pt").select("pt_code", "pt_name"), table(spark, where, "meddra_llt"))
    return found.select("code", "preferred_term", F.array_join("synonyms", "|").alias("synonyms"))


MEDDRA = """
WITH f AS (SELECT pt_code, min(pt_name) AS pt_name FROM meddra_pt WHERE pt_code IS NOT NULL GROUP BY pt_code)
SELECT pt_code AS code, pt_name AS preferred_term, array_to_string(list_sort(list(DISTINCT llt_name)), '|') AS synonyms
FROM meddra_llt JOIN f USING (pt_code) WHERE llt_currency = 'Y' AND llt_name <> pt_name GROUP BY pt_code, pt_name
"""


#: Seeds and pairs of each, as the experiments have them by default.
SEEDS, SAMPLES = list(range(52, 82)), 100


def _with_synonyms(spark: SparkSession, where: str) -> DataFrame:
    return written(_concepts(spark, where).filter("size(synonyms) > 0"), "concepts")


def populations(spark: SparkSession, where: str) -> DataFrame:
    """Thirty seeded populations of sets of each taxonomy's concepts with siblings as negatives, and their true assignments."""
    concepts = _with_synonyms(spark, where)
    made = synthetic.populations(concepts, SEEDS, samples=SAMPLES, negatives=neighbours.sibling_index(concepts), by=["taxonomy"])
    return made.withColumn("truth", synthetic.true_assignment(F.col("rater_a_concepts"), F.col("rater_b_concepts"))).select(
        "taxonomy", "seed", "agreement_level", "sample_index", F.size("rater_a").alias("a_size"), F.size("rater_b").alias("b_size"), F.size("truth").alias("n_true")
    )


def synthetic_results(spark: SparkSession, where: str) -> DataFrame:
    """Errors of two measures on thirty seeded populations of each taxonomy's concepts."""
    made = synthetic.populations(_with_synonyms(spark, where), SEEDS, samples=SAMPLES, by=["taxonomy"])
    out = experiments.synthetic_results(made, [measures.MEASURES["levenshtein"], measures.MEASURES["bipartite_levenshtein"]], group=["taxonomy", "seed"])
    return out.select("taxonomy", "seed", "measure", "matching", *[c for k in experiments.COEFFICIENTS for c in (k, f"true_{k}", f"mae_{k}")])


def synthetic_predictions(spark: SparkSession, where: str) -> DataFrame:
    made = synthetic.populations(_with_synonyms(spark, where), SEEDS, samples=SAMPLES, by=["taxonomy"])
    out = experiments.predictions(made, measures.MEASURES["bipartite_levenshtein"], group=["taxonomy", "seed"])
    return out.select("taxonomy", "seed", "sample_index", "true_match", "distance", "distance_greedy", "distance_true", F.size("confident").alias("n_confident"))


def real_results(spark: SparkSession, where: str) -> DataFrame:
    """Agreement of the captions of annotated images against that of their categories."""
    return experiments.real_results(_long(spark, where).filter("caption is not null"), [measures.MEASURES["jaccard"], measures.MEASURES["levenshtein"]])


def real_chance(spark: SparkSession, where: str) -> DataFrame:
    return experiments.chance_rows(_long(spark, where).filter("caption is not null"), measures.MEASURES["jaccard"])


# --- image captions, embeddings, streams


def derm_concepts(spark: SparkSession, where: str) -> DataFrame:
    found = annotations.derm1_concepts(table(spark, where, "derm1_rows"))
    return found.select("code", "preferred_term", F.size("synonyms").alias("n_synonyms"), F.array_join("parent_codes", "|").alias("parents"))


def derm_annotations(spark: SparkSession, where: str) -> DataFrame:
    found = annotations.derm1_annotations(table(spark, where, "derm1_rows"), "both")
    return found.select("key", "ord", "source", F.array_join("category", "|").alias("category"))


def _label_means(rows: DataFrame) -> DataFrame:
    """label, centre: the mean vector of each label."""
    long = rows.select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


def embedding_costs(spark: SparkSession, where: str) -> DataFrame:
    """1 - cosine of each vector whose id is divisible by 20 with the mean vector of its own label; ``label_mean_costs`` has all."""
    rows = table(spark, where, "embeddings").filter("embedding is not null")
    centre = _label_means(rows)
    asked = rows.filter("vec_id % 20 = 0").select("vec_id", "embedding", F.col("label").alias("own"))
    pairs = asked.join(centre, asked["own"] == centre["label"])
    return pairs.select("vec_id", "label", _rounded(distances.cosine_cost(F.col("embedding"), F.col("centre")), 5).alias("cost"))


EMBEDDINGS = """
WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL),
m AS (SELECT label, i, avg(v) AS m FROM e GROUP BY label, i)
SELECT vec_id, label, round((1 - sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m)))) + 3.7e-11, 5) AS cost
FROM e JOIN m USING (label, i) WHERE vec_id % 20 = 0 GROUP BY vec_id, label
"""


#: Mean vectors travel to every worker up to this number of labels; beyond it they are joined without that.
MOST_LABELS = 10_000


def label_mean_costs(spark: SparkSession, where: str) -> DataFrame:
    """1 - cosine of each vector with the mean vector of every label."""
    rows = table(spark, where, "embeddings").filter("embedding is not null")
    centre = written(_label_means(rows), "means")  # a row per label
    few = centre.count() <= MOST_LABELS
    pairs = rows.select("vec_id", "embedding").crossJoin(F.broadcast(centre) if few else centre)
    return pairs.select("vec_id", "label", _rounded(distances.cosine_cost(F.col("embedding"), F.col("centre")), 5).alias("cost"))


LABEL_MEANS = """
WITH e AS (SELECT vec_id, label AS own, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL),
m AS (SELECT own AS label, i, avg(v) AS m FROM e GROUP BY own, i)
SELECT vec_id, label, round((1 - sum(v * m) / (sqrt(sum(v * v)) * sqrt(sum(m * m)))) + 3.7e-11, 5) AS cost FROM e JOIN m USING (i) GROUP BY vec_id, label
"""


def windowed(spark: SparkSession, where: str) -> DataFrame:
    out = windowed_agreement(table(spark, where, "rater_pairs"), measures.MEASURES["set_jaccard"], "loaded_at", window="30 days")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "n_items", _rounded(F.col("average_agreement"), 6).alias("average_agreement"))


WINDOWED = f"""
WITH {_SETS}, t AS (SELECT row_id, (epoch_us(loaded_at) // 2592000000000) * 2592000 AS w FROM rater_pairs)
SELECT CAST(w AS BIGINT) AS window_start, count(*) AS n_items, round((avg(1 - ({_JACCARD.format('a', 'b')}))) + 3.7e-11, 6) AS average_agreement FROM sets JOIN t USING (row_id) GROUP BY w
"""

LABEL_COSTS = """
WITH w AS (
  SELECT dataset, mode, negative_mode, agreement_level, seed, sample_index, measure AS full_name, max_by({'a': rater_a, 'b': rater_b}, row_id) AS w
  FROM predictions WHERE rater_a IS NOT NULL AND rater_b IS NOT NULL GROUP BY ALL
), t AS (SELECT * EXCLUDE (w, full_name), regexp_replace(full_name, '_single$', '') AS measure, from_json(w.a, '["VARCHAR"]') AS a, from_json(w.b, '["VARCHAR"]') AS b FROM w),
m AS (SELECT * REPLACE (regexp_replace(measure, '_single$', '') AS measure) FROM cost_matrices),
f AS (SELECT measure, cost, a, b, loaded_at, row_id FROM m JOIN t USING (dataset, mode, negative_mode, agreement_level, seed, sample_index, measure) WHERE len(cost) = len(a) AND len(cost[1]) = len(b)),
r AS (SELECT measure, loaded_at, row_id, b, unnest(cost) AS c, unnest(a) AS p FROM f),
x AS (SELECT measure, loaded_at, row_id, p, unnest(c) AS cost, unnest(b) AS q FROM r)
SELECT measure, least(p, q) AS x, greatest(p, q) AS y, max_by(cost, {'t': loaded_at, 'r': row_id, 'c': cost}) AS cost FROM x GROUP BY ALL
"""
_TAGS = r"""regexp_replace(regexp_replace({0}, '^[\s\x{{a0}}\p{{Z}}]+', ''), '[\s\x{{a0}}\p{{Z}}]+$', '')"""
_GOOD = f"""good AS (
  SELECT row_id, phash, {_TAGS.format('caption')} AS caption, disease_label, hierarchical_disease_label, skin_concept, split_part(filename, '/', 1) AS archive
  FROM derm1_rows WHERE phash <> '' AND {_TAGS.format('caption')} <> '' AND filename LIKE '%/%')"""
DERM_CONCEPTS = f"""
WITH {_GOOD}, once AS (SELECT phash, min(row_id) AS r, arg_min(caption, row_id) AS caption FROM good GROUP BY phash, lower(caption)),
cap AS (SELECT phash, list(caption ORDER BY r) AS captions FROM once GROUP BY phash HAVING count(*) >= 2),
par AS (
  SELECT phash, arg_min(parent, row_id) AS parent FROM (
    SELECT phash, row_id, array_to_string(list_filter(list_transform(string_split(hierarchical_disease_label, ','), lambda p: {_TAGS.format('p')}),
      lambda p: p <> '' AND lower(p) <> lower({_TAGS.format('disease_label')})), ', ') AS parent
    FROM good WHERE {_TAGS.format('disease_label')} <> '' AND hierarchical_disease_label IS NOT NULL) WHERE parent <> '' GROUP BY phash)
SELECT phash AS code, captions[1] AS preferred_term, CAST(len(captions) - 1 AS INTEGER) AS n_synonyms, coalesce(parent, '') AS parents FROM cap LEFT JOIN par USING (phash)
"""
DERM_ANNOTATIONS = f"""
WITH {_GOOD}, t AS (
  SELECT row_id, phash, archive, {_TAGS.format("lower(coalesce(disease_label, ''))")} AS d, {_TAGS.format("lower(coalesce(skin_concept, ''))")} AS s FROM good),
u AS (
  SELECT row_id, phash, archive, list_sort(list_distinct(list_concat(
    CASE WHEN d IN ('', 'no definitive diagnosis') THEN [] ELSE ['disease_label:' || d] END,
    CASE WHEN s IN ('', 'no visual concepts') THEN [] ELSE list_transform(list_filter(list_transform(string_split(s, ','), lambda x: {_TAGS.format('x')}), lambda x: x <> ''), lambda x: 'skin_concept:' || x) END))) AS c FROM t)
SELECT phash AS key, row_id AS ord, archive AS source, array_to_string(c, '|') AS category FROM u
WHERE len(c) > 0 AND phash IN (SELECT phash FROM u WHERE len(c) > 0 GROUP BY phash HAVING count(DISTINCT archive) >= 2)
"""

QUERIES = {
    "d_exact_match": _distance("exact_match"),
    "d_set_jaccard": _distance("set_jaccard"),
    "d_word_jaccard": _distance("jaccard"),
    "d_masi": _distance("masi"),
    "d_levenshtein": _distance("levenshtein"),
    "d_indel": _distance("indel"),
    "d_lcs": _distance("lcsseq"),
    "word_tokens": word_tokens,
    "m_levenshtein": _matched("bipartite_levenshtein"),
    "m_jaccard": _matched("bipartite_jaccard"),
    "m_indel": _matched("bipartite_indel"),
    "m_lcs": _matched("bipartite_lcsseq"),
    "m_matrices": matrix_assignments,
    "g_two_raters_exact_match": _two_raters("exact_match"),
    "g_two_raters_set_jaccard": _two_raters("set_jaccard"),
    "g_two_raters_matched": _two_raters("bipartite_levenshtein", with_distribution=True),
    "g_items": items_of_sources,
    "g_many_raters": many_raters,
    "g_many_raters_distribution": many_raters_distribution,
    "g_krippendorff": krippendorff,
    "c_exact": chance_sample,
    "c_all": chance_all,
    "c_drawn": drawn_chance_sample,
    "e_errors": error_table,
    "e_significance": significance,
    "a_true_pairs": true_pairs,
    "a_rows": ablation_rows,
    "a_summary": ablation_summary,
    "h_label_costs": label_costs,
    "h_matrix_fates": matrix_fates,
    "n_siblings": concept_siblings,
    "n_children": concept_children,
    "n_ancestors": concept_ancestors,
    "n_lexical": concept_lexical,
    "s_meddra": meddra_concepts,
    "s_populations": populations,
    "s_derm_concepts": derm_concepts,
    "s_derm_annotations": derm_annotations,
    "x_embedding_costs": embedding_costs,
    "x_label_mean_costs": label_mean_costs,
    "x_windowed": windowed,
    "x_synthetic_results": synthetic_results,
    "x_synthetic_predictions": synthetic_predictions,
    "x_real_results": real_results,
    "x_real_chance": real_chance,
}
ORACLES = {
    "d_exact_match": _sql_distance("CASE WHEN a = b THEN 0.0 ELSE 1.0 END"),
    "d_set_jaccard": _sql_distance(_JACCARD.format("a", "b")),
    "d_word_jaccard": WORD_JACCARD,
    "d_masi": MASI,
    "d_levenshtein": _sql_distance(_LEV),
    "d_indel": INDEL,
    "d_lcs": LCS,
    "m_indel": MATCHED_INDEL,
    "m_lcs": MATCHED_LCS,
    "m_matrices": MATRICES,
    "word_tokens": WORD_TOKENS,
    "m_levenshtein": MATCHED_LEVENSHTEIN,
    "m_jaccard": MATCHED_JACCARD,
    "g_two_raters_exact_match": _two_raters_sql(_EXACT),
    "g_two_raters_set_jaccard": _two_raters_sql(_JACCARD),
    "g_items": ITEMS,
    "g_many_raters": MANY_RATERS,
    "g_krippendorff": KRIPPENDORFF,
    "c_exact": CHANCE,
    "c_all": CHANCE_ALL,
    "e_errors": ERRORS,
    "a_true_pairs": TRUE_PAIRS,
    "h_label_costs": LABEL_COSTS,
    "h_matrix_fates": MATRIX_FATES,
    "n_siblings": SIBLINGS,
    "n_children": CHILDREN,
    "n_ancestors": ANCESTORS,
    "s_meddra": MEDDRA,
    "s_derm_concepts": DERM_CONCEPTS,
    "s_derm_annotations": DERM_ANNOTATIONS,
    "x_embedding_costs": EMBEDDINGS,
    "x_label_mean_costs": LABEL_MEANS,
    "x_windowed": WINDOWED,
}
