"""Queries outside the corpus operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accordant.plans import agreement, quality

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "p2_found": quality.concept_cycles,
    "p2_paths": quality.concept_paths,
    "p2_descendants": quality.concept_descendants,
    "p3_found": quality.packed_values,
    "p3_delimiters": quality.packed_delimiters,
    "p4_found": quality.unsound_lines,
    "p4_predictions": quality.sound_predictions,
    "p4_concepts": quality.sound_concepts,
    "p4_files": quality.recovered_records,
    "p5_found": quality.orphan_references,
    "p5_by_month": quality.orphans_by_month,
    **agreement.QUERIES,
}

_KEY = r"regexp_replace(upper(trim({0}, E' \t\n\r ')), '^[+]?0*([0-9]+?)(?:[.]0*)?$', '\1')"
_ORPHANS = f"""
WITH keys AS (
  SELECT 'c/' || taxonomy AS d, {_KEY.format('n')} AS k, loaded_at AS s, retired_at AS u FROM (
    SELECT taxonomy, loaded_at, retired_at, unnest(list_concat([code], coalesce(hierarchy_key, []))) AS n FROM concepts)
  UNION ALL SELECT 'p', {_KEY.format('pt_code')}, loaded_at, retired_at FROM meddra_pt
  UNION ALL SELECT 's', concat_ws('~', dataset, mode, negative_mode, agreement_level, seed, sample_index), loaded_at, retired_at FROM predictions
), refs AS (
  SELECT 'concepts' AS tbl, row_id, ref, loaded_at AS t, 'c/' || taxonomy AS d, {_KEY.format('ref')} AS k FROM (
    SELECT row_id, taxonomy, loaded_at, unnest(list_distinct(parent_codes)) AS ref FROM concepts) WHERE NOT regexp_full_match(ref, '[\\s\\x{{a0}}]*')
  UNION ALL SELECT 'meddra_llt', row_id, pt_code, loaded_at, 'p', {_KEY.format('pt_code')} FROM meddra_llt WHERE NOT regexp_full_match(pt_code, '[\\s\\x{{a0}}]*')
  UNION ALL SELECT 'cost_matrices', row_id, sample_index::VARCHAR, loaded_at, 's', concat_ws('~', dataset, mode, negative_mode, agreement_level, seed, sample_index)
    FROM cost_matrices WHERE sample_index IS NOT NULL
), f AS (
  SELECT tbl, row_id, ref, strftime(t, '%Y-%m') AS loaded_month,
    CASE WHEN count(keys.k) = 0 THEN 'missing' WHEN min(s) > t THEN 'late' WHEN bool_or(s <= t AND (u IS NULL OR t < u)) THEN 'there' ELSE 'deleted' END AS fate
  FROM refs LEFT JOIN keys USING (d, k) GROUP BY tbl, row_id, ref, t
)"""

_CYCLES = r"""
WITH RECURSIVE rows AS (
  SELECT taxonomy, upper(trim(code, E' \t\n\r ')) AS k, code, parent_codes, hierarchy_key,
    row_number() OVER (PARTITION BY taxonomy, upper(trim(code, E' \t\n\r ')) ORDER BY loaded_at DESC, row_id DESC) AS n
  FROM concepts WHERE trim(code, E' \t\n\r ') <> ''
), c AS (SELECT * FROM rows WHERE n = 1),
names AS (SELECT DISTINCT taxonomy, k, upper(trim(x, E' \t\n\r ')) AS name FROM (SELECT taxonomy, k, unnest(list_concat([code], coalesce(hierarchy_key, []))) AS x FROM c)),
e AS (
  SELECT DISTINCT p.taxonomy, p.k AS u, names.k AS v FROM (SELECT taxonomy, k, upper(trim(x, E' \t\n\r ')) AS name FROM (SELECT taxonomy, k, unnest(parent_codes) AS x FROM c)) p
  JOIN names USING (taxonomy, name)
), r AS (SELECT taxonomy, u, v FROM e UNION SELECT r.taxonomy, r.u, e.v FROM r JOIN e ON e.taxonomy = r.taxonomy AND e.u = r.v)
SELECT a.taxonomy, min(o.code) AS cycle_code, c.code
FROM r a JOIN r b ON a.taxonomy = b.taxonomy AND a.u = b.v AND a.v = b.u
JOIN c ON c.taxonomy = a.taxonomy AND c.k = a.u JOIN c o ON o.taxonomy = a.taxonomy AND o.k = a.v
GROUP BY a.taxonomy, c.code
"""

_LINKS = r"""
rows AS (
  SELECT taxonomy, upper(trim(code, E' \t\n\r ')) AS k, code, parent_codes, hierarchy_key,
    row_number() OVER (PARTITION BY taxonomy, upper(trim(code, E' \t\n\r ')) ORDER BY loaded_at DESC, row_id DESC) AS n
  FROM concepts WHERE trim(code, E' \t\n\r ') <> ''
), c AS (SELECT * FROM rows WHERE n = 1),
names AS (SELECT DISTINCT taxonomy, k, upper(trim(x, E' \t\n\r ')) AS name FROM (SELECT taxonomy, k, unnest(list_concat([code], coalesce(hierarchy_key, []))) AS x FROM c)),
links AS (
  SELECT p.taxonomy, p.k AS u, names.k AS v, min(place) AS place FROM (
    SELECT taxonomy, k, generate_subscripts(parent_codes, 1) AS place, upper(trim(unnest(parent_codes), E' \t\n\r ')) AS name FROM c) p
  JOIN names USING (taxonomy, name) WHERE p.k <> names.k GROUP BY ALL
), up AS (SELECT taxonomy, u, min_by(v, place) AS v FROM links GROUP BY taxonomy, u)"""
_PATHS = "WITH RECURSIVE " + _LINKS + """,
way AS (
  SELECT c.taxonomy, c.k, [c.code] AS path FROM c LEFT JOIN up ON up.taxonomy = c.taxonomy AND up.u = c.k WHERE up.u IS NULL
  UNION ALL
  SELECT c.taxonomy, c.k, list_append(way.path, c.code) FROM way JOIN up ON up.taxonomy = way.taxonomy AND up.v = way.k JOIN c ON c.taxonomy = up.taxonomy AND c.k = up.u
)
SELECT c.taxonomy, c.code, array_to_string(path, ' > ') AS path, CAST(coalesce(len(path), 0) - 1 AS INTEGER) AS depth, path[1] AS root
FROM c LEFT JOIN way ON way.taxonomy = c.taxonomy AND way.k = c.k
"""
_DESCENDANTS = r"""
WITH RECURSIVE rows AS (
  SELECT taxonomy, upper(trim(code, E' \t\n\r ')) AS k, code, parent_codes, hierarchy_key,
    row_number() OVER (PARTITION BY taxonomy, upper(trim(code, E' \t\n\r ')) ORDER BY loaded_at DESC, row_id DESC) AS n
  FROM concepts WHERE trim(code, E' \t\n\r ') <> ''
), c AS (SELECT * FROM rows WHERE n = 1),
names AS (SELECT DISTINCT taxonomy, k, upper(trim(x, E' \t\n\r ')) AS name FROM (SELECT taxonomy, k, unnest(list_concat([code], coalesce(hierarchy_key, []))) AS x FROM c)),
e AS (
  SELECT DISTINCT p.taxonomy, p.k AS u, names.k AS v FROM (SELECT taxonomy, k, upper(trim(x, E' \t\n\r ')) AS name FROM (SELECT taxonomy, k, unnest(parent_codes) AS x FROM c)) p
  JOIN names USING (taxonomy, name)
), r AS (SELECT taxonomy, u, v FROM e UNION SELECT r.taxonomy, r.u, e.v FROM r JOIN e ON e.taxonomy = r.taxonomy AND e.u = r.v)
SELECT DISTINCT r.taxonomy, a.code AS code, d.code AS descendant
FROM r JOIN c a ON a.taxonomy = r.taxonomy AND a.k = r.v JOIN c d ON d.taxonomy = r.taxonomy AND d.k = r.u WHERE r.u <> r.v
"""

_DEFECTS = r"""
WITH l AS (
  SELECT line_id, feed, CASE feed WHEN 'icd11' THEN chr(9) ELSE ',' END AS sep,
    regexp_replace(regexp_replace(line, '^\x{FEFF}', ''), '(\r\n|\n|\r)$', '') AS t
  FROM raw_lines
), q AS (
  SELECT *, CASE feed
    WHEN 'icd11' THEN regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*')
    ELSE regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') END AS quoted,
    regexp_replace(t, '(?s)"(?:[^"]|"")*"', 'Q', 'g') AS bare
  FROM l
), n AS (
  SELECT *, len(bare) - len(replace(bare, sep, '')) + 1 AS n, contains(bare, chr(10)) AS broken,
    list_transform(
      CASE feed WHEN 'icd11' THEN regexp_extract_all(chr(9) || t, '(?s)\t("(?:[^"]|"")*"|[^"\t]*)', 1)
      ELSE regexp_extract_all(',' || t, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) END,
      lambda f: CASE WHEN f LIKE '"%' THEN replace(substr(f, 2, len(f) - 2), '""', '"') ELSE f END) AS f
  FROM q
), d AS (
  SELECT line_id, feed, f, CASE
    WHEN NOT quoted THEN 'quoting'
    WHEN broken OR n <> CASE feed WHEN 'icd11' THEN 10 ELSE 14 END THEN 'columns'
    WHEN feed = 'icd11' THEN CASE
      WHEN f[5] NOT IN ('chapter', 'block', 'category') OR (f[2] = '' AND f[5] = 'category')
        OR (f[2] <> '' AND NOT regexp_full_match(f[2], '[A-Z0-9]+([.][A-Z0-9]+)*'))
        OR regexp_full_match(f[4], '[\s\x{a0}\p{Z}\p{Pd}]*') OR regexp_matches(f[4], '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffd}]') THEN 'value' END
    ELSE CASE
      WHEN NOT regexp_full_match(f[9], '[0-9]+') OR NOT regexp_full_match(f[14], '[0-9]+([.][0-9]+)?') OR coalesce(TRY_CAST(f[14] AS DOUBLE) > 1, TRUE)
        OR NOT regexp_full_match(f[12], '(?s)\s*\[\s*("(?:[^"\\\x00-\x1f]|\\.)*"\s*(,\s*"(?:[^"\\\x00-\x1f]|\\.)*"\s*)*)?\]\s*') OR regexp_matches(f[12], '[\[,]\s*"[\s\p{Z}]*"\s*[,\]]')
        OR NOT regexp_full_match(f[13], '(?s)\s*\[\s*("(?:[^"\\\x00-\x1f]|\\.)*"\s*(,\s*"(?:[^"\\\x00-\x1f]|\\.)*"\s*)*)?\]\s*') OR regexp_matches(f[13], '[\[,]\s*"[\s\p{Z}]*"\s*[,\]]') THEN 'value' END
  END AS defect FROM n
)
"""
_FOUND_DEFECTS = _DEFECTS + "SELECT line_id, defect FROM d WHERE defect IS NOT NULL"
_ICD11_NAMES = ["Foundation_URI", "Code", "BlockId", "Title", "ClassKind", *(f"Grouping{i}" for i in range(1, 6))]
_SOUND_CONCEPTS = _DEFECTS + f"SELECT line_id, {', '.join(f'f[{i}] AS {c}' for i, c in enumerate(_ICD11_NAMES, 1))} FROM d WHERE defect IS NULL AND feed = 'icd11'"
_SOUND_PREDICTIONS = _DEFECTS + """
SELECT line_id, f[1] AS dataset, f[2] AS mode, f[3] AS negative_mode, TRY_CAST(f[4] AS DOUBLE) AS agreement_level, TRY_CAST(f[5] AS BIGINT) AS seed,
  f[6] AS measure, f[7] AS chance_measure, TRY_CAST(f[8] AS BOOLEAN) AS reasoning, TRY_CAST(f[9] AS BIGINT) AS sample_index,
  TRY_CAST(f[10] AS INTEGER) AS rater_a_set_size, TRY_CAST(f[11] AS INTEGER) AS rater_b_set_size,
  array_to_string(from_json(f[12], '["VARCHAR"]'), '|') AS rater_a, array_to_string(from_json(f[13], '["VARCHAR"]'), '|') AS rater_b, TRY_CAST(f[14] AS DOUBLE) AS distance
FROM d WHERE defect IS NULL AND feed = 'predictions'
"""

# fields cut by one expression: a quoted value, or the shortest stretch before a mark, brackets taken whole
_W = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_MARK = rf"->|[,;|>\x{{bb}}\x{{ff0c}}\x{{ff1b}}\x{{3001}}\t]|[\n\r]+|{_W}/(?:{_W}|$)"


def _pieces(mark: str) -> str:
    quoted = r'"(?:[^"\\]|\\.|"")*"|\x27(?:[^\x27\\]|\\.|\x27\x27)*\x27'
    return rf"(?s)({_W}*(?:{quoted}){_W}*|(?:\((?:[^()]|\([^()]*\))*\)|.)*?)({mark}|$)"


_FIELDS = rf"""
WITH t AS (
  SELECT row_id, CASE WHEN contains(filename, '/') THEN split_part(filename, '/', 1) ELSE '' END AS source, f AS field,
    regexp_replace(v, '^{_W}+|{_W}+$', '', 'g') AS t
  FROM (SELECT row_id, filename, unnest(['skin_concept', 'hierarchical_disease_label']) AS f, unnest([skin_concept, hierarchical_disease_label]) AS v FROM derm1_rows)
), u AS (SELECT row_id, source, field, CASE WHEN len(t) > 1 AND t[1] = '[' AND t[-1] = ']' THEN t[2:-2] ELSE t END AS t FROM t WHERE t <> '')"""
_VALUES = _FIELDS + rf""", v AS (
  SELECT row_id, field, list_filter(list_transform(list_transform(regexp_extract_all(t, '{_pieces(_MARK)}', 1),
      lambda x: regexp_replace(x, '^{_W}+|{_W}+$', '', 'g')),
      lambda x: regexp_replace(CASE WHEN len(x) > 1 AND x[1] = x[-1] AND x[1] IN ('"', chr(39))
        THEN regexp_replace(replace(x[2:-2], x[1] || x[1], x[1]), '\\(["\x27\\])', '\1', 'g') ELSE x END, '^{_W}+|{_W}+$', '', 'g')),
    lambda x: x <> '') AS vals
  FROM u
)
SELECT row_id, field AS field_name, CAST(unnest(range(1, len(vals) + 1)) AS INTEGER) AS pos, unnest(vals) AS val FROM v
WHERE NOT (field = 'skin_concept' AND len(vals) = 1 AND lower(vals[1]) = 'no visual concepts')
"""
# another way to tell delimiters: what stands before one also stands, somewhere in the field, before another mark or at the
# end, and some field has it twice
_ANY = _MARK + r"|[&+:~\x{2022}-]"
_DELIMITERS = _FIELDS + rf""", p AS (
  SELECT row_id, source, field, generate_subscripts(x, 1) AS i, lower(regexp_replace(unnest(x), '^[\s"\x27]+|[\s"\x27]+$', '', 'g')) AS piece,
    unnest(m) AS mark FROM (SELECT *, regexp_extract_all(t, '{_pieces(_ANY)}', 1) AS x, regexp_extract_all(t, '{_pieces(_ANY)}', 2) AS m FROM u)
), named AS (
  SELECT *, CASE WHEN regexp_full_match(mark, '[\n\r]+') THEN 'newline' WHEN mark = chr(9) THEN 'tab' WHEN contains(mark, '/') THEN ' / ' ELSE mark END AS name FROM p
), before AS (
  SELECT field, piece, name, count(*) AS n FROM named WHERE piece <> '' GROUP BY ALL
), free AS (
  SELECT b.field, b.name, sum(CASE WHEN o.n > b.n THEN b.n ELSE 0 END) / sum(b.n) AS share
  FROM before b JOIN (SELECT field, piece, sum(n) AS n FROM before GROUP BY ALL) o USING (field, piece) WHERE b.name <> '' GROUP BY ALL
), twice AS (SELECT DISTINCT field, name FROM (SELECT row_id, field, name FROM named GROUP BY ALL HAVING count(*) > 1))
SELECT s.field, s.source, coalesce(string_agg(free.name, '|' ORDER BY free.name), '') AS delimiters
FROM (SELECT DISTINCT field, source FROM u) s
LEFT JOIN (SELECT DISTINCT field, source, name FROM named WHERE name <> '') o USING (field, source)
LEFT JOIN free ON free.field = o.field AND free.name = o.name AND free.share > 0.3 AND (free.field, free.name) IN (SELECT (field, name) FROM twice) GROUP BY s.field, s.source
"""

ORACLES: dict[str, str] = {
    "p2_found": _CYCLES,
    "p2_paths": _PATHS,
    "p2_descendants": _DESCENDANTS,
    "p3_found": _VALUES,
    "p3_delimiters": _DELIMITERS,
    "p4_found": _FOUND_DEFECTS,
    "p4_concepts": _SOUND_CONCEPTS,
    "p4_predictions": _SOUND_PREDICTIONS,
    "p5_found": _ORPHANS + "SELECT * FROM f WHERE fate <> 'there'",
    "p5_by_month": _ORPHANS + "SELECT tbl, loaded_month, fate, count(*) AS n, count(DISTINCT ref) AS n_keys FROM f WHERE fate <> 'there' GROUP BY ALL",
    **agreement.ORACLES,
}
