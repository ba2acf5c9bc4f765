"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

import string

WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_TEXT = "coalesce(text, '')"
_LOWER = f"translate({_TEXT}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=_LOWER)} AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS shared
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 85 * (nx + ny - shared)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION
  SELECT reach.id, b.y FROM reach JOIN both_ways b ON b.x = reach.r),
named AS (SELECT id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN named ON id = doc_id"""

REPEATS = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text=_TEXT)} AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT i + j) AS ps FROM later, range(20) t(j) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(ws) + 1),
    lambda p: NOT coalesce(list_contains(ps, p), false)), lambda p: ws[p]), ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id"""

_RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
_MOMENTS = ", ".join(f"avg(k_{r} / n) AS mean_{r}, var_pop(k_{r} / n) - avg(k_{r} / n) * (1 - avg(k_{r} / n)) * avg(1 / n) "
                     f"AS spread_{r}" for r in _RULES)
_STRENGTH = ("CASE WHEN spread_{r} * 1e6 > mean_{r} * (1 - mean_{r}) "
             "THEN greatest(mean_{r} * (1 - mean_{r}) / spread_{r} - 1, 1.0) ELSE 1e6 END")
_FAILED = " OR ".join(f"(k_{r} + mean_{r} * {_STRENGTH.format(r=r)}) / (n + {_STRENGTH.format(r=r)}) > 0.5"
                      for r in _RULES)

QUALITY = rf"""
WITH t AS (SELECT doc_id, source, {_TEXT} AS x, {WORDS.format(text=_TEXT)} AS ws,
  list_filter(string_split({_TEXT}, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) r(j) GROUP BY 1),
m AS (SELECT t.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN covered ON covered.doc_id = t.doc_id),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n,
  {", ".join(f"sum(CASE WHEN {rule} THEN 1.0 ELSE 0.0 END) AS k_{r}" for r, rule in _RULES.items())}
  FROM m WHERE source IS NOT NULL GROUP BY 1),
prior AS (SELECT {_MOMENTS} FROM hosts),
verdicts AS (SELECT source, {_FAILED} AS failed FROM hosts, prior),
judged AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  coalesce(failed, false) AS host_failed FROM m LEFT JOIN verdicts v ON v.source = m.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed,
  NOT base_failed AND NOT host_failed AS kept FROM judged"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
size AS (SELECT doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
held AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY 1, 2),
weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, total GROUP BY 1),
asked AS (SELECT item_id, t, count(*) AS repeats
  FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY 1, 2),
found AS (SELECT item_id, held.doc_id, CAST(sum(repeats * w * ((1000000000 * tf)
    // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (t) JOIN held USING (t) JOIN size ON size.doc_id = held.doc_id, total GROUP BY 1, 2),
best AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
  doc_id, score FROM found WHERE score > 0)
SELECT * FROM best WHERE rank <= 10"""

ORACLE_SQL = {"op2_near_duplicates": NEAR_DUPLICATES, "op5_quality": QUALITY, "op10_repeats": REPEATS,
              "op12_lexical_search": SEARCH}
