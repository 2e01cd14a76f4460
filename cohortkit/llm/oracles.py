"""DuckDB SQL of the queries that SQL can express, written from their contracts alone."""

from __future__ import annotations

import math

from cohortkit.llm.license_scan import BLOCK, PERCENT, PHRASES, TEMPLATES
from cohortkit.llm.quality_divergence import CHAR_LIMIT, COMMON_WORDS, MIN_CHARS, MIN_COMMON_WORDS, WORD_LIMIT

_SPACE = r"'[^\x20\x09-\x0D]+'"
_LETTER = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LISTED = ", ".join(f"('{lang}', '{w}')" for lang, words in COMMON_WORDS.items() for w in words)
_PART = "CASE WHEN {p} > 0 THEN {p} / 2 * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} / 2 * log2(2 * {q} / ({p} + {q})) ELSE 0 END"
_COUNT = "length(regexp_replace(joined, '{}', '', 'g'))"
_CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "high": r"[\x00-\x7F]+", "stop": "[^.,;:!?''\"()-]+", "symbol": "[^#*$%&|<>]+"}

QUALITY = rf"""
WITH listed(lang, word) AS (VALUES {_LISTED}),
texts AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_SPACE}) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_SPACE})) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts))
), repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE c > 1) GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, lang, len(w) AS n_words, length(joined) AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         {", ".join(f"{_COUNT.format(p)} AS c_{c}" for c, p in _CLASSES.items())}
  FROM (SELECT *, array_to_string(w, '') AS joined FROM texts) t LEFT JOIN repeats r ON r.doc_id = t.doc_id
), base AS (
  SELECT *, c_symbol AS n_symbols, word_chars - {" - ".join(f"c_{c}" for c in _CLASSES)} AS c_lower, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
), common AS (
  SELECT t.doc_id, t.lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(list_transform(w, lambda x: lower(x))) AS word FROM texts) t
  JOIN listed l USING (lang, word) GROUP BY ALL
), classes AS (
  SELECT doc_id, lang, base_failed, word_chars, class, n FROM base UNPIVOT (n FOR class IN (c_lower, {", ".join(f"c_{c}" for c in _CLASSES)}))
), ref_classes AS (SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM classes WHERE NOT base_failed GROUP BY lang, class),
chars AS (
  SELECT doc_id, sqrt(greatest(sum({_PART.format(p="(c.n / word_chars)", q="r.q")}), 0)) AS d
  FROM classes c JOIN ref_classes r USING (lang, class) WHERE word_chars >= {MIN_CHARS} GROUP BY doc_id
), ref_words AS (
  SELECT c.lang, word, sum(c.n) / any_value(t.total) AS q FROM common c JOIN base b USING (doc_id)
  JOIN (SELECT lang, sum(n_words) AS total FROM base WHERE NOT base_failed GROUP BY lang) t ON t.lang = c.lang
  WHERE NOT base_failed GROUP BY c.lang, word
), entries AS (
  SELECT b.doc_id, coalesce(c.n, 0) / b.n_words AS p, r.q FROM base b JOIN ref_words r USING (lang) LEFT JOIN common c ON c.doc_id = b.doc_id AND c.word = r.word
  WHERE b.n_words >= {MIN_COMMON_WORDS}
), rests AS (SELECT doc_id, 1 - sum(p) AS p, 1 - sum(q) AS q, sum({_PART.format(p="p", q="q")}) AS d FROM entries GROUP BY doc_id),
words AS (SELECT doc_id, sqrt(greatest(d + {_PART.format(p="p", q="q")}, 0)) AS d FROM rests)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(c.d > {CHAR_LIMIT}, false) AND NOT coalesce(w.d > {WORD_LIMIT}, false) AS kept,
       round(c.d, 4) AS char_distance, round(w.d, 4) AS word_distance
FROM base b LEFT JOIN chars c USING (doc_id) LEFT JOIN words w USING (doc_id)
"""

PASSAGES = rf"""
WITH texts AS (
  SELECT doc_id, md5(text) AS th, regexp_extract_all({_LOWER.format("text")}, {_SPACE}) AS w FROM documents WHERE text IS NOT NULL
), copied AS (SELECT th FROM texts GROUP BY th HAVING min(doc_id) < max(doc_id)),
windows AS (
  SELECT doc_id, th, s, md5(array_to_string(w[s + 1 : s + 50], ' ')) AS h FROM (SELECT *, unnest(range(0, len(w) - 49)) AS s FROM texts WHERE len(w) >= 50)
), shared AS (SELECT h FROM windows GROUP BY h HAVING min(th) < max(th)),
hits AS (SELECT DISTINCT doc_id, th, s FROM windows WHERE h IN (SELECT h FROM shared) AND th NOT IN (SELECT th FROM copied)),
runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, th ORDER BY s) AS run
  FROM (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id, th ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM hits)
), spans AS (
  SELECT doc_id, min(s) AS start_word, max(s) + 50 AS end_word FROM runs GROUP BY doc_id, th, run
  UNION ALL SELECT doc_id, 0, len(w) FROM texts WHERE len(w) >= 50 AND th IN (SELECT th FROM copied)
)
SELECT doc_id, start_word, end_word, end_word - start_word AS n_words FROM spans
"""

CONTAINED = rf"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, text, regexp_extract_all(lower(text), {_LETTER}) AS w FROM documents WHERE text IS NOT NULL
  UNION SELECT 'i', item_id, text, regexp_extract_all(lower(text), {_LETTER}) FROM benchmark WHERE text IS NOT NULL
), short AS (SELECT DISTINCT len(w) AS m FROM words WHERE side = 'i' AND len(w) BETWEEN 1 AND 4), shingles AS (
  SELECT DISTINCT side, id, text, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM words WHERE len(w) >= 5)
  UNION SELECT side, id, text, array_to_string(w, ' ') FROM words WHERE side = 'i' AND len(w) BETWEEN 1 AND 4
  UNION SELECT side, id, text, array_to_string(w[k : k + m - 1], ' ') FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM words, short WHERE side = 'd' AND len(w) >= m)
), sized AS (SELECT *, count(*) OVER (PARTITION BY id, text) AS q FROM shingles WHERE side = 'i')
SELECT d.id AS doc_id, i.id AS item_id, i.q AS item_shingles, count(*) AS hits, round(count(*) / i.q, 6) AS containment
FROM shingles d JOIN sized i ON d.s = i.s AND d.side = 'd'
GROUP BY d.id, d.text, i.id, i.text, i.q
HAVING 100 * count(*) >= 80 * i.q
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACE}) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM texts UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""

_PHRASES = " UNION ALL ".join(
    f"SELECT doc_id, k - 1 AS place, '{label}' AS label FROM places WHERE w[k : k + {len(phrase.split()) - 1}] = {phrase.split()!r}" for phrase, label in PHRASES.items()
)
_TEMPLATES = ", ".join(
    f"('{label}', {sorted(set(t.split()))!r}, {math.ceil(len(set(t.split())) * PERCENT / 100 - 1e-9)})" for label, texts in TEMPLATES.items() for t in texts
)
_HALF = BLOCK // 2

LICENSES = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_LETTER}) AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM texts),
base AS ({_PHRASES}),
counted AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi FROM base GROUP BY doc_id),
templates(label, words, need) AS (VALUES {_TEMPLATES}),
blocks AS (SELECT doc_id, w[greatest(b * {_HALF}, 0) + 1 : b * {_HALF} + {BLOCK}] AS own FROM (SELECT *, unnest(range(-1, len(w) // {_HALF} + 1)) AS b FROM texts)),
found AS (
  SELECT doc_id, label, max(len(list_intersect(own, words)) / len(words)) AS containment FROM blocks, templates
  WHERE len(list_intersect(own, words)) >= need GROUP BY doc_id, label
), named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM found) GROUP BY doc_id),
best AS (SELECT doc_id, max(containment) AS containment FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(n.labels, '') AS base_labels, coalesce(e.labels, '') AS labels,
       CASE WHEN c.n > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0) END AS score
FROM texts LEFT JOIN counted c USING (doc_id) LEFT JOIN named n USING (doc_id) LEFT JOIN every e USING (doc_id) LEFT JOIN best USING (doc_id)
"""

_ROUNDS = 4


def _assigned(book: str) -> str:
    """Each part with its nearest entry of ``book``: least distance, then least index."""
    return f"""
  SELECT k, p, min_by(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT a.k, a.p, b.e, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts a JOIN {book} b USING (p)
  ) GROUP BY k, p"""


def _round(n: int) -> str:
    return f"""
a{n} AS MATERIALIZED ({_assigned(f"b{n}")}),
m{n} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT p, e, i, floor(s / c)::BIGINT - CASE WHEN floor(s / c)::BIGINT * c > s THEN 1 ELSE 0 END AS m FROM (
      SELECT p, e, i, sum(v)::BIGINT AS s, count(*)::BIGINT AS c FROM (SELECT a.p, a.e, unnest(range(1, len(t.x) + 1)) AS i, unnest(t.x) AS v FROM a{n} a JOIN parts t USING (k, p)) GROUP BY p, e, i
    )
  ) GROUP BY p, e
),
b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m USING (p, e)),"""


VECTOR_CODES = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT k, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p)),
b0 AS (SELECT p, k - 1 AS e, x FROM parts WHERE k <= 256),
{"".join(_round(n) for n in range(_ROUNDS))}
final AS MATERIALIZED ({_assigned(f"b{_ROUNDS}")}),
coded AS (SELECT k, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM final GROUP BY k)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{_ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (k)
"""

_SHARE = "1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * v)"
SOURCE_AUDIT = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, lang, source, {_LOWER.format("w")} AS term FROM (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d)),
kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format(n="coalesce(c.n, 0)", total="coalesce(t.total, 0)")} AS p, {_SHARE.format(n="k.lang_n", total="l.lang_total")} AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS s1, b.source AS s2, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) x
  ON x.lang = a.lang AND x.s1 = a.source AND x.s2 = b.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
) WHERE part = 'pair' OR rank <= 50
"""
