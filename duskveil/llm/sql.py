"""DuckDB SQL of the queries that SQL can express.

The others cannot be: page alignment, random rounding, 64-bit hashes of shingles,
encoders, trained models and the search they lead are tested against brute force.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from duskveil.llm.disclosure import Disclosure
from duskveil.llm.licences import COVER, template_pairs
from duskveil.llm.quality import BOILERPLATE, SENTENCE_END, SEPARATORS, LineRules


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quality_sql(rules: LineRules = LineRules()) -> str:
    separators = ", ".join(map(_text, SEPARATORS))
    word = r"'[^\x20\x09-\x0D]+'"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), {word}) AS w
  FROM documents
), lines AS (
  SELECT r, unnest(string_split(t, chr(10))) AS line,
         unnest(range(1, len(string_split(t, chr(10))) + 1)) AS n
  FROM d
), worded AS (
  SELECT *, regexp_extract_all(line, {word}) AS lw FROM lines
), judged AS (
  SELECT r, len(lw) AS k, line,
         row_number() OVER (PARTITION BY r, line ORDER BY n) > 1 AS repeated,
         list_sum(list_transform(lw, lambda x: length(x))) AS chars,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
         len(list_filter(lw, lambda x: x IN ({separators}))) AS seps,
         len(list_filter(lw, lambda x: regexp_matches(x, {_text(SENTENCE_END)}))) AS ends,
         len(list_filter(range(1, len(lw)), lambda i: lw[i] = lw[i + 1])) AS stutter
  FROM worded WHERE len(lw) > 0
), failed AS (
  SELECT *, repeated OR 100 * symbols > {rules.max_symbol_percent} * k
         OR (seps >= 2 AND 100 * seps > {rules.max_separator_percent} * k)
         OR ends = 0
         OR (k >= {rules.caps_words} AND line = upper(line) AND line <> lower(line))
         OR 100 * stutter > {rules.max_stutter_percent} * k
         OR (k <= {rules.boilerplate_words} AND regexp_matches(lower(line), {_text(BOILERPLATE)})) AS bad
  FROM judged
), by_line AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (bad) AS n_failed_lines,
         coalesce(sum(chars) FILTER (bad), 0) AS lost_chars, count(*) FILTER (repeated) AS n_dup_lines
  FROM failed GROUP BY r
), spots AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT r, i FROM spots QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), repeats AS (
  SELECT r, count(DISTINCT i + s) AS n_repeat_words
  FROM twice, (SELECT unnest([0, 1, 2]) AS s) GROUP BY r
), measured AS (
  SELECT doc_id, len(w) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines,
         CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN by_line USING (r) LEFT JOIN repeats USING (r)
)
SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)
       AND 100 * lost_chars <= {rules.max_lost_percent} * word_chars AS kept
FROM measured
"""


#: Plain forms of the patterns of the four kinds.
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal_sql(rules: Disclosure = Disclosure()) -> str:
    kinds = " UNION ALL ".join(
        f"""SELECT r, {i} AS kind_at, '{kind}' AS kind, regexp_extract_all(t, '{pattern}') AS f,
            string_split_regex(t, '{pattern}') AS g FROM d"""
        for i, (kind, pattern) in enumerate(_KINDS.items())
    )
    counts = ", ".join(
        f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _KINDS
    )
    zeros = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in _KINDS)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS key
  FROM documents
), found AS ({kinds}), placed AS (
  SELECT r, kind_at, kind, f[i] AS value,
         list_sum(list_transform(g[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM found)
), digits AS (
  SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS n FROM placed
), base AS (
  SELECT r, kind_at, kind, CAST(start AS BIGINT) AS start, CAST(start + length(value) AS BIGINT) AS stop,
         kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN n ELSE lower(value) END AS entity,
         'group:' || kind || ':' || CASE kind WHEN 'email' THEN lower(split_part(value, '@', 2))
           WHEN 'ip' THEN array_to_string(string_split(value, '.')[1:3], '.')
           WHEN 'card' THEN left(n, 6) ELSE left(n, length(n) - 4) END AS shared
  FROM digits
  WHERE kind = 'email'
     OR (kind = 'ip' AND len(list_filter(string_split(value, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0)
     OR (kind = 'phone' AND length(n) BETWEEN 8 AND 15)
     OR (kind = 'card' AND length(n) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda i:
           CASE WHEN i % 2 = 1 THEN CAST(reverse(n)[i] AS INT)
                WHEN CAST(reverse(n)[i] AS INT) > 4 THEN CAST(reverse(n)[i] AS INT) * 2 - 9
                ELSE CAST(reverse(n)[i] AS INT) * 2 END)) % 10 = 0)
), texts AS (
  SELECT key, min(r) AS r, count(*) AS copies FROM d GROUP BY key
), mentions AS (
  SELECT DISTINCT key, copies, unnest([entity, shared]) AS entity FROM texts JOIN base USING (r)
), entities AS (
  SELECT entity, sum(copies) AS named FROM mentions GROUP BY entity HAVING count(*) > 1
), covers AS (
  SELECT r, list({{'start': start, 'stop': stop}}) AS spans FROM base WHERE r IN (SELECT r FROM texts) GROUP BY r
), blanked AS (
  SELECT key, r, array_to_string(list_transform(regexp_extract_all(t, '(?s).'), lambda c, i:
           CASE WHEN len(list_filter(spans, lambda s: s.start < i AND i <= s.stop)) > 0 THEN ' ' ELSE c END), '') AS t
  FROM covers JOIN d USING (r)
  UNION ALL
  SELECT key, r, t FROM d WHERE r IN (SELECT r FROM texts) AND r NOT IN (SELECT r FROM covers)
), words AS (
  SELECT key, unnest(list_distinct(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+'))) AS term
  FROM blanked WHERE r IN (SELECT r FROM covers)
), joint AS (
  SELECT entity, term, count(*) AS n, sum(copies) AS with_entity FROM mentions JOIN words USING (key)
  WHERE length(term) >= {rules.shortest} GROUP BY ALL
), everywhere AS (
  SELECT term, count(*) AS documents FROM (
    SELECT unnest(list_distinct(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+'))) AS term FROM d) GROUP BY term
), telltale AS (
  SELECT DISTINCT term FROM joint JOIN everywhere USING (term) JOIN entities USING (entity)
  WHERE n > 1
    AND with_entity * {2**rules.slack_bits} * CASE WHEN n >= {rules.support} THEN 1 ELSE n / (n + 2) END >= documents
    AND with_entity * (SELECT count(*) FROM d) >= documents * named * {2**rules.lift_bits}
), cut AS (
  SELECT key, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') AS f, string_split_regex(t, '[\p{{L}}\p{{N}}]+') AS g
  FROM blanked
  WHERE list_has_any(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+'), (SELECT coalesce(list(term), []) FROM telltale))
), spans AS (
  SELECT key, f[i] AS word,
         list_sum(list_transform(g[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM cut)
), extra AS (
  SELECT key, string_agg('term:' || CAST(start AS BIGINT) || ':' || CAST(start + length(word) AS BIGINT), ',' ORDER BY start) AS s
  FROM spans WHERE lower(word) IN (SELECT term FROM telltale) GROUP BY key
), by_document AS (
  SELECT r, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY kind_at, start) AS s
  FROM base GROUP BY r
)
SELECT doc_id, {zeros}, sha256(coalesce(b.s, '')) AS base_sha256,
       concat_ws(',', nullif(coalesce(b.s, ''), ''), e.s) AS spans
FROM d LEFT JOIN by_document b USING (r) LEFT JOIN extra e USING (key)
"""


def licence_sql() -> str:
    rows = [
        f"({_text(a)}, {_text(b)}, {_text(label)}, {exact}, {size}, {shift}, {spot})"
        for a, b, label, exact, size, shift, spot in template_pairs()
    ]
    return rf"""
WITH RECURSIVE templates(a, b, label, exact, size, shift, spot) AS (VALUES {", ".join(rows)}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), grams AS (
  SELECT r, i - 1 AS place, w[i] AS a, w[i + 1] AS b
  FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)
), hits AS (
  SELECT r, label, exact, size, shift, spot, place, place - spot AS diagonal
  FROM grams JOIN templates USING (a, b)
), phrases AS (
  SELECT r, label, exact, min(place) AS first, 1.0::DOUBLE AS covered FROM hits
  WHERE exact GROUP BY r, label, exact, size, diagonal HAVING count(*) = size - 1
), steps AS (
  SELECT r, label, shift, diagonal,
         diagonal - lag(diagonal) OVER (PARTITION BY r, label ORDER BY diagonal) AS step
  FROM (SELECT DISTINCT r, label, shift, diagonal FROM hits WHERE NOT exact)
), runs AS (
  SELECT r, label, diagonal, sum(CASE WHEN step <= shift THEN 0 ELSE 1 END)
         OVER (PARTITION BY r, label ORDER BY diagonal) AS run
  FROM steps
), merged AS (
  SELECT r, label, run, size, shift, list({{'place': place, 'spot': spot}} ORDER BY place, spot) AS h
  FROM hits JOIN runs USING (r, label, diagonal) WHERE NOT exact
  GROUP BY r, label, run, size, shift HAVING count(*) > 1
), walk(r, label, run, size, shift, h, i, seen, best) AS (
  SELECT r, label, run, size, shift, h, 1,
         CAST([] AS STRUCT(place BIGINT, spot INTEGER, words INTEGER)[]), 0
  FROM merged
  WHERE len(list_distinct(flatten(list_transform(h, lambda x: [x.spot, x.spot + 1])))) >= size * {COVER}
  UNION ALL
  SELECT r, label, run, size, shift, h, i + 1,
         list_append(seen, {{'place': h[i].place, 'spot': h[i].spot, 'words': words}}), greatest(best, words)
  FROM (
    SELECT *, coalesce(list_max(list_transform(
        list_filter(seen, lambda x: x.place < h[i].place AND x.spot < h[i].spot
                    AND abs((h[i].place - h[i].spot) - (x.place - x.spot)) <= shift),
        lambda x: x.words + CASE WHEN x.spot = h[i].spot - 1 THEN 1 ELSE 2 END)), 2)::INTEGER AS words
    FROM walk WHERE i <= len(h)
  )
), spans AS (
  SELECT r, label, false AS exact, CAST(NULL AS BIGINT) AS first, best / size::DOUBLE AS covered
  FROM walk WHERE i > len(h)
), every AS (
  SELECT * FROM phrases UNION ALL SELECT * FROM spans WHERE covered >= {COVER}
), scanned AS (
  SELECT r, count(*) FILTER (exact) AS n_base, CAST(min(first) FILTER (exact) AS BIGINT) AS first_word,
         CAST(max(first) FILTER (exact) AS BIGINT) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score
  FROM every GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN scanned USING (r)
"""


SQL: dict[str, str] = {
    "op1_quality_lines": quality_sql(),
    "op5_personal_spans": personal_sql(),
    "op9_licence_scan": licence_sql(),
}
