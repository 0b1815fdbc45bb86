"""DuckDB SQL for the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

LINE_DEDUP = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM parts),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
m AS (SELECT doc_id, len(words) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS full_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters FROM d),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS win FROM d, unnest(range(1, len(words) - 3)) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM w) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, unnest(range(5)) AS s(k) GROUP BY doc_id),
x AS (SELECT doc_id, n_words, word_chars, n_symbols, len(full_lines) AS n_lines, len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, n_capitals, n_letters FROM m LEFT JOIN rep USING (doc_id)),
y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR 10 * n_dup_lines > 5 * n_lines OR word_chars < 2 * n_words OR word_chars > 40 * n_words
    OR (n_letters >= 50 AND 10 * n_capitals > 6 * n_letters)) AS kept
FROM y
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS win FROM d, unnest(range(1, len(words) - 48)) AS t(i)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM w) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM f, unnest(range(50)) AS s(k)),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
m AS (SELECT p.*, g.pos IS NOT NULL AS hit FROM p LEFT JOIN gone g USING (doc_id, pos)),
r AS (SELECT doc_id, count(*) AS n_words, CAST(count(*) FILTER (hit) AS BIGINT) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT hit), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

ORACLES: dict[str, str] = {"op3_line_dedup": LINE_DEDUP, "op7_substring_dedup": SUBSTRING_DEDUP, "op10_quality_rules": QUALITY_RULES}
