"""DuckDB SQL of the operators whose results SQL can express."""

from __future__ import annotations

from .quality import BOILERPLATE

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, @WORDS_T@ AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM win JOIN (SELECT r, g FROM win GROUP BY ALL HAVING count(*) > 1) USING (r, g)),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) o(j) GROUP BY r),
line AS (SELECT r, x, @WORDS_X@ AS lw FROM (SELECT r, unnest(list_distinct(lines)) AS x FROM w)),
kept AS (SELECT r, sum(len(lw)) AS n FROM line WHERE NOT (
    NOT regexp_matches(x, '[.!?…。！？:;"''”’»)\]]([\x20\x09-\x0D]*$|[\x20\x09-\x0D].{20,}$)')
    OR length(regexp_replace(x, '[^#*$%&|<>{}=~^\\»›•]', '', 'g')) > 0.3 * len(lw)
    OR length(regexp_replace(x, '[^!]', '', 'g')) > 0.6 * len(lw) + 2
    OR (len(lw) >= 4 AND len(regexp_extract_all(x, '\p{Lu}{2}')) > 0.6 * len(lw))
    OR (len(lw) >= 10 AND len(list_distinct(lw)) < 0.35 * len(lw))
    OR (len(lw) <= 20 AND regexp_matches(x, '(?i)@NOTICES@'))) GROUP BY r),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(kept.n, 0) AS BIGINT) AS n_kept_words
  FROM w LEFT JOIN cov USING (r) LEFT JOIN kept USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_kept_words,
       NOT base_failed AND 100 * n_kept_words >= 50 * n_words AS kept FROM failed"""

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
heads AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS class_id
          FROM (SELECT doc_id, list_sort(list(g)) AS t FROM s GROUP BY 1)),
reach AS (SELECT DISTINCT x AS a, x AS b FROM link UNION SELECT a, y FROM reach JOIN link ON b = x),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m, w.doc_id) AS component_id,
       coalesce(class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id) LEFT JOIN heads USING (doc_id)"""

ORACLE_SQL = {
    "op1_adaptive_prefix_join": _JACCARD,
    "op7_line_first_cleaning": _QUALITY.replace("@WORDS_T@", _WORDS.format("t"))
    .replace("@WORDS_X@", _WORDS.format("x"))
    .replace("@NOTICES@", "|".join(BOILERPLATE)),
}
