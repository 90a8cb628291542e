"""DuckDB SQL for the queries that SQL can state over whole tables."""

from __future__ import annotations

from entityflow.llm import mixing, quality_rules

_SPACE = r"[\x20\x09-\x0D]"

MIXING = f"""WITH RECURSIVE d AS (SELECT doc_id, source, text, coalesce('s:' || source, 'null') AS k, coalesce(doc_id::VARCHAR, md5(text), '') AS who,
  greatest(coalesce(strlen(text), 0), 1) AS b FROM documents),
s AS (SELECT k, sum(b)::DOUBLE AS bytes, pow(sum(b)::DOUBLE, {mixing.TEMPERATURE}) AS w FROM d GROUP BY k),
r AS (SELECT k, w / (SELECT sum(w) FROM s) * (SELECT sum(bytes) FROM s) / bytes AS rate FROM s),
c AS (SELECT k, rate, 0 AS n, exp(-rate) AS p, exp(-rate) AS cdf FROM r
  UNION ALL SELECT k, rate, n + 1, p * rate / (n + 1), cdf + p * rate / (n + 1) FROM c WHERE n < ceil(rate + 12 * sqrt(rate) + 20)),
l AS (SELECT k, list(cdf ORDER BY n) AS cdf FROM c GROUP BY k),
u AS (SELECT d.*, len(list_filter(l.cdf, lambda x: x <= ('0x' || substr(md5('{mixing.SEED}|' || who), 1, 13))::BIGINT / 4503599627370496.0)) AS copies FROM d JOIN l USING (k))
SELECT doc_id, source, text, copies, copy_no, md5('{mixing.SEED}|' || who || '|' || copy_no) AS shuffle_key FROM (SELECT *, unnest(range(copies)) AS copy_no FROM u)"""

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('h:' || source, 'null') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '{_SPACE}+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT row, i, array_to_string(list_slice(words, i, i + {quality_rules.WINDOW - 1}), chr(31)) AS win FROM (SELECT row, words, unnest(range(1, len(words) - {quality_rules.WINDOW - 2})) AS i FROM w)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM p) WHERE n > 1),
cover AS (SELECT row, count(DISTINCT i + j) AS n FROM twice, range({quality_rules.WINDOW}) t(j) GROUP BY row),
m AS (SELECT w.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cover USING (row)),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols >= 15 * word_chars OR (len(lines) >= 5 AND 2 * n_dup_lines > len(lines)) AS failed FROM b),
h AS (SELECT host, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS f FROM f GROUP BY host),
s AS (SELECT sum(n) AS n, sum(f) / sum(n) AS mean, count(*) AS h, sum(f * f / n) AS ff, sum(n * n) AS nn FROM h),
v AS (SELECT *, greatest(0, (ff - n * mean * mean - mean * (1 - mean) * (h - 1)) / greatest(1e-9, n - nn / n)) AS spread FROM s),
k AS (SELECT mean, CASE WHEN spread > 0 THEN least(1e6, greatest(2, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS strength FROM v),
bad AS (SELECT host FROM h, k WHERE (f + mean * strength) / (n + strength) > {quality_rules.MAX_HOST_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND host NOT IN (SELECT host FROM bad) AS kept FROM f"""

SQL = {"op2_mixing": MIXING, "op10_quality_rules": QUALITY}
