"""DuckDB SQL of the queries that SQL can express over whole tables."""

OP2 = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY flat) AS keep_id, count(*) OVER (PARTITION BY flat) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY flat) AS kept, sha256(flat) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS flat FROM documents)
"""

OP6 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM base)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT b.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims,
         length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id)
), bits AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN n_words = 0 THEN 0 ELSE
    CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_upper > 5 * word_chars THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_exclaims > 3 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 128 ELSE 0 END
    + CASE WHEN 10 * n_digits > 4 * word_chars THEN 256 ELSE 0 END END)::BIGINT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM bits
"""

ORACLES: dict[str, str] = {"op2_exact_dedup": OP2, "op6_quality_rules": OP6}
