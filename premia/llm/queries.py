"""The queries opN_<name> over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.llm import bpe, compact_windows, langid, mixing, quality, simhash, spotsigs, sstable, suffix_dedup, token_count
from premia.llm._common import scratch, table, written


def tokenizer_path() -> str:
    """Where the public byte-level vocabulary lies; a parameter of every operator that tokenizes."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_column(found["fp"]).alias("fingerprint"), "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.in_order(mixing.plan(table(spark, sf_dir, "documents")))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.classes(table(spark, sf_dir, "documents"))


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sstable.write_shards(table(spark, sf_dir, "documents"), path, tokenizer_path())
    docs = written(sstable.read_shards(spark, path))
    return sstable.with_starts(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality, op3_langid, op4_simhash, op5_suffix_dedup, op6_mixing, op7_spotsigs, op8_compact_windows, op9_sstable, op10_token_counts)}
ORACLE_SQL: dict[str, str] = {
    "op2_quality": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS m FROM (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, list_slice(w, i, i + 4) AS g FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE m > 1) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines, count(*) FILTER (regexp_matches(x, '[.!?][ \t\n\x0B\f\r]*$')) AS n_ended
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ \t\n\x0B\f\r]') GROUP BY 1),
c AS (SELECT doc_id, len(w)::BIGINT AS n, length(array_to_string(w, ''))::BIGINT AS chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_ended, 0) AS n_ended, len(list_distinct(w)) AS n_distinct, length(regexp_replace(t, '\P{{L}}', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper,
  length(regexp_replace(t, '[^.!?。！？]', '', 'g')) AS n_stops FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
v AS (SELECT *, n < 10 OR 100 * n_repeat_words > 20 * n AS base_failed, [
  CASE WHEN 10 * n_symbols > n THEN 0 WHEN 50 * n_symbols <= n THEN 1 END, CASE WHEN 100 * n_letters < 92 * chars THEN 0 WHEN 100 * n_letters > 95 * chars THEN 1 END,
  CASE WHEN 10 * chars < 44 * n OR 10 * chars > 65 * n THEN 0 WHEN 10 * chars >= 47 * n AND 10 * chars <= 60 * n THEN 1 END, CASE WHEN 100 * n_ended < 95 * n_lines THEN 0 WHEN 100 * n_ended >= 99 * n_lines THEN 1 END,
  CASE WHEN 10 * n_distinct < 6 * n THEN 0 WHEN 10 * n_distinct > 7 * n THEN 1 END, CASE WHEN 10 * n_dup_lines > n_lines THEN 0 WHEN n_dup_lines = 0 THEN 1 END,
  CASE WHEN 20 * n_repeat_words > n THEN 0 WHEN 100 * n_repeat_words <= n THEN 1 END, CASE WHEN 10 * n_upper > chars THEN 0 WHEN 25 * n_upper < chars THEN 1 END,
  CASE WHEN 25 * n_stops < n THEN 0 WHEN 20 * n_stops > n THEN 1 END, CASE WHEN n < 20 THEN 0 WHEN n >= 50 THEN 1 END] AS vote FROM c),
p AS (SELECT vote, count(*)::DOUBLE AS m, least(0.98, greatest(0.02, coalesce(list_avg(vote), 1) ** 3))::DOUBLE AS s0 FROM v WHERE NOT base_failed GROUP BY 1),
em AS (
  SELECT 0 AS round, list({{'vote': vote, 'm': m, 's': s0}}) AS rows, NULL::DOUBLE AS good, NULL::DOUBLE[] AS b, NULL::DOUBLE[] AS f FROM p
  UNION ALL
  SELECT round + 1, list_transform(rows, lambda x: {{'vote': x.vote, 'm': x.m, 's': 1 / (1 + exp(-(ln(good1 / (1 - good1)) + coalesce(list_sum(list_transform(range(1, {len(quality.RULES) + 1}), lambda j: CASE x.vote[j] WHEN 0 THEN ln(f1[j] / b1[j]) WHEN 1 THEN ln((1 - f1[j]) / (1 - b1[j])) ELSE 0 END)), 0))))}}), good1, b1, f1
  FROM (SELECT round, rows, (list_sum(list_transform(rows, lambda x: x.s * x.m)) + 1) / (list_sum(list_transform(rows, lambda x: x.m)) + 2) AS good1,
    list_transform(range(1, {len(quality.RULES) + 1}), lambda j: (list_sum(list_transform(rows, lambda x: CASE WHEN x.vote[j] = 0 THEN (1 - x.s) * x.m ELSE 0 END)) + 1) / (list_sum(list_transform(rows, lambda x: CASE WHEN x.vote[j] IS NULL THEN 0 ELSE (1 - x.s) * x.m END)) + 2)) AS b1,
    list_transform(range(1, {len(quality.RULES) + 1}), lambda j: (list_sum(list_transform(rows, lambda x: CASE WHEN x.vote[j] = 0 THEN x.s * x.m ELSE 0 END)) + 1) / (list_sum(list_transform(rows, lambda x: CASE WHEN x.vote[j] IS NULL THEN 0 ELSE x.s * x.m END)) + 2)) AS f1 FROM em WHERE round < {quality.ROUNDS})
),
fit AS (SELECT CASE WHEN list_sum(b) < list_sum(f) THEN 1 - good ELSE good END AS good, CASE WHEN list_sum(b) < list_sum(f) THEN f ELSE b END AS b, CASE WHEN list_sum(b) < list_sum(f) THEN b ELSE f END AS f FROM em WHERE round = {quality.ROUNDS}),
o AS (SELECT v.*, 1 / (1 + exp(-(ln(good / (1 - good)) + list_sum(list_transform(range(1, {len(quality.RULES) + 1}), lambda j: CASE vote[j] WHEN 0 THEN ln(f[j] / b[j]) WHEN 1 THEN ln((1 - f[j]) / (1 - b[j])) ELSE 0 END))))) AS posterior FROM v, fit)
SELECT doc_id, n AS n_words, chars AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= {quality.KEEP} AS kept, round(posterior, 6) AS posterior FROM o
""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER ()::DOUBLE AS total FROM s),
c AS (SELECT *, ratio <= (total - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM r),
t AS (SELECT source, source_size, round(CASE WHEN capped THEN 3.0::DOUBLE * source_size ELSE weight * ((total - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0)) / sum(weight) FILTER (NOT capped) OVER ()) END, 6)::DOUBLE AS target FROM c),
m AS (SELECT d.doc_id, d.k, d.size, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT doc_id, size, sum(size) OVER (ORDER BY (2 * (e * source_size + upto) - size) / (2 * target), k, doc_id, e ROWS UNBOUNDED PRECEDING) AS cum, sum(size) FILTER (e = 0) OVER () AS budget FROM m, range(3) x(e) WHERE size > 0 AND target > 0),
n AS (SELECT doc_id, count(*) AS copies FROM q WHERE 2 * cum - size <= 2 * budget GROUP BY 1)
SELECT doc_id, size, source_size, target, (size * coalesce(copies, 0))::BIGINT AS taken FROM m LEFT JOIN n USING (doc_id)
""",
}
