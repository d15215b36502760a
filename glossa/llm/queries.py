"""The corpus operators as queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import ann, language, line_dedup, lm_score, media, mix_sources, near_dedup, pack, quality, shard
from glossa.llm.common import read_table


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_table(read_table(spark, sf_dir, "embeddings"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack_documents(read_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.mix_table(read_table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.store_texts(read_table(spark, sf_dir, "documents")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_table(read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(read_table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_table(read_table(spark, sf_dir, "documents"), third=lm_score.THIRD)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann_search, op2_near_dedup, op3_pack, op4_mix_sources, op5_media, op6_language, op7_line_dedup, op8_shard, op9_lm_score, op10_quality)}


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

NEAR_DEDUP_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM words
), sizes AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS h FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN sizes x ON c.a = x.doc_id JOIN sizes y ON c.b = y.doc_id WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
least_id AS (SELECT node, min(other) AS other FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id, doc_id <= coalesce(other, doc_id) AS kept
FROM sizes LEFT JOIN least_id ON node = doc_id
"""

MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS h FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1 AS i FROM sized GROUP BY source
), caps AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(i % 3 + 1)::INT] AS w, 2.0::DOUBLE * s AS cap FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM caps WINDOW before AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), one AS (SELECT min_by(level, (cap / w, i)) AS level FROM levels WHERE level <= cap / w),
plan AS (
  SELECT source, s, t, CASE WHEN s > 0 THEN floor(t / s)::BIGINT ELSE 0 END AS q
  FROM (SELECT source, s, least(coalesce(w * one.level, cap), cap) AS t FROM levels, one)
), steps AS (
  SELECT source, h, sum(size)::BIGINT AS n, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized GROUP BY source, h
), edge AS (
  SELECT p.source, h + CASE WHEN before + n - (t - q * s) < (t - q * s) - before THEN 1 ELSE 0 END AS threshold
  FROM plan p JOIN steps x ON p.source IS NOT DISTINCT FROM x.source WHERE before <= t - q * s AND t - q * s < before + n
)
SELECT d.doc_id, d.size, p.s AS source_size, p.t AS target, d.size * (p.q + CASE WHEN d.h < coalesce(e.threshold, 0) THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN edge e ON p.source IS NOT DISTINCT FROM e.source
"""

LINES_SQL = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, {_WS}), {_LOWER}) AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE keeper <> k.doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_dedup": NEAR_DEDUP_SQL, "op4_mix_sources": MIX_SQL, "op7_line_dedup": LINES_SQL}
