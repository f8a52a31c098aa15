"""The queries of the training-data operators and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, embeddings, licenses, mixing, packing, quality, sharding, simhash, substring, token_files, tokens, url_filter, vector_codes

#: Rules of the URL filter: host, path, verdict (fixed values).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url")
    judged = url_filter.filter_urls(pages, "url", url_filter.rules_frame(spark, URL_RULES))
    return judged.select("page_id", "url_filter.host", "url_filter.path", "url_filter.rule", "url_filter.verdict")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(_table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    rows = plan.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    slim = docs.select("doc_id", (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("text_crc32"))
    out = sharding.shard(slim, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents", "doc_id", "lang", "text"))
    return judged.select("doc_id", *[c for c in judged.columns if c not in ("doc_id", "lang", "bits")], "lang", "bits")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = token_files.write(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return token_files.read(corpus, token_files.crc32, pa.int64(), "ids_crc32 long").withColumnRenamed("key", "doc_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "vec_id", "embedding", "label")
    return vector_codes.digest(coded).withColumnRenamed("key", "vec_id")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return conversations.digests(conversations.check(damaged))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_substring_dedup, op3_mixing, op4_simhash, op5_sharding, op6_token_counts, op7_packing, op8_license_scan, op9_embedding_dedup, op10_quality, op11_token_files, op12_vector_codes, op13_conversation_repair, pipeline)
}

_OP1 = """
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT u.page_id, u.host, u.path,
       (SELECT max_by(rhost || rpath, length(rhost || rpath)) FROM r WHERE (u.host = rhost OR u.host LIKE '%.' || rhost) AND starts_with(u.path, rpath)) AS rule,
       coalesce((SELECT max_by(verdict, length(rhost || rpath)) FROM r WHERE (u.host = rhost OR u.host LIKE '%.' || rhost) AND starts_with(u.path, rpath)), 'allow') AS verdict
FROM u
"""

_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
own AS (SELECT h, min(doc_id) AS owner FROM win GROUP BY h),
hit AS (SELECT doc_id, list(i) AS starts FROM win JOIN own USING (h) WHERE doc_id > owner GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS g FROM hit)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(g, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

_OP3 = r"""
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS text_key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS lim, sum(source_size) OVER () * 150 / 100.0::DOUBLE AS budget FROM s0),
s2 AS (SELECT *, lim / weight::DOUBLE AS edge FROM s1),
s3 AS (SELECT *, (budget - coalesce(sum(lim) OVER (ORDER BY edge, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
              / (sum(weight) OVER (ORDER BY edge, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s2),
s4 AS (SELECT *, CASE WHEN level > edge THEN lim::DOUBLE ELSE weight * (min_by(level, CASE WHEN level > edge THEN NULL ELSE edge END) OVER ()) END AS target FROM s3),
b AS (SELECT *, size AS block, ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(source, '') || '|' || text_key::VARCHAR || '|' || nth::VARCHAR), 1, 15))::BIGINT AS h
      FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, text_key) AS nth FROM d)),
r AS (SELECT b.*, source_size, target, budget, sum(block) OVER (PARTITION BY b.source ORDER BY h, doc_id NULLS LAST, text_key, nth ROWS UNBOUNDED PRECEDING) AS upto
      FROM b JOIN s4 ON b.source IS NOT DISTINCT FROM s4.source WHERE block > 0),
c AS (SELECT *, (copy * source_size + upto)::DOUBLE / target AS finish FROM r, (VALUES (0), (1)) AS k(copy)),
g AS (SELECT *, sum(block) OVER (ORDER BY finish, h, doc_id NULLS LAST, source NULLS LAST, text_key, nth, copy ROWS UNBOUNDED PRECEDING) AS run FROM c),
p AS (SELECT doc_id, source, text_key, nth, count(*) AS passes FROM g WHERE run <= budget GROUP BY ALL)
SELECT b.doc_id, b.size, s4.source_size, coalesce(s4.target, 0.0)::DOUBLE AS target, (b.size * coalesce(passes, 0))::BIGINT AS taken
FROM b JOIN s4 ON b.source IS NOT DISTINCT FROM s4.source
LEFT JOIN p ON b.doc_id IS NOT DISTINCT FROM p.doc_id AND b.source IS NOT DISTINCT FROM p.source AND b.text_key = p.text_key AND b.nth = p.nth
"""

ORACLES: dict[str, str] = {"op1_url_filter": _OP1, "op2_substring_dedup": _OP2, "op3_mixing": _OP3}
