"""The registered queries of the operators, with DuckDB SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calstack.llm.common import new_path
from calstack.llm import decontaminate, language, markup, packing, pieces, pseudonyms, simhash, substrings, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), path)
    whole = F.assert_true(F.col("gap").isNull(), F.concat(F.lit("gap in an archive just written: "), "file", F.lit(": "), "gap"))
    records = warc.read(spark, path, payloads=False).where(whole.isNull())
    number = {c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)") for c in ("record_id", "refers_to")}
    return records.select(number["record_id"].alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number["refers_to"].alias("refers_to"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.rendered(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.duplicate_passages(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits().alias("fingerprint"), "component_id")


#: Key of the pseudonyms in the registered query; a deployment passes its own.
PSEUDONYM_KEY = "registered query"


def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.write(table(spark, sf_dir, "documents"), new_path(spark, "packed"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pseudonyms.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    counts = [pseudonyms.count(name).alias(f"n_{name}") for name, *_ in pseudonyms.FORMATS]
    return made.select("doc_id", F.col("__text").alias("text"), F.size("__kinds").cast("long").alias("n_found"), *counts)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings")).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pieces.round_trip(table(spark, sf_dir, "documents"))
    return made.select(F.col("id").alias("doc_id"), "n_pieces", "pieces_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "lossless")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_html_text": op2_html_text,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash": op5_simhash,
    "op6_token_packing": op6_token_packing,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_topk": op8_topk,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_language": op10_language,
}

SQL: dict[str, str] = {}

SQL["op1_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS h FROM p),
g AS (SELECT h, max(page_id) AS keep FROM d GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((('0x' || substr(d.h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d JOIN g ON g.h = d.h
"""

SQL["op3_decontamination"] = r"""
WITH w AS (
  SELECT 'd' AS t, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), pat AS (
  SELECT DISTINCT id AS item_id, least(10, len(ws)) AS m, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS p
  FROM (SELECT id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM w WHERE t = 'b' AND len(ws) > 0)
), sizes AS (SELECT DISTINCT m FROM pat),
occ AS (
  SELECT d.id AS doc_id, d.i, d.m, pat.item_id
  FROM (SELECT id, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM w, sizes WHERE t = 'd' AND len(ws) >= m) d
  JOIN pat ON pat.m = d.m AND pat.p = array_to_string(d.ws[d.i : d.i + d.m - 1], ' ')
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id
)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits ON hits.doc_id = w.id LEFT JOIN its ON its.doc_id = w.id WHERE t = 'd'
"""

SQL["op8_topk"] = r"""
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

SQL["op4_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
dup AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT pos) AS g FROM (SELECT doc_id, unnest(range(i, i + 35)) AS pos FROM dup) GROUP BY doc_id),
kept AS (SELECT d.doc_id, string_agg(word, ' ' ORDER BY pos) AS s FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d) d LEFT JOIN gone ON gone.doc_id = d.doc_id WHERE g IS NULL OR NOT list_contains(g, pos) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
