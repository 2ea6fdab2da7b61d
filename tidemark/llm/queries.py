"""The queries of this subpackage and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, language, media, neardup, pii, secrets, sharding, urlfilter, warc
from tidemark.llm.common import ship_package, table

def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return media.media_columns(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return warc.warc_round_trip(table(spark, sf_dir, "pages"), unnamed=True).drop("url")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=24)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return language.identify(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pii.scan_personal_data(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), ids=False)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).drop("ids")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_url_filters, op2_media_columns, op3_warc, op4_secret_scan, op5_decontaminate, op6_sharding, op7_language_id, op8_pii, op9_bpe, op10_minhash_dedup, pipeline)}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        o AS (SELECT d, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY d)
        SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
            CASE WHEN p.page_id < o.original THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN p.page_id < o.original THEN o.original END AS refers_to
        FROM p LEFT JOIN o ON p.d = o.d AND p.n >= 1000
    """,
    "op10_minhash_dedup": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
                ELSE list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4]) END) AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.b, s.doc_id)) AS component_id, s.doc_id <= coalesce(m.b, s.doc_id) AS kept
        FROM s LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON s.doc_id = m.a
    """,
}
