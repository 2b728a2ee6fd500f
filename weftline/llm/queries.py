"""The operators' queries over whole tables, with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import read_table


#: Arrivals that op1's appends come in.
ARRIVALS = 8


def op1_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from weftline.llm.common import shared_dir
    from weftline.llm.shards import ShardStore

    docs = read_table(spark, sf_dir, "documents")
    store = ShardStore(spark, shared_dir(spark, "shards"), target_bytes=64 << 20)
    arrival = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS)).cast("int")
    store.append(docs.withColumn("arrival", arrival), arrival)
    store.compact()
    store.vacuum()
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "lang", "source", "n_chars", "arrival", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op2_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.webp import media_digest

    return media_digest(read_table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality import quality_scores

    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.katz import katz_scores

    return katz_scores(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.toxicity import toxicity_scores

    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.ann import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm.pack import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.licences import licence_scan

    return licence_scan(read_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm.bpe import bpe_digest

    return bpe_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_size_tiered_shards": op1_size_tiered_shards,
    "op2_lossless_webp": op2_lossless_webp,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_katz_backoff": op7_katz_backoff,
    "op8_toxicity": op8_toxicity,
    "op4_anisotropic_search": op4_anisotropic_search,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op9_licence_scan": op9_licence_scan,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_size_tiered_shards": """
        SELECT doc_id, lang, source, n_chars, CAST(((coalesce(doc_id, 0) % 8) + 8) % 8 AS INTEGER) AS arrival,
            CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    # Exact search. The operator reranks a shortlist; its recall is measured on larger tables, see README and tests.
    "op4_anisotropic_search": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
