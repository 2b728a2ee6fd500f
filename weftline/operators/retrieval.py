"""Seeds and relevance of many queries at once: dense, question and lexical rankings, fused by rank."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.vectors import all_scores, top_k_join


def dense_ranking(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, chunk_idx, score, rank from 0); frames (query_id, embedding), (chunk_idx, embedding)."""
    q = queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("v"))
    c = chunks.select(F.col("chunk_idx").alias("id"), F.col("embedding").alias("v"))
    got = top_k_join(q, c, k, exclude_self=False)
    return got.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("chunk_idx"), "score", (F.col("rank") - 1).alias("rank"))


def dense_scores(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (query_id, chunk_idx, score) of all pairs, without ranks and so without a shuffle of pairs."""
    q = queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("v"))
    got = all_scores(q, chunks.select(F.col("chunk_idx").alias("id"), F.col("embedding").alias("v")))
    return got.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("chunk_idx"), "score")


def question_ranking(hits: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Question hits (query_id, question_id, rank) become chunks, each at its best rank, k of them, ranked anew from 0."""
    best = hits.join(questions.select("question_id", "chunk_idx"), "question_id").groupBy("query_id", "chunk_idx").agg(F.min("rank").alias("best"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("best", "chunk_idx")) - 1
    return best.withColumn("rank", rank).where(F.col("rank") < k).select("query_id", "chunk_idx", "rank")


def rrf(lists: list[DataFrame], k: int, damping: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_idx, rank from 0): k items a query, ranked from 1.

    Ties go to the item of the earlier list, then of the earlier rank there. A single list is cut to k.
    """
    all_ = reduce(DataFrame.unionByName, (x.select("query_id", "chunk_idx", "rank", F.lit(i).alias("list_no")) for i, x in enumerate(lists)))
    fused = all_.groupBy("query_id", "chunk_idx").agg(F.round(F.sum(1.0 / (damping + F.col("rank") + 1)), 12).alias("rrf"), F.min(F.struct("list_no", "rank")).alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first", "chunk_idx")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_idx", "rrf", "rank")


def hybrid_relevance(dense: DataFrame, lexical: DataFrame, weight: float = 0.30, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Relevance (query_id, chunk_idx, score) of dense scores for all pairs and lexical scores where there are any.

    Dense over its maximum (negative ones stay), lexical clipped at 0 over its maximum, blended; a query
    without a positive lexical score keeps its raw dense scores. With store, which keeps the pairs, each query's two
    maxima come to them, as one row a query; without, the pairs come together by query.
    """
    w = Window.partitionBy("query_id")
    lex = lexical.select("query_id", "chunk_idx", F.greatest("score", F.lit(0.0)).alias("lex"))
    both = dense.select("query_id", "chunk_idx", F.col("score").alias("dense")).join(lex, ["query_id", "chunk_idx"], "left").fillna(0.0, ["lex"])
    if store:
        both = store(both)
        top = both.join(F.broadcast(both.groupBy("query_id").agg(F.max("dense").alias("dmax"), F.max("lex").alias("lmax"))), "query_id")
    else:
        top = both.withColumn("dmax", F.max("dense").over(w)).withColumn("lmax", F.max("lex").over(w))
    dense_norm = F.when(F.col("dmax") > 0, F.col("dense") / F.col("dmax")).otherwise(F.col("dense"))
    blend = (1 - weight) * dense_norm + weight * F.col("lex") / F.col("lmax")
    return top.select("query_id", "chunk_idx", F.when(F.col("lmax") > 0, blend).otherwise(F.col("dense")).alias("score"))
