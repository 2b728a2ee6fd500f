"""BM25 over a partitioned postings table, for any number of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import tokenize

K1, B, EPSILON = 1.5, 0.75, 0.25

#: Most terms of all questions together that are sent to every executor; with more, terms meet by a shuffle.
SENT_TERMS = 2_000_000


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, term, tf, len): counted before they are shuffled, one row for each term of a document."""
    toks = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("toks")).where("toks is not null")
    return toks.select("id", F.size("toks").alias("len"), F.explode("toks").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (query_id, term, qtf): a term said twice counts twice."""
    toks = queries.select(F.col(id_col).alias("query_id"), F.explode(tokenize(F.col(text_col))).alias("term"))
    return toks.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def idf(df: Column, n: Column, mean_idf: Column) -> Column:
    raw = F.log(n - df + 0.5) - F.log(df + 0.5)
    return F.when(raw < 0, mean_idf * EPSILON).otherwise(raw)


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str) -> DataFrame:
    """Rows (query_id, doc_id, score) for each query and document with a term in common.

    Document frequencies of all terms (the mean idf needs them) come from each document's distinct terms, so only
    partial counts by term are shuffled; frequencies within documents are counted for the queries' terms alone.
    These are dealt by document and stay there: the queries' terms come to them, so neither a frequent term is one task
    nor are pairs shuffled before they are summed.
    Scores are rounded to six places, so that the order of additions can't matter.
    """
    # explode_outer: for explode the optimiser would add a filter that tokenises each text once more.
    toks = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("toks"))
    corpus = toks.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("toks")).alias("avgdl"))
    found = toks.select(F.explode_outer(F.array_distinct("toks")).alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    stats = found.crossJoin(F.broadcast(corpus))  # one row
    wanted = query_terms(queries, query_id, query_text)
    sent = F.broadcast if wanted.count() <= SENT_TERMS else lambda df: df  # counts questions only
    asked = wanted.select("term").distinct()
    post = toks.select("id", F.size("toks").alias("len"), F.explode_outer("toks").alias("term")).join(sent(asked), "term", "left_semi").repartition("id").groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean = stats.agg(F.avg(raw).alias("mean_idf"))  # one row
    scored = stats.join(sent(asked), "term", "left_semi").crossJoin(F.broadcast(mean)).withColumn("idf", idf(F.col("df"), F.col("n"), F.col("mean_idf")))
    hits = post.join(sent(scored.join(wanted, "term")), "term")
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return hits.groupBy("query_id", F.col("id").alias("doc_id")).agg(F.round(F.sum(part), 6).alias("score"))


def top_per_query(scores: DataFrame, k: int, item: str = "doc_id") -> DataFrame:
    """The k best items of each query with their rank from 1; ties to the smaller item."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), item))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """Top k first, then only positive scores."""
    return top_per_query(bm25_scores(docs, queries, id_col, text_col, query_id, query_text), k).where(F.col("score") > 0)
