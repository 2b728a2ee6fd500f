"""Proximity of candidates to seeds (spectral and personalised PageRank) and its blend with relevance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.vectors import dot, l2_normalise, topk_mean
from weftline.operators.graph import symmetric


def seed_proximity(candidates: DataFrame, seeds: DataFrame, coords: DataFrame, mode: str = "max", topk: int = 3) -> DataFrame:
    """Rows (query_id, id, proximity): cosines to the query's seeds, aggregated, clipped at 0 and over the query's maximum.

    Frames: candidates (query_id, id), seeds (query_id, id, relevance), coords (id, v). Seeds without
    coordinates don't count; a candidate without gets 0. Candidates meet the seeds of their own query only,
    by an equi-join; both are bounded for each query.
    """
    unit = coords.where("v is not null").select("id", l2_normalise(F.col("v").cast("array<double>")).alias("v"))
    s = seeds.join(unit, "id").select("query_id", F.col("v").alias("sv"), F.greatest("relevance", F.lit(0.0)).alias("w"), F.col("id").alias("seed"))
    pairs = candidates.select("query_id", "id").join(unit, "id").join(s, "query_id").select("query_id", "id", "w", dot(F.col("v"), F.col("sv")).alias("cos"))
    if mode == "max":
        value = F.max("cos")
    elif mode == "topk_mean":
        value = topk_mean(F.collect_list("cos"), topk)
    elif mode == "relevance_weighted":
        value = F.when(F.sum("w") > 0, F.sum(F.col("cos") * F.col("w")) / F.sum("w")).otherwise(F.avg("cos"))
    else:
        raise ValueError(f"unknown aggregation {mode}")
    got = pairs.groupBy("query_id", "id").agg(F.greatest(value, F.lit(0.0)).alias("p"))
    all_ = candidates.select("query_id", "id").join(got, ["query_id", "id"], "left").fillna(0.0, ["p"])
    top = F.max("p").over(Window.partitionBy("query_id"))
    return all_.select("query_id", "id", F.when(top > 0, F.col("p") / top).otherwise(F.col("p")).alias("proximity"))


def pagerank(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, seeds: np.ndarray, damping: float = 0.85, most: int = 200, tol: float = 1e-6) -> np.ndarray | None:
    """Power iteration from the seeds; None if it doesn't settle. Nodes without edges lead back to the seeds."""
    start = np.zeros(n)
    start[seeds] = 1 / len(seeds)
    out = np.bincount(src, weights=weight, minlength=n)
    share = weight / np.where(out[src] > 0, out[src], 1)
    x = np.full(n, 1 / n)
    for _ in range(most):
        after = damping * (np.bincount(dst, weights=x[src] * share, minlength=n) + x[out == 0].sum() * start) + (1 - damping) * start
        if np.abs(after - x).sum() < n * tol:
            return after
        x = after
    return None


def ppr_proximity(candidates: DataFrame, seeds: DataFrame, edges: DataFrame, damping: float = 0.85) -> DataFrame:
    """Rows (query_id, id, proximity): PageRank on the graph of the query's candidates, over its maximum.

    Candidates are capped for each query, so each query's graph is one small group.
    """
    both = symmetric(edges.select("src", "dst", "weight"))
    ends = candidates.select(F.col("query_id").alias("of"), F.col("id").alias("end"))
    inside = candidates.select(F.col("query_id").alias("q"), F.col("id").alias("src")).join(both, "src")
    near = inside.join(ends, (F.col("q") == F.col("of")) & (F.col("dst") == F.col("end"))).select("q", "src", "dst", "weight")
    marked = seeds.select(F.col("query_id").alias("sq"), F.col("id").alias("sid")).distinct().withColumn("seed", F.lit(True))
    nodes = candidates.select("query_id", "id").join(marked, (F.col("query_id") == F.col("sq")) & (F.col("id") == F.col("sid")), "left").select("query_id", "id", F.coalesce("seed", F.lit(False)).alias("seed"))

    def run(a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("id").reset_index(drop=True)
        seeds_at = np.flatnonzero(a["seed"].to_numpy(bool))
        if not len(seeds_at):
            return pd.DataFrame({"query_id": [], "id": [], "proximity": []})
        at = pd.Index(a["id"])
        x = pagerank(len(a), at.get_indexer(e["src"]), at.get_indexer(e["dst"]), e["weight"].to_numpy(float), seeds_at, damping)
        if x is None:
            return pd.DataFrame({"query_id": [], "id": [], "proximity": []})
        return pd.DataFrame({"query_id": a["query_id"], "id": a["id"], "proximity": x / x.max()})

    return nodes.groupBy(F.col("query_id").alias("g")).cogroup(near.groupBy(F.col("q").alias("g"))).applyInPandas(run, "query_id long, id long, proximity double")


def diffuse(relevance: DataFrame, spectral: DataFrame | None = None, ppr: DataFrame | None = None, alpha: float = 0.5) -> DataFrame:
    """(1 - alpha) relevance + alpha proximity; both proximities average, one stands alone, none leaves relevance as it is."""
    out = relevance.select("query_id", "id", F.col("score").alias("relevance"))
    null = F.lit(None).cast("double")
    for name, frame in (("spectral", spectral), ("ppr", ppr)):
        out = out.withColumn(name, null) if frame is None else out.join(frame.select("query_id", "id", F.col("proximity").alias(name)), ["query_id", "id"], "left")
    both = F.when(F.col("spectral").isNotNull() & F.col("ppr").isNotNull(), (F.col("spectral") + F.col("ppr")) / 2).otherwise(F.coalesce("spectral", "ppr"))
    score = F.when(both.isNull(), F.col("relevance")).otherwise((1 - alpha) * F.col("relevance") + alpha * both)
    return out.select("query_id", "id", "relevance", score.alias("score"))
