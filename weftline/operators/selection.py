"""Which candidates become a query's context: eight modes, one dispatcher.

Modes without a running decision are windows in the JVM. The others choose one candidate after another, so each
query's bounded pool is one group. Frames: pool (query_id, id, score, tokens) and, where a mode asks for them,
source, vector v, raw, cluster. All give rows (query_id, id, rank from 1, score).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import Retrieval

_OUT = "query_id long, id long, rank int, score double"


def topk(pool: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pool.select("query_id", "id", "score", rank.alias("rank")).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def token_budget_window(pool: DataFrame, budget: int, head_ratio: float = 0.30) -> DataFrame:
    """token_budget with backfill and no tie band: by score, at least head_ratio of the best, while tokens last.

    The first one is kept whatever its length; the first that no longer fits ends the context.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    rows = pool.select("query_id", "id", "score", "tokens", F.row_number().over(w).alias("rank"), F.max("score").over(Window.partitionBy("query_id")).alias("top"))
    rows = rows.where(F.col("score") >= head_ratio * F.col("top")).withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("rank") == 1) | (F.col("used") <= budget)).select("query_id", "id", "rank", "score")


def _grouped(pool: DataFrame, choose: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """choose() gets a query's pool by score and returns places in it, in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        at = choose(pdf)
        got = pdf.iloc[at]
        return pd.DataFrame({"query_id": got["query_id"].to_numpy(), "id": got["id"].to_numpy(), "rank": np.arange(1, len(at) + 1), "score": got["score"].to_numpy()})

    return pool.groupBy("query_id").applyInPandas(run, _OUT)


def coverage_order(score: np.ndarray, source: list, band: float) -> list[int]:
    """By score, but among those within `band` of the best left, one of a source not seen yet goes first."""
    left, seen, out = list(range(len(score))), set(), []
    while left:
        best = score[left[0]]
        cut = min(best - band * best, best)
        ties = [i for i in left if score[i] >= cut]
        take = next((i for i in ties if source[i] not in seen), ties[0])
        out.append(take)
        seen.add(source[take])
        left.remove(take)
    return out


def token_budget_choice(pdf: pd.DataFrame, r: Retrieval) -> list[int]:
    score, tokens = pdf["score"].to_numpy(float), pdf["tokens"].to_numpy(int)
    if not len(score):
        return []
    order = coverage_order(score, pdf["source"].tolist(), r.tie_band) if r.tie_band > 0 else list(range(len(score)))
    top = score.max()
    chosen, later, used, full = [], [], 0, False
    for i in order:
        if score[i] < r.head_ratio * top:
            continue
        if len(chosen) >= r.head_k and score[i] < r.tail_ratio * top:
            later.append(i)
            continue
        if chosen and used + tokens[i] > r.token_budget:
            full = True
            break
        chosen.append(i)
        used += tokens[i]
    if r.backfill and not full:
        for i in later:
            if used + tokens[i] > r.token_budget:
                break
            chosen.append(i)
            used += tokens[i]
    return chosen


def _cosines(pdf: pd.DataFrame) -> np.ndarray:
    x = np.stack(pdf["v"].to_numpy()).astype(float)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x @ x.T


def mmr_choice(pdf: pd.DataFrame, k: int, lam: float, core: int = 0) -> list[int]:
    """Relevance against likeness to what is chosen; the first `core` by score are always in."""
    n = len(pdf)
    score = pdf["score"].to_numpy(float)
    top = score.max() if n else 0
    rel = score / top if top > 0 else score
    cos = _cosines(pdf) if n else np.zeros((0, 0))
    chosen = list(range(min(core, k, n)))
    worst = cos[:, chosen].max(1) if chosen else np.zeros(n)
    while len(chosen) < min(k, n):
        value = lam * rel - (1 - lam) * worst
        value[chosen] = -np.inf
        i = int(np.argmax(value))
        chosen.append(i)
        worst = np.maximum(worst, cos[:, i]) if len(chosen) > 1 else cos[:, i].copy()
    return chosen


def kmeans_labels(x: np.ndarray, k: int, seed: int = 42, rounds: int = 50) -> np.ndarray:
    """Lloyd's algorithm from spread-out starts."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centre = [x[rng.integers(len(x))]]
    while len(centre) < k:
        d = np.min([((x - c) ** 2).sum(1) for c in centre], axis=0)
        centre.append(x[int(np.argmax(d))])
    centres = np.stack(centre)
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        after = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        if (after == label).all() and _:
            break
        label = after
        for c in range(k):
            if (label == c).any():
                centres[c] = x[label == c].mean(0)
    return label


def query_clusters(pdf: pd.DataFrame, k: int) -> np.ndarray:
    """Stored labels, or clusters of the coordinates; rows without coordinates are clusters of their own."""
    if "cluster" in pdf and (pdf["cluster"] >= 0).all():
        return pdf["cluster"].to_numpy(int)
    has = pdf["coords"].map(lambda c: c is not None).to_numpy(bool) if "coords" in pdf else np.zeros(len(pdf), bool)
    label = np.arange(k, k + len(pdf))
    if has.sum() > 1:
        label[has] = kmeans_labels(np.stack(pdf.loc[has, "coords"].to_numpy()).astype(float), k)
    return label


def greedy_choice(pdf: pd.DataFrame, edges: pd.DataFrame, r: Retrieval) -> list[int]:
    """Largest marginal gain of five terms, one after another."""
    n = len(pdf)
    norm = lambda a: a / a.max() if len(a) and a.max() > 0 else a
    diffused, raw = norm(pdf["score"].to_numpy(float)), norm(np.maximum(pdf["raw"].to_numpy(float), 0))
    cos = _cosines(pdf)
    at = pd.Index(pdf["id"])
    weight = np.zeros((n, n))
    i, j = at.get_indexer(edges["src"]), at.get_indexer(edges["dst"])
    fine = (i >= 0) & (j >= 0)
    weight[i[fine], j[fine]] = edges["weight"].to_numpy(float)[fine]
    weight = np.maximum(weight, weight.T)
    cluster = query_clusters(pdf, r.clusters)
    chosen: list[int] = []
    worst, linked, seen = np.zeros(n), np.zeros(n), set()
    while len(chosen) < min(r.final_k, n):
        fresh = np.array([c not in seen for c in cluster], float)
        value = r.sel_diffused * diffused + r.sel_raw * raw - r.sel_redundancy * worst + r.sel_connectivity * np.minimum(linked, 1) + r.sel_diversity * fresh
        value[chosen] = -np.inf
        k = int(np.argmax(value))
        chosen.append(k)
        worst, linked = np.maximum(worst, cos[:, k]), linked + weight[:, k]
        seen.add(cluster[k])
    return chosen


def anchor_choice(pdf: pd.DataFrame, edges: pd.DataFrame, r: Retrieval) -> list[int]:
    """A protected core, then its strongest neighbours that the reranker (column ce) lets in, best first, while tokens last."""
    core = list(range(min(r.anchor_core_k, len(pdf))))
    at = {i: k for k, i in enumerate(pdf["id"])}
    both = pd.concat([edges[["src", "dst", "weight"]], edges.rename(columns={"src": "dst", "dst": "src"})[["src", "dst", "weight"]]]).sort_values(["weight", "dst"], ascending=[False, True], kind="stable")
    near = {s: g["dst"].tolist() for s, g in both.groupby("src", sort=False)}
    taken, extra = set(core), []
    for k in core:
        got = 0
        for d in near.get(pdf["id"].iat[k], []):
            c = at.get(d)
            if c is not None and c not in taken and got < r.anchor_neighbours:
                taken.add(c)
                extra.append(c)
                got += 1
    ce, tokens = pdf["ce"].to_numpy(float), pdf["tokens"].to_numpy(int)
    used = int(tokens[core].sum())
    for k in sorted(extra, key=lambda c: -ce[c]):
        if ce[k] < r.anchor_ce_threshold:
            continue
        if used + tokens[k] > r.token_budget:
            break
        core.append(k)
        used += int(tokens[k])
    return core


def _with_edges(pool: DataFrame, edges: DataFrame, choose: Callable[[pd.DataFrame, pd.DataFrame], list[int]]) -> DataFrame:
    """Groups hold a query's pool and the edges inside it."""
    ends = pool.select(F.col("query_id").alias("of"), F.col("id").alias("dst"))
    near = pool.select(F.col("query_id").alias("q"), F.col("id").alias("src")).join(edges.select("src", "dst", "weight"), "src")
    inside = near.join(ends, (near["q"] == ends["of"]) & (near["dst"] == ends["dst"])).select("of", "src", near["dst"], "weight")

    def run(pdf: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({"query_id": [], "id": [], "rank": [], "score": []})
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        at = choose(pdf, e)
        got = pdf.iloc[at]
        return pd.DataFrame({"query_id": got["query_id"].to_numpy(), "id": got["id"].to_numpy(), "rank": np.arange(1, len(at) + 1), "score": got["score"].to_numpy()})

    return pool.groupBy(F.col("query_id").alias("g")).cogroup(inside.groupBy(F.col("of").alias("g"))).applyInPandas(run, _OUT)


def select(pool: DataFrame, settings: Retrieval | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Dispatches by settings.selection_mode; an unknown mode is greedy."""
    r = settings or Retrieval()
    mode = r.selection_mode
    if mode == "topk_diffused":
        return topk(pool, r.final_k)
    if mode == "token_budget":
        if r.tie_band == 0 and r.backfill:
            return token_budget_window(pool, r.token_budget, r.head_ratio)
        return _grouped(pool, lambda p: token_budget_choice(p, r))
    if mode == "mmr":
        return _grouped(pool, lambda p: mmr_choice(p, r.final_k, r.mmr_lambda))
    if mode == "protected_mmr":
        return _grouped(pool, lambda p: mmr_choice(p, r.final_k, r.mmr_lambda, r.protected_core_k))
    if mode == "anchor_expand_ce":
        return _with_edges(pool, edges, lambda p, e: anchor_choice(p, e, r))
    return _with_edges(pool, edges, lambda p, e: greedy_choice(p, e, r))
