import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.config import Retrieval
from weftline.operators import diffusion, lexical, retrieval, selection


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "cat sat"), (1, "dog ran far away"), (2, "cat cat dog"), (3, None), (4, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "cat cat"), (8, "nothing")], "item_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lexical.bm25_scores(docs, queries, "doc_id", "text", "item_id", "text").collect()}
    n, lens, df = 4, {0: 2, 1: 4, 2: 3, 4: 0}, {"cat": 2, "sat": 1, "dog": 2, "ran": 1, "far": 1, "away": 1}
    avg = sum(lens.values()) / n
    idf = {t: np.log(n - d + 0.5) - np.log(d + 0.5) for t, d in df.items()}
    mean = np.mean(list(idf.values()))
    cat = idf["cat"] if idf["cat"] >= 0 else 0.25 * mean
    want = {d: 2 * cat * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lens[d] / avg)) for d, tf in ((0, 1), (2, 2))}
    assert got.keys() == want.keys() and all(got[d] == pytest.approx(want[d], abs=1e-6) for d in want)


def test_rrf_ties_and_single_list(spark):
    a = spark.createDataFrame([(0, 10, 0), (0, 11, 1)], "query_id long, chunk_idx long, rank int")
    b = spark.createDataFrame([(0, 12, 0), (0, 11, 1)], "query_id long, chunk_idx long, rank int")
    assert [r["chunk_idx"] for r in retrieval.rrf([a, b], 3).orderBy("rank").collect()] == [11, 10, 12]
    assert [r["chunk_idx"] for r in retrieval.rrf([a], 1).collect()] == [10]


def test_hybrid_keeps_raw_dense_without_lexical_hits(spark):
    dense = spark.createDataFrame([(0, 1, 0.5), (0, 2, -0.2), (1, 1, 0.4)], "query_id long, chunk_idx long, score double")
    lex = spark.createDataFrame([(0, 2, 4.0), (0, 1, -1.0)], "query_id long, chunk_idx long, score double")
    got = {(r["query_id"], r["chunk_idx"]): r["score"] for r in retrieval.hybrid_relevance(dense, lex).collect()}
    assert got[0, 1] == pytest.approx(0.7) and got[0, 2] == pytest.approx(0.7 * -0.4 + 0.3) and got[1, 1] == pytest.approx(0.4)


def test_pagerank_adds_up():
    src, dst = np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1])
    x = diffusion.pagerank(4, src, dst, np.ones(4), np.array([0]))
    assert x.sum() == pytest.approx(1) and x[0] > x[2] and x[3] < 1e-6


def test_diffuse_fallbacks(spark):
    rel = spark.createDataFrame([(0, 1, 0.4), (0, 2, 0.8)], "query_id long, id long, score double")
    prox = spark.createDataFrame([(0, 1, 1.0)], "query_id long, id long, proximity double")
    score = lambda df: {r["id"]: r["score"] for r in df.collect()}
    assert score(diffusion.diffuse(rel)) == {1: 0.4, 2: 0.8}
    assert score(diffusion.diffuse(rel, prox)) == {1: pytest.approx(0.7), 2: 0.8}
    other = prox.withColumn("proximity", F.lit(0.0))
    assert score(diffusion.diffuse(rel, prox, other))[1] == pytest.approx(0.45)


def test_proximity_of_rows_without_coordinates(spark):
    cand = spark.createDataFrame([(0, 1), (0, 2)], "query_id long, id long")
    seeds = spark.createDataFrame([(0, 3, 0.9), (0, 4, 0.1)], "query_id long, id long, relevance double")
    coords = spark.createDataFrame([(1, [1.0, 0.0]), (3, [1.0, 1.0]), (2, None)], "id long, v array<double>")
    got = {r["id"]: r["proximity"] for r in diffusion.seed_proximity(cand, seeds, coords).collect()}
    assert got == {1: 1.0, 2: 0.0}


def frame(scores, tokens=None, sources=None):
    n = len(scores)
    return pd.DataFrame({"query_id": 0, "id": range(n), "score": scores, "tokens": tokens or [10] * n, "source": sources or ["s"] * n})


def test_token_budget_first_fits_whatever_and_overflow_ends():
    r = Retrieval(token_budget=25, tie_band=0.0)
    assert selection.token_budget_choice(frame([1.0, 0.9, 0.8], [100, 10, 10]), r) == [0]
    assert selection.token_budget_choice(frame([1.0, 0.9, 0.8, 0.7], [10, 10, 10, 1]), r) == [0, 1]


def test_tail_gate_and_backfill():
    scores = [1.0, 0.9, 0.9, 0.9, 0.9, 0.5, 0.4, 0.2]
    on, off = Retrieval(tie_band=0.0), Retrieval(tie_band=0.0, backfill=False)
    assert selection.token_budget_choice(frame(scores), off) == [0, 1, 2, 3, 4]
    assert selection.token_budget_choice(frame(scores), on) == [0, 1, 2, 3, 4, 5, 6]


def test_tie_band_covers_sources_and_survives_negative_scores():
    assert selection.coverage_order(np.array([1.0, 0.99, 0.985, 0.5]), ["a", "a", "b", "c"], 0.02) == [0, 2, 1, 3]
    assert selection.coverage_order(np.array([-1.0, -2.0]), ["a", "b"], 0.02) == [0, 1]


def test_window_equals_choice_without_band(spark):
    rng = np.random.default_rng(1)
    rows = [(q, i, float(round(s, 3)), int(n), "s") for q in range(20) for i, (s, n) in enumerate(zip(rng.random(12), rng.integers(1, 40, 12), strict=True))]
    pool = spark.createDataFrame(rows, "query_id long, id long, score double, tokens long, source string")
    got = {(r["query_id"], r["id"]) for r in selection.token_budget_window(pool, 100).collect()}
    want = set()
    for q, g in pool.toPandas().sort_values(["score", "id"], ascending=[False, True]).groupby("query_id"):
        g = g.reset_index(drop=True)
        want |= {(q, int(g["id"][i])) for i in selection.token_budget_choice(g, Retrieval(token_budget=100, tie_band=0.0))}
    assert got == want


def test_mmr_skips_copies_and_core_stays():
    pdf = frame([1.0, 0.99, 0.6])
    pdf["v"] = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]
    assert selection.mmr_choice(pdf, 2, 0.5) == [0, 2]
    assert selection.mmr_choice(pdf, 2, 0.5, core=2) == [0, 1]


def test_greedy_and_anchor():
    pdf = frame([1.0, 0.9, 0.8, 0.1])
    pdf["v"], pdf["raw"], pdf["cluster"], pdf["ce"] = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.5, 0.5]], [1.0, 0.9, 0.8, 0.1], [0, 0, 1, 1], [0.0, 0.0, 0.0, 1.0]
    edges = pd.DataFrame({"src": [0, 0], "dst": [3, 2], "weight": [0.9, 0.3]})
    assert selection.greedy_choice(pdf, edges, Retrieval(final_k=2))[:2] == [0, 2]
    r = Retrieval(anchor_core_k=1, anchor_neighbours=1, token_budget=25)
    assert selection.anchor_choice(pdf, edges, r) == [0, 3]
    assert selection.anchor_choice(pdf, edges, Retrieval(anchor_core_k=1, token_budget=15)) == [0]


@pytest.mark.parametrize("mode", ["topk_diffused", "token_budget", "mmr", "protected_mmr", "anchor_expand_ce", "greedy", "unknown"])
def test_dispatch(spark, mode):
    rows = [(0, i, 1.0 - i / 10, 10, "s", [1.0, float(i)], 0.5, 0, 0.0) for i in range(5)]
    pool = spark.createDataFrame(rows, "query_id long, id long, score double, tokens long, source string, v array<double>, raw double, cluster int, ce double")
    edges = spark.createDataFrame([(0, 1, 0.5)], "src long, dst long, weight double")
    got = selection.select(pool, Retrieval(selection_mode=mode, final_k=3), edges).orderBy("rank").collect()
    assert got and got[0]["id"] == 0 and [r["rank"] for r in got] == list(range(1, len(got) + 1))


# -- choices once more, step by step in plain Python -------------------------------------------------------


def rich_pool(rng, n):
    pdf = frame(sorted((round(float(s), 3) for s in rng.random(n)), reverse=True), [int(x) for x in rng.integers(5, 40, n)], [f"s{x}" for x in rng.integers(0, 4, n)])
    pdf["v"] = [list(map(float, v)) for v in rng.normal(size=(n, 4))]
    pdf["raw"], pdf["cluster"], pdf["ce"] = [round(float(s), 3) for s in rng.random(n)], [int(c) for c in rng.integers(0, 3, n)], [round(float(s), 3) for s in rng.normal(size=n)]
    pairs = {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(2 * n)}
    edges = pd.DataFrame([(a, b, round(float(rng.random()), 3)) for a, b in sorted(pairs)], columns=["src", "dst", "weight"])
    return pdf, edges


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)


@pytest.mark.parametrize("seed", range(6))
def test_mmr_by_hand(seed):
    pdf, _ = rich_pool(np.random.default_rng(seed), 14)
    score, v = pdf["score"].tolist(), pdf["v"].tolist()
    for core in (0, 3):
        chosen = list(range(core))
        while len(chosen) < 8:
            gain = {i: 0.6 * score[i] / max(score) - 0.4 * (max(cosine(v[i], v[j]) for j in chosen) if chosen else 0) for i in range(14) if i not in chosen}
            chosen.append(max(gain, key=lambda i: (round(gain[i], 12), -i)))
        assert selection.mmr_choice(pdf, 8, 0.6, core) == chosen


@pytest.mark.parametrize("seed", range(6))
def test_greedy_by_hand(seed):
    pdf, edges = rich_pool(np.random.default_rng(seed), 14)
    r = Retrieval(final_k=7)
    score, raw_, v, cluster = pdf["score"].tolist(), pdf["raw"].tolist(), pdf["v"].tolist(), pdf["cluster"].tolist()
    weight = {frozenset((a, b)): w for a, b, w in edges.itertuples(index=False)}
    chosen = []
    while len(chosen) < 7:
        gain = {}
        for i in range(14):
            if i not in chosen:
                like = max([0.0, *(cosine(v[i], v[j]) for j in chosen)])
                linked = min(1.0, sum(weight.get(frozenset((i, j)), 0.0) for j in chosen))
                fresh = float(cluster[i] not in {cluster[j] for j in chosen})
                gain[i] = r.sel_diffused * score[i] / max(score) + r.sel_raw * raw_[i] / max(raw_) - r.sel_redundancy * like + r.sel_connectivity * linked + r.sel_diversity * fresh
        chosen.append(max(gain, key=lambda i: (round(gain[i], 12), -i)))
    assert selection.greedy_choice(pdf, edges, r) == chosen


@pytest.mark.parametrize("seed", range(6))
def test_anchor_by_hand(seed):
    pdf, edges = rich_pool(np.random.default_rng(seed), 14)
    r = Retrieval(anchor_core_k=4, anchor_neighbours=2, anchor_ce_threshold=-0.5, token_budget=170)
    tokens, ce = pdf["tokens"].tolist(), pdf["ce"].tolist()
    core, extra = list(range(4)), []
    for k in core:
        near = sorted(((w, b if a == k else a) for a, b, w in edges.itertuples(index=False) if k in (a, b)), key=lambda x: (-x[0], x[1]))
        extra += [d for _, d in near if d not in core and d not in extra][:2]
    used = sum(tokens[k] for k in core)
    want = list(core)
    for k in sorted(extra, key=lambda c: -ce[c]):
        if ce[k] < -0.5:
            continue
        if used + tokens[k] > 170:
            break
        want.append(k)
        used += tokens[k]
    assert selection.anchor_choice(pdf, edges, r) == want


@pytest.mark.parametrize("seed", range(6))
def test_budget_band_by_hand(seed):
    pdf, _ = rich_pool(np.random.default_rng(seed), 20)
    r = Retrieval(token_budget=180, tie_band=0.1, head_k=4, tail_ratio=0.6, head_ratio=0.2)
    score, tokens, source = pdf["score"].tolist(), pdf["tokens"].tolist(), pdf["source"].tolist()
    left, seen, order = list(range(20)), [], []
    while left:
        band = [i for i in left if score[i] >= score[left[0]] * 0.9]
        pick = [i for i in band if source[i] not in seen] or band
        order.append(pick[0])
        seen.append(source[pick[0]])
        left.remove(pick[0])
    want, later, used, ended = [], [], 0, False
    for i in order:
        if score[i] < 0.2 * score[0] or ended:
            continue
        if len(want) >= 4 and score[i] < 0.6 * score[0]:
            later.append(i)
        elif want and used + tokens[i] > 180:
            ended = True
        else:
            want.append(i)
            used += tokens[i]
    for i in [] if ended else later:
        if used + tokens[i] > 180:
            break
        want.append(i)
        used += tokens[i]
    assert selection.token_budget_choice(pdf, r) == want


def test_pagerank_solves_its_equation():
    """The walk's fixed point, as one linear system."""
    rng = np.random.default_rng(3)
    n = 30
    src, dst = rng.integers(0, 25, 80), rng.integers(0, 25, 80)
    weight = rng.random(80)
    seeds = np.array([2, 7, 28])
    start = np.zeros(n)
    start[seeds] = 1 / 3
    move = np.zeros((n, n))
    for a, b, w in zip(src, dst, weight, strict=True):
        move[b, a] += w / weight[src == a].sum()
    move[:, move.sum(0) == 0] = start[:, None]
    want = np.linalg.solve(np.eye(n) - 0.85 * move, 0.15 * start)
    got = diffusion.pagerank(n, src, dst, weight, seeds, tol=1e-12)
    assert np.abs(got - want).max() < 1e-9
