"""What keeps queries within bounds on larger tables, against plain recomputation on small ones."""

import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from weftline.functions import vectors as vx
from weftline.operators import lexical, retrieval, signals, spectral, weights
from weftline.plans.registry import QUERIES


def brute(ids, x, others, y, k, threshold, exclude_self):
    score, out = vx.exact_scores(x, y), []
    for i, own in enumerate(ids):
        found = sorted((-score[i, j], o) for j, o in enumerate(others) if not (exclude_self and o == own) and (threshold is None or score[i, j] >= threshold))
        out += [(own, o, -s) for s, o in found[:k]]
    return sorted(out)


@pytest.mark.parametrize("tile,block", [(1 << 22, 4096), (64, 4), (8, 4)])
def test_nearest_is_exact_with_ties_and_small_tiles(monkeypatch, tile, block):
    monkeypatch.setattr(vx, "TILE", tile)
    monkeypatch.setattr(vx, "BLOCK", block)
    rng = np.random.default_rng(2)
    for case in range(24):
        x, y = rng.normal(size=(rng.integers(1, 30), 5)), rng.normal(size=(rng.integers(1, 60), 5))
        if case % 3 == 0:
            x, y = np.round(x), np.round(y)  # many equal scores
        if case % 2:
            x, y = x.astype(np.float32), y.astype(np.float32)
        ids, others = rng.permutation(90)[: len(x)], rng.permutation(90)[: len(y)]
        how = (int(rng.integers(1, 12)), (None, 0.3, 1.0)[case % 3], bool(case % 4))
        got = sorted((i, o, s) for part in vx.nearest(ids, x, others, y, *how) for i, o, s in zip(*part, strict=True))
        assert got == brute(ids, x, others, y, *how)


def test_nearest_of_large_and_odd_numbers():
    """Beyond single precision all pairs are summed; what is no number counts as largest, as in SQL."""
    x, y = np.array([[1e30, 0.0], [1.0, 1.0]]), np.array([[1e30, 0.0], [0.0, 1e30], [1.0, 2.0], [np.nan, 0.0]])
    got = [[int(o) for _, o, _ in sorted(zip(*part, strict=True), key=lambda r: r[0])] for part in vx.nearest(np.array([0, 1]), x, np.arange(4), y, 2, 0.5, False)]
    flat = [o for part in got for o in part]
    assert flat[:2] in ([3, 0], [0, 3]) and 3 in flat[2:]


def test_blocks_grow_slower_than_rows():
    assert [vx.blocks_of(n) for n in (0, 1, 4096, 4097, 100_000, 615_000, 3_000_000)] == [1, 1, 1, 2, 16, 16, 46]


@pytest.mark.parametrize("name", ["subgraph", "neighbour_sets", "bfs_2hop", "ppr", "laplacian_entries", "degree_topn", "graph_counts", "graph_payload_rows", "stored_index", "graph_nodes_view", "minmax_combine", "dominant_signal", "signal_breakdown", "signal_importance"])
def test_neighbours_are_searched_once(spark, sf_dir, name):
    """The search of all pairs is done before the query's own plan, which reads what it found."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "best(" not in plan


def test_numbers_are_whole_where_ranges_are_sampled(spark, tmp_path):
    """More rows than a range partitioning looks at, with sources, ids and pairs that repeat or are missing."""
    n = 400_000
    rows = spark.range(0, n, 1, 3).select(F.concat(F.lit("s"), F.col("id") % 7).alias("source"), (F.col("id") * 7919 % 300_007).alias("doc_id"))
    rows = rows.withColumn("source", F.when(F.col("doc_id") % 1000 != 0, F.col("source")))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["numbered_chunks"](spark, str(tmp_path)).toPandas().sort_values("chunk_idx")
    assert got["chunk_idx"].tolist() == list(range(n))
    want = got.sort_values(["source", "doc_id"], na_position="last", kind="stable")
    assert want["chunk_idx"].tolist() == list(range(n))


def ring_graph(spark, sizes):
    """Rings of some nodes each, with two nodes without edges."""
    pairs, at = [], 0
    for size in sizes:
        pairs += [(at + i, at + (i + 1) % size, 0.5 + (i * 7 % 11) / 11) for i in range(size)]
        at += size
    nodes = spark.createDataFrame([(i, i, at + 2) for i in range(at + 2)], "id long, position int, doc_size int")
    return nodes, spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in pairs], "src long, dst long, weight double"), at + 2


def test_distributed_coordinates_span_what_the_dense_ones_span(spark):
    """Five parts of a graph and two lone nodes: eigenvalue 0 is there seven times, and all seven vectors are found."""
    nodes, edges, n = ring_graph(spark, (60, 60, 45, 30, 20))
    lap = np.zeros((n, n))
    for r in spectral.laplacian(nodes, edges).collect():
        lap[r["i"], r["j"]] += r["value"]
    x = spectral.leading_vectors(lambda v: 2 * v - lap @ v, n, 9)
    assert np.abs(x.T @ x - np.eye(9)).max() < 1e-9
    value, vector = np.linalg.eigh(lap)
    assert np.diag(x.T @ lap @ x) == pytest.approx(value[:9], abs=1e-9)
    assert np.linalg.norm(x[:, :7] - vector[:, :7] @ (vector[:, :7].T @ x[:, :7])) < 1e-6


def test_distributed_coordinates_match_the_local_ones(spark):
    nodes, edges, n = ring_graph(spark, (301,))
    nodes, n = nodes.where("id < 301"), 301
    entries = spectral.laplacian(nodes, edges)
    read = lambda df: np.array([r["coords"] for r in df.orderBy("id").collect()])
    local, far = read(spectral.coordinates(nodes, entries, 6)), read(spectral.coordinates(nodes, entries, 6, local_nodes=10))
    assert local.shape == far.shape == (n, 6)
    assert np.abs(np.linalg.svd(local.T @ far)[1] - 1).max() < 1e-6


def test_smallest_hashes(spark):
    pairs = spark.range(5000).select("id", (F.col("id") * 3).alias("j")).withColumnRenamed("id", "i")
    for n in (0, 1, 700, 4999, 9000):
        want = pairs.orderBy(F.xxhash64("i", "j")).limit(n)
        assert sorted(weights._smallest(pairs, n).collect()) == sorted(want.collect())


@pytest.mark.parametrize("name", ["fit_weights", "calibrate_weights", "multiplex_coords", "spectral_coords", "kmeans_labels"])
def test_models_search_neighbours_once(spark, sf_dir, monkeypatch, name):
    """However often a model reads its edges, the search of all pairs runs once."""
    runs, search = spark.sparkContext.accumulator(0), signals.top_k_join

    def counted(*args, **kwargs):
        found = search(*args, **kwargs).coalesce(1)

        def tick(batches):
            runs.add(1)
            yield from batches

        return found.mapInArrow(tick, found.schema)

    monkeypatch.setattr(signals, "top_k_join", counted)
    assert QUERIES[name](spark, sf_dir).collect()
    assert runs.value == 1


@pytest.mark.parametrize("pairs,block", [(1 << 22, 512), (8, 5)])
def test_shared_keys_shuffle_chunks_not_pairs(spark, monkeypatch, pairs, block):
    """All pairs are counted in blocks, in tables of whatever size, and no exchange lies above the counting."""
    monkeypatch.setattr(signals, "PAIRS", pairs)
    monkeypatch.setattr(signals, "PAIR_BLOCK", block)
    rng = np.random.default_rng(4)
    keys = {i: {f"k{k}" for k in rng.integers(0, 12, rng.integers(0, 6))} | {"all"} for i in rng.permutation(500)[:40].tolist()}
    rows = [(i, k) for i, ks in keys.items() for k in sorted(ks)]
    got = signals.shared_keys(spark.createDataFrame(rows + rows[:9], "chunk_idx long, key string"), "entity")
    most = max(len(a & b) for i, a in keys.items() for j, b in keys.items() if i < j)
    assert {(r["i"], r["j"]): r["score"] for r in got.collect()} == {(i, j): len(keys[i] & keys[j]) / most for i in keys for j in keys if i < j}
    assert got.count() == 40 * 39 // 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [i" not in plan


def test_blocks_are_smaller_where_all_pairs_are_given():
    for left, right, k in ((200, 3_000_000, 1 << 62), (5000, 100_000, 1 << 62), (615_000, 615_000, 8), (615_000, 615_000, 500), (0, 0, 5)):
        nl, nr = vx._dealt(left, right, k)
        assert -(-left // nl) * min(k, -(-right // nr)) <= vx.GIVEN
    assert vx._dealt(615_000, 615_000, 8) == (16, 16)


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_a_term_of_all_documents_is_not_one_task(spark, monkeypatch, most):
    """Terms of documents are dealt by document alone; scores are the same where questions are too many to be sent."""
    docs = spark.createDataFrame([(i, "the " * (i % 3 + 1) + f"word{i % 5}") for i in range(60)] + [(7, "the word1")], "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"the word{q}") for q in range(5)], "item_id long, text string")
    monkeypatch.setattr(lexical, "SENT_TERMS", 2_000_000)
    want = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.bm25_scores(docs, asked, "doc_id", "text", "item_id", "text").collect()}
    monkeypatch.setattr(lexical, "SENT_TERMS", most)
    got = lexical.bm25_scores(docs, asked, "doc_id", "text", "item_id", "text")
    assert {(r["query_id"], r["doc_id"]): r["score"] for r in got.collect()} == want and len(want) == 300
    if most:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan and not re.search(r"hashpartitioning\(query_id#\d+L, id#", plan)


def test_hybrid_relevance_of_stored_pairs(spark):
    dense = spark.createDataFrame([(0, 1, 0.5), (0, 2, -0.2), (1, 1, 0.4)], "query_id long, chunk_idx long, score double")
    lex = spark.createDataFrame([(0, 2, 4.0), (0, 1, -1.0)], "query_id long, chunk_idx long, score double")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "chunk_idx", "score").collect()))
    kept = []
    got = retrieval.hybrid_relevance(dense, lex, store=lambda df: kept.append(df) or df)
    assert rows(got) == rows(retrieval.hybrid_relevance(dense, lex)) and len(kept) == 1
