import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.config import EdgeWeights
from weftline.functions import vectors as vx
from weftline.operators import graph, signals, spectral, weights


def raw(spark, rows):
    return spark.createDataFrame(rows, "signal string, i long, j long, score double")


def test_weights_add_up():
    EdgeWeights()
    with pytest.raises(ValueError):
        EdgeWeights(semantic=0.5)


def test_minmax(spark):
    df = graph.minmax(raw(spark, [("semantic", 1, 2, 0.8), ("semantic", 1, 2, 0.9), ("semantic", 2, 3, 0.7), ("section", 1, 2, 0.4), ("section", 2, 4, 0.4)]))
    got = {(r["signal"], r["i"], r["j"]): r["norm"] for r in df.collect()}
    assert got == {("semantic", 1, 2): 1.0, ("semantic", 2, 3): 0.0, ("section", 1, 2): 1.0, ("section", 2, 4): 1.0}


def test_combine_floor(spark):
    """An adjacency edge alone is exactly at the floor and stays; a citation edge alone never reaches it."""
    edges = graph.combine(raw(spark, [("adjacency", 1, 2, 1.0), ("citation", 2, 3, 1.0), ("semantic", 3, 4, 0.9), ("semantic", 4, 5, 0.8)])).collect()
    assert {(r["src"], r["dst"]): r["weight"] for r in edges} == {(1, 2): 0.1, (3, 4): 0.15}


def test_section_is_capped_and_unscoped(spark):
    rows = [(i, ["H"]) for i in range(120)] + [(200, ["H", "S"]), (201, ["X"]), (202, [])]
    got = signals.section(spark.createDataFrame(rows, "chunk_idx long, section_path array<string>"), 100)
    assert got.count() == 100 * 99 // 2
    two = signals.section(spark.createDataFrame([(1, ["H", "S"]), (2, ["H", "S"]), (3, ["H"])], "chunk_idx long, section_path array<string>"))
    assert {(r["i"], r["j"]): r["score"] for r in two.collect()} == {(1, 2): 1.0, (1, 3): 0.5, (2, 3): 0.5}


def test_adjacency(spark):
    rows = [(0, "a", "d", 0), (1, "a", "d", 1), (2, "a", "d", 3), (3, "b", "d", 0), (4, "b", "d", 1)]
    got = signals.adjacency(spark.createDataFrame(rows, "chunk_idx long, source string, doc_id string, position int"))
    assert {(r["i"], r["j"]) for r in got.collect()} == {(0, 1), (3, 4)}


def test_entity_counts_each_term_once(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["a", "b"]), (3, ["b", "z"])]
    got = signals.entity(spark.createDataFrame(rows, "chunk_idx long, terms array<string>"))
    assert {(r["i"], r["j"]): r["score"] for r in got.collect()} == {(1, 2): 1.0, (1, 3): 0.5, (2, 3): 0.5}


def test_semantic_with_copies(spark):
    v = [(i, [1.0, 0.0]) for i in range(4)] + [(9, [0.0, 1.0])]
    got = signals.semantic(spark.createDataFrame(v, "chunk_idx long, embedding array<float>"), 7, 0.75)
    assert {(r["i"], r["j"]) for r in got.collect()} == {(a, b) for a in range(4) for b in range(a + 1, 4)}


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {(r["left_id"], r["rank"]): r["right_id"] for r in vx.top_k_join(df, df, 4).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert got == {(i, k + 1): int(j) for i in range(60) for k, j in enumerate(np.argsort(-s[i])[:4])}


def test_expand_counts_seeds_and_orders(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 1)], "query_id long, id long")
    assert {(r["id"], r["hop"]) for r in graph.expand(seeds, edges, 2, 200).collect()} == {(1, 0), (2, 1), (5, 1), (3, 2)}
    assert {r["id"] for r in graph.expand(seeds, edges, 2, 2).collect()} == {1, 2}


def test_degrees_and_counts(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3)], "id long")
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert [(r["id"], r["degree"]) for r in graph.top_by_degree(nodes, edges, 5).collect()] == [(1, 1), (2, 1), (3, 0)]
    assert tuple(graph.counts(nodes, edges).first()) == (3, 1, True)


def test_coordinates_match_numpy(spark):
    pairs = [(0, 1, 1.0), (1, 2, 0.5), (2, 3, 1.0), (3, 4, 0.7), (4, 5, 1.0)]
    edges = spark.createDataFrame(pairs, "src long, dst long, weight double")
    nodes = spark.createDataFrame([(i, i, 7) for i in range(7)], "id long, position int, doc_size int")  # 6 is isolated
    got = {r["id"]: r["coords"] for r in spectral.coordinates(nodes, spectral.laplacian(nodes, edges), 3).collect()}
    w = np.zeros((7, 7))
    for a, b, x in pairs:
        w[a, b] = w[b, a] = x
    d = w.sum(1)
    half = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    lap = np.diag((d > 0).astype(float)) - half[:, None] * w * half[None]
    _, vec = np.linalg.eigh(lap)
    for k in range(1, 3):
        mine = np.array([got[i][k] for i in range(6)])
        assert abs(abs(mine @ vec[:6, k + 1])) == pytest.approx(np.linalg.norm(vec[:6, k + 1]) * np.linalg.norm(mine), rel=1e-6)
    assert len(got) == 7 and got[6] is not None


def test_tiny_graphs(spark):
    edges = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(0, 0, 2), (1, 1, 2)], "id long, position int, doc_size int")
    got = {r["id"]: r["coords"] for r in spectral.coordinates(nodes, spectral.laplacian(nodes, edges), 8).collect()}
    assert got == {0: [0.1], 1: [1.0]}
    assert {r["label"] for r in spectral.cluster_labels(spark.createDataFrame([(1, [0.5])], "id long, coords array<double>")).collect()} == {0}


def test_calibrate(spark):
    rows = [("semantic", i, i + 1, i / 10) for i in range(10)] + [("section", 1, 2, 0.5)]
    w = weights.calibrate(raw(spark, rows)).as_dict()
    assert w["semantic"] == pytest.approx(1.0) and w["section"] == 0
    assert weights.calibrate(raw(spark, [("section", 1, 2, 0.5)])) == EdgeWeights()


def test_store(spark, tmp_path):
    g = graph.GraphTables(spark, str(tmp_path / "g"))
    assert not g.exists()
    g.write(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1, 2, 0.5)], "src long, dst long, weight double"))
    assert g.exists() and g.edges.count() == 1 and g.nodes.select(F.max("id")).first()[0] == 1
