"""Laplacian coordinates and clusters of the graph."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import minmax, symmetric


def laplacian(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries (i, j, value) of I - D^-1/2 W D^-1/2; an isolated node's diagonal is 0."""
    both = symmetric(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    degree = both.groupBy("src").agg(F.sum("weight").alias("d"))
    off = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    entries = off.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight") / F.sqrt(F.col("d") * F.col("dd"))).alias("value"))
    return entries.unionByName(degree.select(F.col("src").alias("i"), F.col("src").alias("j"), F.lit(1.0).alias("value")))


def multiplex(nodes: DataFrame, raw: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum over signals of weight times the signal's own Laplacian; signals of no weight or no edges are left out."""
    norm = minmax(raw).where("norm > 0").select("signal", F.col("i").alias("src"), F.col("j").alias("dst"), F.col("norm").alias("weight"))
    out = None
    for signal, beta in weights.items():
        if beta > 0:
            layer = laplacian(nodes, norm.where(F.col("signal") == signal)).select("i", "j", (F.col("value") * beta).alias("value"))
            out = layer if out is None else out.unionByName(layer)
    if out is None:
        raise ValueError("no signal has a weight")
    return out.groupBy("i", "j").agg(F.sum("value").alias("value"))


def _coordinates(n: int, i: np.ndarray, j: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Rows of the eigenvectors after the first, for the smallest eigenvalues."""
    want = min(k + 1, n - 1)
    if want < 2:
        return np.linspace(0.1, 1.0, n)[:, None]
    m = np.zeros((n, n))
    np.add.at(m, (i, j), value)
    _, vectors = np.linalg.eigh((m + m.T) / 2)
    return vectors[:, 1:want]


def coordinates(nodes: DataFrame, entries: DataFrame, k: int = 32, local_nodes: int = 3000) -> DataFrame:
    """Rows (id, position, coords): up to k coordinates a node, isolated nodes interpolated by their position.

    nodes: (id, position, doc_size). A graph of up to local_nodes is solved in one task; a larger one by
    block Lanczos iteration on 2I - L, whose largest eigenvectors are the smallest of L, with products by the executors.
    Signs are arbitrary.
    """
    n = nodes.count()
    if n == 0:
        return nodes.select("id", "position", F.array().cast("array<double>").alias("coords"))
    if n <= local_nodes:

        def solve(a: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
            a = a.sort_values("id").reset_index(drop=True)
            at = pd.Index(a["id"])
            x = _coordinates(len(a), at.get_indexer(e["i"]), at.get_indexer(e["j"]), e["value"].to_numpy(float), k)
            return pd.DataFrame({"id": a["id"], "coords": list(x)})

        one = lambda df: df.groupBy(F.lit(1).alias("all"))
        solved = one(nodes.select("id")).cogroup(one(entries.select("i", "j", "value"))).applyInPandas(solve, "id long, coords array<double>")
    else:
        solved = _distributed(nodes, entries, n, k)
    linked = entries.select(F.col("i").alias("id")).distinct().withColumn("linked", F.lit(True))
    rows = nodes.join(solved, "id").join(linked, "id", "left")
    dims = min(k, max(n - 2, 1))
    span = rows.agg(*(F.min(F.col("coords")[d]).alias(f"lo{d}") for d in range(dims)), *(F.max(F.col("coords")[d]).alias(f"hi{d}") for d in range(dims)))  # one row
    place = F.col("position") / F.greatest(F.col("doc_size") - 1, F.lit(1))
    between = F.array(*(F.col(f"lo{d}") + place * F.when(F.col(f"hi{d}") > F.col(f"lo{d}"), F.col(f"hi{d}") - F.col(f"lo{d}")).otherwise(1.0) for d in range(dims)))
    return rows.crossJoin(F.broadcast(span)).select("id", "position", F.when(F.col("linked"), F.col("coords")).otherwise(between).alias("coords"))


def leading_vectors(product: Callable[[np.ndarray], np.ndarray], n: int, want: int, tol: float = 1e-8, most: int = 3000, seed: int = 42) -> np.ndarray:
    """Eigenvectors (n x want) of a symmetric matrix for its largest eigenvalues, by its products with n x want blocks.

    Block Lanczos with thick restarts and full orthogonalisation. As many vectors start as are wanted, so eigenvalues
    that are there more than once are found as often. It ends when no residual exceeds tol.
    """
    room, keep = max(4 * want, min(10 * want, 90)), max(2 * want, min(3 * want, 27))
    if n <= 2 * room:
        value, vector = np.linalg.eigh(product(np.eye(n)))
        return vector[:, ::-1][:, :want]
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, want)))[0]
    v, h, left = q, np.zeros((0, 0)), np.inf
    for _ in range(most):
        w = product(q)
        c = v.T @ w
        size = v.shape[1]
        h = np.pad(h, (0, size - len(h)))
        h[:, size - want :], h[size - want :, :] = c, c.T
        w -= v @ c
        w -= v @ (v.T @ w)
        q, t = np.linalg.qr(w)
        q = np.linalg.qr(q - v @ (v.T @ q))[0]
        value, s = np.linalg.eigh((h + h.T) / 2)
        value, s = value[::-1], s[:, ::-1]
        left = np.linalg.norm(t @ s[size - want :, :want], axis=0).max()
        if left < tol:
            break
        if size + want > room:
            v, h = v @ s[:, :keep], np.diag(value[:keep])
        v = np.hstack([v, q])
    else:
        raise RuntimeError(f"eigenvectors have not settled in {most} products: residual {left:.1e}")
    return v @ s[:, :want]


def _distributed(nodes: DataFrame, entries: DataFrame, n: int, k: int) -> DataFrame:
    """Rows (id, coords). The matrix stays on the executors, a block of rows in each part; vectors go to them and back."""
    from pyspark import StorageLevel
    from pyspark.sql import Window

    # Dense row numbers without one global sort: counts of hash parts are offsets of the parts' own numbers.
    parts = 256
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    counted = nodes.select("id", part.alias("part")).withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1)
    sizes = counted.groupBy("part").count().collect()  # 256 rows
    start, offset = 0, {}
    for r in sorted(sizes, key=lambda r: r["part"]):
        offset[r["part"]] = start
        start += r["count"]
    shift = F.create_map(*(F.lit(x) for pair in offset.items() for x in pair))
    index = counted.select("id", (shift[F.col("part")] + F.col("nth")).cast("long").alias("row"))
    flipped = entries.join(index.select(F.col("id").alias("i"), F.col("row").alias("ri")), "i").join(index.select(F.col("id").alias("j"), F.col("row").alias("rj")), "j")
    two = index.select(F.col("row").alias("ri"), F.col("row").alias("rj"), F.lit(2.0).alias("value"))
    matrix = flipped.select("ri", "rj", (-F.col("value")).alias("value")).unionByName(two)
    context = nodes.sparkSession.sparkContext
    blocks = max(1, min(context.defaultParallelism, n // 1000))

    def pack(key: tuple, e: pa.Table) -> pa.Table:
        """A block's entries by row, as rows, their starts, columns and values."""
        ri, rj, value = (e[c].to_numpy() for c in ("ri", "rj", "value"))
        order = np.lexsort((rj, ri))
        rows, starts = np.unique(ri[order], return_index=True)
        packed = pickle.dumps((rows, starts, rj[order], value[order]), protocol=5)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([packed], pa.binary())})

    own = F.floor(F.col("ri") * blocks / n).cast("int")
    packed = matrix.groupBy(own.alias("block")).applyInArrow(pack, "block int, packed binary")
    held = packed.rdd.map(lambda r: (r["block"], bytes(r["packed"]))).partitionBy(blocks, int).persist(StorageLevel.MEMORY_AND_DISK)

    def product(x: np.ndarray) -> np.ndarray:
        sent = context.broadcast(x)

        def times(block: tuple[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
            rows, starts, at, value = pickle.loads(block[1])
            return rows, np.add.reduceat(value[:, None] * sent.value[at], starts, axis=0)

        out = np.zeros_like(x)
        for rows, y in held.map(times).collect():
            out[rows] = y
        sent.destroy()
        return out

    try:
        found = context.broadcast(leading_vectors(product, n, min(k + 1, n - 1))[:, 1:])
    finally:
        held.unpersist()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = found.value[b["row"].to_numpy()]
            ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], ["id", "coords"])

    return index.mapInArrow(placed, "id long, coords array<double>")


def cluster_labels(coords: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Rows (id, label) by k-means, k between 2 and the number of nodes; fewer than two nodes share label 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = coords.count()
    if n < 2:
        return coords.select("id", F.lit(0).alias("label"))
    data = coords.select("id", array_to_vector(F.col("coords").cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, min(k, n)), seed=seed).fit(data)
    return model.transform(data).select("id", F.col("prediction").alias("label"))
