"""Vector functions: column expressions for a few vectors, an Arrow kernel for blocked exact top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, component after component."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def l2_normalise(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def checked(v: Column, dim: int) -> Column:
    """The vector, or an error if its length is not `dim`."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} components, got "), F.size(v).cast("string"))))


def topk_mean(values: Column, k: int) -> Column:
    top = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)


#: Fewest and most rows of a block, and the blocks of a side from which on they grow instead of getting more.
BLOCK, MOST_ROWS, BLOCKS = 4096, 65536, 16
#: Scores that are looked at at once, and rows that two blocks may give.
TILE, GIVEN = 1 << 22, 1 << 24


def blocks_of(rows: int, least: int | None = None) -> int:
    """Blocks of a side. Its rows are sent once for each block of the other, so their number hardly grows."""
    return max(1, min(-(-rows // (least or BLOCK)), BLOCKS), -(-rows // MOST_ROWS))


def _dealt(left: int, right: int, k: int) -> tuple[int, int]:
    """Blocks of both sides, smaller ones where two blocks would give more than GIVEN rows, k for each row of the left."""
    nl, nr = blocks_of(left), blocks_of(right)
    while -(-left // nl) * min(k, -(-right // nr)) > GIVEN and (nl * BLOCK < left or nr * BLOCK < right):
        nl, nr = (nl, 2 * nr) if nr * BLOCK < right else (2 * nl, nr)
    return nl, nr


def as_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as rows, in the type they are stored in."""
    a = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not len(a):
        return np.zeros((0, 0), np.float32)
    length = pc.list_value_length(a)
    if length.null_count or pc.min(length) != pc.max(length):
        raise ValueError("vectors are missing or differ in length")
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), length[0].as_py())


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products in double precision, component after component."""
    score = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        score += x[:, d, None].astype(np.float64) * y[None, :, d].astype(np.float64)
    return score


def _leading(who: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k best, ties to the smaller other; what is no number counts as largest, as in SQL."""
    order = np.lexsort((other, np.where(np.isnan(score), -np.inf, -score), who))
    row = who[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
    nth = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    return order[nth < k]


def nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int, threshold: float | None = None, exclude_self: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, others, scores) of each row's k best of the other block, some rows at a time.

    A product in single precision, with a bound of its rounding, leaves the few pairs that can be among the best; only
    these are summed as SQL does. Vectors that aren't finite, or too large for single precision, are summed throughout.
    """
    n, m, dim = len(x), len(y), x.shape[1]
    if not n or not m:
        return
    want = k + (int(np.unique(others, return_counts=True)[1].max()) if exclude_self else 0)  # a row and itself may be among the best
    fast = want < m and all(np.isfinite(a).all() and np.abs(a).max(initial=0.0) < 1e15 for a in (x, y))
    if fast:
        x32, y32 = x.astype(np.float32), y.astype(np.float32)
        xt, yt = (np.ascontiguousarray(a.T, np.float64) for a in (x, y))
        room = np.empty((min(n, max(1, TILE // m)), m), np.float32)
        slack = (dim + 4) * 2.0**-23 * np.sqrt((xt * xt).sum(0)) * np.sqrt((yt * yt).sum(0).max()) + 1e-30

    def candidates(a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, places in the other block and exact scores of what may be among the best of rows a to b."""
        if not fast:
            score = exact_scores(x[a:b], y)
            keep = np.ones(score.shape, bool) if want >= m else ~(score < np.partition(score, m - want, axis=1)[:, m - want, None])
            who, to = np.nonzero(keep)
            yield who + a, to, score[who, to]
            return
        score = np.matmul(x32[a:b], y32.T, out=room[: b - a])
        for width in (min(m, max(BLOCK, 4 * want)), m):
            cut = np.partition(score[:, :width], width - want, axis=1)[:, width - want] - slack[a:b]
            if threshold is not None:
                cut = np.maximum(cut, threshold - slack[a:b])
            at = np.flatnonzero(score >= np.nextafter(cut.astype(np.float32), np.float32(-np.inf))[:, None])
            if len(at) <= TILE // 8:
                break
        if len(at) > TILE // 8 and b - a > 1:  # ties without end: fewer rows at once
            yield from candidates(a, (a + b) // 2)
            yield from candidates((a + b) // 2, b)
            return
        who, to = np.divmod(at, m)
        who += a
        total = np.zeros(len(who))
        for d in range(dim):
            total += xt[d].take(who) * yt[d].take(to)
        yield who, to, total

    rows = max(1, (TILE if fast else TILE // 4) // m)
    for a in range(0, n, rows):
        for who, to, score in candidates(a, min(a + rows, n)):
            keep = np.ones(len(who), bool) if threshold is None else ~(score < threshold)
            if exclude_self:
                keep &= ids[who] != others[to]
            who, to, score = who[keep], to[keep], score[keep]
            best = _leading(who, others[to], score, k)
            yield ids[who[best]], others[to[best]], score[best]


def top_k_join(left: DataFrame, right: DataFrame, k: int, threshold: float | None = None, exclude_self: bool = True) -> DataFrame:
    """Exact nearest neighbours: frames (id, v) give rows (left_id, right_id, score), the k best of each left id.

    Both sides are dealt into blocks of bounded size and each pair of blocks is one group of a matrix product,
    which keeps only its own k best that reach the threshold; the best of all blocks are chosen by a window whose
    partial limit runs before the shuffle. Scores are summed component after component in double precision, so they
    equal what SQL gives. Ties go to the smaller id. No side is broadcast or collected. The work grows with the product
    of the sides, at some 5 ns a pair and core; what is sent grows with their rows.
    """
    def best(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return nearest(ids, x, others, y, k, threshold, exclude_self)

    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id"))
    return _met(left, right, k, best).withColumn("rank", rank).where(F.col("rank") <= k).select("left_id", "right_id", "score", "rank")


def all_scores(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner products of all pairs, as top_k_join sums them: frames (id, v) give rows (left_id, right_id, score)."""

    def every(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rows = max(1, (1 << 18) // max(1, len(y)))
        for a in range(0, len(x), rows):
            score = exact_scores(x[a : a + rows], y)
            yield np.repeat(ids[a : a + rows], len(y)), np.tile(others, len(score)), score.ravel()

    return _met(left, right, 1 << 62, every)


def _met(left: DataFrame, right: DataFrame, k: int, pairs: Callable[..., Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> DataFrame:
    """What pairs(), which gives k rows for each of the left at most, makes of each block of the left with each of the right: rows (left_id, right_id, score)."""
    nl, nr = _dealt(left.count(), right.count(), k)
    l2 = left.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(nl)).alias("lb"), F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("rb"))
    r2 = right.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nl - 1).cast("long"))).alias("lb"))
    schema = pa.schema([("left_id", pa.int64()), ("right_id", pa.int64()), ("score", pa.float64())])

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        ids, others = (c["id"].to_numpy().astype(np.int64) for c in (a, b))
        return pa.concat_tables([pa.table(list(found), schema=schema) for found in pairs(ids, as_matrix(a["v"]), others, as_matrix(b["v"]))])

    return l2.groupBy("lb", "rb").cogroup(r2.groupBy("lb", "rb")).applyInArrow(best, "left_id long, right_id long, score double")


def axis_variance(vectors: DataFrame, top: int = 3) -> DataFrame:
    """The dimensions with the largest population variance: rows (dim, variance, rank); ties to the smaller dimension."""
    per = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))
    return per.orderBy(F.desc(F.round("variance", 12)), "dim").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("variance", 12)), "dim")))
