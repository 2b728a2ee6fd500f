"""Maximum inner product search with score-aware (anisotropic) product quantisation.

Codebooks. Vectors are cut into subspaces of two components with 16 centres each (four bits). Both training
and coding minimise the anisotropic loss: the residual's part along the vector itself, which is what shifts
high inner products, weighs ETA times as much as the part across it. Coding is coordinate descent over the
subspaces, since the parallel part couples them.

Search. Every row is coded once and its codes (half a byte a subspace) are stored in the shared folder; only codes
and queries are dealt out in blocks, each pair of blocks one group, never the vectors. Two neighbouring four-bit
codes are one byte, so a query has a table of 256 sums for each byte. The tables are quantised to 8 bits and
scanned in tiles: one row of the table for each code, added up in 16 bits. A group passes on the KEEP rows with
the best approximate scores of each query, ties at the end included, and of all groups' the same again: so the
shortlist is KEEP rows and ties a query, whatever the table. Their vectors are joined and reranked exactly, in
double precision, component after component. The scan leaves no row out; what can be lost is a neighbour whose
approximate score is not among the KEEP best: recall() measures it against brute force.

Only the 21 smallest ids of rows with the same vector can ever be among a query's 20 nearest, so the others
are left out of the scanned rows (they still ask as queries); this loses nothing.

Cases: vectors that are null, empty or zero, hold a null, NaN or infinite component, or differ in length from
the most common length (the longer of two as common) take no part, nor do rows without an id. A row said twice
(one id, one vector) is one row, before any limit. Rows of one id with different vectors are rows of their own,
ask and are found as such, and a query never finds a row with its own id; the nearest of all vectors of an id that
asks are ranked together. With fewer candidates than asked for all are returned. An empty table gives an empty
result. Columns besides id and vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import written

CENTRES, PART = 16, 2
#: Weight of the parallel residual against the orthogonal one.
ETA = 4.0
#: Rows that codebooks are fitted on, at most: those with the smallest hashes.
SAMPLE = 4096
TRAIN_ROUNDS, CODE_ROUNDS = 8, 2
TOP, KEEP = 20, 500
#: Codes and queries of a block, at most; a group holds one block of each.
ROW_BLOCK, QUERY_BLOCK = 1 << 21, 4096
#: On small tables query blocks are made smaller, down to this, so that there are some for every core.
LEAST_QUERY_BLOCK, WANTED_GROUPS = 128, 64
TILE_ROWS, TILE_QUERIES, SLAB = 2048, 256, 32_768
QUERY_EVERY = 20


def _padded(x: np.ndarray) -> np.ndarray:
    """Components up to a multiple of two subspaces."""
    short = -x.shape[1] % (2 * PART)
    return np.pad(x, ((0, 0), (0, short))) if short else x


def encode(x: np.ndarray, books: np.ndarray, rounds: int = CODE_ROUNDS) -> np.ndarray:
    """Codes (rows, subspaces) that minimise the anisotropic loss by coordinate descent."""
    x = _padded(x)
    n, m = len(x), x.shape[1] // PART
    parts = x.reshape(n, m, PART)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    # Residuals' squared lengths and their parts along x, for each subspace and centre.
    square = np.empty((m, n, CENTRES))
    along = np.empty((m, n, CENTRES))
    for s in range(m):
        r = parts[:, s, None, :] - books[s][None]
        square[s] = (r * r).sum(-1)
        along[s] = (r * unit[:, s, None, :]).sum(-1)
    codes = square.argmin(-1).T.copy()  # (n, m)
    rows = np.arange(n)
    total = sum(along[s][rows, codes[:, s]] for s in range(m))
    for _ in range(rounds):
        for s in range(m):
            rest = total - along[s][rows, codes[:, s]]
            # Loss = |r|^2 + (ETA - 1) * (r along x)^2; only this subspace's share varies.
            loss = square[s] + (ETA - 1) * (rest[:, None] + along[s]) ** 2
            codes[:, s] = loss.argmin(1)
            total = rest + along[s][rows, codes[:, s]]
    return codes.astype(np.uint8)


def train(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """Codebooks (subspaces, 16, 2): alternates anisotropic coding and the least-squares centres for its loss."""
    x = _padded(np.asarray(x, np.float64))
    n, m = len(x), x.shape[1] // PART
    rng = np.random.default_rng(seed)
    parts = x.reshape(n, m, PART)
    books = np.stack([parts[rng.integers(0, n, CENTRES), s] + rng.normal(0, 1e-6, (CENTRES, PART)) for s in range(m)])
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    for _ in range(TRAIN_ROUNDS):
        codes = encode(x, books, 1)
        along = np.stack([((parts[:, s] - books[s][codes[:, s]]) * unit[:, s]).sum(-1) for s in range(m)])
        total = along.sum(0)
        for s in range(m):
            # For each centre c: sum over its rows of (I + (ETA - 1) u u') c = sum of (I + (ETA - 1) u u') x + (ETA - 1) rest * u
            u, p = unit[:, s], parts[:, s]
            rest = total - along[s]
            lhs = np.zeros((CENTRES, PART, PART))
            rhs = np.zeros((CENTRES, PART))
            weight = np.eye(PART)[None] + (ETA - 1) * u[:, :, None] * u[:, None, :]
            np.add.at(lhs, codes[:, s], weight)
            np.add.at(rhs, codes[:, s], np.einsum("nij,nj->ni", weight, p) + (ETA - 1) * rest[:, None] * u)
            used = np.bincount(codes[:, s], minlength=CENTRES) > 0
            books[s][used] = np.linalg.solve(lhs[used] + 1e-12 * np.eye(PART), rhs[used][..., None])[..., 0]
            empty = np.flatnonzero(~used)
            books[s][empty] = p[rng.integers(0, n, len(empty))]
            total = total - along[s]
            along[s] = ((p - books[s][codes[:, s]]) * u).sum(-1)
            total = total + along[s]
    return books


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate scores (rows, queries) in 16 bits; larger is nearer, comparable within a query."""
    q = _padded(queries).reshape(len(queries), -1, PART)
    m = q.shape[1]
    tables = np.einsum("qsp,scp->scq", q, books)  # subspace, centre, query
    low = tables.min(1, keepdims=True)
    span = np.maximum((tables - low).max((0, 1)), 1e-30)  # one step size a query, so sums stay comparable
    pair = (tables - low) * (127.0 / span)
    pair = np.rint(pair[0::2, None, :] + pair[1::2, :, None]).astype(np.uint8).reshape(m // 2, 256, -1)  # high nibble: odd subspace
    both = codes[:, 0::2] | codes[:, 1::2] << 4
    out = np.zeros((len(codes), len(queries)), np.uint16)
    for j in range(m // 2):
        out += pair[j].take(both[:, j], axis=0)
    return out


def shortlist(queries: np.ndarray, query_ids: np.ndarray, codes: np.ndarray, ids: np.ndarray, books: np.ndarray, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, approximate score) of each query's `keep` best rows and all that tie with the last of them."""
    out = []
    for a in range(0, len(queries), TILE_QUERIES):
        q, own = queries[a : a + TILE_QUERIES].astype(np.float64), query_ids[a : a + TILE_QUERIES]
        who, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        least = np.zeros(len(q), np.uint16)
        for at in range(0, len(codes), SLAB):
            slab = codes[at : at + SLAB]
            # One is added, so 0 stands for the query's own rows alone.
            approx = np.concatenate([scan(q, slab[i : i + TILE_ROWS], books) for i in range(0, len(slab), TILE_ROWS)]).T + np.uint16(1)
            order = np.argsort(ids[at : at + SLAB])
            known = ids[at : at + SLAB][order]
            begin, end = np.searchsorted(known, own), np.searchsorted(known, own, "right")
            for i in np.flatnonzero(end > begin).tolist():
                approx[i, order[begin[i] : end[i]]] = 0
            if len(slab) > keep:
                least = np.maximum(least, np.partition(approx, len(slab) - keep, axis=1)[:, len(slab) - keep])
            w, r = np.nonzero(approx >= np.maximum(least, 1)[:, None])
            who, row, score = np.concatenate([who, w]), np.concatenate([row, r + at]), np.concatenate([score, approx[w, r]])
            order = np.lexsort((-score.astype(np.int32), who))
            who, row, score = who[order], row[order], score[order]
            last = np.searchsorted(who, np.arange(len(q))) + keep - 1
            full = np.flatnonzero(np.searchsorted(who, np.arange(len(q)), "right") > last)
            least[full] = np.maximum(least[full], score[last[full]])
            fine = score >= least[who]
            who, row, score = who[fine], row[fine], score[fine]
        out.append((who + a, row, score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, v) that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda c: c != 0))
    fine = fine.select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("v") if "float" in vectors.schema[vec_col].dataType.simpleString() else v.cast("array<double>").alias("v"))
    size = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fine.where(F.size("v") == (size["d"] if size else 0))


def coded(rows: DataFrame, books) -> DataFrame:
    """Rows (row, id, code) for rows (row, id, v): two subspaces to a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(2)
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
                codes = np.concatenate([encode(x[i : i + TILE_ROWS], books.value) for i in range(0, len(x), TILE_ROWS)])
                both = codes[:, 0::2] | codes[:, 1::2] << 4
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(bytes, both), pa.binary())], names=["row", "id", "code"])

    return rows.select("row", "id", "v").mapInArrow(run, "row long, id long, code binary")


def unpacked(codes: pd.Series) -> np.ndarray:
    both = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    out = np.empty((len(both), 2 * both.shape[1]), np.uint8)
    out[:, 0::2], out[:, 1::2] = both & 15, both >> 4
    return out


def candidates(asked: DataFrame, codes: DataFrame, books, row_blocks: int, query_blocks: int, keep: int) -> DataFrame:
    """Rows (query, row, approx): the shortlists of all pairs of blocks; query is the row that asks."""
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("row", "id", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)).cast("int").alias("qb"), all_of(row_blocks).alias("rb"))
    right = codes.select("row", "id", "code", F.pmod(F.xxhash64("row"), F.lit(row_blocks)).cast("int").alias("rb"), all_of(query_blocks).alias("qb"))

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"query": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "approx": np.zeros(0, np.int32)})
        who, row, score = shortlist(np.stack(q["v"].to_numpy()), q["id"].to_numpy(), unpacked(r["code"]), r["id"].to_numpy(), books.value, keep)
        return pd.DataFrame({"query": q["row"].to_numpy()[who], "row": r["row"].to_numpy()[row], "approx": score.astype(np.int32)})

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(search, "query long, row long, approx int")


def dot(a: str, b: str) -> Column:
    """The inner product in double precision, added up component after component."""
    product = F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda total, x: total + x)


def _numbered(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (row, id, v) that take part, each once (before any limit), with a number of its own."""
    return written(usable(vectors, id_col, vec_col).distinct().withColumn("row", F.monotonically_increasing_id()), "ann-rows")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = QUERY_EVERY, top: int = TOP, keep: int = KEEP, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the nearest of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = _numbered(vectors, id_col, vec_col)
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).toPandas()  # bounded
    if sample.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = spark.sparkContext.broadcast(train(np.stack(sample["v"].to_numpy())))  # dimension x 16 numbers
    # Of equal vectors only the top + 1 smallest ids can be found.
    few = rows.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= top + 1)
    codes = written(coded(few, books), "ann-codes")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    row_blocks, n_asked = max(1, -(-codes.count() // row_block)), asked.count()
    size = min(query_block, max(LEAST_QUERY_BLOCK, n_asked // WANTED_GROUPS))
    found = candidates(asked, codes, books, row_blocks, max(1, -(-n_asked // size)), keep)
    near = F.rank().over(Window.partitionBy("query").orderBy(F.desc("approx")))
    short = found.withColumn("near", near).where(F.col("near") <= keep).select("query", "row")
    found_rows = rows.select("row", F.col("id").alias("vec_id"), "v")
    queries = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("qv"))
    scored = short.join(found_rows, "row").join(queries, "query").select("query_id", "vec_id", dot("qv", "v").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def recall(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP) -> float:
    """Share of the true neighbours that nearest() found, by brute force over all rows for the queries in `found`.

    Queries are broadcast in no way: they meet the rows in blocks. A found neighbour counts if it scores no less than
    the last true one, so ties don't matter.
    """
    rows = usable(vectors, id_col, vec_col).distinct()
    n = max(1, -(-rows.count() // SLAB))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    asked = rows.join(found.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("rb"))

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        x, ids = np.stack(r["w"].to_numpy()).astype(np.float64), r["row_id"].to_numpy()
        out = []
        for i in range(0, len(q), 256):
            own = q["id"].to_numpy()[i : i + 256]
            s = np.stack(q["v"].to_numpy()[i : i + 256]).astype(np.float64) @ x.T
            s[own[:, None] == ids[None]] = -np.inf
            s = np.sort(s, axis=1)[:, ::-1][:, :top]
            out.append(pd.DataFrame({"query_id": np.repeat(own, s.shape[1]), "score": s.reshape(-1)}))
        return pd.concat(out)

    against = rows.select(F.col("id").alias("row_id"), F.col("v").alias("w"), block.alias("b"))
    true = asked.groupBy("rb").cogroup(against.groupBy("b")).applyInPandas(best, "query_id long, score double").where(F.col("score") > F.lit(float("-inf")))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    last = true.withColumn("nth", nth).where(F.col("nth") <= top).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    hits = found.join(last, "query_id").groupBy("query_id").agg(F.sum((F.col("score") >= F.col("least") - 1e-9).cast("int")).alias("hits"), F.first("n").alias("n"))
    total = hits.agg(F.sum(F.least("hits", "n")).alias("hits"), F.sum("n").alias("n")).first()
    return (total["hits"] or 0) / total["n"] if total["n"] else 1.0
