"""The six edge signals. Each takes chunk frames and gives raw edges (signal, i, j, score) with i < j."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import citation_keys
from weftline.functions.vectors import blocks_of, top_k_join

#: Extractors by name: further signals are added here. Each gets the chunks frame.
EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def extractor(name: str):
    """Registers a signal."""

    def put(f):
        EXTRACTORS[name] = f
        return f

    return put


def _edges(pairs: DataFrame, signal: str, score: str = "score") -> DataFrame:
    """Best score of each unordered pair; pairs of a chunk with itself go."""
    lo, hi = F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    return pairs.where("i <> j").select(lo, hi, F.col(score).alias("score")).groupBy("i", "j").agg(F.max("score").alias("score")).select(F.lit(signal).alias("signal"), "i", "j", "score")


@extractor("semantic")
def semantic(chunks: DataFrame, k: int = 7, threshold: float = 0.75) -> DataFrame:
    """k nearest neighbours by inner product that reach the threshold; (chunk_idx, embedding).

    k + 1 are searched and the chunk itself dropped, so with exact copies k + 1 neighbours can stay.
    """
    v = chunks.where("embedding is not null").select(F.col("chunk_idx").alias("id"), F.col("embedding").alias("v"))
    near = top_k_join(v, v, k + 1, threshold, exclude_self=False).where(F.col("left_id") != F.col("right_id"))
    return _edges(near.select(F.col("left_id").alias("i"), F.col("right_id").alias("j"), "score"), "semantic")


@extractor("adjacency")
def adjacency(chunks: DataFrame) -> DataFrame:
    """Neighbours in reading order within a document: positions that follow each other; (chunk_idx, source, doc_id, position).

    A window over each document, not over the corpus, so it is as parallel as there are documents.
    """
    w = Window.partitionBy("source", "doc_id").orderBy("chunk_idx")
    after = chunks.select("chunk_idx", "position", F.lead("chunk_idx").over(w).alias("next"), F.lead("position").over(w).alias("next_position"))
    pairs = after.where(F.col("next_position") == F.col("position") + 1).select(F.col("chunk_idx").alias("i"), F.col("next").alias("j"), F.lit(1.0).alias("score"))
    return _edges(pairs, "adjacency")


@extractor("section")
def section(chunks: DataFrame, max_members: int = 100) -> DataFrame:
    """Chunks below one heading path: depth of the shared path over the longer path; (chunk_idx, section_path).

    The first max_members chunks of each path take part, in corpus order; paths are not bound to a document.
    The cap is part of the signal's definition and bounds the pairs of a path.
    """
    size = F.size("section_path")
    prefixes = F.transform(F.sequence(F.lit(1), size), lambda d: F.slice("section_path", 1, d))
    rows = chunks.where(size > 0).select("chunk_idx", size.alias("len"), F.explode(prefixes).alias("prefix"))
    kept = rows.withColumn("nth", F.row_number().over(Window.partitionBy("prefix").orderBy("chunk_idx"))).where(F.col("nth") <= max_members)
    a = kept.select(F.col("chunk_idx").alias("i"), F.col("len").alias("li"), "prefix")
    b = kept.select(F.col("chunk_idx").alias("j"), F.col("len").alias("lj"), F.col("prefix"))
    pairs = a.join(b, "prefix").where("i < j").withColumn("score", F.size("prefix") / F.greatest("li", "lj", F.lit(1)))
    return _edges(pairs, "section")


#: Chunks of a block from which on there are more blocks, and pairs that are counted at once.
PAIR_BLOCK, PAIRS = 512, 1 << 18


def pair_counts(own: np.ndarray, own_keys: pa.Array, other: np.ndarray, other_keys: pa.Array, within: bool, only_most: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(smaller ids, larger ids, numbers of shared keys) of each chunk's pairs with another block's, or within its own block.

    Keys are lists, each key once. Some rows' counts at a time stand in a table of bounded size. With only_most, rows that
    have no more keys than a pair found shares are left out: they can't share more.
    """
    m = len(other)
    if not len(own) or not m:
        return
    sizes = lambda k: np.diff(k.offsets.to_numpy()).astype(np.int64)
    if only_most:
        longest = np.argsort(-sizes(own_keys), kind="stable")
        own, own_keys = own[longest], own_keys.take(pa.array(longest))
    both = pa.concat_arrays([own_keys.flatten(), other_keys.flatten()]).dictionary_encode()
    code, rows = both.indices.to_numpy(), sizes(own_keys)
    mine, theirs = code[: rows.sum()], code[rows.sum() :]
    order = np.argsort(theirs, kind="stable")
    members = np.repeat(np.arange(m), sizes(other_keys))[order]
    length = np.bincount(theirs, minlength=len(both.dictionary))
    first = np.cumsum(length) - length
    ends = np.r_[0, np.cumsum(rows)]
    met = np.r_[0, np.cumsum(length[mine])][ends]  # pairs before each row
    at, most = 0, 0
    while at < len(own) and not (only_most and rows[at] <= most):
        stop = max(at + 1, min(at + max(1, PAIRS // m), int(np.searchsorted(met, met[at] + PAIRS, "right")) - 1))
        keys = mine[ends[at] : ends[stop]]
        n, total = length[keys], int(met[stop] - met[at])
        place = np.repeat(first[keys] - (np.cumsum(n) - n), n) + np.arange(total)
        cell = np.repeat(np.repeat(np.arange(stop - at) * m, rows[at:stop]), n) + members[place]
        table = np.bincount(cell, minlength=(stop - at) * m)
        found = np.flatnonzero(table > (most if only_most else 0))
        count = table[found]
        row, to = np.divmod(found, m)
        i, j = own[at + row], other[to]
        if within:
            keep = i != j if only_most else i < j
            i, j, count = i[keep], j[keep], count[keep]
        most = max(most, int(count.max(initial=0)))
        yield np.minimum(i, j), np.maximum(i, j), count
        at = stop


def shared_keys(keys: DataFrame, signal: str, min_freq: int = 2, max_members: int | None = None, digits: int | None = None, store: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Number of keys two chunks share over the largest such number; rows (chunk_idx, key), each once.

    Keys in fewer than min_freq chunks link nothing and go before chunks meet. With max_members a key links only
    its first chunks in corpus order; without it a key in n chunks gives n (n - 1) / 2 pairs, as defined. Chunks are
    dealt into blocks, and each two blocks meet as one group, where all that two chunks share is counted: pairs are
    never shuffled, only chunks, once for each block. Blocks meet twice, first for the largest number alone.
    With digits, scores are rounded; store keeps the chunks' keys, which are read more than once.
    """
    once = keys.distinct()
    often = once.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= min_freq)
    kept = once.join(often.select("key"), "key")
    if max_members is not None:
        kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("chunk_idx"))).where(F.col("nth") <= max_members).drop("nth")
    chunks = kept.groupBy("chunk_idx").agg(F.collect_list("key").alias("keys"))
    chunks = store(chunks) if store else chunks
    blocks = blocks_of(chunks.count(), PAIR_BLOCK)
    own = F.pmod(F.xxhash64("chunk_idx"), F.lit(blocks)).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    dealt = chunks.withColumn("own", own).select("chunk_idx", "keys", "own", F.explode(meets).alias("meet")).select("chunk_idx", "keys", "own", "meet.x", "meet.y")

    def met(kernel: Callable[[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], Iterator[list[pa.Array]]], only_most: bool, schema: str) -> DataFrame:
        """What the kernel makes of each two blocks' pairs."""
        names = [c.split()[0] for c in schema.split(", ")]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches))
            block, x, y = (table[c].to_numpy() for c in ("own", "x", "y"))
            sides = []
            for b in (x[0], y[0]):
                rows = table.filter(pa.array(block == b)).sort_by("chunk_idx")
                if not rows.num_rows:
                    return
                sides += [rows["chunk_idx"].to_numpy(), pa.concat_arrays(rows["keys"].chunks)]
            for out in kernel(pair_counts(*sides, x[0] == y[0], only_most)):
                yield pa.RecordBatch.from_arrays(out, names)

        return dealt.repartition(blocks * (blocks + 1) // 2, "x", "y").groupBy("x", "y").applyInArrow(count, schema)  # by work, not by bytes

    def largest(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[list[pa.Array]]:
        yield [pa.array([max((int(n.max(initial=0)) for _, _, n in parts), default=0)], pa.int32())]

    most = met(largest, True, "n int").agg(F.max("n")).first()[0] or 0  # one row
    share = F.col("n") / F.lit(most)
    shares = [r[0] for r in keys.sparkSession.range(1, most + 1).withColumnRenamed("id", "n").orderBy("n").select(share if digits is None else F.round(share, digits)).collect()]  # a chunk's number of keys at most

    def edges(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[list[pa.Array]]:
        score, held = np.array([0.0, *shares]), []
        for part in itertools.chain(parts, (None,)):
            held += [part] if part else []
            if held and (part is None or sum(len(i) for i, _, _ in held) >= 1 << 16):
                i, j, n = (np.concatenate(c) for c in zip(*held, strict=True))
                held = []
                yield [pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(score[n])]

    return met(edges, False, "i long, j long, score double").select(F.lit(signal).alias("signal"), "i", "j", "score")


@extractor("entity")
def entity(chunks: DataFrame, min_freq: int = 2, max_members: int | None = None) -> DataFrame:
    """Shared concepts or entities; (chunk_idx, terms)."""
    return shared_keys(chunks.select("chunk_idx", F.explode(F.array_distinct("terms")).alias("key")), "entity", min_freq, max_members)


@extractor("citation")
def citation(chunks: DataFrame, max_members: int | None = None) -> DataFrame:
    """Shared references, DOIs and URLs of the texts; (chunk_idx, text)."""
    return shared_keys(chunks.select("chunk_idx", F.explode(citation_keys(F.col("text"))).alias("key")), "citation", 2, max_members)


@extractor("utility_question")
def utility_question(questions: DataFrame, k: int = 20, threshold: float = 0.80) -> DataFrame:
    """Chunks whose questions are alike: nearest questions, k with itself and siblings; (question_id, chunk_idx, embedding)."""
    v = questions.select(F.col("question_id").alias("id"), F.col("embedding").alias("v"))
    near = top_k_join(v, v, k, threshold, exclude_self=False)
    of = questions.select("question_id", "chunk_idx")
    pairs = near.join(of.select(F.col("question_id").alias("left_id"), F.col("chunk_idx").alias("i")), "left_id").join(of.select(F.col("question_id").alias("right_id"), F.col("chunk_idx").alias("j")), "right_id")
    return _edges(pairs.select("i", "j", "score"), "utility_question")
