"""Katz backoff bigram model: Good-Turing discounts, exactly normalised backoff weights, every token scored.

Model. Words are lower-cased (A-Z) runs of anything but white space, each text ends with an end token, and
the first token's history is a begin mark, which is no token itself. For counts c up to 5 the Good-Turing
discount d(c) applies (absolute discounting where the counts of counts don't give one between 0 and 1):

    P(w | v) = d(c(v,w)) c(v,w) / c(v)                      if c(v,w) > 0 (above 5: the count less 0.1)
             = alpha(v) P(w)                                 else, with alpha(v) = 1 if v has no successor
    alpha(v) = (1 - sum of the first over v's successors) / (1 - sum of P(w) over v's successors)
    P(w)     = d1(c(w)) c(w) / N                             if c(w) > 0
             = what that leaves of one                       else: one class of all unknown words

so for each history the probabilities of all words and of the unknown class add up to one.

Flow. The text is read twice. The first pass counts words (the unigram table, partitioned by word, in the
shared folder). The second cuts its partition into chunks of whole documents, counts each chunk's bigrams by
document with one sort, and sends them, packed by column, to the bucket of the bigram's word; words that are
more than their share of all tokens are dealt out by history too. A bucket knows the counts of its bigrams
and of its words; it sends back to the chunks what each document gains from them, by count class, so the
discounts can follow once the counts of counts of all buckets are known. For held-out documents it passes on
which histories they used and which of these backed off; together with each history's sums over its
successors these meet in the history's bucket, where alpha is worked out. Histories as frequent as the dealt
words are few and are worked out first; their documents wait in the chunk. At last each chunk adds up its
documents. Only bounded lists are collected: counts of counts up to 6, and the frequent words (at most
4 HOT_SHARE-ths a bucket).

Words go by 56 bits of a 64-bit hash: ten million distinct words collide with a probability below 1e-3.

Cases: a null or empty text has its end token only. Repeated rows and ids are texts of their own (the fold
goes by id; null ids count as the text "null" is not one, they train). Without training tokens N and V are 0
and the base is log10(1 / 1) = 0 a token, as is the model's. Texts of any length are read whole. Columns
besides id and text are not looked at.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, claim, mix, read_table, slices, span_hashes, text_buffer, words, written

__all__ = ["katz_scores", "read_table"]

FOLDS, HELD_OUT = 7, 2
CLASSES = 5
BOS, END = np.uint64(1), np.uint64(2)
MASK = np.uint64((1 << 56) - 1)
#: Text and documents of a chunk, at most (a longer document is a chunk of its own).
CHUNK_TEXT, CHUNK_DOCS = 6 << 20, 60_000
#: A word is dealt out by history if it is more than 1 / (HOT_SHARE x buckets) of all tokens.
HOT_SHARE = 4
#: Counts above 5 are lowered by this, so that a history whose successors are all frequent still backs off.
LARGE_LESS = 0.1
COLUMNS = CLASSES + 1


# -- packing ---------------------------------------------------------------------------------------------


def pack_ids(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unpack_ids(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(b, np.uint8).reshape(-1, 7)
    return out.view("<u8")[:, 0]


#: Shorter columns are left as they are.
SHORT = 128
_tools: list = []


def pack(a: np.ndarray, kind: str) -> bytes:
    raw = a.astype(kind).tobytes()
    if len(raw) < SHORT:
        return b"\0" + raw
    if not _tools:
        _tools.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return b"\1" + _tools[0].compress(raw)


def unpack(b: bytes, kind: str) -> np.ndarray:
    if b[:1] == b"\0":
        return np.frombuffer(b, kind, offset=1)
    if not _tools:
        _tools.extend((zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()))
    return np.frombuffer(_tools[1].decompress(memoryview(b)[1:]), kind)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


# -- texts -----------------------------------------------------------------------------------------------


def token_ids(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts' tokens, ends included, and how many each text has."""
    hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in slices(offs):  # hashing needs a multiple of the text's memory, so it goes by parts
        low = LOWER[data[offs[i] : offs[j]]]
        s, e, n = words(low, offs[i : j + 1] - offs[i])
        sizes.append(n)
        if len(s):
            h = span_hashes(low, s, e) & MASK
            hashes.append(np.where(h < 16, h + np.uint64(16), h))
    h, counts = np.concatenate(hashes), np.concatenate(sizes)
    out = np.empty(len(h) + len(counts), np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(counts)), counts)] = h
    out[np.cumsum(counts + 1) - 1] = END
    return out, counts + 1


def held_of(ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids], bool)


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The unigram table (word, count) over training texts, counted in Python a batch at a time before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            w = np.concatenate([k for k, _ in kept])
            n = np.concatenate([c for _, c in kept])
            u, inverse = np.unique(w, return_inverse=True)
            return u, np.bincount(inverse, weights=n).astype(np.int64)

        for b in batches:
            train = ~held_of(b.column(0).to_pylist())
            data, offs = text_buffer(b.column(1).filter(pa.array(train)))
            for i, j in slices(offs):
                t, _ = token_ids(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                kept.append(np.unique(t, return_counts=True))
                size += len(kept[-1][0])
                if size > 1_000_000:
                    kept = [merged()]
                    size = len(kept[0][0])
                    if size > 700_000:
                        yield pa.RecordBatch.from_arrays([pa.array(kept[0][0].view(np.int64)), pa.array(kept[0][1])], names=["word", "n"])
                        kept, size = [], 0
        if kept:
            u, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.select(id_col, text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def discounts(n: dict[int, int]) -> np.ndarray:
    """Katz's factors for counts 1..5 from the numbers of things seen 1..6 times; all below one if n[1] > 0."""
    n1, last = n.get(1, 0), n.get(CLASSES + 1, 0)
    out = np.ones(CLASSES)
    if all(n.get(r, 0) for r in range(1, CLASSES + 2)):
        cut = (CLASSES + 1) * last / n1
        out = np.array([((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if cut < 1 else 0 for r in range(1, CLASSES + 1)])
        if ((out > 0) & (out < 1)).all():
            return out
    total = n1 + 2 * n.get(2, 0)
    d = min(max(n1 / total, 0.1), 0.9) if n1 and total else 0.5
    return 1 - d / np.arange(1, CLASSES + 1)


# -- second pass -----------------------------------------------------------------------------------------

_FLOW = "bucket int, chunk long, kind int, w binary, wn binary, c binary, cn binary, d binary, k binary, held binary"
_FLOW_COLUMNS = [f.split()[0] for f in _FLOW.split(", ")]


def chunk_flow(chunk: int, data: np.ndarray, offs: np.ndarray, held: np.ndarray, hot: np.ndarray, buckets: int) -> Iterator[dict]:
    """One row for each bucket: its bigrams by word, then history, then document."""
    tok, sizes = token_ids(data, offs)
    doc = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64)
    names, wi = np.unique(tok, return_inverse=True)
    wi = wi.astype(np.uint64)
    ci = np.empty_like(wi)
    ci[1:] = wi[:-1]
    ci[np.cumsum(sizes) - sizes] = len(names)
    names = np.append(names, BOS)
    key, times = np.unique(wi << np.uint64(40) | ci << np.uint64(16) | doc, return_counts=True)
    pair = key >> np.uint64(16)
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    per = np.diff(np.append(first, len(pair)))
    w, c = names[(pair[first] >> np.uint64(24)).astype(np.int64)], names[(pair[first] & np.uint64(0xFFFFFF)).astype(np.int64)]
    with np.errstate(over="ignore"):
        at = mix(np.where(np.isin(w, hot), w + c * np.uint64(0x9E3779B97F4A7C15), w)) % np.uint64(buckets)
    order = np.argsort(at.astype(np.uint32), kind="stable")
    at, w, c, per, first = at[order], w[order], c[order], per[order], first[order]
    entries = ranges(first, per)
    d, k = (key[entries] & np.uint64(0xFFFF)).astype(np.uint16), times[entries]
    ends = np.concatenate([[0], np.cumsum(per)])
    bits = np.packbits(held).tobytes()
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        new = np.flatnonzero(np.concatenate([[True], w[a + 1 : b] != w[a : b - 1]]))
        yield {
            "bucket": int(at[a]), "chunk": chunk, "kind": 0, "w": pack_ids(w[a:b][new]), "wn": pack(np.diff(np.append(new, b - a)), "<u4"), "c": pack_ids(c[a:b]),
            "cn": pack(per[a:b], "<u4"), "d": pack(d[ends[a] : ends[b]], "<u2"), "k": pack(k[ends[a] : ends[b]], "<u4"), "held": bits,
        }


def flow(docs: DataFrame, id_col: str, text_col: str, hot, buckets: int) -> DataFrame:
    """All chunks' rows; kind 1 carries a chunk's documents instead."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in _FLOW_COLUMNS[3:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("katz")
        base = TaskContext.get().partitionId() << 24
        made = 0
        hot_words = hot.value[0]

        def rows(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids = pa.chunked_array([p.column(0) for p in parts])
            data, offs = text_buffer(pa.chunked_array([p.column(1) for p in parts]))
            held = held_of(ids.to_pylist())
            chunk = base + made
            made += 1
            out = list(chunk_flow(chunk, data, offs, held, hot_words, buckets))
            out.append({"bucket": int(chunk % buckets), "chunk": chunk, "kind": 1, "held": np.packbits(held).tobytes(), "cn": pack(words(data, offs)[2] + 1, "<u4")})
            docs_of = pa.array([None] * (len(out) - 1) + [ids.to_pylist()], pa.list_(ids.type))
            cols = [pa.array([r.get(c) for r in out], f.type) for c, f in zip(_FLOW_COLUMNS, schema, strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, docs_of], names=[*_FLOW_COLUMNS, "ids"])

        waiting: list[pa.RecordBatch] = []
        size = n = 0
        for b in batches:
            length = b.column(1).nbytes
            if waiting and (size + length > CHUNK_TEXT or n + b.num_rows > CHUNK_DOCS):
                yield from rows(waiting)
                waiting, size, n = [], 0, 0
            waiting.append(b)
            size += length
            n += b.num_rows
        if waiting:
            yield from rows(waiting)

    return docs.select(id_col, text_col).mapInArrow(run, f"{_FLOW}, ids array<{kind}>")


class Gains:
    """What documents gain in one task: by chunk and document, tokens by count class and sums of logarithms."""

    def __init__(self):
        self.parts: dict[int, list[tuple]] = {}

    def add(self, chunk: int, doc: np.ndarray, seen: np.ndarray, logs: np.ndarray, base: np.ndarray, known: np.ndarray) -> None:
        """seen: (n, 5) tokens whose bigram was seen 1..5 times."""
        u, inverse = np.unique(doc, return_inverse=True)
        sum_ = lambda x: np.bincount(inverse, weights=x, minlength=len(u))
        self.parts.setdefault(chunk, []).append((u, np.stack([sum_(seen[:, r]) for r in range(COLUMNS)], 1), sum_(logs), sum_(base), sum_(known)))

    def rows(self) -> Iterator[dict]:
        for chunk, parts in self.parts.items():
            doc = np.concatenate([p[0] for p in parts])
            u, inverse = np.unique(doc, return_inverse=True)
            sum_ = lambda x: np.bincount(inverse, weights=x, minlength=len(u))  # noqa: B023, E731
            seen = np.concatenate([p[1] for p in parts])
            yield {
                "kind": 2, "chunk": chunk, "d": pack(u, "<u2"), "n": pack(np.stack([sum_(seen[:, r]) for r in range(COLUMNS)]), "<u4"), "logs": pack(sum_(np.concatenate([p[2] for p in parts])), "<f8"),
                "base": pack(sum_(np.concatenate([p[3] for p in parts])), "<f8"), "known": pack(sum_(np.concatenate([p[4] for p in parts])), "<u4"),
            }


def by_bucket(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """Rows sorted by a column, as lists of those with one value."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0][column] != r[column]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


#: Rows of the second pass's result. kind 2: gains of a chunk's documents; 3: sums of histories; 4: histories that
#: held-out documents used; 5: sums of one frequent history; 6: frequent histories that a chunk's documents used;
#: 7: counts of counts; 1: a chunk's documents.
_OUT = "kind int, bucket int, chunk long, c binary, cn binary, n binary, m binary, s binary, chunks binary, d binary, k binary, back binary, logs binary, base binary, known binary, held binary, hot long, total long, n1 long, n2 long, n3 long, n4 long, n5 long, n6 long, m1 long, m2 long, m3 long, m4 long, m5 long, m6 long, big long"
_OUT_NAMES = [f.split()[0] for f in _OUT.split(", ")]
_PA = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_OUT_SCHEMA = pa.schema([(f.split()[0], _PA[f.split()[1]]) for f in _OUT.split(", ")])


def out_batch(rows: list[dict], ids_type: pa.DataType | None = None) -> pa.RecordBatch:
    cols = [pa.array([r.get(n) for r in rows], f.type) for n, f in zip(_OUT_NAMES, _OUT_SCHEMA, strict=True)]
    if ids_type is None:
        return pa.RecordBatch.from_arrays(cols, names=_OUT_NAMES)
    return pa.RecordBatch.from_arrays([*cols, pa.array([r.get("ids") for r in rows], ids_type)], names=[*_OUT_NAMES, "ids"])


def class_counts(c: np.ndarray, weight: np.ndarray | int = 1) -> np.ndarray:
    """(n, 6): weight where the count is 1, ..., 5 or more."""
    return (np.minimum(c, COLUMNS)[:, None] == np.arange(1, COLUMNS + 1)) * (np.asarray(weight)[..., None] if np.ndim(weight) else weight)


class Model:
    """Unigram side of the model."""

    def __init__(self, tokens: int, types: int, counts_of: dict[int, int]):
        self.tokens, self.types = tokens, types
        self.d1 = discounts(counts_of)
        large = types - sum(counts_of.get(r, 0) for r in range(1, CLASSES + 1))
        less = sum(counts_of.get(r, 0) * r * (1 - self.d1[r - 1]) for r in range(1, CLASSES + 1)) + large * LARGE_LESS
        self.unknown = less / tokens if tokens else 1.0
        self.factor = np.concatenate([[0.0], self.d1 * np.arange(1, CLASSES + 1)])

    def log_unigram(self, c: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.zeros(len(c))
        value = np.where(c <= CLASSES, self.factor[np.minimum(c, CLASSES)], c - LARGE_LESS) / self.tokens
        return np.log10(np.where(c > 0, value, self.unknown))

    def log_base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.types + 1))


def count_bucket(rows: list[dict], model: Model, hot: np.ndarray, hot_counts: np.ndarray, gains: Gains, histories: list, used: list, counts_of: np.ndarray) -> None:
    """One bucket: counts its bigrams and says what every document gains."""
    w, c, per, d, k, src = [], [], [], [], [], []
    for i, r in enumerate(rows):
        w.append(np.repeat(unpack_ids(r["w"]), unpack(r["wn"], "<u4")))
        c.append(unpack_ids(r["c"]))
        per.append(unpack(r["cn"], "<u4").astype(np.int64))
        d.append(unpack(r["d"], "<u2"))
        k.append(unpack(r["k"], "<u4").astype(np.int64))
        src.append(np.full(len(d[-1]), i))
    held = [np.unpackbits(np.frombuffer(r["held"], np.uint8)).astype(bool) for r in rows]
    w, c, per, d, k, src = (np.concatenate(x) for x in (w, c, per, d, k, src))
    is_held = np.concatenate([held[i][x] for i, x in zip(range(len(rows)), np.split(d, np.flatnonzero(np.diff(src)) + 1), strict=True)])
    # Distinct bigrams: sorted by word and history.
    order = np.lexsort((c, w))
    sw, sc = w[order], c[order]
    new = np.concatenate([[True], (sw[1:] != sw[:-1]) | (sc[1:] != sc[:-1])])
    which = np.empty(len(w), np.int64)
    which[order] = np.cumsum(new) - 1
    pw, pc = sw[new], sc[new]
    entry_pair = np.repeat(which, per)
    n_pair = np.bincount(entry_pair, weights=k * ~is_held, minlength=len(pw)).astype(np.int64)
    word_new = np.concatenate([[True], pw[1:] != pw[:-1]])
    word_at = np.cumsum(word_new) - 1
    n_word = np.bincount(word_at, weights=n_pair).astype(np.int64)
    names = pw[word_new]
    if len(hot):
        spot = np.searchsorted(hot, names)
        fixed = (spot < len(hot)) & (hot[np.minimum(spot, len(hot) - 1)] == names)
        n_word[fixed] = hot_counts[spot[fixed]]
    word_of_pair = n_word[word_at]
    counts_of += np.bincount(n_pair[n_pair <= CLASSES + 1], minlength=CLASSES + 2)
    # Each document's tokens here.
    cp, cw = n_pair[entry_pair], word_of_pair[entry_pair]
    logs = np.where(cp > CLASSES, k * np.log10(np.maximum(cp - LARGE_LESS, 1)), 0.0)
    back = is_held & (cp == 0)
    logs += np.where(back, k * model.log_unigram(cw), 0.0)
    # A word of a training text is the history of the next token, which was seen: its count divides.
    divides = ~is_held & (pw[entry_pair] != END)
    logs -= np.where(divides, k * np.log10(np.maximum(cw, 1)), 0.0)
    seen = class_counts(cp, k)
    base, known = k * model.log_base(cw), k * (cw > 0)
    cuts = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        gains.add(rows[src[a]]["chunk"], d[a:b], seen[a:b], logs[a:b], base[a:b], known[a:b])
    # Sums over successors, for the histories' backoff weights.
    live = n_pair > 0
    c_live, w_live = n_pair[live], word_of_pair[live]
    histories.append((pc[live], c_live, np.minimum(c_live, COLUMNS).astype(np.uint8), np.minimum(w_live, COLUMNS).astype(np.uint8), np.where(w_live > CLASSES, w_live, 0)))
    chunk = np.array([r["chunk"] for r in rows], np.int64)
    used.append((pc[entry_pair[is_held]], chunk[src[is_held]], d[is_held], np.where(cp[is_held] > 0, k[is_held], 0), np.where(back[is_held], k[is_held], 0)))


def sum_pairs(histories: list) -> tuple[np.ndarray, ...]:
    """Each history's sums over its successors: tokens, successors by class of the bigram's and of the word's count, large counts."""
    u, inverse = np.unique(np.concatenate([h[0] for h in histories]), return_inverse=True)
    total = lambda i: np.bincount(inverse, weights=np.concatenate([h[i] for h in histories]), minlength=len(u)).astype(np.int64)
    classes = lambda i: np.bincount(inverse * 8 + np.concatenate([h[i] for h in histories]), minlength=8 * len(u)).reshape(-1, 8)[:, 1 : COLUMNS + 1]
    return u, total(1), classes(2), classes(3), total(4)


def sum_histories(parts: list) -> tuple[np.ndarray, ...]:
    """The same of several sums."""
    u, inverse = np.unique(np.concatenate([h[0] for h in parts]), return_inverse=True)
    total = lambda x: np.bincount(inverse, weights=x, minlength=len(u)).astype(np.int64)
    n, m = (np.concatenate([h[i] for h in parts]) for i in (2, 3))
    return (u, total(np.concatenate([h[1] for h in parts])), np.stack([total(n[:, r]) for r in range(COLUMNS)], 1), np.stack([total(m[:, r]) for r in range(COLUMNS)], 1), total(np.concatenate([h[4] for h in parts])))


def sum_used(used: list) -> tuple[np.ndarray, ...]:
    c, chunk, d, k, back = (np.concatenate([u[i] for u in used]) for i in range(5))
    order = np.lexsort((d, chunk, c))
    c, chunk, d, k, back = c[order], chunk[order], d[order], k[order], back[order]
    if not len(c):
        return c, chunk, d, k, back
    new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (chunk[1:] != chunk[:-1]) | (d[1:] != d[:-1])]))
    return c[new], chunk[new], d[new], np.add.reduceat(k, new), np.add.reduceat(back, new)


def history_rows(histories: list, used: list, hot: np.ndarray, buckets: int) -> Iterator[dict]:
    """What a task passes on to the histories' buckets, and the frequent histories apart."""
    if not histories:
        return
    u, total, n, m, s = sum_pairs(histories)
    hu, chunk, d, k, back = sum_used(used)
    names = np.append(hot, BOS)
    is_hot = np.isin(u, names)
    for i in np.flatnonzero(is_hot).tolist():
        yield {"kind": 5, "hot": int(u[i]), "total": int(total[i]), "big": int(s[i]), **{f"n{r + 1}": int(n[i, r]) for r in range(COLUMNS)}, **{f"m{r + 1}": int(m[i, r]) for r in range(COLUMNS)}}
    at = (mix(u) % np.uint64(buckets)).astype(np.int64)
    at[is_hot] = -1
    order = np.argsort(at, kind="stable")
    cut = np.searchsorted(at[order], np.arange(buckets + 1))
    hot_used = np.isin(hu, names)
    at_used = (mix(hu) % np.uint64(buckets)).astype(np.int64)
    at_used[hot_used] = -1
    order_used = np.argsort(at_used, kind="stable")
    cut_used = np.searchsorted(at_used[order_used], np.arange(buckets + 1))
    for b in range(buckets):
        x, y = order[cut[b] : cut[b + 1]], order_used[cut_used[b] : cut_used[b + 1]]
        if len(x):
            yield {"kind": 3, "bucket": b, "c": pack_ids(u[x]), "cn": pack(total[x], "<u8"), "n": pack(n[x].T, "<u4"), "m": pack(m[x].T, "<u4"), "s": pack(s[x], "<u8")}
        if len(y):
            new = np.flatnonzero(np.concatenate([[True], hu[y][1:] != hu[y][:-1]]))
            yield {"kind": 4, "bucket": b, "c": pack_ids(hu[y][new]), "cn": pack(np.diff(np.append(new, len(y))), "<u4"), "chunks": pack(chunk[y], "<u8"), "d": pack(d[y], "<u2"), "k": pack(k[y], "<u4"), "back": pack(back[y], "<u4")}
    y = np.flatnonzero(hot_used)
    y = y[np.argsort(chunk[y], kind="stable")]
    for part in np.split(y, np.flatnonzero(np.diff(chunk[y])) + 1):
        if len(part):
            yield {"kind": 6, "chunk": int(chunk[part[0]]), "c": pack(hu[part], "<u8"), "d": pack(d[part], "<u2"), "k": pack(k[part], "<u4"), "back": pack(back[part], "<u4")}


def count_all(flowing: DataFrame, partitions: int, model, hot, ids_type: str) -> DataFrame:
    arrow_ids = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal arrow_ids
        gains, histories, used = Gains(), [], []
        counts_of = np.zeros(CLASSES + 2, np.int64)
        words_, counts_ = hot.value
        passing: list[dict] = []
        pending = 0

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal arrow_ids
            for b in source:
                arrow_ids = b.schema.field("ids").type
                yield b

        def emit(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            some: list[dict] = []
            for r in rows:
                some.append(r)
                if len(some) == 32:
                    yield out_batch(some, arrow_ids)
                    some = []
            if some:
                yield out_batch(some, arrow_ids)

        for group in by_bucket(typed(batches), "bucket"):
            passing += [{"kind": 1, "chunk": r["chunk"], "held": r["held"], "cn": r["cn"], "ids": r["ids"]} for r in group if r["kind"] == 1]
            mine = [r for r in group if r["kind"] == 0]
            if mine:
                count_bucket(mine, model.value, words_, counts_, gains, histories, used, counts_of)
                pending += len(histories[-1][0]) + len(used[-1][0])
            if pending > 1_500_000:
                yield from emit(history_rows(histories, used, words_, partitions))
                histories, used, pending = [], [], 0
        yield from emit(iter(passing))
        yield from emit(gains.rows())
        yield from emit(history_rows(histories, used, words_, partitions))
        if counts_of.any():
            yield out_batch([{"kind": 7, **{f"n{r}": int(counts_of[r]) for r in range(1, CLASSES + 1)}, "total": int(counts_of[CLASSES + 1])}], arrow_ids)

    return flowing.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, f"{_OUT}, ids array<{ids_type}>")


def log_alpha(total: np.ndarray, n: np.ndarray, m: np.ndarray, big: np.ndarray, model: Model, d2: np.ndarray) -> np.ndarray:
    """log10 of each history's backoff weight from the sums over its successors."""
    r = np.arange(1, CLASSES + 1)
    left = ((n[..., :CLASSES] * ((1 - d2) * r)).sum(-1) + LARGE_LESS * n[..., CLASSES]) / np.maximum(total, 1)
    rest = 1 - ((m[..., :CLASSES] * model.factor[1:]).sum(-1) + big - LARGE_LESS * m[..., CLASSES]) / max(model.tokens, 1)
    return np.where(total > 0, np.log10(np.maximum(left, 1e-300)) - np.log10(np.maximum(rest, 1e-300)), 0.0)


def back_off(counted: DataFrame, partitions: int, model, d2: np.ndarray) -> DataFrame:
    """Gains of held-out documents from the histories that aren't frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains()
        for group in by_bucket(batches, "bucket"):
            sums = [r for r in group if r["kind"] == 3]
            uses = [r for r in group if r["kind"] == 4]
            if not uses:
                continue
            parts = []
            for r in sums:
                c = unpack_ids(r["c"])
                parts.append((c, unpack(r["cn"], "<u8").astype(np.int64), unpack(r["n"], "<u4").reshape(COLUMNS, -1).T, unpack(r["m"], "<u4").reshape(COLUMNS, -1).T, unpack(r["s"], "<u8").astype(np.int64)))
            if parts:
                u, total, n, m, s = sum_histories(parts)
                alpha, count = log_alpha(total, n, m, s, model.value, d2), np.log10(np.maximum(total, 1))
            else:
                u, alpha, count = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
            for r in uses:
                per = unpack(r["cn"], "<u4")
                c = unpack_ids(r["c"])
                at = np.minimum(np.searchsorted(u, c), max(len(u) - 1, 0))
                fine = u[at] == c if len(u) else np.zeros(len(c), bool)
                a, t = (np.where(fine, x[at] if len(u) else 0.0, 0.0) for x in (alpha, count))
                logs = np.repeat(a, per) * unpack(r["back"], "<u4") - np.repeat(t, per) * unpack(r["k"], "<u4")
                chunks, d = unpack(r["chunks"], "<u8").astype(np.int64), unpack(r["d"], "<u2")
                order = np.argsort(chunks, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(chunks[order])) + 1):
                    if len(part):
                        z = np.zeros(len(part))
                        gains.add(int(chunks[part[0]]), d[part], np.zeros((len(part), COLUMNS)), logs[part], z, z)
        some = list(gains.rows())
        for i in range(0, len(some), 32):
            yield out_batch(some[i : i + 32])

    return counted.where("kind in (3, 4)").drop("ids").repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _OUT)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * partitions
    unigrams = written(word_counts(docs, id_col, text_col), "unigrams")
    first = unigrams.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), *(F.count(F.when(F.col("n") == r, 1)).alias(f"n{r}") for r in range(1, CLASSES + 2))).first()
    tokens = first["tokens"] or 0
    counts_of = {r: first[f"n{r}"] for r in range(1, CLASSES + 2)}
    frequent = unigrams.where(F.col("n") * (HOT_SHARE * buckets) > tokens).collect()  # at most HOT_SHARE x buckets words
    names = np.array([r["word"] for r in frequent], np.int64).view(np.uint64)
    order = np.argsort(names)
    hot = spark.sparkContext.broadcast((names[order], np.array([r["n"] for r in frequent], np.int64)[order]))
    model = spark.sparkContext.broadcast(Model(tokens, first["types"], counts_of))
    # Rows here are packed columns of up to some hundred kilobytes: few to a batch. Shuffle files go once they are read.
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    try:
        counted = written(count_all(flow(docs, id_col, text_col, hot, buckets), partitions, model, hot, kind), "bigrams")
        seen = counted.where("kind = 7").agg(*(F.sum(f"n{r}").alias(f"n{r}") for r in range(1, CLASSES + 1)), F.sum("total").alias("n6")).first()
        d2 = discounts({r: seen[f"n{r}"] or 0 for r in range(1, CLASSES + 2)})
        sums = [F.sum(c).alias(c) for c in ("total", "big", *(f"{x}{r}" for x in "nm" for r in range(1, COLUMNS + 1)))]
        often = counted.where("kind = 5").groupBy("hot").agg(*sums).collect()  # the frequent words and the begin mark
        backed = written(back_off(counted, partitions, model, d2), "backoff")
    finally:
        gc.collect()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    often.sort(key=lambda r: np.uint64(r["hot"]))
    hot_names = np.array([r["hot"] for r in often], np.int64).view(np.uint64)
    hot_total = np.array([r["total"] for r in often], np.int64)
    field = lambda x: np.array([[r[f"{x}{i}"] for i in range(1, COLUMNS + 1)] for r in often], np.int64).reshape(-1, COLUMNS)
    hot_alpha = log_alpha(hot_total, field("n"), field("m"), np.array([r["big"] for r in often], np.int64), model.value, d2)
    hot_count = np.log10(np.maximum(hot_total, 1))
    begins = float(hot_count[hot_names == BOS][0]) if (hot_names == BOS).any() else 0.0
    per_class = np.append(np.log10(d2 * np.arange(1, CLASSES + 1)), 0.0)

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["kind"] == 1].iloc[0]
        ids = list(head["ids"])
        n = len(ids)
        held = np.unpackbits(np.frombuffer(head["held"], np.uint8))[:n].astype(bool)
        score, base, known = np.where(held, 0.0, -begins), np.zeros(n), np.zeros(n)
        for r in pdf[pdf["kind"] == 2].itertuples():
            d = unpack(r.d, "<u2")
            score[d] += unpack(r.n, "<u4").reshape(COLUMNS, -1).T @ per_class + unpack(r.logs, "<f8")
            base[d] += unpack(r.base, "<f8")
            known[d] += unpack(r.known, "<u4")
        for r in pdf[pdf["kind"] == 6].itertuples():
            at = np.searchsorted(hot_names, unpack(r.c, "<u8"))
            fine = (at < len(hot_names)) & (hot_names[np.minimum(at, max(len(hot_names) - 1, 0))] == unpack(r.c, "<u8")) if len(hot_names) else np.zeros(len(at), bool)
            at = np.where(fine, at, 0)
            gain = np.where(fine, hot_alpha[at] * unpack(r.back, "<u4") - hot_count[at] * unpack(r.k, "<u4"), 0.0) if len(hot_names) else np.zeros(len(at))
            np.add.at(score, unpack(r.d, "<u2"), gain)
        return pd.DataFrame({"id": ids, "held_out": held, "n_tokens": unpack(head["cn"], "<u4").astype(np.int64), "known": known.astype(np.int64), "base": base, "score": score})

    rows = counted.where("kind in (1, 2, 6)").select("kind", "chunk", "c", "cn", "d", "k", "back", "n", "logs", "base", "known", "held", "ids")
    rows = rows.unionByName(backed.where("kind = 2").select("kind", "chunk", "c", "cn", "d", "k", "back", "n", "logs", "base", "known", "held", F.lit(None).cast(f"array<{kind}>").alias("ids")))
    done = rows.groupBy("chunk").applyInPandas(add_up, f"id {kind}, held_out boolean, n_tokens long, known long, base double, score double")
    return done.select(F.col("id").alias(id_col), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
