"""Best-fit packing by hierarchical residual packing.

Each input partition tokenises its documents, cuts those longer than a sequence, and packs its own pieces by
best fit, longest first. Bins that are nearly full are done. The others become items themselves: rounds of
best fit over them, dealt out by hash to groups of bounded size, merge them as a tree does, until one group
is left or a round no longer merges anything worth while. An item carries which first-level bins it holds and
where, so only small rows move, tokens never do.

Cases: a null text is an empty one; an empty text still has its end token. Repeated rows are documents of
their own. A text of any length is cut into pieces of `capacity` tokens, the last may be shorter. Ties go to
the earlier piece of the partition. An empty table gives an empty result. Columns besides id and text are
not looked at. The strings of the vocabulary's added tokens in a text give those tokens' ids.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import CLEANERS, claim, discard, slices, text_buffer, written

CAPACITY = 2048
END_ID = 0
#: A bin with at most this many free places is done.
NEARLY_FULL = 8
#: Bytes of text that are tokenised together, about.
TOGETHER = 4 << 20
#: Pieces that one best fit of a partition, and items that one best fit of a round, takes at most.
LOCAL_PIECES, ROUND_ITEMS = 200_000, 40_000
#: Rounds end when one of several groups' rounds merges less than this share of the bins.
WORTH = 0.01


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place in it for each item, and how full the bins get; longest first, each into the fullest bin it fits."""
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free places
    mask = 0  # bit f: some bin has f free places
    sizes = lengths[order].tolist()
    for item, size in zip(order.tolist(), sizes, strict=True):
        fits = mask >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
            places[item] = fill[b]
            fill[b] += size
            room -= size
        else:
            b = len(fill)
            fill.append(size)
            places[item] = 0
            room = capacity - size
        bins[item] = b
        if room:
            if not free[room]:
                mask |= 1 << room
            free[room].append(b)
    return bins, places, np.array(fill, np.int64)


class WordTokenizer:
    """Ids of a text as packed little-endian 32-bit integers; words seen before are looked up.

    The vocabulary's normaliser and splitter never join what a blank or a line feed parts, so each stretch
    between those is tokenised once and kept (in a bounded table). Arrow cuts the texts of a batch, finds the
    different stretches and puts their ids together; only these are looked up one by one. A new stretch of plain
    Latin letters, digits and signs is first cut where the splitter cuts it, and its parts, which are fewer, are
    what the library sees.
    The strings of added tokens (`<|endoftext|>`) in a text give those tokens' ids, as the library does;
    with plain_specials they are ordinary text.
    """

    MOST_WORDS = 1_000_000
    LONG_WORD = 64
    #: Stretches that the normaliser only puts into lower case.
    _SIMPLE = re.compile("[!-~\u00c0-\u00ff]{1,%d}" % LONG_WORD)
    # Fixed value: the vocabulary's splitter, for such stretches in lower case, with a blank between two.
    _PARTS = re.compile(" |'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
    #: Stands for the blank between two stretches; no id is as large, so its bytes are found nowhere else.
    _BETWEEN = b"\xff" * 4

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.kept: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def _library(self, found: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(found, add_special_tokens=False)]

    def _apart(self, parts: list[str]) -> Iterator[bytes]:
        """Parts that the splitter leaves whole, many to a line: the vocabulary marks the tokens that end one."""
        lines = [parts[i : i + 256] for i in range(0, len(parts), 256)]
        for line, raw in zip(lines, self._library([" ".join(p) for p in lines]), strict=True):
            ends = 4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)
            if len(ends) == len(line):
                yield from (raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
            else:
                yield from self._library(line)

    def _new(self, found: list[str]) -> dict[str, bytes]:
        simple = list(filter(self._SIMPLE.fullmatch, found))
        line = " ".join(simple)
        if any(t in line for t in self.added):
            simple = [w for w in simple if not any(t in w for t in self.added)]
            line = " ".join(simple)
        parts = self.parts
        if len(parts) > self.MOST_WORDS:
            parts.clear()
        parts[" "] = self._BETWEEN
        cut = self._PARTS.findall(line.lower())
        unknown = list(set(cut).difference(parts))
        parts.update(zip(unknown, self._apart(unknown), strict=True))
        coded = dict(zip(simple, b"".join(map(parts.__getitem__, cut)).split(self._BETWEEN), strict=True)) if simple else {}
        if len(simple) < len(found):
            rest = [w for w in found if w not in coded]
            coded.update(zip(rest, self._library(rest), strict=True))
        return coded

    def coded(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """Ids of all texts, one after another, and the bytes between which each text's are; no text may be null.

        Arrow cuts the texts and finds equal stretches; Python sees each different one once.
        """
        kept = self.kept
        stretches = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(stretches).to_numpy())])
        every = stretches.flatten().dictionary_encode()
        del stretches
        found = every.dictionary.to_pylist()
        ids = list(map(kept.get, found))
        places = [i for i, c in enumerate(ids) if c is None]
        if len(kept) + len(places) > self.MOST_WORDS:  # what this call needs of the table is in `ids` already
            kept.clear()
            kept[""] = b""
        for i in range(0, len(places), 50_000):
            some = places[i : i + 50_000]
            new = self._new([found[k] for k in some])
            for k in some:
                ids[k] = new[found[k]]
            kept.update((w, c) for w, c in new.items() if len(w) <= self.LONG_WORD)
        _, offsets, data = pa.array(ids, pa.large_binary()).take(every.indices).buffers()
        at = np.frombuffer(offsets, np.int64)[: int(ends[-1]) + 1] if ends[-1] else np.zeros(1, np.int64)
        return memoryview(data or b""), at[ends].tolist()

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        data, at = self.coded(pa.array(texts, pa.large_string()))
        for a, b in pairwise(at):
            yield data[a:b].tobytes()


@lru_cache(maxsize=2)
def word_tokenizer(path: str, plain_specials: bool = False) -> WordTokenizer:
    return WordTokenizer(path, plain_specials)


CLEANERS["pack"] = word_tokenizer.cache_clear


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    step = 4 * capacity
    for k, at in enumerate(range(0, len(ids), step)):
        part = ids[at : at + step]
        yield k, at // 4, len(part) // 4, zlib.crc32(part)


def packed_pieces(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their first-level bin: every partition packed by itself."""
    end = np.array([END_ID], "<u4").tobytes()
    names = [id_col, "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pack")
        tok = word_tokenizer(vocab_path)
        rows: list[list] = [[] for _ in range(5)]
        base = TaskContext.get().partitionId() << 36
        made = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            lengths = np.array(rows[3], np.int64)
            bins, places, fill = best_fit(lengths, capacity)
            out = pa.RecordBatch.from_arrays(
                [pa.array(rows[0], id_type), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:]), pa.array(bins + base + made), pa.array(places), pa.array(fill[bins])],
                names=names,
            )
            made += len(fill)
            for r in rows:
                r.clear()
            return out

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field(0).type
            ids = b.column(0).to_pylist()
            texts = b.column(1).fill_null("")
            for i, j in slices(text_buffer(texts)[1], TOGETHER):  # bounds what is held beside the batch
                data, at = tok.coded(texts.slice(i, j - i))
                for doc, (x, y) in zip(ids[i:j], pairwise(at), strict=True):
                    for p in pieces_of(data[x:y].tobytes() + end, capacity):
                        rows[0].append(doc)
                        for r, v in zip(rows[1:], p, strict=True):
                            r.append(v)
                if len(rows[0]) >= LOCAL_PIECES:
                    yield flush()
        if rows[0]:
            yield flush()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long")


_ITEM = "bin long, fill long, members array<struct<first:bigint,at:bigint>>"


def merge_round(items: DataFrame, groups: int, salt: int, capacity: int) -> DataFrame:
    """One best fit in each group of items; an item keeps its first member's name."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin").reset_index(drop=True)
        bins, places, fill = best_fit(pdf["fill"].to_numpy(np.int64), capacity)
        members: list[list] = [[] for _ in fill]
        name = np.full(len(fill), -1, np.int64)
        for i, (b, at, has) in enumerate(zip(bins.tolist(), places.tolist(), pdf["members"], strict=True)):
            members[b] += [{"first": m["first"], "at": m["at"] + at} for m in has]
            if at == 0:
                name[b] = pdf["bin"].iat[i]
        return pd.DataFrame({"bin": name, "fill": fill, "members": members})

    key = F.pmod(F.xxhash64("bin", F.lit(salt)), F.lit(groups)).alias("g")
    return items.groupBy(key).applyInPandas(run, _ITEM)


def pack(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Returns id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    first = written(packed_pieces(docs, vocab_path, capacity, id_col, text_col), "pack-first")
    is_open = F.col("fill") < capacity - NEARLY_FULL
    items = first.where(is_open & (F.col("offset") == 0)).select("bin", "fill", F.array(F.struct(F.col("bin").alias("first"), F.lit(0).cast("long").alias("at"))).alias("members"))
    done: list[DataFrame] = []
    left, salt = items.count(), 0
    while left:
        groups = -(-left // ROUND_ITEMS)
        merged = written(merge_round(items, groups, salt, capacity), "pack-round")
        now = merged.count()
        if groups == 1 or now > left * (1 - WORTH):
            done.append(merged)
            break
        done.append(merged.where(~is_open))
        items = merged.where(is_open)
        left, salt = items.count(), salt + 1
    moved = first.select(F.col("bin").alias("first"), F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("at")).limit(0)
    for d in done:
        moved = moved.unionByName(d.select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select("m.first", "sequence_id", "m.at"))
    out = first.join(moved, first["bin"] == moved["first"], "left")
    return out.select(id_col, "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"))


__all__ = ["best_fit", "discard", "pack", "packed_pieces", "word_tokenizer"]
