"""What the operators share: shared-folder tables, Arrow text buffers and vectorised word hashing.

Text is handled as UTF-8 bytes in the buffers that Arrow hands over, so one numpy call works on all
documents of a batch; Python objects per word are made only where a dictionary needs them.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests on one machine).
LOCAL_FALLBACK = "/tmp/checkpoints/weftline"

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that one step of a vectorised kernel takes at once.
CHUNK_BYTES = 1 << 20


#: What a worker keeps between tasks, by operator: functions that let go of it.
CLEANERS: dict[str, Callable[[], None]] = {}
_owner: list[str] = []


def claim(owner: str) -> None:
    """Called by a task: what another operator's tasks have left in this worker is given back first."""
    if _owner[:1] == [owner]:
        return
    _owner[:] = [owner]
    for name, clear in CLEANERS.items():
        if name != owner:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir; only a local session may lack one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_FALLBACK
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a path that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.weftline_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by written() once nothing reads them."""
    for df in frames:
        if path := getattr(df, "weftline_path", None):
            with contextlib.suppress(Exception):
                remove_path(df.sparkSession, path)


def crc_fold(id_column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds that hold rows out of training."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % n


def fold_of(ids: Iterable[int | None], n: int) -> np.ndarray:
    """The same fold for Python values; a null id is in fold -1, which nothing holds out."""
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % n for i in ids], np.int64)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str, owner: str = "") -> DataFrame:
    """mapInArrow with one call of fn for each batch; owner: the operator, see claim()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 places where they part; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about `most` bytes; a longer document stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, for each document, how many there are."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs) - 1, np.int64)
    black = ~WHITE[data]
    first = np.empty(n, bool)
    first[0] = black[0]
    np.logical_and(black[1:], ~black[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = black[-1]
    np.logical_and(black[:-1], ~black[1:], out=last[:-1])
    cut = np.unique(offs[1:-1])
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[black[cut] & black[cut - 1]]  # a text that ends in a word, before one that begins with a word
    first[both] = True
    last[both - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


_R = np.uint64(0x9E3779B97F4A7C15)
_POW: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_R), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for key, r in (("p", _R), ("i", inverse)):
                a = np.full(size, r, np.uint64)
                a[0] = 1
                _POW[key] = np.multiply.accumulate(a)
    return _POW["p"][:n], _POW["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """What span_hashes() reads; made once where several sets of spans of the same bytes are hashed."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _powers(len(data) + 1)[0][: len(data)]
        np.cumsum(terms, out=sums[1:])
    return sums


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each data[start:end] by prefix sums of a polynomial modulo 2**64; equal bytes, equal hash."""
    sums = prefix_sums(data) if sums is None else sums
    inv = _powers(len(data) + 1)[1]
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def combine(*parts: np.ndarray) -> np.ndarray:
    """A hash of a sequence of hashes; order counts."""
    out = np.full(len(parts[0]), np.uint64(len(parts)), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = mix(out * _R + p)
    return out


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
