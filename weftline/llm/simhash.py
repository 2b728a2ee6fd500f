"""SimHash near-duplicates: a popcount grid finds candidates, exact distances decide.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of their popcounts is its embedding. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints, so pairs beyond
it need not be looked at. Of two fingerprints at most four bits apart, one 32-bit half differs in two bits at
most, so the halves' embeddings lie within Manhattan distance two of each other. Such points share a point of
the unit grid that is within distance one of both. Each fingerprint is therefore put into its own cell and
the next cells of either half, cells are the join key, and all that meet in a cell are compared by Hamming
distance.

Only distinct fingerprints take part, so copies cost nothing. Nothing lists the pairs of a group: in a cell,
a search from one fingerprint to all within reach emits each newly reached one once, so a cell of n gives at
most n - 1 links, and those keep the same components as all links do.

Cases: null and empty texts have fingerprint zero and link as any other; a text of fewer words than a shingle
gives one shingle of all its words. Repeated rows and ids each get a row. Texts of any length are read whole.
An empty table gives an empty result. Columns besides id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import LOWER, WHITE, map_batches, slices, text_buffer, words, written
from weftline.llm.graph import components

WORDS, SEED, NEAR = 4, 42, 4


def fingerprints_of(data: np.ndarray, offs: np.ndarray, k: int = WORDS) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit numbers."""
    n = len(offs) - 1
    out = np.zeros(n, np.uint64)
    data = LOWER[data]
    starts, ends, counts = words(data, offs)
    if not len(starts):
        return out
    # One blank between words, whatever stood there: a shingle is then a slice.
    length = ends - starts
    to = np.cumsum(length + 1) - (length + 1)
    if len(starts) > 1 and (starts[1:] - ends[:-1] == 1).all():
        flat = data[starts[0] : ends[-1]].copy()
        flat[WHITE[flat]] = 0x20
        text = flat.tobytes()
        to = starts - starts[0]
    else:
        take = np.repeat(starts - to, length + 1) + np.arange(int(to[-1] + length[-1] + 1))
        flat = data[np.minimum(take, len(data) - 1)]
        flat[to + length] = 0x20
        text = flat.tobytes()
    first = np.cumsum(counts) - counts  # the text's first word
    shingles = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    s0 = np.repeat(first, shingles) + (np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles))
    last = np.minimum(s0 + k, np.repeat(first + counts, shingles)) - 1
    begin, end = to[s0].tolist(), (to[last] + length[last]).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(text[a:b], SEED) for a, b in zip(begin, end, strict=True)], np.uint64)
    full = np.flatnonzero(shingles)
    at = np.cumsum(shingles) - shingles
    for i, j in slices(np.concatenate([at[full], [len(h)]]), 1 << 18):  # bounds the unpacked bits
        lo, hi = at[full[i]], (at[full[j]] if j < len(full) else len(h))
        bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[full[i:j]] - lo, axis=0, dtype=np.int64)
        set_bits = ones * 2 > shingles[full[i:j], None]
        out[full[i:j]] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): the fingerprint's 64 bits as a long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = text_buffer(b.column(1))
        parts = [fingerprints_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts).view(np.int64))], names=[id_col, "fp"])

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, fp long")


def cells_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (cell, fingerprint) rows: a cell is 32 popcounts of two bits each of one half, and bit 0 of its key says which."""
    pairs = np.uint64(0x5555555555555555)
    counts = fp - ((fp >> np.uint64(1)) & pairs)  # each two bits now hold their own popcount
    cells, owners = [], []
    for half in (0, 1):
        v = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(half)
        cells.append(v << np.uint64(1) | tag)
        owners.append(fp)
        for seg in range(16):
            one = np.uint64(1 << 2 * seg)
            value = (v >> np.uint64(2 * seg)) & np.uint64(3)
            up, down = value < 2, value > 0
            cells += [(v[up] + one) << np.uint64(1) | tag, (v[down] - one) << np.uint64(1) | tag]
            owners += [fp[up], fp[down]]
    return np.concatenate(cells), np.concatenate(owners)


def _spread(members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest among members within reach, by search that looks at unreached ones only."""
    left = members
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= NEAR
            if near.any():
                found = left[near]
                yield np.full(len(found), x, np.uint64), found
                queue.extend(found)
                left = left[~near]


#: Cells of more members are looked at by parts.
LARGE_CELL = 1024
#: Which of the 16 segments of a half are in each of five groups.
_GROUPS = [np.uint64(sum(3 << 2 * s for s in range(16) if s % 5 == g)) for g in range(5)]


def _parts(members: np.ndarray, half: int) -> Iterator[np.ndarray]:
    """The members of a cell of this half; of a large cell, those that agree in one group of the other half's popcounts.

    Two members at most NEAR = 4 bits apart differ by four at most in the Manhattan distance of the other half's popcounts
    as well, so of five groups of segments they agree in one and meet there: no link is lost.
    """
    if len(members) <= LARGE_CELL:
        yield members
        return
    other = members >> np.uint64(32) if half == 0 else members & np.uint64(0xFFFFFFFF)
    counts = other - ((other >> np.uint64(1)) & np.uint64(0x55555555))
    for group in _GROUPS:
        key = counts & group
        order = np.argsort(key, kind="stable")
        for part in np.split(members[order], np.flatnonzero(np.diff(key[order])) + 1):
            if len(part) > 1:
                yield part


#: Cells of up to so many members are compared all at once, pair by pair.
SMALL_CELL = 12


def links_of(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by cell."""
    new = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(new, len(cell)))
    left, right = [], []
    small = np.repeat(size <= SMALL_CELL, size)
    for k in range(1, SMALL_CELL):
        i = np.flatnonzero((cell[k:] == cell[:-k]) & small[k:])
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= NEAR]
        left.append(fp[i])
        right.append(fp[i + k])
    for at in np.flatnonzero(size > SMALL_CELL):
        for part in _parts(fp[new[at] : new[at] + size[at]], int(cell[new[at]]) & 1):
            for a, b in _spread(part):
                left.append(a)
                right.append(b)
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pair[:, 0], pair[:, 1]


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between names that join the same components as all pairs of fp at most NEAR bits apart; rows (fp, name)."""

    def spread(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        name = b.column(1).to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), 20_000):
            order = np.argsort(fp[i : i + 20_000])
            known, names = fp[i : i + 20_000][order], name[i : i + 20_000][order]
            cell, owner = cells_of(known)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(owner.view(np.int64)), pa.array(names[np.searchsorted(known, owner)])], names=["cell", "fp", "name"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, fp, name = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in _and_end(batches):
            if b is not None:
                columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                cell, fp, name = np.concatenate([cell, columns[0].view(np.uint64)]), np.concatenate([fp, columns[1].view(np.uint64)]), np.concatenate([name, columns[2]])
                cut = int(np.searchsorted(cell.view(np.int64), cell.view(np.int64)[-1])) if len(cell) else 0  # the last cell may go on
            else:
                cut = len(cell)
            if cut:
                x, y = links_of(cell[:cut], fp[:cut])
                if len(x):
                    known, first = np.unique(fp[:cut], return_index=True)
                    names = name[:cut][first]
                    yield pa.RecordBatch.from_arrays([pa.array(names[np.searchsorted(known, v)]) for v in (x, y)], names=["a", "b"])
                cell, fp, name = cell[cut:], fp[cut:], name[cut:]

    cells = map_batches(distinct.select("fp", "name"), spread, "cell long, fp long, name long")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long")


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


#: Names of fingerprints that only rows without an id have; ids are below.
NAMELESS = 1 << 62


def _roots(marked: DataFrame, id_col: str) -> DataFrame:
    """Rows (fp, root): the smallest name of each fingerprint's component; NAMELESS and above if no row there has an id."""
    nameless = F.lit(NAMELESS).cast("long") + F.col("fp").bitwiseAND(F.lit((1 << 61) - 1))
    distinct = written(marked.groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("least")).select("fp", F.coalesce("least", nameless).alias("name")), "distinct")
    links = components(near_links(distinct))
    return written(distinct.join(links, distinct["name"] == links["node"], "left").select("fp", F.coalesce("root", "name").alias("root")), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint, component_id), one for each row of docs; component_id is the smallest id reachable.

    Ids are whole numbers below 2**62. Each distinct fingerprint goes by its smallest id, so the smallest name of a
    component is its id and nothing is grouped by component. Rows without an id link too, but give no name: among
    themselves their component is null. Rows that repeat an id are one document, and so in one component.
    """
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    component = F.when(F.col("root") < NAMELESS, F.col("root")).alias("component_id")
    return marked.join(_roots(marked, id_col), "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group stays, with all its columns: the one whose id is the group's smallest.

    Ids name documents; rows that repeat an id stay or go together. Of a group in which no row has an id one row
    stays, the one with the smallest fingerprint and then the smallest hash of its columns; a row without an id
    goes if its group has one with.
    """
    marked = written(fingerprints(docs, id_col, text_col), "fingerprints")
    roots = _roots(marked, id_col)
    kept = marked.join(roots, "fp").where(F.col(id_col) == F.col("root")).select(F.col(id_col).alias("kept_id")).distinct()
    named = docs.join(kept, docs[id_col] == kept["kept_id"], "left_semi")
    row = F.struct(*docs.columns).alias("row")
    unnamed = fingerprints(docs.where(F.col(id_col).isNull()).select(row, text_col), "row", text_col)
    order = F.struct("fp", F.sha2(F.to_json("row"), 256))
    one = unnamed.join(roots.where(F.col("root") >= NAMELESS), "fp").groupBy("root").agg(F.min_by("row", order).alias("row"))
    return named.unionByName(one.select("row.*"))
