"""Documents into chunks: structural, recursive and semantic splitting, tables, overlap.

Splitting is one document at a time and sequential inside it, so it runs as an Arrow-batched map over
documents; no document meets another and nothing is shuffled but pages that belong together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.config import Chunking
from weftline.functions.text import ATX_HEADING, NUMBERED_HEADING, SPACED_OUT, chunk_id, extract_references

#: Where text may be cut, coarse to fine, and where sentences end.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", "; ", ", ", " ", "")
SENTENCE_END = r"(?<=[.!?。！？])\s+"

_ATX, _NUMBERED = re.compile(ATX_HEADING), re.compile(NUMBERED_HEADING)
_TOKENS = re.compile(r"\w+|[^\w\s]")
_SPACED = re.compile(SPACED_OUT)

Counter = Callable[[str], int]


def count_tokens(text: str) -> int:
    """The default counter, the same as functions.text.token_len."""
    return len(_TOKENS.findall(text))


def join_spaced(text: str) -> str:
    """Letters set apart one by one ("H E L L O") come together again."""
    return _SPACED.sub(lambda m: m.group(0).replace(" ", ""), text)


def heading_of(line: str) -> tuple[int, str] | None:
    line = line.strip()
    if m := _ATX.match(line):
        return len(m.group(1)), m.group(2).strip()
    if m := _NUMBERED.match(line):
        return m.group(1).count(".") + 1, line
    return None


def sections(text: str, stack: list[tuple[int, str]]) -> list[tuple[list[str], str]]:
    """Blocks below their headings: (up to three last titles, text); the stack goes on to the next page."""
    blocks: list[tuple[list[str], str]] = []
    lines: list[str] = []

    def close() -> None:
        if "".join(lines).strip():
            blocks.append(([t for _, t in stack][-3:], "\n".join(lines)))
        lines.clear()

    for line in text.split("\n"):
        if (h := heading_of(line)) is not None:
            close()
            while stack and stack[-1][0] >= h[0]:
                stack.pop()
            stack.append(h)
        lines.append(line)
    close()
    return blocks


def split_recursively(text: str, size: int, overlap: int, length: Counter, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` tokens where the text allows it, cut at the coarsest separator there is."""
    sep, finer = "", ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, finer = s, separators[i + 1 :]
            break
    if sep:
        at = text.split(sep)
        parts = [at[0]] + [sep + p for p in at[1:]]
        parts = [p for p in parts if p]
    else:
        parts = list(text)
    out: list[str] = []
    fitting: list[str] = []

    def pour() -> None:
        if not fitting:
            return
        current: list[tuple[str, int]] = []
        used = 0
        for part in fitting:
            n = length(part)
            if current and used + n > size:
                out.append("".join(p for p, _ in current).strip())
                while current and (used > overlap or used + n > size):
                    used -= current.pop(0)[1]
            current.append((part, n))
            used += n
        if current:
            out.append("".join(p for p, _ in current).strip())
        fitting.clear()

    for part in parts:
        if length(part) <= size:
            fitting.append(part)
        else:
            pour()
            out += split_recursively(part, size, overlap, length, finer) if finer else [part.strip()]
    pour()
    return [p for p in out if p]


def sentence_tail(text: str, most: int, length: Counter) -> str:
    """Whole sentences from the end, as many as fit, one at least; words only if that one is over twice too long."""
    if most <= 0 or not text.strip():
        return ""
    tail: list[str] = []
    used = 0
    for s in reversed(re.split(SENTENCE_END, text.strip())):
        n = length(s)
        if tail and used + n > most:
            break
        tail.insert(0, s)
        used += n
    joined = " ".join(tail)
    if used > 2 * most:
        kept = joined.split(" ")
        while len(kept) > 1 and length(" ".join(kept)) > most:
            kept = kept[max(1, len(kept) // 8) :]
        joined = " ".join(kept)
    return joined


def merge_small(pieces: list[str], least: int, length: Counter) -> list[str]:
    """Pieces below `least` tokens join the one before; a small first one joins the next."""
    out: list[str] = []
    for p in (p for p in pieces if p.strip()):
        if out and (length(p) < least or (len(out) == 1 and length(out[0]) < least)):
            out[-1] += "\n" + p
        else:
            out.append(p)
    return out


def split_table(md: str, size: int, length: Counter) -> list[str]:
    """A table cut between rows, its first row on top of every part."""
    rows = md.split("\n")
    if length(md) <= size:
        return [md]
    parts, body, used = [], [], 0
    head, head_n = rows[0], length(rows[0])
    for row in rows:
        n = length(row)
        if body and used + n > size:
            parts.append("\n".join(body))
            body, used = [head], head_n
        body.append(row)
        used += n
    parts.append("\n".join(body))
    return parts


def split_semantically(text: str, size: int, least: int, percentile: float, length: Counter, embed: Callable[[list[str]], np.ndarray]) -> list[str]:
    """Sentences, parted where neighbours are far apart (cosine distance at the percentile or more) or the size is reached."""
    sentences = [s for s in re.split(SENTENCE_END, text.strip()) if s.strip()]
    if len(sentences) < 4:
        return split_recursively(text, size, 0, length)
    x = embed(sentences)
    distance = 1 - (x[:-1] * x[1:]).sum(1)
    cut = np.percentile(distance, percentile)
    out, current, used = [], [sentences[0]], length(sentences[0])
    for s, d in zip(sentences[1:], distance, strict=True):
        n = length(s)
        if used + n > size or (d >= cut and used >= least):
            out.append(" ".join(current))
            current, used = [], 0
        current.append(s)
        used += n
    out.append(" ".join(current))
    return [q for p in out for q in ([p] if length(p) <= size else split_recursively(p, size, 0, length))]


def chunk_document(items: list[tuple[str, int | None, str]], settings: Chunking, length: Counter = count_tokens, embed: Callable[[list[str]], np.ndarray] | None = None) -> Iterator[tuple[str, list[str], int | None, str]]:
    """(text, section path, page, kind) of a document's chunks; items are (text, page, prose or table) in order."""
    strategy = settings.strategy
    if not settings.table_extraction:  # a table is then text like any other
        items = [(text, page, "prose") for text, page, _ in items]
    if strategy == "auto":
        headings = sum(heading_of(line) is not None for t, _, k in items if k == "prose" for line in t.split("\n"))
        strategy = "structural" if headings >= 2 or embed is None else "semantic"
    stack: list[tuple[int, str]] = []
    tail = ""
    for text, page, kind in items:
        if kind == "table":
            tail = ""
            for part in split_table(text, settings.chunk_size, length):
                yield part, ["(table)"], page, "table"
            continue
        if not text.strip():
            continue
        if strategy == "semantic" and embed is not None:
            blocks = [([], split_semantically(text, settings.chunk_size, settings.min_chunk_tokens, settings.breakpoint_percentile, length, embed))]
        else:
            blocks = [(path, split_recursively(block, settings.chunk_size, settings.chunk_overlap, length)) for path, block in sections(text, stack)]
        for path, pieces in blocks:
            pieces = merge_small(pieces, settings.min_chunk_tokens, length)
            if not pieces:
                continue
            last = pieces[-1]
            if tail:
                pieces[0] = tail + "\n" + pieces[0]
            for p in pieces:
                yield p, path, page, "prose"
            tail = sentence_tail(last, settings.chunk_overlap, length)


CHUNK_SCHEMA = "doc_id string, source string, position int, text string, section_path array<string>, page int, content_type string"


def chunk_documents(docs: DataFrame, settings: Chunking | None = None, length: Counter = count_tokens, embed: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """Chunks of documents (doc_id, source, items array<struct<text,page,kind>>), with ids and references.

    Nulls count as empty; a document without text has no chunks.
    """
    c = settings or Chunking()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d in pdf.itertuples():
                items = [(i["text"] or "", i["page"], i["kind"] or "prose") for i in (d.items if d.items is not None else [])]
                for n, (text, path, page, kind) in enumerate(chunk_document(items, c, length, embed)):
                    rows.append((d.doc_id, d.source, n, text, list(path), page, kind))
            yield pd.DataFrame(rows, columns=["doc_id", "source", "position", "text", "section_path", "page", "content_type"]).astype({"page": "Int32"})

    cut = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "items").mapInPandas(run, CHUNK_SCHEMA)
    return cut.withColumn("chunk_id", chunk_id(F.coalesce("source", F.lit("")), F.col("doc_id"), F.col("position"), F.col("text"), c.id_hash_prefix)).withColumn("references", extract_references(F.col("text")))


#: Rows whose order gives the bounds of numbered()'s ranges, and most ranges.
SAMPLE, RANGES = 8192, 256


def numbered(chunks: DataFrame) -> DataFrame:
    """chunk_idx: the corpus order by source, document and position (nulls last), without one global sort.

    Each row's number is its range's offset and its place there. The ranges' bounds are fixed before rows are counted:
    a range partitioning draws its bounds anew whenever it runs, so counts of one run don't fit another.
    """
    keys = ("source", "doc_id", "position")
    key = F.struct(*(c for k in keys for c in (F.col(k).isNull(), F.col(k))))
    drawn = chunks.select(*keys).orderBy(F.xxhash64(*keys)).limit(SAMPLE)
    sample = drawn.select(key.alias("key")).orderBy("key")
    bounds = sorted({i * SAMPLE // RANGES for i in range(RANGES)})
    order = sample.withColumn("nth", F.row_number().over(Window.orderBy("key")) - 1).where(F.col("nth").isin(bounds)).select("key").distinct().orderBy("key").collect()  # RANGES rows at most
    if not order:
        return chunks.withColumn("chunk_idx", F.lit(0).cast("long")).limit(0)
    kind = sample.schema["key"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("low", kind), T.StructField("high", kind), T.StructField("start", T.LongType())])

    def dealt(start: dict[int, int]) -> DataFrame:
        lows = [None, *(r["key"] for r in order)]
        rows = [(p, low, high, start.get(p, 0)) for p, (low, high) in enumerate(zip(lows, [*lows[1:], None], strict=True))]
        table = chunks.sparkSession.createDataFrame(rows, schema)
        own = (F.col("low").isNull() | (F.col("key") >= F.col("low"))) & (F.col("high").isNull() | (F.col("key") < F.col("high")))
        return chunks.withColumn("key", key).join(F.broadcast(table), own).drop("key", "low", "high")  # RANGES + 1 rows

    start, total = {}, 0
    for r in sorted(dealt({}).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        start[r["part"]] = total
        total += r["n"]
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*(F.asc_nulls_last(k) for k in keys)))
    return dealt(start).withColumn("chunk_idx", (F.col("start") + nth - 1).cast("long")).drop("part", "start")


def fixed_windows(docs: DataFrame, size: int = 100, overlap: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of `size` blank-separated words that share `overlap` with the one before: rows (id, position, n_words, text)."""
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), " "), lambda w: w != "")
    step = size - overlap
    rows = docs.select(F.col(id_col), words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.ceil((F.size("w") - overlap) / step).cast("int"), F.lit(1))
    at = rows.select(id_col, "w", F.explode(F.sequence(F.lit(0), last - 1)).alias("position"))
    part = F.slice("w", F.col("position") * step + 1, size)
    return at.select(id_col, "position", F.size(part).alias("n_words"), F.array_join(part, " ").alias("text"))
