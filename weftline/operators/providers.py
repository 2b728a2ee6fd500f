"""Models behind interfaces, each with a deterministic default that needs no network.

The defaults are approximations, not the models they stand in for: hashed words for an embedder, frequent rare
terms for concepts, leading sentences for questions, capitalised runs for entities, shared words for a
reranker, the best sentences for an answer. Any of them is replaced by passing another function.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import detect_language, text_hash, token_len, tokenize


#: Turns a list of texts into one row of numbers each: what a model's client offers.
TextEmbedder = Callable[[list[str]], np.ndarray]


def retrying(call: Callable, attempts: int = 3, wait: float = 1.0, longest: float = 10.0) -> Callable:
    """The call, tried again after a growing wait; the last error is raised."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception:
                if k + 1 == attempts:
                    raise
                time.sleep(min(wait * 2**k, longest))
        return None

    return run


def in_batches(texts: list[str], embed: TextEmbedder, batch: int = 32, attempts: int = 3, wait: float = 1.0) -> np.ndarray:
    """Unit vectors of all texts, a batch at a time. A batch that fails or comes back short is tried again; a dimension that
    changes between batches is an error."""

    def one(part: list[str]) -> np.ndarray:
        got = np.asarray(embed(part), np.float32)
        if got.ndim != 2 or len(got) != len(part):
            raise ValueError(f"{len(part)} texts gave vectors of shape {got.shape}")
        return got

    parts = [retrying(one, attempts, wait)(texts[i : i + batch]) for i in range(0, len(texts), batch)]
    if not parts:
        return np.zeros((0, 0), np.float32)
    if len({p.shape[1] for p in parts}) > 1:
        raise ValueError(f"the dimension changed between batches: {sorted({p.shape[1] for p in parts})}")
    x = np.concatenate(parts)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def embedding_of(embed: TextEmbedder, batch: int = 32, attempts: int = 3, wait: float = 1.0, prefixes: dict[str, str] | None = None) -> Callable[[Column, str], Column]:
    """A column function of a text embedder; prefixes by kind (document or query) for models that tell them apart."""

    def function(kind: str):
        before = (prefixes or {}).get(kind, "")

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(list(in_batches([before + (t or "") for t in texts], embed, batch, attempts, wait)))

        return run

    return lambda text, kind="document": function(kind)(text)


def hashed_words(dim: int = 256) -> TextEmbedder:
    """Signed hashed words."""

    def embed(texts: list[str]) -> np.ndarray:
        found = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
        distinct = list(dict.fromkeys(w for f in found for w in f))
        place = {w: i for i, w in enumerate(distinct)}
        h = np.array([zlib.crc32(w.encode()) for w in distinct], np.int64)
        at = np.array([place[w] for f in found for w in f], np.int64)
        row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        out = np.zeros((len(texts), dim), np.float32)
        if len(at):
            np.add.at(out, (row, h[at] % dim), np.where(h[at] & 0x80000000, 1, -1).astype(np.float32))
        return out

    return embed


def hashed_embedding(dim: int = 256) -> Callable[[Column, str], Column]:
    """Hashed words of unit length."""
    return embedding_of(hashed_words(dim), batch=512)


def tfidf_concepts(chunks: DataFrame, per_chunk: int = 5, max_share: float = 0.2) -> DataFrame:
    """Rows (chunk_idx, terms): each chunk's terms of at least five letters with the highest tf-idf."""
    n = chunks.agg(F.count(F.lit(1)).alias("n"))  # one row
    toks = chunks.select("chunk_idx", F.explode(tokenize(F.col("text"))).alias("term")).where(F.length("term") >= 5).groupBy("chunk_idx", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = toks.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= 2) & (F.col("df") <= F.greatest(F.lit(2), max_share * F.col("n"))))
    scored = toks.join(df, "term").withColumn("s", F.col("tf") * F.log(F.col("n") / F.col("df")))
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("chunk_idx").orderBy(F.desc(F.round("s", 9)), "term"))).where(F.col("r") <= per_chunk)
    return top.groupBy("chunk_idx").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def leading_questions(text: Column, n: int = 2) -> Column:
    """The first sentences, as stand-ins for generated questions."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 20)
    return F.slice(parts, 1, n)


def capitalised_entities(text: Column) -> Column:
    """Runs of capitalised words inside sentences, as (text, label, normalized), each once."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<=[a-z,;] )\p{Lu}[\p{L}\d]+(?: \p{Lu}[\p{L}\d]+)*"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.struct(x.alias("text"), F.lit("MISC").alias("label"), F.lower(x).alias("normalized"))))


def entity_terms(entities: Column) -> Column:
    """Normalised names, each once: the same name under two labels links no more than once."""
    return F.array_distinct(F.transform(entities, lambda e: e["normalized"]))


def merge_entities(first: Column, second: Column) -> Column:
    """A second extractor's finds are taken where the first has no entity of that text and label."""
    key = lambda e: F.concat_ws("\x1f", e["text"], e["label"])
    return F.concat(first, F.filter(second, lambda e: ~F.array_contains(F.transform(first, key), key(e))))


def overlap_reranker(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has."""
    q = F.array_distinct(tokenize(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokenize(text))) / F.size(q)).otherwise(0.0)


def extractive_answer(question: Column, context: Column) -> Column:
    """The context's sentence that shares most words with the question."""
    q = F.array_distinct(tokenize(question))
    scored = F.transform(F.split(context, r"(?<=[.!?])\s+"), lambda s: F.struct(F.size(F.array_intersect(q, tokenize(s))).alias("n"), s.alias("s")))
    return F.array_max(scored)["s"]


@dataclass(frozen=True)
class Providers:
    """What the pipelines call; replace any field."""

    embed: Callable[[Column, str], Column]
    token_len: Callable[[Column], Column] = token_len
    language: Callable[[Column, str], Column] = detect_language
    concepts: Callable[[DataFrame], DataFrame] = tfidf_concepts
    questions: Callable[[Column, int], Column] = leading_questions
    entities: Callable[[Column], Column] = capitalised_entities
    rerank: Callable[[Column, Column], Column] = overlap_reranker
    answer: Callable[[Column, Column], Column] = extractive_answer
    #: Names the embedder in cache keys: another model's vectors are not taken for its own.
    model: str = "hashed-words"
    #: Embeds sentences where the chunker looks for breaks; without it texts are never cut by meaning.
    embed_texts: TextEmbedder | None = None
    #: Concepts of one text (null: failed), kept by content; in place of `concepts`, which looks at the whole corpus.
    text_concepts: Callable[[Column], Column] | None = None
    #: A second extractor, whose finds are added to those of `entities`.
    more_entities: Callable[[Column], Column] | None = None

    def all_entities(self, text: Column) -> Column:
        first = self.entities(text)
        return first if self.more_entities is None else merge_entities(first, self.more_entities(text))


def default_providers(dim: int = 256) -> Providers:
    return Providers(embed=hashed_embedding(dim), model=f"hashed-words-{dim}", embed_texts=hashed_words(dim))


def require_embedded(chunks: DataFrame, column: str = "embedding") -> DataFrame:
    """The same rows; reading one without a vector is an error."""
    v = F.col(column)
    return chunks.withColumn(column, F.when(v.isNull(), F.raise_error(F.lit(f"a chunk has no {column}"))).otherwise(v))


def cached(texts: DataFrame, cache: DataFrame | None, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Values by content: rows (key, text) and a cache (key, value) give all values and the rows to add to the cache.

    Equal texts are computed once; only misses are computed. A null value is a failure: it is given, not kept.
    """
    wanted = texts.select("key", "text").dropDuplicates(["key"])
    misses = wanted if cache is None else wanted.join(cache.select("key"), "key", "left_anti")
    new = compute(misses).select("key", "value")
    every = new if cache is None else cache.select("key", "value").unionByName(new)
    return texts.join(every, "key", "left"), new


def cache_key(text: Column, model: str = "") -> Column:
    return text_hash(F.concat(F.lit(f"{model}|"), text)) if model else text_hash(text)
