"""Follow-the-regularised-leader logistic regression over sparse hashed features, and bounded labelled samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import claim, crc_fold


class Ftrl:
    """Per-coordinate FTRL-proximal; the bias is a coordinate of its own without L1.

    Examples are (indices, values) with distinct indices; a target may be any number from 0 to 1.
    """

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = self.prior = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return self.prior - self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def step(self, at: np.ndarray, x: np.ndarray, target: float) -> float:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(self.bias + float(w @ x), -35, 35)))
        g = (p - target) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        b, gb = self.bias, p - target
        self.bias_z += gb - ((self.bias_n + gb * gb) ** 0.5 - self.bias_n**0.5) / self.alpha * (b - self.prior)
        self.bias_n += gb * gb
        return p

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, epochs: int, seed: int = 7) -> Ftrl:
        rng = np.random.default_rng(seed)
        if len(targets):
            share = (float(np.sum(targets)) + 0.5) / (len(targets) + 1)
            self.prior = float(np.log(share / (1 - share)))  # a text without features scores what is usual
        for _ in range(epochs):
            for i in rng.permutation(len(examples)):
                self.step(*examples[i], float(targets[i]))
        return self


#: Bytes of a text that a model learns from, at most; longer ones are scored, not learnt from.
LONGEST_SAMPLE = 1 << 16


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts with a label, outside the held-out fold: rows (id, text, label), at most `most` ids, one row each.

    The ids with the smallest hashes are taken, so the sample is even and the same on every run. Null labels and
    labels without an id don't count; an id with several labels has their mean, rounded up, one with several texts
    gives the one with the smallest hash. Texts over LONGEST_SAMPLE bytes are left out, so `most` times that bounds the
    sample. Only `most` ids are broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(_in_training(id_col, folds, held_out))
    known = known.groupBy(id_col).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    taken = known.orderBy(F.xxhash64(id_col), id_col).limit(most).select(F.col(id_col).alias("sample_id"), "label")
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).where(F.octet_length("body") <= LONGEST_SAMPLE)
    found = texts.join(F.broadcast(taken), texts["doc"] == taken["sample_id"])
    once = found.groupBy("doc").agg(F.min_by("body", F.xxhash64("body")).alias("text"), F.first("label").alias("label"))
    return once.select(F.col("doc").alias("id"), "text", "label")


def _in_training(id_col: str, folds: int, held_out: int) -> Column:
    return crc_fold(id_col, folds) != held_out


def fitted(sample: DataFrame, fit, schema: str) -> list:
    """Runs fit(pandas frame) in one task over a sample of bounded size and returns its few rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        claim("fit")
        return fit(pdf.sort_values("id", kind="stable").reset_index(drop=True))

    return sample.groupBy(F.lit(1).alias("all")).applyInPandas(run, schema).collect()


def kept_rows(docs: DataFrame, scorer, keep, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that scorer() finds keep(score), whole, in one pass: rows are filtered where they are scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("")
        score = scorer()
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(keep(score(b.column(b.schema.get_field_index(text_col))))))

    return docs.mapInArrow(run, docs.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
