"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Words here are runs of letters, of digits or of other signs; the features are hashed unigrams and bigrams of
words and n-grams of word shapes (case, digits, signs, a word said again). A text's features are their
shares of the text, so the score is a sparse dot product that is a mean of weights over the tokens.

Cases: null and empty texts have no features and score what the bias alone gives; without any labelled row
every score is 0.5. A row without an id is never held out, and its labels don't count. Repeated rows are scored one
by one. Labels that are null don't count. Other columns are not looked at and not returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import combine, fold_of, map_batches, mix, slices, span_hashes, text_buffer
from weftline.llm.linear import Ftrl, fitted, kept_rows, labelled_sample, sigmoid

BUCKETS = 1 << 18
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 6000
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
EPOCHS, ALPHA, L1, L2 = 3, 1.0, 0.02, 0.002
#: Shares of a text are multiplied by this, so that the usual learning rates fit.
SCALE = 30.0

_KIND = np.full(256, 3, np.uint8)  # signs
_KIND[[0x20, 9, 10, 11, 12, 13]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds of the runs of one kind of byte, and how many each document has."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint8), np.zeros(len(offs) - 1, np.int64)
    kind = _KIND[data]
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    inner = offs[1:-1]
    new[inner[inner < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    keep = kind[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, kind[starts], np.diff(np.searchsorted(starts, offs))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, text after text, and how many each has; repeats included."""
    starts, ends, kind, counts = tokens(data, offs)
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    word = span_hashes(data, starts, ends)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    ups, length = upper[ends] - upper[starts], ends - starts
    shape = np.where(kind == 3, 6 + np.minimum(length, 4), np.where(kind == 2, 5, np.where(ups == 0, 1, np.where(ups == length, np.where(length > 1, 4, 2), np.where(ups == 1, 2, 3)))))
    first = np.zeros(n, bool)  # of a text: nothing stands before it
    at = np.concatenate([[0], np.cumsum(counts)])
    first[at[:-1][counts > 0]] = True
    before = np.roll(word, 1)
    before[first] = 1
    shape_before = np.roll(shape, 1)
    shape_before[first] = 0
    second = np.roll(first, 1) | first
    shape_2 = np.roll(shape_before, 1)
    shape_2[second] = 0
    again = (word == before) & ~first
    shapes = ((shape + 16 * shape_before + 256 * shape_2) * 2 + again).astype(np.uint64)
    out = np.empty((n, 4), np.int64)
    mask = np.uint64(BUCKETS - 1)
    out[:, 0] = word & mask
    out[:, 1] = combine(word, before) & mask
    out[:, 2] = mix(shapes + np.uint64(1 << 32)) & mask
    out[:, 3] = mix((shape * 2 + again).astype(np.uint64) + np.uint64(1 << 33)) & mask
    return out.reshape(-1), counts * 4


def fit_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: the weights as float32 bytes and the bias."""
    data, offs = text_buffer(pa.array(pdf["text"], pa.string()))
    examples = []
    for i, j in slices(offs):
        f, counts = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        at = np.concatenate([[0], np.cumsum(counts)])
        for a, b in zip(at[:-1], at[1:], strict=True):
            idx, c = np.unique(f[a:b], return_counts=True)
            examples.append((idx, c * (SCALE / max(b - a, 1))))
    model = Ftrl(BUCKETS, ALPHA, 1.0, L1, L2).fit(examples, pdf["label"].to_numpy(float), EPOCHS)
    return pd.DataFrame({"weights": [model.weights().astype("<f4").tobytes()], "bias": [model.bias]})


def score_batch(column: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    data, offs = text_buffer(column)
    out = np.full(len(offs) - 1, bias)
    for i, j in slices(offs):
        f, counts = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        if len(f):
            full = np.flatnonzero(counts)
            at = np.cumsum(counts) - counts
            out[i + full] += np.add.reduceat(weights[f], at[full], dtype=np.float64) * SCALE / counts[full]
    return sigmoid(out)


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int):
    """The fitted model as a broadcast of 1 MB, whatever the input."""
    got = fitted(labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, sample, id_col, text_col), fit_rows, "weights binary, bias double")
    weights = np.frombuffer(got[0]["weights"], "<f4") if got else np.zeros(BUCKETS, np.float32)
    return docs.sparkSession.sparkContext.broadcast((weights, got[0]["bias"] if got else 0.0))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Rows (id, held_out, score, predicted), one for each row of docs."""
    model = _model(docs, labels, id_col, text_col, sample)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        score = score_batch(b.column(1), *model.value)
        held = fold_of(b.column(0).to_pylist(), FOLDS) == HELD_OUT
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return map_batches(docs.select(id_col, text_col), run, f"{id_col} {kind}, held_out boolean, score double, predicted int")


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, whole, that are predicted to be of quality."""
    model = _model(docs, labels, id_col, text_col, sample)
    return kept_rows(docs, lambda: lambda column: score_batch(column, *model.value), lambda score: score >= THRESHOLD, id_col, text_col)
