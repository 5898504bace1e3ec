"""Quality classifier on supervised subword embeddings.

Words, pairs of words and character n-grams are hashed into buckets; each bucket has a
learned vector, a document is the average of its features' vectors, and a softmax layer
turns it into class probabilities. Vectors and layer are trained together by stochastic
gradient descent in numpy, on at most ``SAMPLE_ROWS`` labelled rows, taken in the order
of a hash of their id. As a document's vector is an average, its logit is the average of
one number per bucket; the trained model is that table, a few MB whatever the corpus,
and every text is scored whole in one pass over the scan without a shuffle.

Null and empty texts have no features; their score comes from the bias alone. Labels
that are null are not used. Without labels of both classes the score is 0.5, which is
below the threshold. Repeated rows are scored each on its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .session import batch, lean, quoted

SAMPLE_ROWS = 4096
#: log2 of the number of buckets.
BITS = 18
GRAMS = (3, 4)
THRESHOLD = 0.7


def features(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets in order of text, and where each text's begin (one entry more than texts)."""
    starts, ends, first = T.spans(data, at, T.SPACES)
    words = T.word_hashes(data, starts, ends)
    shift = np.uint64(64 - BITS)
    out = [((words >> shift).astype(np.int32), first)]
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    if len(words) > 1:
        same = text[1:] == text[:-1]
        counts = np.bincount(text[1:][same], minlength=len(at) - 1)
        out.append(((T.run_hashes(words, 2)[same] >> shift).astype(np.int32), np.concatenate([[0], np.cumsum(counts)])))
    wide = data.astype(np.uint32)
    for n in GRAMS:
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, np.uint32)
        for j in range(n):
            code *= np.uint32(0x01000193)
            code ^= wide[j : len(data) - n + 1 + j]
        code *= np.uint32(0x9E3779B1)
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA77)
        inside = np.ones(len(code), bool)
        for j in range(1, n):
            cut = at[1:-1] - j
            inside[cut[(cut >= 0) & (cut < len(code))]] = False
        size = np.maximum(np.diff(at) - n + 1, 0)
        out.append(((code[inside] >> np.uint32(32 - BITS)).astype(np.int32), np.concatenate([[0], np.cumsum(size)])))
    return out


@dataclass
class Model:
    """Logit of the good class: bias plus the average weight of a text's features."""

    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(at) - 1), np.zeros(len(at) - 1, np.int64)
        for bucket, first in features(data, at):
            sums = np.concatenate([[0.0], np.cumsum(self.weight[bucket], dtype=np.float64)])
            total += sums[first[1:]] - sums[first[:-1]]
            n += np.diff(first)
        logit = self.bias + total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(texts: list[str], labels: np.ndarray, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 11, rows: int = 32) -> Model:
    """Fits bucket vectors and a two-class softmax layer; classes weigh the same in total, however rare one is."""
    labels = np.asarray(labels, np.int64)
    if len(np.unique(labels)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BITS, dim)) - 0.5) / dim).astype(np.float32)
    layer, bias = (rng.standard_normal((dim, 2)) / np.sqrt(dim)).astype(np.float32), np.zeros(2, np.float32)
    docs = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        found = [b for b, _ in features(data, np.array([0, len(data)]))] if len(data) else []
        docs.append(np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64)))
    class_weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    steps = epochs * -(-len(docs) // rows)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), rows):
            chosen = order[lo : lo + rows]
            bucket = np.concatenate([docs[i][0] for i in chosen])
            share = np.concatenate([docs[i][1] / max(1, docs[i][1].sum()) for i in chosen]).astype(np.float32)
            size = np.array([len(docs[i][0]) for i in chosen])
            row = np.repeat(np.arange(len(chosen)), size)
            mean = np.stack([np.bincount(row, share * vectors[bucket, d], len(chosen)) for d in range(dim)], 1).astype(np.float32)
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - np.eye(2, dtype=np.float32)[labels[chosen]]) * class_weight[labels[chosen]][:, None].astype(np.float32) / len(chosen)
            back = (error @ layer.T).astype(np.float32)
            now = rate * (1 - step / steps)
            layer -= now * (mean.T @ error)
            bias -= now * error.sum(0)
            used, where = np.unique(bucket, return_inverse=True)
            # a step in a text's vectors moves its average by the step, however many features share it
            step_size = now * len(chosen) / np.maximum(np.bincount(row, share * share, len(chosen)), 1e-6)
            scaled = share * step_size.astype(np.float32)[row]
            for d in range(dim):
                vectors[used, d] -= np.bincount(where, scaled * back[row, d], len(used)).astype(np.float32)
            step += 1
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on at most ``sample_rows`` labelled rows that are not held out."""
    usable = labels.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    chosen = usable.orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows)
    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    # of rows that share their id, the same ones are taken whatever the order of tasks
    taken = texts.orderBy(F.xxhash64("id"), "id", "label", "text").limit(sample_rows)
    rows = sorted(taken.select("id", "text", "label").collect(), key=lambda r: (r[0], r.label, r.text))
    return train([r.text for r in rows], np.array([r.label for r in rows], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([(id_col, b.schema.field(0).type), ("score", pa.float64()), ("predicted", pa.int32())])
            for lo, hi, data, at in T.blocks(b.column(1)):
                s = shared.value.scores(data, at)
                yield batch(schema, b.column(0).slice(lo, hi - lo), s, (s >= threshold).astype(np.int32))

    return docs.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text")).mapInArrow(lean(run), f"{quoted(id_col)} {id_type}, score double, predicted int")
