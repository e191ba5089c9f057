"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its words, punctuation runs and their bigrams (a word that repeats the one before it counts
as one fixed word, so that repetition shows whatever is repeated), hashed into ``2**bits`` slots, as counts scaled to
length one. Training takes at most ``max_rows`` labelled rows, those with the least hash of their id; it streams them
through one task, pass by pass, so that the task holds the weights alone. Scores are sparse dot products.

Defined results: null and empty texts have no features and get the score of the intercept; rows keep one result each;
labels that are null or not 0 or 1, labels of an id that disagree, and labels without a document, teach nothing; all rows
of a labelled id teach; without any labelled rows every score is 0.5; ids that are null are held in (remainder of nothing), other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import LOWER, as_bytes, cut, pieces

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x20\x7f0-9a-z\x80-\xff]+")


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts in turn: slots, values, and where each text's features start (and the last ones end)."""
    words = [TOKEN.findall(t.translate(LOWER)) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((crc32(w) for ws in words for w in ws), np.uint32, int(sizes.sum())).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    h[same] = 1
    pair = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    grams = np.concatenate([h, h[pair - 1] * np.uint64(0x100000001B3) ^ h[pair]]) * np.uint64(0x9E3779B97F4A7C15)
    slot = (grams >> np.uint64(64 - bits)).astype(np.int64)
    keys, counts = np.unique(np.concatenate([doc, doc[pair]]) << bits | slot, return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(texts) + 1) << bits)
    values = counts.astype(np.float64)
    norm = np.sqrt(np.add.reduceat(np.append(values**2, 0.0), np.minimum(starts[:-1], len(values)))) if len(texts) else np.zeros(0)
    return (keys & ((1 << bits) - 1)).astype(np.int32), values / np.repeat(norm, np.diff(starts)), starts


@dataclass
class Ftrl:
    """The leader's sums for each slot (the last one is the intercept), and the weights that they give."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5

    @classmethod
    def empty(cls, bits: int) -> Ftrl:
        return cls(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        at, x = np.append(slots, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


@dataclass
class Classifier:
    weights: np.ndarray
    bits: int

    def score(self, texts: list[bytes]) -> np.ndarray:
        slots, values, starts = features(texts, self.bits)
        # summed text by text, so that equal texts get equal scores wherever they stand
        sums = np.add.reduceat(np.append(self.weights[slots] * values, 0.0), starts[:-1]) if len(texts) else np.zeros(0)
        return 1 / (1 + np.exp(-(np.where(starts[1:] > starts[:-1], sums, 0.0) + self.weights[-1])))


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, bits: int = 18, max_rows: int = 8000, passes: int = 4) -> Classifier:
    """Learns from ``labels`` (``doc_id, quality``), at most ``max_rows`` of them; who may teach is for the caller to filter."""
    taught = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_label")).where("_id IS NOT NULL")
    taught = taught.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).where("_label = _other").drop("_other")
    taught = taught.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(taught), F.col("doc_id") == F.col("_id"))  # max_rows bounds what is broadcast

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            slots, values, starts = features(as_bytes(piece.column("text")), bits)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("_label"), lists(slots), lists(values.astype(np.float32))], ["id", "label", "slots", "vals"])

    rows = cut(rows.select("_id", "_label", "text").mapInArrow(extract, "id long, label int, slots array<int>, vals array<float>"))
    state = Ftrl.empty(bits)
    for turn in range(passes):
        order = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.col("id") + turn), "id", F.xxhash64("slots", "vals"))  # max_rows bounds it; the task streams it
        z, n = state.z, state.n

        def train(batches: Iterator[pa.RecordBatch], z: np.ndarray = z, n: np.ndarray = n) -> Iterator[pa.RecordBatch]:
            own = Ftrl(z.copy(), n.copy())
            for batch in batches:
                slots, vals = batch.column("slots"), batch.column("vals")
                at = slots.offsets.to_numpy()
                s, v = slots.values.to_numpy(), vals.values.to_numpy().astype(np.float64)
                for k, label in enumerate(batch.column("label").to_pylist()):
                    own.learn(s[at[k] : at[k + 1]], v[at[k] : at[k + 1]], label)
            yield pa.RecordBatch.from_arrays([pa.array([own.z.tobytes()], pa.binary()), pa.array([own.n.tobytes()], pa.binary())], ["z", "n"])

        for got in order.mapInArrow(train, "z binary, n binary").collect():
            state = Ftrl(np.frombuffer(got.z), np.frombuffer(got.n))
    return Classifier(state.weights(), bits)


def _scored(docs: DataFrame, model: Classifier, threshold: float, keep: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            p = shared.value.score(as_bytes(piece.column("text")))
            if keep:
                yield piece.filter(pa.array(p >= threshold))
            else:
                yield pa.RecordBatch.from_arrays([*piece.select(["doc_id", "held_out"]).columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(score, docs.schema if keep else "doc_id long, held_out boolean, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options: int) -> DataFrame:
    """Scores of all documents by a model that learns from labels whose crc32(doc_id) mod 4 is not 2."""
    model = fit(docs, labels.where(remainder(F.col("doc_id"), 4) != 2), **options)
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return _scored(docs.select(F.col("doc_id").cast("long"), "text", held), model, threshold, keep=False)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options: int) -> DataFrame:
    """The documents, all columns, that score at least ``threshold``."""
    model = fit(docs, labels.where(remainder(F.col("doc_id"), 4) != 2), **options)
    return _scored(docs, model, threshold, keep=True)
