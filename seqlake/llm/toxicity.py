"""Toxicity scores by logistic regression over hashed word n-grams, learned with FTRL-proximal.

Features are single words, pairs of neighbours and pairs with one word between them, hashed into
2**BITS places. FTRL-proximal gives every coordinate its own rate, and its L1 term leaves most
weights exactly zero, so what is broadcast is the few that are not: at most 2**BITS pairs.

Training takes about `max_rows` labelled rows a class at most, those with the least hashed ids, and `MAX_BYTES` of
features; scoring covers all rows and is a map without a shuffle. Toxic texts are few, so the plain model's half is
set too high for them: the bias is moved to where the F1 measure is best on training rows, each scored by a model
that has not seen its fold. Held-out rows have no part in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import MIX, durable, hashed, mixed, row_of, slices, split_words, texts_of

BITS = 20
MAX_ROWS, MAX_BYTES = 6000, 256 << 20
EPOCHS = 10
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 1.0
MARKS = ".,;:!?\"'()[]{}<>|*#$%&@~^_=+/\\-`"


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and place of every feature: words, neighbours, and words with one between."""
    codes, offsets, words = split_words(pc.utf8_lower(texts))
    h = mixed(hashed(pc.utf8_trim(words, MARKS).to_pylist()))[codes] if len(codes) else np.zeros(0, np.uint64)
    rows = row_of(offsets)
    parts, owners = [h], [rows]
    for gap in (1, 2):
        if len(h) > gap:
            inside = rows[gap:] == rows[:-gap]
            parts.append(mixed(h[:-gap][inside] * MIX + h[gap:][inside] + np.uint64(gap)))
            owners.append(rows[:-gap][inside])
    return np.concatenate(owners), (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal for binary features and the logistic loss; place 2**bits is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w, n = self.weights(at), self.n[at]
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(rows: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and weights that are not zero, and the bias, from (label, places of its features)."""
    model, order = Ftrl(bits), np.random.RandomState(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.learn(rows[i][1], rows[i][0])
    every = model.weights(np.arange(len(model.z)))
    at = np.flatnonzero(every[:-1])
    return at, every[at], float(every[-1])


def calibrated(rows: list[tuple[int, np.ndarray]], folds: np.ndarray) -> float:
    """What to add to the bias so that the F1 measure of rows, each scored by a model of the other folds, is best at a score of one half."""
    labels, sums = np.array([y for y, _ in rows]), np.full(len(rows), np.nan)
    for k in np.unique(folds):
        others = [r for r, f in zip(rows, folds, strict=True) if f != k]
        if len({y for y, _ in others}) < 2:
            return 0.0
        at, weights, bias = train(others)
        table = np.zeros(1 << BITS)
        table[at] = weights
        for i in np.flatnonzero(folds == k):
            sums[i] = bias + table[rows[i][1]].sum()
    order = np.argsort(-sums, kind="stable")
    hits, taken = np.cumsum(labels[order]), np.arange(1, len(order) + 1)
    last = np.append(sums[order][1:] != sums[order][:-1], True)  # equal sums fall to one side
    f1 = np.where(last, 2 * hits / (taken + labels.sum()), 0.0)
    k = int(np.argmax(f1))
    below = sums[order[k + 1]] if k + 1 < len(order) else sums[order[k]] - 1
    return float(-(sums[order[k]] + below) / 2)


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, max_rows: int, max_bytes: int = MAX_BYTES) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Features of at most about max_rows labelled rows of each class, outside the held-out fold, and their folds."""
    ids = F.col(id_column).cast("long")
    known = labels.select(ids.alias("id"), F.col(label_column).cast("int").alias("label")).dropna().filter(fold(F.col("id")) != 0)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).filter("label in (0, 1)").collect()}
    if not sizes:
        return [], np.zeros(0, int)
    # an even share of the hash range holds about as many rows; the limit makes the bound hard
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    taken = None
    for label, n in sizes.items():
        part = known.filter((F.col("label") == label) & (share < min(1.0, max_rows / n) * (1 << 30))).limit(2 * max_rows)
        taken = part if taken is None else taken.union(part)
    plain = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, at = features(texts_of(batch))
            order = np.argsort(rows, kind="stable")
            cut = np.searchsorted(rows[order], np.arange(batch.num_rows + 1))
            data = [np.unique(at[order[a:b]]).astype("<i4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(data, pa.binary())], names=["id", "label", "at"])

    found = plain.join(F.broadcast(taken), "id").select("id", "label", "text").mapInArrow(run, "id long, label int, at binary")
    found = durable(found.groupBy("id").agg(F.min("label").alias("label"), F.min("at").alias("at")))  # of rows with one id the same one in every run
    total = found.agg(F.sum(F.octet_length("at").cast("long")).alias("b")).first()["b"] or 0
    if total > max_bytes:
        found = found.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < max_bytes / total * (1 << 30))
    rows = sorted(found.collect(), key=lambda r: r["id"])
    return [(r["label"], np.frombuffer(r["at"], "<i4").astype(np.int64)) for r in rows], np.array([zlib.crc32(str(r["id"]).encode()) % 5 for r in rows], int)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score in (0, 1) and predicted (score >= 0.5) for every row.

    Learns from labelled rows outside the held-out fold only. Null texts score like empty ones, by
    the bias. Labels other than 0 and 1, null labels and labels without a document are not used; of
    several labels for an id the larger holds; without any usable label all scores are 0.5. Null ids
    count as not held out. Repeated rows score alike; of several texts of one id that of the least features is learned from. Texts
    of any length are scored whole. An empty table gives no rows; other columns are ignored.
    """
    rows, folds = training_rows(docs, labels, id_column, text_column, label_column, max_rows)
    at, weights, bias = train(rows)
    bias += calibrated(rows, folds) if rows else 0.0
    spread = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights.astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights, bias = spread.value
        table = np.zeros(1 << BITS, np.float32)
        table[at] = weights
        for batch in slices(batches, "text"):
            rows, at = features(texts_of(batch))
            w = table[at]
            some = np.flatnonzero(w)  # each feature counts once in a text, as in training
            once = np.unique(rows[some] * (1 << BITS) + at[some])
            sums = bias + np.bincount(once >> BITS, table[once & ((1 << BITS) - 1)], batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    plain = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    scored = plain.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
