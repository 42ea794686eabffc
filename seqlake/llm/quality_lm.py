"""Quality by the perplexity of an n-gram model of trusted text.

The model is an interpolated modified Kneser-Ney model over the bytes of UTF-8 text, of order
`ORDER`; a byte n-gram is an integer, so its context and its shorter form are shifts and masks.
Counts come from all trusted documents: tasks count their own n-grams, a shuffle by n-gram adds them
up, and joins between the count tables of neighbouring orders, sharded by n-gram, give continuation
counts, discounts, back-off weights and interpolated probabilities. A document's perplexity is held
against quantiles of that of trusted held-out documents of its language: the limit lies above the median of the
logarithms by a multiple of the way to their `HIGH` quantile, so one odd trusted text does not move it. Which
multiple follows from held-out rows labelled good and bad.

The tables go to the scoring tasks as a broadcast while they have at most `BROADCAST_ROWS` rows.
Beyond that, documents' n-grams are joined with the sharded tables instead.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import durable, mixed, row_key, rows_with, slices, texts_of

ORDER = 5
HIGH = 0.9  # five held-out texts at least lie above it
MULTIPLES, LEAST_SPREAD, LEAST_BAD = [1 + 0.25 * k for k in range(77)], 0.01, 20
USUAL_MULTIPLE = 4.0  # without labelled bad rows
BROADCAST_ROWS = 6_000_000
BROADCAST_IDS = 2_000_000
BROADCAST_LANGUAGES, SALTS = 100_000, 32
LEAST_LABELS = 50
SLICE = 1 << 20  # bytes of text at a time; some forty bytes of arrays go with each
PAD = 0  # stands before the first byte of a text


def grams(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text, and each text's number of bytes."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    size = np.diff(bounds)
    first = (bounds - bounds[0])[:-1][size > 0]
    out = data.astype(np.int64)
    for k in range(1, min(order, len(data) + 1)):
        back = np.zeros(len(data), np.int64)
        back[k:] = data[: len(data) - k]
        for j in range(k):  # no byte of an earlier text
            back[np.minimum(first + j, len(data) - 1)[first + j < len(data)]] = PAD
        out |= back << (8 * k)
    return out, size


def count_grams(trusted: DataFrame) -> DataFrame:
    """gram and n over the texts of trusted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found, n = np.unique(grams(texts_of(batch))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"])

    return trusted.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """What is taken from counts of 1, 2 and at least 3."""
    n = [0, 0, 0, 0, 0]
    for r in counts.filter("n <= 4").groupBy("n").count().collect():
        n[r["n"]] = r["count"]
    if not n[1] or not n[2]:
        return [0.5, 0.75, 0.9]  # too little text to estimate from
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] else 0.75 for k in (1, 2, 3)]


def train(trusted: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """For each order from 1: (gram, p) with interpolated p, and (context, rest), the weight left to the lower order."""
    counts = [durable(count_grams(trusted))]
    for order in range(ORDER - 1, 0, -1):  # continuation counts: different bytes before it
        counts.insert(0, durable(counts[0].groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")).agg(F.count("*").alias("n"))))
    tables, rests = [], []
    for order, table in enumerate(counts, 1):
        d1, d2, d3 = discounts(table)
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = table.select("gram", F.shiftright("gram", 8).alias("context"), "n", cut.alias("cut"))
        sums = own.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("rest"))
        shares = own.join(sums, "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("share"), "rest")
        if order == 1:
            p = shares.select("gram", (F.col("share") + F.col("rest") / 256).alias("p"))
        else:
            lower = tables[-1].select(F.col("gram").alias("short"), F.col("p").alias("lower"))
            short = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
            p = shares.withColumn("short", short).join(lower, "short").select("gram", (F.col("share") + F.col("rest") * F.col("lower")).alias("p"))
        tables.append(durable(p))
        rests.append(durable(sums.select("context", "rest")))
    return tables, rests


class Lookup:
    """Values of integer keys: sorted by hash, with the first place of each hash prefix."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(1, (2 * len(keys)).bit_length())
        at = self._bucket(keys)
        order = np.argsort(at, kind="stable")
        self.keys, self.values = keys[order], values[order].astype(np.float64)
        self.first = np.searchsorted(at[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max(initial=0))

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values; NaN where a key is unknown."""
        out = np.full(len(keys), np.nan)
        if not len(self.keys):
            return out
        at = self._bucket(keys)
        place, end = self.first[at], self.first[at + 1]
        left = np.flatnonzero(place < end)
        for k in range(self.deepest):
            spot = place[left] + k
            hit = self.keys[spot] == keys[left]
            out[left[hit]] = self.values[spot[hit]]
            left = left[~hit & (spot + 1 < end[left])]
            if not len(left):
                break
        return out


def log_probabilities(found: np.ndarray, tables: list[Lookup], rests: list[Lookup]) -> np.ndarray:
    """Natural logarithms for n-grams of full order, backing off while they are unknown."""
    out, left, weight = np.zeros(len(found)), np.arange(len(found)), np.zeros(len(found))
    for order in range(ORDER, 0, -1):
        short = found[left] & ((1 << 8 * order) - 1)
        p = tables[order - 1](short)
        known = ~np.isnan(p)
        out[left[known]] = weight[left[known]] + np.log(p[known])
        left, short = left[~known], short[~known]
        if not len(left):
            break
        rest = rests[order - 1](short >> 8)
        weight[left] += np.where(np.isnan(rest), 0.0, np.log(rest))
    out[left] = weight[left] - math.log(256)
    return out


def score_broadcast(rows: DataFrame, tables: list[DataFrame], rests: list[DataFrame]) -> DataFrame:
    """Adds log_p and n_bytes to rows (key, doc_id, language, text), without the text."""
    def pair(df: DataFrame) -> tuple:
        data = df.toArrow()
        return data.column(0).to_numpy(), data.column(1).to_numpy()

    spread = rows.sparkSession.sparkContext.broadcast(([pair(t) for t in tables], [pair(r) for r in rests]))
    ready: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ready:
            ready.extend([Lookup(*x) for x in part] for part in spread.value)
        for batch in slices(batches, "text", SLICE):
            found, size = grams(texts_of(batch))
            sums = np.concatenate(([0.0], np.cumsum(log_probabilities(found, *ready))))
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "language")), pa.array(sums[ends] - sums[ends - size]), pa.array(size, pa.int64())], names=["key", "doc_id", "language", "log_p", "n_bytes"])

    return rows.mapInArrow(run, "key long, doc_id long, language string, log_p double, n_bytes long")


def score_joined(rows: DataFrame, tables: list[DataFrame], rests: list[DataFrame]) -> DataFrame:
    """The same by joins of the rows' n-grams with the sharded tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found, size = grams(texts_of(batch))
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((found, owner))
            owner, found = owner[order], found[order]
            new = np.ones(len(found), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner[at])), pa.array(found[at]), pa.array(np.diff(at, append=len(found)), pa.int64())], names=["key", "gram", "n"])

    left = rows.dropDuplicates(["key"]).mapInArrow(run, "key long, gram long, n long").withColumn("weight", F.lit(0.0))
    parts = []
    for order in range(ORDER, 0, -1):
        short = left.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)))
        met = durable(short.join(tables[order - 1].withColumnRenamed("gram", "short"), "short", "left"))
        parts.append(met.filter("p is not null").select("key", (F.col("n") * (F.col("weight") + F.log("p"))).alias("log_p")))
        rest = rests[order - 1].withColumnRenamed("context", "before")
        unmet = met.filter("p is null").withColumn("before", F.shiftright("short", 8)).join(rest, "before", "left")
        left = unmet.select("key", "gram", "n", (F.col("weight") + F.coalesce(F.log("rest"), F.lit(0.0))).alias("weight"))
    parts.append(left.select("key", (F.col("n") * (F.col("weight") - math.log(256))).alias("log_p")))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    sums = every.groupBy("key").agg(F.sum("log_p").alias("log_p"))
    return rows.join(sums, "key", "left").select("key", "doc_id", "language", F.coalesce("log_p", F.lit(0.0)).alias("log_p"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


def held_out(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def thresholds(sample: DataFrame) -> tuple[DataFrame, float | None]:
    """Limits (language, threshold) of the languages with 50 good held-out rows, and the limit of all others, null without any good row.

    sample: held-out rows (language, label, x, the logarithm of the perplexity). With 20 rows labelled 0, the largest
    multiple of those with which the share of bad rows kept and the share of good ones rejected, added up, are
    smallest holds for all languages; with fewer the usual one.
    """
    fine = sample.filter("label = 1")
    at = lambda q: F.percentile_approx("x", q, 100_000)
    figures = [F.count("*").alias("n"), at(0.5).alias("mid"), F.greatest(at(HIGH) - at(0.5), F.lit(LEAST_SPREAD)).alias("spread")]
    every = fine.agg(*figures).first()
    own = durable(fine.groupBy("language").agg(*figures).filter(F.col("n") >= LEAST_LABELS))
    if not every["n"]:
        return own.select("language", F.lit(0.0).alias("threshold")), None
    met = sample.join(own, "language", "left")
    z = (F.col("x") - F.coalesce("mid", F.lit(every["mid"]))) / F.coalesce("spread", F.lit(every["spread"]))
    step = F.greatest(F.ceil((z - MULTIPLES[0]) / (MULTIPLES[1] - MULTIPLES[0])), F.lit(0))  # the first multiple that keeps a row
    counts = {(r["label"], r["step"]): r["n"] for r in met.filter("label in (0, 1)").groupBy("label", F.least(step, F.lit(len(MULTIPLES))).alias("step")).agg(F.count("*").alias("n")).collect()}  # a row for each multiple and label
    n_bad = sum(n for (label, _), n in counts.items() if label == 0)
    chosen = USUAL_MULTIPLE
    if n_bad >= LEAST_BAD:
        upto = lambda label, i: sum(counts.get((label, k), 0) for k in range(i + 1))
        errors = [1 - upto(1, i) / every["n"] + upto(0, i) / n_bad for i in range(len(MULTIPLES))]
        least = min(errors) + 1e-12
        chosen = max(k for k, e in zip(MULTIPLES, errors, strict=True) if e <= least)
    return own.select("language", F.exp(F.col("mid") + chosen * F.col("spread")).alias("threshold")), math.exp(every["mid"] + chosen * every["spread"])


def judge_perplexity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang", label_column: str = "quality", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: key, doc_id, language, n_bytes, perplexity (per byte), threshold, kept.

    Trusted text is that of rows labelled 1; a fifth of them, by crc32 of the id, is held out of the
    model and gives the thresholds of `thresholds`, of a language or of all if it has fewer than 50 held-out
    rows. Rows labelled 0 help to choose them, if held out too. Texts without bytes
    (null too) have no perplexity and go; without any trusted text, all others stay; one that equals its threshold stays. Texts of any
    length are scored whole. A null language reads ''.
    Null labels are not used; of several labels for one id the least holds. Repeated rows are
    judged alike. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(row_key(docs[id_column], docs[text_column]).alias("key"), docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[language_column].cast("string"), F.lit("")).alias("language"), docs[text_column].cast("string").alias("text"))
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    good = known.filter("label = 1").select("doc_id")
    small = good.count() <= BROADCAST_IDS
    trusted = rows.join(F.broadcast(good) if small else good.hint("shuffle_hash"), "doc_id").filter(~held_out(F.col("doc_id")))
    tables, rests = train(trusted)
    size = sum(t.count() for t in [*tables, *rests])
    scored = (score_broadcast if size <= broadcast_rows else score_joined)(rows, tables, rests)
    scored = durable(scored.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes")))))
    sample = durable(scored.filter(held_out(F.col("doc_id")) & F.col("perplexity").isNotNull()).join(known, "doc_id").select("language", "label", F.log("perplexity").alias("x")))
    limits, others = thresholds(sample)
    if limits.count() <= BROADCAST_LANGUAGES:
        judged = scored.join(F.broadcast(limits), "language", "left")
    else:  # one language may hold a large part of the rows
        salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        judged = scored.withColumn("salt", F.pmod(F.col("key"), F.lit(SALTS)).cast("int")).join(salted, ["language", "salt"], "left")
    judged = judged.withColumn("threshold", F.coalesce("threshold", F.lit(others).cast("double")))
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return judged.select("key", "doc_id", "language", "n_bytes", "perplexity", "threshold", kept.alias("kept"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that the model keeps."""
    judged = judge_perplexity(docs, labels, id_column, text_column)
    return rows_with(docs, id_column, text_column, judged.filter(~F.col("kept")), "left_anti")
