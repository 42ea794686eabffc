"""Word and batch helpers shared by the Arrow-side operators.

All of them work on one bounded slice of a partition at a time, so a worker's memory depends on
`SLICE_BYTES` and on its longest single text, not on the number of rows.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 6 << 20


#: What workers keep from one task to the next, by operator.
KEPT: dict[str, dict] = {}


def give_back() -> None:
    """Hands memory that is free back to the machine: a worker waits for its next task while others, and the JVM, need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of about max_bytes of `column` (one row at least).

    What the worker kept for other operators than `keep` is dropped first, and free memory given back at the end.
    """
    for name, kept in KEPT.items():
        if name != keep:
            kept.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.cumsum(size) // max_bytes
        starts = [0, *(np.flatnonzero(np.diff(cut)) + 1), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            yield batch.slice(a, b - a)
    give_back()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A text column with nulls read as empty, in buffers of its own: kernels do not all mind an offset."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2] or pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).tobytes()), data.slice(int(at[0]), int(at[-1] - at[0])))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the ASCII-white-space separated words, the offsets of each text's codes, the distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64), pa.array([], pa.large_string())
    coded = flat.dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    offsets = offsets - offsets[0]
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[codes]
    if not full.all():  # splitting leaves empty strings at the ends of a text
        before = np.concatenate(([0], np.cumsum(full)))
        codes, offsets = codes[full], before[offsets]
    return codes, offsets, words


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shift and multiply."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of MIX and of its inverse modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in POWERS:
        POWERS.clear()
        steps = [np.full(size, x, np.uint64) for x in (int(MIX), pow(int(MIX), -1, 1 << 64))]
        for x in steps:
            x[0] = 1
        POWERS[size] = (np.cumprod(steps[0], dtype=np.uint64), np.cumprod(steps[1], dtype=np.uint64))
    return POWERS[size]


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside one text, and the position of each run's first word.

    A run's hash is a polynomial in its words' hashes modulo 2**64, taken from running sums.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(len(hashes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * down[: len(hashes)], dtype=np.uint64)))
    rows = row_of(offsets)
    inside = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return mixed((sums[inside + size] - sums[inside]) * up[inside]), inside


def hashed(words: list[str] | np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept where all executors and a restarted one can read them."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())  # one process: nobody else needs to see it
    return df.checkpoint(eager=True)


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(id_column: Column, text_column: Column) -> Column:
    """A key of a row by its id and text; equal rows share it."""
    return F.xxhash64(id_column, text_column)


def with_row_key(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str, str]:
    """docs with the key and the integer id of each row, under names that are free, and these names."""
    key = spare(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs[id_column], docs[text_column]))
    own = spare(keyed, "row_id")
    return keyed.withColumn(own, keyed[id_column].cast("long")), key, own


def rows_with(docs: DataFrame, id_column: str, text_column: str, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose key and id are (left_semi) or are not (left_anti) among keys (key, doc_id).

    Id and hash together tell rows apart: a hash alone repeats among 10**11 rows.
    """
    keyed, key, own = with_row_key(docs, id_column, text_column)
    few = keys.select(F.col("key").alias(f"{key}2"), F.col("doc_id").alias(f"{own}2")).distinct().hint("shuffle_hash")
    same = (F.col(key) == F.col(f"{key}2")) & F.col(own).eqNullSafe(F.col(f"{own}2"))
    return keyed.join(few, same, how).drop(key, own)
