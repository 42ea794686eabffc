"""Writing: validation, contiguous sequences and de-duplication of batches given as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions.durable import durable
from seqlake.functions.model import MAX_BYTES, NEVER, PUT, TTL_BYTES, BatchTooLarge, EmptyKey, EntryTooLarge, InvalidRange, InvalidTTL, size_of


@dataclass
class Batch:
    """Operations that become visible together. Later ones win over earlier ones on the same key."""

    ops: list[tuple] = field(default_factory=list)

    def put(self, key: bytes, value: bytes, expires_at: int = NEVER) -> Batch:
        self.ops.append(("put", key, value, expires_at))
        return self

    def delete(self, key: bytes) -> Batch:
        self.ops.append(("delete", key, None, NEVER))
        return self

    def delete_range(self, start: bytes, end: bytes) -> Batch:
        self.ops.append(("range", start, end, NEVER))
        return self

    def reset(self) -> None:
        self.ops.clear()

    def __len__(self) -> int:
        return len(self.ops)

    def check(self) -> None:
        """The first error in order of operations rejects the whole batch."""
        total = 0
        for kind, key, value, expires_at in self.ops:
            if kind == "range":
                if not key or not value or key >= value:
                    raise InvalidRange(f"range {key!r} to {value!r}")
                total += len(key) + len(value)
                continue
            if not key:
                raise EmptyKey("a key must not be empty")
            if expires_at < 0:
                raise InvalidTTL(f"deadline {expires_at}")
            size = len(key) + len(value or b"") + TTL_BYTES * (expires_at != NEVER)
            if size > MAX_BYTES:
                raise EntryTooLarge(f"{size} bytes")
            total += size
        if total > MAX_BYTES:
            raise BatchTooLarge(f"{total} bytes")


def entry_error(kind: Column, key: Column, value: Column, expires_at: Column) -> Column:
    """What is wrong with one operation, null if nothing is."""
    size = size_of(key) + size_of(value) + F.when(expires_at != NEVER, TTL_BYTES).otherwise(0)
    return F.when(key.isNull() | (F.octet_length(key) == 0), "empty_key").when((kind == PUT) & (expires_at < 0), "invalid_ttl").when(size > MAX_BYTES, "entry_too_large")


def first_errors(ops: DataFrame) -> DataFrame:
    """batch and its first error by ord (null: the batch is valid), of (batch, ord, kind, key, value, expires_at)."""
    bad = entry_error(F.col("kind"), F.col("key"), F.col("value"), F.col("expires_at"))
    return ops.withColumn("error", bad).groupBy("batch").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("ord", "error"))).alias("first")).select("batch", F.col("first.error").alias("error"))


def with_sequences(ops: DataFrame, last_seq: int, order: list[str], partitions: int = 0) -> DataFrame:
    """Adds seq: last_seq + 1 and on, without gaps, in the given total order.

    One range shuffle, so no task sees all rows: rows are numbered within their sorted partitions, kept durably, counted by
    partition, and moved by the rows of the partitions before.
    """
    spread = ops.repartitionByRange(partitions or int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = durable(spread.withColumn("__id", F.monotonically_increasing_id()))  # the partition above 33 bits of place
    counts = {r["part"]: r["n"] for r in placed.groupBy(F.shiftright("__id", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    offset, total = {}, last_seq + 1
    for part in sorted(counts):
        offset[part], total = total, total + counts[part]
    if not offset:
        return ops.withColumn("seq", F.lit(None).cast("bigint"))
    base = F.create_map(*[F.lit(x) for pair in offset.items() for x in pair])
    return placed.withColumn("seq", (base[F.shiftright("__id", 33)] + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")).drop("__id")


def sequences_in_batches(ops: DataFrame) -> DataFrame:
    """Adds seq to (batch_seq, ord): batch_seq for the first operation of a batch, then one after another."""
    n = F.row_number().over(Window.partitionBy("batch_seq").orderBy("ord"))
    return ops.withColumn("seq", (F.col("batch_seq") + n - 1).cast("bigint"))


def changed_puts(puts: DataFrame) -> DataFrame:
    """puts of (seq, key, value, ...) that differ from the one before them on their key, nulls equal to each other."""
    w = Window.partitionBy("key").orderBy("seq")
    deadline = F.col("expires_at") if "expires_at" in puts.columns else F.lit(NEVER)
    kind = F.col("kind") if "kind" in puts.columns else F.lit(PUT)
    now = F.struct(kind.alias("k"), F.col("value").alias("v"), deadline.alias("e"))
    before = F.lag(now).over(w)
    return puts.withColumn("__same", (kind == PUT) & before.isNotNull() & before.eqNullSafe(now)).filter(~F.col("__same")).drop("__same")


def changed_against(ops: DataFrame, state: DataFrame, order: list[str]) -> DataFrame:
    """ops without puts that change nothing: each is held against the operation before it on its key, the first against state (key, value, expires_at)."""
    before = state.select("key", F.col("value").alias("__v"), F.col("expires_at").alias("__e"), F.lit(True).alias("__there"))
    met = ops.join(before, "key", "left")
    now = F.struct(F.col("kind").alias("k"), F.col("value").alias("v"), F.col("expires_at").alias("e"))
    first = F.when(F.col("__there"), F.struct(F.lit(PUT).alias("k"), F.col("__v").alias("v"), F.col("__e").alias("e")))
    w = Window.partitionBy("key").orderBy(*order)
    last = F.when(F.row_number().over(w) == 1, first).otherwise(F.lag(now).over(w))
    marked = met.withColumn("__same", (F.col("kind") == PUT) & F.coalesce(last.eqNullSafe(now), F.lit(False)))
    return marked.filter(~F.col("__same")).select(*ops.columns)


def new_puts(puts: DataFrame, state: DataFrame) -> DataFrame:
    """puts without those whose value and deadline are what state (key, value, expires_at) already holds."""
    s = state.select(F.col("key").alias("__k"), F.col("value").alias("__v"), F.col("expires_at").alias("__e"))
    same = (puts["key"] == s["__k"]) & puts["value"].eqNullSafe(s["__v"]) & (puts["expires_at"] == s["__e"])
    return puts.join(s, same, "left_anti")

