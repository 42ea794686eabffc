"""What a reader sees: of each key the newest version, unless it is deleted, expired or range-deleted.

Only predicates on the key and on the sequence may come before the choice of the newest version;
everything else is decided by that version alone and is filtered after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.functions.model import DELETE, MAX_SEQ, PUT, in_bounds, live_at
from seqlake.operators.ranges import with_cover


def newest(log: DataFrame, seq: int = MAX_SEQ, start=None, end=None) -> DataFrame:
    """The deciding version of each key at a sequence: one row per key. Partially aggregated before its shuffle."""
    seen = log.filter((F.col("seq") <= seq) & in_bounds(F.col("key"), start, end))
    rest = [c for c in ("kind", "value", "expires_at") if c in log.columns]
    best = seen.groupBy("key").agg(F.max(F.struct("seq", *rest)).alias("v"))
    return best.select("key", *(F.col(f"v.{c}").alias(c) for c in ("seq", *rest)))


def classified(log: DataFrame, ranges: DataFrame, seq: int, now: int) -> DataFrame:
    """Each key with its state at (seq, now): live, deleted, expired, range_deleted or not_yet."""
    first = log.groupBy("key").agg(F.min("seq").alias("first_seq"))
    decided = with_cover(newest(log, seq), ranges, seq)
    state = F.when(F.col("seq").isNull(), "not_yet").when(F.col("kind") == DELETE, "deleted").when(F.col("cover") > F.col("seq"), "range_deleted").when(~live_at(F.col("expires_at"), now), "expired").otherwise("live")
    return first.join(decided, "key", "left").select("key", state.alias("state"))


def visible(log: DataFrame, ranges: DataFrame | None, seq: int, now: int, start=None, end=None) -> DataFrame:
    """key, value, expires_at and seq of the live entries at (seq, now) inside [start, end)."""
    decided = newest(log, seq, start, end).filter((F.col("kind") == PUT) & live_at(F.col("expires_at"), now))
    if ranges is not None:
        near = F.lit(True)
        if start is not None:
            near = near & (F.col("end_key") > F.lit(start))
        if end is not None:
            near = near & (F.col("start_key") < F.lit(end))
        decided = with_cover(decided, ranges.filter(near), seq).filter(F.col("cover") <= F.col("seq"))
    return decided.select("key", "value", "expires_at", "seq")


def get_many(log: DataFrame, ranges: DataFrame | None, keys: DataFrame, seq: int, now: int, broadcast_keys: int | None = None) -> DataFrame:
    """The visible entries of the requested keys; empty, null and repeated requests are ignored, absent keys left out.

    The keys are broadcast where Spark knows them to be small, or where a number is given and they are counted and
    found to be no more; else both sides are shuffled.
    """
    wanted = requested(keys)
    if broadcast_keys is not None:
        wanted = F.broadcast(wanted) if wanted.limit(broadcast_keys + 1).count() <= broadcast_keys else wanted.hint("merge")
    return visible(log.join(wanted, "key", "left_semi"), ranges, seq, now)


def has_many(log: DataFrame, ranges: DataFrame | None, keys: DataFrame, seq: int, now: int) -> DataFrame:
    """key and present for each different, non-empty requested key; reads no values."""
    bare = log.select("seq", "kind", "key", "expires_at").withColumn("value", F.lit(None).cast("string"))
    there = get_many(bare, ranges, keys, seq, now).select("key", F.lit(True).alias("present"))
    return requested(keys).join(there, "key", "left").select("key", F.coalesce("present", F.lit(False)).alias("present"))


def requested(keys: DataFrame) -> DataFrame:
    return keys.select("key").filter(F.octet_length("key") > 0).distinct()


def history(log: DataFrame, keys: DataFrame) -> DataFrame:
    """All versions of the requested keys, numbered from the newest."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return log.join(requested(keys), "key", "left_semi").select("key", "seq", "kind", "value", rank.cast("bigint").alias("version"))


def merged(*sources: DataFrame) -> DataFrame:
    """Sources as one relation in internal order: keys ascend over partitions and within them, newer versions first.

    All versions of a key are in one partition, so what follows by key needs no other shuffle.
    """
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.repartitionByRange("key").sortWithinPartitions(F.asc("key"), F.desc("seq"))
