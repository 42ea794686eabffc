"""Compaction: which versions survive a merge, in closed form per key.

Every version above the retention sequence R stays, and of those up to R the newest, unless it is
dead (deleted, expired, refused by the filter, or covered by a range delete up to R) and nothing below
the merge can hold the key. Dead versions that stay become deletes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions.model import DELETE, NEVER
from seqlake.operators.ranges import held_by, with_cover


def conflicts(log: DataFrame) -> DataFrame:
    """key and seq that occur with different contents; a put with a deadline beside its delete is no conflict."""
    same = F.struct("kind", "value", "expires_at")
    groups = log.groupBy("key", "seq").agg(F.count_distinct(same).alias("different"), F.count_distinct(F.when(F.col("kind") != DELETE, same)).alias("puts"), F.max((F.col("kind") != DELETE) & (F.col("expires_at") != NEVER)).alias("deadline"))
    return groups.filter((F.col("different") > 1) & ~((F.col("puts") == 1) & F.col("deadline"))).select("key", "seq", F.col("different").cast("bigint").alias("different"))


def without_replays(log: DataFrame) -> DataFrame:
    """One row for each (key, seq); of a put with a deadline and its delete the delete."""
    return log.groupBy("key", "seq").agg(F.max_by(F.struct("kind", "value", "expires_at"), "kind").alias("v")).select("key", "seq", "v.*")


def compacted(log: DataFrame, ranges: DataFrame, retain: int, expire_before: int, reclaim: Column | bool = False, keep: Column | None = None, through: int = 0) -> DataFrame:
    """seq, key, kind, value, expires_at of what a merge of log writes.

    reclaim: whether nothing outside the merge may hold the key (a column of log may say). keep: the
    user's filter, a condition on key, value and expires_at; it applies to live values up to sequence
    `through` (0: all).
    """
    dead = (F.col("kind") == DELETE) | ((F.col("expires_at") != NEVER) & (F.col("expires_at") <= expire_before))
    if keep is not None:
        seen = F.lit(True) if through == 0 else F.col("seq") <= through
        dead = dead | (seen & ~F.coalesce(keep, F.lit(False)))
    reclaim = F.lit(reclaim) if isinstance(reclaim, bool) else reclaim
    old = Window.partitionBy("key", "__old").orderBy(F.desc("seq"))
    marked = log.withColumn("__dead", dead).withColumn("__reclaim", reclaim).withColumn("__old", F.col("seq") <= retain)
    first = marked.withColumn("__rank", F.row_number().over(old)).filter(~F.col("__old") | (F.col("__rank") == 1))
    covered = with_cover(first, ranges, retain)
    gone = F.col("__old") & F.col("__reclaim") & ((F.col("cover") > F.col("seq")) | F.col("__dead"))
    out = covered.filter(~gone)
    kind = F.when(F.col("__dead"), DELETE).otherwise(F.col("kind"))
    alive = lambda c, other: F.when(F.col("__dead"), F.lit(other).cast(log.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return out.select("seq", "key", kind.alias("kind"), alive("value", None), alive("expires_at", NEVER))


def kept_ranges(ranges: DataFrame, retain: int, bottom: bool) -> DataFrame:
    """The range deletes a merge carries on: all, or at the bottom those above R."""
    return ranges.filter(F.col("seq") > retain) if bottom else ranges


def outside(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Adds reclaim: whether no file (min_key, max_key inclusive, null open) may hold the key."""
    bounds = files.select(F.col("min_key").alias("start_key"), F.col("max_key").alias("end_key")).distinct()
    held = held_by(keys.select("key").distinct(), bounds).select("key").distinct().withColumn("__held", F.lit(True))
    return keys.join(held, "key", "left").withColumn("reclaim", F.col("__held").isNull()).drop("__held")
