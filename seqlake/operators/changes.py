"""The change stream: gap-free tails, recovery of a damaged log, and how long history is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions.model import Corruption
from seqlake.operators.writes import with_sequences


def updates_since(log: DataFrame, seq: int, cutoff: int) -> DataFrame:
    """Changes seq + 1 to cutoff."""
    return log.filter((F.col("seq") > seq) & (F.col("seq") <= cutoff))


def batches_of(changes: DataFrame) -> DataFrame:
    """batch_seq, ops, first_seq and last_seq of the changes' batches; one cut by the tail's start is trimmed."""
    return changes.groupBy("batch_seq").agg(F.count("*").alias("ops"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def gaps(log: DataFrame, after: int, until: int) -> DataFrame:
    """first_missing and last_missing of each stretch of after + 1 to until that the log lacks.

    Looks up seq + 1 and seq - 1 by hash joins and numbers the ends of stretches over range partitions, so no task
    needs the whole log, or all gaps, in order.
    """
    spark = log.sparkSession
    inside = log.select("seq").filter((F.col("seq") > after) & (F.col("seq") <= until)).distinct()
    ends = inside.unionByName(spark.createDataFrame([(after,), (until + 1,)], "seq bigint"))
    starts = ends.join(ends.select((F.col("seq") - 1).alias("seq")), "seq", "left_anti").filter(F.col("seq") <= until)
    stops = ends.join(ends.select((F.col("seq") + 1).alias("seq")), "seq", "left_anti").filter(F.col("seq") > after)
    # a stretch lies between a start and the next stop; at a lone change, the stop before it comes first
    both = starts.select((F.col("seq") + 1).alias("at"), F.lit(1).alias("side")).union(stops.select((F.col("seq") - 1).alias("at"), F.lit(2).alias("side")))
    numbered = with_sequences(both, -1, ["at", "side"])
    return numbered.groupBy(F.floor(F.col("seq") / 2)).agg(F.min("at").alias("first_missing"), F.max("at").alias("last_missing")).select("first_missing", "last_missing")


def check_contiguous(log: DataFrame, after: int, until: int) -> None:
    """Raises unless the log holds each of after + 1 to until."""
    r = log.filter((F.col("seq") > after) & (F.col("seq") <= until)).agg(F.count_distinct("seq").alias("n")).first()
    if r["n"] != max(0, until - after):
        raise Corruption(f"{max(0, until - after) - r['n']} of the changes {after + 1} to {until} are missing")


def recovered(log: DataFrame, bad: DataFrame, boundary: int = 0) -> DataFrame:
    """Changes from boundary on and before the first damaged one: nothing after damage comes back."""
    cut = bad.filter(F.col("seq") >= boundary).agg(F.min("seq").alias("cut"))
    return log.filter(F.col("seq") >= boundary).crossJoin(F.broadcast(cut)).filter(F.col("cut").isNull() | (F.col("seq") < F.col("cut"))).drop("cut")  # one row


def kept_segments(segments: DataFrame, horizon_age: int, horizon_bytes: int) -> DataFrame:
    """Adds kept to (num, bytes, age): while age or size horizon covers a segment; the newest stays, and all after a kept one.

    Segments are files of one table; their list is small.
    """
    newest_first = Window.orderBy(F.desc("num"))
    before = F.coalesce(F.sum("bytes").over(newest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = (F.row_number().over(newest_first) == 1) | (F.col("age") <= horizon_age) | (before < horizon_bytes)
    oldest_first = Window.orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("__c", covered).withColumn("kept", F.max("__c").over(oldest_first)).drop("__c")
