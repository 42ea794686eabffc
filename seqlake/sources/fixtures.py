"""Relations of versions, range deletes and files derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1705968000  # 2024-01-23 00:00:00 UTC
DEADLINE = 21600
BATCH = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(user: Column) -> Column:
    return F.concat(F.lit("u"), F.lpad(user.cast("string"), 8, "0"))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per event: errors delete, signups expire, ten make a batch."""
    e = table(spark, sf_dir, "events")
    seq = (F.col("event_id") + 1).cast("bigint")
    kind = F.when(F.col("event_type") == "error", 1).otherwise(0)
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(seq.alias("seq"), key_of(F.col("user_id")).alias("key"), kind.alias("kind"), F.when(kind == 0, F.col("props")).alias("value"), F.when(F.col("event_type") == "signup", at + DEADLINE).otherwise(F.lit(0)).cast("bigint").alias("expires_at"), (seq - (seq - 1) % BATCH).alias("batch_seq"), at.alias("at"))


def range_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_id") % 97 == 13)
    return e.select(key_of(F.col("user_id")).alias("start_key"), key_of(F.col("user_id") + 5).alias("end_key"), (F.col("event_id") + 1).cast("bigint").alias("seq"))


def sequence_at(spark: SparkSession, sf_dir: str) -> int:
    """The last sequence written up to NOW."""
    return mutations(spark, sf_dir).filter(F.col("at") <= NOW).agg(F.max("seq").alias("s")).first()["s"]


def order_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest: a file per customer, four hundred a tier."""
    n = F.col("c_custkey")
    low = (n % 400) * 40
    return table(spark, sf_dir, "customer").select(n.alias("num"), F.floor(n / 400).cast("int").alias("depth"), (1000 + (n * 7919) % 5003).alias("size"), low.alias("min_key"), (low + (n * 7919) % 61).alias("max_key"), (10 + n % 90).alias("entries"), ((n * 31) % (10 + n % 90)).alias("tombstones"))


def wanted_keys(spark: SparkSession) -> DataFrame:
    """Forty keys of users, absent ones, repeats and an empty one."""
    ids = spark.range(40).select(key_of(F.col("id") * 7 + 1).alias("key"))
    repeats = spark.range(3).select(key_of(F.col("id") * 7 + 1).alias("key"))
    absent = spark.range(5).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("key"))
    return ids.union(repeats).union(absent).union(spark.createDataFrame([("",)], "key string"))
