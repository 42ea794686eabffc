from pyspark.sql import functions as F

from seqlake.operators import changes, writes


def test_contiguous_sequences(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("x"))
    rows = writes.with_sequences(df, 10, ["x"], 5).orderBy("x").collect()
    assert [r["seq"] for r in rows] == list(range(11, 5011))
    assert writes.with_sequences(df.limit(0), 10, ["x"]).count() == 0


def test_first_error_in_order(spark):
    ops = [(1, 1, 0, "k", "v", -1), (1, 2, 0, "", "v", 0), (2, 1, 0, "k", "v", 0), (3, 1, 1, None, None, 0)]
    df = spark.createDataFrame(ops, "batch int, ord int, kind int, key string, value string, expires_at bigint")
    assert {r["batch"]: r["error"] for r in writes.first_errors(df).collect()} == {1: "invalid_ttl", 2: None, 3: "empty_key"}


def test_unchanged_puts(spark):
    rows = [(1, "k", 0, "v", 0), (2, "k", 0, "v", 0), (3, "k", 0, "w", 0), (4, "k", 0, "w", 9), (5, "k", 1, None, 0), (6, "k", 0, "w", 9)]
    df = spark.createDataFrame(rows, "seq bigint, key string, kind int, value string, expires_at bigint")
    assert sorted(r["seq"] for r in writes.changed_puts(df).collect()) == [1, 3, 4, 5, 6]


def test_gaps_recovery_retention(spark):
    log = spark.createDataFrame([(s,) for s in (1, 2, 5, 6, 9)], "seq bigint")
    assert sorted(tuple(r) for r in changes.gaps(log, 0, 11).collect()) == [(3, 4), (7, 8), (10, 11)]
    assert changes.gaps(log.filter("seq < 3"), 0, 2).count() == 0
    bad = spark.createDataFrame([(5,), (9,)], "seq bigint")
    assert sorted(r["seq"] for r in changes.recovered(log, bad).collect()) == [1, 2]
    assert sorted(r["seq"] for r in changes.recovered(log, bad, 6).collect()) == [6]
    segs = spark.createDataFrame([(1, 10, 90), (2, 10, 5), (3, 10, 50), (4, 10, 60)], "num bigint, bytes bigint, age bigint")
    assert {r["num"]: r["kept"] for r in changes.kept_segments(segs, 10, 0).collect()} == {1: False, 2: True, 3: True, 4: True}
    assert {r["num"]: r["kept"] for r in changes.kept_segments(segs, 0, 15).collect()} == {1: False, 2: False, 3: True, 4: True}


def test_stream_restarts_without_gap_or_repeat(spark, tmp_path):
    from seqlake.streaming.tail import follow

    changes_dir, applied, progress = (str(tmp_path / x) for x in ("c", "a", "p"))
    rows = spark.range(1, 11).select(F.col("id").alias("seq"))
    rows.filter("seq <= 5").coalesce(1).write.parquet(changes_dir)
    follow(spark, changes_dir, applied, progress)
    rows.filter("seq > 5").coalesce(1).write.mode("append").parquet(changes_dir)
    follow(spark, changes_dir, applied, progress)
    assert sorted(r["seq"] for r in spark.read.parquet(applied).select("seq").collect()) == list(range(1, 11))
