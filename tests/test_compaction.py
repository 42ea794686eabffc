"""Compaction keeps what readers at or above the retained sequence see."""

import random

from pyspark.sql import functions as F

from seqlake.operators import compaction, visibility

LOG = "seq bigint, key string, kind int, value string, expires_at bigint"
RANGES = "start_key string, end_key string, seq bigint"


def kept(spark, log, retain, rts=(), **more):
    df = compaction.compacted(spark.createDataFrame(log, LOG), spark.createDataFrame(list(rts), RANGES), retain, more.pop("expire_before", 0), **more)
    return sorted((r["key"], r["seq"], r["kind"]) for r in df.collect())


def test_versions_that_stay(spark):
    k = [(s, "k", 0, f"v{s}", 0) for s in (1, 2, 3)]
    assert kept(spark, k, 3) == [("k", 3, 0)]
    assert kept(spark, [k[0], (5, "k", 0, "v", 0)], 3) == [("k", 1, 0), ("k", 5, 0)]
    assert kept(spark, [k[0], k[2]], 3) == [("k", 3, 0)]
    assert kept(spark, [(2, "k", 1, None, 0)], 3) == [("k", 2, 1)]
    assert kept(spark, [(2, "k", 1, None, 0)], 3, reclaim=True) == []


def test_expired_values_become_deletes_and_skip_the_filter(spark):
    log = [(1, "a", 0, "x", 10), (2, "b", 0, "drop", 0), (3, "c", 0, "keep", 0)]
    assert kept(spark, log, 9, expire_before=10, keep=F.col("value") == "keep") == [("a", 1, 1), ("b", 2, 1), ("c", 3, 0)]
    assert kept(spark, log, 9, expire_before=10, reclaim=True, keep=F.col("value") == "keep", through=1) == [("b", 2, 0), ("c", 3, 0)]


def test_conflicts(spark):
    rows = [(1, "a", 0, "x", 0), (1, "a", 0, "x", 0), (2, "b", 0, "x", 0), (2, "b", 0, "y", 0), (3, "c", 0, "x", 9), (3, "c", 1, None, 0), (4, "d", 0, "x", 0), (4, "d", 1, None, 0)]
    df = spark.createDataFrame(rows, LOG)
    assert {r["key"] for r in compaction.conflicts(df).collect()} == {"b", "d"}
    assert compaction.without_replays(df.filter("key in ('a', 'c')")).count() == 2


def test_readers_see_no_difference(spark):
    r = random.Random(1)
    log = [(s, f"k{r.randint(0, 12):02d}", int(r.random() < 0.3), f"v{s}", r.choice([0, 0, 5, 500])) for s in range(1, 200)]
    rts = [(f"k{a:02d}", f"k{a + 3:02d}", s) for s, a in ((20, 2), (90, 5), (150, 0), (190, 7))]
    df, ranges = spark.createDataFrame(log, LOG), spark.createDataFrame(rts, RANGES)
    retain = 120
    for reclaim in (False, True):
        small = compaction.compacted(df, ranges, retain, 10, reclaim)
        left = compaction.kept_ranges(ranges, retain, reclaim)
        for seq in (120, 121, 160, 200):
            assert sorted(visibility.visible(df, ranges, seq, 10).collect()) == sorted(visibility.visible(small, left, seq, 10).collect())
    before = visibility.visible(df, ranges, 60, 10).collect()
    assert sorted(before) != sorted(visibility.visible(compaction.compacted(df, ranges, retain, 10, True), ranges, 60, 10).collect())


def test_files_left_behind_hold_deletes_back(spark):
    log = [(1, "a", 1, None, 0), (2, "m", 1, None, 0)]
    files = spark.createDataFrame([("k", "p")], "min_key string, max_key string")
    df = compaction.outside(spark.createDataFrame(log, LOG), files)
    out = compaction.compacted(df, spark.createDataFrame([], RANGES), 9, 0, F.col("reclaim"))
    assert [r["key"] for r in out.collect()] == ["m"]
    open_ended = spark.createDataFrame([(None, "b")], "min_key string, max_key string")
    assert {r["key"]: r["reclaim"] for r in compaction.outside(spark.createDataFrame(log, LOG), open_ended).collect()} == {"a": False, "m": True}
