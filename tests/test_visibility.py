"""Rules of visibility, each against a variant that breaks it."""

from pyspark.sql import functions as F

from seqlake.operators import ranges, visibility

LOG = "seq bigint, key string, kind int, value string, expires_at bigint"
RANGES = "start_key string, end_key string, seq bigint"


def state(spark, log, rts=(), seq=100, now=50, **bounds):
    rows = visibility.visible(spark.createDataFrame(log, LOG), spark.createDataFrame(list(rts), RANGES), seq, now, **bounds).collect()
    return {r["key"]: r["value"] for r in rows}


def test_newest_version_decides(spark):
    log = [(1, "k", 0, "a", 0), (3, "k", 0, "c", 0), (2, "k", 0, "b", 0)]
    assert state(spark, log) == {"k": "c"}
    assert state(spark, log, seq=2) == {"k": "b"}
    assert state(spark, log, seq=0) == {}


def test_deletes_and_deadlines_shadow_what_is_older(spark):
    log = [(1, "d", 0, "old", 0), (2, "d", 1, None, 0), (1, "t", 0, "old", 0), (2, "t", 0, "new", 50)]
    assert state(spark, log, now=49) == {"t": "new"}
    assert state(spark, log, now=50) == {}
    broken = spark.createDataFrame(log, LOG).filter("kind = 0 and (expires_at = 0 or expires_at > 50)")
    assert {r["key"] for r in visibility.newest(broken).collect()} == {"d", "t"}


def test_range_deletes_compare_sequences_and_bounds(spark):
    log = [(k, f"k{k:02d}", 0, "v", 0) for k in range(10)]
    assert set(state(spark, log, [("k03", "k07", 20)])) == {"k00", "k01", "k02", "k07", "k08", "k09"}
    assert len(state(spark, log, [("k03", "k07", 20)], seq=19)) == 10
    assert set(state(spark, log, [("k03", "k07", 5)])) == {"k00", "k01", "k02", "k05", "k06", "k07", "k08", "k09"}
    assert len(state(spark, log, [("k07", "k03", 20), ("k03", "k03", 20)])) == 10
    again = [*log, (30, "k04", 0, "w", 0)]
    assert state(spark, again, [("a", "z", 20)]) == {"k04": "w"}


def test_scan_bounds(spark):
    log = [(1, k, 0, k, 0) for k in "abc"]
    assert set(state(spark, log, start="b")) == {"b", "c"}
    assert set(state(spark, log, end="b")) == {"a"}
    assert state(spark, log, end="") == {}


def test_binary_keys_are_unsigned(spark):
    log = spark.createDataFrame([(i + 1, bytearray(k), 0, bytearray(b"v"), 0) for i, k in enumerate([b"\x80", b"\x7f\x00", b"\x7f", b"\xff"])], LOG.replace("string", "binary"))
    assert [bytes(r["key"]) for r in visibility.merged(log).collect()] == [b"\x7f", b"\x7f\x00", b"\x80", b"\xff"]


def test_many_keys(spark):
    log = spark.createDataFrame([(i, f"k{i}", i % 2, "v", 0) for i in range(1, 20)], LOG)
    keys = spark.createDataFrame([("k2",), ("k2",), ("",), (None,), ("k3",), ("zz",)], "key string")
    assert {r["key"] for r in visibility.get_many(log, None, keys, 100, 0).collect()} == {"k2"}
    assert {r["key"] for r in visibility.get_many(log, None, keys, 100, 0, broadcast_keys=0).collect()} == {"k2"}
    assert {r["key"]: r["present"] for r in visibility.has_many(log, None, keys, 100, 0).collect()} == {"k2": True, "k3": False, "zz": False}


def test_flattened_ranges_equal_a_search(spark):
    import random

    r = random.Random(4)
    many = [(f"{a:03d}", f"{a + r.randint(0, 30):03d}", s) for s, a in enumerate((r.randint(0, 200) for _ in range(120)), 1)]
    flat = ranges.flatten(many)
    assert all(a < b for a, b, _ in flat) and all(x[1] <= y[0] for x, y in zip(flat, flat[1:], strict=False))
    for k in range(240):
        key = f"{k:03d}"
        want = max((s for a, b, s in many if a <= key < b), default=0)
        assert next((s for a, b, s in flat if a <= key < b), 0) == want
    keys = spark.createDataFrame([(f"{k:03d}",) for k in range(240)], "key string")
    rts = spark.createDataFrame(many, RANGES)
    few = {x["key"]: x["cover"] for x in ranges.with_cover(keys, rts, 80).collect()}
    spread = {x["key"]: x["cover"] for x in ranges.with_cover(keys, rts, 80, broadcast_ranges=10, buckets=7).collect()}
    assert few == spread == {f"{k:03d}": max((s for a, b, s in many if a <= f"{k:03d}" < b and s <= 80), default=0) for k in range(240)}


def test_empty_relations(spark):
    assert state(spark, []) == {}
    log = spark.createDataFrame([], LOG)
    assert visibility.classified(log, spark.createDataFrame([], RANGES), 5, 5).filter(F.col("state") == "live").count() == 0
