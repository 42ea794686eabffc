"""Covers and interval joins against plain loops, for few and for many intervals, and their plans."""

import random

import pytest

from seqlake import queries
from seqlake.operators import ranges

DATA = "/root/testdata/sf0.001"


def cover(key, deletes, seq):
    return max((r for a, b, r in deletes if a <= key < b and r <= seq), default=0)


@pytest.mark.parametrize("kind", ["string", "binary", "bigint"])
@pytest.mark.parametrize("few", [True, False])
def test_cover(spark, kind, few):
    r = random.Random(7)
    make = {"string": lambda x: f"k{x:04d}", "binary": lambda x: bytearray(x.to_bytes(2, "big")), "bigint": lambda x: x}[kind]
    deletes = [(a, a + r.choice([0, 1, 3, 40, 900, -5]), s) for s, a in enumerate(r.choices(range(1000), k=400), 1)]
    keys = r.choices(range(1100), k=500)
    df = spark.createDataFrame([(make(k), k) for k in keys], f"key {kind}, k bigint")
    gone = spark.createDataFrame([(make(max(0, a)), make(max(0, b)), s) for a, b, s in deletes], f"start_key {kind}, end_key {kind}, seq bigint")
    for seq in (0, 17, 250, 400):
        got = ranges.with_cover(df, gone, seq, *(() if few else (20, 16))).collect()
        assert len(got) == 500 and all(x["cover"] == cover(x["k"], deletes, seq) for x in got)


def test_sorted_ranges_spread_over_all_buckets(spark):
    """Limits come from all starts: the first rows of a sorted list do not make one bucket of the rest."""
    gone = spark.range(3000).selectExpr("format_string('k%06d', id * 10) AS start_key", "format_string('k%06d', id * 10 + 5) AS end_key", "id + 1 AS seq")
    keys = spark.range(3000).selectExpr("format_string('k%06d', id * 10 + 3) AS key", "id")
    got = ranges.with_cover(keys, gone, 10_000, 100, 32)
    assert got.filter("cover = id + 1").count() == 3000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_held_by(spark):
    r = random.Random(9)
    own = [(k, None if r.random() < 0.05 else a, None if r.random() < 0.05 else a + r.choice([0, 2, 30, 500])) for k, a in enumerate(r.choices(range(1000), k=200))]
    keys = r.choices(range(-5, 1600), k=300)
    df, iv = spark.createDataFrame([(k,) for k in keys], "key bigint"), spark.createDataFrame(own, "num bigint, start_key bigint, end_key bigint")
    want = sorted((k, n) for k in keys for n, a, b in own if (a is None or a <= k) and (b is None or k <= b))
    for buckets in (1024, 8, 1):
        assert sorted((x["key"], x["num"]) for x in ranges.held_by(df, iv, buckets).select("key", "num").collect()) == want
    assert ranges.held_by(df, iv.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["latest_state", "snapshot_state", "compact_bottom", "compact_partial_reclaim", "file_candidates", "classified"])
def test_no_nested_loops(spark, name):
    df = queries.QUERIES[{"classified": "state_classification"}.get(name, name)](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
