"""Range deletes: half-open key intervals with a sequence, kept apart from the versions.

A key is covered by the largest sequence of the intervals that hold it. Few intervals are swept into
disjoint, sorted segments, and each key finds its own by halving steps over them: no join. Many are dealt, with the
keys, over buckets of the key space; a range goes to the buckets it begins and ends in, and what lies whole between
these is a handful of nodes of a tree over the buckets, however wide the range.
"""

from __future__ import annotations

import base64
import heapq
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RANGES = 20_000
BUCKETS, RANGES_A_BUCKET = 1024, 64


def flatten(ranges: list[tuple]) -> list[tuple]:
    """Disjoint (low, high, seq) with the largest sequence over each stretch, ascending; from (start, end, seq)."""
    starts = sorted(r for r in ranges if r[0] < r[1])
    points = sorted({p for s, e, _ in starts for p in (s, e)})
    out: list[tuple] = []
    open_: list[tuple] = []
    k = 0
    for low, high in zip(points, points[1:], strict=False):
        while k < len(starts) and starts[k][0] <= low:
            heapq.heappush(open_, (-starts[k][2], starts[k][1]))
            k += 1
        while open_ and open_[0][1] <= low:
            heapq.heappop(open_)
        if open_:
            seq = -open_[0][0]
            if out and out[-1][1] == low and out[-1][2] == seq:
                out[-1] = (out[-1][0], high, seq)
            else:
                out.append((low, high, seq))
    return out


def constant(rows: list, kind: str) -> Column:
    """A literal array, whatever its length; rows are values or tuples of a struct's fields."""
    plain = lambda x: base64.b64encode(x).decode() if isinstance(x, bytes | bytearray) else x
    if rows and isinstance(rows[0], tuple):
        names = [f.strip().split(":")[0] for f in kind.removeprefix("struct<").removesuffix(">").split(",")]
        data = [dict(zip(names, map(plain, r), strict=True)) for r in rows]
    else:
        data = [plain(x) for x in rows]
    return F.from_json(F.lit(json.dumps(data)), f"array<{kind}>")  # of a constant: worked out once, when the plan is made


def place_in(value: Column, bounds: Column, n: int) -> Column:
    """How many of n ascending bounds are at most value."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(bounds, at + s - 1) <= value), at + s).otherwise(at))


def with_cover(keys: DataFrame, ranges: DataFrame, seq: int, broadcast_ranges: int = BROADCAST_RANGES, buckets: int = BUCKETS) -> DataFrame:
    """Adds cover: the largest sequence up to seq of the ranges that hold the key, 0 if none does."""
    seen = ranges.filter((F.col("seq") <= seq) & (F.col("start_key") < F.col("end_key"))).select("start_key", "end_key", F.col("seq").alias("range_seq"))
    few = seen.limit(broadcast_ranges + 1).collect()
    if not few:
        return keys.withColumn("cover", F.lit(0).cast("bigint"))
    kind = keys.schema["key"].dataType.simpleString()
    if len(few) > broadcast_ranges:
        return _dealt_cover(keys, seen, kind, broadcast_ranges, buckets)
    flat = flatten([tuple(r) for r in few])
    segments = constant(flat, f"struct<low:{kind},high:{kind},cover:bigint>")
    own = F.get(segments, place_in(F.col("key"), segments["low"], len(flat)) - 1)
    inside = F.transform(F.array(own), lambda s: F.when(F.col("key") < s["high"], s["cover"]))
    return keys.withColumn("cover", F.coalesce(F.get(inside, F.lit(0)), F.lit(0).cast("bigint")))


def nodes_between(first: Column, last: Column, size: int) -> Column:
    """The nodes of a binary tree with `size` leaves (numbered from `size`; node n has 2n and 2n + 1 below it) that make up leaves first to last - 1."""
    levels = F.array(*[F.lit(k) for k in range(size.bit_length())])
    start = F.struct((first + size).cast("int").alias("l"), (last + size).cast("int").alias("r"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        l, r = acc["l"], acc["r"]  # noqa: E741
        some = l < r
        left, right = some & (l % 2 == 1), some & (r % 2 == 1)
        out = F.concat(acc["out"], F.when(left, F.array(l)).otherwise(F.array().cast("array<int>")), F.when(right, F.array(r - 1)).otherwise(F.array().cast("array<int>")))
        return F.struct(F.shiftright(F.when(left, l + 1).otherwise(l), 1).alias("l"), F.shiftright(F.when(right, r - 1).otherwise(r), 1).alias("r"), out.alias("out"))

    return F.aggregate(levels, start, step)["out"]


def _dealt_cover(keys: DataFrame, seen: DataFrame, kind: str, most: int, buckets: int) -> DataFrame:
    """The cover where ranges are many: by buckets of the key space whose limits are quantiles of all starts."""
    spark, n = keys.sparkSession, seen.count()
    # the least hashes of all starts are a fair sample of them, however they are ordered
    sample = sorted({r["start_key"] for r in seen.select("start_key").orderBy(F.xxhash64("start_key"), "start_key").limit(most).collect()})
    limits = sample[:: max(1, len(sample) // min(len(sample), max(buckets, n // RANGES_A_BUCKET)))]
    bounds, size = constant(limits, kind), 1 << len(limits).bit_length()
    bucket = lambda c: place_in(c, bounds, len(limits))
    placed = keys.select("key").distinct().withColumn("bucket", bucket(F.col("key")))
    ends = seen.withColumns({"a": bucket(F.col("start_key")), "b": bucket(F.col("end_key"))})
    dealt = ends.withColumn("bucket", F.explode(F.array_distinct(F.array("a", "b")))).drop("a", "b")
    part = placed.join(dealt, "bucket").filter((F.col("key") >= F.col("start_key")) & (F.col("key") < F.col("end_key"))).groupBy("key").agg(F.max("range_seq").alias("part"))
    whole = ends.filter("b > a + 1").select(F.explode(nodes_between(F.col("a") + 1, F.col("b"), size)).alias("node"), "range_seq").groupBy("node").agg(F.max("range_seq").alias("most"))
    every = spark.range(len(limits) + 1).select(F.col("id").cast("int").alias("bucket"))
    above = every.withColumn("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(size.bit_length() - 1)), lambda k: F.call_function("shiftright", F.col("bucket") + size, k))))
    full = above.join(whole, "node").groupBy("bucket").agg(F.max("most").alias("whole"))  # a row for each bucket at most
    found = placed.join(part, "key", "left").join(F.broadcast(full), "bucket", "left").select("key", F.greatest("part", "whole").alias("cover"))
    return keys.join(found, "key", "left").withColumn("cover", F.coalesce("cover", F.lit(0)).cast("bigint"))


def held_by(points: DataFrame, intervals: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """points (with key) beside each of the intervals (start_key, end_key, both inclusive, null: open) that hold the key.

    An equi-join: an interval stands under the nodes of a tree over buckets of the key space that it fills, and under the
    buckets it begins and ends in; a key is looked up under its bucket and all nodes above.
    """
    kind = points.schema["key"].dataType.simpleString()
    order = intervals.filter("start_key is not null").select("start_key").orderBy(F.xxhash64("start_key"), "start_key").limit(BROADCAST_RANGES)
    sample = sorted({r["start_key"] for r in order.collect()})
    limits = sample[:: max(1, len(sample) // max(1, min(len(sample), buckets)))]
    bounds, size = constant(limits, kind), 1 << len(limits).bit_length()
    bucket = lambda c: place_in(c, bounds, len(limits)) if limits else F.lit(0)
    ends = intervals.withColumns({"__a": F.coalesce(bucket(F.col("start_key")), F.lit(0)), "__b": F.when(F.col("end_key").isNull(), len(limits)).otherwise(bucket(F.col("end_key")))})
    edges = F.transform(F.array_distinct(F.array("__a", "__b")), lambda b: F.struct((b + size).cast("int").alias("node"), F.lit(True).alias("edge")))
    whole = F.transform(nodes_between(F.col("__a") + 1, F.col("__b"), size), lambda n: F.struct(n.cast("int").alias("node"), F.lit(False).alias("edge")))
    dealt = ends.withColumn("__n", F.explode(F.concat(edges, whole))).withColumns({"__node": F.col("__n.node"), "__edge": F.col("__n.edge")}).drop("__n", "__a", "__b")
    above = F.transform(F.array(*[F.lit(k) for k in range(size.bit_length())]), lambda k: F.call_function("shiftright", bucket(F.col("key")) + size, k))
    looked = points.withColumn("__node", F.explode(above))
    inside = F.coalesce(F.col("key") >= F.col("start_key"), F.lit(True)) & F.coalesce(F.col("key") <= F.col("end_key"), F.lit(True))
    return looked.join(dealt, "__node").filter(~F.col("__edge") | inside).drop("__node", "__edge")
