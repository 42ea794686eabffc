"""Choosing files: overlap groups, readiness of tiers, size caps and pruning, over manifest rows.

Manifests are small, so the choices an engine makes are plain Python; the same relations exist as
DataFrames for use on other tables of intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.operators.ranges import held_by


@dataclass(frozen=True)
class File:
    num: int
    depth: int
    size: int
    min_key: object
    max_key: object
    entries: int = 0
    tombstones: int = 0
    path: str = ""
    min_seq: int = 0
    max_seq: int = 0

    def may_hold(self, key) -> bool:
        return (self.min_key is None or self.min_key <= key) and (self.max_key is None or key <= self.max_key)

    def overlaps(self, start, end) -> bool:
        """Whether it may hold keys of [start, end]; the end counts, to be safe."""
        return (end is None or self.min_key is None or self.min_key <= end) and (start is None or self.max_key is None or self.max_key >= start)


def overlap_groups(files: list[File]) -> list[list[File]]:
    """Files whose key ranges touch, directly or through others; abutting bounds touch, an open bound reaches on."""
    ordered = sorted(files, key=lambda f: (f.min_key is not None, f.min_key if f.min_key is not None else 0, f.num))
    out: list[list[File]] = []
    reach = None
    for f in ordered:
        if out and (reach is OPEN or f.min_key is None or f.min_key <= reach):
            out[-1].append(f)
        else:
            out.append([f])
            reach = f.max_key if f.max_key is not None else OPEN
            continue
        if f.max_key is None:
            reach = OPEN
        elif reach is not OPEN:
            reach = max(reach, f.max_key)
    return out


OPEN = object()


def largest_group(groups: list[list[File]]) -> list[File]:
    """The one with most files; of equals the first."""
    return max(groups, key=len) if groups else []


def capped(files: list[File], most: int) -> list[File]:
    """The first files up to and with the one that reaches `most` bytes, two at least; 0 or less: all."""
    if most <= 0:
        return files
    total, out = 0, []
    for f in files:
        out.append(f)
        total += f.size
        if total >= most and len(out) >= 2:
            break
    return out


def size_targets(base: int, multiplier: int, most: int, depths: list[int]) -> dict[int, int]:
    return {d: min(base * multiplier**d, most) for d in depths}


@dataclass(frozen=True)
class TierRules:
    ratio: int = 4
    min_tables: int = 4
    byte_trigger: int = 0
    tombstone_ratio: float = 0.5
    max_levels: int = 8
    overlap_selection: bool = True


def pick_tier(files: list[File], rules: TierRules) -> int | None:
    """The shallowest tier that is ready to be merged."""
    cap = rules.max_levels - 1
    for depth in sorted({f.depth for f in files}):
        own = [f for f in files if f.depth == depth]
        c, entries = len(own), sum(f.entries for f in own)
        if rules.min_tables >= 2 and depth > 0 and c < rules.min_tables:
            continue
        gate = depth == 0 or not rules.overlap_selection or (rules.ratio >= 2 and c >= 2 * rules.ratio) or any(len(g) >= 2 for g in overlap_groups(own))
        full = c >= rules.ratio or (rules.byte_trigger > 0 and c >= 2 and sum(f.size for f in own) >= rules.byte_trigger)
        dense = rules.tombstone_ratio > 0 and c >= 2 and entries > 0 and sum(f.tombstones for f in own) / entries >= rules.tombstone_ratio
        if (depth < cap and gate and full) or dense:
            return depth
    return None


def live_files(edits: list[tuple[str, File | int]]) -> dict[int, File]:
    """Folds adds and deletes into the live set; a reused number or an unknown delete is an error."""
    live: dict[int, File] = {}
    used: set[int] = set()
    for op, x in edits:
        if op == "add":
            if x.num in used:
                raise ValueError(f"file {x.num} was added before")
            used.add(x.num)
            live[x.num] = x
        elif live.pop(x, None) is None:
            raise ValueError(f"file {x} is not live")
    return live


# The same as relations.


def grouped(files: DataFrame, by: str = "depth") -> DataFrame:
    """Adds grp, the number of the overlap group within `by`, counted from 1 by rising keys."""
    rising = Window.partitionBy(by).orderBy(F.asc_nulls_first("min_key"), "num")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.max(F.col("max_key").isNull()).over(before), F.lit(False))
    new = ~F.coalesce(open_before | F.col("min_key").isNull() & F.max(F.lit(True)).over(before) | (F.col("min_key") <= F.max("max_key").over(before)), F.lit(False))
    return files.withColumn("__new", new.cast("bigint")).withColumn("grp", F.sum("__new").over(rising.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def largest_groups(files: DataFrame, by: str = "depth") -> DataFrame:
    """`by`, grp and tables of the overlap group with most files in each `by`; of equals the one with the lowest key."""
    sizes = grouped(files, by).groupBy(by, "grp").agg(F.count("*").alias("tables"), F.min("min_key").alias("low"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("tables"), "low"))
    return sizes.withColumn("rank", rank).filter("rank = 1").select(by, "grp", "tables")


def capped_prefix(files: DataFrame, most: int, by: str = "depth") -> DataFrame:
    """The first files of each `by` up to and with the one that reaches `most` bytes, two at least, with total, the bytes so far."""
    w = Window.partitionBy(by).orderBy("min_key", "num")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = files.withColumns({"__n": F.row_number().over(w), "__before": before})
    return rows.filter((F.col("__n") <= 2) | (F.col("__before") < most)).withColumn("total", F.col("__before") + F.col("size")).drop("__n", "__before")


def newest_file(files: DataFrame) -> DataFrame:
    """The file that was made last: the one with the largest number."""
    return files.agg(F.max_by(F.struct(*files.columns), "num").alias("f")).filter("f is not null").select("f.*")


def live(edits: DataFrame) -> DataFrame:
    """num of the files that are live after edits (edit, op, num): those whose last edit adds them."""
    return edits.groupBy("num").agg(F.max_by("op", "edit").alias("op")).filter("op = 'add'").select("num")


def depth_histogram(files: DataFrame) -> DataFrame:
    """depth, tables, bytes, entries and tombstones of each depth."""
    return files.groupBy("depth").agg(F.count("*").alias("tables"), F.sum("size").alias("bytes"), F.sum("entries").alias("entries"), F.sum("tombstones").alias("tombstones"))


def blob_places(values: DataFrame, threshold: int, by: str, order: str) -> DataFrame:
    """Adds blob, file and off to (bytes): values from threshold bytes on go to a file for each `by`, one behind the other."""
    large = F.col("bytes") >= threshold
    upto = F.sum(F.when(large, F.col("bytes")).otherwise(0)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumns({"blob": large, "file": F.when(large, F.col(by)), "off": F.when(large, upto - F.col("bytes"))})


def candidates(keys: DataFrame, files: DataFrame) -> DataFrame:
    """key and num of the files that may hold it; files is a manifest."""
    bounds = files.select("num", F.col("min_key").alias("start_key"), F.col("max_key").alias("end_key"))
    return held_by(keys.select("key"), bounds).select("key", "num")


def tier_readiness(files: DataFrame, rules: TierRules) -> DataFrame:
    """depth, tables, bytes, entries, tombstones, largest_overlap, ready of each tier."""
    groups = grouped(files).groupBy("depth", "grp").agg(F.count("*").alias("n")).groupBy("depth").agg(F.max("n").alias("largest_overlap"))
    sums = depth_histogram(files)
    c, depth = F.col("tables"), F.col("depth")
    enough = ~(F.lit(rules.min_tables >= 2) & (depth > 0) & (c < rules.min_tables))
    gate = (depth == 0) | F.lit(not rules.overlap_selection) | (F.lit(rules.ratio >= 2) & (c >= 2 * rules.ratio)) | (F.col("largest_overlap") >= 2)
    full = (c >= rules.ratio) | (F.lit(rules.byte_trigger > 0) & (c >= 2) & (F.col("bytes") >= rules.byte_trigger))
    dense = F.lit(rules.tombstone_ratio > 0) & (c >= 2) & (F.col("entries") > 0) & (F.col("tombstones") >= rules.tombstone_ratio * F.col("entries"))
    return sums.join(groups, "depth").withColumn("ready", enough & (((depth < rules.max_levels - 1) & gate & full) | dense))
