import pytest

from seqlake.plans.planner import File, TierRules, capped, grouped, largest_group, live_files, overlap_groups, pick_tier, size_targets, tier_readiness


def files(*bounds, depth=0, **more):
    return [File(i, depth, more.get("size", 10), a, b, more.get("entries", 10), more.get("tombstones", 0)) for i, (a, b) in enumerate(bounds, 1)]


def nums(groups):
    return [[f.num for f in g] for g in groups]


def test_overlap_groups():
    assert nums(overlap_groups(files("ac", "eg", "ik"))) == [[1], [2], [3]]
    assert nums(overlap_groups(files("03", "18", "27", "69"))) == [[1, 2, 3, 4]]
    assert nums(overlap_groups(files("ac", "ce"))) == [[1, 2]]
    assert nums(overlap_groups(files(("x", None), "ac", ("y", "z")))) == [[2], [1, 3]]
    assert nums(overlap_groups(files((None, "b"), "ac"))) == [[1, 2]]
    assert [f.num for f in largest_group(overlap_groups(files("ab", "bc", "xy", "yz")))] == [1, 2]


def test_caps_and_targets():
    f = files("ab", "bc", "cd", "de")
    assert [len(capped(f, n)) for n in (1, 20, 25, 0)] == [2, 2, 3, 4]
    assert list(size_targets(2, 2, 128, list(range(10))).values()) == [2, 4, 8, 16, 32, 64, 128, 128, 128, 128]


def test_picker():
    rules = TierRules(ratio=4, min_tables=4)
    assert pick_tier(files("ab", "cd", "ef", "gh"), rules) == 0
    assert pick_tier(files("ab", "cd", "ef", depth=1), rules) is None
    five = files(*[(f"{i}0", f"{i}5") for i in range(5)], depth=1)
    eight = files(*[(f"{i}0", f"{i}5") for i in range(8)], depth=1)
    assert pick_tier(five, rules) is None and pick_tier(eight, rules) == 1
    dense = files("ab", "cd", entries=6, tombstones=4)
    assert pick_tier(dense, TierRules(ratio=9, tombstone_ratio=0.5)) == 0
    assert pick_tier(dense, TierRules(ratio=9, tombstone_ratio=0.9)) is None
    assert pick_tier(dense[:1], TierRules(ratio=9, tombstone_ratio=0.5)) is None


def test_relations_agree(spark):
    own = files("ac", "ce", "xy", depth=1) + [File(9, 2, 5, None, "b", 1, 1), File(10, 2, 5, "a", None, 1, 1), File(11, 2, 5, "q", "r", 1, 1), File(12, 2, 5, "s", "t", 1, 1)]
    df = spark.createDataFrame([(f.num, f.depth, f.size, f.min_key, f.max_key, f.entries, f.tombstones) for f in own], "num bigint, depth int, size bigint, min_key string, max_key string, entries bigint, tombstones bigint")
    got = {}
    for r in grouped(df).collect():
        got.setdefault((r["depth"], r["grp"]), set()).add(r["num"])
    want = [set(g) for d in (1, 2) for g in nums(overlap_groups([f for f in own if f.depth == d]))]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    rules = TierRules(ratio=4, min_tables=4)
    ready = [r["depth"] for r in tier_readiness(df, rules).filter("ready").collect()]
    assert min(ready, default=None) == pick_tier(own, rules)


def test_live_files():
    f = files("ab", "cd")
    assert set(live_files([("add", f[0]), ("add", f[1]), ("delete", 1)])) == {2}
    with pytest.raises(ValueError):
        live_files([("delete", 1)])
    with pytest.raises(ValueError):
        live_files([("add", f[0]), ("delete", 1), ("add", f[0])])
