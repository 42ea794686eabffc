"""The forest against all pairs, its measured depth, and one class of many different near-copies."""

import collections
import itertools
import random

import numpy as np
import pytest

from seqlake.llm import jaccard_join as j


def shingles(text):
    w = (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).lower().split(" ")
    w = [x for x in w if x]
    return frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)])


def slow(texts):
    """{doc_id: (class_id, n_links)} from all pairs that share a shingle."""
    rows = collections.defaultdict(list)
    for i, t in texts.items():
        rows[shingles(t)].append(i)
    sets = list(rows)
    lists = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            lists[x].append(k)
    common = collections.Counter()
    for own in lists.values():
        common.update(itertools.combinations(own, 2))
    near = collections.defaultdict(list)
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            near[a].append(b)
            near[b].append(a)
    out, seen = {}, set()
    for k in range(len(sets)):
        if k in seen:
            continue
        group, todo = [], [k]
        seen.add(k)
        while todo:
            x = todo.pop()
            group.append(x)
            todo += [y for y in near[x] if y not in seen]
            seen.update(near[x])
        head = min(i for x in group for i in rows[sets[x]])
        for x in group:
            for i in rows[sets[x]]:
                out[i] = (head, len(rows[sets[x]]) - 1 + sum(len(rows[sets[y]]) for y in near[x]))
    return out


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_all_pairs_on_whole_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    want = slow({r["doc_id"]: r["text"] for r in docs.collect()})
    have = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in j.jaccard_classes(docs).collect()}
    linked = [i for i in want if want[i][1]]
    assert len(have) == len(want) and len(linked) > 100
    assert sum(have[i] == want[i] for i in linked) >= 0.99 * len(linked)  # a pair at exactly 0.8 may go unseen once in ten thousand
    assert all(have[i][1] <= want[i][1] for i in want)


def test_one_class_of_ten_thousand_near_copies(spark):
    r = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(10_000):
        own = list(base)
        own[r.randrange(0, 100)] = f"a{k}"
        own[r.randrange(100, 200)] = f"b{r.randrange(50)}"
        texts.append((k, " ".join(own)))
    rows = j.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string").repartition(8)).collect()
    assert len(rows) == 10_000 and {x["class_id"] for x in rows} == {0}
    links = {x["doc_id"]: x["n_links"] for x in rows}
    sets = [shingles(t) for _, t in texts]
    for i in r.sample(range(10_000), 20):
        assert links[i] == sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) - 1e-9 for s in sets) - 1


def test_depth_follows_what_is_measured():
    model = [0.8**d for d in range(1, 9)]
    assert j.depth_for(model) == 7 and j.depth_for(model, recall=0.9) == 8 and j.depth_for([x * 0.6 for x in model]) < 7
    assert j.depth_for([0.01] * 8, recall=1.0) == 1


def test_probe_measures_the_chance_of_sharing_a_prefix():
    r, forest = np.random.RandomState(1), j.Forest()
    met = [forest.probe(np.unique(r.randint(0, 1 << 62, n).astype(np.uint64)), 0.8) for n in r.randint(40, 300, 300)]
    share = np.mean(met, axis=0) / j.TREES
    assert np.allclose(share, [0.8**d for d in range(1, 9)], atol=0.03)
    assert forest.probe(np.arange(10, dtype=np.uint64), 0.8) is None


def test_signatures_are_sorted_tries():
    forest = j.Forest()
    one, other = (np.arange(k, k + 90, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (0, 5))
    a, b = forest.signatures(one), forest.signatures(other)
    assert (a >> 56).tolist() == list(range(j.TREES)) and (a > 0).all() and (a == forest.signatures(one[::-1])).all()
    assert 0 < sum((a >> 7 * 7) == (b >> 7 * 7)) < j.TREES


def test_clashing_names_and_one_long_text(spark):
    long = " ".join(f"w{k}" for k in range(400_000))
    rows = [(1, "a b c", 1, 1, 1), (2, "A b  c", 2, 2, 2), (3, long, 3, 3, 3), (4, long + " more", 4, 4, 4), (5, None, 5, 5, 5), (5, None, 5, 5, 5), (None, "", 6, 6, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key long, row_key long, row_id long")
    out = j.drop_near_copies(docs)
    assert out.columns == docs.columns and sorted(tuple(r)[2:] for r in out.collect()) == [(1, 1, 1), (3, 3, 3), (5, 5, 5)]
