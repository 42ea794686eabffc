"""The risk-controlled cutoffs against a slow recomputation, and what they promise."""

import math
import zlib

import numpy as np
import pytest

from seqlake.llm import quality_rules as q


def binomial_at_most(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def slow_settings(rows):
    """The chain and the certified setting of each stratum, from rows (id, stratum, label, {rule: figure})."""
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, *_ in rows}
    design, chain, cut = [r for r in rows if fold[r[0]] < 2], [], {}
    while True:
        best = None
        for rule, (_, grid) in q.RULES.items():
            for c in sorted((c for c in grid if c < cut.get(rule, math.inf)), reverse=True):
                gain, loss = (sum(c < r[3][rule] <= cut.get(rule, math.inf) for r in design if r[2] == label) for label in (0, 1))
                if gain and (best is None or gain / (loss + 0.5) > best[0]):
                    best = gain / (loss + 0.5), rule, c
        if best is None:
            break
        cut[best[1]] = best[2]
        chain.append(best[1:])
    good = [r for r in rows if fold[r[0]] >= 2 and r[2] == 1]
    size = {s: sum(r[1] == s for r in good) for s in {r[1] for r in good}}
    first = sum(0.98**n <= 0.05 for n in size.values()) + 1
    named = {s: s if 0.98**n <= 0.05 / first else None for s, n in size.items()}
    strata, found, done = set(named.values()), {}, set()
    while True:
        error = 0.05 / (len(strata) - len(done)) if len(strata) > len(done) else 0.05
        for s in strata:
            own, found[s] = [r for r in good if named[r[1]] == s], 0
            for k in range(1, len(chain) + 1):
                lost = sum(any(r[3][rule] > c for rule, c in chain[:k]) for r in own)
                if binomial_at_most(lost, len(own), 0.02) > error:
                    break
                found[s] = k
        now = {s for s in strata if found[s] == len(chain)}
        if len(now) <= len(done) or now == strata:
            return chain, {s: found[named[s]] for s in named}
        done = now


@pytest.fixture(scope="module")
def judged(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = q.judge_quality(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").join(labels.select("doc_id", "quality"), "doc_id", "left")
    return out.toPandas()


def test_cutoffs_equal_a_slow_recomputation(judged):
    """Every verdict on sf0.1, from cutoffs found by counting."""

    def figures(r):
        n = max(r.n_words, 1)
        return {"symbols": r.n_symbols / max(r.word_chars, 1), "lines": r.n_dup_lines / n, "repeats": r.n_repeat_words / n, "long_words": r.word_chars / n, "short_words": -r.word_chars / n}

    fine = [r for r in judged.itertuples() if not r.base_failed]
    chain, furthest = slow_settings([(r.doc_id, r.lang, int(r.quality), figures(r)) for r in fine if r.quality == r.quality])
    for r in fine:
        f = figures(r)
        want = next((rule for rule, c in chain[: furthest.get(r.lang, 0)] if f[rule] > c), None)
        assert (r.rejected_by if isinstance(r.rejected_by, str) else None) == want


def test_the_method_rejects_bad_texts_and_keeps_its_promise(judged):
    fine = judged[~judged.base_failed & judged.quality.notna()]
    bad, good = fine[fine.quality == 0], fine[fine.quality == 1]
    assert (~bad.kept).sum() > 200
    for _, own in good[[zlib.crc32(str(i).encode()) % 5 >= 2 for i in good.doc_id]].groupby("lang"):
        assert (~own.kept).mean() <= q.MAX_FALSE


def test_the_promise_over_many_holdouts():
    """A rule that rejects 3 % of good texts is let through in at most 5 % of holdouts; one of 0.2 % mostly."""
    r = np.random.RandomState(1)
    for rate, low, high in ((0.03, 0.0, 0.05), (0.002, 0.9, 1.0)):
        through = np.mean([q.furthest([x], 800 - x, 0.02, 0.05) for x in r.binomial(800, rate, 1000)])
        assert low <= through <= high


def test_binomial_tail():
    for n, p in ((1, 0.3), (50, 0.02), (400, 0.02), (900, 0.5)):
        for k in (0, 1, n // 3, n - 1, n):
            assert q.at_most(k, n, p) == pytest.approx(binomial_at_most(k, n, p), rel=1e-9, abs=1e-12)
    assert q.at_most(10**9 // 60, 10**9, 0.02) < 1e-6  # no list of as many terms


def test_strata_too_small_to_show_anything(spark):
    words = "the quick brown fox jumps over lazy dogs while seven green birds sing near old stone walls"
    rows = [(i, f"{words} {i}" + (" ####################" if i % 4 == 0 else ""), "big" if i < 780 else "small") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, *_ in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in q.judge_quality(docs, labels).collect()}
    assert len(got) == 800 and all(got[i] == (i % 4 > 0 or i >= 780) for i in got)
