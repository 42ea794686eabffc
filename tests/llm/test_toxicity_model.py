"""The learner against a plain one, its calibration, and what it reaches on held-out rows."""

import zlib

import numpy as np
import pytest

from seqlake.llm import toxicity as t


def slow_ftrl(rows, epochs, alpha=t.ALPHA, beta=t.BETA, l1=t.L1, l2=t.L2):
    """FTRL-proximal, one coordinate at a time; 'bias' is not regularised by l1."""
    z, n, order = {}, {}, np.random.RandomState(7)

    def weight(k):
        limit = 0.0 if k == "bias" else l1
        if abs(z.get(k, 0.0)) <= limit:
            return 0.0
        return -(z[k] - np.sign(z[k]) * limit) / ((beta + np.sqrt(n[k])) / alpha + l2)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, own = rows[i]
            own = [*own, "bias"]
            w = {k: weight(k) for k in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for k in own:
                before = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (np.sqrt(before + g * g) - np.sqrt(before)) / alpha * w[k]
                n[k] = before + g * g
    return {k: weight(k) for k in z if weight(k)}


def test_learner_equals_a_plain_one():
    r = np.random.RandomState(1)
    rows = [(int(y), np.unique(np.append(r.randint(0, 60, 12), [100] if y else []).astype(int))) for y in r.rand(150) < 0.3]
    at, weights, bias = t.train(rows, bits=8, epochs=3)
    want = slow_ftrl([(y, x.tolist()) for y, x in rows], 3)
    assert bias == pytest.approx(want.pop("bias")) and dict(zip(at.tolist(), weights.tolist(), strict=True)) == pytest.approx(want) and 100 in want


def test_calibration_finds_the_best_f1():
    r = np.random.RandomState(2)
    rows = [(int(y), np.unique(np.append(r.randint(0, 3000, 30), r.randint(5000, 5040, 2) if y and r.rand() < 0.9 else []).astype(int))) for y in r.rand(600) < 0.1]
    folds = np.arange(600) % 4 + 1
    shift, sums = t.calibrated(rows, folds), np.zeros(600)
    for k in range(1, 5):
        at, w, bias = t.train([x for x, f in zip(rows, folds, strict=True) if f != k])
        table = dict(zip(at.tolist(), w.tolist(), strict=True))
        for i in np.flatnonzero(folds == k):
            sums[i] = bias + sum(table.get(p, 0.0) for p in rows[i][1].tolist())
    labels = np.array([y for y, _ in rows])
    f1 = lambda c: 2 * (labels[sums >= c].sum()) / ((sums >= c).sum() + labels.sum())
    assert f1(-shift) == pytest.approx(max(f1(c) for c in sums))
    assert t.calibrated([(0, np.array([1]))] * 9, np.arange(9) % 3) == 0.0


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    got = t.score_toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() > 0.85 and clean.predicted.mean() < 0.01
    # the other four fifths of the labels alone decide
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    again = t.score_toxicity(docs, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(again.loc[got.doc_id], got.score)
