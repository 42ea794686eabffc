"""The byte model against Kneser-Ney written out from its definition, and its thresholds."""

import collections
import math
import zlib

import numpy as np
import pytest

from seqlake.llm import quality_lm as q


def slow_model(texts):
    """P(byte | context) of an interpolated modified Kneser-Ney model, from dictionaries of n-grams."""
    counts = [None] * (q.ORDER + 1)
    counts[q.ORDER] = collections.Counter()
    for t in texts:
        data = bytes([q.PAD] * (q.ORDER - 1)) + t.encode()
        counts[q.ORDER].update(data[i : i + q.ORDER] for i in range(len(data) - q.ORDER + 1))
    for order in range(q.ORDER - 1, 0, -1):
        counts[order] = collections.Counter(g[1:] for g in counts[order + 1])
    model = {}
    for order in range(1, q.ORDER + 1):
        n = [sum(c == k for c in counts[order].values()) for k in range(5)]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] else 0.75 for k in (1, 2, 3)]
        else:
            d = [0.5, 0.75, 0.9]
        totals, taken = collections.Counter(), collections.Counter()
        for g, c in counts[order].items():
            totals[g[:-1]] += c
            taken[g[:-1]] += d[min(c, 3) - 1]
        model[order] = counts[order], d, totals, taken

    def p(byte, context):
        order = len(context) + 1
        grams, d, totals, taken = model[order]
        lower = p(byte, context[1:]) if context else 1 / 256
        if not totals[context]:
            return lower
        c = grams[context + bytes([byte])]
        return (c - d[min(c, 3) - 1] if c else 0) / totals[context] + taken[context] / totals[context] * lower

    return p


@pytest.mark.parametrize("limit", [q.BROADCAST_ROWS, 0])
def test_perplexities_equal_the_definition(spark, limit):
    r = np.random.RandomState(4)
    texts = {i: " ".join("".join(r.choice(list("aeinrstéß"), 1 + i % 5)) for _ in range(12)) for i in range(90)}
    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in texts], "doc_id long, quality int")
    p = slow_model([t for i, t in texts.items() if i % 3 and not out(i)])
    for row in q.judge_perplexity(df, labels, broadcast_rows=limit).collect():
        data = bytes([q.PAD] * (q.ORDER - 1)) + texts[row["doc_id"]].encode()
        logs = [math.log(p(data[k], data[k - q.ORDER + 1 : k])) for k in range(q.ORDER - 1, len(data))]
        assert row["perplexity"] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-9)


def test_both_ways_of_scoring_decide_alike(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    a, b = ({r["doc_id"]: r["kept"] for r in q.judge_perplexity(docs, labels, broadcast_rows=n).collect()} for n in (q.BROADCAST_ROWS, 0))
    assert a == b


def test_thresholds_by_language(spark):
    r = np.random.RandomState(5)
    rows = [("a", 1, x) for x in r.normal(1, 0.1, 200)] + [("b", 1, x) for x in r.normal(3, 0.3, 200)] + [("c", 1, x) for x in r.normal(1, 0.1, 10)] + [("a", 0, 2.0)] * 30 + [("b", 0, 6.0)] * 30
    limits, others = q.thresholds(spark.createDataFrame([(k, y, float(x)) for k, y, x in rows], "language string, label int, x double"))
    limits = {x["language"]: math.log(x["threshold"]) for x in limits.collect()}
    assert set(limits) == {"a", "b"} and 1.2 < limits["a"] < 2 and 3.6 < limits["b"] < 6 and others is not None
    empty, none = q.thresholds(spark.createDataFrame([], "language string, label int, x double"))
    assert empty.count() == 0 and none is None


def test_more_languages_than_any_cap(spark):
    r = np.random.RandomState(6)
    rows = [(f"l{k}", 1, float(x)) for k in range(90) for x in r.normal(k, 0.1, 60)]
    limits, _ = q.thresholds(spark.createDataFrame(rows, "language string, label int, x double"))
    assert limits.count() == 90


def test_what_is_kept_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    rows = q.judge_perplexity(docs, labels).join(labels, "doc_id").select("quality", "kept").toPandas()
    assert rows[rows.quality == 0].kept.mean() < 0.05 and rows[rows.quality == 1].kept.mean() > 0.98
