"""Disclosing terms against a plain count over all texts, identifiers in long texts, and what terms become."""

import collections
import math
import re
import time

import pytest
import regex

from seqlake.llm import pii

DATA = "/root/testdata/sf0.001"


def slow(texts, base, generalise=pii.GENERALISE, remove=pii.REMOVE):
    """{doc_id: [(kind, start, end)]} of terms, from the texts and their identifiers (kind, start, end, value)."""
    free = {}
    for i, t in texts.items():
        out = list(t)
        for _, a, b, _ in base[i]:
            out[a:b] = " " * (b - a)
        free[i] = "".join(out)
    words = {i: {w.lower() for w in regex.findall(r"[\p{L}\p{N}]{3,}", t)} for i, t in free.items()}
    entities = {i: {f"{k}:{v}" for k, _, _, v in b} for i, b in base.items()}
    held = collections.Counter(x for e in entities.values() for x in e)
    held = {c: n for c, n in held.items() if n < len(texts)}
    seen = collections.Counter(w for own in words.values() for w in own)
    joint = collections.Counter((w, c) for i in texts for c in entities[i] if c in held for w in words[i])
    chosen = {}
    for (w, c), n in joint.items():
        p = held[c] / len(texts)
        told = 1 + math.log((n + p) / (seen[w] + 1)) / -math.log(p)
        if abs(told - generalise) > 1e-9 and told >= generalise:
            chosen[w] = max(chosen.get(w, 0), told)
    out = {}
    for i, t in free.items():
        hits = [("remove" if chosen[w] >= remove else "general", m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]{3,}", t) if (w := m[0].lower()) in chosen]
        out[i] = sorted(hits)
    return out


@pytest.mark.parametrize("limit", [pii.BROADCAST_ROWS, 0])
def test_terms_on_a_whole_table(spark, limit):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = pii.find_pii(docs, broadcast_rows=limit).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    base = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in rows}
    want = slow(texts, base)
    assert sum(map(len, want.values())) > 100
    assert {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["terms"]] for r in rows} == want
    for r in rows:
        assert all(texts[r["doc_id"]][s["start"] : s["end"]].lower() == s["value"] for s in r["terms"])


def test_what_terms_become(spark):
    spans = [("general", 0, 4, ""), ("general", 5, 9, ""), ("general", 10, 14, ""), ("general", 15, 19, ""), ("remove", 20, 24, ""), ("email", 25, 32, "")]
    df = spark.createDataFrame([("Anna 1234 AB12 word gone a@b.org end", spans)], f"text string, spans {pii.SPAN}")
    assert df.select(pii.replaced(df.text, df.spans)).first()[0] == "<NAME> <NUMBER> <CODE> <TERM>  <EMAIL> end"


def test_many_identifiers_in_one_text(spark):
    took = []
    for n in (4_000, 16_000):
        text = " ".join(f"{k % 10}.2.3.4 and {k} 12 {k}" for k in range(n)) + " a@b.org"
        df = spark.createDataFrame([(1, text, 1, 2, 3)], "doc_id long, text string, __key long, row_spans long, base long")
        start = time.perf_counter()
        r = pii.find_pii(df).first()
        took.append(time.perf_counter() - start)
        assert len(r["base"]) == n + 1
        at = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", text)]
        assert [(s["start"], s["end"]) for s in r["base"] if s["kind"] == "ip"] == at
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.first()["text"].count("<IP>") == 16_000
    assert took[1] < 8 * took[0] + 2


def test_long_numbers_are_no_cards(spark):
    text = "4111111111111111, " + "4" * 5000 + ", 4111-1111-1111-1111, 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5, 4111111111111111 4111111111111111"
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == [("card", 0, 16), ("card", 5020, 5039)]
