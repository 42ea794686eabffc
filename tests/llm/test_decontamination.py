"""Contamination search against brute force, and the cases that a single window or one odd value could hide."""

import collections
import random

import pytest
import regex

from seqlake.llm import decontamination as d


def words_of(text):
    """(plain word, kind of slot or None) of a text."""
    out, start, number_before = [], True, False
    for raw in regex.split(r"[\x20\x09-\x0D]+", text):
        if not raw:
            continue
        w = raw.strip(d.MARKS)
        ends = regex.search(r"[.!?:]['\")\]]*$", raw) is not None
        if regex.search(r"[\p{L}\p{N}]", w):
            number = regex.search(r"^[+-]?\p{Nd}[\p{Nd}.,:/]*\p{L}{0,3}%?$", w) is not None
            unit = number_before and w.lower() in d.UNITS
            name = regex.search(r"^\p{Lu}", w) is not None and not start and not number and not unit
            out.append((w.lower(), "number" if number else "unit" if unit else "name" if name else None))
            number_before = number
        start = ends
    return out


def windows_of(words, size, whole):
    """(hash, place, slot values or None for word for word, literal place)."""
    for a in range(len(words) - size + 1):
        if whole and len(words) != size:
            continue
        part = words[a : a + size]
        slots = sum(k is not None for _, k in part)
        literal = size - slots >= d.LEAST_LITERAL
        if literal or not slots:
            yield (size, tuple(w if k is None else f"<{k}>" for w, k in part)), a, tuple(w for w, k in part if k) if slots else (), literal
        if slots:
            yield (size, tuple(w for w, _ in part)), a, (), literal


def slow(docs, items):
    """{(doc_id, item_id): (windows, share, first_word, last_word)}"""
    ours = {}
    shorts = set()
    for _, text in items:
        n = len(words_of(text or ""))
        if 0 < n < d.WINDOW:
            shorts.add(n)
    for i, text in docs:
        w = words_of(text or "")
        index = collections.defaultdict(list)
        for size in [d.WINDOW, *shorts]:
            for h, at, slots, _ in windows_of(w, size, size < d.LEAST_LITERAL):
                index[h].append((at, slots))
        ours[i] = index
    out = {}
    for item, text in items:
        w = words_of(text or "")
        if not w:
            continue
        size = min(len(w), d.WINDOW)
        theirs = list(windows_of(w, size, size < d.WINDOW))
        literal = {at: x for _, at, _, x in theirs}
        for i, index in ours.items():
            aligned = collections.defaultdict(list)
            for h, at, slots, _ in theirs:
                for place, values in index.get(h, ()):
                    aligned[place - at].append((at, place, set(zip(slots, values, strict=True)) if slots and values else set(), bool(slots and values)))
            places, low, high = set(), [], []
            for hits in aligned.values():
                pairs = set().union(*(p for _, _, p, _ in hits))
                fine = len({x for x, _ in pairs}) == len(pairs)
                used = [x for x in hits if fine or not x[3]]
                places |= {x[0] for x in used}
                low += [x[1] for x in used]
                high += [x[1] for x in used]
            told = sum(literal[p] for p in places)
            share = max(len(places) / (len(w) - size + 1), told / sum(literal.values()) if told >= d.LEAST_TEMPLATES else 0)
            if places and share >= d.LEAST_SHARE:
                out[i, item] = max(out.get((i, item), (0,)), (share, len(places), min(low), max(high) + size - 1))
    return {k: (v[1], pytest.approx(v[0]), v[2], v[3]) for k, v in out.items()}


def got(spark, docs, items):
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["windows"], r["share"], r["first_word"], r["last_word"]) for r in d.find_contamination(a, b).collect()}


def test_brute_force_on_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    r = random.Random(3)
    for k, (_, text) in enumerate(items[:40]):  # copies with other values, other words, pieces
        w = text.split()
        for _ in range(3):
            w[r.randrange(len(w))] = r.choice(["12", "Anna", "word", "7", "kg"])
        docs.append((10_000 + k, "so it reads: " + " ".join(w[r.randrange(3) :])))
    items += [(900 + k, " ".join(r.choice(["Anna", "has", "12", "kg", "of", "apples", "now", "left"]) for _ in range(r.randrange(1, 14)))) for k in range(20)]
    docs += [(20_000 + k, " ".join(r.choice(["Anna", "has", "13", "kg", "of", "apples", "now", "left"]) for _ in range(r.randrange(1, 60)))) for k in range(60)]
    want = slow(docs, items)
    have = got(spark, docs, items)
    assert len(want) > 20 and {k: (v, want.get(k)) for k, v in have.items() if v != want.get(k)} == {} and set(have) == set(want)


def test_short_items(spark):
    items = [(1, "What is the capital of France"), (2, "yes"), (3, "true story"), (4, "Count the 12 red apples now")]
    docs = [(1, "He asked: what is the capital of france? I do not know."), (2, "yes and no and yes again in a text"), (3, "Yes."), (4, "we count the 99 red apples now and then"), (5, "what is the capital city of France"), (6, "true story!")]
    assert set(got(spark, docs, items)) == {(1, 1), (3, 2), (4, 4), (6, 3)}


def test_templates_dense_in_slots(spark):
    """Windows with many slots say nothing by themselves; those that do decide."""
    item = "Anna Bob and Carl and 12 and 13 and 14 and 15 kg 16 kg 17 kg walk slowly over the old stone bridge to town and back home again"
    other = item.replace("Anna", "Mia").replace("Bob", "Tom").replace("Carl", "Udo")
    for n in range(12, 18):
        other = other.replace(str(n), str(n + 50))
    assert set(got(spark, [(1, "then " + other), (2, "and 12 and 13 and 14 and 15 kg 16 kg")], [(1, "see " + item)])) == {(1, 1)}


def test_items_with_equal_texts(spark):
    text = "one benchmark question of more than eight plain words that nobody else asks"
    items = [(k, text) for k in range(50)] + [(7, "another text of the same item with more than eight words in it")]
    assert set(got(spark, [(1, text), (1, text), (2, "none")], items)) == {(1, k) for k in range(50)}


def test_clashing_names_and_long_text(spark):
    text = "one benchmark question of more than eight plain words that nobody else asks"
    long = "the quick brown fox jumps over the lazy dog . " * 200_000 + text
    docs = spark.createDataFrame([(1, text, 5, 6, 7), (2, "clean", 5, 6, 7), (3, long, 1, 2, 3), (4, None, 1, 2, 3)], "doc_id long, text string, __key long, row_key long, row_id long")
    out = d.drop_contaminated(docs, spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(2, "clean", 5, 6, 7), (4, None, 1, 2, 3)]
