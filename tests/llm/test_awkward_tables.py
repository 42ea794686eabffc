"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import json

import pytest

from seqlake.llm import chat_format, decontamination, html_text, jaccard_join, packing, pii, quality_lm, quality_rules, token_counts, toxicity

pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

LONG = "the quick brown fox jumps over the lazy dog near the old mill . " * 2000
TEXTS = ["", None, " \t\n", "one", "same words in this short text here", "same words in this short text here", LONG, "write to a@b.org or call +1 743 555 3824 today"]
#: Names that the operators use inside.
CLASHING = "key long, `set` string, label string, prefix string, hash long, at string, base string, terms string, language string, stratum string, perplexity string, score string, kind string, id string, `a.b` string"
EXTRA = (None, "s", "l", "p", 4, "x", "b", "t", "g", "r", "q", "c", "k", "i", "d")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "web", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, None, None, None, None), (None, "text without an id", None, None, 5)]
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").checkpoint()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0, "x"), (4, 1, 1, None), (6, 1, 0, "x"), (6, 0, 1, "x"), (None, 1, 1, "x"), (5, None, None, "x"), (77, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def benchmark(spark):
    item = "one benchmark question of more than eight plain words that nobody else asks"
    return spark.createDataFrame([(1, item, "k"), (1, item, "k"), (None, item, "k"), (2, None, None), (3, "", "k")], "item_id long, text string, doc_id string")


def operators(docs, labels, benchmark):
    return {
        "packing": packing.pack(docs, public.path("word_bpe_49k.json")),
        "pii": pii.find_pii(docs),
        "decontamination": decontamination.find_contamination(docs, benchmark),
        "token_counts": token_counts.count_tokens(docs, public.path("byte_bpe_50k.json")),
        "jaccard_join": jaccard_join.jaccard_classes(docs),
        "toxicity": toxicity.score_toxicity(docs, labels),
        "quality_lm": quality_lm.judge_perplexity(docs, labels),
        "quality_rules": quality_rules.judge_quality(docs, labels),
    }


def stages(docs, labels, benchmark):
    return {
        "quality": quality_lm.drop_low_quality(docs, labels),
        "near_copies": jaccard_join.drop_near_copies(docs),
        "decontamination": decontamination.drop_contaminated(docs, benchmark),
        "pii": pii.sanitise(docs),
    }


def test_operators_take_every_row(docs, labels, benchmark):
    n = docs.count()
    got = {name: out.collect() for name, out in operators(docs, labels, benchmark).items()}
    assert got.pop("decontamination") == []
    by = [(r["doc_id"], r["start"]) for r in got.pop("packing")]
    assert sum(start == 0 for _, start in by) == n and {i for i, _ in by} == {*range(len(TEXTS)), None}
    for name, rows in got.items():
        assert len(rows) == n, name
        assert sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 3 for r in rows) == 3, name
    classes = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got["jaccard_join"] if r["doc_id"] is not None}
    assert classes[4] == classes[5] == (4, 1) and classes[3] == (3, 2) and classes[0] == classes[1] == classes[2] == (0, 3)
    assert {r["n_tokens"] for r in got["token_counts"] if r["doc_id"] in (0, 1)} == {0}
    assert all(r["kept"] is False and r["base_failed"] for r in got["quality_rules"] if r["doc_id"] in (0, 1, 2, 3))


def test_stages_keep_columns(docs, labels, benchmark):
    n = docs.count()
    for name, out in stages(docs, labels, benchmark).items():
        rows = out.collect()
        assert out.columns == docs.columns, name
        ids = [r["doc_id"] for r in rows]
        if name in ("decontamination", "pii"):
            assert len(rows) == n, name
        if name == "pii":
            assert {r["text"] for r in rows if r["doc_id"] == 7} == {"write to <EMAIL> or call <PHONE> today"} and [r["text"] for r in rows if r["doc_id"] == 1] == [None]
        if name == "near_copies":
            assert sorted(x for x in ids if x is not None) == [0, 3, 4, 6, 7] and ids.count(None) == 1
        if name == "quality":
            assert not {0, 1} & set(ids)


def test_empty_tables(docs, labels, benchmark):
    none = docs.limit(0)
    for name, out in (operators(none, labels, benchmark) | stages(none, labels, benchmark)).items():
        assert out.count() == 0, name


def test_without_labels_and_items(docs, labels, benchmark):
    n = docs.count()
    for name, out in operators(docs, labels.limit(0), benchmark.limit(0)).items():
        assert out.select("doc_id").distinct().count() == (0 if name == "decontamination" else len(TEXTS) + 1), name
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert decontamination.drop_contaminated(docs, benchmark.limit(0)).count() == n


def test_pages_and_chats(spark):
    pages = [(1, "u", "<p>" + "long text of a page " * 30000 + "</p>", "x"), (1, "u", None, None), (None, None, "", "x"), (2, "u", "plain <b>", "x"), (2, "u", "plain <b>", "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = html_text.extract_text(df)
    assert got.count() == 5 and all(r["n_chars"] == len(r["text"]) for r in got.collect()) and html_text.extract_text(df.limit(0)).count() == 0
    call = json.dumps({"tool_calls": [{"id": "c", "name": "f", "arguments": {"x": "y" * 50000}}, {"id": None, "name": None, "arguments": None}]})
    chats = [(1, 0, "assistant", call, "k"), (1, 0, "assistant", call, "k"), (1, 1, "tool", None, None), (None, 1, None, "", "k"), (1, None, "tool", '{"tool_call_id": "c"}', "k"), (2, 0, "user", "é" * 50000, "k")]
    df = spark.createDataFrame(chats, "conv_id long, turn long, role string, text string, kind string")
    rows = chat_format.format_chats(df).collect()
    assert len(rows) == 8 and sum(r["kind"] == "call" for r in rows) == 4
    assert [r["json"] for r in rows if r["conv_id"] == 2] == [json.dumps({"content": "é" * 50000, "role": "user"}, ensure_ascii=False, separators=(",", ":"))]
    assert all(r["json"] is not None for r in rows)
