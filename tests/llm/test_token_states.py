"""Counts stay right while the transducer's states are dropped and compiled anew."""

import random

import pyarrow as pa
import pytest

from seqlake.llm import token_counts

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("most", [1, 7, 64, 1000])
def test_few_states(monkeypatch, most):
    monkeypatch.setattr(token_counts, "MAX_STATES", most)
    path, r = public.path("byte_bpe_50k.json"), random.Random(most)
    counter, library = token_counts.TokenCounter(path), tokenizers.Tokenizer.from_file(path)
    texts = ["", *(" ".join("".join(r.choice("abcdeéß漢 ") for _ in range(r.randint(1, 30))) for _ in range(20)) for _ in range(40)), *("".join(r.choice("etaoinäö日") for _ in range(4000)) for _ in range(4))]
    assert counter(pa.array(texts, pa.large_string())).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
