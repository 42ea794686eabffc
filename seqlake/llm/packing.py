"""Packing tokenised documents into fixed-length training sequences.

An order-preserving dynamic programme chooses the cuts. Candidates are document ends, sentence ends
and, inside long sentences, regular token positions; the cost of a sequence is its padding plus a
penalty for the kind of cut that ends it. A sequence holds at most `capacity` tokens, so the best
predecessor of a cut is a minimum over a sliding window: a monotone queue gives it in constant time.
Sequences whose length is a power of two need no padding and are tried as extra transitions.

Documents keep the order of their partition; no shuffle takes place. Each partition is packed by
itself in blocks of bounded size, so memory does not depend on the partition, and a lost task is
repeated from its input. The input must give the same rows in the same order when it is read again,
as a file scan does.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .words import KEPT, slices, split_words, texts_of

CAPACITY, END_ID = 2048, 1
SENTENCE_PENALTY, WORD_PENALTY, SEQUENCE_COST = 2.0, 32.0, 8.0
LONG_SENTENCE, STEP = 192, 32
BLOCK = 64 * CAPACITY

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """Indexes into `positions` where sequences end, at least cost.

    positions[0] is the start; each step between neighbours is at most `capacity`. penalties[i] is
    what a cut at positions[i] costs. Runs in time linear in the number of candidates.
    """
    m = len(positions) - 1
    if m <= 0:
        return []
    p, pen = positions.tolist(), penalties.tolist()
    exact: dict[int, list[int]] = {}
    length = 64
    while length < capacity:
        at = np.searchsorted(positions, positions - length)
        for i in np.flatnonzero((positions - length >= p[0]) & (positions[np.minimum(at, m)] == positions - length)).tolist():
            exact.setdefault(i, []).append(int(at[i]))
        length *= 2
    cost, key, back = [0.0] * (m + 1), [0.0] * (m + 1), [0] * (m + 1)
    key[0] = float(p[0])
    queue = deque([0])
    for i in range(1, m + 1):
        x = p[i]
        while p[queue[0]] < x - capacity:
            queue.popleft()
        j = queue[0]
        best = key[j] + capacity - x
        if i in exact:
            for e in exact[i]:
                if cost[e] < best:
                    best, j = cost[e], e
        best += pen[i] + SEQUENCE_COST
        cost[i], back[i] = best, j
        k = key[i] = best + x
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(i)
    out, i = [], m
    while i:
        out.append(i)
        i = back[i]
    return out[::-1]


def ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[first : first + size] one after another, and where each begins and the last ends."""
    at = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=at[1:])
    index = np.repeat(first - at[:-1], size)
    index += np.arange(at[-1], dtype=np.int32)
    return flat[index], at


class Tokens:
    """Ids of whole texts, by the library on distinct words.

    The vocabulary drops white space, splits letters from punctuation and reads upper case as lower,
    so a text's ids are those of its words one after another, and a word's those of its stem and of
    the punctuation after it. At most `limit` stems are kept between slices.
    """

    JOINED = 400

    def __init__(self, path: str, limit: int = 900_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size, self.ends = (np.zeros(1 << 16, t) for t in (np.int32, np.int32, bool))

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.number), len(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n + m > len(self.first):
            self.first, self.size, self.ends = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.size, self.ends))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[n : n + m] = np.cumsum(sizes) - sizes + self.used
        self.size[n : n + m] = sizes
        self.ends[n : n + m] = [w.endswith((".", "!", "?")) for w in words]
        self.number.update(zip(words, range(n, n + m), strict=True))
        self.used += len(ids)

    def _encode(self, words: list[str]) -> None:
        """By the library: words of letters many at a time, where each ends with an end-of-word token."""
        plain = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        groups = [plain[i : i + self.JOINED] for i in range(0, len(plain), self.JOINED)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(x) for x in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                self._keep(group, ids, np.diff(ends, prepend=0))
            else:
                rest += group
        if rest:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            self._keep(rest, np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found]))

    def _learn(self, words: list[str]) -> None:
        known = self.number
        whole, cut, parts = [], [], []
        for w in words:
            s = w.rstrip(".,!?;:")
            if len(s) < len(w) and s[-1:].isalnum() and not s[-1].isupper():
                cut.append(w)
                parts += (s, w[len(s) :])
            else:
                whole.append(w)
        self._encode(list(dict.fromkeys(w for w in (*whole, *parts) if w not in known)))
        if cut:
            at = np.array([known[x] for x in parts], np.int64)
            ids, bounds = ragged(self.flat, self.first[at], self.size[at])
            self._keep(cut, ids, bounds[2::2] - bounds[:-1:2])

    def _numbers(self, words: list[str]) -> np.ndarray:
        known = self.number
        try:
            return np.array([known[w] for w in words], np.int64)
        except KeyError:
            new = [w for w in words if w not in known]
        if len(known) + len(new) > self.limit:
            self._clear()
            known, new = self.number, [w for w in words if w]
        self._learn(new)
        return np.array([known[w] for w in words], np.int64)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text, and the positions in them where a sentence ends."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens have a case
            texts = pc.ascii_lower(texts)
        codes, offsets, words = split_words(texts)
        pieces = self._numbers(words.to_pylist())[codes]
        ids, at = ragged(self.flat, self.first[pieces], self.size[pieces])
        stop = at[1:][self.ends[pieces]]
        bounds = at[offsets]
        till = np.searchsorted(stop, bounds, side="right")
        for r in range(len(offsets) - 1):
            a, b = bounds[r], bounds[r + 1]
            yield ids[a:b], stop[till[r] : till[r + 1]] - a


READY: dict[str, Tokens] = {}
KEPT["packing"] = READY


def tokens_of(path: str) -> Tokens:
    """The tokens of a file, kept by a worker for its next tasks: their words are mostly the same. One file at a time."""
    if path not in READY:
        READY.clear()
        READY[path] = Tokens(path)
    return READY[path]


class Packer:
    """Takes documents in order and gives the rows of finished sequences."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.sequence = capacity, first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: deque = deque()  # document, its number of tokens, its ids before the buffer's first
        self.positions: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.penalties: list[np.ndarray] = [np.zeros(1)]
        self.held = 0

    def add(self, doc, ids: np.ndarray, sentence_ends: np.ndarray) -> list[tuple]:
        ids = np.append(ids, np.uint32(END_ID))
        n = len(ids)
        marks = np.concatenate(([0], sentence_ends[sentence_ends < n - 1], [n]))
        gaps = np.diff(marks)
        extra = [np.arange(marks[i] + STEP, marks[i + 1], STEP) for i in np.flatnonzero(gaps > LONG_SENTENCE)]
        cuts, pen = marks[1:], np.full(len(marks) - 1, SENTENCE_PENALTY)
        if extra:
            between = np.concatenate(extra)
            cuts, pen = np.concatenate((cuts, between)), np.concatenate((pen, np.full(len(between), WORD_PENALTY)))
            order = np.argsort(cuts, kind="stable")
            cuts, pen = cuts[order], pen[order]
        pen[-1] = 0.0
        self.docs.append((doc, n, 0))
        out, done = [], 0
        while done < n:  # a long document goes in by blocks
            take = n if n - done + self.held <= BLOCK else int(cuts[max(np.searchsorted(cuts, done + max(1, BLOCK - self.held), side="right") - 1, np.searchsorted(cuts, done, side="right"))])
            part = slice(np.searchsorted(cuts, done, side="right"), np.searchsorted(cuts, take, side="right"))
            self.positions.append(cuts[part] - done + self.held)
            self.penalties.append(pen[part])
            self.ids.append(ids[done:take])
            self.held += take - done
            done = take
            if self.held >= BLOCK:
                out += self.flush(False)
        return out

    def flush(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        positions, penalties = np.concatenate(self.positions), np.concatenate(self.penalties)
        ids = np.concatenate(self.ids)
        cuts = choose_cuts(positions, penalties, self.capacity)
        if not last and len(cuts) > 1:
            cuts = cuts[:-1]  # what follows may still join the last sequence
        data, out, start = ids.astype("<u4").tobytes(), [], 0
        for c in cuts:
            end, offset = int(positions[c]), 0
            while start < end:
                doc, n, before = self.docs[0]
                k = min(end - start, n - before)
                out.append((doc, before, k, zlib.crc32(data[4 * start : 4 * (start + k)]), n, self.sequence, offset))
                start, offset = start + k, offset + k
                if before + k == n:
                    self.docs.popleft()
                else:
                    self.docs[0] = (doc, n, before + k)
            self.sequence += 1
        k = cuts[-1]
        self.positions, self.penalties = [positions[k:] - start], [penalties[k:]]
        self.ids, self.held = [ids[start:]], self.held - start
        return out


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document: which of its ids went where.

    tokenizer: path of a tokenizers file, the same on all machines. A null text is an empty one; an
    empty text is its end id alone. A null id stays null; repeated rows are packed one by one;
    an empty table gives no rows; columns other than the two are ignored. Ties between equally good
    cuts go to the earlier predecessor.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        tokens, packer = tokens_of(tokenizer), Packer((task.partitionId() if task else 0) << 40, capacity)
        for batch in slices(batches, "text", 8 << 20, "packing"):
            out = []
            for doc, (ids, ends) in zip(batch.column("id").to_pylist(), tokens(texts_of(batch)), strict=True):
                out += packer.add(doc, ids, ends)
            if out:
                yield rows(out)
        if out := packer.flush(True):
            yield rows(out)

    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    plain = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].cast("string").alias("text"))
    return plain.mapInArrow(run, SCHEMA)
