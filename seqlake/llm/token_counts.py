"""Token counts of whole texts by finite-state transducers.

Two deterministic transducers, compiled from a byte-level BPE vocabulary, do the work.

* The splitter reads classes of code points and marks where the vocabulary's pattern cuts a text
  into pieces. Its input is cut into chunks of equal length; the state map of each chunk (final state
  for every state it may start in) is found for all chunks at once, the maps compose through a
  parallel prefix scan, and a second pass over the chunks, now with known first states, writes marks.
* The counter reads the bytes of one piece. A state is what later merges can still depend on: for
  each suffix of the bytes read that begins some token, its place in the vocabulary's trie, the token
  before it and the tokens counted there. Each transition carries the number of tokens it adds, which
  can be negative when a token grows. Exactly one division of each prefix has only neighbours that
  merging keeps apart, so a transition is determined. States are compiled when first met, kept in a
  table of bounded size, and dropped together when it is full.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import KEPT, slices, texts_of

OVER = 1024
CHUNK, WARM = 256, 6
MAX_STATES = 1 << 17

# Classes of code points, and the splitter's states.
LETTER, SUFFIX, R, E, V, LL, NUMBER, SPACE, BLANK, QUOTE, OTHER, END = range(12)
START, WORD, DIGITS, SIGNS, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L, ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK = range(12)
HERE, BEFORE = 1, 2  # a piece begins at this code point; at the one before it


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks, at state * 16 + class."""
    step, marks = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    letters = (LETTER, SUFFIX, R, E, V, LL)
    run = {**dict.fromkeys(letters, WORD), NUMBER: DIGITS, OTHER: SIGNS, QUOTE: QUOTED, SPACE: ONE_SPACE, BLANK: ONE_BLANK, END: START}
    pending = {QUOTE_R: E, QUOTE_V: E, QUOTE_L: LL}
    for state in range(12):
        for kind in range(12):
            to, mark = run[kind], HERE * (kind != END)
            if state in pending:
                if kind == pending[state]:
                    to, mark = START, 0
                else:
                    mark |= BEFORE
                    mark &= ~HERE if kind in letters else ~0
            elif state == QUOTED:
                if kind == SUFFIX:
                    to, mark = START, 0
                elif kind in (R, V, LL):
                    to, mark = {R: QUOTE_R, V: QUOTE_V, LL: QUOTE_L}[kind], 0
                elif kind in (OTHER, QUOTE):
                    to, mark = SIGNS, 0
            elif state == WORD and kind in letters or state == DIGITS and kind == NUMBER:
                mark = 0
            elif state == SIGNS and kind in (OTHER, QUOTE):
                to, mark = SIGNS, 0
            elif state in (ONE_SPACE, ONE_BLANK, MORE_SPACE, MORE_BLANK):
                if kind in (SPACE, BLANK):
                    to, mark = MORE_SPACE if kind == SPACE else MORE_BLANK, 0
                elif kind != END:
                    if state in (ONE_SPACE, MORE_SPACE):  # the space goes with what follows
                        mark, to = 0, SIGNS if kind == QUOTE else to
                    if state in (MORE_SPACE, MORE_BLANK):
                        mark |= BEFORE
            step[state * 16 + kind], marks[state * 16 + kind] = to, mark
    return step, marks


def code_point_classes() -> np.ndarray:
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", BLANK)):
        found = "".join(regex.findall(pattern + "+", everything))
        kinds[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    for letters, kind in (("stmd", SUFFIX), ("r", R), ("e", E), ("v", V), ("l", LL), (" ", SPACE), ("'", QUOTE)):
        kinds[[ord(c) for c in letters]] = kind
    return kinds


def states_before(kinds: np.ndarray, step: np.ndarray, first: int = START) -> np.ndarray:
    """The state before each chunk; kinds: one row of classes per position, one column per chunk."""
    length, n = kinds.shape
    every = np.repeat(np.arange(12, dtype=np.uint8)[:, None], n, axis=1)
    for row in kinds[:WARM]:
        every = step[every * 16 + row]
    same = (every == every[0]).all(axis=0)  # what these chunks start in no longer matters
    one = every[0].copy()
    for row in kinds[WARM:]:
        one = step[one * 16 + row]
    if not same.all():
        rest = every[:, ~same]
        for row in kinds[WARM:, ~same]:
            rest = step[rest * 16 + row]
        every[:, ~same] = rest
    every[:, same] = one[same]
    maps, jump = every, 1
    while jump < n:  # inclusive scan: after it, column i maps through chunks 0 to i
        maps = np.concatenate((maps[:, :jump], np.take_along_axis(maps[:, jump:], maps[:, :-jump].astype(np.intp), axis=0)), axis=1)
        jump *= 2
    return np.concatenate(([first], maps[first, :-1])).astype(np.uint8)


def piece_marks(kinds: np.ndarray, step: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each position of the stream of classes."""
    n = len(kinds)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = kinds
    table = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    state, out = states_before(table, step), np.zeros_like(table)
    for k in range(CHUNK):
        at = state * 16 + table[k]
        out[k], state = marks[at], step[at]
    flat = out.T.reshape(-1)[:n]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BEFORE).astype(bool)
    return begins


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """The counting transducer. table[state * 256 + byte] is next state * 256 + tokens added + 128; -1: not compiled."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        symbols = byte_symbols()
        spelled = {}
        for text, i in vocabulary.items():
            if all(c in symbols for c in text):
                spelled[bytes(symbols[c] for c in text)] = i
        self.text = {i: b for b, i in spelled.items()}
        self.rank = {}
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list | tuple) else pair.split(" ")
            a, b = (spelled[bytes(symbols[c] for c in x)] for x in (a, b))
            self.rank[a, b] = (k, spelled[self.text[a] + self.text[b]])
        self.single = [spelled[bytes([b])] for b in range(256)]
        made = {m for _, m in self.rank.values()} | set(self.single)
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for b, i in spelled.items():
            if i not in made or len(b) > 1 and self.merged(b) != [i]:
                continue  # merging never gives this token
            node = 0
            for x in b:
                node = self.child[node].setdefault(x, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.token.append(-1)
            self.token[node] = i
        self.apart: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.number, self.keys = {((0, -1, 0),): 0}, [((0, -1, 0),)]
        self.table = np.full(256 << 10, -1, np.int32)

    def merged(self, data: bytes) -> list[int]:
        """The tokens of some bytes by merging pairs in order of rank."""
        parts = [self.single[b] for b in data]
        while len(parts) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [self.rank[parts[k], parts[k + 1]][1]]
        return parts

    def keeps_apart(self, a: int, b: int) -> bool:
        if (known := self.apart.get((a, b))) is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            known = self.apart[a, b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return known

    def compile(self, state: int, byte: int) -> int:
        found, alive = None, []
        for node, last, tokens in self.keys[state]:
            if (to := self.child[node].get(byte)) is None:
                continue
            if found is None and (t := self.token[to]) >= 0 and (last < 0 or self.keeps_apart(last, t)):
                found = (t, tokens + 1)
            if self.child[to]:
                alive.append((to, last, tokens))
        token, added = found
        key = (*((n, t, c - added) for n, t, c in alive), (0, token, 0))
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.keys)
            self.keys.append(key)
            if len(self.keys) * 256 > len(self.table):
                self.table = np.concatenate((self.table, np.full(len(self.table), -1, np.int32)))
        self.table[state * 256 + byte] = value = to * 256 + added + 128
        return value

    def keep_only(self, states: np.ndarray) -> np.ndarray:
        """Drops all states but these (as state * 256), and gives their new numbers."""
        used, at = np.unique(states >> 8, return_inverse=True)
        keys = [self.keys[s] for s in used.tolist()]
        self.clear()
        for key in keys:
            if key not in self.number:
                self.number[key] = len(self.keys)
                self.keys.append(key)
        if len(self.keys) * 256 > len(self.table):
            self.table = np.full(len(self.keys) * 512, -1, np.int32)
        return np.array([self.number[key] for key in keys], np.int64)[at] << 8

    def counts(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The tokens of each piece data[begin : begin + size].

        At most MAX_STATES pieces go side by side, and states are dropped when there are as many again as these can be in.
        """
        order = np.argsort(-size, kind="stable")
        total = np.zeros(len(begin), np.int64)
        for k in range(0, len(order), MAX_STATES):
            part = order[k : k + MAX_STATES]
            total[part] = self._side_by_side(data, begin[part], size[part])
        return total

    def _side_by_side(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same for pieces that are given longest first."""
        if len(self.keys) > MAX_STATES:
            self.clear()
        state, sums = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        n, k, longest = len(begin), 0, int(size[0]) if len(size) else 0
        left = np.searchsorted(-size, -np.arange(longest), side="left")  # pieces longer than k
        while k < longest and (n := int(left[k])) > 24:
            at = (state[:n] & ~255) + data[begin[:n] + k]
            value = self.table[at]
            if (missing := value < 0).any():
                if len(self.keys) > 2 * MAX_STATES:
                    state[:n] = self.keep_only(state[:n])
                    at = state[:n] + data[begin[:n] + k]
                    missing = self.table[at] < 0
                for x in np.unique(at[missing]).tolist():
                    self.compile(x >> 8, x & 255)
                value = self.table[at]
            sums[:n] += value & 255
            state[:n] = value
            k += 1
        for i in range(n if k < longest else 0):  # a few very long pieces
            s, c = int(state[i]) >> 8, int(sums[i])
            for b in data[begin[i] + k : begin[i] + size[i]].tolist():
                v = int(self.table[s * 256 + b])
                if v < 0:
                    v = self.compile(s, b)
                s, c = v >> 8, c + (v & 255)
                if len(self.keys) > 4 * MAX_STATES:
                    # the pieces still to come keep their states too
                    state[i] = s << 8
                    state[i:n] = self.keep_only(state[i:n])
                    s = int(state[i]) >> 8
            sums[i] = c
        return sums - 128 * size


class TokenCounter:
    """Counts of whole texts, equal to the library's for a byte-level BPE file with this pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.counter = Counter(spec["model"]["vocab"], spec["model"]["merges"])
        self.kinds, (self.step, self.marks) = code_point_classes(), splitter()

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        special = [pc.count_substring(texts, s).to_numpy(zero_copy_only=False) for s in self.special]
        if any(x.any() for x in special):  # such a string is one token, and ends what stands before it
            parts = [self._cut(t) for t in texts.to_pylist()]
            sizes = np.array([len(p) for p in parts])
            counts = self._plain(pa.array([x for p in parts for x in p], pa.large_string()))
            ends = np.cumsum(sizes)
            return np.concatenate(([0], np.cumsum(counts)))[ends] - np.concatenate(([0], np.cumsum(counts)))[ends - sizes] + sizes - 1
        return self._plain(texts)

    def _cut(self, text: str) -> list[str]:
        parts = [text]
        for s in self.special:
            parts = [x for p in parts for x in p.split(s)]
        return parts

    def _plain(self, texts: pa.Array) -> np.ndarray:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[0] == offsets[-1]:
            return np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each code point
        ends = np.searchsorted(lead, bounds[1:])
        kinds = np.insert(self.kinds[points], ends, END)
        begins = np.delete(piece_marks(kinds, self.step, self.marks), ends + np.arange(len(ends)))
        begin = lead[begins]
        counts = self.counter.counts(data, begin, np.diff(begin, append=len(data)))
        upto = np.concatenate(([0], np.cumsum(counts)))
        return np.diff(upto[np.searchsorted(begin, bounds)])


COUNTERS: dict[str, TokenCounter] = {}
KEPT["token_counts"] = COUNTERS


def counter_for(path: str) -> TokenCounter:
    """One compiled counter for each Python worker."""
    if path not in COUNTERS:
        COUNTERS.clear()
        COUNTERS[path] = TokenCounter(path)
    return COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", over: int = OVER) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > over) for every row.

    A null text counts as empty: 0 bytes, 0 tokens. Null ids stay null, repeated rows are counted one
    by one, an empty table gives no rows, other columns are ignored. Strings of special tokens inside
    a text count as that one token, as the library has it by default. A map over the rows: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(tokenizer)
        for batch in slices(batches, "text", keep="token_counts"):
            texts = texts_of(batch)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(counter(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    plain = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > over)
