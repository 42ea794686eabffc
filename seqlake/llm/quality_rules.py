"""Quality rules whose cutoffs come with a guarantee.

Every rule is a figure of a text (share of symbols, of repeated lines, of repeated words, long or
short words) that rejects above a cutoff. Cutoffs tighten along one chain of settings: each step makes
the cutoff of one rule stricter. The order of the chain is chosen on a part of the labelled texts (the
design part), the step that gains most bad texts for the good ones it costs first. How far a stratum
(language) may go along the chain is decided on the rest, its holdout, which had no say in the chain:
settings are tested from the laxest on, by the exact binomial (Clopper-Pearson) bound on the share of good
texts that all rules together reject, up to the first one that does not show at most `max_false`. A
chain tested in a fixed order needs no correction for its rules and cutoffs; over strata the error is
divided by Holm's method: a stratum whose whole chain is certified hands its part on to the others. So
with probability `confidence` no stratum loses more than `max_false` of its good texts.

Strata with too few good labels to certify anything, even if nothing of theirs were rejected, are one
stratum together, for which the guarantee then holds; if they are too few even so, nothing is rejected there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import durable, mixed, row_of, slices, split_words, texts_of, windows

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
SYMBOLS = b"#*$%&|<>"
MAX_FALSE, CONFIDENCE = 0.02, 0.95
DESIGN_FOLDS = 2  # of five, by crc32 of the id; the others are the holdout
OTHERS = "\x00others"
BROADCAST_STRATA, SALTS = 100_000, 32

# The rules: a figure for each, and the grid of its cutoffs.
RULES = {
    "symbols": ("n_symbols / word_chars", [round(0.005 * k, 3) for k in range(1, 61)]),
    "lines": ("n_dup_lines / n_words", [round(0.0025 * k, 4) for k in range(1, 61)]),
    "repeats": ("n_repeat_words / n_words", [round(0.005 * k, 3) for k in range(1, 41)]),
    "long_words": ("word_chars / n_words", [round(5 + 0.25 * k, 2) for k in range(0, 61)]),
    "short_words": ("-word_chars / n_words", [round(-6 + 0.1 * k, 1) for k in range(0, 51)]),
}
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_figures(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COLUMNS for each text."""
    n = len(texts)
    codes, offsets, words = split_words(texts)
    n_words = np.diff(offsets)
    rows = row_of(offsets)
    chars = np.bincount(rows, pc.utf8_length(words).to_numpy(zero_copy_only=False)[codes] if len(codes) else None, n).astype(np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    symbols = np.searchsorted(np.flatnonzero(is_symbol[data]), bounds - bounds[0])
    lines = pc.split_pattern(texts, "\n")
    ends = lines.offsets.to_numpy().astype(np.int64)
    coded = lines.flatten().dictionary_encode()
    full = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    line, owner = coded.indices.to_numpy().astype(np.int64), row_of(ends - ends[0])
    owner, line = owner[full[line]], line[full[line]]
    different = np.unique(owner * (len(full) + 1) + line) // (len(full) + 1)
    dup_lines = np.bincount(owner, minlength=n) - np.bincount(different, minlength=n)
    repeated = np.zeros(n, np.int64)
    found, at = windows(mixed(codes.astype(np.uint64) + np.uint64(1)), offsets, WINDOW)
    if len(found):
        own = mixed(found + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + WINDOW, -1)
        repeated = np.bincount(rows[np.cumsum(cover)[:-1] > 0], minlength=n)
    return dict(zip(COLUMNS, (n_words, chars, np.diff(symbols), dup_lines, repeated), strict=True))


def figures(docs: DataFrame, id_column: str, text_column: str, stratum_column: str) -> DataFrame:
    """doc_id, stratum and the counts of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = text_figures(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("stratum"), *(pa.array(found[c], pa.int64()) for c in COLUMNS)], names=["doc_id", "stratum", *COLUMNS])

    plain = docs.select(docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[stratum_column].cast("string"), F.lit("")).alias("stratum"), docs[text_column].cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COLUMNS))


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), summed downwards from k until the terms no longer count."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    if k > n * p + 40 * math.sqrt(n * p * (1 - p) + 1):
        return 1.0
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio, total, term = (1 - p) / p, 0.0, 1.0
    for i in range(k, -1, -1):
        total += term
        term *= ratio * i / (n - i + 1)
        if term < 1e-17 * total:
            break
    return min(1.0, math.exp(top) * total)


def most_rejected(n: int, limit: float, error: float) -> int:
    """The most rejections among n good texts that still show, at this error, a rate of at most limit; -1: none do."""
    low, high = -1, n
    while high - low > 1:  # exact (Clopper-Pearson): the upper bound is at most limit when P(X <= k) <= error
        k = (low + high) // 2
        low, high = (k, high) if at_most(k, n, limit) <= error else (low, k)
    return low


def least_labels(limit: float, error: float) -> int:
    """The fewest good texts of which no rejection at all shows, at this error, a rate of at most limit."""
    return math.ceil(math.log(error) / math.log1p(-limit) - 1e-9)


def chain_of(bad: dict[str, list[int]], good: dict[str, list[int]]) -> list[tuple[str, float]]:
    """The chain as (rule, cutoff), laxest first, from how many bad and good texts exceed each cutoff of the grids.

    Every step takes the rule and the stricter cutoff that gain most bad texts for a good one lost; of equals
    the first rule and the laxest cutoff. It ends where no cutoff gains a bad text.
    """
    at = {rule: len(grid) for rule, (_, grid) in RULES.items()}  # grids ascend: the last cutoff is the laxest
    chain: list[tuple[str, float]] = []
    while True:
        best = None
        for rule, (_, grid) in RULES.items():
            here = (bad[rule][at[rule]], good[rule][at[rule]]) if at[rule] < len(grid) else (0, 0)
            for i in range(at[rule] - 1, -1, -1):
                gain, loss = bad[rule][i] - here[0], good[rule][i] - here[1]
                if gain > 0 and (best is None or gain / (loss + 0.5) > best[0]):
                    best = (gain / (loss + 0.5), rule, i)
        if best is None:
            return chain
        at[best[1]] = best[2]
        chain.append((best[1], RULES[best[1]][1][best[2]]))


def furthest(counts: list[int], rest: int, limit: float, error: float) -> int:
    """How many settings are certified: counts[i] good texts fall to the i-th one first, `rest` to none."""
    most, lost = most_rejected(sum(counts) + rest, limit, error), 0
    for k, c in enumerate(counts):
        lost += c
        if lost > most:
            return k
    return len(counts)


def level_of(chain: list[tuple[str, float]]) -> tuple[Column, Column]:
    """The first setting that rejects a row, counted from 1, and its rule; null where none does."""
    level, rule_of = F.lit(None).cast("int"), F.lit(None).cast("string")
    if chain:
        first = {}
        for rule in dict(chain):
            steps = [(k, c) for k, (r, c) in enumerate(chain, 1) if r == rule]  # cutoffs fall along the chain
            hit = F.lit(None).cast("int")
            for k, c in reversed(steps):
                hit = F.when(F.col(rule) > c, k).otherwise(hit)
            first[rule] = hit
        level = F.least(*first.values()) if len(first) > 1 else next(iter(first.values()))
        rules = F.array(*[F.lit(r) for r, _ in chain])
        rule_of = F.get(rules, level - 1)
    return level, rule_of


def tester(n_levels: int, limit: float, error: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Tests the chain for the counts (stratum, level, n) of one stratum."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        per = {int(k): int(n) for k, n in zip(pdf["level"].fillna(0), pdf["n"], strict=True)}
        k = furthest([per.get(i, 0) for i in range(1, n_levels + 1)], per.get(0, 0), limit, error)
        return pd.DataFrame({"stratum": pdf["stratum"].iloc[:1], "furthest": pd.Series([k], dtype="int32", index=pdf.index[:1])})

    return test


def certified(holdout: DataFrame, n_levels: int, max_false: float, confidence: float) -> DataFrame:
    """stratum and furthest, the last setting certified for it, from the good texts (stratum, level) of the holdout.

    The stratum OTHERS holds all that have no row here.
    """
    error = 1 - confidence
    counts = durable(holdout.groupBy("stratum", "level").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("n"))
    tests = sizes.filter(F.col("n") >= least_labels(max_false, error)).count() + 1
    own = durable(sizes.filter(F.col("n") >= least_labels(max_false, error / tests)).select("stratum"))
    pooled = counts.join(own, "stratum", "left_anti").withColumn("stratum", F.lit(OTHERS))
    named = durable(counts.join(own, "stratum").union(pooled.select(*counts.columns)).groupBy("stratum", "level").agg(F.sum("n").alias("n")))
    tests = named.select("stratum").distinct().count()
    done = 0
    while tests:
        # a group has a row for each setting at most
        found = durable(named.groupBy("stratum").applyInPandas(tester(n_levels, max_false, error / (tests - done)), "stratum string, furthest int"))
        whole = found.filter(F.col("furthest") == n_levels).count()
        if whole <= done or whole == tests:
            return found
        done = whole
    return holdout.sparkSession.createDataFrame([], "stratum string, furthest int")


def with_limit(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows with furthest, the setting that holds for their stratum; null without one."""
    pool = limits.filter(F.col("stratum") == OTHERS).select("furthest").first()
    own = limits.filter(F.col("stratum") != OTHERS)
    if own.count() <= BROADCAST_STRATA:
        met = rows.join(F.broadcast(own), "stratum", "left")
    else:  # one stratum may hold a large part of the rows
        salted = own.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["stratum", "__salt"], "left").drop("__salt")
    return met.withColumn("furthest", F.coalesce("furthest", F.lit(pool["furthest"] if pool else None).cast("int")))


def settings(labelled: DataFrame) -> list[tuple[str, float]]:
    """The chain from the design part of labelled rows (label, figures of the rules); what reaches the driver has the grids' size."""
    sums = []
    for rule, (_, grid) in RULES.items():
        for label in (0, 1):
            sums.append(F.array(*[F.sum(((F.col("label") == label) & (F.col(rule) > c)).cast("long")) for c in grid]).alias(f"{rule}_{label}"))
    r = labelled.agg(*sums).first()
    counts = [{rule: [x or 0 for x in r[f"{rule}_{label}"]] for rule in RULES} for label in (0, 1)]
    return chain_of(counts[0], counts[1])


def judge_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang", label_column: str = "quality", max_false: float = MAX_FALSE, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, kept, and the rule that rejected it, if one did.

    Words are runs without ASCII white space; a text may have any length. A null text has none. base_failed:
    fewer than 10 words, or more than 20 % of them in repeated runs of five. Rules apply to the rest. A null
    language is the stratum ''. Labels other than 0 and 1, null ones, or those whose id has no row are not used; of
    several labels for one id the least holds. Without bad or without enough good labels no rule rejects. A figure equal to a
    cutoff passes. Repeated rows are judged alike (and count as often); an empty table gives no rows; other columns are ignored.
    """
    shares = {rule: F.coalesce(F.expr(figure.replace("/ ", "/ nullif(") + ", 0)"), F.lit(0.0)) for rule, (figure, _) in RULES.items()}
    counts = durable(figures(docs, id_column, text_column, stratum_column))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = counts.withColumns(shares).withColumn("base_failed", failed)
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label_column).cast("int").alias("label")).dropna().filter("label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    design = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 < DESIGN_FOLDS
    labelled = durable(rows.filter(~F.col("base_failed")).join(known, "doc_id").select("doc_id", "stratum", "label", *RULES))
    chain = settings(labelled.filter(design))
    level, rule = level_of(chain)
    limits = certified(labelled.filter(~design & (F.col("label") == 1)).select("stratum", level.alias("level")), len(chain), max_false, confidence)
    rows = with_limit(rows.withColumn("level", level), limits)
    verdict = F.when(~F.col("base_failed") & (F.col("level") <= F.col("furthest")), rule)
    rows = rows.withColumn("rejected_by", verdict)
    return rows.select("doc_id", *COLUMNS, "base_failed", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")
