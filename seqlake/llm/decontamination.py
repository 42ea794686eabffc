"""Finding benchmark passages in documents, re-parameterised ones too.

Texts are read as templates: numbers, names (capitalised words inside a sentence) and units become
typed placeholders. Runs of `WINDOW` template words are hashed and hash-joined with those of the
benchmark; each benchmark value in a slot must then map to one value of the document, over
all windows of one alignment (two values may become one); where it does not, only the windows found
word for word count. A second stream of windows over the plain lower-cased words finds those, and
copies whose capitals or full stops were changed.

An item of fewer words than a window is one window by itself, looked for at its own length; one of
fewer than `LEAST_LITERAL` words says too little inside a text and is only found as a whole text.

Documents are first held against a bitmap of the benchmark's hashes, whose size is fixed; only
windows that pass are shuffled. Items with equal texts are one until the end. The benchmark side is
broadcast when its windows number at most `BROADCAST_ROWS`, else both sides are shuffled with the hot
hashes salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import MIX, durable, hashed, mixed, row_key, row_of, rows_with, slices, split_words, texts_of, windows

WINDOW, LEAST_SHARE, LEAST_LITERAL = 8, 0.3, 4
LEAST_TEMPLATES = 3  # fewer windows that need their slots filled say too little by themselves
BITMAP_BITS = 22
BROADCAST_ROWS = 200_000
SALTS = 32

MARKS = ".,;:!?\"'()[]{}<>|*#$%&@~^_=+/\\-`"
# Unit words and signs that become the placeholder <unit>.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs pound pounds oz ounce ounces ton tons ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent degree degrees kmh mph hz khz mhz ghz w kw kwh v volt volts kb mb gb tb".split())
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA11CE0001, 0xA11CE0002, 0xA11CE0003))
LITERAL = np.uint64(0)


def template_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the plain words, hashes of the template words, whether each is a slot, offsets.

    Words without a letter or digit are skipped.
    """
    codes, offsets, words = split_words(texts)
    trimmed = pc.utf8_trim(words, MARKS)
    lower = pc.utf8_lower(trimmed)
    names = lower.to_pylist()
    digits = pc.match_substring_regex(trimmed, r"^[+-]?\p{Nd}[\p{Nd}.,:/]*\p{L}{0,3}%?$").to_numpy(zero_copy_only=False)
    capital = pc.match_substring_regex(trimmed, r"^\p{Lu}").to_numpy(zero_copy_only=False)
    units = np.array([w in UNITS for w in names], bool)
    full = pc.match_substring_regex(trimmed, r"[\p{L}\p{N}]").to_numpy(zero_copy_only=False)
    ends = pc.match_substring_regex(words, r"[.!?:]['\")\]]*$").to_numpy(zero_copy_only=False)
    plain = mixed(hashed(names))
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), offsets
    rows = row_of(offsets)
    starts = np.ones(len(codes), bool)
    starts[1:] = ends[codes[:-1]] | (rows[1:] != rows[:-1])
    keep = full[codes]
    before = np.concatenate(([0], np.cumsum(keep)))
    codes, starts, offsets, rows = codes[keep], starts[keep], before[offsets], rows[keep]
    number = digits[codes]
    after_number = np.zeros(len(codes), bool)
    after_number[1:] = number[:-1] & (rows[1:] == rows[:-1])
    unit = units[codes] & after_number
    name = capital[codes] & ~starts & ~number & ~unit
    kind = np.select([number, name, unit], [NUMBER, NAME, UNIT], LITERAL)
    slot = kind != LITERAL
    own = plain[codes]
    return own, np.where(slot, mixed(kind), own), slot, offsets


WINDOW_SCHEMA = "key long, doc_id long, hash long, at int, size int, words int, usable int, literal boolean, slots array<long>"


def runs(plain: np.ndarray, template: np.ndarray, slot: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Hash, place, whether slots are to be filled, and whether the place is literal enough for a template, of windows of a size."""
    found, at = windows(template, offsets, size)
    filled = np.concatenate(([0], np.cumsum(slot)))
    slots = filled[at + size] - filled[at]
    literal = size - slots >= LEAST_LITERAL
    by_template = literal | (slots == 0)
    typed = np.flatnonzero(slots > 0)  # windows that read otherwise without placeholders
    hashes, where, held = found[by_template], at[by_template], slots[by_template] > 0
    if len(typed):
        exact, _ = windows(plain, offsets, size)
        hashes, where, held = np.concatenate((hashes, exact[typed])), np.concatenate((where, at[typed])), np.concatenate((held, np.zeros(len(typed), bool)))
    enough = np.zeros(len(plain) + 1, bool)
    enough[at[literal]] = True
    if size != WINDOW:
        hashes = mixed(hashes + np.uint64(size) * MIX)
    return hashes, where, held, enough[where]


def window_rows(df: DataFrame, bitmap: np.ndarray | None, short: list[int] | None = None) -> DataFrame:
    """The windows of (key, doc_id, text).

    With a bitmap those in it, of `WINDOW` words and of each length in `short`; without one all of an item's: one window if it is short.
    """
    spread = None if bitmap is None else df.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if spread is None else np.unpackbits(spread.value).astype(bool)
        for batch in slices(batches, "text"):
            words = template_words(texts_of(batch))
            plain, slot, offsets = words[0], words[2], words[3]
            rows, size = row_of(offsets), np.diff(offsets)
            for length in [WINDOW, *(range(1, WINDOW) if short is None else short)]:
                if length > len(plain):
                    continue
                hashes, where, held, literal = runs(*words, length)
                if length < LEAST_LITERAL or length < WINDOW and known is None:  # whole texts only
                    pick = size[rows[where]] == length
                    hashes, where, held, literal = hashes[pick], where[pick], held[pick], literal[pick]
                if known is not None:
                    pick = known[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]
                    hashes, where, held, literal = hashes[pick], where[pick], held[pick], literal[pick]
                if not len(hashes):
                    continue
                values = [plain[w : w + length][slot[w : w + length]].view(np.int64) if h else plain[:0].view(np.int64) for w, h in zip(where.tolist(), held.tolist(), strict=True)]
                owner = rows[where]
                usable = np.bincount(rows[np.unique(where[literal])] if known is None else [], minlength=len(size)).astype(np.int64)  # of items only
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(owner)),
                        batch.column("doc_id").take(pa.array(owner)),
                        pa.array(hashes.view(np.int64)),
                        pa.array((where - offsets[owner]).astype(np.int32)),
                        pa.array(np.full(len(owner), length, np.int32)),
                        pa.array(size[owner].astype(np.int32)),
                        pa.array(usable[owner].astype(np.int32)),
                        pa.array(literal),
                        pa.array(values, pa.list_(pa.int64())),
                    ],
                    names=["key", "doc_id", "hash", "at", "size", "words", "usable", "literal", "slots"],
                )

    return df.mapInArrow(run, WINDOW_SCHEMA)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per contaminated row of docs and benchmark item: key, doc_id, item_id, windows, share, first_word, last_word.

    share: of the item's windows, those found in the document word for word or with consistent slots; or, if three at least
    are found, of those windows that are literal enough to be told by their template. Rows below least_share are left out.
    Words count from 0, last_word included. Items of 4 to 7 words are found whole anywhere in a text, shorter ones only as a
    whole text. Null texts and texts without letters or digits match nothing. A null id stays null. Repeated rows share a key
    and give one row for each item; items with equal texts are all given; of several texts of one item the one with the
    largest share counts, of equal ones that with more windows, then the later words. Whole texts of any length are read.
    Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null")
    named = items.select("item_id", F.xxhash64("text").alias("item")).distinct()
    texts = items.groupBy(F.xxhash64("text").alias("key")).agg(F.min("text").alias("text")).withColumn("doc_id", F.lit(None).cast("long"))
    theirs = window_rows(texts, None).select(F.col("key").alias("item"), "hash", F.col("at").alias("item_at"), F.col("words").alias("item_words"), F.col("size").alias("item_size"), F.col("usable").alias("item_usable"), F.col("literal").alias("item_literal"), F.col("slots").alias("item_slots"))
    theirs = durable(theirs.dropDuplicates(["item", "hash", "item_at"]))
    bits = theirs.select(F.shiftrightunsigned("hash", 64 - BITMAP_BITS).alias("bit")).distinct()  # at most 2**BITMAP_BITS rows
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[bits.toArrow().column("bit").to_numpy()] = True
    short = sorted(r["item_size"] for r in theirs.filter(F.col("item_size") < WINDOW).select("item_size").distinct().collect())  # seven at most
    plain = docs.select(row_key(docs[id_column], docs[text_column]).alias("key"), docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    ours = window_rows(plain, bitmap, short).select("key", "doc_id", "hash", "at", "slots")
    if theirs.count() <= BROADCAST_ROWS:
        pairs = ours.join(F.broadcast(theirs), "hash")
    else:
        salted = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = ours.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    # windows of one alignment share at - item_at
    own = ["key", "doc_id", "item", "item_words", "item_usable", "item_size"]
    place = F.struct(F.col("item_at").alias("at"), F.col("item_literal").alias("literal"))
    pairs = pairs.select(*own, "at", place.alias("place"), (F.col("at") - F.col("item_at")).alias("shift"), F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("ours")).alias("slots"))
    exact = F.size("slots") == 0  # word for word, or nothing to fill in
    ends = [F.min("at").alias("low"), F.max("at").alias("high"), F.min(F.when(exact, F.col("at"))).alias("exact_low"), F.max(F.when(exact, F.col("at"))).alias("exact_high")]
    aligned = pairs.groupBy(*own, "shift").agg(F.collect_set("place").alias("places"), F.collect_set(F.when(exact, F.col("place"))).alias("exact_places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"), *ends)
    one_value = F.size(F.array_distinct(F.col("slots.theirs"))) == F.size("slots")
    consistent = aligned.select(*own, *[F.when(one_value, F.col(c)).otherwise(F.col(f"exact_{c}")).alias(c) for c in ("places", "low", "high")]).filter(F.size("places") > 0)
    found = consistent.groupBy(*own).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("low").alias("first_word"), (F.max("high") + F.col("item_size") - 1).alias("last_word"))
    literal = F.size(F.filter("places", lambda p: p["literal"]))
    share = F.size("places") / (F.col("item_words") - F.col("item_size") + 1)
    share = F.greatest(share, F.when(literal >= LEAST_TEMPLATES, literal / F.col("item_usable")).otherwise(0.0))
    found = found.withColumns({"windows": F.size("places").cast("long"), "share": share}).filter(F.col("share") >= least_share)
    best = found.join(named, "item").groupBy("key", "doc_id", "item_id").agg(F.max(F.struct("share", "windows", "first_word", "last_word")).alias("best"))
    return best.select("key", "doc_id", "item_id", "best.windows", "best.share", "best.first_word", "best.last_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs in which no benchmark item was found. Null texts stay; columns of any name are kept as they were."""
    return rows_with(docs, id_column, text_column, find_contamination(docs, benchmark, id_column, text_column), "left_anti")
