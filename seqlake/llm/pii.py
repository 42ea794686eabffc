"""Personal data: direct identifiers, and the terms around them that give them away.

Direct identifiers (e-mail and IP addresses, card and phone numbers) are found by patterns and
checks. Terms are then weighed over the corpus, a whole text being the context: with P(c) the share of
texts that hold identifier c, and P(c|t) that share among the texts that hold term t, the pointwise mutual
information log P(c|t) / P(c) cannot exceed the information -log P(c) of the identifier itself. P(c|t)
is smoothed towards P(c) by `SMOOTHING` texts, so that a term seen in one text counts, but for less than one seen
with c in many. Where the information reaches `GENERALISE` of the identifier's, the term is replaced by a general one
wherever it stands, in every text; from `REMOVE` on it is removed. An identifier that all texts hold says nothing.

All of it is DataFrame operations. Texts are never shuffled: identifiers are found once and kept with the
texts that hold some; of all words only those that pass a bitmap of the terms beside identifiers are counted, beside identifiers only
those that could disclose one, and only the places of those that pass a bitmap of the chosen terms are joined with these.
The bitmaps have a fixed size. Counts are added up before each shuffle. Lists of terms and identifiers (as 64-bit hashes) are
broadcast up to `BROADCAST_ROWS` rows; beyond, both sides are sorted, and Spark splits a term or identifier that fills a large part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import durable, row_key, spare, with_row_key

GENERALISE, REMOVE, SMOOTHING = 0.8, 0.95, 1.0
BROADCAST_ROWS = 200_000
BITMAP_BITS = 25
KINDS = ("email", "ip", "card", "phone")
REPLACEMENTS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "remove": ""}
# What a term becomes by how it is written; the first that fits.
GENERAL = ((r"^\p{N}+$", "<NUMBER>"), (r"\p{N}", "<CODE>"), (r"^\p{Lu}", "<NAME>"), ("", "<TERM>"))
LEAST_PART = 16

# A separator between digits, or a dot inside a domain, becomes a mark first; so every pattern below
# is a run of one character class and needs neither recursion nor a second try.
MARK = "\uFDD0"
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{MARK}{LOCAL}])|\G)[{MARK}{LOCAL}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{MARK}]{{15,}}"  # 16 digits at least
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"[\p{L}\p{N}]{3,}"

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once: what a lambda takes from outside is worked out each time it runs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded(items: Column, first: Column, kind: str, step, context=lambda at, own: F.lit(0), add=F.concat) -> Column:
    """All that step(at, item, context) gives for items in turn, as (at, out): step gives the next at and what is added to an array of a kind.

    Arrays grow by copying, so parts of the items, as many as each has, are folded by themselves and put together at the end.
    context(at, own) is worked out once for each part.
    """
    none = F.array().cast(kind)

    def one(acc: Column, item: Column, c: Column) -> Column:
        at, out = step(acc["at"], item, c)
        return F.struct(at.alias("at"), add(acc["out"], out).alias("out"))

    def part(acc: Column, own: Column, c: Column) -> Column:
        inner = F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("out")), lambda a, item: one(a, item, c))
        return once(inner, lambda p: F.struct(p["at"].alias("at"), F.array_append(acc["out"], p["out"]).alias("out")))

    def every(items: Column) -> Column:
        n = F.greatest(F.size(items), F.lit(1))
        size = F.greatest(F.ceil(F.sqrt(n)), F.lit(LEAST_PART)).cast("int")
        start = F.struct(first.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

        def in_parts(size: Column) -> Column:
            parts = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
            return F.aggregate(parts, start, lambda acc, k: once(F.slice(items, k * size + 1, size), lambda own: once(context(acc["at"], own), lambda c: part(acc, own, c))))

        return once(once(size, in_parts), lambda w: F.struct(w["at"].alias("at"), F.flatten(w["out"]).alias("out")))

    return once(items, every)


def stretch(text: Column):
    """The context of a fold over spans (start, end): the text from where it stands to the last end, and where that begins.

    Finding a place in a text takes as many steps as there are characters before it, so it is done once for each part.
    """

    def context(at: Column, own: Column) -> Column:
        last = F.coalesce(F.array_max(F.transform(own, lambda s: s["end"])), at)
        return F.struct(at.alias("begin"), F.substr(text, at + 1, F.greatest(last - at, F.lit(0))).alias("text"))

    return context


def cut(c: Column, start: Column, end: Column) -> Column:
    """Characters start to end - 1 of the text, from a context of `stretch`."""
    return F.substr(c["text"], start - c["begin"] + 1, F.greatest(end - start, F.lit(0)))


def running(sizes: Column) -> Column:
    """The running sums of an array of integers, in parts like `folded`."""
    whole = folded(sizes, F.lit(0), "array<int>", lambda at, size, _: (at + size, at + size), add=F.array_append)
    return whole["out"]


def found(text: Column, pattern: str, kind: str, value=lambda hit: hit) -> Column:
    """The matches of a pattern with their places, in code points, end exclusive."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def spans(b: Column) -> Column:
        ends = running(F.zip_with(b["gaps"], b["hits"], lambda gap, hit: F.length(gap) + F.length(hit)))  # after the last hit comes a gap alone
        pairs = F.filter(F.arrays_zip(b["hits"].alias("hit"), ends.alias("end")), lambda p: p["hit"].isNotNull())
        return F.transform(pairs, lambda p: F.struct(F.lit(kind).alias("kind"), (p["end"] - F.length(p["hit"])).alias("start"), p["end"].alias("end"), value(p["hit"]).alias("value")))

    return once(both, spans)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    back = F.reverse(number)
    twice = F.translate(back, "0123456789", "0246813579")
    at = F.sequence(F.lit(1), F.length(number))
    total = F.aggregate(at, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, F.substr(twice, i, F.lit(1))).otherwise(F.substr(back, i, F.lit(1))).cast("int"))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """All valid direct identifiers, by kind and then place."""
    none = F.array().cast(SPAN)
    clean = F.translate(text, MARK, "\uFDD1")
    dotted = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    joined = F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", MARK)
    back = lambda hit: F.lower(F.translate(hit, MARK, "."))
    email = F.when(F.contains(text, F.lit("@")), found(dotted, EMAIL, "email", back)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]++\."), F.filter(found(text, IP, "ip"), lambda s: s["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))).otherwise(none)
    long_enough = lambda s: F.length(s["value"]).between(16, 19)
    card = F.when(text.rlike(r"(?:[0-9][\x20-]?){16}"), F.filter(F.filter(found(joined, CARD, "card", digits), long_enough), lambda s: passes_luhn(s["value"]))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(found(text, PHONE, "phone", digits), lambda s: F.length(s["value"]).between(8, 15))).otherwise(none)
    return F.concat(email, ip, card, phone)


def blanked(text: Column, base: Column) -> Column:
    """The text with spaces in the place of identifiers, as long as it was."""
    order = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(at: Column, s: Column, c: Column) -> tuple[Column, Column]:
        begin = F.greatest(at, s["start"])
        return F.greatest(at, s["end"]), F.array(cut(c, at, begin), F.repeat(F.lit(" "), F.greatest(s["end"] - begin, F.lit(0))))

    whole = folded(order, F.lit(0), "array<string>", step, stretch(text))
    return once(whole, lambda w: F.concat(F.array_join(w["out"], ""), F.substr(text, w["at"] + 1, F.length(text))))


def terms_in(text: Column) -> Column:
    """The different terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def listed(left: DataFrame, few: DataFrame, on: str, broadcast_rows: int) -> DataFrame:
    """left joined with a durable list of different values of a column; a long list is not broadcast, and Spark splits what is skewed on the left."""
    return left.join(F.broadcast(few) if few.count() <= broadcast_rows else few.hint("merge"), on)


def passing(written: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of written whose term is in a bitmap of those of chosen: all that are chosen, and some that are not."""
    cell = F.xxhash64("term").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    set_ = chosen.select(cell.alias("cell")).groupBy(F.shiftright("cell", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("word"))
    every = written.sparkSession.range(1 << (BITMAP_BITS - 6)).join(set_, "id", "left").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word"))))["word"].alias("bits"))
    hit = F.bit_get(F.get("bits", F.shiftright(cell, 6).cast("int")), cell.bitwiseAND(F.lit(63)).cast("int")) == 1
    return written.join(F.broadcast(durable(every)), hit).drop("bits")  # one row


def decisions(marked: DataFrame, texts: DataFrame, n_texts: int, generalise: float, remove: float, smoothing: float, broadcast_rows: int) -> DataFrame:
    """term and kind ('general' or 'remove') of the terms that disclose too much, of texts and those of them (marked) with entities."""
    entities = durable(marked.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("held")).filter(F.col("held") < n_texts))
    ends = entities.agg(F.min("held").alias("low"), F.max("held").alias("high")).first()
    low, high = ((ends[k] or 0) / n_texts if n_texts else 0.0 for k in ("low", "high"))
    beside = marked.select("entities", F.explode(terms_in(F.col("free"))).alias("term"))
    near = durable(beside.groupBy("term").agg(F.count("*").alias("most")))
    words = passing(texts.select(F.explode(terms_in(F.col("free"))).alias("term")), near).groupBy("term").agg(F.count("*").alias("seen"))
    # no entity can be told from a term that falls short of the lowest bound with all texts that hold it and any entity
    could = near.join(words, "term").filter((F.col("most") + smoothing * high) / (F.col("seen") + smoothing) >= low ** (1 - generalise) * (1 - 1e-9))
    could = durable(could.select("term", "seen"))
    joint = passing(beside, could).select("term", F.explode("entities").alias("entity")).groupBy("term", "entity").agg(F.count("*").alias("joint"))
    weighed = listed(listed(joint, could, "term", broadcast_rows), entities, "entity", broadcast_rows)
    p = F.col("held") / n_texts
    disclosed = 1 + F.log((F.col("joint") + smoothing * p) / (F.col("seen") + smoothing)) / -F.log(p)
    told = weighed.withColumn("disclosed", disclosed).filter(F.col("disclosed") >= generalise)
    # of several decisions on one term the stricter holds
    return told.groupBy("term").agg(F.when(F.max("disclosed") >= remove, "remove").otherwise("general").alias("kind"))


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, smoothing: float = SMOOTHING, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: key, doc_id, base and terms, arrays of spans (kind, start, end, value).

    Places count code points, end exclusive. base holds direct identifiers by kind, then place; terms
    holds all occurrences of disclosing terms by kind, then place, each outside all identifiers; a text without
    identifiers may have some. A null text has neither; texts of any length are read whole. Null ids stay null. Repeated rows
    share a key and get the same spans; each counts as a text. A figure equal to a bound reaches it. An empty table gives no
    rows; other columns are ignored.
    """
    plain = docs.select(row_key(docs[id_column], docs[text_column]).alias("key"), docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"))
    rows = plain.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("free", F.when(F.size("base") > 0, blanked(F.col("text"), F.col("base"))).otherwise(F.col("text")))
    spans = durable(rows.select("key", "doc_id", "base", F.when(F.size("base") > 0, F.col("free")).alias("free")))
    named = F.array_distinct(F.transform("base", lambda s: F.xxhash64(s["kind"], s["value"])))
    marked = spans.filter(F.size("base") > 0).select("free", named.alias("entities"))
    chosen = durable(decisions(marked, rows, spans.count(), generalise, remove, smoothing, broadcast_rows))
    written = rows.select("key", "doc_id", F.explode(found(F.col("free"), TERM, "", F.lower)).alias("s")).select("key", "doc_id", F.col("s.value").alias("term"), "s.start", "s.end")
    hits = listed(passing(written, chosen), chosen, "term", broadcast_rows)
    span = F.struct("kind", F.col("start"), F.col("end"), F.col("term").alias("value"))
    terms = hits.groupBy("key", "doc_id").agg(F.sort_array(F.collect_set(span)).alias("terms"))  # by row: repeated ones share it
    terms = terms.withColumnsRenamed({"key": "key2", "doc_id": "doc_id2"})
    same = (F.col("key") == F.col("key2")) & F.col("doc_id").eqNullSafe(F.col("doc_id2"))
    return spans.drop("free").join(terms, same, "left").select("key", "doc_id", "base", F.coalesce("terms", F.array().cast(SPAN)).alias("terms"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced by what stands for its kind; overlapping spans fall to the first.

    A generalised term becomes a number, a code, a name or a term, as it is written.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.create_map(*[F.lit(x) for pair in REPLACEMENTS.items() for x in pair])

    def general(written: Column) -> Column:
        out = F.lit(GENERAL[-1][1])
        for pattern, name in reversed(GENERAL[:-1]):
            out = F.when(written.rlike(pattern), name).otherwise(out)
        return out

    def step(at: Column, s: Column, c: Column) -> tuple[Column, Column]:
        own = F.when(s["kind"] == "general", once(cut(c, s["start"], s["end"]), general)).otherwise(names[s["kind"]])
        parts = F.array(cut(c, at, s["start"]), own)
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, parts).otherwise(F.array().cast("array<string>"))

    whole = folded(order, F.lit(0), "array<string>", step, stretch(text))
    new = once(whole, lambda w: F.concat(F.array_join(w["out"], ""), F.substr(text, w["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(new)


def sanitise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with all spans replaced in the text column; rows and other columns as they were. A null text stays null."""
    found_in = find_pii(docs, id_column, text_column)
    keyed, key, own = with_row_key(docs, id_column, text_column)
    spans = found_in.filter((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["key", "doc_id"]).select(F.col("key").alias(f"{key}2"), F.col("doc_id").alias(f"{own}2"), F.concat("base", "terms").alias(spare(keyed, "row_spans")))
    same = (F.col(key) == F.col(f"{key}2")) & F.col(own).eqNullSafe(F.col(f"{own}2"))
    found_spans = F.col(spare(keyed, "row_spans"))
    text = F.when(found_spans.isNull(), F.col(f"`{text_column}`")).otherwise(replaced(F.col(f"`{text_column}`"), found_spans))
    return keyed.join(spans.hint("shuffle_hash"), same, "left").withColumn(text_column, text).select(*[F.col(f"`{c}`") for c in docs.columns])
