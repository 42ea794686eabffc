"""Self-join of documents on the Jaccard similarity of their word n-grams.

A MinHash LSH forest finds candidates. Each of `TREES` trees holds every document under a signature of
`DEEPEST` labels, packed into one integer with the tree in front: a tree is its sorted signatures, and a node of its
prefix trie is a run of them that share their first labels. Documents are matched at full depth
first; then the prefix is shortened label by label, and at each depth the nodes that still hold several
classes are compared: of some trees on the way, of all at the end. How far it is shortened is measured: a part of the documents, each against a
made copy at exactly the threshold, shows how often two such signatures share a prefix in a
tree, and the shortening ends at the first depth at which a pair at the threshold meets in some tree with
the target chance.

All candidates are verified exactly on their sets of shingles, in blocks bounded in members and in bytes: a
node's members are dealt into blocks, a task compares two blocks, and it gives a spanning forest of the
links found there instead of the pairs. Documents with equal sets are one vertex throughout. Links merge into
classes by label propagation with pointer jumping over durable tables; links are counted in blocks of each class.

Work and rows are linear in the documents except inside one class of different near-copies: counting their
links compares each two of them, in tasks of bounded size, and a member is sent once for each block of its class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import MIX, durable, hashed, mixed, row_key, slices, split_words, texts_of, windows, with_row_key

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEEPEST, FIRST_TREES = 40, 8, 8
LABEL_BITS = 7  # of a label; two different ones are equal by chance in one of 128 cases, which only adds candidates
PROBED, PROBE_SIZES = 32, (27, 270)  # one set of so many, cut to a multiple of nine shingles between these
BLOCK, BLOCK_BYTES, STRIPE_CELLS = 512, 4 << 20, 1 << 23
NO_WORDS = np.uint64(0x5EED)


def chance(meets: float, trees: int = TREES) -> float:
    """The chance that two signatures meet in some tree if they do in one with chance `meets`."""
    return 1 - (1 - meets) ** trees


def depth_for(meets: list[float], recall: float = RECALL, trees: int = TREES) -> int:
    """The longest prefix at which a pair at the threshold meets with the target chance; meets[d - 1] is that for d labels in one tree."""
    return next((d for d in range(len(meets), 1, -1) if chance(meets[d - 1], trees) >= recall), 1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle make one shingle."""
    codes, offsets, words = split_words(pc.utf8_lower(texts))
    hashes = hashed(words.to_pylist())[codes]
    found, at = windows(hashes, offsets, size)
    cut = np.searchsorted(at, offsets)
    for r in range(len(offsets) - 1):
        a, b = offsets[r], offsets[r + 1]
        if b - a >= size:
            yield np.unique(found[cut[r] : cut[r + 1]])
        elif b > a:
            own = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                own = mixed(own + h)
            yield own
        else:
            yield np.array([NO_WORDS])


class Forest:
    """Signatures of shingle sets, one integer for each tree: six bits of tree, then the labels, the first one highest."""

    def __init__(self, trees: int = TREES, seed: int = 1):
        random = np.random.RandomState(seed)
        self.trees, n = trees, DEEPEST * trees
        self.flip = random.randint(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]
        self.scale = (random.randint(0, 1 << 31, n, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.tree = np.arange(trees, dtype=np.uint64) << np.uint64(LABEL_BITS * DEEPEST)
        self.shift = (np.arange(DEEPEST)[::-1] * LABEL_BITS).astype(np.uint64)

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        small = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.flip), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(small), 512):
            part = small[k : k + 512]
            for j in range(0, len(least), 40):  # in pieces that stay in the processor's cache
                least[j : j + 40] = np.minimum(least[j : j + 40], ((part ^ self.flip[j : j + 40]) * self.scale[j : j + 40]).min(axis=1))
        labels = mixed(least.astype(np.uint64) * MIX) >> np.uint64(64 - LABEL_BITS)
        return (self.tree | np.bitwise_or.reduce(labels.reshape(self.trees, DEEPEST) << self.shift, axis=1)).view(np.int64)

    def probe(self, shingles: np.ndarray, threshold: float) -> np.ndarray | None:
        """In how many trees a part of the set and a copy of it at the threshold share 1, 2, ... labels; null for too small a set."""
        n = min(len(shingles), PROBE_SIZES[1])
        lost = math.floor(n * (1 - threshold) / (1 + threshold) + 1e-9)  # (n - lost) / (n + lost) shingles are shared
        n = round(lost * (1 + threshold) / (1 - threshold)) if threshold < 1 else n
        if n < PROBE_SIZES[0] or n > len(shingles):
            return None
        own = shingles[np.argsort(mixed(shingles + np.uint64(1)), kind="stable")[:n]]
        other = np.concatenate((own[lost:], mixed(own[:lost] + np.uint64(0xC0FFEE))))
        differ = (self.signatures(own) ^ self.signatures(other)).view(np.uint64)
        return np.array([(differ < (1 << LABEL_BITS * (DEEPEST - d))).sum() for d in range(1, DEEPEST + 1)], np.int64)


def set_hash(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set of shingles."""
    sums = np.array([shingles.sum(dtype=np.uint64), mixed(shingles).sum(dtype=np.uint64), len(shingles)], np.uint64)
    return int(mixed(sums * np.array([3, 5, 7], np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def sketches(docs: DataFrame, threshold: float) -> DataFrame:
    """key, doc_id, set (its hash), bytes of its shingles, signatures and, for some rows, met (what `Forest.probe` gives) of each row of (key, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in slices(batches, "text"):
            sets, sizes, found, met = [], [], [], []
            for s in shingle_sets(texts_of(batch)):
                sets.append(set_hash(s))
                sizes.append(8 * len(s))
                found.append(forest.signatures(s))
                met.append(forest.probe(s, threshold) if sets[-1] % PROBED == 0 else None)
            lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * forest.trees, np.concatenate(found))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64()), lists, pa.array(met, pa.list_(pa.int64()))], names=["key", "doc_id", "set", "bytes", "signatures", "met"])

    return docs.mapInArrow(run, "key long, doc_id long, set long, bytes long, signatures array<long>, met array<long>")


def measured(rows: DataFrame, threshold: float) -> list[float]:
    """The share of trees in which signatures at the threshold share 1, 2, ... labels; by the model of MinHash where no set was probed."""
    r = rows.filter("met is not null").agg(F.count("*").alias("n"), *[F.sum(F.get("met", F.lit(d))).alias(f"d{d}") for d in range(DEEPEST)]).first()
    if not r["n"]:
        return [threshold**d for d in range(1, DEEPEST + 1)]
    return [r[f"d{d}"] / (r["n"] * TREES) for d in range(DEEPEST)]


def with_shingles(docs: DataFrame) -> DataFrame:
    """set and its shingles (64-bit little-endian) of rows (set, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data = [s.astype("<u8").tobytes() for s in shingle_sets(texts_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array(data, pa.binary())], names=["set", "shingles"])

    return docs.mapInArrow(run, "set long, shingles binary")


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Whether each left set and each right one (or each two left ones) reach the threshold, exactly."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.float32)
    flat = np.concatenate(sets)
    _, code, seen = np.unique(flat, return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    shared = seen[code] > 1
    names, code = np.unique(code[shared], return_inverse=True)
    rows, n = rows[shared], len(left)
    common = np.zeros((n, len(sets) - n if right is not None else n), np.float32)
    stripe = max(64, STRIPE_CELLS // len(sets))
    for a in range(0, len(names), stripe):  # a stripe of shingles at a time
        own = (code >= a) & (code < a + stripe)
        has = np.zeros((len(sets), min(stripe, len(names) - a)), np.float32)
        has[rows[own], code[own] - a] = 1
        common += has[:n] @ (has[n:] if right is not None else has).T
    other = sizes[n:] if right is not None else sizes
    # counts are integers below 2**24, so both sides are exact up to the last comparison
    return common.astype(np.float64) >= threshold * (sizes[:n, None].astype(np.float64) + other[None, :] - common) - 1e-9


def in_blocks(members: DataFrame, group: str, count: str, volume: str) -> DataFrame:
    """Deals each group's members into blocks and repeats a member for every pair of blocks it is in.

    A block has about BLOCK members and BLOCK_BYTES at most, or one member.
    """
    n = F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(volume) / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64(F.col(group), F.col("set"), F.lit(7)), n).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.select(*[c for c in members.columns if c not in (count, volume)], "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def _sets(pdf: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    return pdf["set"].to_numpy(), [np.frombuffer(x, "<u8") for x in pdf["shingles"]]


def forest_of(names: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what is linked; rows with equal names are one vertex."""
    vertices, code = np.unique(names, return_inverse=True)
    i, j = np.nonzero(links)
    pairs = np.unique(np.minimum(code[i], code[j]).astype(np.int64) * len(vertices) + np.maximum(code[i], code[j]))
    root = list(range(len(vertices)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p in pairs.tolist():
        x, y = find(p // len(vertices)), find(p % len(vertices))
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(int(vertices[x]), int(vertices[find(x)])) for x in range(len(vertices)) if find(x) != x]


def linked(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Edges between the labels (components so far) that are linked between two blocks of one prefix."""
    low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    names, sets = pdf["label"].to_numpy(), _sets(pdf)[1]
    if low != high:
        first = pdf["own"].to_numpy() == low
        order = np.argsort(~first, kind="stable")
        names, sets, n = names[order], [sets[i] for i in order], int(first.sum())
        if not 0 < n < len(sets):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        links = np.zeros((len(sets), len(sets)), bool)
        links[:n, n:] = similar(sets[:n], sets[n:], threshold)
    else:
        links = np.triu(similar(sets, None, threshold), 1)
    edges = forest_of(names, links)
    return pd.DataFrame({"a": [x for x, _ in edges], "b": [y for _, y in edges]}, dtype="int64")


def counted(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Documents linked to each set, between two blocks of one class."""
    low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    names, sets = _sets(pdf)
    copies = pdf["copies"].to_numpy().astype(np.float64)
    total = np.zeros(len(sets))
    if low != high:
        a, b = (np.flatnonzero(pdf["own"].to_numpy() == x) for x in (low, high))
        if len(a) and len(b):
            links = similar([sets[i] for i in a], [sets[i] for i in b], threshold)
            total[a], total[b] = links @ copies[b], links.T @ copies[a]
    else:
        links = similar(sets, None, threshold)
        np.fill_diagonal(links, False)
        total = links @ copies
    return pd.DataFrame({"set": names, "links": total.astype("int64")})


def components(links: DataFrame) -> DataFrame:
    """set and label (the least set of its component) for every set that has a link (a, b)."""
    both = durable(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("set")).agg(F.least(F.min("b"), F.col("set")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.set).groupBy(F.col("a").alias("set")).agg(F.min("label").alias("near"))
        least = labels.join(near, "set").select("set", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("set").alias("to"), F.col("label").alias("far"))
        after = durable(least.join(jump, "to").select("set", F.least("to", "far").alias("label"), (F.least("to", "far") < F.col("label")).alias("moved")))
        labels = after.select("set", "label")
        if after.filter("moved").isEmpty():
            return labels


def node_at(depth: int) -> Column:
    """The node of a tree that a signature lies under at a depth."""
    return F.shiftright("signature", LABEL_BITS * (DEEPEST - depth))


def under_shared_nodes(sets: DataFrame, depth: int) -> DataFrame:
    """set and signature, for each tree in which a set shares a node of that depth with another one."""
    dealt = sets.select("set", F.explode("signatures").alias("signature"))
    shared = dealt.groupBy(node_at(depth).alias("node")).agg(F.count("*").alias("n")).filter("n > 1").select("node")
    return durable(dealt.withColumn("node", node_at(depth)).join(shared, "node").select("set", "signature"))


def joined_at(members: DataFrame, labels: DataFrame, shingles: DataFrame, volumes: DataFrame, depth: int, first: int, last: int, threshold: float) -> DataFrame:
    """labels after comparing, in the trees first to last - 1, the nodes of a depth that hold several labels."""
    tree = F.shiftright("signature", LABEL_BITS * DEEPEST)
    own = members.filter((tree >= first) & (tree < last)).select("set", node_at(depth).alias("node")).join(labels, "set").join(volumes, "set")
    nodes = own.groupBy("node").agg(F.count("*").alias("members"), F.sum("bytes").alias("volume"), F.sum(F.xxhash64("set").cast("decimal(20,0)")).alias("who"), (F.min("label") != F.max("label")).alias("several")).filter("several and members > 1")
    # of nodes with equal members, as trees repeat them, the first
    nodes = nodes.groupBy("members", "who").agg(F.min(F.struct("node", "volume")).alias("v")).select("v.node", "v.volume", "members")
    met = own.drop("bytes").join(nodes, "node")
    blocks = in_blocks(met, "node", "members", "volume").join(shingles, "set")
    links = blocks.groupBy("node", "low", "high").applyInPandas(lambda pdf: linked(pdf, threshold), "a long, b long")
    joined = components(links).select(F.col("set").alias("label"), F.col("label").alias("to"))
    return durable(labels.join(joined, "label", "left").select("set", F.coalesce("to", "label").alias("label")))


def jaccard_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, count_links: bool = True) -> DataFrame:
    """One row per row of docs: key, doc_id, class_id, class_first and, if asked for, n_links.

    class_id is the least document id of the class, class_first the key of one row that has it: rows
    are in one class when a chain of pairs at or above the threshold connects them. n_links counts
    the other rows at or above the threshold. Shingles are runs of five lower-cased words between
    ASCII white space, of the whole text however long; a text with fewer words is one shingle, and texts without words (null too) are
    equal to each other. Repeated rows link like any copies. Null ids come after all others as
    class_id; of rows with the least id the one with the least key is class_first. An empty table gives no rows; other columns are ignored.
    """
    key = row_key(docs[id_column], docs[text_column])
    plain = docs.select(key.alias("key"), docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    rows = durable(sketches(plain, threshold))
    sets = rows.groupBy("set").agg(F.count("*").alias("copies"), F.first("bytes").alias("bytes"), F.min_by("key", F.xxhash64("key")).alias("key"), F.min_by("signatures", F.xxhash64("key")).alias("signatures"))
    sets = durable(sets)
    last = depth_for(measured(rows, threshold), recall)
    members = under_shared_nodes(sets, last)
    labels = durable(members.select("set").distinct().withColumn("label", F.col("set")))
    wanted = sets.join(labels, "set", "left_semi").select("set", "key")
    found = plain.join(wanted.hint("shuffle_hash"), "key").groupBy("set").agg(F.first("text").alias("text"))
    shingles = durable(with_shingles(found))
    volumes = sets.select("set", "bytes")
    # most copies meet in a longer prefix of the first trees already; at the last depth, whose nodes hold those above, all trees
    # compare what could still join two classes
    for depth in range(DEEPEST, last - 1, -1):
        labels = joined_at(members, labels, shingles, volumes, depth, 0, TREES if depth == last else FIRST_TREES, threshold)
    copies = sets.select("set", "copies")
    if count_links:
        size = labels.join(volumes, "set").groupBy("label").agg(F.count("*").alias("size"), F.sum("bytes").alias("volume")).filter("size > 1")
        own = labels.join(size, "label").select(F.col("label").alias("class"), "set", "size", "volume")
        blocks = in_blocks(own, "class", "size", "volume").join(shingles.join(copies, "set"), "set")
        counts = blocks.groupBy("class", "low", "high").applyInPandas(lambda pdf: counted(pdf, threshold), "set long, links long").groupBy("set").agg(F.sum("links").alias("links"))
        copies = copies.join(counts, "set", "left")
    else:
        copies = copies.withColumn("links", F.lit(0).cast("long"))
    per_set = copies.join(labels, "set", "left").select("set", F.coalesce("label", "set").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    first = rows.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    named = durable(per_set.join(first, "set"))
    heads = named.groupBy("class").agg(F.min("first").alias("head"))
    where = named.join(heads, "class").select("set", "n_links", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("class_first"))
    out = rows.select("set", "key", "doc_id").join(where, "set").select("key", "doc_id", "class_id", "class_first", "n_links")
    return out if count_links else out.drop("n_links")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs without all but one row of each class: the one with the least id."""
    classes = jaccard_classes(docs, id_column, text_column, threshold, count_links=False)
    keyed, key, own = with_row_key(docs, id_column, text_column)
    heads = classes.filter("key = class_first and doc_id <=> class_id").select(F.col("key").alias(f"{key}2"), F.col("doc_id").alias(f"{own}2")).distinct()
    same = (F.col(key) == F.col(f"{key}2")) & F.col(own).eqNullSafe(F.col(f"{own}2"))
    kept = keyed.join(heads.hint("shuffle_hash"), same, "left_semi")
    return kept.dropDuplicates([key, own]).drop(key, own)
