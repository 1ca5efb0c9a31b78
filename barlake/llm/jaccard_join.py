"""N-gram Jaccard join of near-duplicate texts by a MinHash LSH forest, with exact verification.

1. Every text becomes a hash of its word sequence, the number of its distinct five-word shingles and a
   MinHash signature, the labels of ``TREES`` prefix tries of depth ``DEPTH``. Equal word sequences are one node.
2. In each trie, texts that share a prefix of the least depth that may be needed are linked to the least of
   them; connected components bound where links can be.
3. A component's members, in blocks of at most two chunks of ``CHUNK`` (so a large component is split
   over many tasks), are sorted in each trie, and the common prefixes of neighbours tell who meets at what depth. From the
   full depth on, pairs that meet are verified on their whole shingle sets, and the prefix is shortened until the recall
   reaches the target. It is estimated from the pairs found and from those that have not met: how far the whole signatures of
   such a pair agree tells how likely a pair at the threshold would agree no better, and so many links it may hide. Where
   only close copies and strangers lie in a block, the first depth is enough; where pairs near the threshold are left, the
   search goes on to the least depth, at which such pairs meet with the target probability. A task returns link counts and a
   spanning forest, never pairs.
4. Components of the verified links are the classes.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, joined_words, mix, pieces, table, texts_of, tune, windows
from .seeds import text_id

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 24, 7
TARGET_RECALL = 0.9999
CHUNK = 96

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def meeting(similarity: float, depth: int) -> float:
    """How likely a pair of that similarity shares a prefix of that depth in some trie."""
    return 1 - (1 - similarity**depth) ** TREES


def prefix_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The shortest prefix that any search can come to: there a pair at the threshold meets with the target probability."""
    return next((d for d in range(DEPTH, 1, -1) if meeting(threshold, d) >= target), 1)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Distinct hashed shingles of a text; one of fewer than five words is a single shingle."""
    n = len(hashes)
    return np.unique(windows(hashes, WORDS if n >= WORDS else n)) if n else hashes


def _signature_runs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, shingle set, signature) of each text with a word."""
    for i, j in pieces(texts, 1 << 20):
        hashes, at = joined_words(texts[i:j])
        sets = [(i + k, shingles(hashes[at[k] : at[k + 1]])) for k in range(j - i) if at[k + 1] > at[k]]
        if not sets:
            continue
        flat = (np.concatenate([s for _, s in sets]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(s) for _, s in sets])[:-1]))
        sig = np.empty((len(sets), TREES * DEPTH), dtype=np.uint32)
        with np.errstate(over="ignore"):
            for k in range(TREES * DEPTH):
                sig[:, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], starts)
        for row, (at_text, s) in enumerate(sets):
            yield at_text, s, sig[row]


def _labels(sig: np.ndarray, depth: int) -> np.ndarray:
    """64-bit names of the prefixes of each trie: rows of signatures to rows of names."""
    cube = sig.reshape(len(sig), TREES, DEPTH).astype(np.uint64)
    out = np.zeros((len(sig), TREES), dtype=np.uint64) + np.arange(1, TREES + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(depth):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cube[:, :, k])
    return out


def _features(depth: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        labels: list[np.ndarray | None] = [None] * len(texts)
        node: list[int | None] = [None] * len(texts)
        for k, _, sig in _signature_runs(texts):
            labels[k], node[k] = _labels(sig[None, :], depth)[0].view(np.int64), text_id(texts[k])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("row_key"), pa.array(node, pa.int64()), pa.array(labels, pa.list_(pa.int64()))],
            ["doc_id", "row_key", "node", "labels"],
        )

    return run


def _block_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Signature and shingle set of each member."""
    texts = texts_of(batch)
    sig: list[bytes | None] = [None] * len(texts)
    sets: list[bytes | None] = [None] * len(texts)
    for k, s, g in _signature_runs(texts):
        sig[k], sets[k] = g.tobytes(), s.tobytes()
    names = ["node", "copies", "comp", "chunk", "chunks"]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(n) for n in names), pa.array(sig, pa.binary()), pa.array(sets, pa.binary())], [*names, "sig", "sets"]
    )


def _common_prefixes(sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each trie the order of its labels, and how long a prefix each shares with the one before it."""
    for labels in sig.reshape(len(sig), TREES, DEPTH).transpose(1, 0, 2):
        order = np.lexsort(labels.T[::-1])
        same = labels[order][1:] == labels[order][:-1]
        yield order, np.concatenate(([0], np.minimum.accumulate(same, axis=1).sum(axis=1)))


@functools.cache
def _doubts(threshold: float) -> np.ndarray:
    """How likely a pair at the threshold has at most k equal values in its signatures, for each k."""
    n = TREES * DEPTH
    if threshold >= 1:
        return (np.arange(n + 1) == n).astype(float)
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(threshold) + (n - k) * math.log1p(-threshold) for k in range(n + 1)]
    return np.minimum(np.cumsum(np.exp(terms)), 1.0)


def shortened(sig: np.ndarray, sets: list[np.ndarray], open_: np.ndarray, floor: int, threshold: float, target: float) -> tuple[list[tuple[int, int]], int]:
    """Links among the open pairs (a matrix) of some texts, and the depth at which the search came to its end."""
    tries, pairs = list(_common_prefixes(sig)), []
    open_ = open_.copy()
    for depth in range(DEPTH, floor - 1, -1):
        meet = np.zeros_like(open_)
        for order, shared in tries:
            group = np.empty(len(sets), np.int64)
            group[order] = np.cumsum(shared < depth)
            meet |= group[:, None] == group[None, :]
        for a, b in zip(*(x.tolist() for x in np.nonzero(meet & open_))):
            # both arrays hold distinct values, so repeats in the merged one are common shingles
            both = np.concatenate((sets[a], sets[b]))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if common >= threshold * (len(both) - common):
                pairs.append((a, b))
        open_ &= ~meet
        if depth == floor:
            break
        missing = 0.0
        left = np.nonzero(open_)
        for k in range(0, len(left[0]), 1 << 12):
            a, b = (x[k : k + (1 << 12)] for x in left)
            missing += float(_doubts(threshold)[(sig[a] == sig[b]).sum(axis=1)].sum())
        if missing <= (1 - target) * max(len(pairs), 1):
            break
    return pairs, depth


def _verify(rows: list[dict], floor: int, threshold: float, target: float) -> Iterator[tuple[int, int | None, int | None]]:
    """(node, other, null) for a spanning forest of the verified links in a block, (node, null, links) for counts."""
    seen: dict[int, dict] = {}
    for r in rows:
        seen.setdefault(r["node"], r)
    rows = sorted(seen.values(), key=lambda r: r["node"])
    if len(rows) < 2:
        return
    chunk = np.array([r["chunk"] for r in rows])
    size = np.array([len(r["sets"]) // 8 for r in rows])
    # pairs to be looked at: the larger set is not too large for the threshold, and both chunks have a say
    open_ = np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size)
    if rows[0]["i"] != rows[0]["j"]:
        open_ &= chunk[:, None] != chunk[None, :]
    sig = np.frombuffer(b"".join(r["sig"] for r in rows), dtype=np.uint32).reshape(len(rows), -1)
    pairs, _ = shortened(sig, [np.frombuffer(r["sets"], dtype=np.uint64) for r in rows], np.triu(open_, 1), floor, threshold, target)
    links = np.zeros(len(rows), dtype=np.int64)
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        links[a] += rows[b]["copies"]
        links[b] += rows[a]["copies"]
        x, y = root(a), root(b)
        if x != y:
            parent[y] = x
            yield rows[a]["node"], rows[b]["node"], None
    for k in np.flatnonzero(links):
        yield rows[k]["node"], None, int(links[k])


def _verifier(floor: int, threshold: float, target: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(b.to_pylist() for b in batches)
        for _, block in itertools.groupby(rows, key=lambda r: (r["comp"], r["i"], r["j"])):
            out = list(_verify(list(block), floor, threshold, target))
            if out:
                a, b, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "links"])

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, row_key, text_key, node, class_id, n_copies, n_links) for each row of docs (doc_id, text, ...).

    class_id: least doc_id of the rows connected by links of at least the threshold; node: least doc_id
    with the same word sequence, text_key: a 64-bit hash of it; class_key: the least text_key of the class; n_copies: rows with that sequence; n_links: other rows
    linked directly, copies included; row_key: xxhash64 of all columns of the row. Texts that are null or without a word stand alone
    (text_key null). Words are taken as they stand. Rows of null doc_id take part like others; a doc_id given to
    several texts stands in the class of each.
    """
    tune(docs.sparkSession)
    floor = prefix_depth(threshold, target)
    docs = docs.select("doc_id", "text", F.xxhash64(*docs.columns).alias("row_key"))
    found = table(arrow_map(docs, _features(floor), "doc_id long, row_key long, node long, labels array<long>"), "forest")
    texts = found.where("node is not null")
    nodes = table(texts.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("row_key").alias("row"), F.count("*").alias("copies")), "nodes")
    # one row of labels a node
    leaves = texts.select("row_key", "labels").join(nodes.select("node", F.col("row").alias("row_key")), "row_key")
    leaves = leaves.select("node", F.explode("labels").alias("label")).distinct()
    first = leaves.groupBy("label").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    star = leaves.join(first, "label").where("node <> b").select(F.col("node").alias("a"), "b")
    comp = table(components(star, "candidates"), "members")
    sizes = comp.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = comp.join(sizes, "root").join(nodes, "node").select(
        "node", "copies", "row", F.col("root").alias("comp"), "chunks",
        F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int").alias("chunk"),
    )
    members = docs.join(members, docs["row_key"] == members["row"]).select("text", "node", "copies", "comp", "chunk", "chunks")
    rows = arrow_map(members, _block_rows, "node long, copies long, comp long, chunk int, chunks int, sig binary, sets binary")
    blocks = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "comp", F.least("chunk", "x").alias("i"), F.greatest("chunk", "x").alias("j"), "node", "copies", "chunk", "sig", "sets"
    )
    blocks = blocks.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    verified = table(blocks.mapInArrow(_verifier(floor, threshold, target), "a long, b long, links long"), "verified")
    classes = components(verified.where("b is not null").select("a", "b"), "classes")
    links = verified.where("links is not null").groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    named = nodes.join(classes, "node", "left").join(links, "node", "left").select(
        "node", "first_id", "copies", "links", F.coalesce("root", "node").alias("class_key")
    )
    named = table(named, "named")
    least = named.groupBy("class_key").agg(F.min("first_id").alias("class_id"))
    named = named.join(least, "class_key")
    one = F.lit(1).cast("long")
    return found.select("doc_id", "row_key", "node").join(named, "node", "left").select(
        "doc_id", "row_key", F.col("node").alias("text_key"), "class_key",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first_id")).alias("node"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", one).alias("n_copies"),
        (F.coalesce("copies", one) - 1 + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links"),
    )
