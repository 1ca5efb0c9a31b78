"""A Merkle manifest of a corpus: one root for all rows, and for each row the proof that ties it to the root.

Rows are placed by one range sort; blocks of 8^4 nodes are aligned to the tree, so each block is a subtree that one task
walks in postorder: the walk returns the digest of a subtree and appends, as it unwinds, the siblings of each child to the
leaves below that child. The roots of the blocks are the nodes of the next walk, until a language has one root; the roots of
the languages are then a tree of their own. No task holds more than a block, the driver nothing but the largest number of nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .common import table

FAN = 8
#: Levels that one task walks; a block has FAN ** LEVELS nodes.
LEVELS = 4
BLOCK = FAN**LEVELS
#: Columns that a leaf covers, in order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(columns: dict[str, Column]) -> Column:
    """Sha-256 of the columns, each ``-`` if null, else its count of UTF-8 bytes, a colon and the value."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*told).cast("binary"), 256))


def _node(children: list[bytes]) -> bytes:
    """Sha-256 of the children's digests as hex text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def _height(n: int) -> int:
    levels = 0
    while FAN**levels < n:
        levels += 1
    return levels


def walk(digests: list[bytes], levels: int) -> tuple[bytes, list[bytes]]:
    """Digest of the subtree of these nodes, ``levels`` high, and for each node its siblings, from below to above, left to right."""
    siblings = [bytearray() for _ in digests]

    def visit(first: int, level: int) -> bytes:
        if not level:
            return digests[first]
        width = FAN ** (level - 1)
        starts = range(first, min(len(digests), first + FAN * width), width)
        children = [visit(start, level - 1) for start in starts]
        for k, start in enumerate(starts):
            others = b"".join(children[:k] + children[k + 1 :])
            for leaf in range(start, min(len(digests), start + width)):
                siblings[leaf] += others
        return _node(children)

    return visit(0, levels), [bytes(s) for s in siblings]


def fold(digest: bytes, proof: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that a leaf and its siblings lead to; places: (place, number of nodes) of each tree on the way."""
    at, size = 0, len(digest)
    for i, n in places:
        while n > 1:
            k, run = i % FAN, min(FAN, n - i // FAN * FAN)
            others = [proof[at + j * size : at + (j + 1) * size] for j in range(run - 1)]
            at += (run - 1) * size
            digest = _node([*others[:k], digest, *others[k:]])
            i, n = i // FAN, -(-n // FAN)
    return digest


def _placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds i, the place in the order within g, and n, the rows of g. Equal rows stand in the order in which they were written."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["g", *order, "tie"]
    # ids count up within a partition of the range sort, so they are places there
    dealt = table(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33).alias("part")
    starts = dealt.groupBy(part, "g").agg(F.min("at").alias("least"), F.count("*").alias("c"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("part", "g", (before - F.col("least")).alias("shift"), F.sum("c").over(whole).alias("n"))
    return dealt.withColumn("part", part).join(starts, ["part", "g"]).withColumn("i", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _walked(nodes: DataFrame, name: str) -> DataFrame:
    """Adds to nodes (g, i, n, digest, ...) the block of each, the block's root and the siblings within the block."""
    rows = nodes.withColumn("block", F.floor(F.col("i") / BLOCK).cast("long"))

    shape = StructType(list(rows.schema.fields)).add("path", BinaryType()).add("root", BinaryType())

    def one(block: pa.Table) -> pa.Table:
        block = block.sort_by("i").combine_chunks()
        root, siblings = walk(block.column("digest").to_pylist(), min(LEVELS, _height(block.column("n")[0].as_py())))
        out = block.append_column("path", pa.array(siblings, pa.binary()))
        return out.append_column("root", pa.array([root] * len(out), pa.binary()))

    return table(rows.groupBy("g", "block").applyInArrow(one, shape), name)


def _blocks(walked: DataFrame) -> DataFrame:
    """The roots of blocks as nodes (g, i, n, digest)."""
    n = F.ceil(F.col("n") / BLOCK).cast("long").alias("n")
    return walked.where(F.col("i") % BLOCK == 0).select("g", F.col("block").alias("i"), n, F.col("root").alias("digest"))


def _tree(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with path, all siblings up to the root of their g; and (g, root)."""
    walked = _walked(nodes, name)
    blocks = _blocks(walked)
    if (walked.agg(F.max("n")).first()[0] or 0) <= BLOCK:
        return walked.drop("block", "root"), blocks.select("g", F.col("digest").alias("root"))
    higher, roots = _tree(blocks, name)
    above = higher.select("g", F.col("i").alias("block"), F.col("path").alias("above"))
    return walked.drop("root").join(above, ["g", "block"]).withColumn("path", F.concat("path", "above")).drop("block", "above"), roots


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, place, n, lang_place, langs): digests of every row of documents, as binary.

    A leaf covers doc_id, source, lang, n_chars and text. Per lang, leaves ascend by doc_id (null first; rows of one doc_id by
    their leaf); while several nodes remain, every eight consecutive ones become their digest, the last run from fewer, even
    from one. The languages' roots, by lang (null first, UTF-8 bytewise), likewise give the root. ``proof`` is what a leaf meets
    on its way: the other nodes of its run, level by level, left to right. Place and n say where in its lang a leaf stands.

    altered: text that rows are to be tried with; adds altered_leaf, the leaf of that text. An empty table gives no rows.
    """
    leaf = {c: F.col(c) for c in COVERED}
    # '' sorts before all others and stands for null
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("g")
    tried = [_leaf(leaf | {"text": altered}).alias("altered_leaf")] if altered is not None else []
    leaves = table(docs.select("doc_id", group, _leaf(leaf).alias("digest"), *tried), "merkle-leaves")
    walked = _walked(_placed(leaves, ["doc_id", "digest"], "merkle-leaves"), "merkle-leaves")
    blocks, subroots = _tree(_blocks(walked), "merkle-blocks")
    langs = _placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("lang_key"), F.col("root").alias("digest")), ["lang_key"], "merkle-langs")
    tops, root = _tree(langs, "merkle-langs")
    tops = tops.join(root, "g").select(F.col("lang_key").alias("g"), F.col("digest").alias("subroot"), F.col("i").alias("lang_place"), F.col("n").alias("langs"), F.col("path").alias("top"), "root")
    above = blocks.join(tops, "g").select("g", F.col("i").alias("block"), F.concat("path", "top").alias("above"), "subroot", "root", "lang_place", "langs")
    return walked.drop("root").join(above, ["g", "block"]).select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "above").alias("proof"), F.col("i").alias("place"), "n", "lang_place", "langs", *(["altered_leaf"] if tried else [])
    )


def audit(rows: DataFrame, leaf: str = "altered_leaf") -> DataFrame:
    """Adds proof_sha256, of the proof as hex text, folded_root, what that leaf and the proof lead to, and verified to rows of a manifest.

    A leaf that is null folds to null and is not verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(n).to_pylist() for n in ("proof", "place", "n", "lang_place", "langs", "root", leaf)}
            shas, roots, same = [], [], []
            for proof, place, n, top, langs, root, x in zip(*get.values()):
                shas.append(hashlib.sha256(proof.hex().encode()).hexdigest())
                roots.append(fold(x, proof, [(place, n), (top, langs)]) if x is not None else None)
                same.append(roots[-1] == root)
            more = [pa.array(shas, pa.string()), pa.array(roots, pa.binary()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "proof_sha256", "folded_root", "verified"])

    shape = StructType(list(rows.schema.fields)).add("proof_sha256", "string").add("folded_root", BinaryType()).add("verified", "boolean")
    return rows.mapInArrow(run, shape)
