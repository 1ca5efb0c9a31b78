"""Shared pieces: tables in the shared folder, Arrow batches, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these (space, tab to carriage return).
WORD_SPLIT = "[^ \\t-\\r]+"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}
_own: list[str] = []


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, since one row may be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where that is unset, a local one if all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="barlake-shared-"))
        path = _own[0]
    return path.rstrip("/")


def table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends here, and a lost executor costs nothing.

    The shuffle files behind the write go as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        full = np.full(max(n, _CHUNK), base, dtype=np.uint64)
        full[0] = 1
        with np.errstate(over="ignore"):
            _powers[name] = np.cumprod(full, dtype=np.uint64)
    return _powers[name]


def word_hashes(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end byte of every word of data, without a Python step a word.

    The hash of a word depends on its bytes alone. Temporary memory is about 40 bytes a byte of a
    chunk of 1 MB, or of the longest word.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    solid = ~_SPACE[raw]
    edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + _CHUNK)))
            a, b = int(starts[i]), int(ends[j - 1])
            sums = np.zeros(b - a + 1, dtype=np.uint64)
            np.cumsum(_CODES[raw[a:b]] * _power("base", _BASE, b - a)[: b - a], dtype=np.uint64, out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * _power("inverse", _BASE_INV, b - a)[s]
            i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) << np.uint64(48))), starts, ends


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as bytes; null: empty."""
    return [x or b"" for x in batch.column(column).cast(pa.string()).cast(pa.binary()).to_pylist()]


def pieces(texts: list[bytes], limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of at most limit bytes, or a single longer one."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= limit:
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def joined_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all the texts, and for each text where its words begin (one more at the end)."""
    data = b"\n".join(texts)
    hashes, starts, _ = word_hashes(data, lower)
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return hashes, np.searchsorted(starts, begins)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * _BASE + hashes[k : len(hashes) - n + 1 + k])
    return out


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of edges (a, b: long, not null); root is the least node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014); each ends in a written table, so
    that no lineage grows. The joins are plain equi-joins, which adaptive execution splits on hot keys.
    """
    cur = table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )

    def stat(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    seen = stat(cur)
    for _ in range(rounds):
        if not seen[0]:
            break
        # the least neighbours are tables of their own, so that each join stands alone between its exchanges
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), name)
        large = table(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        low = table(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        cur = table(small.union(low.select("a", F.col("m").alias("b"))).distinct(), name)
        now = stat(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    star = cur.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return star.union(roots)
