"""Content-selected word positions that passage operators share: minimisers and what texts they are in."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, joined_words, mix, pieces, table, texts_of, windows


def text_id(text: bytes) -> int:
    """64-bit signed hash of the word sequence."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.split())) - (1 << 63)


def minimisers(keys: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least key of some window of keys (all of equal ones); all in order, each once."""
    if len(keys) <= window:
        return np.flatnonzero(keys == keys.min()) if len(keys) else np.zeros(0, dtype=np.int64)
    least = _sliding(keys, window, np.minimum)
    pad = np.zeros(window - 1, keys.dtype)
    return np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), window, np.maximum) == keys)


def _sliding(x: np.ndarray, window: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each window, by doubling."""
    n, width = len(x) - window + 1, 1
    while 2 * width <= window:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[:n], x[window - width : window - width + n])


def sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, n_words): a row a document; documents of null id or without a word give nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("doc_id").to_pylist()
        rows = [(d, text_id(t), len(t.split())) for d, t in zip(ids, texts_of(batch)) if d is not None and t.strip()]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "tid", "n_words"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, tid long, n_words int")


def bucketed(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(bucket, data): the columns' values of each bucket, compressed into one row."""
    import zstandard

    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    columns = [c[order] for c in columns]
    names, starts = np.unique(bucket[order], return_index=True)
    ends = [*starts[1:], len(order)]
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for k in range(0, len(names), 64):
        data = [squeeze(len(columns[0][a:b]).to_bytes(8, "little") + b"".join(c[a:b].tobytes() for c in columns)) for a, b in zip(starts[k : k + 64], ends[k : k + 64])]
        yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 64], pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])


def unbucketed(batches: Iterator[pa.RecordBatch], kinds: list[tuple[str, str]] | Callable[[int], list[tuple[str, str]]]) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket of rows sorted by bucket; kinds: their numpy types, or a function of the bucket that tells them."""
    import zstandard

    rows = itertools.chain.from_iterable(zip(b.column("bucket").to_pylist(), b.column("data")) for b in batches)
    for bucket, group in itertools.groupby(rows, key=lambda r: r[0]):
        parts: list[list[np.ndarray]] = []
        for _, data in group:
            raw, at = zstandard.decompress(data.as_buffer()), 8
            n, one = int.from_bytes(raw[:8], "little"), []
            for _, kind in kinds(bucket) if callable(kinds) else kinds:
                one.append(np.frombuffer(raw, kind, n, at))
                at += one[-1].nbytes
            parts.append(one)
        yield [np.concatenate(c) for c in zip(*parts)]


_PLACES = [("key", "<u8"), ("tid", "<i8"), ("pos", "<i4"), ("sure", "u1")]


def new_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Texts and their ids, of each batch those that the task has not met; rows of null doc_id have none.

    So copies of a text cost a task one, however many there are; what other tasks have is sorted out by text id.
    """
    met: set[int] = set()
    for batch in batches:
        texts = [t for t, d in zip(texts_of(batch), batch.column("doc_id").to_pylist()) if d is not None]
        tids = [text_id(t) for t in texts]
        new = [k for k, t in enumerate(tids) if t not in met and not met.add(t)]
        if len(met) > 1_000_000:
            met.clear()
        yield [texts[k] for k in new], np.array([tids[k] for k in new], np.int64)


def _anchors(k: int, window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, tids in new_texts(batches):
            for i, j in pieces(texts, 4 << 20):
                hashes, at = joined_words(texts[i:j])
                parts = []
                for n in range(j - i):
                    keys = windows(hashes[at[n] : at[n + 1]], k)
                    where = minimisers(keys, window)
                    parts.append((keys[where], np.full(len(where), tids[i + n]), where.astype("<i4")))
                key, tid, pos = (np.concatenate(c) for c in zip(*parts))
                yield from places_out(key, tid, pos, buckets)

    return run


def shared_places(key: np.ndarray, tid: np.ndarray) -> np.ndarray:
    """Numbers of the places whose key another text has too."""
    order = np.argsort(key, kind="stable")
    if not len(order):
        return order
    begin = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    sorted_tid = tid[order]
    several = np.minimum.reduceat(sorted_tid, begin) != np.maximum.reduceat(sorted_tid, begin)
    return order[np.repeat(several, np.diff(np.append(begin, len(order))))]


def places_out(key: np.ndarray, tid: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The places of a run of texts on their way to the buckets of their keys.

    Where the run itself shows that two texts have a key, its places are sure and go anywhere (by text), and one of them stands for
    them in the key's bucket: a key that very many texts have costs that bucket a place a run.
    """
    at = shared_places(key, tid)
    alone = np.ones(len(key), bool)
    alone[at] = False
    sent = np.concatenate((np.flatnonzero(alone), at[np.unique(key[at], return_index=True)[1]]))
    columns = [np.concatenate((v[sent], v[at])) for v in (key, tid, pos)]
    sure = np.repeat(np.array([0, 1], "u1"), [len(sent), len(at)])
    bucket = np.where(sure > 0, mix(columns[1].view(np.uint64)), columns[0]) % np.uint64(buckets)
    yield from bucketed(bucket.astype(np.int32), [*columns, sure])


def places_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, position) of the places in buckets of places_out() whose key another text has too; some come twice."""
    for key, tid, pos, sure in unbucketed(batches, _PLACES):
        known = np.flatnonzero(sure)
        met = np.flatnonzero(sure == 0)
        at = np.concatenate((known, met[shared_places(key[met], tid[met])]))
        yield tid[at], pos[at]


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tid, pos in places_in(batches):
        for k in range(0, len(tid), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(tid[k : k + (1 << 16)]), pa.array(pos[k : k + (1 << 16)])], ["tid", "pos"])


def repeated(docs: DataFrame, texts: DataFrame, k: int, window: int, buckets: int) -> DataFrame:
    """(tid, doc_id, spots) for texts with minimiser keys of k words that another text has too: their least document and these positions.

    texts: (tid, doc_id), a row a text. Places meet in packed buckets of keys.
    """
    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_anchors(k, window, buckets), "bucket int, data binary")
    packed = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    places = packed.mapInArrow(_shared_anchors, "tid long, pos int")
    return places.groupBy("tid").agg(F.collect_set("pos").alias("spots")).join(texts.select("tid", "doc_id"), "tid")


def texts_and_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables (tid, doc_id, n_words, several) of texts and (doc_id, tid) of rows: a text's least document and whether others have it too.

    A text that very many rows have is one row of the first, so that a join with it can be split on the side of the rows.
    """
    found = table(sequences(docs), "rows")
    several = (F.min("doc_id") != F.max("doc_id")).alias("several")
    texts = table(found.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.min("n_words").alias("n_words"), several), "texts")
    return texts, found.select("doc_id", "tid")


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Joins wanted (doc_id, ...) with the texts of its documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(wanted, "doc_id")
