"""Repeated passages by a sparse suffix array over word positions.

Suffixes are kept only where the content selects them: the minimisers of ``KEY``-word keys over
``WINDOW`` positions, so any passage of KEY + WINDOW - 1 words has the same ones in every text. Suffixes whose
key another text has too are sorted over the cluster by key and what follows, in ranges that split a
very common key like any other. Each is compared with the nearest suffix of another text on either side, and
the match extended to the left and right; once more in the order of what precedes. The ends of ranges are compared in a
second, small pass (four rows a range). Extensions compare two bytes a word, and the longest partner may be the nearest in neither
order; so an exact check follows: the windows of ``MIN_WORDS`` words around the kept positions are hashed and meet in packed
buckets, and a passage counts as far as such windows stand in another text too.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BASE_INV, _power, arrow_map, joined_words, mix, pieces, table, texts_of, tune, windows
from .seeds import bucketed, places_in, places_out, repeated, text_id, texts_and_rows, unbucketed, with_texts

KEY, WINDOW, MIN_WORDS = 16, 16, 50
#: Words in a bucket.
BUCKET = 4_000_000
#: Words that a match is extended by on each side of an anchor's key; neighbouring anchors carry on from there.
REACH = MIN_WORDS - KEY
_FIELDS = ["side", "key", "first", "second", "tid", "pos", "left", "right"]
_SHAPE = "side int, key long, first binary, second binary, tid long, pos int, left int, right int"


def _suffixes(least: int, buckets: int):
    """Both orders of each wanted position: its key, the words behind it (nearest first) and before it (nearest first).

    With side 2, windows of that many words that take in a wanted key, packed: their buckets stand in key, hashes, texts and starts in first.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, tids, spots = texts_of(batch), batch.column("tid").to_pylist(), batch.column("spots").to_pylist()
        rows: list[tuple] = []
        found: list[tuple] = []
        for i, j in pieces(texts, 1 << 20):
            hashes, at = joined_words(texts[i:j])
            names = _long_windows(hashes, least)
            for n in range(i, j):
                if text_id(texts[n]) != tids[n]:
                    continue
                begin, size = at[n - i], at[n - i + 1] - at[n - i]
                words = hashes[begin : begin + size]
                keys = windows(words, KEY).view(np.int64)
                short = (words >> np.uint64(48)).astype(">u2")
                padded = np.concatenate((np.zeros(REACH, ">u2"), short, np.zeros(REACH, ">u2")))
                where = np.array(sorted(spots[n]))
                for p in where.tolist():
                    left, right = min(REACH, p), min(REACH, len(words) - p - KEY)
                    after = padded[p + KEY + REACH : p + KEY + 2 * REACH].tobytes()
                    before = padded[p : p + REACH][::-1].tobytes()
                    rows.append((0, int(keys[p]), after, before, tids[n], p, left, right))
                    rows.append((1, int(keys[p]), before, after, tids[n], p, left, right))
                if size >= least:
                    first = np.maximum(where - max(0, least - KEY), 0)
                    edge = np.bincount(first, minlength=size + 1) - np.bincount(where + 1, minlength=size + 1)
                    start = np.flatnonzero(np.cumsum(edge)[: size - least + 1])
                    found.append((names[begin + start], np.full(len(start), tids[n]), start.astype("<i4")))
        if found:
            columns = [np.concatenate(c) for c in zip(*found)]
            for packed in places_out(*columns, buckets):
                rows += [(2, b, d, None, None, None, None, None) for b, d in zip(packed.column("bucket").to_pylist(), packed.column("data").to_pylist())]
        return _batch(rows)

    return run


def _batch(rows: list[tuple], extra: tuple = ()) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *extra]
    columns = list(zip(*rows)) or [[] for _ in types]
    names = [*_FIELDS, "part", "start", "end"][: len(types)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _extent(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows of a and b, up to limit."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, limit)


def compare(side, key, first, second, tid, left, right) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sorted suffix the longest match with a neighbour of another text: words, and how far left and right."""
    n = len(key)
    best, bl, br = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    change = np.flatnonzero(np.concatenate(([True], (tid[1:] != tid[:-1]) | (key[1:] != key[:-1]) | (side[1:] != side[:-1]), [True])))
    run = np.repeat(np.arange(len(change) - 1), np.diff(change))
    for other in (change[run + 1], change[run] - 1):  # the next and the last suffix of another text
        ok = np.flatnonzero((other >= 0) & (other < n))
        o = other[ok]
        same = (key[ok] == key[o]) & (side[ok] == side[o])
        ok, o = ok[same], o[same]
        lim_r, lim_l = np.minimum(right[ok], right[o]), np.minimum(left[ok], left[o])
        forward = side[ok] == 0
        x = _extent(first[ok], first[o], np.where(forward, lim_r, lim_l))
        y = _extent(second[ok], second[o], np.where(forward, lim_l, lim_r))
        r, l = np.where(forward, x, y), np.where(forward, y, x)
        more = l + r + KEY > best[ok]
        at = ok[more]
        best[at], bl[at], br[at] = (l + r + KEY)[more], l[more], r[more]
    return best, bl, br


def _matcher(least: int, edges: bool):
    def arrays(batch: pa.Table) -> tuple:
        col = lambda n: batch.column(n).to_numpy()
        words = lambda n: np.frombuffer(b"".join(batch.column(n).to_pylist()), ">u2").reshape(-1, REACH)
        return col("side"), col("key"), words("first"), words("second"), col("tid"), col("left"), col("right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, began, parted = TaskContext.get().partitionId(), None, None, False
        batches = (b for b in batches if b.num_rows)
        for batch, more in _with_more(batches):
            now = pa.Table.from_batches([batch]).select(_FIELDS)
            if held is not None:
                now = pa.concat_tables([held, now])
            best, bl, br = compare(*arrays(now))
            pos = now.column("pos").to_numpy()
            hit = np.flatnonzero(best >= least)
            if len(hit):
                tid = now.column("tid").to_numpy()[hit]
                yield _spans(tid, (pos - bl)[hit], (pos + KEY + br)[hit])
            tids = now.column("tid").to_numpy()
            if edges and began is None:
                yield _edge(now, [0], part)
                began = tids[0]
            if edges and not parted and len(other := np.flatnonzero(tids != began)):
                yield _edge(now, other[:1].tolist(), part)
                parted = True
            tail = np.flatnonzero(tids != tids[-1])[-1:].tolist() + [len(tids) - 1]
            if edges and not more:
                yield _edge(now, tail, part)
            held = now.slice(max(0, tail[0]))

    return run


def _with_more(items: Iterator) -> Iterator[tuple]:
    last = next(items, None)
    while last is not None:
        nxt = next(items, None)
        yield last, nxt is not None
        last = nxt


def _spans(tid, start, end) -> pa.RecordBatch:
    n = len(tid)
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), None, pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    columns = [pa.nulls(n, t) if t else pa.array(tid) for t in types]
    return pa.RecordBatch.from_arrays([*columns, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], [*_FIELDS, "part", "start", "end"])


def _edge(rows: pa.Table, at: list[int], part: int) -> pa.RecordBatch:
    picked = rows.take(at).to_pylist()
    return _batch([(*(r[f] for f in _FIELDS), part, None, None) for r in picked], (pa.int32(), pa.int32(), pa.int32()))


def _long_windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row, from sums, so at the same cost for any n."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _power("base", _BASE, len(hashes))[: len(hashes)], dtype=np.uint64)))
        return mix((sums[n:] - sums[:-n]) * _power("inverse", _BASE_INV, len(hashes))[: len(hashes) - n + 1])


_SPANS = [("tid", "<i8"), ("start", "<i4"), ("end", "<i4"), ("exact", "u1")]


def _shared_windows(least: int, buckets: int):
    """The windows that another text has too, packed by buckets of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tid, pos in places_in(batches):
            yield from _packed_spans(tid, pos, pos + least, 1, buckets)

    return run


def _packed_spans(tid: np.ndarray, start: np.ndarray, end: np.ndarray, exact: int, buckets: int) -> Iterator[pa.RecordBatch]:
    if len(tid):
        columns = [tid.astype("<i8"), start.astype("<i4"), end.astype("<i4"), np.full(len(tid), exact, "u1")]
        yield from bucketed((mix(tid.view(np.uint64)) % np.uint64(buckets)).astype(np.int32), columns)


def _proposed(buckets: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = list(_packed_spans(*(batch.column(n).to_numpy() for n in ("tid", "start", "end")), 0, buckets))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    return run


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of start, joined where they touch."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    begin = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))[: len(start)]
    return start[begin], end[np.append(begin[1:], len(start)) - 1] if len(start) else end


def _covered(start: np.ndarray, end: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """How much the spans, in order and apart, hold of all that is before each place."""
    if not len(start):
        return np.zeros(len(upto), np.int64)
    total = np.concatenate(([0], np.cumsum(end - start)))
    k = np.searchsorted(start, upto, side="right")
    return total[k] - np.where(k > 0, np.maximum(end[k - 1] - upto, 0), 0)


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the confirmed passages, and how many of their words no neighbour in suffix order gave."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for tid, start, end, exact in unbucketed(batches, _SPANS):
        texts, which = np.unique(tid, return_inverse=True)
        # texts lie one behind the other on one line
        start, end, sure = which.astype(np.int64) << 32 | start, which.astype(np.int64) << 32 | end, exact > 0
        a, b = _merged(start[sure], end[sure])
        if not len(a):
            continue
        p, q = _merged(start[~sure], end[~sure])
        rest = (b - a) - (_covered(p, q, b) - _covered(p, q, a))
        own = a >> 32
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        rest = np.add.reduceat(rest, begin)
        offsets = np.append(begin, len(a)).astype(np.int32)
        for k in range(0, len(begin), 1 << 14):
            part = offsets[k : k + (1 << 14) + 1]
            some = slice(part[0], part[-1])
            values = pa.StructArray.from_arrays([pa.array((v[some] & 0xFFFFFFFF).astype(np.int32)) for v in (a, b)], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(part - part[0], pa.int32()), values).cast(kind)
            yield pa.RecordBatch.from_arrays([pa.array(texts[own[part[:-1]]]), spans, pa.array(rest[k : k + (1 << 14)].astype(np.int32))], ["tid", "spans", "n_rest"])


def find(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, n_repeated, spans, n_rest) of documents with a passage of at least `least` words that another has too.

    spans: word positions, end exclusive, joined where they touch; n_rest: of their words, those that only the
    windows gave, as their partner is the nearest in neither order. Equal word sequences repeat as a whole. Null
    and empty texts and rows of null doc_id have none; a passage repeated within one text only is no match; a
    doc_id that stands at two texts gets a row for each. All passages of at least KEY + WINDOW - 1 words are found.
    """
    tune(docs.sparkSession)
    texts, rows = texts_and_rows(docs)
    buckets = max(8, int(texts.agg(F.sum("n_words")).first()[0] or 0) // BUCKET)
    wanted = repeated(docs, texts, KEY, WINDOW, buckets)
    suffixes = arrow_map(with_texts(docs, wanted).select("text", "tid", "spots"), _suffixes(least, buckets), _SHAPE)
    suffixes = table(suffixes, "suffixes", ["side"])
    order = ["side", "key", "first", "second", "tid", "pos"]
    ranged = suffixes.where("side < 2").repartitionByRange(*order).sortWithinPartitions(*order)
    shape = f"{_SHAPE}, part int, start int, end int"
    hits = table(ranged.mapInArrow(_matcher(least, True), shape), "hits")
    ends = hits.where("part is not null").select(*_FIELDS).distinct().coalesce(1).sortWithinPartitions(*order)
    spans = hits.where("part is null").select("tid", "start", "end").union(
        ends.mapInArrow(_matcher(least, False), shape).select("tid", "start", "end")
    )
    proposed = arrow_map(spans, _proposed(buckets), "bucket int, data binary")
    around = suffixes.where("side = 2").select(F.col("key").cast("int").alias("bucket"), F.col("first").alias("data"))
    around = around.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    confirmed = around.mapInArrow(_shared_windows(least, buckets), "bucket int, data binary")
    joined = proposed.union(confirmed).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    joined = joined.mapInArrow(_join_spans, "tid long, spans array<struct<start:int,end:int>>, n_rest int")
    copied = F.col("several") & (F.col("n_words") >= least)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))
    spans = F.when(copied, whole).otherwise(F.col("spans"))
    n = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    each = texts.join(joined, "tid", "left").select("tid", "n_words", spans.alias("spans"), F.when(copied, 0).otherwise(F.col("n_rest")).alias("n_rest"))
    each = table(each.where("spans is not null"), "spans")
    return rows.join(each, "tid").select("doc_id", "n_words", n.alias("n_repeated"), "spans", "n_rest")
