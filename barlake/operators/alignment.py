"""All pairs of series and tracks whose cross-correlation reaches a bound: spectral sketches rule pairs out before arrays meet.

A correlation of two standardised series at any lag is an integral over frequency of the product of their spectra. By
Cauchy-Schwarz, band by band, its size is at most the sum over bands of the roots of both energies there, over the shorter
length. The roots of a series' band energies are its sketch, so an inner product of two sketches bounds all lags at once;
the greatest roots of a block of sketches bound all its pairs with another block. Blocks that may hold a pair meet with their
series, whose spectra serve all pairs of the two. What a bound rules out cannot reach it:
the result is that of all pairs.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import signal as s
from ..session import shared_folder
from .grouped import Part, by_group
from .order import placed

#: Bands of a sketch, narrower towards slow movement, and sketches of a block.
BANDS, BLOCK = 64, 256
#: Samples of a block (a longer series is a block of its own), and values that are transformed at once.
SAMPLES, FLAT = 1 << 17, 1 << 21
#: Values of a panel of blocks, and samples up to which series are multiplied lag by lag where many of their pairs are wanted.
PANEL, SHORT = 1 << 18, 128
EDGES = np.pi * (np.arange(BANDS + 1) / BANDS) ** 2


def sketch(y: np.ndarray) -> np.ndarray:
    """Roots of the band energies of a series, standardised as for its correlation; a little above the exact ones."""
    x = (y - y.mean()) / (y.std() + 1e-9)
    r = s.products(x, x)[len(x) - 1 :]
    k = np.arange(1, len(x))
    # the integral of the energy up to each edge, from the autocorrelation
    upto = np.array([(r[0] * w + 2 * (r[1:] * np.sin(w * k) / k).sum()) / np.pi for w in EDGES.tolist()])
    return np.sqrt(np.maximum(np.diff(upto), 0) + 1e-10 * max(r[0], 1.0))


def sketches(rows: DataFrame, key: str, hz: float, on: str | None = None) -> DataFrame:
    """(id, key, on, n, y, sketch, peak): each series (key, t, y) on a common grid, written once; peak is its strongest band.

    Series that the grid has no point of are left out. Ids tell rows apart where a key is null or stands in several sessions.
    """

    def fn(part: Part) -> list[tuple]:
        t, y = np.asarray(part["t"], float), np.asarray(part["y"], float)
        grid = np.arange(t[0], t[-1], 1 / hz)
        if not len(grid):
            return []
        on_grid = np.interp(grid, t, y)
        roots = sketch(on_grid)
        return [(len(grid), on_grid.tolist(), roots.tolist(), int(roots.argmax()))]

    session = F.lit(0) if on is None else F.col(on)
    named = rows.select(F.col(key).alias("key"), session.alias("on"), "t", "y").where("t is not null and y is not null")
    made = by_group(named, ["key", "on"], fn, "n long, y array<double>, sketch array<double>, peak int")
    path = f"{shared_folder(rows.sparkSession)}/sketches-{uuid.uuid4().hex}"
    made.withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _blocks(made: DataFrame, side: str) -> DataFrame:
    """(on, class, side, ids, keys, ns, roots, ys, most, mean): blocks of like sketches, with their series one behind the other.

    most and mean are the greatest root, and root over length, of each band. Series meet in classes by the bits of their length, so
    that a block of long ones holds fewer.
    """
    size = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"shiftright({SAMPLES}, class)"))).cast("long")
    rows = placed(made.select("on", F.length(F.bin("n")).alias("class"), "peak", "n", "id"), ["peak", "n", "id"], ["on", "class"]).where("on is not null")
    full = rows.select("on", "class", "id", F.floor(F.col("place") / size).alias(side)).join(made.select("id", "key", "n", "sketch", "y"), "id")
    held = full.groupBy("on", "class", side).agg(F.collect_list(F.struct("id", "key", "n", "sketch", "y")).alias("rows"))

    def greatest(scaled: bool) -> Column:
        def take(most: Column, row: Column) -> Column:
            return F.zip_with(most, row["sketch"], lambda a, b: F.greatest(a, b / row["n"] if scaled else b))

        return F.aggregate("rows", F.array_repeat(F.lit(0.0), BANDS), take)

    part = lambda c: F.transform("rows", lambda r: r[c])
    return held.select(
        "on", F.col("class").alias(f"class_{side}"), side, part("id").alias(f"ids_{side}"), part("key").alias(f"keys_{side}"), part("n").alias(f"ns_{side}"),
        F.flatten(part("sketch")).alias(f"roots_{side}"), F.flatten(part("y")).alias(f"ys_{side}"), greatest(False).alias(f"most_{side}"), greatest(True).alias(f"mean_{side}"),
    )


def _inner(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _met(left: DataFrame, right: DataFrame, least: float, columns: list[str]) -> DataFrame:
    """These columns of both blocks (named with their sides) of each two blocks within a session that may hold a pair which correlates by ``least``.

    A block is dealt once, into a panel, and the panels of one side meet those of the other where they lie: what is shuffled grows with the
    blocks, not with their meetings. Only where blocks are far more than sessions have pairs (many tiny sessions) they are sent to each other by session.
    """
    spark = left.sparkSession
    folder = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"
    for rows, side in ((left, "a"), (right, "b")):
        _blocks(rows, side).write.parquet(f"{folder}/{side}")
    sides, counts, size = [], [], {}
    for side in "ab":
        rows = spark.read.parquet(f"{folder}/{side}")
        count, values = rows.agg(F.count("*"), F.sum(F.size(f"ys_{side}") + F.size(f"roots_{side}"))).first()
        panels = max(1, min(count, max(math.isqrt(4 * spark.sparkContext.defaultParallelism) + 1, -(-(values or 0) // PANEL))))
        sides.append(rows.select("on", *[f"{c}_{side}" for c in dict.fromkeys(("most", "mean", *columns))]).repartition(panels))
        counts.append(count)
        size[side] = rows.groupBy("on").agg(F.sum(F.size(f"ns_{side}")).alias(side))
    pairs = size["a"].join(size["b"], "on").agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0
    one, two = sides[0].withColumnRenamed("on", "on_a"), sides[1].withColumnRenamed("on", "on_b")
    if counts[0] * counts[1] <= pairs:
        two = two.hint("shuffle_replicate_nl")
    may = F.greatest(_inner("mean_a", "most_b"), _inner("most_a", "mean_b")) >= least - 1e-9
    return one.join(two, (F.col("on_a") == F.col("on_b")) & may).select(*[f"{c}_{side}" for side in "ab" for c in columns])


def _bounded(ns_a: np.ndarray, roots_a: np.ndarray, ns_b: np.ndarray, roots_b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of two blocks may correlate by ``least``."""
    return roots_a.reshape(-1, BANDS) @ roots_b.reshape(-1, BANDS).T / np.minimum(ns_a[:, None], ns_b[None, :]) >= least - 1e-9


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): ids of the pairs of ``sketches`` within a session that may correlate by ``least``; sketches are multiplied block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids_a, ns_a, roots_a, ids_b, ns_b, roots_b = (batch.column(k)[row].values.to_numpy() for k in range(6))
                i, j = np.nonzero(_bounded(ns_a, roots_a, ns_b, roots_b, least))
                yield pa.RecordBatch.from_arrays([pa.array(ids_a[i]), pa.array(ids_b[j])], names=["a", "b"])

    return _met(left, right, least, ["ids", "ns", "roots"]).mapInArrow(run, "a long, b long")


def _standardised(ns: np.ndarray, ys: np.ndarray, backwards: bool = False) -> np.ndarray:
    """Series of a block as rows, standardised, zeros behind them; backwards: mirrored, zeros before them."""
    out, at = np.zeros((len(ns), int(ns.max()))), np.cumsum(ns) - ns
    for row, a, n in zip(out, at.tolist(), ns.tolist()):
        x = ys[a : a + n]
        row[:n] = (x - x.mean()) / (x.std() + 1e-9)
    return out[:, ::-1] if backwards else out


def _lag_by_lag(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(products, lags) of all pairs of rows of two blocks at the lag where the product is greatest by size, the least of such lags."""
    n, m = x.shape[1], y.shape[1]
    y = np.ascontiguousarray(y.T)
    shape = (len(x), y.shape[1])
    c, size, best = np.empty(shape), np.empty(shape), np.full(shape, -1.0)
    more, down, code, at = np.empty(shape, bool), np.empty(shape, bool), np.empty(shape, np.int16), np.zeros(shape, np.int16)
    for lag in range(1 - m, n):
        i, j = max(lag, 0), max(-lag, 0)
        k = min(n - i, m - j)
        np.matmul(x[:, i : i + k], y[j : j + k], out=c)
        np.abs(c, out=size)
        np.greater(size, best, out=more)
        np.maximum(size, best, out=best)
        # lags rise, so the greatest code is the last that was better: the lag, and whether the product is negative
        np.signbit(c, out=down)
        np.add(down, np.int16(2 * (lag + m)), out=code)
        np.multiply(code, more, out=code)
        np.maximum(code, at, out=at)
    return np.where(at & 1, -best, best), (at >> 1).astype(np.int64) - m


def best_lags(ns_a: np.ndarray, ys_a: np.ndarray, ns_b: np.ndarray, ys_b: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, r, lag) of the wanted pairs of two blocks, as ``signal.correlate_lags`` of each.

    Short series of which many pairs are wanted are multiplied as matrices, lag by lag; else every series is transformed once for many pairs.
    """
    if not wanted.any():
        return
    if max(ns_a.max(), ns_b.max()) <= SHORT and wanted.mean() > 0.25:
        c, lag = _lag_by_lag(_standardised(ns_a, ys_a), _standardised(ns_b, ys_b))
        i, j = np.nonzero(wanted)
        yield i, j, c[i, j] / np.minimum(ns_a[i], ns_b[j]), lag[i, j]
        return
    x, y = _standardised(ns_a, ys_a), _standardised(ns_b, ys_b, True)
    n = x.shape[1] + y.shape[1] - 1
    size = 1 << (n - 1).bit_length()
    step = max(1, FLAT // size)
    for begin in range(0, len(y), step):
        spectra = np.fft.rfft(y[begin : begin + step], size)
        for i in np.flatnonzero(wanted[:, begin : begin + step].any(axis=1)).tolist():
            j = np.flatnonzero(wanted[i, begin : begin + step])
            c = np.fft.irfft(spectra[j] * np.fft.rfft(x[i], size), size)[:, :n]
            k = np.abs(c).argmax(axis=1)
            yield np.full(len(j), i), begin + j, c[np.arange(len(j)), k] / np.minimum(ns_a[i], ns_b[begin + j]), k - (y.shape[1] - 1)


def align_above(left: DataFrame, right: DataFrame, least: float, hz: float = 50.0, on: str | None = None) -> DataFrame:
    """(recording_id, clip, r, lag) of every series (recording_id, t, y) and track (clip, t, y) whose best cross-correlation is at least ``least`` in size.

    These are the rows of ``recordings.align_all`` with abs(r) >= least, without its bound on pairs: pairs that the
    sketches rule out are not correlated. on: a column of both within which they meet (null: nowhere). Samples of null t or y
    are left out, and so are series without a second grid point.
    """
    if not least > 0:
        raise ValueError("least must be over 0, since any pair reaches 0; align_all lists all pairs")
    a, b = sketches(left, "recording_id", hz, on), sketches(right, "clip", hz, on)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys_a, ns_a, roots_a, ys_a, keys_b, ns_b, roots_b, ys_b = (batch.column(k)[row].values for k in range(8))
                ns_a, roots_a, ys_a, ns_b, roots_b, ys_b = (c.to_numpy() for c in (ns_a, roots_a, ys_a, ns_b, roots_b, ys_b))
                found = list(best_lags(ns_a, ys_a, ns_b, ys_b, _bounded(ns_a, roots_a, ns_b, roots_b, least)))
                if not found:
                    continue
                i, j, r, lag = (np.concatenate(c) for c in zip(*found))
                on = np.abs(r) >= least
                columns = [keys_a.take(pa.array(i[on])), keys_b.take(pa.array(j[on])), pa.array(r[on]), pa.array(lag[on].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["recording_id", "clip", "r", "lag"])

    shape = StructType([StructField("recording_id", a.schema["key"].dataType), StructField("clip", b.schema["key"].dataType), *StructType.fromDDL("r double, lag int").fields])
    return _met(a, b, least, ["keys", "ns", "roots", "ys"]).mapInArrow(run, shape)


__all__ = ["align_above", "best_lags", "candidates", "sketch", "sketches"]
