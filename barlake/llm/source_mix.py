"""Mixing sources to target weights by entropy balancing.

Each document gets a rate in [0, 3]; among all rates that meet the token constraint of every source, the
ones that diverge least from 1 are exponentially tilted in the document's size (with the bound of 3, in
its logistic form: rate = 3 / (1 + 2 exp(-lambda * size))). The multipliers solve the convex dual by
distributed Newton iterations over a table of (source, size, documents). Rates then become whole copies: within
salted cells of a source, documents in falling size carry the rounding error on, so a cell's words
stay near what its rates ask for. Every step is a function of the rows, so reruns agree.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT, table, tune

WEIGHTS = (5, 2, 1)
CAP = 3
#: Documents in a rounding cell, about.
CELL = 64
ROUNDS = 100


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_SPLIT)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size): one row a source, so one window over all.

    A level L gives each source min(cap * size, L * weight); the sources at their cap are those with the
    least cap * size / weight, so sums over that order find L: the greatest of the levels that fit.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") * cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.col("rest") / F.col("left")
    free = F.when(F.col("source_size") * cap >= F.col("weight") * level, level)
    return (
        sizes.withColumn("weight", weight).withColumn("rest", rest).withColumn("left", left).withColumn("level", free)
        .withColumn("level", F.max("level").over(whole))
        .select("source", "source_size", F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.col("level")).alias("target"))
    )


def _rate(x: Column, lam: Column, cap: int) -> Column:
    return F.lit(float(cap)) / (1 + (cap - 1) * F.exp(-lam * x))


def multipliers(cells: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, lam, unit) with sum(n * size * rate(size)) = target a source, by safeguarded Newton steps.

    cells: (source, size, n). Each step is one aggregation of the cells with the last multipliers; the
    state is a table of a row a source, never collected. A source at its cap or without words keeps lam null.
    """
    unit = F.col("source_size") / F.greatest(F.col("docs"), F.lit(1))
    state = goals.select(
        "source", "source_size", "target", unit.alias("unit"), F.lit(0.0).alias("lam"), F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi"),
        ((F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap)).alias("open"),
    )
    state = table(state.coalesce(1), "dual")
    for _ in range(ROUNDS):
        live = state.where("open").select(F.col("source").alias("of"), "lam", "unit")
        joined = cells.join(live, F.col("source").eqNullSafe(F.col("of")))
        x = F.col("size") / F.col("unit")
        w = _rate(x, F.col("lam"), cap)
        mass = F.col("n") * F.col("size")
        sums = joined.groupBy("of").agg(F.sum(mass * w).alias("got"), F.sum(mass * x * w * (1 - w / cap)).alias("slope"))
        step = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        to = F.col("lam") - gap / F.col("slope")
        fine = (F.col("slope") > 0) & (to > F.col("lo2")) & (to < F.col("hi2"))
        state = table(
            step.withColumn("lo2", lo).withColumn("hi2", hi).select(
                "source", "source_size", "target", "unit",
                F.when(~F.col("open") | (F.abs(gap) < 1e-9 * F.col("target")), F.col("lam"))
                .otherwise(F.when(fine, to).otherwise((F.col("lo2") + F.col("hi2")) / 2)).alias("lam"),
                F.col("lo2").alias("lo"), F.col("hi2").alias("hi"),
                (F.col("open") & (F.abs(gap) > 1e-6 * F.col("target")) & (F.col("hi2") - F.col("lo2") > 1e-12)).alias("open"),
            ).coalesce(1), "dual",
        )
        if state.where("open").isEmpty():
            return state
    raise RuntimeError("entropy balancing did not settle")


def _round(rows: Iterator[dict], cap: int) -> Iterator[tuple]:
    """Copies of a cell's documents, largest first; what a document gets too much or too little goes to the next."""
    carry = 0.0
    for r in rows:
        size, want = r["size"], r["rate"] * r["size"]
        copies = min(cap, max(0, math.floor((want + carry) / size + 0.5))) if size else min(cap, round(r["rate"]))
        carry += want - copies * size
        yield r["row"], r["salt"], r["source"], r["source_size"], r["target"], size, copies


def _rounder(cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(b.to_pylist() for b in batches)
        done = itertools.chain.from_iterable(_round(cell, cap) for _, cell in itertools.groupby(rows, key=lambda r: (r["source"], r["cell"])))
        names = _ROUNDED.names
        while part := list(itertools.islice(done, 4096)):
            yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in part], schema=_ROUNDED)

    return run


_ROUNDED = pa.schema(
    [("row", pa.int64()), ("row_key", pa.int64()), ("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("size", pa.int64()), ("copies", pa.int64())]
)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, row_key, source, size, source_size, target, copies) of docs (doc_id, text, source, ...), one row for each.

    size: words of the text (null: 0). Null is a source of its own. Rows without words get copies that
    take no words. row_key: xxhash64 of all columns of the row; cells are dealt by it. Repeated rows are documents of their own. An empty table gives no rows.
    """
    tune(docs.sparkSession)
    sized = table(docs.select(F.col("doc_id").cast("long").alias("row"), "source", word_count().alias("size"), F.xxhash64(*docs.columns).alias("salt")), "sizes")
    cells = table(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    by_source = cells.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("docs")
    )
    goals = targets(by_source.select("source", "source_size"), weights, cap)
    goals = goals.join(by_source.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goals = table(goals, "goals")
    lam = multipliers(cells, goals, cap).select("source", "lam", "unit")
    lam = lam.join(goals.select(F.col("source").alias("s"), "source_size", "target", "docs"), F.col("source").eqNullSafe(F.col("s")))
    lam = table(lam.drop("source").coalesce(1), "multipliers")
    tilt = F.when(F.col("target") >= F.col("source_size") * cap, F.lit(float(cap))).otherwise(_rate(F.col("size") / F.col("unit"), F.col("lam"), cap))
    spread = F.greatest(F.ceil(F.col("docs") / CELL), F.lit(1))
    dealt = sized.join(lam, F.col("source").eqNullSafe(F.col("s"))).select(
        "row", "source", "source_size", "target", "size", F.when(F.col("size") > 0, tilt).otherwise(1.0).alias("rate"),
        F.pmod(F.xxhash64("salt", F.lit(11)), spread).alias("cell"), "salt",
    )
    dealt = dealt.repartition("source", "cell")
    dealt = dealt.sortWithinPartitions("source", "cell", F.col("size").desc(), "row", "salt")
    fields = "row long, row_key long, source string, source_size long, target double, size long, copies long"
    return dealt.mapInArrow(_rounder(cap), fields).withColumnRenamed("row", "doc_id")
