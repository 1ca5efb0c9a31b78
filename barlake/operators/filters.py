"""Recursive filters over recordings of any length: a parallel prefix over blocks.

A second-order section carries two numbers from sample to sample, and over a block they change by a fixed affine map: the
matrix is a power of the section's, the vector what the block makes of a state of 0. Tasks find the vectors block by block,
a scan over the blocks of a recording joins the maps, and tasks run each block again from the state that it begins with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import numpy as np

from ..functions import signal as s
from .grouped import Part, by_group

#: Samples of a block.
BLOCK = 1 << 16


def section(num: np.ndarray, den: np.ndarray, x: np.ndarray, state: tuple[float, float]) -> tuple[np.ndarray, tuple[float, float]]:
    """One block through a section (transposed direct form) from a state, and the state after it."""
    (b0, b1, b2), (_, a1, a2) = map(float, num), map(float, den)
    s1, s2 = map(float, state)
    out = np.empty(len(x))
    for k, v in enumerate(x.tolist()):
        y = b0 * v + s1
        s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
        out[k] = y
    return out, (s1, s2)


def _one_way(rows: DataFrame, num: np.ndarray, den: np.ndarray, key: str, block: int) -> DataFrame:
    """(key, i, x) through a section in the order of i (0 to n - 1), begun in the steady state of the first sample."""
    rows = rows.withColumn("block", F.floor(F.col("i") / block).cast("long"))
    own = [key, "block"]
    ends = by_group(rows, own, lambda p: [(len(p["x"]), float(p["x"][0]), *section(num, den, p["x"], (0.0, 0.0))[1])], "n long, x0 double, v1 double, v2 double", ["i"])
    once = np.array([[-den[1], 1.0], [-den[2], 0.0]])
    rest = num.sum() / den.sum()
    steady = np.array([(num[1] + num[2] - (den[1] + den[2]) * rest), num[2] - den[2] * rest])

    def scan(part: Part) -> list[tuple]:
        state, out = steady * part["x0"][0], []
        for name, n, v1, v2 in zip(part["block"].tolist(), part["n"].tolist(), part["v1"], part["v2"]):
            out.append((name, float(state[0]), float(state[1])))
            state = np.linalg.matrix_power(once, int(n)) @ state + (v1, v2)
        return out

    begins = by_group(ends, key, scan, "block long, s1 double, s2 double", ["block"])

    def apply(part: Part) -> list[tuple]:
        y = section(num, den, part["x"], (part["s1"][0], part["s2"][0]))[0]
        return list(zip(part["i"].tolist(), y.tolist()))

    return by_group(rows.join(begins, own), own, apply, "i long, x double", ["i"]).select(key, "i", "x")


def zero_phase(rows: DataFrame, hz: float, fs: float, kind: str, value: str = "a", key: str = "recording_id", pad: int = 9, block: int = BLOCK) -> DataFrame:
    """(key, i, value) of recordings (key, i from 0 without gaps, value) after a zero-phase second-order filter, sampled at fs.

    As ``signal.zero_phase`` does in one task: forwards and backwards over an odd extension of ``pad`` samples, of what a
    shorter recording has; a lone sample stays. Blocks of a recording are filtered by different tasks.
    """
    num, den = s.butterworth2(hz, fs, kind)
    w = Window.partitionBy(key)
    x = rows.select(key, F.col("i").cast("long").alias("i"), F.col(value).cast("double").alias("x"))
    x = x.withColumn("n", F.count("*").over(w)).withColumn("pad", F.least(F.lit(pad), F.col("n") - 1))
    edges = x.where((F.col("i") <= F.col("pad")) | (F.col("i") >= F.col("n") - 1 - F.col("pad"))).withColumns({"x0": F.max(F.when(F.col("i") == 0, F.col("x"))).over(w), "x1": F.max(F.when(F.col("i") == F.col("n") - 1, F.col("x"))).over(w)})
    front = edges.where("i between 1 and pad").select(key, (-F.col("i")).alias("i"), (2 * F.col("x0") - F.col("x")).alias("x"), "n", "pad")
    back = edges.where("i between n - 1 - pad and n - 2").select(key, (2 * (F.col("n") - 1) - F.col("i")).alias("i"), (2 * F.col("x1") - F.col("x")).alias("x"), "n", "pad")
    longer = x.unionByName(front).unionByName(back).where("n > 1").select(key, (F.col("i") + F.col("pad")).alias("i"), "x")
    size = x.select(key, "n", "pad").distinct().where("n > 1")
    turn = lambda df: df.join(size, key).select(key, (F.col("n") + 2 * F.col("pad") - 1 - F.col("i")).alias("i"), "x")
    there = _one_way(longer, num, den, key, block)
    again = turn(_one_way(turn(there), num, den, key, block))
    out = again.join(size, key).withColumn("i", F.col("i") - F.col("pad")).where("i between 0 and n - 1").select(key, "i", F.col("x").alias(value))
    return out.unionByName(x.where("n = 1").select(key, "i", F.col("x").alias(value)))


__all__ = ["BLOCK", "section", "zero_phase"]
