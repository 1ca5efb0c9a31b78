"""Bounded alignments, legs, seeds and the corpus reports, against all pairs, brute force and small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.functions import signal as s
from barlake.operators import alignment, estimates, reports
from barlake.operators import recordings as rec
from barlake.operators import trajectories as traj


def waves(spark, seed, key, n=100):
    """Swings of many periods and lengths, some with noise, one constant."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        size, period, noise = int(rng.integers(30, 160)), float(rng.uniform(4, 40)), float(rng.choice([0.0, 0.2, 1.0]))
        y = np.sin(2 * np.pi * np.arange(size) / period + rng.uniform(0, 6)) * (k != 7) + noise * (k != 7) * rng.normal(size=size)
        rows += [(k, k % 3, float(i), float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, f"{key} int, session int, t double, y double")


def pairs(rows):
    return {(r["recording_id"], r["clip"]): (round(r["r"], 9), r["lag"]) for r in rows}


def test_sketch_bounds_every_lag():
    rng = np.random.default_rng(1)
    series = [np.cumsum(rng.normal(size=int(rng.integers(1, 300)))) for _ in range(60)] + [np.ones(20), np.zeros(1)]
    roots = [alignment.sketch(x) for x in series]
    for x, a in zip(series, roots):
        for y, b in zip(series, roots):
            assert abs(s.correlate_lags(x, y)[0]) <= a @ b / min(len(x), len(y)) + 1e-12
    assert all(abs((a**2).sum() - ((x - x.mean()) / (x.std() + 1e-9) @ ((x - x.mean()) / (x.std() + 1e-9)))) < 1e-4 for x, a in zip(series, roots))


def test_alignments_above_are_those_of_all_pairs(spark, monkeypatch):
    left, right = waves(spark, 1, "recording_id"), waves(spark, 2, "clip")
    every = pairs(rec.align_all(left.drop("session"), right.drop("session"), 1.0).collect())
    monkeypatch.setattr(alignment, "BLOCK", 16)
    got = alignment.align_above(left.drop("session"), right.drop("session"), 0.9, 1.0)
    wanted = {k: v for k, v in every.items() if abs(v[0]) >= 0.9}
    assert pairs(got.collect()) == wanted and len(wanted) > 100
    a, b = alignment.sketches(left, "recording_id", 1.0), alignment.sketches(right, "clip", 1.0)
    met = alignment.candidates(a, b, 0.9)
    assert len(wanted) <= met.count() < 0.4 * len(every) and met.distinct().count() == met.count()
    within = pairs(alignment.align_above(left, right, 0.9, 1.0, "session").collect())
    assert within == {k: v for k, v in wanted.items() if k[0] % 3 == k[1] % 3}


def test_alignments_of_odd_rows(spark):
    shape = "recording_id string, t double, y double, session int"
    wave = [(float(t), float(np.sin(t / 3))) for t in range(60)]
    rows = [("a", *w, 1) for w in wave] + [("a", *w, 2) for w in wave] + [(None, *w, 1) for w in wave] + [("one", 0.0, 1.0, 1), ("gap", 0.0, None, 1), ("a", None, 1.0, 1), ("lost", 0.0, 1.0, None), ("lost", 5.0, 1.0, None)]
    left = spark.createDataFrame(rows, shape)
    right = left.withColumnRenamed("recording_id", "clip")
    got = alignment.align_above(left, right, 0.9, 1.0, "session").collect()
    assert sorted(map(str, ((r["recording_id"], r["clip"]) for r in got))) == sorted(map(str, [("a", "a")] * 2 + [("a", None), (None, "a"), (None, None)]))
    assert alignment.align_above(left.limit(0), right, 0.9, 1.0).count() == 0
    with pytest.raises(ValueError, match="over 0"):
        alignment.align_above(left, right, 0.0)


def test_blocks_are_dealt_once_not_once_a_meeting(spark, monkeypatch):
    """Blocks go into panels, and nothing is shuffled where panels meet: shuffles grow with the blocks. Many tiny sessions meet by session instead."""
    left, right = waves(spark, 1, "recording_id"), waves(spark, 2, "clip")
    monkeypatch.setattr(alignment, "BLOCK", 4)
    got = alignment.align_above(left.drop("session"), right.drop("session"), 0.9, 1.0)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and plan.index("Exchange") > plan.index("CartesianProduct")
    every = pairs(rec.align_all(left.drop("session"), right.drop("session"), 1.0).collect())
    assert pairs(got.collect()) == {k: v for k, v in every.items() if abs(v[0]) >= 0.9}
    one = [(side.withColumn("session", F.col(key)), key) for side, key in ((left, "recording_id"), (right, "clip"))]
    alone = alignment.align_above(one[0][0], one[1][0], 0.5, 1.0, "session")
    assert "CartesianProduct" not in alone._jdf.queryExecution().sparkPlan().toString()
    assert pairs(alone.collect()) == {k: v for k, v in every.items() if k[0] == k[1] and abs(v[0]) >= 0.5}


def test_short_series_are_multiplied_lag_by_lag(monkeypatch):
    rng = np.random.default_rng(3)
    series = [np.cumsum(rng.normal(size=int(n))) for n in rng.integers(1, alignment.SHORT + 1, 40)] + [np.sin(np.arange(60)), -np.sin(np.arange(60)), np.ones(20), np.zeros(1)]
    ns, ys = np.array([len(x) for x in series]), np.concatenate(series)
    monkeypatch.setattr(np.fft, "irfft", None)
    found = list(alignment.best_lags(ns, ys, ns[::-1], np.concatenate(series[::-1]), np.ones((len(ns), len(ns)), bool)))
    monkeypatch.undo()
    i, j, r, lag = (np.concatenate(c).tolist() for c in zip(*found))
    assert len(i) == len(series) ** 2
    for a, b, c, k in zip(i, j, r, lag):
        want, at = s.correlate_lags(series[a], series[::-1][b])
        assert abs(c - want) < 1e-9 and (k == at or abs(want) < 1e-9), (a, b)


def test_legs_are_stitched_at_the_seed(spark):
    legs = spark.createDataFrame(
        [("c", "forward", t, t, 0.0) for t in (2.0, 3.0)] + [("c", "backward", t, 9.0 - t, 1.0) for t in (0.0, 1.0, 2.0)]
        + [("short", "forward", 1.0, 1.0, 0.0), ("short", "backward", 0.0, 0.0, 0.0), ("short", "backward", 1.0, 5.0, 0.0), ("back", "backward", 0.0, 1.0, 1.0), ("back", "backward", 1.0, 2.0, 1.0)],
        "clip string, leg string, t double, cx double, cy double",
    )
    seeds = spark.createDataFrame([("c", 2.0), ("short", 1.0), ("back", 1.0)], "clip string, seed_t double")
    got = [tuple(r) for r in traj.stitched_legs(legs, seeds).orderBy("clip", "t").collect()]
    assert got == [
        ("back", 0.0, 2.0, 1.0, "backward"), ("back", 1.0, 1.0, 1.0, "backward"),
        ("c", 0.0, 7.0, 1.0, "backward"), ("c", 1.0, 8.0, 1.0, "backward"), ("c", 2.0, 2.0, 0.0, "forward"), ("c", 3.0, 3.0, 0.0, "forward"),
        ("short", 1.0, 1.0, 0.0, "forward"),
    ]
    targets = spark.createDataFrame([("c", 40.0), ("short", 4.0)], "clip string, target_px double")
    found = {r["clip"]: r for r in traj.leg_agreement(legs, seeds, targets).collect()}
    assert found["c"]["shared"] == 1 and found["c"]["rms"] == pytest.approx(np.hypot(7, 1)) and found["c"]["agrees"]
    assert found["short"]["rms"] == pytest.approx(1.0) and found["short"]["agrees"]
    assert found["back"]["shared"] == 0 and found["back"]["rms"] is None and found["back"]["agrees"] is None


def test_seeds_take_the_nearest_track(spark):
    rows = []
    for f in range(120):
        rows.append(("c", f, f / 15, 300.0, float(400 - 60 * (1 - np.cos(2 * np.pi * f / 30))), 45.0))
        rows.append(("c", f, f / 15, 600.0, 390.0 + 0.01 * (f % 2), 45.0))
    found = spark.createDataFrame(rows, "clip string, frame int, t double, cx double, cy double, r double")
    seeds = spark.createDataFrame([("c", 0, 302.0, 401.0), ("none", 0, 0.0, 0.0)], "clip string, frame int, x double, y double")
    nudges = [(0.0, 0.0), (0.4, 0.0), (0.0, -0.4), (6.5, 0.0), (3.0, 0.0)]
    got = {(r["clip"], r["dx"], r["dy"]): (r["track"], r["count"]) for r in estimates.seeded_counts(found, seeds, nudges).collect()}
    lift, rest = got["c", 0.0, 0.0], got["c", 6.5, 0.0]
    assert lift[1] >= 3 and got["c", 0.4, 0.0] == lift and got["c", 0.0, -0.4] == lift
    assert rest[0] != lift[0] and rest[1] == 0 and got["c", 3.0, 0.0] == (None, None) and got["none", 0.0, 0.0] == (None, None)
    assert len(got) == 10
    verdict = traj.jitter_stability(estimates.seeded_counts(found, seeds, nudges)).where("clip = 'c'").first()
    assert verdict["base_count"] == lift[1] and verdict["agreement"] == pytest.approx(0.6) and verdict["stable"]


def test_seeded_counts_link_once(spark):
    """Linking and counting stand once in the plan of the verdict; a gate over whole sets gives the same counts where it rejects nothing; without a track the count is null."""
    rows = [("c", f, f / 15, 300.0, float(400 - 60 * (1 - np.cos(2 * np.pi * f / 30))), 45.0) for f in range(120)]
    found = spark.createDataFrame(rows, "clip string, frame int, t double, cx double, cy double, r double")
    seeds = spark.createDataFrame([("c", 0, 302.0, 401.0), ("none", 0, 0.0, 0.0)], "clip string, frame int, x double, y double")
    nudges = [(0.0, 0.0), (9.0, 0.0), (0.1, 0.1)]
    counts = estimates.seeded_counts(found, seeds, nudges)
    verdict = traj.jitter_stability(counts)
    assert verdict._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 2
    got = {r["clip"]: r for r in verdict.collect()}
    assert got["c"]["base_count"] >= 3 and got["c"]["agreement"] == pytest.approx(2 / 3) and got["c"]["stable"]
    assert got["none"]["base_count"] is None and got["none"]["agreement"] == 0 and not got["none"]["stable"]
    gated = estimates.seeded_counts(found, seeds, nudges, rom_floor=0.01)
    assert sorted(map(str, gated.collect())) == sorted(map(str, counts.collect()))


def test_coverage_gaps(spark):
    key = "set_id string"
    truth = spark.createDataFrame([("a", "v"), ("a", "p"), ("b", "v"), ("c", "v"), ("d", "p"), (None, "v")], f"{key}, vendor string")
    videos = spark.createDataFrame([("a", "3840x2160", "a.mov"), ("b", None, "b.mov"), ("z", "1920x1080", "z.mov"), ("d", "x", None)], f"{key}, resolution string, file string")
    watches = spark.createDataFrame([("w",), ("c",), ("c",), (None,)], key)
    board, heard = spark.createDataFrame([("d",)], key), spark.createDataFrame([("w",)], key)
    objects = spark.createDataFrame([("a.mov",), ("new.mov",), ("new.mov",), (None,)], "name string")
    gaps = reports.coverage_gaps(truth, videos, watches, board, heard, objects)
    assert sorted(tuple(r) for r in gaps.select("section", "item", F.coalesce("vendors", F.lit("")), F.coalesce("resolution", F.lit("")), "large", "gap").collect()) == [
        ("object", "new.mov", "", "", False, True), ("video", "a", "p,v", "3840x2160", True, True), ("video", "b", "v", "local", False, True), ("watch", "c", "v", "", False, True),
    ]
    alone = reports.coverage_gaps(truth, videos.limit(0), watches, board, heard)
    assert {(r["section"], r["item"], r["gap"]) for r in alone.collect()} == {("watch", "c", True), ("no_signal", "a", False), ("no_signal", "b", False), ("no_signal", "d", False)}
    assert {r["section"]: (r["items"], r["large"], r["gaps"]) for r in reports.coverage_summary(gaps).collect()}["all"] == (4, 1, 4)
    assert [tuple(r) for r in reports.coverage_summary(gaps.limit(0)).collect()] == [("all", 0, 0, 0)]


def test_inventory_lines(spark):
    sets = spark.createDataFrame([("s2", "2024-01-02", "row", 1, 5), ("s1", "2024-01-01", "row", 2, None), ("s3", None, "bench", None, 3)], "set_id string, date string, lift string, set_index int, actual_reps int")
    reps = spark.createDataFrame([("s2", "v", None), ("s2", "v", "phantom"), ("s2", "p", ""), ("s1", "p", ""), ("s1", "o", "missed")], "set_id string, vendor string, flag string")
    one = spark.createDataFrame([("s2",), ("s2",)], "set_id string")
    local = spark.createDataFrame([("s1",), ("s2",)], "set_id string")
    auto = spark.createDataFrame([("s2", 4)], "set_id string, count int")
    watch = spark.createDataFrame([("s1", 5, 6)], "set_id string, auto int, adjusted int")
    rows = reports.inventory_rows(sets, reps, one, local, auto, watch, ["v", "p"], "o")
    lines = [r["line"] for r in reports.inventory_lines(rows).orderBy(F.col("n").asc_nulls_last()).collect()]
    assert lines[2:] == [
        "| – | bench | – | 3 | — | — | — | — | — | — |",
        "| 2024-01-01 | row | 2 | ? | p 1 | git | 1 | ? | 5 | 6 |",
        "| 2024-01-02 | row | 1 | 5 | v 1 | store | — | 4 | — | — |",
        "3 sets, 2 with truth, 2 with video, 1 with watch",
    ]
