"""Scales, choices among candidates, counts from detections and the way from recordings to the tidy table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake import operators
from barlake.operators import estimates
from barlake.operators import trajectories as traj
from barlake.sources import recordings


def test_sources_by_name(spark):
    assert isinstance(operators.source("wave"), operators.VelocitySource)
    with pytest.raises(ValueError, match="chain.*trajectory.*wave"):
        operators.source("sonar")
    rows = recordings.synthetic_set(spark).select("recording_id", "t", (F.col("ua_z") * 9.80665).alias("a"))
    reps = operators.source("chain").estimate(rows)
    assert abs(reps.count() - 5) <= 1 and estimates.summaries(reps).first()["n_reps"] == reps.count()


def test_scale_order(spark):
    shape = "k int, target_px double, spec_m double, spec_confidence double, angle_valid boolean, rim_px double, body boolean, segment_px double, height_m double, segment string, segment_confidence double"
    rows = [
        (1, 90.0, None, None, None, None, False, None, None, None, None), (2, 90.0, 0.4, 0.6, True, None, False, None, None, None, None),
        (3, 90.0, 0.4, 0.6, True, 80.0, False, None, None, None, None), (4, 90.0, 0.4, 0.6, False, 80.0, False, 70.0, 1.8, "forearm", 0.7),
        (5, 90.0, 0.4, 0.6, False, None, False, 0.0, 1.8, "forearm", 0.7), (6, 0.0, None, None, None, None, None, None, None, None, None),
    ]
    got = {r["k"]: (r["scale_source"], r["m_per_px"], r["scale_confidence"]) for r in estimates.resolved_scale(spark.createDataFrame(rows, shape)).collect()}
    assert got[1] == ("implement", pytest.approx(0.005), None) and got[2] == ("plate_spec", pytest.approx(0.4 / 90), 0.6) and got[3] == ("rim_confirmed", pytest.approx(0.005), 0.9)
    assert got[4] == ("anthro", pytest.approx(1.8 * 0.146 / 70), 0.7) and got[5][0] == "plate_spec" and got[6][1] is None
    trust = lambda *x: spark.range(1).select(*(c.alias(n) for c, n in zip(estimates.trusted_scale(*(F.lit(v) for v in x)), "cs"))).first()
    assert trust(0.9, "implement", 0.2, 0.5, True)["s"] and not trust(0.9, "rim_confirmed", 0.2, 0.5, True)["s"] and trust(0.9, "plate_spec", 0.01, 2.0, True)["c"] == 0.3
    assert not trust(0.9, "anthro", 0.5, 2.0, False)["s"]


def candidates(spark, rows):
    return spark.createDataFrame([("c", *r) for r in rows], "clip string, candidate int, origin string, confidence double, n_reps int, regularity double, static boolean, honest boolean")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1, "edge", 0.9, 8, 0.9, False, False), (2, "edge", 0.5, 8, 0.5, False, True)], (2, "flow", True, True)),
        ([(1, "edge", 0.9, 8, 0.9, False, True), (2, "blob", 0.99, 8, 0.99, False, True)], (1, "flow", True, False)),
        ([(1, "edge", 0.9, 8, 0.9, False, True), (2, "blob", 0.99, 9, 0.99, False, True)], (2, "flow", True, False)),
        ([(1, "edge", 0.9, 8, 0.9, False, False)], (1, "flow", False, False)),
        ([(1, "edge", 0.9, 8, 0.9, True, True), (2, "edge", 0.9, 2, 0.9, False, True), (3, "detect", 0.2, 7, 0.1, False, False)], (3, "detect", False, False)),
        ([(1, "edge", 0.9, 8, 0.9, False, True), (2, "profile", 0.7, 5, 0.1, False, False)], (2, "profile", True, False)),
        ([(1, "edge", 0.9, 8, 0.9, False, True), (2, "profile", 0.5, 5, 0.1, False, False)], (1, "flow", True, False)),
        ([(2, "edge", 0.5, 8, 0.5, False, True), (1, "edge", 0.5, 9, 0.5, False, True)], (1, "flow", True, False)),
    ],
)
def test_choice(spark, rows, want):
    r = estimates.chosen_estimates(candidates(spark, rows)).first()
    assert (r["candidate"], r["pick"], r["velocity_reliable"], r["flipped"]) == want


def test_nothing_to_choose(spark):
    assert estimates.chosen_estimates(candidates(spark, [(1, "edge", 0.9, 2, 0.9, False, True)])).count() == 0


def _clip(name, candidate, height, n=5, fs=30.0):
    t = np.arange(0, 2.0 * n, 1 / fs)
    return pd.DataFrame({"clip": name, "candidate": candidate, "t": t, "cx": 320 + np.sin(t), "cy": 400 - height / 0.01 * (1 - np.cos(np.pi * t)), "m_per_px": 0.005, "target_px": 90.0})


def test_auto_estimate(spark):
    tracks = spark.createDataFrame(pd.concat([_clip("a", 1, 0.25), _clip("a", 2, 0.002), _clip("b", 1, 0.002)]))
    made = spark.createDataFrame([("a", 1, "edge", 0.8), ("a", 2, "edge", 0.99), ("b", 1, "detect", 0.4)], "clip string, candidate int, origin string, confidence double")
    reps, choice = estimates.auto_estimate(tracks, made)
    got = {r["clip"]: r for r in choice.collect()}
    assert got["a"]["candidate"] == 1 and got["a"]["velocity_reliable"] and got["b"]["pick"] == "detect"
    assert reps.where("clip = 'a'").count() == got["a"]["n_reps"] and all("velocity_relative_only" in (r["flag"] or "") for r in reps.where("clip = 'b'").collect())


def test_counts_from_detections(spark):
    one = _clip("a", 1, 0.25)
    frames = np.arange(len(one))
    rows = pd.concat([
        pd.DataFrame({"clip": "a", "frame": frames, "t": one["t"], "cx": one["cx"], "cy": one["cy"], "r": 45.0}),
        pd.DataFrame({"clip": "a", "frame": frames, "t": one["t"], "cx": 900.0, "cy": 100 + np.sin(frames), "r": 45.0}),
    ])
    assert estimates.auto_counts(spark.createDataFrame(rows)).count() == 5
    few = spark.createDataFrame(rows[:6])
    assert estimates.auto_counts(few).count() == 0
    counts = estimates.perturbed_counts(spark.createDataFrame(one), [-0.1, 0.0, 0.1], gate="relative")
    assert {r["count"] for r in counts.collect()} == {5} and traj.jitter_stability(counts).first()["stable"]


def test_depth_ruler(spark):
    t = np.arange(0, 6, 0.05)
    d = 90 + 2 * np.sin(t / 3)
    rows = pd.DataFrame({"clip": "c", "t": t, "cy": 400 - 0.3 * np.sin(t) * d / 0.45, "d": np.where(np.arange(len(t)) % 5 == 4, np.nan, d), "rim_px": 90.0, "rim_t": 0.0, "plate_m": 0.45, "frame_h": 800.0})
    got = estimates.depth_positions(spark.createDataFrame(rows)).orderBy("t").toPandas()
    assert np.abs(got["pos"] - 0.3 * np.sin(t)).max() < 0.02
    assert estimates.depth_positions(spark.createDataFrame(rows.assign(d=np.where(t < 0.4, 90.0, np.nan)))).count() == 0


def test_lift_windows(spark):
    data = [("r", "row", 0.0, 0.5, 0.4), ("r", "row", 1.0, 0.95, 0.4), ("r", "row", 2.0, 0.5, 0.3), ("b", "bench", 0.0, 0.2, 0.13), ("d", "rdl", 0.0, 0.39, 0.5), ("p", "press", 0.0, 3.0, 0.01), ("q", None, 0.0, 0.1, 0.1)]
    got = estimates.lift_gate(spark.createDataFrame(data, "recording_id string, lift string, start double, rom double, mean_velocity double")).collect()
    assert sorted((r["recording_id"], r["start"], r["rep"]) for r in got) == [("b", 0.0, 0), ("p", 0.0, 0), ("q", 0.0, 0), ("r", 0.0, 0)]


def test_watch_ingest(spark):
    one = recordings.synthetic_set(spark, n_reps=6, peak=1.0).withColumn("set_id", F.lit("s1")).withColumn("vendor", F.lit("watch_imu")).drop("recording_id")
    rows = one.unionByName(one.withColumn("set_id", F.lit("s2"))).unionByName(one.withColumn("set_id", F.lit("unknown")))
    n = operators.wave_segments(one.select(F.lit("x").alias("recording_id"), "t", (F.col("ua_z") * 9.80665).alias("a"))).count()
    truth = spark.createDataFrame([("s1", str(n)), ("s2", str(n + 1))], "set_id string, actual_reps string")
    shape = "set_id string, vendor string, rep_index int, true_rep int, metric string, value double, unit string, flag string, confidence double"
    old = spark.createDataFrame([("s1", "watch_bar", 1, 1, "rom", 1.0, "cm", None, None), ("s1", "vitruve", 1, 1, "rom", 2.0, "cm", None, None), ("s9", "watch_imu", 1, 1, "rom", 3.0, "cm", None, None)], shape)
    got = estimates.watch_ingest(rows, truth, old)
    assert n > 2 and got.where("set_id = 's1' and vendor = 'watch_imu'").count() == 2 * n and got.where("set_id = 'unknown' or vendor = 'watch_bar'").isEmpty()
    assert {(r["true_rep"], r["flag"]) for r in got.where("set_id = 's2'").collect()} == {(None, "count_mismatch")} and sorted(r["value"] for r in got.where("vendor = 'vitruve' or set_id = 's9'").collect()) == [2.0, 3.0]


def test_report(spark):
    rows = spark.createDataFrame([("b", -1, None), ("a", 2, 0.5)], "set_id string, delta int, mean double")
    got = [r["line"] for r in estimates.report(rows, {"set_id": "%s", "delta": "%+d", "mean": "%.2f"}, ["set_id"]).orderBy("n").collect()]
    assert got == ["| set_id | delta | mean |", "|-|-|-|", "| a | +2 | 0.50 |", "| b | -1 | – |"]


def test_files_of_different_columns_in_one_folder(spark, tmp_path):
    full, old = recordings.IMU_COLUMNS, list(recordings.IMU_REQUIRED)
    for name, head in (("full", full), ("old", old), ("turned", full[::-1]), ("bare", None)):
        cells = {c: k + 0.5 for k, c in enumerate(full)}
        lines = [] if head is None else [",".join(head)]
        lines += [",".join(str(cells[c]) for c in (head or full)), ""]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines))
    got = {r["recording_id"]: r for r in recordings.read_motion(spark, str(tmp_path)).collect()}
    assert set(got) == {"full", "old", "turned", "bare"}
    for name, r in got.items():
        assert [r[c] for c in full] == [0.0 if name == "old" and c not in old else k + 0.5 for k, c in enumerate(full)]


def test_writers_and_clips(spark, tmp_path):
    beats = spark.createDataFrame([("w", 1.0, "2026-06-15T10:00:01Z", 101.0), ("w", 0.0, "2026-06-15T10:00:00Z", 100.0)], "workout_id string, t double, utc string, bpm double").withColumn("utc", F.to_timestamp("utc"))
    recordings.write_heart_rate(beats, str(tmp_path / "hr"))
    back = recordings.read_heart_rate(spark, str(tmp_path / "hr" / "workout_id=w"))
    assert sorted(r["bpm"] for r in back.collect()) == [100.0, 101.0]
    samples = recordings.synthetic_set(spark, n_reps=1, fs=20.0)
    recordings.write_session(samples, spark.createDataFrame([("synthetic", "squat", 1)], "recording_id string, exercise string, sampleCount int"), str(tmp_path / "session"))
    assert recordings.read_motion(spark, str(tmp_path / "session" / "samples" / "recording_id=synthetic")).count() == samples.count()
    (tmp_path / "near").mkdir(), (tmp_path / "far").mkdir()
    (tmp_path / "near" / "a.mov").write_bytes(b"a"), (tmp_path / "far" / "a.mov").write_bytes(b"other"), (tmp_path / "far" / "b.mov").write_bytes(b"b")
    import hashlib

    manifest = spark.createDataFrame([("a.mov", hashlib.sha256(b"a").hexdigest()), ("b.mov", "00"), ("c.mov", None)], "filename string, sha256 string")
    got = {r["filename"]: (r["found"], r["intact"]) for r in recordings.resolved_clips(spark, manifest, [str(tmp_path / "near"), str(tmp_path / "far")]).collect()}
    assert got == {"a.mov": (True, True), "b.mov": (True, False), "c.mov": (False, None)}
