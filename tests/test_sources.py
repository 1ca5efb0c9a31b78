"""Readers, writers, table keeping and streaming on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake import functions as fn
from barlake.operators import recordings as rec
from barlake.operators import tables
from barlake.schemas import IMU_COLUMNS, IMU_REQUIRED
from barlake.sources import exports, recordings


def test_motion_files(spark, tmp_path):
    old = tmp_path / "20260615-SQ-1_watch.csv"
    old.write_text(",".join(IMU_REQUIRED) + "\n" + ",".join(["0.5"] * 11) + "\n")
    row = recordings.read_motion(spark, str(old)).first()
    assert row["recording_id"] == "20260615-SQ-1_watch" and row["ua_x"] == 0.5 and row["mf_z"] == 0.0
    bad = tmp_path / "bad.csv"
    bad.write_text("t,ua_x\n1,2\n")
    with pytest.raises(ValueError, match="g_x"):
        recordings.read_motion(spark, str(bad))
    cell = tmp_path / "cell.csv"
    cell.write_text(",".join(IMU_REQUIRED) + "\n" + ",".join(["x"] * 11) + "\n")
    with pytest.raises(Exception, match="bad required cell"):
        recordings.read_motion(spark, str(cell)).collect()
    bare = tmp_path / "bare.csv"
    bare.write_text("\n" + ",".join(str(k) for k in range(11)) + "\n")
    assert recordings.read_motion(spark, str(bare)).first()["q_z"] == 10.0
    found = {(r["set_id"], r["vendor"]) for r in recordings.discover(spark, str(tmp_path)).collect()}
    assert found == {("20260615-SQ-1", "watch_imu")}


def test_motion_round_trip(spark, tmp_path):
    rows = recordings.synthetic_set(spark, n_reps=1, fs=20.0)
    text = recordings.motion_text(rows).first()["text"]
    assert text.startswith("t,ua_x") and text.endswith("\n") and len(text.splitlines()) == 42
    recordings.write_motion(rows, str(tmp_path / "out"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "out"))
    assert back.count() == 41 and set(IMU_COLUMNS) <= set(back.columns)
    assert not recordings.has_gyro(rows).first()["has_gyro"]


def test_heart_rate_and_sidecar(spark, tmp_path):
    hr = tmp_path / "w.csv"
    hr.write_text("t,utc,bpm\n1.0,2026-06-15T10:00:00.500Z,120.0\nbroken\n2.0,nope,1\n")
    rows = recordings.read_heart_rate(spark, str(hr))
    assert rows.count() == 1 and rows.select(recordings.heart_rate_line()).first()[0] == "1.000,2026-06-15T10:00:00.500Z,120.0"
    for name, started in (("a", "2026-06-15T10:00:00Z"), ("b", 803210400.0)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"schemaVersion": 3, "startedAt": started, "clockAnchorUptimeSeconds": 100.0, "watchOSVersion": "26.5"}))
    cars = recordings.read_sidecar(spark, str(tmp_path / "*.json"))
    got = {r["recording_id"]: r for r in cars.collect()}
    assert got["a"]["osVersion"] == "26.5" and got["b"]["startedAt"].year == 2026
    samples = spark.createDataFrame([("a", 101.5), ("c", 1.0)], "recording_id string, t double")
    utc = {r["recording_id"]: r["u"] for r in recordings.with_utc(samples, cars).select("recording_id", F.date_format("utc", "HH:mm:ss.S").alias("u")).collect()}
    assert utc == {"a": "10:00:01.5", "c": None}


def test_device_export(spark, tmp_path):
    names = ["Email", "Workout Date", "# Set", "# Rep.", "Weight (kg)", *[c for c, *_ in exports.DEVICE_METRICS]]
    lines = [",".join(names), "x@y.z,15/06/2026,1,1,100,0.5,0.6,0.9,0.512,300,500,", "x@y.z,15/06/2026,1,2,100,0.45,0.55,0.8,0.5,280,480,700"]
    (tmp_path / "e.csv").write_text("\n".join(lines) + "\n")
    reps, sets = exports.device_rows(exports.read_device_export(spark, str(tmp_path / "e.csv")), "20260615", "SQ")
    rows = {(r["rep_index"], r["metric"]): r["value"] for r in reps.collect()}
    assert rows[1, "rom"] == 51.2 and (1, "time_to_peak") not in rows and rows[2, "time_to_peak"] == 0.7
    first = sets.first()
    assert (first["set_id"], first["load_kg"], first["actual_reps"]) == ("20260615-SQ-1", 100.0, 2) and "Email" not in reps.columns
    with pytest.raises(Exception, match="unmapped set"):
        exports.split_by_athlete(exports.read_device_export(spark, str(tmp_path / "e.csv")), spark.createDataFrame([(9, "s", "a")], "source_set int, set_id string, athlete string")).select("set_id").collect()


def test_counts_decide_alignment(spark):
    shown = "set_id string, rep_index int, mean_velocity double, peak_velocity double, rom_m double, mean_power double, pause double"
    screen = spark.createDataFrame([(s, *r) for s in "suv" for r in [(1, 0.5, 0.8, 0.5, 100.0, 0.0), (2, 0.4, 0.7, 0.5, 90.0, 1.5)]], shown)
    every = exports.transcribed(screen, spark.createDataFrame([("s", 3), ("u", 2)], "set_id string, actual_reps int"))
    assert every.where("set_id <> 's' and true_rep = rep_index and flag is null").count() == 18
    typed = every.where("set_id = 's'")
    assert {r["flag"] for r in typed.collect()} == {"undercount"} and typed.where("true_rep is not null").isEmpty() and typed.where("metric = 'pause'").count() == 1
    reps = spark.createDataFrame([("s", "watch_imu", k, 0.5, 0.4) for k in (1, 2)], "set_id string, vendor string, rep int, mean_velocity double, rom double")
    truth = spark.createDataFrame([("s", "2"), ("x", "many")], "set_id string, actual_reps string")
    assert exports.watch_rows(reps, truth).where("true_rep = rep_index and flag is null").count() == 4
    more = exports.watch_rows(reps, truth.withColumn("actual_reps", F.lit("3")))
    assert {(r["true_rep"], r["flag"]) for r in more.collect()} == {(None, "count_mismatch")}
    drop = exports.remapped(spark.createDataFrame([("s", k) for k in range(1, 6)], "set_id string, rep_index int"), spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "set_id string, rep_index int"))
    assert [(r["rep_index"], r["true_rep"]) for r in drop.orderBy("rep_index").collect()] == [(3, 1), (4, 2), (5, 3)]


def _log(kind):
    t = np.arange(0, 6, 0.01)
    v = 0.8 * np.sin(np.pi * t)
    pos = 0.8 / np.pi * (1 - np.cos(np.pi * t))
    sep = "\t" if kind == "tab" else ","
    quote = (lambda x: x) if kind == "tab" else (lambda x: f'"{x}"')
    head = ["Frame number", "Time (s)", quote("velocity (horizontal, m/s)"), quote("velocity (vertical, m/s)"), quote("displacement (vertical, m)"), quote("acceleration (vertical, m/s^2)")]
    lines = ["Weight: 100", sep.join(head), "1" + sep * 5, "summary", sep.join(head)]
    lines += [sep.join([str(k + 1), f"{x:.2f}", "9.9", f"{v[k]:.5f}", f"{pos[k]:.5f}", "1.0"]) for k, x in enumerate(t)]
    return "\n".join(lines) + "\n"


@pytest.mark.parametrize("kind", ["quoted", "tab"])
def test_velocity_log(spark, tmp_path, kind):
    (tmp_path / "20260615-SQ-1.txt").write_text(_log(kind))
    rows = exports.read_velocity_logs(spark, str(tmp_path))
    reps = rec.velocity_logs(rows)
    got = reps.orderBy("rep").toPandas()
    assert len(got) == 3 and got["mean_velocity"].mean() == pytest.approx(0.8 * 2 / np.pi, abs=0.06) and got["peak_velocity"].max() == pytest.approx(0.8, abs=0.08)
    assert got["rom"].mean() == pytest.approx(0.8 * 2 / np.pi * 100, abs=6) and not got["rom_integrated"].any()
    long = exports.log_rows(reps)
    assert long.where("metric = 'peak_accel'").count() == 3 and long.where("flag is not null").isEmpty()


def test_board_log(spark):
    lines = spark.createDataFrame([(1, "\u001b[32m20260615-SQ-1 reps: 5\u001b[0m"), (2, "20260615-SQ-1 reps: 6"), (3, "20260616-BN-2  7/8"), (4, "x")], "n int, value string")
    assert {(r["set_id"], r["count"]) for r in exports.board_log(lines).collect()} == {("20260615-SQ-1", 6), ("20260616-BN-2", 7)}


def test_tables(spark):
    old = spark.createDataFrame([("s", "watch_imu", 1), ("s", "watch_bar", 2), ("s", "vitruve", 3), ("t", "watch_imu", 4)], "set_id string, vendor string, v int")
    new = spark.createDataFrame([("s", "watch_imu", 9)], old.schema)
    once = tables.replace_by_key(old, new)
    assert sorted(r["v"] for r in once.collect()) == [2, 3, 4, 9] == sorted(r["v"] for r in tables.replace_by_key(once, new).collect())
    assert sorted(r["v"] for r in tables.replace_watch(old, new).collect()) == [3, 4, 9]
    left = spark.createDataFrame([("a", "mine", 1), ("b", None, 2)], "k string, note string, size int")
    right = spark.createDataFrame([("a", "theirs", 7), ("b", "theirs", None), ("c", "new", 3)], left.schema)
    assert [tuple(r) for r in tables.upsert(left, right, "k", ["size"]).collect()] == [("a", "mine", 7), ("b", "theirs", 2), ("c", "new", 3)]
    assert tables.nullified(spark.createDataFrame([("", 1)], "a string, b int")).first()["a"] is None
    tables.save(old, "reps_saved")
    tables.save(new.withColumn("v", F.lit(8)), "reps_saved")
    assert sorted(r["v"] for r in spark.table("reps_saved").collect()) == [2, 3, 8]
    spark.sql("drop table reps_saved")


def test_names(spark):
    files = spark.createDataFrame([("20260615-SQ-1_watch_bar.csv",), ("20260701-SQ-MM-1_side.mov",), ("20260615-BN_1.mov",), ("notes.txt",)], "n string")
    assert [r[0] for r in files.select(fn.infer_set_id("n")).collect()] == ["20260615-SQ-1", "20260701-SQ-MM-1", "20260615-BN_1", ""]
    assert files.select(fn.watch_file("n")["vendor"]).first()[0] == "watch_bar"
    assert files.select(fn.half_even(F.lit(0.125), 2), fn.half_even(F.lit(0.375), 2)).first()[0] == 0.12
    assert files.select(fn.regime_hint(F.array(F.lit(0.9), F.lit(0.88), F.lit(0.87)))).first()[0] == "speed_work?"
