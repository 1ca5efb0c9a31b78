"""Streams over small files; every wait has a limit."""

import json
import os

import pytest
from pyspark.sql import functions as F

from barlake.streaming import live

LIMIT = 240


def at(k: int) -> str:
    return f"2026-06-15T{10 + k // 3600:02d}:{k // 60 % 60:02d}:{k % 60:02d}Z"


def put(folder, name, rows):
    """Files are taken in order of their time."""
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(folder / f"{name}.json", (1_750_000_000 + name, 1_750_000_000 + name))


def beats(seconds, who="w"):
    return [{"workout_id": who, "utc": at(k), "bpm": 100.0 + k % 60} for k in seconds]


def events(rows, who="w"):
    return [{"workout_id": who, "at": at(s), "kind": k, "set_id": i} for k, s, i in rows]


def run(spark, df, folder, mode="append"):
    progress = live.run_available(df, str(folder), f"{folder}-cp", mode, LIMIT)
    return spark.read.parquet(str(folder)), progress


def test_heart_rate_windows_and_sets(spark, tmp_path):
    src = tmp_path / "in"
    for n in range(3):
        put(src, n, beats(range(n * 10, n * 10 + 10)))
    read = lambda files=1: live.read_stream(spark, str(src), live.HEART, files)
    out = run(spark, live.heart_rate(read(), "2026-06-15T10:00:00Z", 50.0), tmp_path / "beats")[0]
    assert out.count() == 30 and out.agg(F.max("t")).first()[0] == 79.0
    assert run(spark, live.heart_rate(read(100)), tmp_path / "beats")[0].count() == 30  # nothing twice
    assert run(spark, live.late_windows(read(), "0 seconds"), tmp_path / "windows")[0].agg(F.sum("n")).first()[0] >= 10
    assert run(spark, live.deduplicated(read()), tmp_path / "once")[0].count() == 30
    sets = spark.createDataFrame([("w", "s1", at(5), at(9))], "workout_id string, set_id string, start string, end string")
    sets = sets.withColumn("start", F.to_timestamp("start")).withColumn("end", F.to_timestamp("end"))
    assert run(spark, live.heart_rate_of_sets(read(), sets), tmp_path / "sliced")[0].count() == 5


def test_rates_end_and_forget(spark, tmp_path):
    """The query ends; a recording that is silent for long is counted anew, and its state went meanwhile."""
    src = tmp_path / "motion"
    row = lambda who, k: {"recording_id": who, "utc": at(k), "t": k / 10, "ua_x": 0.0, "ua_y": 0.0, "ua_z": 0.0}
    put(src, 0, [row("r", k) for k in range(10)])
    put(src, 1, [row("r", k) for k in range(10, 20)])
    put(src, 2, [row("other", 7200)])
    put(src, 3, [row("r", k) for k in range(7201, 7206)])
    put(src, 4, [row("other", 20_000)])
    put(src, 5, [row("other", 20_001)])
    out, progress = run(spark, live.motion_rate(live.read_stream(spark, str(src), live.MOTION, 1), "10 seconds", "1 hour"), tmp_path / "rates", "update")
    got = sorted((r.batch, r.n, r.rate) for r in out.where("recording_id = 'r'").collect())
    assert [n for _, n, _ in got] == [10, 20, 5] and got[1][2] == pytest.approx(10.0)
    assert sum(o.numRowsRemoved for p in progress for o in p.stateOperators) > 0


def test_sets_of_events(spark, tmp_path):
    src = tmp_path / "ev"
    put(src, 0, events([("start_workout", 0, None), ("start_set", 1, "s1"), ("stop_set", 9, None), ("start_set", 20, "s2")]))
    put(src, 1, events([("stop_workout", 30, None), ("start_set", 40, "s3"), ("stop_set", 40, None), ("start_set", 50, "s4"), ("start_set", 60, "s5")]))
    put(src, 2, events([("stop_set", 4000, None)]) + events([("start_set", 4000, "other")], "v"))
    put(src, 3, events([("stop_set", 4005, None)], "v"))
    out = run(spark, live.sets_of(live.read_stream(spark, str(src), live.EVENT, 1), "5 seconds", "10 minutes"), tmp_path / "sets")[0]
    # s3 has no length, s5 was left open for too long
    assert {(r.workout_id, r.set_id) for r in out.collect()} == {("w", "s1"), ("w", "s2"), ("w", "s4"), ("v", "other")}


def test_heart_rate_of_open_sets(spark, tmp_path):
    """Beats come before the set that holds them has ended, in other files and of two workouts; the state shrinks once they can match no more."""
    b, e = tmp_path / "beats", tmp_path / "events"
    for n in range(6):
        put(b, n, beats(range(n * 60, n * 60 + 60)) + beats(range(n * 60, n * 60 + 60, 10), "v"))
    put(e, 0, events([("start_set", 30, "long"), ("start_set", 10, "a")]))
    put(e, 1, events([("start_set", 61, "v1")], "v"))
    put(e, 2, events([("stop_set", 150, None)]) + events([("stop_set", 121, None)], "v"))
    put(e, 3, events([("start_set", 200, "open")]))
    put(e, 4, events([("start_workout", 290, None)]))
    put(e, 5, events([("start_workout", 350, None)]))
    graph = live.heart_rate_of_open_sets(live.read_stream(spark, str(b), live.HEART, 1), live.read_stream(spark, str(e), live.EVENT, 1), "20 seconds", "130 seconds")
    out, progress = run(spark, graph, tmp_path / "out")
    got = {(r.workout_id, r.set_id): r.n for r in out.groupBy("workout_id", "set_id").agg(F.count("*").alias("n")).collect()}
    assert got == {("w", "a"): 21, ("w", "long"): 121, ("v", "v1"): 6}
    held = [o.numRowsTotal for p in progress for o in p.stateOperators if o.operatorName == "symmetricHashJoin"]
    assert held[-1] < max(held) and sum(o.numRowsRemoved for p in progress for o in p.stateOperators if o.operatorName == "symmetricHashJoin") > 0


def test_replay_is_whole_and_settings_stay(spark, tmp_path):
    rows = spark.range(500).select(F.lit("w").alias("workout_id"), F.timestamp_seconds(F.col("id") * 7).alias("utc"), F.col("id").cast("double").alias("bpm"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    out, progress = live.replayed(spark, {"beats": (rows, "utc", live.HEART)}, lambda beats: beats, str(tmp_path), slices=5)
    assert out.count() == 500 and len([p for p in progress if p.numInputRows]) == 5
    assert before == (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.streaming.stateStore.providerClass"))
    assert live.replayed(spark, {"beats": (rows.limit(0), "utc", live.HEART)}, lambda beats: beats, str(tmp_path))[0].isEmpty()


def test_a_stream_over_its_limit_is_stopped(spark, tmp_path):
    put(tmp_path / "in", 0, beats(range(3)))
    slow = live.read_stream(spark, str(tmp_path / "in"), live.HEART)
    with pytest.raises(TimeoutError):
        live.run_available(slow, str(tmp_path / "out"), str(tmp_path / "cp"), limit=0.001)
