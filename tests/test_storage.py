"""Tables that change as a whole, and recordings as data sources."""

import os

import pytest
from pyspark.sql import functions as F

from barlake.operators import storage
from barlake.schemas import IMU_COLUMNS, IMU_REQUIRED
from barlake.sources import datasource, recordings

SHAPE = "set_id string, vendor string, v int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_commits_versions_and_replays(spark, tmp_path):
    path = str(tmp_path / "t")
    old = [("s", "a", 1), ("s", "b", 2), ("t", "a", 3), ("u", None, 4)]
    assert storage.write(spark.createDataFrame(old, SHAPE), path, "first") == 0
    new = spark.createDataFrame([("s", "a", 9)], SHAPE)
    assert storage.replace_by_key(new, path, "second") == 1
    want = [("s", "a", 9), ("s", "b", 2), ("t", "a", 3), ("u", None, 4)]
    assert rows_of(storage.read(spark, path)) == sorted(want, key=str)
    before = {d: sorted(os.listdir(d)) for d, _, _ in os.walk(path)}
    assert storage.replace_by_key(new, path, "second") == 1 and {d: sorted(os.listdir(d)) for d, _, _ in os.walk(path)} == before
    assert rows_of(storage.read(spark, path, 0)) == sorted(old, key=str)
    assert storage.append_absent(spark.createDataFrame([("s", "b", 7), ("x", "b", 8), ("y", "new", 1)], SHAPE), path, "third") == 2
    assert rows_of(storage.read(spark, path).where("vendor in ('b', 'new')")) == [("s", "b", 2), ("x", "b", 8), ("y", "new", 1)]
    assert storage.upsert(spark.createDataFrame([("y", "new", 5)], SHAPE), path, "fourth", "set_id", ["v"]) == 3
    assert rows_of(storage.read(spark, path).where("vendor = 'new'")) == [("y", "new", 5)]
    storage.rewrite(spark.createDataFrame([("y", "new", 0)], SHAPE), path, "fifth", lambda old, new: old.limit(0))
    assert storage.read(spark, path).where("vendor = 'new'").isEmpty() and storage.read(spark, path).count() == 5
    with pytest.raises(ValueError, match="partitioned"):
        storage.write(new, path, "sixth", "set_id")
    with pytest.raises(ValueError, match="no table"):
        storage.read(spark, str(tmp_path / "none"))


def test_a_write_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    storage.write(spark.range(100).select(F.lit("s").alias("set_id"), (F.col("id") % 4).cast("string").alias("vendor"), F.col("id").cast("int").alias("v")), path, "first")
    want = rows_of(storage.read(spark, path))
    # dies half-way: some of its partitions are written when one row fails
    dying = spark.range(0, 40, 1, 4).select(F.lit("s").alias("set_id"), (F.col("id") % 4).cast("string").alias("vendor"), F.when(F.col("id") == 39, F.raise_error(F.lit("dies")).cast("int")).otherwise(0).alias("v"))
    with pytest.raises(Exception, match="dies"):
        storage.write(dying, path, "second")
    assert rows_of(storage.read(spark, path)) == want and storage.log(spark, path).count() == 1
    # dies when all is staged, before the commit
    with monkeypatch.context() as m:
        m.setattr(storage, "sorted", lambda *a: 1 / 0, raising=False)
        with pytest.raises(ZeroDivisionError):
            storage.write(dying.where("id < 39"), path, "second")
    assert rows_of(storage.read(spark, path)) == want
    assert storage.write(dying.where("id < 39"), path, "second") == 1 and storage.read(spark, path).count() == 39


def motion(spark, names, n=30):
    return spark.createDataFrame([(name, k / 10, *[float(k + j) for j in range(16)]) for name in names for k in range(n)], "recording_id string, " + ", ".join(f"{c} double" for c in IMU_COLUMNS))


def test_motion_source_round_trip_and_mixed_files(spark, tmp_path):
    datasource.register(spark)
    path = str(tmp_path / "m")
    rows = motion(spark, ["20260615-SQ-1_watch", "20260615-SQ-2_watch"])
    datasource.write_motion(rows, path)
    assert sorted(f for f in os.listdir(path) if not f.startswith("_")) == ["20260615-SQ-1_watch.csv", "20260615-SQ-2_watch.csv"]
    load = lambda **o: spark.read.format("barlake_motion").options(**o).load(path)
    assert rows_of(load()) == rows_of(rows)
    (tmp_path / "m" / "legacy.csv").write_text(",".join(IMU_REQUIRED) + "\n" + ",".join(["0.5"] * 11) + "\n\n")
    back = list(reversed(IMU_COLUMNS))
    (tmp_path / "m" / "turned.csv").write_text(",".join(back) + "\n" + ",".join(str(k) for k in range(17)) + "\n")
    (tmp_path / "m" / "bare.csv").write_text(",".join(str(k) for k in range(17)) + "\n")
    (tmp_path / "m" / "empty.csv").write_text("")
    got = {r.recording_id: r for r in load().where("recording_id in ('legacy', 'turned', 'bare')").collect()}
    assert got["legacy"].ua_x == 0.5 and got["legacy"].mf_z == 0.0
    assert got["turned"].t == 16.0 and got["turned"].mf_z == 0.0 and got["bare"].t == 0.0 and got["bare"].mf_z == 16.0
    assert rows_of(load()) == rows_of(spark.read.format("barlake_motion").load(path)) and load().count() == 63
    # the same as the reader of text lines
    plain = recordings.read_motion(spark, f"{path}/*.csv")
    assert rows_of(load().select(*plain.columns)) == rows_of(plain)
    assert load(pack="0").rdd.getNumPartitions() == 6 and load(pack="0").where("recording_id = 'legacy'").rdd.getNumPartitions() == 1
    narrow = spark.read.format("barlake_motion").schema("ua_z double, recording_id string").load(path)
    assert narrow.where("recording_id = 'turned'").collect() == [(13.0, "turned")]
    for name, text, said in (("bad", "t,ua_x\n1,2\n", "bad required cell|g_x"), ("cell", ",".join(IMU_REQUIRED) + "\n" + ",".join(["x"] * 11) + "\n", "bad required cell")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.csv").write_text(text)
        with pytest.raises(Exception, match=said):
            spark.read.format("barlake_motion").load(str(tmp_path / name)).collect()


def test_a_motion_write_that_dies_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "m")
    datasource.write_motion(motion(spark, ["a"]), path)
    rows = motion(spark, ["a", "b", "c", "d"], 20).withColumn("ua_x", F.when((F.col("recording_id") == "c") & (F.col("t") > 1), F.raise_error(F.lit("dies")).cast("double")).otherwise(7.0))
    with pytest.raises(Exception, match="dies"):
        datasource.write_motion(rows, path)
    assert [f for f in os.listdir(path) if f.endswith(".csv")] == ["a.csv"]
    assert rows_of(spark.read.format("barlake_motion").load(path)) == rows_of(motion(spark, ["a"]))
    datasource.write_motion(motion(spark, ["e"]), path, "overwrite")
    assert [f for f in os.listdir(path) if f.endswith(".csv")] == ["e.csv"]


def test_motion_stream_takes_each_file_once(spark, tmp_path):
    path = str(tmp_path / "m")
    datasource.write_motion(motion(spark, ["a", "b"], 5), path)

    def run():
        stream = spark.readStream.format("barlake_motion").option("settle", "0").load(path)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return {r.recording_id: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("recording_id").count().collect()}

    assert run() == {"a": 5, "b": 5}
    datasource.write_motion(motion(spark, ["c"], 4), path)
    assert run() == {"a": 5, "b": 5, "c": 4} == run()


def test_heart_rate_source(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "w.csv").write_text("t,utc,bpm\n1.0,2026-06-15T10:00:00.500Z,120.0\nbroken\n2.0,nope,1\n3.0,2026-06-15T10:00:02Z,121\n")
    rows = spark.read.format("barlake_heart_rate").load(str(tmp_path))
    got = rows.selectExpr("recording_id", "t", "date_format(utc, 'HH:mm:ss.S') as utc", "bpm").collect()
    assert [tuple(r) for r in got] == [("w", 1.0, "10:00:00.5", 120.0), ("w", 3.0, "10:00:02.0", 121.0)]
    assert [tuple(r) for r in rows.select("bpm").collect()] == [(120.0,), (121.0,)]
