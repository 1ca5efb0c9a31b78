"""Files and tables written from the tables' rows and read again (survey sections 2.1 and 2.2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import storage
from ..schemas import IMU_COLUMNS
from ..session import shared_folder
from ..sources import datasource
from ..views import read, reps
from .registry import query


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("s06_motion_source", """select user_id as recording_id, count(*) as n, round(min(epoch_us(ts)) / 1e6, 6) as first_t, round(max(epoch_us(ts)) / 1e6, 6) as last_t, round(sum(value), 6) as ua_x, round(sum(event_id), 6) as mf_z
    from events group by user_id""", ())
def s06(spark, sf):
    """Every user's events as a motion file, a file a user, and what the data source reads of the folder."""
    rows = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("recording_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), F.col("value").alias("ua_x"), F.col("event_id").cast("double").alias("mf_z"))
    folder = _folder(spark, "motion")
    blank = {c: F.lit(0.0) for c in IMU_COLUMNS if c not in rows.columns}
    datasource.write_motion(rows.withColumns(blank), folder)
    back = spark.read.format("barlake_motion").schema("recording_id string, t double, ua_x double, mf_z double").load(folder)
    return back.groupBy(F.col("recording_id").cast("long").alias("recording_id")).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("ua_x").alias("ua_x"), F.sum("mf_z").alias("mf_z"))


@query("s20_stored_replacement", """new as (select set_id, vendor, rep + 1000 as rep, value from reps where vendor = 'click' and rep = 1 and set_id % 3 = 0),
    late as (select set_id, vendor, rep + 2000 as rep, value from reps where vendor = 'view' and rep = 1),
    one as (select set_id, vendor, rep, value from reps where vendor <> 'error' and not (vendor = 'click' and set_id in (select set_id from new)) union all select * from new)
    select * from one union all select * from late where set_id not in (select set_id from one where vendor = 'view')""", ("reps",))
def s20b(spark, sf):
    """Writes a table, replaces sets of one vendor, appends what is absent of another, repeats both and reads it."""
    rows = reps(spark, sf).select("set_id", "vendor", "rep", "value")
    path = _folder(spark, "reps")
    storage.write(rows.where("vendor <> 'error'"), path, "all")
    new = rows.where("vendor = 'click' and rep = 1 and set_id % 3 = 0").withColumn("rep", F.col("rep") + 1000)
    late = rows.where("vendor = 'view' and rep = 1").withColumn("rep", F.col("rep") + 2000)
    for _ in range(2):
        storage.replace_by_key(new, path, "replace")
        storage.append_absent(late, path, "append")
    return storage.read(spark, path)
