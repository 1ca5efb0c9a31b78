"""Adapter views: the driver's synthetic tables in the shape of the measurement model.

They hold no lifting data. Events stand in for repetitions (a user is a set, an event type a vendor) and
for ordered series (a user is a recording); customers stand in for sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vendors of the view, most trusted first.
PREFERENCE = ("view", "purchase", "click", "signup", "error")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, vendor, rep, value, flag); rep counts from 1 in time order."""
    k = F.get_json_object("props", "$.k").cast("int") % 10
    flag = F.when(k == 0, "phantom").when(k == 1, "missed").when(k == 2, "partial_rom").otherwise("")
    # renamed first: what follows groups by these names and so keeps the window's partitioning
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("set_id"), F.col("event_type").alias("vendor"), "ts", "event_id", "value", flag.alias("flag"))
    order = Window.partitionBy("set_id", "vendor").orderBy("ts", "event_id")
    return rows.select("set_id", "vendor", F.row_number().over(order).alias("rep"), "value", "flag")


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, lift, load_kg)."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("set_id"), F.col("c_mktsegment").alias("lift"), F.col("c_acctbal").alias("load_kg"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, i, t, a): seconds since the epoch and the value less the recording's mean."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), "ts", "event_id", "value")
    whole = Window.partitionBy("recording_id")
    order = whole.orderBy("ts", "event_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return rows.select("recording_id", (F.row_number().over(order) - 1).cast("long").alias("i"), seconds.alias("t"), (F.col("value") - F.avg("value").over(whole)).alias("a"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, i, t, cx, cy, m_per_px, target_px): a cosine lift at 15 frames a second, its period by the user, on which the values lie as noise."""
    t = F.col("i") / F.lit(15.0)
    lift = 50 * (1 - F.cos(2 * F.pi() * t / (1.5 + 0.3 * (F.col("recording_id") % 5))))
    noise = F.col("a") * 0.05
    return series(spark, sf_dir).select(
        F.col("recording_id").alias("clip"), "i", t.alias("t"), (320 + noise).alias("cx"), (400 - lift + noise).alias("cy"), F.lit(0.005).alias("m_per_px"), F.lit(90.0).alias("target_px")
    )


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, i, t, a): acceleration of a swing at 20 Hz, its period by the user, on which the values lie as noise."""
    t = F.col("i") / F.lit(20.0)
    swing = 3 * F.cos(2 * F.pi() * t / (1.6 + 0.2 * (F.col("recording_id") % 5)))
    return series(spark, sf_dir).select("recording_id", "i", t.alias("t"), (swing + F.col("a") * 0.002).alias("a"))


#: The same views for DuckDB, as common table expressions.
CTES = {
    "reps": """reps as (
        select user_id as set_id, event_type as vendor, row_number() over (partition by user_id, event_type order by ts, event_id) as rep, value,
               case k % 10 when 0 then 'phantom' when 1 then 'missed' when 2 then 'partial_rom' else '' end as flag
        from (select *, cast(regexp_extract(props, '[0-9]+') as integer) as k from events))""",
    "sets": "sets as (select c_custkey as set_id, c_mktsegment as lift, c_acctbal as load_kg from customer)",
    "usable": "usable as (select * from reps where value is not null and flag not in ('phantom', 'missed'))",
    "series": """series as (
        select user_id as recording_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, epoch_us(ts) / 1e6 as t,
               value - avg(value) over (partition by user_id) as a from events)""",
    "tracks": """tracks as (
        select recording_id as clip, i, i / 15.0 as t, 320 + a * 0.05 as cx, 400 - 50 * (1 - cos(2 * pi() * (i / 15.0) / (1.5 + 0.3 * (recording_id % 5)))) + a * 0.05 as cy
        from series)""",
}
