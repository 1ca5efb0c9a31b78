"""Stream graphs (survey section 2.12), over events that are replayed in slices of time; their SQL is that of the whole table at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import live
from ..views import read
from .registry import query

#: Files that a table is replayed in.
SLICES = 4
#: Event time that sets may last and that events may be late, in the tables' hours.
LONGEST = "48 hours"

CONTROL = """k as (select user_id, ts, event_id, case event_type when 'purchase' then 'start_set' when 'signup' then 'stop_set' else 'stop_workout' end as kind from events where event_type in ('purchase', 'signup', 'error')),
    l as (select *, lead(ts) over (partition by user_id order by ts, kind, cast(event_id as varchar)) as until from k),
    sets as (select user_id, event_id, ts as since, until from l where kind = 'start_set' and until > ts and until <= ts + interval 48 hours)"""


def _beats(spark, sf):
    return read(spark, sf, "events").where("event_type in ('view', 'click')").select(F.col("user_id").cast("string").alias("workout_id"), F.col("ts").cast("timestamp").alias("utc"), F.col("value").alias("bpm"))


def _control(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "start_set").when(F.col("event_type") == "signup", "stop_set").otherwise("stop_workout")
    rows = read(spark, sf, "events").where("event_type in ('purchase', 'signup', 'error')")
    return rows.select(F.col("user_id").cast("string").alias("workout_id"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), F.col("event_id").cast("string").alias("set_id"))


def _run(spark, tables, graph, mode="append"):
    return live.replayed(spark, tables, graph, shared_folder(spark), mode, SLICES)[0]


@query("t01_live_heart_rate", "select user_id as workout_id, count(*) as n, round(max(epoch_us(ts)) / 1e6 + 50, 6) as last_t from events where event_type in ('view', 'click') group by user_id", ())
def t01(spark, sf):
    out = _run(spark, {"beats": (_beats(spark, sf), "utc", live.HEART)}, lambda beats: live.heart_rate(beats, uptime=50.0))
    return out.groupBy(F.col("workout_id").cast("long").alias("workout_id")).agg(F.count("*").alias("n"), F.max("t").alias("last_t"))


@query("t02_motion_rates", """m as (select user_id, value as t from events where value is not null)
    select user_id as recording_id, count(*) as n, round(case when max(t) > min(t) then (count(*) - 1) / (max(t) - min(t)) end, 6) as rate from m group by user_id""", ())
def t02(spark, sf):
    """The last that a stream says of each recording."""
    zero = [F.lit(0.0).alias(c) for c in ("ua_x", "ua_y", "ua_z")]
    rows = read(spark, sf, "events").where("value is not null").select(F.col("user_id").cast("string").alias("recording_id"), F.col("ts").cast("timestamp").alias("utc"), F.col("value").alias("t"), *zero)
    out = _run(spark, {"motion": (rows, "utc", live.MOTION)}, lambda motion: live.motion_rate(motion, "1 hour", "10000 days"), "update")
    return out.groupBy(F.col("recording_id").cast("long").alias("recording_id")).agg(F.max("n").alias("n"), F.max_by("rate", "n").alias("rate"))


@query("t03_sets_of_events", f"{CONTROL} select user_id as workout_id, event_id as set_id, epoch_us(since) as since, epoch_us(until) as until from sets", ())
def t03(spark, sf):
    out = _run(spark, {"events": (_control(spark, sf), "at", live.EVENT)}, lambda events: live.sets_of(events, "1 hour", LONGEST))
    return out.select(F.col("workout_id").cast("long").alias("workout_id"), F.col("set_id").cast("long").alias("set_id"), F.unix_micros("start").alias("since"), F.unix_micros("end").alias("until"))


@query("t04_heart_rate_of_open_sets", f"""{CONTROL}, b as (select user_id, ts, value from events where event_type in ('view', 'click'))
    select sets.user_id as workout_id, event_id as set_id, count(*) as n, round(avg(value), 6) as bpm, epoch_us(min(b.ts)) as first, epoch_us(max(b.ts)) as last
    from sets join b on b.user_id = sets.user_id and b.ts between since and until group by sets.user_id, event_id""", ())
def t04(spark, sf):
    tables = {"beats": (_beats(spark, sf), "utc", live.HEART), "events": (_control(spark, sf), "at", live.EVENT)}
    out = _run(spark, tables, lambda beats, events: live.heart_rate_of_open_sets(beats, events, "1 hour", LONGEST))
    ids = [F.col(c).cast("long").alias(c) for c in ("workout_id", "set_id")]
    return out.groupBy(*ids).agg(F.count("*").alias("n"), F.avg("bpm").alias("bpm"), F.unix_micros(F.min("utc")).alias("first"), F.unix_micros(F.max("utc")).alias("last"))
