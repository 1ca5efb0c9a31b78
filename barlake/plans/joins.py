"""Joins, governance and ordering on the adapter views (survey sections 2.1, 2.3, 2.5 to 2.7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import usable
from ..operators import repmetrics as rm
from ..operators import series, tables, trajectories
from ..sources import exports
from ..views import read, reps, sets
from .aggregates import HEAD, PAIRS, RANKED
from .registry import query

THREE = ("reps", "usable", "sets")


@query("j01_set_lookup", "select r.set_id, vendor, rep, lift, round(load_kg, 6) as load_kg from reps r join sets s on r.set_id = s.set_id", THREE)
def j01(spark, sf):
    return reps(spark, sf).join(sets(spark, sf), "set_id").select("set_id", "vendor", "rep", "lift", "load_kg")


@query("j02_lift_of_reps", "select lift, count(*) as n from usable u left join sets s on u.set_id = s.set_id where lift is not null group by lift", THREE)
def j02(spark, sf):
    return reps(spark, sf).where(usable()).join(sets(spark, sf), "set_id", "left").where("lift is not null").groupBy("lift").agg(F.count("*").alias("n"))


@query("j03_vendor_pivot", """select set_id, rep, round(max(case when vendor = 'view' then value end), 6) as view, round(max(case when vendor = 'purchase' then value end), 6) as purchase, round(max(case when vendor = 'click' then value end), 6) as click
    from usable group by set_id, rep""")
def j03(spark, sf):
    wide = rm.pivot_reps(reps(spark, sf), ["view", "purchase", "click", "signup", "error"])
    return wide.select("set_id", "rep", "view", "purchase", "click")


@query("j04_shared_reps", "select a.set_id, a.rep, round(a.value - b.value, 6) + 0.0 as d from usable a join usable b on a.set_id = b.set_id and a.rep = b.rep where a.vendor = 'click' and b.vendor = 'view'")
def j04(spark, sf):
    good = reps(spark, sf).where(usable())
    other = good.where("vendor = 'view'").select("set_id", "rep", F.col("value").alias("v"))
    return good.where("vendor = 'click'").join(other, ["set_id", "rep"]).select("set_id", "rep", (F.col("value") - F.col("v")).alias("d"))


@query("j05_common_window", """v as (select set_id, count(distinct vendor) as vendors from usable group by set_id), h as (select set_id, rep, count(distinct vendor) as here from usable group by set_id, rep)
    select u.set_id, u.vendor, u.rep, round(u.value, 6) as value from usable u join v on u.set_id = v.set_id join h on u.set_id = h.set_id and u.rep = h.rep where vendors >= 2 and here = vendors""")
def j05(spark, sf):
    return rm.common_window(reps(spark, sf)).select("set_id", "vendor", "rep", "value")


@query("j06_positional_pairs", RANKED + ", " + PAIRS + " select set_id, pos, round(source, 6) as source, round(reference, 6) as reference, n_source, n_reference from paired")
def j06(spark, sf):
    return rm.paired(reps(spark, sf), "click", "view")


@query("j07_strict_pairs", RANKED + ", " + PAIRS + " select set_id, pos, round(source, 6) as source, round(reference, 6) as reference from paired where n_source = n_reference and n_source >= 2")
def j07(spark, sf):
    rows = reps(spark, sf)
    fit = rm.rmse_bias(rows, "click", "view").where("n_source = n_reference and n_source >= 2").select("set_id")
    return rm.strict_pairs(rows.join(fit, "set_id", "left_semi"), "click", "view").select("set_id", "pos", "source", "reference")


@query("j08_head_pairs", HEAD + " select set_id, pos, round(source, 6) as source, round(reference, 6) as reference from head")
def j08(spark, sf):
    return rm.head_pairs(reps(spark, sf), "click", "view").select("set_id", "pos", "source", "reference")


@query("j09_tail_pairs", RANKED + """, t as (select set_id, rd - 1 as pos, max(case when vendor = 'click' then value end) as source, max(case when vendor = 'view' then value end) as reference from ranked where vendor in ('view', 'click') group by set_id, rd),
    k as (select *, count(*) over (partition by set_id) as n from t where source is not null and reference is not null) select set_id, pos, round(source, 6) as source, round(reference, 6) as reference, n from k where n >= 8""")
def j09(spark, sf):
    return rm.tail_pairs(reps(spark, sf), "click", "view")


@query("j10_coverage", """select c_custkey as set_id, 'not_on_board' as gap from customer where c_custkey not in (select user_id from events)
    union all select distinct user_id, 'no_truth' from events where user_id not in (select c_custkey from customer)""", ("reps",))
def j10(spark, sf):
    return tables.coverage(sets(spark, sf), reps(spark, sf))


@query("j11_inventory", """c as (select set_id, count(*) as n from reps group by set_id), o as (select distinct o_custkey as set_id from orders), e as (select distinct set_id from reps where vendor = 'error')
    select s.set_id, s.lift, c.n, case when o.set_id is not null then 'store' when e.set_id is not null then 'local' else '-' end as place from sets s left join c on s.set_id = c.set_id left join o on s.set_id = o.set_id left join e on s.set_id = e.set_id""", ("reps", "sets"))
def j11(spark, sf):
    rows = reps(spark, sf)
    stored = read(spark, sf, "orders").select(F.col("o_custkey").alias("set_id"))
    out = tables.inventory(sets(spark, sf), rows.groupBy("set_id").agg(F.count("*").alias("n")), stored, rows.where("vendor = 'error'"))
    return out.select("set_id", "lift", "n", "place")


@query("j12_truth_lookup", "select r.set_id, count(*) as n, max(cast(round(load_kg) as bigint)) as want from reps r join sets s on r.set_id = s.set_id where load_kg > 0 group by r.set_id", ("reps", "sets"))
def j12(spark, sf):
    known = sets(spark, sf).where("load_kg > 0").select("set_id", F.round("load_kg").cast("long").alias("want"))
    return reps(spark, sf).join(known, "set_id").groupBy("set_id").agg(F.count("*").alias("n"), F.max("want").alias("want"))


@query("j13_truth_fallback", "c as (select set_id, count(*) as n from reps where vendor = 'view' group by set_id) select s.set_id, coalesce(case when load_kg > 5000 then cast(5 as bigint) end, n) as truth from sets s left join c on s.set_id = c.set_id", ("reps", "sets"))
def j13(spark, sf):
    counts = reps(spark, sf).where("vendor = 'view'").groupBy("set_id").agg(F.count("*").alias("n"))
    return sets(spark, sf).join(counts, "set_id", "left").select("set_id", F.coalesce(F.when(F.col("load_kg") > 5000, F.lit(5).cast("long")), "n").alias("truth"))


WINDOWS = """w as (select user_id as workout_id, event_id as set_id, epoch_us(ts) / 1e6 as start from events where event_type = 'signup')"""


@query("j14_set_windows", WINDOWS + " select workout_id, set_id, count(*) as n, round(avg(value), 6) as bpm from events e join w on e.user_id = w.workout_id where epoch_us(e.ts) / 1e6 between start and start + 3600 group by workout_id, set_id", ("reps",))
def j14(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    events = read(spark, sf, "events")
    windows = events.where("event_type = 'signup'").select(F.col("user_id").alias("workout_id"), F.col("event_id").alias("set_id"), at.alias("start"), (at + 3600).alias("end"))
    samples = events.select(F.col("user_id").alias("workout_id"), at.alias("at"), "value")
    return tables.sliced(samples, windows, 600.0).groupBy("workout_id", "set_id").agg(F.count("*").alias("n"), F.avg("value").alias("bpm"))


@query("j15_nearest_time", """a as (select user_id as k, epoch_us(ts) / 1e6 as t from events where event_type = 'view'), b as (select user_id as k, epoch_us(ts) / 1e6 as t, value from events where event_type = 'purchase'),
    r as (select a.k, a.t, b.t as nt, b.value, row_number() over (partition by a.k, a.t order by abs(a.t - b.t), b.t) as r from a join b on a.k = b.k) select k as recording_id, round(t, 6) as t, round(nt, 6) as nearest_t, round(value, 6) as y from r where r = 1""", ("reps",))
def j15(spark, sf):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t")
    events = read(spark, sf, "events")
    left = events.where("event_type = 'view'").select(F.col("user_id").alias("recording_id"), at)
    right = events.where("event_type = 'purchase'").select(F.col("user_id").alias("recording_id"), at, F.col("value").alias("y"))
    return series.nearest(left, right).where("nearest_t is not null")


@query("j16_interpolated", """a as (select user_id as k, epoch_us(ts) / 1e6 as t from events where event_type = 'view'), b as (select user_id as k, epoch_us(ts) / 1e6 as t, value from events where event_type = 'purchase'),
    p as (select a.k, a.t, max(case when b.t <= a.t then b.t end) as t0, min(case when b.t > a.t then b.t end) as t1 from a join b on a.k = b.k group by a.k, a.t)
    select p.k as recording_id, round(p.t, 6) as t, round(case when t0 is null then y.value when t1 is null then x.value else x.value + (y.value - x.value) * (p.t - t0) / (t1 - t0) end, 6) as y
    from p left join b x on p.k = x.k and p.t0 = x.t left join b y on p.k = y.k and p.t1 = y.t""", ("reps",))  # fmt: skip
def j16(spark, sf):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t")
    events = read(spark, sf, "events")
    grid = events.where("event_type = 'view'").select(F.col("user_id").alias("recording_id"), at)
    samples = events.where("event_type = 'purchase'").select(F.col("user_id").alias("recording_id"), at, F.col("value").alias("y"))
    return series.interpolate(grid, samples).where("y is not null")


@query("j18_pairwise_slopes", RANKED + " select a.set_id, a.vendor, a.pos, b.pos as pos2, round((b.value - a.value) / (b.pos - a.pos), 6) + 0.0 as slope from ranked a join ranked b on a.set_id = b.set_id and a.vendor = b.vendor and b.pos > a.pos")
def j18(spark, sf):
    rows = rm.numbered(reps(spark, sf)).select("set_id", "vendor", "pos", "value")
    later = rows.select("set_id", "vendor", F.col("pos").alias("pos2"), F.col("value").alias("v2"))
    return rows.join(later, ["set_id", "vendor"]).where("pos2 > pos").select("set_id", "vendor", "pos", "pos2", ((F.col("v2") - F.col("value")) / (F.col("pos2") - F.col("pos"))).alias("slope"))


@query("j20_manual_mapping", "select n_name as name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name", ("reps",))
def j20(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("n"))


@query("j21_consensus", """a as (select set_id, count(*) as n, avg(value) as m from usable where vendor = 'view' group by set_id), b as (select set_id, count(*) as n, avg(value) as m from usable where vendor = 'click' group by set_id)
    select coalesce(a.set_id, b.set_id) as set_id, case when abs(a.n - b.n) <= 2 then 'pose' else 'fallback' end as spine,
           case when abs(a.n - b.n) <= 2 and abs(a.m - b.m) / b.m < 0.15 then 'HIGH' when abs(a.n - b.n) <= 2 then 'MEDIUM' else 'LOW' end as confidence from a full join b on a.set_id = b.set_id""")  # fmt: skip
def j21(spark, sf):
    per = reps(spark, sf).where(usable()).groupBy("set_id", "vendor").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rm.consensus(per.where("vendor = 'view'").withColumn("visibility", F.lit(0.9)), per.where("vendor = 'click'"))


@query("j22_session_groups", "select user_id as workout_id, count(*) as files, count(distinct event_type) as kinds from events group by user_id", ("reps",))
def j22(spark, sf):
    return read(spark, sf, "events").groupBy(F.col("user_id").alias("workout_id")).agg(F.count("*").alias("files"), F.countDistinct("event_type").alias("kinds"))


@query("j23_registered_only", "select set_id, vendor, rep from reps where set_id in (select o_custkey from orders)", ("reps",))
def j23(spark, sf):
    known = read(spark, sf, "orders").select(F.col("o_custkey").alias("set_id"))
    return reps(spark, sf).join(known, "set_id", "left_semi").select("set_id", "vendor", "rep")


@query("o02_best_candidate", """c as (select set_id as clip, vendor as candidate, count(*) as n_reps, avg(value) as score, max(case when flag = 'missed' then 1 else 0 end) = 0 as honest from reps group by set_id, vendor),
    r as (select *, row_number() over (partition by clip order by case when honest then 0 else 1 end, score desc, candidate) as r from c where n_reps between 3 and 18) select clip, candidate, honest, n_reps, round(score, 6) as score from r where r = 1""", ("reps",))
def o02(spark, sf):
    rows = reps(spark, sf).groupBy(F.col("set_id").alias("clip"), F.col("vendor").alias("candidate")).agg(
        F.count("*").alias("n_reps"), F.avg("value").alias("score"), (~F.bool_or(F.col("flag") == "missed")).alias("honest"), F.lit(False).alias("static")
    )
    return trajectories.choose_candidate(rows)


@query("o03_extreme_positions", "r as (select *, row_number() over (partition by set_id, vendor order by value desc, rep) as a, row_number() over (partition by set_id, vendor order by value, rep) as b from reps) select set_id, vendor, max(case when a = 1 then rep end) as argmax, max(case when b = 1 then rep end) as argmin from r group by set_id, vendor", ("reps",))
def o03(spark, sf):
    return reps(spark, sf).groupBy("set_id", "vendor").agg(F.min_by("rep", F.struct(-F.col("value"), F.col("rep"))).alias("argmax"), F.min_by("rep", F.struct("value", "rep")).alias("argmin"))


@query("o04_inventory_order", "select set_id, lift, row_number() over (order by lift, cast(set_id as varchar)) as place from sets", ("sets",))
def o04(spark, sf):
    return sets(spark, sf).select("set_id", "lift", F.row_number().over(Window.orderBy("lift", F.col("set_id").cast("string"))).alias("place"))


@query("w18_top_reps", "r as (select *, row_number() over (partition by set_id order by value desc, vendor, rep) as r from usable) select set_id, vendor, rep, round(value, 6) as value, r from r where r <= 3")
def w18(spark, sf):
    w = Window.partitionBy("set_id").orderBy(F.col("value").desc(), "vendor", "rep")
    return reps(spark, sf).where(usable()).select("set_id", "vendor", "rep", "value", F.row_number().over(w).alias("r")).where("r <= 3")


@query("w19_next_index", "select o_orderpriority as code, o_orderstatus as date, max(o_orderkey) + 1 as next_index from orders group by o_orderpriority, o_orderstatus", ("reps",))
def w19(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("code"), F.col("o_orderstatus").alias("date"), F.col("o_orderkey").alias("set_index"))
    return tables.next_index(rows).select("code", "date", "next_index")


@query("s12_unpivot_metrics", """select c_custkey as set_id, 'load_kg' as metric, 'kg' as unit, round(c_acctbal, 6) as value from customer where c_acctbal is not null union all select c_custkey, 'nation', '-', cast(c_nationkey as double) from customer where c_nationkey is not null""", ("reps",))
def s12(spark, sf):
    rows = read(spark, sf, "customer").withColumnRenamed("c_custkey", "set_id")
    return exports.unpivoted(rows, ["set_id"], [("load_kg", "kg", F.col("c_acctbal")), ("nation", "-", F.col("c_nationkey").cast("double"))])


@query("s20_replace_by_key", "select set_id, vendor, rep, value from (select set_id, vendor, rep, round(value, 6) as value from reps where vendor <> 'view' union all select set_id, vendor, rep, round(value * 2, 6) from reps where vendor = 'view')", ("reps",))
def s20(spark, sf):
    rows = reps(spark, sf).select("set_id", "vendor", "rep", "value")
    return tables.replace_by_key(rows, rows.where("vendor = 'view'").withColumn("value", F.col("value") * 2))


@query("s21_append_absent", "select set_id, lift from (select c_custkey as set_id, c_mktsegment as lift from customer where c_custkey % 2 = 0 union all select c_custkey, 'new' from customer where c_custkey % 2 = 1)", ("reps",))
def s21(spark, sf):
    rows = sets(spark, sf).select("set_id", "lift")
    return tables.append_absent(rows.where("set_id % 2 = 0"), rows.withColumn("lift", F.lit("new")))


@query("s22_upsert", "select c_custkey as set_id, case when c_custkey % 3 = 0 then 'kept' else c_mktsegment end as lift, round(c_acctbal, 6) as load_kg from customer", ("reps",))
def s22(spark, sf):
    new = sets(spark, sf)
    old = new.where("set_id % 3 = 0").withColumn("lift", F.lit("kept")).withColumn("load_kg", F.lit(0.0))
    return tables.upsert(old, new, "set_id", ["load_kg"])


@query("s23_key_breaks", "select 'foreign' as kind, count(*) as n from (select distinct set_id from reps) r where set_id not in (select set_id from sets) union all select 'primary', count(*) from (select l_orderkey, l_linenumber from lineitem group by l_orderkey, l_linenumber having count(*) > 1)", ("reps", "sets"))
def s23(spark, sf):
    foreign = tables.foreign_key_breaks(reps(spark, sf).select("set_id").distinct(), sets(spark, sf), "set_id")
    primary = tables.primary_key_breaks(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(foreign, "foreign").union(count(primary, "primary"))
