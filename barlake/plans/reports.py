"""Reports on the corpus, legs of tracks, seeds and bounded alignments (survey J10, J11, J17, X6, F2)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import usable
from ..operators import alignment, estimates, reports
from ..operators import trajectories as traj
from ..views import moves, read, reps, sets, tracks
from .recordings import _detections
from .registry import query

CLIPS = "v as (select o_custkey as set_id, case o_orderkey % 3 when 0 then '3840x2160' when 1 then '1920x1080' end as resolution, concat('f', o_orderkey) as file from orders)"
GAPS = CLIPS + """, t as (select set_id, string_agg(distinct vendor, ',' order by vendor) as vendors from usable group by set_id), c as (select set_id, coalesce(max(resolution), 'local') as resolution from v group by set_id),
    w as (select distinct set_id from reps where vendor = 'error'), vb as (select set_id from reps where vendor = 'purchase' and rep = 15), wb as (select set_id from reps where vendor = 'error' and rep = 12),
    g as (select 'video' as section, cast(c.set_id as varchar) as item, vendors, resolution, substr(resolution, 1, 4) in ('3840', '2160') as large, true as gap from c join t on c.set_id = t.set_id where c.set_id not in (select set_id from vb)
        union all select 'watch', cast(w.set_id as varchar), vendors, null, false, true from w left join t on w.set_id = t.set_id where w.set_id not in (select set_id from wb)
        union all select 'no_signal', cast(set_id as varchar), vendors, null, false, false from t where set_id not in (select set_id from c) and set_id not in (select set_id from w)
        union all select distinct 'object', concat('f', o_orderkey + o_orderkey % 7), null, null, false, true from orders where concat('f', o_orderkey + o_orderkey % 7) not in (select file from v))"""


def _gaps(spark, sf):
    rows, orders, key = reps(spark, sf), read(spark, sf, "orders"), F.col("o_orderkey")
    size = F.when(key % 3 == 0, "3840x2160").when(key % 3 == 1, "1920x1080")
    videos = orders.select(F.col("o_custkey").alias("set_id"), size.alias("resolution"), F.concat(F.lit("f"), key).alias("file"))
    objects = orders.select(F.concat(F.lit("f"), key + key % 7).alias("name"))
    error = rows.where("vendor = 'error'")
    return reports.coverage_gaps(rows.where(usable()), videos, error, rows.where("vendor = 'purchase' and rep = 15"), error.where("rep = 12"), objects)


@query("j10_coverage_gaps", GAPS + " select * from g")
def j10b(spark, sf):
    return _gaps(spark, sf)


@query("j10_coverage_summary", GAPS + """ select section, count(*) as items, count(*) filter (where large) as large, count(*) filter (where gap) as gaps from g group by section
    union all select 'all', count(*), count(*) filter (where large), count(*) filter (where gap) from g""")
def j10c(spark, sf):
    return reports.coverage_summary(_gaps(spark, sf))


@query("j11_inventory_lines", """n as (select set_id, nullif(count(*) filter (where vendor = 'view'), 0) as v, nullif(count(*) filter (where vendor = 'purchase'), 0) as p, nullif(count(*) filter (where vendor = 'click'), 0) as c,
        nullif(count(*) filter (where vendor = 'signup'), 0) as w, max(rep) filter (where vendor = 'signup') as a from reps where flag <> 'phantom' group by set_id),
    o as (select o_custkey as set_id, min(strftime(o_orderdate, '%Y-%m-%d')) as date, max(o_totalprice) > 300000 as stored, count(*) as orders from orders group by o_custkey), e as (select distinct set_id from reps where vendor = 'error' and rep = 10),
    r as (select s.set_id, date, lift, s.set_id % 4 as k, case when load_kg > 5000 then 5 end as want, v, p, c, w, a, case when stored then 'store' when e.set_id is not null then 'git' end as place, case when orders > 9 then orders end as auto,
          from sets s left join n on s.set_id = n.set_id left join o on s.set_id = o.set_id left join e on s.set_id = e.set_id),
    l as (select *, concat('| ', coalesce(date, '–'), ' | ', lift, ' | ', k, ' | ', coalesce(cast(want as varchar), '?'), ' | ', coalesce('view ' || v, 'purchase ' || p, '—'), ' | ', coalesce(place, '—'), ' | ', coalesce(cast(c as varchar), '—'), ' | ',
          coalesce(cast(auto as varchar), case when place is not null then '?' end, '—'), ' | ', coalesce(cast(w as varchar), '—'), ' | ', coalesce(cast(a as varchar), '—'), ' |') as line from r)
    select row_number() over (order by date nulls first, lift, cast(k as varchar), set_id) as n, line from l union all select -1, '| date | lift | set_index | reps | truth | video | other | auto | watch_auto | watch_adjusted |' union all select 0, '|-|-|-|-|-|-|-|-|-|-|'
    union all select null, printf('%d sets, %d with truth, %d with video, %d with watch', count(*), count(coalesce(v, p)), count(place), count(w)) from r""", ("reps", "sets"))
def j11b(spark, sf):
    rows = reps(spark, sf)
    orders = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("set_id")).agg(F.min(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), (F.max("o_totalprice") > 300000).alias("stored"), F.count("*").alias("count"))
    known = sets(spark, sf).join(orders.select("set_id", "date"), "set_id", "left").withColumns({"set_index": F.col("set_id") % 4, "actual_reps": F.when(F.col("load_kg") > 5000, 5)})
    signups = rows.where("vendor = 'signup' and flag <> 'phantom'").groupBy("set_id").agg(F.count("*").alias("auto"), F.max("rep").alias("adjusted"))
    made = reports.inventory_rows(known, rows, orders.where("stored"), rows.where("vendor = 'error' and rep = 10"), orders.where("count > 9"), signups, ["view", "purchase"], "click")
    return reports.inventory_lines(made)


def _halves(spark, sf):
    """Tracks seen from their middle frame: forwards from it, and backwards over what comes before."""
    whole = Window.partitionBy("clip")
    rows = tracks(spark, sf).withColumn("mid", F.floor(F.count("*").over(whole) / 2)).withColumn("seed_t", F.max(F.when(F.col("i") == F.col("mid"), F.col("t"))).over(whole))
    legs = rows.where("i >= mid").select("clip", F.lit("forward").alias("leg"), "t", "cx", "cy").unionByName(rows.where("i <= mid").select("clip", F.lit("backward").alias("leg"), (F.col("seed_t") - F.col("t")).alias("t"), "cx", "cy"))
    return legs, rows.where("i = mid").select("clip", "seed_t"), rows


@query("x06_stitched_legs", """m as (select *, count(*) over (partition by clip) // 2 as mid from tracks)
    select clip, round(t, 6) as t, round(cx, 6) as cx, round(cy, 6) as cy, case when i >= mid then 'forward' else 'backward' end as leg from m where i >= mid or mid >= 2""", ("series", "tracks"))
def x06(spark, sf):
    legs, seeds, _ = _halves(spark, sf)
    return traj.stitched_legs(legs, seeds)


@query("x06_leg_agreement", """d as (select clip, 5.0 * (i % 7) as dx, cy * 0.004 * (clip % 20) as dy from tracks), r as (select clip, count(*) as shared, sqrt(avg(dx * dx + dy * dy)) as rms from d group by clip)
    select clip, shared, round(rms, 6) as rms, rms <= 0.25 * 90 as agrees from r""", ("series", "tracks"))
def x06b(spark, sf):
    """The backward leg strays sideways by frame and upwards by clip."""
    _, seeds, rows = _halves(spark, sf)
    forward = rows.select("clip", F.lit("forward").alias("leg"), "t", "cx", "cy")
    backward = rows.select("clip", F.lit("backward").alias("leg"), (F.col("seed_t") - F.col("t")).alias("t"), (F.col("cx") + 5.0 * (F.col("i") % 7)).alias("cx"), (F.col("cy") * (1 + 0.004 * (F.col("clip") % 20))).alias("cy"))
    return traj.leg_agreement(forward.unionByName(backward), seeds, rows.select("clip", "target_px").distinct())


@query("d20_alignments_above", """a as (select recording_id, i, y, n from (select *, 3 * cos(2 * pi() * (i / 20.0) / (1.6 + 0.2 * (recording_id % 5))) + a * 0.002 as y, count(*) over (partition by recording_id) as n from series) where i < n - 1),
    b as (select clip, i, cy as y, n from (select *, count(*) over (partition by clip) as n from tracks) where i < n - 1),
    p as (select recording_id, i, n - 1 as n, (y - avg(y) over w) / (stddev_pop(y) over w + 1e-9) as y from a window w as (partition by recording_id)), q as (select clip, i, n - 1 as n, (y - avg(y) over w) / (stddev_pop(y) over w + 1e-9) as y from b window w as (partition by clip)),
    c as (select recording_id, clip, p.i - q.i as lag, sum(p.y * q.y) / least(max(p.n), max(q.n)) as r from p, q group by recording_id, clip, p.i - q.i),
    k as (select *, row_number() over (partition by recording_id, clip order by abs(r) desc, lag) as k from c) select recording_id, clip, round(r, 6) as r, lag from k where k = 1 and abs(r) >= 0.8""", ("series", "tracks"))
def d20b(spark, sf):
    """Every recording against every clip, sample by sample."""
    i = F.col("i").cast("double").alias("t")
    return alignment.align_above(moves(spark, sf).select("recording_id", i, F.col("a").alias("y")), tracks(spark, sf).select("clip", i, F.col("cy").alias("y")), 0.8, 1.0)


@query("f02_seeded_counts")
def f02b(spark, sf):
    """Seeds on the lift at its first frame, nudged by up to two radii; linked tracks have no SQL."""
    found = _detections(spark, sf)
    seeds = tracks(spark, sf).where("i = 0").select("clip", F.lit(0).alias("frame"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    nudges = [(0.0, 0.0), (0.3, 0.0), (-0.3, 0.0), (0.0, 0.6), (2.0, 0.0)]
    return traj.jitter_stability(estimates.seeded_counts(found, seeds, nudges))
