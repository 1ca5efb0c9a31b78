"""Ordered-series operators on the adapter views (survey section 2.5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import recordings as rec
from ..operators import series as ops
from ..views import reps, series
from .registry import query

ONE = ("series",)
K = "partition by recording_id order by i"
AREA = f"""inc as (select *, coalesce((t - lag(t) over ({K})) * (a + lag(a) over ({K})) / 2, 0.0) as d from series), area as (select *, sum(d) over ({K} rows unbounded preceding) as c from inc)"""
MARKED = f"""marked as (select *, case when i % 10 = 0 or i = 0 or i = max(i) over (partition by recording_id) then i end as m from area),
    bounds as (select *, max(m) over ({K} rows between unbounded preceding and current row) as p, min(m) over ({K} rows between current row and unbounded following) as q from marked)"""
ZUPT = """zupt as (select b.*, b.c - x.c - case when q > p then (b.i - p) * 1.0 / (q - p) else 0 end * (y.c - x.c) as v from bounds b join area x on b.recording_id = x.recording_id and b.p = x.i join area y on b.recording_id = y.recording_id and b.q = y.i)"""


def _marked(spark, sf):
    return series(spark, sf).withColumn("anchor", F.col("i") % 10 == 0)


def _velocity(spark, sf):
    return ops.zero_velocity_integral(_marked(spark, sf))


@query("w01_cumulative_trapezoid", AREA + " select recording_id, i, round(c, 3) + 0.0 as area from area", ONE)
def w01(spark, sf):
    return ops.cumulative_trapezoid(series(spark, sf)).select("recording_id", "i", F.round("area", 3).alias("area"))


@query("w02_zero_velocity_update", AREA + ", " + MARKED + ", " + ZUPT + " select recording_id, i, round(v, 3) + 0.0 as v from zupt", ONE)
def w02(spark, sf):
    return _velocity(spark, sf).select("recording_id", "i", F.round("v", 3).alias("v"))


@query("w03_sample_rate", f"d as (select recording_id, t - lag(t) over ({K}) as dt from series) select recording_id, round(1 / quantile_cont(dt, 0.5), 6) as fs from d group by recording_id", ONE)
def w03(spark, sf):
    return ops.sample_rate(series(spark, sf))


@query("w04_sign_changes", f"s as (select *, case when a < 0 then -1 else 1 end as s from series), c as (select *, lead(s) over ({K}) as n from s) select recording_id, i from c where n <> s", ONE)
def w04(spark, sf):
    return ops.crossings(series(spark, sf)).where("crossing").select("recording_id", "i")


@query("w05_edge_margin", f"s as (select *, case when a < 0 then -1 else 1 end as s, count(*) over (partition by recording_id) as n from series), c as (select *, lead(s) over ({K}) as nx from s) select recording_id, i from c where nx <> s and i > floor(0.05 * n) and i < n - floor(0.05 * n)", ONE)
def w05(spark, sf):
    return ops.crossings(series(spark, sf), margin=0.05).where("crossing").select("recording_id", "i")


@query("w06_greedy_separation", f"""s as (select *, case when a < 0 then -1 else 1 end as s from series), c as (select *, lead(s) over ({K}) as n from s), m as (select recording_id, i from c where n <> s)
    select recording_id, i from (with recursive kept as (select recording_id, min(i) as i from m group by recording_id union all
        select k.recording_id, min(m.i) as i from kept k join m on m.recording_id = k.recording_id and m.i >= k.i + 3 group by k.recording_id, k.i) select * from kept)""", ONE)  # fmt: skip
def w06(spark, sf):
    return rec.separated(w04(spark, sf), 3)


SEGMENTS = """ends as (select recording_id, m, lead(m) over (partition by recording_id order by m) as e, row_number() over (partition by recording_id order by m) - 1 as segment from marked where m is not null),
    seg as (select z.*, e.segment from zupt z join ends e on z.recording_id = e.recording_id and z.i between e.m and e.e)"""


@query("w07_segments", AREA + ", " + MARKED + ", " + ZUPT + ", " + SEGMENTS + " select recording_id, segment, i from seg", ONE)
def w07(spark, sf):
    return ops.segments(_marked(spark, sf)).select("recording_id", "segment", "i")


METRICS = """sinc as (select *, (t - lag(t) over (partition by recording_id, segment order by i)) * (v + lag(v) over (partition by recording_id, segment order by i)) / 2 as d2 from seg),
    met as (select recording_id, segment, min(t) as start, max(t) as stop, avg(v) as mv, max(v) as pv, sum(d2) as rom, count(*) as samples from sinc group by recording_id, segment),
    kept as (select *, row_number() over (partition by recording_id order by segment) - 1 as rep from met where mv > 0 and samples > 1)"""


@query("a22_segment_metrics", AREA + ", " + MARKED + ", " + ZUPT + ", " + SEGMENTS + ", " + METRICS + " select recording_id, rep, round(start, 6) as start, round(stop, 6) as stop, round(mv, 3) as mean_velocity, round(pv, 3) as peak_velocity, samples from kept", ONE)
def a22(spark, sf):
    rows = ops.segment_metrics(ops.segments(_velocity(spark, sf)))
    return rows.select("recording_id", "rep", "start", F.col("end").alias("stop"), F.round("mean_velocity", 3).alias("mean_velocity"), F.round("peak_velocity", 3).alias("peak_velocity"), "samples")


@query("a23_gate_reps", """c as (select *, value / 100 as rom, value / 60 as mv from usable), k as (select set_id, sum(case when rom > 0.3 and mv > 0.45 then 1 else 0 end) as n, quantile_cont(case when rom > 0.3 and mv > 0.45 then rom end, 0.5) as mr, quantile_cont(case when rom > 0.3 and mv > 0.45 then mv end, 0.5) as mm from c where vendor = 'view' group by set_id),
    g as (select c.set_id, c.rep as original, rom, c.mv from c join k on c.set_id = k.set_id where vendor = 'view' and (n < 3 or (rom >= 0.55 * mr and rom <= 1.5 * mr and c.mv >= 0.55 * mm)))
    select set_id, original, row_number() over (partition by set_id order by original) - 1 as rep, round(rom, 6) as rom from g""", ("reps", "usable"))
def a23(spark, sf):
    from ..functions import usable

    rows = reps(spark, sf).where(usable()).where("vendor = 'view'").select("set_id", F.col("rep").alias("original"), (F.col("value") / 100).alias("rom"), (F.col("value") / 60).alias("mean_velocity"))
    return ops.gate_reps(rows, by="set_id", order="original").select("set_id", "original", "rep", "rom")


@query("a24_active_mean", "p as (select *, max(abs(a)) over (partition by recording_id) as peak from series) select recording_id, round(abs(avg(case when abs(a) >= greatest(0.05, 0.1 * peak) - 1e-9 then a end)), 6) as mean_velocity, round(max(peak), 6) as peak_velocity from p group by recording_id", ONE)
def a24(spark, sf):
    return ops.concentric_velocity(series(spark, sf), ["recording_id"], "a")


@query("a25_running_rate", f"select recording_id, i, round(case when i > 0 then i / (t - min(t) over ({K})) end, 6) as rate from series", ONE)
def a25(spark, sf):
    return ops.running_rate(series(spark, sf)).select("recording_id", "i", "rate")


@query("a28_periodicity", f"""n as (select *, count(*) over (partition by recording_id) as n, i - (count(*) over (partition by recording_id) - 1) / 2.0 as x from series), f as (select recording_id, sum(x * a) / sum(x * x) as b, avg(a) as m from n group by recording_id),
    d as (select n.recording_id, n.i, n.n, a - m - b * x as y from n join f on n.recording_id = f.recording_id), p as (select recording_id, sum(y * y) as p from d group by recording_id),
    r as (select u.recording_id, v.i - u.i as lag, sum(u.y * v.y) / max(p.p) as r, max(u.n) as n from d u join d v on u.recording_id = v.recording_id and v.i - u.i between 3 and greatest(3, floor(u.n / 2)) join p on u.recording_id = p.recording_id group by u.recording_id, v.i - u.i),
    k as (select *, row_number() over (partition by recording_id order by r desc, lag) as k from r) select recording_id, round(greatest(r, 0), 6) as periodicity, lag as period_lag from k where k = 1 and n >= 8""", ONE)  # fmt: skip
def a28(spark, sf):
    return rec.periodicities(series(spark, sf))


@query("w08_renumbered", "select set_id, vendor, rep, row_number() over (partition by set_id, vendor order by rep) as new_rep from usable", ("reps", "usable"))
def w08(spark, sf):
    from ..functions import usable

    return reps(spark, sf).where(usable()).select("set_id", "vendor", "rep", F.row_number().over(Window.partitionBy("set_id", "vendor").orderBy("rep")).alias("new_rep"))


@query("w09_terminal_window", "r as (select *, row_number() over (partition by set_id, vendor order by rep desc) as rd, count(*) over (partition by set_id, vendor) as n from usable) select set_id, vendor, rep from r where rd <= greatest(1, least(2, n - 1))", ("reps", "usable"))
def w09(spark, sf):
    from ..functions import usable

    w = Window.partitionBy("set_id", "vendor")
    rows = reps(spark, sf).where(usable()).withColumn("n", F.count("*").over(w)).withColumn("rd", F.row_number().over(w.orderBy(F.col("rep").desc())))
    return rows.where(F.col("rd") <= F.greatest(F.lit(1), F.least(F.lit(2), F.col("n") - 1))).select("set_id", "vendor", "rep")


@query("w10_envelope", "select recording_id, i, round(max(a) over (partition by recording_id order by t range between 3600.0 preceding and 3600.0 following), 6) + 0.0 as envelope from series", ONE)
def w10(spark, sf):
    return ops.envelope(series(spark, sf), 3600.0).select("recording_id", "i", "envelope")


@query("w11_rolling_median", """o as (select unnest([-2, -1, 0, 1, 2]) as o), s as (select *, count(*) over (partition by recording_id) as n from series), k as (select s.recording_id, s.i, case when s.i + o < 0 then -(s.i + o) - 1 when s.i + o >= n then 2 * n - 1 - (s.i + o) else s.i + o end as j from s cross join o)
    select k.recording_id, k.i, round(quantile_cont(s.a, 0.5), 6) + 0.0 as median from k join series s on k.recording_id = s.recording_id and k.j = s.i group by k.recording_id, k.i""", ONE)
def w11(spark, sf):
    return ops.rolling_median(series(spark, sf)).select("recording_id", "i", "median")


@query("w12_gap_to_next", f"select recording_id, i, round(lead(t) over ({K}) - t, 6) as gap from series", ONE)
def w12(spark, sf):
    return series(spark, sf).select("recording_id", "i", (F.lead("t").over(ops.by_sample()) - F.col("t")).alias("gap"))


@query("w13_neighbour_step", f"m as (select *, quantile_cont(a, 0.5) over (partition by recording_id) as m from series) select recording_id, i, round(least(abs(a - m), coalesce(abs(a - lag(a) over ({K})), abs(a - m))), 6) as step from m", ONE)
def w13(spark, sf):
    d = F.abs(F.col("a") - F.percentile("a", 0.5).over(ops.whole()))
    rows = series(spark, sf).withColumn("d", d)
    return rows.select("recording_id", "i", F.least("d", F.coalesce(F.abs(F.col("a") - F.lag("a").over(ops.by_sample())), "d")).alias("step"))


@query("w14_difference_noise", f"d as (select recording_id, a - lag(a) over ({K}) as d from series) select recording_id, round(stddev_pop(d), 6) as noise from d group by recording_id", ONE)
def w14(spark, sf):
    return series(spark, sf).withColumn("d", F.col("a") - F.lag("a").over(ops.by_sample())).groupBy("recording_id").agg(F.stddev_pop("d").alias("noise"))


EXTREMA = f"""e0 as (select *, lag(a) over ({K}) as b, lead(a) over ({K}) as f from series), ev as (select recording_id, i, a as pos, case when a > b then 'max' else 'min' end as kind from e0 where (a > b and a > f) or (a < b and a < f) or (a > b and f is null) or i % 7 = 0 and b is not null),
    e1 as (select *, case when lag(kind) over ({K}) = kind then 0 else 1 end as s from ev), e2 as (select *, sum(s) over ({K} rows unbounded preceding) as run from e1),
    e3 as (select *, row_number() over (partition by recording_id, run order by case when kind = 'min' then pos else -pos end, i) as r from e2), walk as (select recording_id, kind, i, pos from e3 where r = 1)"""


def _extrema(spark, sf):
    b, f = F.lag("a").over(ops.by_sample()), F.lead("a").over(ops.by_sample())
    rows = series(spark, sf).withColumn("b", b).withColumn("f", f)
    at = "(a > b and a > f) or (a < b and a < f) or (a > b and f is null) or (i % 7 = 0 and b is not null)"
    return rows.where(at).select("recording_id", "i", F.col("a").alias("pos"), F.when(F.col("a") > F.col("b"), "max").otherwise("min").alias("kind"))


@query("w15_alternating_extrema", EXTREMA + " select recording_id, kind, i, round(pos, 6) + 0.0 as pos from walk", ONE)
def w15(spark, sf):
    return ops.alternating(_extrema(spark, sf))


PAIRED = EXTREMA + f""", p as (select *, lead(kind) over ({K}) as k, lead(i) over ({K}) as top, lead(pos) over ({K}) as tp from walk), ex as (select recording_id, i as bottom, top, tp - pos as amplitude from p where kind = 'min' and k = 'max' and top - i >= 1),
    gx as (select *, lead(bottom) over (partition by recording_id order by bottom) - top as gap from ex)"""


@query("w16_excursions", PAIRED + " select recording_id, bottom, top, round(amplitude, 6) + 0.0 as amplitude, gap from gx", ONE)
def w16(spark, sf):
    return ops.excursions(ops.alternating(_extrema(spark, sf)), F.lit(5.0))


@query("w17_stripped_ends", PAIRED + """, m as (select *, count(*) over (partition by recording_id) as n, row_number() over (partition by recording_id order by bottom) - 1 as k, quantile_cont(amplitude, 0.5) over (partition by recording_id) as am, coalesce(quantile_cont(gap, 0.5) over (partition by recording_id), 0) as gm from gx),
    f as (select *, amplitude < 0.75 * am as small, gm > 0 and coalesce(gap, 0) > 2.5 * gm as lone from m), h as (select *, greatest(coalesce(max(case when not small then k end) over (partition by recording_id) + 1, 0), least(3, n)) as hi from f),
    l as (select *, least(coalesce(min(case when not (small or lone) then k end) over (partition by recording_id), n), greatest(hi - 3, 0)) as lo from h)
    select recording_id, bottom, top from l where n < 4 or am <= 0 or (k < hi and k >= lo)""", ONE)  # fmt: skip
def w17(spark, sf):
    return ops.strip_ends(ops.excursions(ops.alternating(_extrema(spark, sf)), F.lit(5.0))).select("recording_id", "bottom", "top")


@query("w20_gradient", f"""h as (select *, t - lag(t) over ({K}) as hp, lead(t) over ({K}) - t as hn, (a - lag(a) over ({K})) / (t - lag(t) over ({K})) as dp, (lead(a) over ({K}) - a) / (lead(t) over ({K}) - t) as dn from series)
    select recording_id, i, round(coalesce((dp * hn + dn * hp) / (hp + hn), dp, dn), 6) + 0.0 as slope from h""", ONE)
def w20(spark, sf):
    return ops.gradient(series(spark, sf)).select("recording_id", "i", "slope")


@query("s25_replay_window", "w as (select * from series where i between 5 and 20) select recording_id, i, round(max(t) over (partition by recording_id) - t, 6) as t from w", ONE)
def s25(spark, sf):
    rows = series(spark, sf).where("i between 5 and 20")
    return ops.replay(rows, 0.0, 1e12, backwards=True).select("recording_id", "i", "t")
