"""Measures over repetitions, on the adapter views (survey section 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lift_weight, provenance, usable
from ..operators import repmetrics as rm
from ..operators import tables, trajectories
from ..views import PREFERENCE, read, reps, sets
from .registry import query

# Names that the SQL below shares.
RANKED = """ranked as (
    select *, row_number() over (partition by set_id, vendor order by rep desc) as rd, row_number() over (partition by set_id, vendor order by rep) - 1 as pos,
           count(*) over (partition by set_id, vendor) as n, max(value) over (partition by set_id, vendor) as best from usable),
groups as (select distinct set_id, vendor from reps),
loss as (
    select g.set_id, g.vendor, coalesce(max(n), 0) as n_reps, max(best) as best,
           case when max(n) >= 3 and max(best) > 0 then (max(best) - avg(case when rd <= greatest(1, least(2, n - 1)) then value end)) / max(best) * 100 end as velocity_loss
    from groups g left join ranked r on g.set_id = r.set_id and g.vendor = r.vendor group by g.set_id, g.vendor)"""
SLOPES = """slopes as (
    select a.set_id, a.vendor, quantile_cont((b.value - a.value) / (b.pos - a.pos), 0.5) as slope
    from ranked a join ranked b on a.set_id = b.set_id and a.vendor = b.vendor and b.pos > a.pos group by a.set_id, a.vendor)"""
PAIRS = """sides as (select * from ranked where vendor in ('view', 'click')),
paired0 as (
    select set_id, pos, max(case when vendor = 'click' then value end) as source, max(case when vendor = 'view' then value end) as reference from sides group by set_id, pos),
paired as (select *, count(source) over (partition by set_id) as n_source, count(reference) over (partition by set_id) as n_reference from paired0)"""
GATED = """gated as (
    select set_id, max(n_source) as n_source, max(n_reference) as n_reference, sqrt(avg(d * d)) as rmse, avg(d) as bias
    from (select *, case when n_source = n_reference then source - reference end as d from paired) group by set_id)"""
PREF = "case vendor when 'view' then 1 when 'purchase' then 2 when 'click' then 3 when 'signup' then 4 when 'error' then 5 end"
CORR = "case when count(*) >= {n} and stddev_pop({x}) > 0 and stddev_pop({y}) > 0 then (avg({x} * {y}) - avg({x}) * avg({y})) / (stddev_pop({x}) * stddev_pop({y})) end"


def _pairs(spark, sf):
    return rm.paired(reps(spark, sf), "click", "view")


@query("a01_velocity_loss", RANKED + " select set_id, vendor, n_reps, round(best, 6) as best, round(velocity_loss, 6) + 0.0 as velocity_loss from loss")
def a01(spark, sf):
    return rm.velocity_loss(reps(spark, sf))


@query("a01_velocity_loss_no_partial", RANKED + """, full_reps as (
    select *, row_number() over (partition by set_id, vendor order by rep desc) as fd, count(*) over (partition by set_id, vendor) as fn from usable where flag <> 'partial_rom'),
    tails as (select set_id, vendor, max(fn) as fn, avg(case when fd <= 2 then value end) as tail from full_reps group by set_id, vendor)
    select l.set_id, l.vendor, l.n_reps, round(l.best, 6) as best,
           round(case when l.velocity_loss is null then null when fn >= 3 then (l.best - tail) / l.best * 100 else l.velocity_loss end, 6) + 0.0 as velocity_loss
    from loss l left join tails t on l.set_id = t.set_id and l.vendor = t.vendor""")  # fmt: skip
def a01b(spark, sf):
    return rm.velocity_loss(reps(spark, sf), exclude_partial=True)


@query("a02_velocity_loss_or_zero", RANKED + " select set_id, vendor, round(coalesce(velocity_loss, 0), 6) + 0.0 as velocity_loss from loss")
def a02(spark, sf):
    return rm.velocity_loss(reps(spark, sf)).select("set_id", "vendor", F.coalesce("velocity_loss", F.lit(0.0)).alias("velocity_loss"))


@query("a03_set_summary", """r as (select *, row_number() over (partition by set_id, vendor order by rep desc) as rd, count(*) over (partition by set_id, vendor) as n, max(value) over (partition by set_id, vendor) as best from reps)
    select set_id, vendor, max(n) as n_reps, round(case when max(n) >= 3 and max(best) > 0 then (max(best) - avg(case when rd <= 2 then value end)) / max(best) * 100 else 0 end, 6) + 0.0 as velocity_loss,
           cast(0.0 as double) as confidence from r group by set_id, vendor""", ("reps",))  # fmt: skip
def a03(spark, sf):
    return rm.set_summary(reps(spark, sf))


@query("a04_theil_sen", RANKED + ", " + SLOPES + " select g.set_id, g.vendor, round(slope, 6) + 0.0 as slope from groups g left join slopes s on g.set_id = s.set_id and g.vendor = s.vendor")
def a04(spark, sf):
    return rm.theil_sen(reps(spark, sf))


@query("a05_rmse_bias", RANKED + ", " + PAIRS + ", " + GATED + " select set_id, n_source, n_reference, round(rmse, 6) + 0.0 as rmse, round(bias, 6) + 0.0 as bias from gated")
def a05(spark, sf):
    return rm.rmse_bias(reps(spark, sf), "click", "view")


PANEL_SQL = RANKED + ", " + SLOPES + ", " + PAIRS + ", " + GATED + """
    select g.set_id, n_source, n_reference, round(rmse, 6) + 0.0 as rmse, round(bias, 6) + 0.0 as bias,
           round(ls.velocity_loss, 6) + 0.0 as vl_source, round(ss.slope, 6) + 0.0 as slope_source, round(lr.velocity_loss, 6) + 0.0 as vl_reference, round(sr.slope, 6) + 0.0 as slope_reference,
           n_source = n_reference and n_source > 0 as aligned, round(ls.velocity_loss - lr.velocity_loss, 6) + 0.0 as vl_delta, round(ss.slope - sr.slope, 6) + 0.0 as slope_delta
    from gated g left join loss ls on g.set_id = ls.set_id and ls.vendor = 'click' left join loss lr on g.set_id = lr.set_id and lr.vendor = 'view'
    left join slopes ss on g.set_id = ss.set_id and ss.vendor = 'click' left join slopes sr on g.set_id = sr.set_id and sr.vendor = 'view'"""


@query("a06_compare_panel", PANEL_SQL)
def a06(spark, sf):
    return rm.compare_panel(reps(spark, sf), "click", "view")


@query("a07_bland_altman", RANKED + ", " + PAIRS + f"""
    select set_id, count(*) as n, round(avg(source - reference), 6) + 0.0 as bias, round(sqrt(avg((source - reference) * (source - reference))), 6) + 0.0 as rmse, round({CORR.format(n=2, x='source', y='reference')}, 6) + 0.0 as r,
           round(avg(source - reference) - 1.96 * case when count(*) > 1 then stddev_samp(source - reference) end, 6) + 0.0 as loa_low, round(avg(source - reference) + 1.96 * case when count(*) > 1 then stddev_samp(source - reference) end, 6) + 0.0 as loa_high,
           round(case when stddev_pop(reference) > 0 then regr_slope(source, reference) end, 6) + 0.0 as slope, round(case when stddev_pop(reference) > 0 then regr_intercept(source, reference) end, 6) + 0.0 as intercept
    from paired where source is not null and reference is not null group by set_id""")  # fmt: skip
def a07(spark, sf):
    return rm.bland_altman(_pairs(spark, sf), ["set_id"])


@query("a08_vendor_summary", RANKED + """, stats as (select set_id, vendor, count(*) as n_reps, avg(value) as mean_value, max(value) as best, max(rep) as last_rep from usable group by set_id, vendor)
    select s.set_id, s.vendor, s.n_reps, round(mean_value, 6) as mean_value, round(s.best, 6) as best, last_rep, round(velocity_loss, 6) + 0.0 as velocity_loss from stats s join loss l on s.set_id = l.set_id and s.vendor = l.vendor""")
def a08(spark, sf):
    return rm.vendor_summary(reps(spark, sf))


COMMON = """v as (select set_id, count(distinct vendor) as vendors from usable group by set_id), h as (select set_id, rep, count(distinct vendor) as here from usable group by set_id, rep),
    common as (select u.* from usable u join v on u.set_id = v.set_id join h on u.set_id = h.set_id and u.rep = h.rep where vendors >= 2 and here = vendors)"""


@query("a09_common_window_loss", COMMON + """, r as (select *, row_number() over (partition by set_id, vendor order by rep desc) as rd, count(*) over (partition by set_id, vendor) as n, max(value) over (partition by set_id, vendor) as best from common)
    select set_id, vendor, max(n) as n_reps, round(max(best), 6) as best, round(case when max(n) >= 3 and max(best) > 0 then (max(best) - avg(case when rd <= 2 then value end)) / max(best) * 100 end, 6) + 0.0 as velocity_loss from r group by set_id, vendor""")
def a09(spark, sf):
    return rm.velocity_loss(rm.common_window(reps(spark, sf)))


@query("a10_agreement", f"""p as (select distinct set_id, vendor, {PREF} as k from usable), ref as (select set_id, vendor as reference from (select *, row_number() over (partition by set_id order by k) as r from p) where r = 1),
    e as (select u.set_id, u.rep, reference, u.value as expected from usable u join ref on u.set_id = ref.set_id and u.vendor = ref.reference)
    select u.set_id, u.vendor, e.reference, count(*) as n, round(avg(value - expected), 6) + 0.0 as bias, round(sqrt(avg((value - expected) * (value - expected))), 6) + 0.0 as rmse
    from usable u join e on u.set_id = e.set_id and u.rep = e.rep where u.vendor <> e.reference group by u.set_id, u.vendor, e.reference""")  # fmt: skip
def a10(spark, sf):
    return rm.agreement(reps(spark, sf), PREFERENCE)


@query("a11_rom_prior", """select lift, count(*) as n_reps, count(distinct u.set_id) as n_sets, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.75), 6) as q75,
    round(quantile_cont(value, 0.05), 6) as p05, round(quantile_cont(value, 0.95), 6) as p95 from usable u join sets s on u.set_id = s.set_id where value > 0 and lift is not null group by lift""", ("reps", "usable", "sets"))
def a11(spark, sf):
    return rm.rom_prior(reps(spark, sf).join(sets(spark, sf), "set_id", "left"))


@query("a12_table_stats", "select count(*) as n_rows, count(distinct vendor) as n_vendors, count(distinct set_id) as n_sets from reps", ("reps",))
def a12(spark, sf):
    return reps(spark, sf).agg(F.count("*").alias("n_rows"), F.countDistinct("vendor").alias("n_vendors"), F.countDistinct("set_id").alias("n_sets"))


@query("a13_counts_by_vendor", "select set_id, vendor, count(*) as n from reps where flag <> 'phantom' group by set_id, vendor", ("reps",))
def a13(spark, sf):
    return reps(spark, sf).where("flag <> 'phantom'").groupBy("set_id", "vendor").agg(F.count("*").alias("n"))


@query("a14_reference_counts", f"""c as (select set_id, vendor, count(*) as n, {PREF} as k from reps where flag <> 'phantom' group by set_id, vendor), r as (select *, row_number() over (partition by set_id order by k) as r from c)
    select set_id, max(case when r = 1 then vendor end) as gt_vendor, max(case when r = 1 then n end) as gt_count, max(case when r = 2 then vendor end) as rival, max(case when r = 2 then n end) as rival_count from r group by set_id""", ("reps",))
def a14(spark, sf):
    return rm.reference_counts(reps(spark, sf), PREFERENCE)


@query("a15_distinct_reps", "select set_id, nullif(count(distinct case when vendor = 'purchase' and flag <> 'phantom' then rep end), 0) as n from reps group by set_id", ("reps",))
def a15(spark, sf):
    return reps(spark, sf).groupBy("set_id").agg(F.nullif(F.countDistinct(F.when((F.col("vendor") == "purchase") & (F.col("flag") != "phantom"), F.col("rep"))), F.lit(0).cast("long")).alias("n"))


@query("a16_weighted_mean", """select vendor, round(sum(value * w) / sum(w), 6) as weighted, round(avg(value), 6) as plain from (select u.*, case lift when 'BUILDING' then 1.0 when 'MACHINERY' then 0.25 else 0.5 end as w
    from usable u join sets s on u.set_id = s.set_id) group by vendor""", ("reps", "usable", "sets"))
def a16(spark, sf):
    w = F.when(F.col("lift") == "BUILDING", 1.0).when(F.col("lift") == "MACHINERY", 0.25).otherwise(0.5)
    rows = reps(spark, sf).where(usable()).join(sets(spark, sf), "set_id")
    return rows.groupBy("vendor").agg(rm.weighted_mean(F.col("value"), w).alias("weighted"), F.avg("value").alias("plain"))


@query("a17_velocity_board", RANKED + """, m as (select set_id, vendor, avg(value) as m from usable group by set_id, vendor), b as (select l.set_id, l.vendor, velocity_loss, m from loss l join m on l.set_id = m.set_id and l.vendor = m.vendor)
    select s.set_id, round(abs(s.velocity_loss - r.velocity_loss), 6) as loss_error, round(abs(c.velocity_loss - r.velocity_loss), 6) as rival_loss_error, round(abs(s.m - r.m), 6) as mean_error, round(abs(c.m - r.m), 6) as rival_mean_error,
           case when c.m is null then abs(s.m - r.m) <= 5 else abs(s.m - r.m) <= least(abs(c.m - r.m), 5) end as wins
    from b s join b r on s.set_id = r.set_id and r.vendor = 'view' left join b c on s.set_id = c.set_id and c.vendor = 'purchase' where s.vendor = 'click'""")  # fmt: skip
def a17(spark, sf):
    return rm.velocity_board(reps(spark, sf), "click", "purchase", "view", target=5.0)


HEAD = RANKED + ", " + PAIRS + ", head as (select * from paired where source is not null and reference is not null)"


@query("a18_watch_board", HEAD + f""" select set_id, count(*) as n, round(sqrt(avg((source - reference) * (source - reference))), 6) as rmse, round(stddev_pop(source - reference), 6) as rmse_calibrated,
    round({CORR.format(n=3, x='source', y='reference')}, 6) + 0.0 as r, round(avg(source - reference), 6) + 0.0 as bias from head group by set_id""")
def a18(spark, sf):
    return rm.watch_board(rm.head_pairs(reps(spark, sf), "click", "view"))


@query("a18_watch_board_pooled", HEAD + """, d as (select lift, source - reference as d from head h join sets s on h.set_id = s.set_id), e as (select *, d - avg(d) over (partition by lift) as e from d)
    select lift, count(*) as n, round(sqrt(avg(d * d)), 6) as rmse, round(stddev_pop(d), 6) as rmse_calibrated, round(avg(d), 6) + 0.0 as bias from e group by lift
    union all select null, count(*), round(sqrt(avg(d * d)), 6), round(stddev_pop(e), 6), round(avg(d), 6) + 0.0 from e""", ("reps", "usable", "sets"))
def a18b(spark, sf):
    return rm.watch_board_pooled(rm.head_pairs(reps(spark, sf), "click", "view").join(sets(spark, sf), "set_id"))


@query("a19_count_board", HEAD + """, b as (select set_id, max(n_source) as n_found, max(n_reference) as n_true, avg(case when n_source = n_reference then source - reference end) as bias from paired group by set_id)
    select lift, count(*) as sets, round(avg(case when n_found = n_true then 1.0 else 0.0 end), 6) as exact, round(avg(cast(abs(n_found - n_true) as double)), 6) as mean_abs_delta, round(avg(bias), 6) + 0.0 as mean_bias
    from b join sets s on b.set_id = s.set_id group by lift""", ("reps", "usable", "sets"))  # fmt: skip
def a19(spark, sf):
    rows = rm.rmse_bias(reps(spark, sf), "click", "view").select("set_id", F.col("n_source").alias("n_found"), F.col("n_reference").alias("n_true"), "bias")
    return rm.count_board(rows.join(sets(spark, sf), "set_id"))


LOO = """i as (select lift, value from usable u join sets s on u.set_id = s.set_id), p as (select lift, sum(value) as s, count(value) as n from i group by lift),
    f as (select lift, (sum(s) over () - s) / (sum(n) over () - n) as others, sum(s) over () / sum(n) over () as everyone from p),
    o as (select i.lift, count(*) as n, avg(abs(value - others)) as blind, avg(abs(value - everyone)) as in_sample from i join f on i.lift = f.lift group by i.lift)"""


@query("a20_leave_one_out", LOO + " select lift, n, round(blind, 6) as blind, round(in_sample, 6) as in_sample from o", ("reps", "usable", "sets"))
def a20(spark, sf):
    return rm.leave_one_out(reps(spark, sf).where(usable()).join(sets(spark, sf), "set_id"), "lift")


@query("a20_leave_one_out_median", """o as (select g.user_id, median(e.value) as others from (select distinct user_id from events) g join events e on e.user_id <> g.user_id group by g.user_id)
    select e.user_id, count(value) as n, round(max(others), 6) as others, round(avg(abs(value - others)), 6) as blind from events e join o on e.user_id = o.user_id group by e.user_id""", ())
def a20b(spark, sf):
    """Every user's values against the median of all others'."""
    return rm.leave_one_out_median(read(spark, sf, "events").select("user_id", "value"), "user_id")


@query("a21_blind_delta", LOO + " select round(avg(blind) - avg(in_sample), 6) + 0.0 as delta, count(*) as n_groups from o", ("reps", "usable", "sets"))
def a21(spark, sf):
    return a20(spark, sf).agg((F.avg("blind") - F.avg("in_sample")).alias("delta"), F.count("*").alias("n_groups"))


@query("a26_cadence_regularity", """g as (select user_id as clip, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by user_id order by epoch_us(ts) / 1e6) as g from events)
    select clip, count(*) as n, round(case when count(*) >= 3 and count(case when g > 0 then 1 end) > 1 then 1 / (1 + stddev_pop(case when g > 0 then g end) / avg(case when g > 0 then g end)) else 0 end, 6) as regularity from g group by clip""", ("reps",))
def a26(spark, sf):
    rows = read(spark, sf, "events").select(F.col("user_id").alias("clip"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    return trajectories.regularity(rows)


@query("a27_robust_spans", """select set_id as clip, count(*) as n, round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 6) as xspan, round(quantile_cont(cast(rep as double), 0.95) - quantile_cont(cast(rep as double), 0.05), 6) as yspan from reps group by set_id""", ("reps",))
def a27(spark, sf):
    return trajectories.spans(reps(spark, sf).select(F.col("set_id").alias("clip"), F.col("value").alias("cx"), F.col("rep").cast("double").alias("cy")))


@query("a30_jitter_stability", """c as (select set_id as clip, n as count, count(*) as k from (select set_id, vendor, count(*) as n from reps group by set_id, vendor) group by set_id, n),
    b as (select *, row_number() over (partition by clip order by k desc, count) as r, sum(k) over (partition by clip) as runs from c)
    select clip, count as base_count, round(cast(k as double) / cast(runs as double), 6) as agreement, cast(k as double) / cast(runs as double) >= 0.6 as stable from b where r = 1""", ("reps",))  # fmt: skip
def a30(spark, sf):
    return trajectories.jitter_stability(reps(spark, sf).groupBy(F.col("set_id").alias("clip"), "vendor").agg(F.count("*").alias("count")).drop("vendor"))


@query("a31_scale_confidence", """s as (select set_id, stddev_pop(value) / avg(value) as cv, quantile_cont(value, 0.5) / 50 as mv from usable group by set_id)
    select set_id, round(case when mv > 1.6 then least(least(0.9, greatest(0.0, 1 - cv / 0.18 * 0.5)), 0.3) else least(0.9, greatest(0.0, 1 - cv / 0.18 * 0.5)) end, 6) as confidence, mv > 1.6 as suspect from s""")
def a31(spark, sf):
    rows = reps(spark, sf).where(usable()).groupBy("set_id").agg((F.stddev_pop("value") / F.avg("value")).alias("cv"), (F.percentile("value", 0.5) / 50).alias("mv"))
    value, suspect = trajectories.scale_check(F.lit(0.9), F.col("cv"), F.col("mv"), F.lit(True))
    return rows.select("set_id", value.alias("confidence"), suspect.alias("suspect"))


@query("a32_size_stats", "select set_id as clip, round(case when count(value) >= 3 then stddev_pop(value) / avg(value) end, 6) as size_cv, round(2 * quantile_cont(value, 0.5), 6) as target_px from usable group by set_id")
def a32(spark, sf):
    return trajectories.size_stats(reps(spark, sf).where(usable()).select(F.col("set_id").alias("clip"), F.col("value").alias("r")))


@query("a33_windowed_rms", """w as (select u.set_id, u.rep, u.value as v, s.set_id as k, s.load_kg from usable u join sets s on u.set_id = s.set_id where u.vendor = 'view')
    select a.set_id, a.rep, round(sqrt(avg(b.value * b.value)), 6) as rms from w a join usable b on a.set_id = b.set_id and b.rep >= a.rep and b.rep < a.rep + 3 group by a.set_id, a.rep""", ("reps", "usable", "sets"))
def a33(spark, sf):
    good = reps(spark, sf).where(usable())
    windows = good.where("vendor = 'view'").join(sets(spark, sf), "set_id").select("set_id", F.col("rep").alias("first"))
    near = windows.join(good, "set_id").where((F.col("rep") >= F.col("first")) & (F.col("rep") < F.col("first") + 3))
    return near.groupBy("set_id", F.col("first").alias("rep")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


@query("a34_merged_legs", """l as (select set_id as clip, vendor, count(*) as n, avg(value) as c, max(value) as t, min(value) as s from reps group by set_id, vendor)
    select clip, cast(sum(n) as bigint) as n, round(sum(c * n) / sum(n), 6) as confidence, round(sum(t * n) / sum(n), 6) as target_px, round(max(s), 6) as size_cv from l group by clip""", ("reps",))
def a34(spark, sf):
    legs = reps(spark, sf).groupBy(F.col("set_id").alias("clip"), "vendor").agg(F.count("*").alias("n"), F.avg("value").alias("confidence"), F.max("value").alias("target_px"), F.min("value").alias("size_cv"))
    return trajectories.merged_legs(legs)


@query("a35_noise_weighted_fusion", RANKED + ", " + PAIRS + """, p as (select * from paired where n_source = n_reference and n_source >= 3),
    z as (select *, (reference - avg(reference) over w) / (stddev_pop(reference) over w + 1e-9) * stddev_pop(source) over w + avg(source) over w as b from p window w as (partition by set_id)),
    s as (select *, source - lag(source) over (partition by set_id order by pos) as da, b - lag(b) over (partition by set_id order by pos) as db from z),
    k as (select *, 1 / (var_pop(da) over (partition by set_id) + 1e-9) as wa, 1 / (var_pop(db) over (partition by set_id) + 1e-9) as wb from s)
    select set_id, pos, round((source * wa + b * wb) / (wa + wb), 6) + 0.0 as fused from k""")  # fmt: skip
def a35(spark, sf):
    return rm.noise_fused(reps(spark, sf), "click", "view")


@query("a36_guarded_pearson", HEAD + f" select set_id, round({CORR.format(n=8, x='source', y='reference')}, 6) + 0.0 as r from head group by set_id")
def a36(spark, sf):
    pairs = rm.head_pairs(reps(spark, sf), "click", "view")
    return pairs.groupBy("set_id").agg(rm.guarded_corr(F.col("source"), F.col("reference"), 8).alias("r"))


@query("a37_provenance_board", """c as (select *, case when set_id % 5 = 0 then 'ORACLE' when set_id % 3 = 0 then 'SIMULATED_TAP' else 'SEED_FREE' end as provenance, case vendor when 'view' then 1.0 when 'error' then 0.25 else 0.5 end as w from usable)
    select provenance, count(*) as n, round(sum(value * w) / sum(w), 6) as weighted, round(avg(value), 6) as plain from c group by provenance""")
def a37(spark, sf):
    k = F.col("set_id")
    kind = provenance(k % 3 == 0, F.lit(False), k % 5 == 0, F.lit(False))
    code = F.when(F.col("vendor") == "view", "SQ").when(F.col("vendor") == "error", "SC").otherwise("ROW")
    rows = reps(spark, sf).where(usable()).withColumn("provenance", kind)
    return rows.groupBy("provenance").agg(F.count("*").alias("n"), rm.weighted_mean(F.col("value"), lift_weight(code)).alias("weighted"), F.avg("value").alias("plain"))


@query("a38_board_cells", "select set_id, vendor, concat(count(*), '·', cast(cast(round(avg(value) + 1e-9) as bigint) as varchar)) as cell from reps where flag <> 'phantom' group by set_id, vendor", ("reps",))
def a38(spark, sf):
    return rm.board_cells(reps(spark, sf), places=0)


@query("a39_gate_flip_audit", RANKED + """, a as (select set_id, count(case when vendor = 'click' then 1 end) as n_new, count(case when vendor = 'view' then 1 end) as n_old, count(case when vendor = 'purchase' then 1 end) as n_true from usable group by set_id)
    select set_id, n_old, n_new, n_true, abs(n_new - n_true) > abs(n_old - n_true) as regression from a""")
def a39(spark, sf):
    n = lambda v: F.count(F.when(F.col("vendor") == v, 1))
    rows = reps(spark, sf).where(usable()).groupBy("set_id").agg(n("view").alias("n_old"), n("click").alias("n_new"), n("purchase").alias("n_true"))
    return rows.withColumn("regression", F.abs(F.col("n_new") - F.col("n_true")) > F.abs(F.col("n_old") - F.col("n_true")))


@query("a42_pivot_loss", RANKED + " select set_id, round(velocity_loss, 6) + 0.0 as velocity_loss from loss where vendor = 'view'")
def a42(spark, sf):
    wide = rm.pivot_reps(reps(spark, sf), ["view"]).select("set_id", F.lit("view").alias("vendor"), "rep", F.col("view").alias("value"), F.lit("").alias("flag"))
    every = reps(spark, sf).where("vendor = 'view'").select("set_id").distinct()
    return every.join(rm.velocity_loss(wide).select("set_id", "velocity_loss"), "set_id", "left")


@query("u01_union_rows", "select set_id, vendor, rep from reps where vendor = 'view' union all select set_id, vendor, rep from reps where vendor = 'click'", ("reps",))
def u01(spark, sf):
    rows = reps(spark, sf).select("set_id", "vendor", "rep")
    return rows.where("vendor = 'view'").unionByName(rows.where("vendor = 'click'"))


@query("u02_common_reps", "select distinct a.set_id, a.rep from reps a join reps b on a.set_id = b.set_id and a.rep = b.rep where a.vendor = 'view' and b.vendor = 'click'", ("reps",))
def u02(spark, sf):
    rows = reps(spark, sf)
    return rows.where("vendor = 'view'").select("set_id", "rep").intersect(rows.where("vendor = 'click'").select("set_id", "rep"))


@query("u03_missing_sets", "select c_custkey as set_id from customer where c_custkey not in (select user_id from events)", ("reps",))
def u03(spark, sf):
    return sets(spark, sf).select("set_id").exceptAll(reps(spark, sf).select("set_id").distinct())


@query("u04_distinct_vendors", "select distinct vendor, flag from reps", ("reps",))
def u04(spark, sf):
    return reps(spark, sf).select("vendor", "flag").distinct()


@query("u05_keep_first", "select set_id, vendor, flag, min(rep) as rep from reps group by set_id, vendor, flag", ("reps",))
def u05(spark, sf):
    return tables.keep_first(reps(spark, sf), ["set_id", "vendor", "flag"], ["rep"]).select("set_id", "vendor", "flag", "rep")
