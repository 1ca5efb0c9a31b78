"""Column functions on the adapter views (survey sections 2.1, 2.2 and 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import trajectories
from ..sources import recordings
from ..views import read, reps, sets
from .registry import query

NONE = ()


@query("p01_vertical_acceleration", """select l_orderkey, l_partkey, round(avg(-(l_quantity * l_discount + l_extendedprice * l_tax) / sqrt(case when l_discount * l_discount + l_tax * l_tax = 0 then 1 else l_discount * l_discount + l_tax * l_tax end) * 9.80665), 3) + 0.0 as a
    from (select l_orderkey, l_partkey, cast(l_quantity as double) as l_quantity, cast(l_extendedprice as double) as l_extendedprice, cast(l_discount as double) as l_discount, cast(l_tax as double) as l_tax from lineitem) group by l_orderkey, l_partkey""", NONE)
def p01(spark, sf):
    d = lambda c: F.col(c).cast("double")
    rows = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", d("l_quantity").alias("ua_x"), d("l_extendedprice").alias("ua_y"), F.lit(0.0).alias("ua_z"), d("l_discount").alias("g_x"), d("l_tax").alias("g_y"), F.lit(0.0).alias("g_z")
    )
    return rows.groupBy("l_orderkey", "l_partkey").agg(F.round(F.avg(fn.vertical_acceleration()), 3).alias("a"))


@query("p02_usable", "select set_id, vendor, rep, round(value, 6) as value from usable")
def p02(spark, sf):
    return reps(spark, sf).where(fn.usable()).select("set_id", "vendor", "rep", "value")


@query("p03_aligned_rows", "select set_id, vendor, rep, case when flag = 'partial_rom' then 'kept' when flag = '' then 'plain' else 'excluded' end as state from reps", ("reps",))
def p03(spark, sf):
    state = F.when(F.col("flag") == "partial_rom", "kept").when(fn.usable(), "plain").otherwise("excluded")
    return reps(spark, sf).select("set_id", "vendor", "rep", state.alias("state"))


@query("p04_lift_code", "select c_custkey as k, upper(substr(c_mktsegment, 1, 3)) as code from customer", NONE)
def p04(spark, sf):
    name = F.concat(F.lit("20260615-"), F.upper(F.substring("c_mktsegment", 1, 3)), F.lit("-"), F.col("c_custkey").cast("string"))
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), fn.lift_code(name).alias("code"))


@query("p05_lift_weight", "select code, count(*) as n, max(case code when 'SQ' then cast(1 as double) when 'SC' then cast(0.25 as double) else cast(0.5 as double) end) as weight from (select case c_mktsegment when 'BUILDING' then 'SQ' when 'MACHINERY' then 'SC' when 'FURNITURE' then 'RDL' else 'other' end as code from customer) group by code", NONE)
def p05(spark, sf):
    m = F.col("c_mktsegment")
    code = F.when(m == "BUILDING", "SQ").when(m == "MACHINERY", "SC").when(m == "FURNITURE", "RDL").otherwise("other")
    rows = read(spark, sf, "customer").select(code.alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.max(fn.lift_weight(F.col("code"))).alias("weight"))


@query("p06_provenance", "select p, count(*) as n from (select case when k % 5 = 0 or k % 7 = 0 then 'ORACLE' when k % 2 = 0 or k % 3 = 0 then 'SIMULATED_TAP' else 'SEED_FREE' end as p from (select c_custkey as k from customer)) group by p", NONE)
def p06(spark, sf):
    k = F.col("c_custkey")
    return read(spark, sf, "customer").groupBy(fn.provenance(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("p")).agg(F.count("*").alias("n"))


@query("p07_plate_diameter", """select q, cast(case when q / 2.2046226 >= 9.5 then 0.45 else 0.3 end as double) as bumper, cast(case when q / 2.2046226 >= 9.5 then 0.95 else 0.6 end as double) as confidence,
    (select first(m::double order by abs(k - q), n) from (values (45.0, 1, 0.45), (35.0, 2, 0.415), (25.0, 3, 0.39), (10.0, 4, 0.25), (5.0, 5, 0.205), (2.5, 6, 0.16)) p(k, n, m)) as iron from (select distinct cast(l_quantity as double) as q from lineitem)""", NONE)
def p07(spark, sf):
    q = F.col("l_quantity").cast("double")
    rows = read(spark, sf, "lineitem").select(q.alias("q")).distinct()
    b = fn.plate_diameter(F.col("q"), F.lit("bumper"), F.lit("lb"))
    return rows.select("q", b["m"].alias("bumper"), b["confidence"].alias("confidence"), fn.plate_diameter(F.col("q"), F.lit("iron"), F.lit("lb"))["m"].alias("iron"))


@query("p08_scale_confidence", "select angle, count(*) as n, max(cast(case angle when 'side' then 0.95 when 'diagonal' then 0.665 when 'front' then 0.0 end as double)) as confidence from (select case c_nationkey % 4 when 0 then 'side' when 1 then 'diagonal' when 2 then 'front' else 'above' end as angle from customer) group by angle", NONE)
def p08(spark, sf):
    k = F.col("c_nationkey") % 4
    angle = F.when(k == 0, "side").when(k == 1, "diagonal").when(k == 2, "front").otherwise("above")
    rows = read(spark, sf, "customer").select(angle.alias("angle"))
    return rows.groupBy("angle").agg(F.count("*").alias("n"), F.max(fn.scale_confidence(F.lit(45.0), F.lit("bumper"), F.lit("lb"), F.col("angle"))).alias("confidence"))


@query("p09_metres_per_pixel", "select c_custkey as k, round(case when c_acctbal > 0 then 0.45 / c_acctbal end, 6) as plate, round(case when c_acctbal > 0 then 1.8 * 0.146 / c_acctbal end, 6) as forearm from customer", NONE)
def p09(spark, sf):
    px = F.col("c_acctbal").cast("double")
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), fn.metres_per_pixel(F.lit(0.45), px).alias("plate"), fn.segment_metres_per_pixel(F.lit(1.8), "forearm", px).alias("forearm"))


@query("p10_is_4k", "select p_partkey as k, case when p_size % 3 = 0 then false else p_size * 100 >= 2560 end as uhd from part", NONE)
def p10(spark, sf):
    size = F.when(F.col("p_size") % 3 == 0, "unknown").otherwise(F.concat((F.col("p_size") * 100).cast("string"), F.lit("x"), F.col("p_size").cast("string")))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("k"), fn.is_4k(size).alias("uhd"))


@query("p11_regime_hint", """r as (select set_id, vendor, value / 100 as v, row_number() over (partition by set_id, vendor order by value) as r from usable), g as (select set_id, vendor, count(*) as n, max(v) as top, sum(case when r <= 2 then v end) / 2 as low from r group by set_id, vendor)
    select set_id, vendor, case when n >= 3 and top > 0.7 and (top - low) / top < 0.10 then 'speed_work?' when n >= 3 and top > 0 and (top - low) / top > 0.15 then 'normal?' else '' end as regime from g""")
def p11(spark, sf):
    rows = reps(spark, sf).where(fn.usable()).groupBy("set_id", "vendor").agg(F.collect_list(F.col("value") / 100).alias("v"))
    return rows.select("set_id", "vendor", fn.regime_hint(F.col("v")).alias("regime"))


@query("p12_loss_label", "select set_id, vendor, case when count(*) <= 2 then concat('best→rep', count(*)) else concat('best→mean(rep', count(*) - 1, '–', count(*), ')') end as label from usable group by set_id, vendor")
def p12(spark, sf):
    rows = reps(spark, sf).where(fn.usable()).groupBy("set_id", "vendor").agg(F.count("*").alias("n"))
    return rows.select("set_id", "vendor", fn.loss_window_label(F.col("n")).alias("label"))


@query("p13_header_match", "select p_partkey as k, lower(p_type) like '%steel%' and lower(p_type) like '%plated%' as hit, 'm/s' as unit from part", NONE)
def p13(spark, sf):
    header = F.concat(F.col("p_type"), F.lit(" (vertical, M/S)"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("k"), fn.header_has(header, "Steel", "plated").alias("hit"), fn.unit_in_header(header).alias("unit"))


@query("p15_band_flag", "b as (select lift, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.95) as hi from usable u join sets s on u.set_id = s.set_id group by lift) select u.set_id, u.vendor, u.rep, not (value >= lo and value <= hi) as rom_outlier from usable u join sets s on u.set_id = s.set_id join b on s.lift = b.lift", ("reps", "usable", "sets"))
def p15(spark, sf):
    rows = reps(spark, sf).where(fn.usable()).join(sets(spark, sf), "set_id").withColumnRenamed("value", "rom")
    band = rows.groupBy("lift").agg(F.percentile("rom", F.array(F.lit(0.05), F.lit(0.95))).alias("q")).select("lift", F.col("q")[0].alias("lo_cm"), F.col("q")[1].alias("hi_cm"))
    return trajectories.band_flag(rows, band).select("set_id", "vendor", "rep", "rom_outlier")


@query("p16_static_suspect", "select set_id as clip, max(value) - min(value) < 0.30 * 300 as static_suspect from reps group by set_id", ("reps",))
def p16(spark, sf):
    return trajectories.static_suspect(reps(spark, sf).select(F.col("set_id").alias("clip"), F.col("value").alias("cy"), F.lit(300.0).alias("target_px"), F.lit(0.9).alias("confidence")))


@query("p17_units", "select o_orderkey as k, round(o_totalprice * 100, 6) as cm, round(o_totalprice / 1000, 6) as s, round(o_totalprice / 0.45359, 4) as lb from orders", NONE)
def p17(spark, sf):
    x = F.col("o_totalprice").cast("double")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), fn.metres_to_cm(x).alias("cm"), fn.ms_to_s(x).alias("s"), F.round(fn.kg_to_lb(x), 4).alias("lb"))


@query("p18_effective_lift_code", "select c_custkey as k, case when c_custkey % 2 = 0 and c_custkey % 3 <> 0 then upper(substr(c_mktsegment, 1, 2)) when c_custkey % 2 = 0 then 'OTHER' else 'SQ' end as code from customer", NONE)
def p18(spark, sf):
    k = F.col("c_custkey")
    custom = F.when(k % 3 == 0, " ").otherwise(F.lower(F.substring("c_mktsegment", 1, 2)))
    return read(spark, sf, "customer").select(k.alias("k"), fn.effective_lift_code(F.when(k % 2 == 0, "OTHER").otherwise("SQ"), custom).alias("code"))


@query("s09_file_stems", "select o_orderkey as k, concat(strftime(o_orderdate, '%Y%m%d'), '-SQ-', o_orderkey % 7 + 1, '_watch') as watch, concat(strftime(o_orderdate, '%Y%m%d'), '-workout_hr', case when o_orderkey % 3 > 0 then concat('-', o_orderkey % 3 + 1) else '' end) as heart from orders", NONE)
def s09(spark, sf):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return read(spark, sf, "orders").select(k.alias("k"), fn.watch_stem(day, F.lit("SQ"), k % 7 + 1).alias("watch"), fn.heart_rate_stem(day, k % 3 + 1).alias("heart"))


@query("s10_watch_files", "select c_custkey as k, case when c_custkey % 4 = 3 then null else concat('20260615-SQ-', c_custkey) end as set_id, case when c_custkey % 4 = 3 then null when c_custkey % 4 = 1 then 'watch_bar' else 'watch_imu' end as vendor from customer", NONE)
def s10(spark, sf):
    k = F.col("c_custkey")
    tail = F.when(k % 4 == 3, "_video.mov").when(k % 4 == 1, "_watch_bar.csv").otherwise("_watch.csv")
    f = fn.watch_file(F.concat(F.lit("20260615-SQ-"), k.cast("string"), tail))
    return read(spark, sf, "customer").select(k.alias("k"), f["set_id"].alias("set_id"), f["vendor"].alias("vendor"))


@query("s11_infer_set_id", "select c_custkey as k, case c_custkey % 4 when 0 then concat('20260615-SQ-', c_custkey) when 1 then concat('20260615b-ROW-', c_custkey) when 2 then concat('20260701-SQ-MM-', c_custkey) else '' end as set_id from customer", NONE)
def s11(spark, sf):
    k = F.col("c_custkey")
    n = k.cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("20260615-SQ-"), n, F.lit("_side.mov"))).when(k % 4 == 1, F.concat(F.lit("20260615b-ROW-"), n, F.lit(".mp4"))).when(k % 4 == 2, F.concat(F.lit("20260701-SQ-MM-"), n, F.lit(".mov"))).otherwise(F.concat(F.lit("clip"), n))
    return read(spark, sf, "customer").select(k.alias("k"), fn.infer_set_id(name).alias("set_id"))


@query("s02_has_gyro", "select l_orderkey as recording_id, max(case when l_discount <> 0 or l_tax <> 0 then 1 else 0 end) = 1 as has_gyro from lineitem group by l_orderkey", NONE)
def s02(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("recording_id"), F.col("l_discount").alias("rr_x"), F.col("l_tax").alias("rr_y"), F.lit(0).alias("rr_z"))
    return recordings.has_gyro(rows)


@query("s04_synthetic_set", """p as (select user_id as recording_id, 1 + count(*) % 4 as n_reps, 0.3 + max(value) / 100 as peak, 1.5 + (count(*) % 3) / 2.0 as period from events where value is not null group by user_id),
    t as (select *, i / 20.0 as t from (select *, unnest(range(cast(floor(n_reps * period * 20 + 1e-9) as bigint) + 1)) as i from p))
    select recording_id, round(t, 6) as t, round(peak * 2 * pi() / period * cos(2 * pi() / period * t) / 9.80665, 6) + 0.0 as ua_z from t""", NONE)
def s04(spark, sf):
    """A recording for each user, whose peak, period and number of reps its events give."""
    n = F.count("*")
    sets = read(spark, sf, "events").where("value is not null").groupBy(F.col("user_id").alias("recording_id")).agg(
        (1 + n % 4).alias("n_reps"), (0.3 + F.max("value") / 100).alias("peak"), (1.5 + (n % 3) / 2.0).alias("period"), F.lit(20.0).alias("fs")
    )
    return recordings.synthetic_sets(sets).select("recording_id", "t", "ua_z")
