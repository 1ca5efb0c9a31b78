"""Signal and trajectory operators (survey sections 2.9 and 2.10), over series and tracks made of the tables' events.

Grouped maps of signal steps have no SQL; tests hold them against closed forms. What is joins, windows and aggregates has.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.signal import butterworth2
from ..operators import estimates, filters
from ..operators import recordings as rec
from ..operators import repmetrics as rm
from ..operators import trajectories as traj
from ..views import moves, read, reps, series, tracks
from .registry import query

NONE: tuple[str, ...] = ()


def _rated(spark, sf):
    return series(spark, sf).withColumn("t", F.col("i") / F.lit(50.0))


def _detections(spark, sf):
    """Three detections a frame: the lift, a plate at rest that the values jitter, and one that crosses the picture."""
    rows, k = tracks(spark, sf), F.col("i")
    found = F.array(
        F.struct(F.col("cx"), F.col("cy"), (45 + (F.col("cx") - 320) / 10).alias("r")),
        F.struct((480 + (F.col("cx") - 320) * 2).alias("cx"), F.lit(390.0).alias("cy"), F.lit(42.0).alias("r")),
        F.struct((60 + 8.0 * (k % 90)).alias("cx"), (340 + F.col("cx") - 320).alias("cy"), F.lit(36.0).alias("r")),
    )
    return rows.select("clip", k.cast("int").alias("frame"), "t", F.inline(found))


def _filter_sql(hz: float, fs: float, kind: str) -> str:
    """The filter sample by sample, forwards and backwards over an odd extension of nine samples."""
    (b0, b1, b2), (_, a1, a2) = (list(map(float, c)) for c in butterworth2(hz, fs, kind))
    rest = (b0 + b1 + b2) / (1 + a1 + a2)

    def way(source: str) -> str:
        step = lambda x, s1, s2: f"{b0!r} * {x} + {s1} as y, {b1!r} * {x} - {a1!r} * ({b0!r} * {x} + {s1}) + {s2} as s1, {b2!r} * {x} - {a2!r} * ({b0!r} * {x} + {s1}) as s2"
        first = f"({b1 - a1 * rest + b2 - a2 * rest!r} * x)", f"({b2 - a2 * rest!r} * x)"
        return f"""with recursive w as (select recording_id, i, {step("x", *first)} from {source} where i = 0
            union all select e.recording_id, e.i, {step("e.x", "w.s1", "w.s2")} from w join {source} e on e.recording_id = w.recording_id and e.i = w.i + 1) select recording_id, i, y from w"""

    return f"""n as (select *, count(*) over (partition by recording_id) as n, first_value(a) over (partition by recording_id order by i) as x0, first_value(a) over (partition by recording_id order by i desc) as x1 from series),
    p as (select *, least(9, n - 1) as pad from n),
    e as (select recording_id, i + pad as i, a as x, n + 2 * pad as m from p union all select recording_id, pad - i, 2 * x0 - a, n + 2 * pad from p where i between 1 and pad
          union all select recording_id, 2 * (n - 1) - i + pad, 2 * x1 - a, n + 2 * pad from p where i between n - 1 - pad and n - 2),
    f as ({way("e")}), r as (select f.recording_id, m - 1 - f.i as i, f.y as x from f join e on e.recording_id = f.recording_id and e.i = f.i), g as ({way("r")})
    select p.recording_id, p.i, round(case when n > 1 then g.y else a end, 6) as a from p join g on g.recording_id = p.recording_id and g.i = n + 2 * pad - 1 - (p.i + pad)"""


@query("d01_high_pass", _filter_sql(0.5, 50.0, "high"), ("series",))
def d01(spark, sf):
    """Recordings filtered in blocks of 64 samples, as tasks share a long one."""
    return filters.zero_phase(series(spark, sf), 0.5, 50.0, "high", block=64)


PEAKS = """x as (select recording_id, i, a from series), f as (select *, case when a = lag(a) over (partition by recording_id order by i) then 0 else 1 end as new from x),
    e as (select *, sum(new) over (partition by recording_id order by i) as run from f), l as (select recording_id, run, max(a) as a, (min(i) + max(i)) // 2 as i from e group by recording_id, run),
    m as (select *, lag(a) over (partition by recording_id order by run) as b, lead(a) over (partition by recording_id order by run) as c from l),
    k as (select recording_id, i, a, row_number() over (partition by recording_id order by a desc, i desc) as k from m where a > b and a > c),
    s as (with recursive w as (select distinct recording_id, 0 as k, []::bigint[] as kept from k
          union all select w.recording_id, k.k, case when len(list_filter(kept, lambda q: abs(q - k.i) < 4)) = 0 then list_append(kept, k.i) else kept end from w join k on k.recording_id = w.recording_id and k.k = w.k + 1)
          select recording_id, unnest(arg_max(kept, k)) as i from w group by recording_id),
    t as (select s.recording_id, s.i, x.a from s join x on x.recording_id = s.recording_id and x.i = s.i),
    h as (select t.recording_id, t.i, t.a, max(case when o.i < t.i then o.i end) as l, min(case when o.i > t.i then o.i end) as r from t left join x o on o.recording_id = t.recording_id and o.a > t.a group by t.recording_id, t.i, t.a),
    p as (select h.recording_id, h.i, h.a, h.a - greatest(min(case when o.i <= h.i and o.i > coalesce(h.l, -1) then o.a end), min(case when o.i >= h.i and o.i < coalesce(h.r, 1e18) then o.a end)) as prominence
          from h join x o on o.recording_id = h.recording_id group by h.recording_id, h.i, h.a)
    select recording_id, i, round(a, 6) as a, round(prominence, 6) as prominence from p where prominence >= 20 - 1e-9"""


@query("d02_peaks", PEAKS, ("series",))
def d02(spark, sf):
    return rec.find_peaks(series(spark, sf), 4, 20.0)


@query("d04_turnarounds")
def d04(spark, sf):
    return rec.find_turnarounds(_rated(spark, sf))


@query("d07_wave_excursions")
def d07(spark, sf):
    return rec.wave_excursions(_rated(spark, sf).withColumnRenamed("a", "pos"), cadence=0.1)


@query("d09_wave_reps")
def d09(spark, sf):
    return rec.wave_segments(moves(spark, sf))


@query("d10_velocity_log_reps")
def d10(spark, sf):
    """The values are accelerations, their running sum the velocity."""
    v = 0.005 * F.sum("a").over(Window.partitionBy("recording_id").orderBy("i"))
    rows = series(spark, sf).select("recording_id", (F.col("i") / F.lit(20.0)).alias("t"), v.alias("v"), F.lit(None).cast("double").alias("disp_cm"), F.col("a").alias("acc"))
    return rec.velocity_logs(rows)


@query("d16_trajectory_reps")
def d16(spark, sf):
    return traj.trajectory_reps(tracks(spark, sf), gate="relative", plausible=True)


@query("d18_bilateral_reps")
def d18(spark, sf):
    sides = F.explode(F.array(F.lit(1), F.lit(2)))
    rows = tracks(spark, sf).where("t is not null").select("clip", sides.alias("side"), "t", "cx", "cy", "target_px", F.lit(None).cast("double").alias("d"), F.lit(0.45).alias("plate_m"), F.lit(800.0).alias("frame_h"))
    return traj.bilateral_reps(rows)


@query("d19_cycle_reps")
def d19(spark, sf):
    rows = moves(spark, sf).select("recording_id", "t", (-F.col("a")).alias("pos"), F.col("a").alias("v"))
    return rec.cycles(rows, counts=rows.select("recording_id").distinct().select("recording_id", F.when(F.col("recording_id") % 2 == 0, 3).alias("count")))


@query("d20_cross_correlation")
def d20(spark, sf):
    """Recordings and clips meet within sessions of ten users."""
    session = lambda c: (F.col(c) / 10).cast("long").alias("session")
    left = moves(spark, sf).select("recording_id", session("recording_id"), "t", F.col("a").alias("y"))
    right = tracks(spark, sf).select("clip", session("clip"), "t", F.col("cy").alias("y"))
    return rec.align_all(left, right, 20.0, "session").where("r is not null")


SCALES = """t as (select c_custkey as k, case when c_custkey % 3 <> 0 then 60 + c_custkey % 50 end::double as target_px, case when c_custkey % 4 = 0 then 0.45 end::double as spec_m, 0.95::double as spec_confidence,
    case c_nationkey % 3 when 0 then true when 1 then false end as angle_valid, case when c_custkey % 5 = 0 then 88.0 end::double as rim_px, c_custkey % 7 = 0 as body, case when c_custkey % 2 = 0 then 70.0 end::double as segment_px, 1.8::double as height_m, 0.8::double as segment_confidence from customer),
    s as (select *, (body or not coalesce(angle_valid, true)) and coalesce(segment_px, 0) > 0 as seen, coalesce(rim_px, 0) > 0 as rim from t)
    select k, round(case when seen then 1.8 * 0.146 / segment_px when rim then coalesce(spec_m, 0.45) / rim_px when target_px > 0 then coalesce(spec_m, 0.45) / target_px end, 6) as m_per_px,
           case when seen then 'anthro' when rim then 'rim_confirmed' when spec_m is not null then 'plate_spec' else 'implement' end as scale_source,
           round(case when seen then segment_confidence when rim then greatest(coalesce(case when spec_m is not null then spec_confidence end, 0.9), 0.9) when spec_m is not null then spec_confidence end, 6) as scale_confidence from s"""


@query("d21_resolved_scale", SCALES, NONE)
def d21(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 3
    rows = read(spark, sf, "customer").select(
        k.alias("k"), F.when(k % 3 != 0, (60 + k % 50).cast("double")).alias("target_px"), F.when(k % 4 == 0, F.lit(0.45)).alias("spec_m"), F.lit(0.95).alias("spec_confidence"),
        F.when(n == 0, True).when(n == 1, False).alias("angle_valid"), F.when(k % 5 == 0, F.lit(88.0)).alias("rim_px"), (k % 7 == 0).alias("body"), F.when(k % 2 == 0, F.lit(70.0)).alias("segment_px"),
        F.lit(1.8).alias("height_m"), F.lit("forearm").alias("segment"), F.lit(0.8).alias("segment_confidence"),
    )
    return estimates.resolved_scale(rows).select("k", "m_per_px", "scale_source", "scale_confidence")


@query("d21_depth_positions")
def d21b(spark, sf):
    d = F.when(F.col("i") % 4 != 3, 90 + F.col("cy") / 100)
    rows = tracks(spark, sf).select("clip", "t", "cy", d.alias("d"), F.lit(92.0).alias("rim_px"), F.lit(None).cast("double").alias("rim_t"), F.lit(0.45).alias("plate_m"), F.lit(800.0).alias("frame_h"))
    return estimates.depth_positions(rows)


@query("d22_linked_tracks")
def d22(spark, sf):
    return traj.oscillation(traj.link_tracks(_detections(spark, sf))).drop("n")


@query("d22_auto_counts")
def d22b(spark, sf):
    found = estimates.auto_counts(_detections(spark, sf))
    return found.groupBy("clip").agg(F.count("*").alias("n"), F.avg("mean_velocity").alias("mean_velocity"))


@query("d23_lift_windows", """r as (select set_id, vendor, rep, value / 200 as rom, value / 100 as mean_velocity, case set_id % 4 when 0 then 'row' when 1 then 'bench' when 2 then 'rdl' else 'press' end as lift from usable where vendor = 'view')
    select set_id as recording_id, lift, row_number() over (partition by set_id order by rep) - 1 as rep, round(rom, 6) as rom from r
    where case lift when 'row' then rom between 0.35 and 0.90 and mean_velocity > 0.35 when 'bench' then rom between 0.20 and 0.55 and mean_velocity > 0.12 when 'rdl' then rom between 0.40 and 0.70 and mean_velocity > 0.10 else true end""")
def d23(spark, sf):
    k = F.col("set_id") % 4
    lift = F.when(k == 0, "row").when(k == 1, "bench").when(k == 2, "rdl").otherwise("press")
    rows = rm.numbered(reps(spark, sf).where("vendor = 'view'")).select(F.col("set_id").alias("recording_id"), lift.alias("lift"), F.col("rep").cast("double").alias("start"), (F.col("value") / 200).alias("rom"), (F.col("value") / 100).alias("mean_velocity"))
    return estimates.lift_gate(rows).select("recording_id", "lift", "rep", "rom")


@query("d24_session_chain")
def d24(spark, sf):
    return rec.chain_segments(moves(spark, sf))


HONEST = """nn as (select *, count(*) over (partition by clip) as n, i - (count(*) over (partition by clip) - 1) / 2.0 as x from tracks), f as (select clip, sum(x * cy) / sum(x * x) as b, avg(cy) as m from nn group by clip having count(*) >= 8),
    d as (select nn.clip, nn.i, nn.n, cy - m - b * x as y from nn join f on nn.clip = f.clip), p as (select clip, sum(y * y) as p from d group by clip),
    r as (select u.clip, v.i - u.i as lag, sum(u.y * v.y) / max(p.p) as r from d u join d v on u.clip = v.clip and v.i - u.i between 3 and greatest(3, floor(u.n / 2)) join p on u.clip = p.clip group by u.clip, v.i - u.i),
    w as (select * from (select *, row_number() over (partition by clip order by r desc, lag) as k from r) where k = 1),
    s as (select clip, count(*) as n, quantile_cont(cx, 0.95) - quantile_cont(cx, 0.05) as xs, quantile_cont(cy, 0.95) - quantile_cont(cy, 0.05) as ys from tracks group by clip),
    h as (select s.clip, case when n >= 3 then ys / (xs + 1e-9) else 0 end as vd, greatest(coalesce(r, 0), 0) as pe, coalesce(lag, 0) as pl, case when n >= 3 then ys / 90 else 0 end as mo from s left join w on s.clip = w.clip)
    select clip, round(vd, 6) as vertical_dominance, round(pe, 6) as periodicity, pl as period_lag, round(mo, 6) as motion,
           concat_ws('|', case when vd < 1.2 then 'not_vertical_dominant' end, case when pe < 0.30 then 'aperiodic' end, case when mo < 0.30 then 'static_track' end) as flags, vd >= 1.2 and pe >= 0.30 and mo >= 0.30 as honest from h"""


@query("a29_track_honesty", HONEST, ("series", "tracks"))
def a29(spark, sf):
    return traj.honesty(tracks(spark, sf)).withColumn("flags", F.concat_ws("|", "flags"))


@query("s29_label_boxes", """b as (select clip, i, least(greatest(cx - 45, 0), 640) as x0, least(greatest(cx + 45, 0), 640) as x1, least(greatest(cy - 45, 0), 480) as y0, least(greatest(cy + 45, 0), 480) as y1 from tracks where i % 15 = 0)
    select clip, i, printf('0 %.6f %.6f %.6f %.6f', round((x0 + x1) / 2 / 640, 6), round((y0 + y1) / 2 / 480, 6), round((x1 - x0) / 640, 6), round((y1 - y0) / 480, 6)) as label, case when cast('0x' || substr(md5(cast(clip as varchar)), 1, 8) as bigint) % 5 = 0 then 'val' else 'train' end as split
    from b where x1 - x0 >= 4 and y1 - y0 >= 4""", ("series", "tracks"))
def s29(spark, sf):
    rows = tracks(spark, sf).select("clip", "i", (F.col("cx") - 45).alias("x0"), (F.col("cx") + 45).alias("x1"), (F.col("cy") - 45).alias("y0"), (F.col("cy") + 45).alias("y1"))
    return traj.boxes(rows, 15, 640, 480)


CHOSEN = """c as (select user_id as clip, event_type as candidate, case event_type when 'view' then 'edge' when 'purchase' then 'edge' when 'click' then 'blob' when 'signup' then 'profile' else 'detect' end as origin,
        (max(event_id) % 100) / 100.0::double as confidence, count(*) as n_reps, 1 / (1 + stddev_pop(value) / avg(value)) as regularity, min(event_id) % 5 = 0 as static, max(event_id) % 2 = 0 as honest from events group by user_id, event_type),
    s as (select *, confidence * regularity as score, origin in ('edge', 'blob') and not static and n_reps between 3 and 18 as sane from c),
    e as (select clip, n_reps as edge_n from (select *, row_number() over (partition by clip order by honest desc, score desc, candidate) as r from s where sane and origin = 'edge') where r = 1),
    free as (select s.* from s left join e on s.clip = e.clip where sane and (origin = 'edge' or n_reps > coalesce(edge_n, 0))),
    a as (select * from (select *, row_number() over (partition by clip order by score desc, origin <> 'edge', candidate) as r from free) where r = 1),
    h as (select * from (select *, row_number() over (partition by clip order by score desc, origin <> 'edge', candidate) as r from free where honest) where r = 1),
    p as (select * from s where origin = 'profile' and confidence >= 0.6 and n_reps >= 3), d as (select * from s where origin = 'detect'),
    j as (select k.clip, p.candidate as pc, p.n_reps as pn, h.candidate as hc, h.n_reps as hn, a.candidate as ac, a.n_reps as an, a.honest as ah, d.candidate as dc, d.n_reps as dn
          from (select distinct clip from c) k left join p on k.clip = p.clip left join h on k.clip = h.clip left join a on k.clip = a.clip left join d on k.clip = d.clip),
    q as (select *, case when pc is not null then 'profile' when ac is not null then 'flow' when dc is not null then 'detect' end as pick from j)
    select clip, case pick when 'profile' then pc when 'flow' then coalesce(hc, ac) else dc end as candidate, pick, case pick when 'profile' then pn when 'flow' then coalesce(hn, an) else dn end as n_reps,
           case when pick = 'flow' then hc is not null end as honest, case pick when 'profile' then true when 'flow' then hc is not null else false end as velocity_reliable,
           pick = 'flow' and hc is not null and hc <> ac as flipped, case when pick = 'flow' then an end as count_before from q where pick is not null"""


@query("x08_chosen_estimates", CHOSEN, NONE)
def x08(spark, sf):
    kind = F.col("event_type")
    origin = F.when(kind.isin("view", "purchase"), "edge").when(kind == "click", "blob").when(kind == "signup", "profile").otherwise("detect")
    rows = read(spark, sf, "events").groupBy(F.col("user_id").alias("clip"), kind.alias("candidate"), origin.alias("origin")).agg(
        ((F.max("event_id") % 100) / 100.0).alias("confidence"), F.count("*").alias("n_reps"), (1 / (1 + F.stddev_pop("value") / F.avg("value"))).alias("regularity"),
        (F.min("event_id") % 5 == 0).alias("static"), (F.max("event_id") % 2 == 0).alias("honest"),
    )
    return estimates.chosen_estimates(rows)


@query("x08_auto_estimate")
def x08b(spark, sf):
    side = F.explode(F.array(F.lit(0), F.lit(1)))
    rows = tracks(spark, sf).select("clip", side.alias("candidate"), "t", "cx", F.when(F.col("candidate") == 0, F.col("cy")).otherwise(400 - (F.col("cy") - 400) / 20).alias("cy"), "m_per_px", "target_px")
    made = rows.select("clip", "candidate").distinct().select("clip", "candidate", F.when(F.col("candidate") == 0, "edge").otherwise("blob").alias("origin"), F.lit(0.8).alias("confidence"))
    return estimates.auto_estimate(rows, made)[0]


@query("f02_perturbed_counts")
def f02(spark, sf):
    return traj.jitter_stability(estimates.perturbed_counts(tracks(spark, sf), [-0.1, -0.05, 0.0, 0.05, 0.1]))


@query("u06_thinned_detections", """n as (select recording_id % 7 as clip, i as frame, (23.0 * (recording_id % 10))::double as cx, (31.0 * (recording_id // 10 % 6))::double as cy, (20.0 + recording_id % 40)::double as r, a as score from series),
    k as (select *, row_number() over (partition by clip, frame order by score desc, cx, cy) as k from n), u as (
        with recursive w as (
            select distinct clip, frame, 0 as k, []::struct(cx double, cy double, r double, score double)[] as kept from k
            union all
            select w.clip, w.frame, k.k, case when len(list_filter(kept, lambda q: sqrt((q.cx - k.cx) ** 2 + (q.cy - k.cy) ** 2) < 0.5 * greatest(q.r, k.r))) = 0
                   then list_append(kept, {'cx': k.cx, 'cy': k.cy, 'r': k.r, 'score': k.score}) else kept end
            from w join k on w.clip = k.clip and w.frame = k.frame and k.k = w.k + 1)
        select clip, frame, unnest(arg_max(kept, k)) as d from w group by clip, frame)
    select clip, frame, d.cx as cx, d.cy as cy, d.r as r, round(d.score, 6) as score from u""", ("series",))
def u06(spark, sf):
    """Users are the detections of a frame, on a lattice whose steps are within reach of some radii and not of others."""
    rows, k = series(spark, sf), F.col("recording_id")
    return traj.thinned(rows.select((k % 7).alias("clip"), F.col("i").cast("int").alias("frame"), (23.0 * (k % 10)).alias("cx"), (31.0 * (F.floor(k / 10) % 6)).alias("cy"), (20.0 + k % 40).alias("r"), F.col("a").alias("score")))


@query("s30_board_lines", """g as (select set_id, count(*) filter (where vendor = 'click') as n, count(*) filter (where vendor = 'view') as truth, avg(value) filter (where vendor = 'click') + 1e-9 as m from usable group by set_id),
    l as (select set_id, concat('| ', set_id, ' | ', n, ' | ', printf('%+d', n - truth), ' | ', coalesce(printf('%.3f', m), '–'), ' |') as line from g where truth > 0)
    select row_number() over (order by set_id) as n, line from l union all select -1, '| set_id | n | delta | mean |' union all select 0, '|-|-|-|-|'""")
def s30(spark, sf):
    from ..functions import usable

    rows = reps(spark, sf).where(usable()).groupBy("set_id").agg(
        F.count_if(F.col("vendor") == "click").alias("n"), F.count_if(F.col("vendor") == "view").alias("truth"), (F.avg(F.when(F.col("vendor") == "click", F.col("value"))) + 1e-9).alias("mean")
    ).where("truth > 0").withColumn("delta", F.col("n") - F.col("truth"))
    return estimates.report(rows, {"set_id": "%s", "n": "%d", "delta": "%+d", "mean": "%.3f"}, ["set_id"])


@query("s18_watch_ingest")
def s18(spark, sf):
    zero = [F.lit(0.0).alias(c) for c in ("ua_x", "ua_y", "g_x", "g_y", "q_x", "q_y", "q_z")]
    rows = moves(spark, sf).select(F.col("recording_id").cast("string").alias("set_id"), F.lit("watch_imu").alias("vendor"), "t", (F.col("a") / 9.80665).alias("ua_z"), F.lit(-1.0).alias("g_z"), F.lit(1.0).alias("q_w"), *zero)
    truth = rows.select("set_id").distinct().select("set_id", (F.col("set_id").cast("long") % 4 + 1).cast("string").alias("actual_reps"))
    from ..sources.exports import TIDY

    shape = "set_id string, vendor string, rep_index int, true_rep int, metric string, value double, unit string, flag string, confidence double"
    return estimates.watch_ingest(rows, truth, spark.createDataFrame([], shape).select(*TIDY))
