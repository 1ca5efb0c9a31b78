"""From tracks and recordings to a set's estimate: which ruler, which candidate, which counts, and how far to trust them.

Selection and flags are joins, windows and aggregates over candidate tables; only the chosen track's signal steps are
grouped maps.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metres_per_pixel, segment_metres_per_pixel, vertical_acceleration
from ..functions import signal as s
from ..functions.columns import SEGMENTS
from . import recordings, repmetrics, tables, trajectories
from .grouped import Part, by_group
from .series import gate_reps

PLATE_M = 0.45
# Lift, least and greatest travel in metres, mean velocity to exceed.
LIFT_WINDOWS = (("row", 0.35, 0.90, 0.35), ("bench", 0.20, 0.55, 0.12), ("rdl", 0.40, 0.70, 0.10))


@runtime_checkable
class VelocitySource(Protocol):
    """Whatever turns samples into rows (set_id, vendor, rep, value, flag) for an exercise."""

    def estimate(self, samples: DataFrame, exercise: str | None = None) -> DataFrame: ...


_sources: dict[str, Callable[..., VelocitySource]] = {}


def register(name: str) -> Callable[[Callable[..., VelocitySource]], Callable[..., VelocitySource]]:
    """Names a class or function that makes a source."""

    def put(make: Callable[..., VelocitySource]) -> Callable[..., VelocitySource]:
        _sources[name] = make
        return make

    return put


def source(name: str, **options) -> VelocitySource:
    """Makes the source of that name; an unknown name raises and tells the known ones."""
    if name not in _sources:
        raise ValueError(f"no source {name!r}; there are {sorted(_sources)}")
    return _sources[name](**options)


def _as_reps(rows: DataFrame, vendor: str, key: str = "recording_id") -> DataFrame:
    flag = F.col("flag") if "flag" in rows.columns else F.lit(None).cast("string")
    rep = "rep" if "rep" in rows.columns else "rep_index"
    return rows.select(F.col(key).alias("set_id"), F.lit(vendor).alias("vendor"), F.col(rep).alias("rep"), F.col("mean_velocity").alias("value"), flag.alias("flag"))


@register("wave")
class WaveSource:
    """Displacement-wave repetitions of motion samples (recording_id, t, a)."""

    def estimate(self, samples: DataFrame, exercise: str | None = None) -> DataFrame:
        return _as_reps(recordings.wave_segments(samples), "watch_imu")


@register("chain")
class ChainSource:
    """The older chain of reversals, with the gate of the lift where it has one."""

    def estimate(self, samples: DataFrame, exercise: str | None = None) -> DataFrame:
        reps = recordings.chain_segments(samples)
        return _as_reps(lift_gate(reps.withColumn("lift", F.lit(exercise))) if exercise else reps, "watch_imu")


@register("trajectory")
class TrajectorySource:
    """Bar trajectories (clip, t, cx, cy, m_per_px)."""

    def __init__(self, **options):
        self.options = options

    def estimate(self, samples: DataFrame, exercise: str | None = None) -> DataFrame:
        return _as_reps(trajectories.trajectory_reps(samples, **self.options), "video", "clip")


def summaries(reps: DataFrame) -> DataFrame:
    """What a source's reps say of each set."""
    return repmetrics.set_summary(reps)


def lift_gate(reps: DataFrame, by: str = "recording_id", lift: str = "lift") -> DataFrame:
    """Keeps reps (by, lift, start, rom, mean_velocity) inside their lift's window; squats by the gate about their own medians; others stay. Renumbered from 0."""
    inside = F.lit(True)
    for name, low, high, least in LIFT_WINDOWS:
        fits = F.col("rom").between(low, high) & (F.col("mean_velocity") > least)
        inside = F.when(F.col(lift) == name, fits).otherwise(inside)
    reps = reps.drop("rep")
    squats = gate_reps(reps.where(F.col(lift) == "squat"), by).drop("rep")
    kept = reps.where(F.coalesce(F.col(lift) != "squat", F.lit(True)) & inside).unionByName(squats)
    return kept.withColumn("rep", F.row_number().over(Window.partitionBy(by).orderBy("start")) - 1)


def resolved_scale(tracks: DataFrame, plate_m: float = PLATE_M) -> DataFrame:
    """Adds m_per_px, scale_source and scale_confidence to tracks (target_px, spec_m, spec_confidence, angle_valid, rim_px, body, segment_px, height_m, segment, segment_confidence).

    A body segment is the ruler where it is asked for (body) or the angle rules the plate out, if it was seen. Else a confirmed
    rim outranks the plate of the specification, and that the usual plate. Nulls are absent; a scale without pixels is null.
    """
    seen = (F.coalesce("body", F.lit(False)) | ~F.coalesce("angle_valid", F.lit(True))) & (F.coalesce("segment_px", F.lit(0.0)) > 0)
    size = F.coalesce("spec_m", F.lit(plate_m))
    rim = F.coalesce("rim_px", F.lit(0.0)) > 0
    plate = metres_per_pixel(size, F.when(rim, F.col("rim_px")).otherwise(F.col("target_px")))
    body = F.lit(None).cast("double")
    for name in SEGMENTS:
        body = F.when(F.col("segment") == name, segment_metres_per_pixel(F.col("height_m"), name, F.col("segment_px"))).otherwise(body)
    known = F.when(F.col("spec_m").isNotNull(), F.col("spec_confidence"))
    confidence = F.when(rim, F.greatest(F.coalesce(known, F.lit(0.9)), F.lit(0.9))).otherwise(known)
    return tracks.select(
        "*", F.when(seen, body).otherwise(plate).alias("m_per_px"),
        F.when(seen, "anthro").when(rim, "rim_confirmed").when(F.col("spec_m").isNotNull(), "plate_spec").otherwise("implement").alias("scale_source"),
        F.when(seen, F.col("segment_confidence")).otherwise(confidence).alias("scale_confidence"),
    )


def trusted_scale(confidence: Column, scale_source: Column, size_cv: Column, median_mv: Column, angle_valid: Column) -> tuple[Column, Column]:
    """(confidence, suspect): a body ruler keeps its own; a measured plate loses by the jitter of its size, a confirmed rim does not; an impossible velocity makes any plate suspect."""
    start, body = F.coalesce(confidence, F.lit(1.0)), scale_source == "anthro"
    measured = F.when(~scale_source.startswith("rim_confirmed") & (size_cv > 0), size_cv)
    value, suspect = trajectories.scale_check(start, measured, median_mv, angle_valid)
    jitter = F.coalesce(measured > 0.18, F.lit(False))
    return F.when(body, start).otherwise(value), F.when(body, F.lit(False)).otherwise(suspect | jitter)


def depth_positions(rows: DataFrame, key: str = "clip") -> DataFrame:
    """(key, t, pos) in metres of a track (key, t, cy, d, rim_px, rim_t, plate_m, frame_h) by the plate's own diameter over time, scaled to the confirmed rim.

    d is null where the plate was not measured. Tracks whose diameters are too few, jittery or drifting give nothing.
    """

    def fn(part: Part) -> list[tuple]:
        seen, when = ~np.isnan(part["d"]), float(part["rim_t"][0])
        trace = trajectories.anchored_trace(part["t"][seen], part["d"][seen], float(part["rim_px"][0]), part["t"], None if np.isnan(when) else when)
        if trace is None:
            return []
        pos = -float(part["plate_m"][0]) * (part["cy"] - float(part["frame_h"][0]) / 2) / trace
        return list(zip(part["t"].tolist(), pos.tolist()))

    numbers = [F.col(c).cast("double").alias(c) for c in ("t", "cy", "d", "rim_px", "rim_t", "plate_m", "frame_h")]
    return by_group(rows.select(key, *numbers), key, fn, "t double, pos double")


def chosen_estimates(candidates: DataFrame, key: str = "clip", least: int = 3, most: int = 18, sure: float = 0.6) -> DataFrame:
    """The estimate of each clip among candidates (key, candidate, origin, confidence, n_reps, regularity, static, honest), one row a clip.

    origin: profile, edge, blob or detect. A sure profile comes first. Then tracks that move and have a sane count: the
    best by confidence times regularity, honest ones before others; a blob only if it counts more than the best edge track.
    Else detect, which counts but has no velocity. Ties go to edges and to the earlier candidate.
    (key, candidate, pick, n_reps, honest, velocity_reliable, flipped, count_before): flipped: honesty changed the choice,
    count_before: the count of the best of all.
    """
    rows = candidates.withColumn("score", F.col("confidence") * F.col("regularity"))
    what = F.struct("candidate", "n_reps", "honest")
    rank = F.struct(-F.col("score"), (F.col("origin") != "edge"), "candidate")
    sane = F.col("origin").isin("edge", "blob") & ~F.col("static") & F.col("n_reps").between(least, most)
    edge = F.min_by("n_reps", F.when(sane & (F.col("origin") == "edge"), F.struct(~F.col("honest"), rank))).over(Window.partitionBy(key))
    profile = (F.col("origin") == "profile") & (F.col("confidence") >= sure) & (F.col("n_reps") >= least)
    rows = rows.withColumn("edge", F.coalesce(edge, F.lit(0)))
    free = sane & ((F.col("origin") == "edge") | (F.col("n_reps") > F.col("edge")))
    best = rows.groupBy(key).agg(
        F.min_by(what, F.when(profile, rank)).alias("p"), F.min_by(what, F.when(free & F.col("honest"), rank)).alias("h"),
        F.min_by(what, F.when(free, rank)).alias("a"), F.min_by(what, F.when(F.col("origin") == "detect", rank)).alias("d"),
    )
    flow = F.coalesce("h", "a")
    pick = F.when(F.col("p").isNotNull(), "profile").when(flow.isNotNull(), "flow").when(F.col("d").isNotNull(), "detect")
    got, moved = F.coalesce("p", flow, "d"), pick == "flow"
    return best.where(got.isNotNull()).select(
        key, got["candidate"].alias("candidate"), pick.alias("pick"), got["n_reps"].alias("n_reps"), F.when(moved, got["honest"]).alias("honest"),
        ((pick == "profile") | (moved & got["honest"])).alias("velocity_reliable"),
        F.coalesce(moved & F.col("h").isNotNull() & (F.col("h.candidate") != F.col("a.candidate")), F.lit(False)).alias("flipped"),
        F.when(moved, F.col("a.n_reps")).alias("count_before"),
    )


def auto_estimate(tracks: DataFrame, candidates: DataFrame, key: str = "clip") -> tuple[DataFrame, DataFrame]:
    """(reps, choices) of clips from their candidate tracks (key, candidate, t, cx, cy, m_per_px, target_px) and candidates (key, candidate, origin, confidence).

    Every track is counted by the relative gate; static and honest are judged on the track; the gate of plausibility comes after the
    choice, on the chosen track only, and not where only detections were left. Reps without a reliable velocity are flagged.
    """
    name = F.concat_ws("\u0001", F.col(key).cast("string"), F.col("candidate").cast("string"))
    rows = tracks.withColumn("track", name)
    reps = trajectories.trajectory_reps(rows, key="track", gate="relative")
    shape = trajectories.regularity(reps, "track")
    judged = trajectories.honesty(rows, "track").select("track", "honest")
    still = trajectories.static_suspect(rows.join(candidates.select(key, "candidate", "confidence"), [key, "candidate"]), "track")
    table = candidates.withColumn("track", name).join(shape, "track", "left").join(judged, "track", "left").join(still, "track", "left")
    table = table.select(
        key, "candidate", "origin", "confidence", F.coalesce("n", F.lit(0)).alias("n_reps"), F.coalesce("regularity", F.lit(0.0)).alias("regularity"),
        F.coalesce("static_suspect", F.lit(False)).alias("static"), F.coalesce("honest", F.lit(False)).alias("honest"),
    )
    choice = chosen_estimates(table, key)
    own = reps.join(choice.select(key, name.alias("track"), "pick", "velocity_reliable"), "track").drop("track")
    gated = trajectories.plausibility_gate(own.where("pick <> 'detect'"), key).unionByName(own.where("pick = 'detect'"))
    flag = F.when(~F.col("velocity_reliable"), "velocity_relative_only")
    return gated.withColumn("flag", F.nullif(F.concat_ws("|", "flag", flag), F.lit(""))).drop("pick"), choice


def auto_counts(detections: DataFrame, key: str = "clip", hz: float = 1.8, share: float = 0.3, floor: float = 0.5) -> DataFrame:
    """Reps of clips counted from detections (key, frame, t, cx, cy, r) alone: linked into tracks, of which the one that swings most steadily is taken.

    ``trajectories.scored_tracks`` scores the tracks (of equal ones the earlier is taken). The chosen one is filled in over all
    frames, low-passed where the frames are dense enough for it, and its reps gated relatively, with a floor on travel.
    """
    linked = trajectories.link_tracks(detections.select(key, "frame", "cx", "cy", "r"), key)
    rows = trajectories.scored_tracks(linked, key, share)
    best = F.min(F.struct(-F.col("score"), F.col("track"))).over(Window.partitionBy(key))
    chosen = rows.withColumn("best", best).where(F.col("track") == F.col("best.track"))
    whole = detections.groupBy(key).agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.min("t").alias("begin"), F.max("t").alias("finish"))
    step = F.coalesce(F.try_divide(F.col("finish") - F.col("begin"), F.col("last") - F.col("first")), F.lit(0.0)).cast("double")
    path = chosen.join(whole.withColumn("step", step), key).select(
        key, (F.col("begin") + (F.col("frame") - F.col("first")) * F.col("step")).alias("t"), "cx", "cy", "step", (PLATE_M / (2 * F.col("radius"))).alias("m_per_px")
    )

    def fn(part: Part) -> list[tuple]:
        rate = 1 / part["step"][0] if part["step"][0] > 0 else 0.0
        cy = s.zero_phase(part["cy"], hz, rate, "low") if rate > 2 * hz and len(part["cy"]) > 15 else part["cy"]
        return list(zip(part["t"].tolist(), part["cx"].tolist(), cy.tolist(), part["m_per_px"].tolist()))

    smooth = by_group(path, key, fn, "t double, cx double, cy double, m_per_px double")
    return trajectories.trajectory_reps(smooth, key=key, gate="relative", peak=0.10, rom=0.18, rom_floor=floor)


def watch_ingest(samples: DataFrame, truth: DataFrame, old: DataFrame) -> DataFrame:
    """The tidy table after taking in watch recordings (set_id, vendor, t and the columns of a motion sample).

    Reps come from the displacement wave; recordings without a count in truth (set_id, actual_reps) are left out; reps keep their number as
    the true one where counts agree, else all are flagged. The earlier watch rows of every set taken in go, whichever the mount.
    """
    from ..sources.exports import watch_rows

    both = F.concat_ws("\u0001", "set_id", "vendor")
    moving = samples.select(both.alias("recording_id"), "t", vertical_acceleration().alias("a"))
    reps = recordings.wave_segments(moving).withColumn("_k", F.split("recording_id", "\u0001"))
    reps = reps.select(F.col("_k")[0].alias("set_id"), F.col("_k")[1].alias("vendor"), "rep", "mean_velocity", "rom")
    return tables.replace_watch(old, watch_rows(reps, truth))


def perturbed_counts(tracks: DataFrame, shifts: list[float], key: str = "clip", **options) -> DataFrame:
    """(key, count) of each track (key, t, cx, cy, m_per_px) counted anew at each relative change of its scale, for jitter_stability."""
    changed = tracks.withColumn("_shift", F.explode(F.array(*[F.lit(float(x)) for x in shifts])))
    changed = changed.withColumn("m_per_px", F.col("m_per_px") * (1 + F.col("_shift")))
    return trajectories.trajectory_counts(changed, [key, "_shift"], **options).select(key, "count")


def seeded_counts(detections: DataFrame, seeds: DataFrame, nudges: list[tuple[float, float]], key: str = "clip", reach: float = 1.0, **options) -> DataFrame:
    """(key, dx, dy, track, count): the reps that follow from a seed (key, frame, x, y) and from each nudge of it, for ``jitter_stability``.

    Nudges are in radii of the track that the seed itself takes. A seed takes the linked track nearest at its frame, within ``reach`` of
    that track's radii (of equal ones the earlier); it may take none: track and count are null. A track is counted once,
    however many nudges take it.
    """
    filled = trajectories.filled_tracks(trajectories.link_tracks(detections.select(key, "frame", "cx", "cy", "r"), key), key)
    times = detections.groupBy(key).agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.min("t").alias("begin"), F.max("t").alias("finish"))
    given = seeds.groupBy(key).agg(F.collect_list(F.struct("frame", "x", "y")).alias("seeds"))
    # what the seeds take is told to all rows of the clip by windows, so that the tracks are made once: every branch would link anew
    rows, whole = filled.join(times, key).join(given, key), Window.partitionBy(key)

    def taken(dx: Column, dy: Column) -> Column:
        far = lambda s: F.sqrt((F.col("cx") - (s["x"] + dx)) ** 2 + (F.col("cy") - (s["y"] + dy)) ** 2)
        nearest = F.array_min(F.transform(F.filter("seeds", lambda s: s["frame"] == F.col("frame")), far))
        return F.min(F.when(nearest <= reach * F.col("radius"), F.struct(nearest.alias("far"), "track", "radius"))).over(whole)

    rows = rows.withColumn("unit", taken(F.lit(0.0), F.lit(0.0))["radius"])
    names = [f"own{k}" for k in range(len(nudges))]
    rows = rows.withColumns({n: taken(float(a) * F.col("unit"), float(b) * F.col("unit"))["track"] for n, (a, b) in zip(names, nudges)})
    which = F.array_compact(F.array(*[F.when(F.col(n) == F.col("track"), F.lit(k)) for k, n in enumerate(names)]))
    used = rows.withColumn("takers", which).where(F.size("takers") > 0)
    step = F.coalesce(F.try_divide(F.col("finish") - F.col("begin"), F.col("last") - F.col("first")), F.lit(0.0))
    paths = used.select(key, "track", "takers", (F.col("begin") + (F.col("frame") - F.col("first")) * step).alias("t"), "cx", "cy", (PLATE_M / (2 * F.col("radius"))).alias("m_per_px"))
    counted = trajectories.trajectory_counts(paths, [key, "track", "takers"], **{"gate": "relative", **options})
    counted = counted.select(key, F.explode("takers").alias("k"), "track", "count")
    moved = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(a)).alias("dx"), F.lit(float(b)).alias("dy")) for k, (a, b) in enumerate(nudges)])).alias("nudge")
    return seeds.select(key, moved).select(key, "nudge.*").join(counted, [key, "k"], "left").drop("k")


def report(rows: DataFrame, columns: dict[str, str], order: list[str], dash: str = "–") -> DataFrame:
    """(n, line) of a table as Markdown: a header, a rule, then the rows in order; columns: name to printf format, null shown as a dash.

    One window numbers all lines, so it is meant for boards of sets, not for reps.
    """
    cells = [F.coalesce(F.format_string(form, F.col(name)), F.lit(dash)) if "s" not in form[-1] else F.coalesce(F.col(name).cast("string"), F.lit(dash)) for name, form in columns.items()]
    cells = [F.when(F.col(name).isNull(), dash).otherwise(c) for name, c in zip(columns, cells)]
    body = rows.select(F.row_number().over(Window.orderBy(*order)).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = rows.sparkSession.createDataFrame([(-1, "| " + " | ".join(columns) + " |"), (0, "|" + "-|" * len(columns))], "n int, line string")
    return head.unionByName(body)
