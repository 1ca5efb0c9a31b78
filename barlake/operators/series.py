"""Ordered series (recording_id, i, t, a): window operators.

All windows are partitioned by recording and ordered by sample, so Spark plans one shuffle and one sort for a
chain of them. Only built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import TIE

KEY = "recording_id"


def by_sample() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy("i")


def whole() -> WindowSpec:
    return Window.partitionBy(KEY)


def up_to() -> WindowSpec:
    return by_sample().rowsBetween(Window.unboundedPreceding, 0)


def onward() -> WindowSpec:
    return by_sample().rowsBetween(0, Window.unboundedFollowing)


def sample_rate(rows: DataFrame) -> DataFrame:
    """(recording_id, fs): one over the median step."""
    steps = rows.withColumn("dt", F.col("t") - F.lag("t").over(by_sample()))
    return steps.groupBy(KEY).agg((1 / F.percentile("dt", 0.5)).alias("fs"))


def cumulative_trapezoid(rows: DataFrame, value: str = "a", out: str = "area") -> DataFrame:
    """Running trapezoid integral over t, 0 at the first sample."""
    step = (F.col("t") - F.lag("t").over(by_sample())) * (F.col(value) + F.lag(value).over(by_sample())) / 2
    return rows.withColumn("_inc", F.coalesce(step, F.lit(0.0))).withColumn(out, F.sum("_inc").over(up_to())).drop("_inc")


def sign(x: Column) -> Column:
    return F.when(x < 0, -1).when(x >= 0, 1)


def crossings(rows: DataFrame, value: str = "a", margin: float = 0.0) -> DataFrame:
    """Adds crossing: the next sample's sign differs, strictly inside a margin of the recording at both ends; zero counts as positive."""
    n = F.count("*").over(whole())
    m = F.floor(F.lit(margin) * n)
    turn = sign(F.lead(value).over(by_sample())) != sign(F.col(value))
    inside = ((F.col("i") > m) & (F.col("i") < n - m)) if margin else F.lit(True)
    return rows.withColumn("crossing", F.coalesce(turn & inside, F.lit(False)))


def zero_velocity_integral(rows: DataFrame, anchor: str = "anchor", value: str = "a", out: str = "v") -> DataFrame:
    """Integrates and removes drift so that v is 0 at each anchor and both ends; the drift is linear in the sample number.

    The raw integral between two anchors is C(i) - C(start); its drift (C(end) - C(start)) * (i - start) / (end - start).
    """
    rows = cumulative_trapezoid(rows, value, "_c")
    last = F.max("i").over(whole())
    mark = F.when(F.col(anchor) | (F.col("i") == 0) | (F.col("i") == last), F.struct("i", "_c"))
    rows = rows.withColumn("_m", mark)
    before = F.last("_m", ignorenulls=True).over(up_to())
    after = F.first("_m", ignorenulls=True).over(onward())
    rows = rows.withColumn("_p", before).withColumn("_q", after)
    share = F.try_divide(F.col("i") - F.col("_p.i"), (F.col("_q.i") - F.col("_p.i")).cast("double"))
    v = F.col("_c") - F.col("_p._c") - F.coalesce(share, F.lit(0.0)) * (F.col("_q._c") - F.col("_p._c"))
    return rows.withColumn(out, v).drop("_c", "_m", "_p", "_q")


def segments(rows: DataFrame, anchor: str = "anchor") -> DataFrame:
    """(recording_id, segment, i, ...): runs between consecutive bounds; a bound's sample belongs to both sides."""
    last = F.max("i").over(whole())
    bound = F.col(anchor) | (F.col("i") == 0) | (F.col("i") == last)
    rows = rows.withColumn("_b", bound).withColumn("_n", F.sum(F.col("_b").cast("long")).over(up_to())).withColumn("_all", F.sum(F.col("_b").cast("long")).over(whole()))
    own = F.when(F.col("_b"), F.array(F.col("_n") - 2, F.col("_n") - 1)).otherwise(F.array(F.col("_n") - 1))
    ok = F.filter(own, lambda s: (s >= 0) & (s < F.col("_all") - 1))
    return rows.withColumn("segment", F.explode(ok)).drop("_b", "_n", "_all")


def segment_metrics(rows: DataFrame, value: str = "v") -> DataFrame:
    """Per segment of positive mean: start, end, mean, max and trapezoid area; numbered from 0 over those kept."""
    w = Window.partitionBy(KEY, "segment").orderBy("i")
    inc = (F.col("t") - F.lag("t").over(w)) * (F.col(value) + F.lag(value).over(w)) / 2
    out = rows.withColumn("_inc", inc).groupBy(KEY, "segment").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.avg(value).alias("mean_velocity"), F.max(value).alias("peak_velocity"), F.sum("_inc").alias("rom"), F.count("*").alias("samples")
    )
    out = out.where("mean_velocity > 0 and samples > 1")
    return out.withColumn("rep", F.row_number().over(Window.partitionBy(KEY).orderBy("segment")) - 1)


def gate_reps(reps: DataFrame, by: str = KEY, rom: str = "rom", mv: str = "mean_velocity", order: str = "start", low: float = 0.55, high: float = 1.5, mv_low: float = 0.55, core_rom: float = 0.3, core_mv: float = 0.45) -> DataFrame:
    """Keeps reps near the medians of the core ones (three needed, else all stay), renumbered from 0."""
    w = Window.partitionBy(by)
    core = (F.col(rom) > core_rom) & (F.col(mv) > core_mv)
    rows = reps.withColumn("_n", F.sum(core.cast("int")).over(w)).withColumn("_rom", F.percentile(F.when(core, F.col(rom)), 0.5).over(w)).withColumn("_mv", F.percentile(F.when(core, F.col(mv)), 0.5).over(w))
    fits = F.col(rom).between(low * F.col("_rom"), high * F.col("_rom")) & (F.col(mv) >= mv_low * F.col("_mv"))
    rows = rows.where((F.col("_n") < 3) | fits)
    return rows.withColumn("rep", F.row_number().over(w.orderBy(order)) - 1).drop("_n", "_rom", "_mv")


def active_mean(value: Column, peak: Column, fraction: float = 0.1, floor: float = 0.05) -> tuple[Column, Column]:
    """(aggregate, fallback): |mean of signed values whose size reaches max(floor, fraction * peak) to within TIE|, and of all where none does.

    peak: the group's greatest size, on each row.
    """
    on = F.abs(value) >= F.greatest(F.lit(floor), fraction * peak) - TIE
    return F.abs(F.avg(F.when(on, value))), F.abs(F.avg(value))


def concentric_velocity(rows: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """(by..., mean_velocity, peak_velocity) of each segment."""
    top = F.max(F.abs(F.col(value))).over(Window.partitionBy(*by))
    some, every = active_mean(F.col(value), F.col("_peak"))
    return rows.withColumn("_peak", top).groupBy(*by).agg(F.coalesce(some, every, F.lit(0.0)).alias("mean_velocity"), F.max("_peak").alias("peak_velocity"))


def running_rate(rows: DataFrame) -> DataFrame:
    """Adds rate: (samples - 1) / (last - first), so far."""
    n, first = F.count("*").over(up_to()), F.min("t").over(up_to())
    return rows.withColumn("rate", F.when(n > 1, F.try_divide((n - 1).cast("double"), F.col("t") - first)))


def envelope(rows: DataFrame, half: float = 0.35, value: str = "a") -> DataFrame:
    """Adds envelope: the greatest value within half a window of time on either side."""
    frame = f"range between {float(half)}D preceding and {float(half)}D following"
    return rows.withColumn("envelope", F.expr(f"max({value}) over (partition by {KEY} order by t {frame})"))


def rolling_median(rows: DataFrame, half: int = 2, value: str = "a", edges: str = "reflect") -> DataFrame:
    """Adds median over 2 half + 1 samples. Beyond the ends, values are mirrored (edge sample repeated) or 0."""
    n = F.count("*").over(whole())
    values = F.collect_list(F.struct("i", F.col(value).alias("v"))).over(by_sample().rowsBetween(-2 * half - 1, 2 * half + 1))
    here = F.col("i")

    def at(k: int) -> Column:
        j = here + k
        if edges == "reflect":
            j = F.when(j < 0, -j - 1).when(j >= n, 2 * n - 1 - j).otherwise(j)
        hit = F.filter(values, lambda s: s["i"] == j)
        return F.coalesce(F.try_element_at(hit, F.lit(1))["v"], F.lit(0.0))

    return rows.withColumn("median", F.element_at(F.array_sort(F.array(*[at(k) for k in range(-half, half + 1)])), half + 1))


def gradient(rows: DataFrame, value: str = "a") -> DataFrame:
    """Adds slope: second-order central differences over uneven t, one-sided at the ends."""
    y, t = F.col(value), F.col("t")
    hp, hn = t - F.lag("t").over(by_sample()), F.lead("t").over(by_sample()) - t
    dp, dn = (y - F.lag(value).over(by_sample())) / hp, (F.lead(value).over(by_sample()) - y) / hn
    return rows.withColumn("slope", F.coalesce((dp * hn + dn * hp) / (hp + hn), dp, dn))


def alternating(events: DataFrame, by: str = KEY) -> DataFrame:
    """Of extrema (by, i, kind min|max, pos): one of each run of a kind, the more extreme, the first of equal ones."""
    w = Window.partitionBy(by).orderBy("i")
    start = F.coalesce(F.lag("kind").over(w) != F.col("kind"), F.lit(True))
    rows = events.withColumn("_run", F.sum(start.cast("int")).over(w))
    depth = F.when(F.col("kind") == "min", F.col("pos")).otherwise(-F.col("pos"))
    best = rows.groupBy(by, "_run", "kind").agg(F.min_by(F.struct("i", "pos"), F.struct(depth, "i")).alias("e"))
    return best.select(by, "kind", F.col("e.i").alias("i"), F.col("e.pos").alias("pos"))


def excursions(walk: DataFrame, fs: Column, by: str = KEY, shortest: float = 0.2) -> DataFrame:
    """(by, bottom, top, amplitude, gap): each bottom with the top right after it, if far enough apart; gap to the next bottom."""
    w = Window.partitionBy(by).orderBy("i")
    rows = walk.withColumn("_k", F.lead("kind").over(w)).withColumn("top", F.lead("i").over(w)).withColumn("_p", F.lead("pos").over(w))
    rows = rows.where((F.col("kind") == "min") & (F.col("_k") == "max") & (F.col("top") - F.col("i") >= F.floor(fs * shortest)))
    rows = rows.select(by, F.col("i").alias("bottom"), "top", (F.col("_p") - F.col("pos")).alias("amplitude"))
    return rows.withColumn("gap", F.lead("bottom").over(Window.partitionBy(by).orderBy("bottom")) - F.col("top"))


def strip_ends(pairs: DataFrame, by: str = KEY, fraction: float = 0.75, gap_factor: float = 2.5, least: int = 4, floor: int = 3) -> DataFrame:
    """Drops anomalous excursions from the end, then from the start, keeping at least `floor` of them.

    An excursion under a fraction of the median amplitude is anomalous; at the start also one that a gap far over the median follows.
    """
    w, order = Window.partitionBy(by), Window.partitionBy(by).orderBy("bottom")
    rows = pairs.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(order) - 1)
    rows = rows.withColumn("_amp", F.percentile("amplitude", 0.5).over(w)).withColumn("_gap", F.coalesce(F.percentile("gap", 0.5).over(w), F.lit(0.0)))
    small = F.col("amplitude") < fraction * F.col("_amp")
    lone = (F.col("_gap") > 0) & (F.coalesce(F.col("gap"), F.lit(0)) > gap_factor * F.col("_gap"))
    rows = rows.withColumn("_hi", F.greatest(F.coalesce(F.max(F.when(~small, F.col("_k"))).over(w) + 1, F.lit(0)), F.least(F.lit(floor), F.col("_n"))))
    good = ~(small | lone)
    rows = rows.withColumn("_lo", F.least(F.coalesce(F.min(F.when(good, F.col("_k"))).over(w), F.col("_n")), F.greatest(F.col("_hi") - floor, F.lit(0))))
    keep = (F.col("_n") < least) | (F.col("_amp") <= 0) | ((F.col("_k") < F.col("_hi")) & (F.col("_k") >= F.col("_lo")))
    return rows.where(keep).drop("_n", "_k", "_amp", "_gap", "_hi", "_lo")


def interpolate(grid: DataFrame, samples: DataFrame, value: str = "y", by: str = KEY) -> DataFrame:
    """Linear interpolation of samples (by, t, value) at grid (by, t); held at the ends. One union and one sort, no range join."""
    both = grid.select(by, "t", F.lit(None).cast("double").alias("_y"), F.lit(None).cast("double").alias("_t"), F.lit(1).alias("_g")).unionByName(
        samples.select(by, "t", F.col(value).cast("double").alias("_y"), F.col("t").alias("_t"), F.lit(0).alias("_g"))
    )
    back = Window.partitionBy(by).orderBy("t", "_g").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy("t", "_g").rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("_g") == 0, F.struct(F.col("_t").alias("t"), F.col("_y").alias("y")))
    rows = both.withColumn("_p", F.last(point, ignorenulls=True).over(back)).withColumn("_q", F.first(point, ignorenulls=True).over(ahead))
    lerp = F.col("_p.y") + (F.col("_q.y") - F.col("_p.y")) * F.try_divide(F.col("t") - F.col("_p.t"), F.col("_q.t") - F.col("_p.t"))
    out = F.when(F.col("t") == F.col("_p.t"), F.col("_p.y")).otherwise(F.coalesce(lerp, F.col("_p.y"), F.col("_q.y")))
    return rows.withColumn(value, out).where("_g = 1").select(by, "t", value)


def nearest(left: DataFrame, right: DataFrame, by: str = KEY, value: str = "y") -> DataFrame:
    """For each left row (by, t) the right row (by, t, value) of the nearest time; the earlier one of two. By windows, not a range join."""
    both = left.select(by, "t", F.lit(None).cast("double").alias("_t"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_g")).unionByName(
        right.select(by, "t", F.col("t").alias("_t"), F.col(value).cast("double").alias("_y"), F.lit(0).alias("_g"))
    )
    back = Window.partitionBy(by).orderBy("t", "_g").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy("t", "_g").rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("_g") == 0, F.struct(F.col("_t").alias("t"), F.col("_y").alias("y")))
    rows = both.withColumn("_p", F.last(point, ignorenulls=True).over(back)).withColumn("_q", F.first(point, ignorenulls=True).over(ahead)).where("_g = 1")
    first = F.col("_q").isNull() | (F.col("_p").isNotNull() & (F.col("t") - F.col("_p.t") <= F.col("_q.t") - F.col("t")))
    chosen = F.when(first, F.col("_p")).otherwise(F.col("_q"))
    return rows.select(by, "t", chosen["t"].alias("nearest_t"), chosen["y"].alias(value))


def replay(rows: DataFrame, start: float, end: float, backwards: bool = False) -> DataFrame:
    """Samples of a closed time window; backwards mirrors time at the last one."""
    rows = rows.where(F.col("t").between(start - 1e-9, end + 1e-9))
    return rows.withColumn("t", F.max("t").over(whole()) - F.col("t")) if backwards else rows
