"""Measures over repetitions (set_id, vendor, rep, value, flag): aggregates, agreement, boards.

Everything is built-in expressions. Groups are sets or set-vendor pairs, which are tiny; each operator
needs one shuffle on its key, combined map-side where it is an aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import usable
from ..functions.columns import TIE
from ..functions.slopes import median_slope
from . import order

KEYS = ("set_id", "vendor")


def loss_of(values: Column, k: int = 2, tail: Column | None = None) -> Column:
    """Velocity loss of values in order: (best - mean of the last k) / best, in percent; null under three or for a best of 0 or less.

    k is at least 1 and at most one less than there are. tail: the values that the last k come from, if not all.
    """
    n, best = F.size(values), F.array_max(values)
    source = values if tail is None else tail
    last = F.slice(source, -F.greatest(F.lit(1), F.least(F.lit(k), n - 1, F.size(source))), F.greatest(F.lit(1), F.least(F.lit(k), n - 1, F.size(source))))
    mean = F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last)
    return F.when((n >= 3) & (best > 0), (best - mean) / best * 100)


def _ordered(value: Column, condition: Column, order: str = "rep") -> Column:
    rows = F.array_sort(F.collect_list(F.when(condition, F.struct(F.col(order).alias("o"), value.alias("v")))))
    return F.transform(rows, lambda r: r["v"])


def _from_end(condition: Column, by: Sequence[str], order: str = "rep") -> Column:
    """How many rows that fulfil the condition a group has from this one on."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc(), F.col("value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(condition.cast("int")).over(w)


def _loss(good: Column, tail: Column, k: int, least: int = 3) -> tuple[Column, Column, Column]:
    """(count, best, loss) as aggregates of rows with good and tail (flags) and _n and _m (their counts from the end).

    The last min(k, n - 1) values are the last k, or all but the first, or (of a shorter tail) all.
    """
    def parts(flag: str, at: str) -> tuple[Column, Column, Column]:
        x = F.when(F.col(flag), F.col("value"))
        return F.count(x), F.sum(F.when(F.col(flag) & (F.col(at) <= k), F.col("value"))), F.sum(x)

    (n, last, every), (m, tail_last, tail_every) = parts("_good", "_n"), parts("_tail", "_m")
    best, first = F.max(F.when(good, F.col("value"))), F.min_by("value", F.when(good, F.col("rep")))
    plain = F.when(n > k, last / k).otherwise((every - first) / (n - 1))
    short = F.when((m >= k) & (n > k), tail_last / k).when(m < n, tail_every / m).otherwise(plain)
    mean = F.when(m >= least, short).otherwise(plain)
    return n.cast("int"), best, F.when((n >= 3) & (best > 0), (best - mean) / best * 100)


def _with_loss(reps: DataFrame, by: Sequence[str], k: int, good: Column, tail: Column | None, *more: Column) -> DataFrame:
    """tail: what the last values come from, if not all good ones."""
    rows = reps.withColumn("_good", good).withColumn("_tail", good if tail is None else tail)
    rows = rows.withColumn("_n", _from_end(F.col("_good"), by))
    rows = rows.withColumn("_m", F.col("_n") if tail is None else _from_end(F.col("_tail"), by))
    n, best, loss = _loss(F.col("_good"), F.col("_tail"), k)
    return rows.groupBy(*by).agg(n.alias("n_reps"), best.alias("best"), loss.alias("velocity_loss"), *more)


def velocity_loss(reps: DataFrame, by: Sequence[str] = KEYS, k: int = 2, exclude_partial: bool = False) -> DataFrame:
    """(by..., n_reps, best, velocity_loss). exclude_partial drops partial reps from the terminal window only, if three or more remain.

    One shuffle and one sort on the key, then a hash aggregate.
    """
    tail = usable() & (F.coalesce("flag", F.lit("")) != "partial_rom") if exclude_partial else None
    return _with_loss(reps, by, k, usable(), tail).select(*by, "n_reps", "best", "velocity_loss")


def set_summary(reps: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Summary of a set whose loss is 0 where undefined; confidence is the mean of the reps', 0 for none (column confidence optional)."""
    conf = F.avg("confidence") if "confidence" in reps.columns else F.lit(None).cast("double")
    some = F.col("value").isNotNull()
    rows = _with_loss(reps, by, 2, some, None, F.count("*").cast("int").alias("_all"), conf.alias("c"))
    return rows.select(*by, F.col("_all").alias("n_reps"), F.coalesce("velocity_loss", F.lit(0.0)).alias("velocity_loss"), F.coalesce("c", F.lit(0.0)).alias("confidence"))


def numbered(reps: DataFrame, by: Sequence[str] = KEYS, order: str = "rep", descending: bool = False, name: str = "pos") -> DataFrame:
    """Position of each usable row in its group, from 0."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc() if descending else F.col(order))
    return reps.where(usable()).withColumn(name, F.row_number().over(w) - 1)


def theil_sen(reps: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """(by..., slope): median of all pairwise slopes over positions; null under two. Groups stay.

    The values of a set become one sorted array; the median is selected by counting inversions, n log n in a set, so no slope
    is a row and a set may hold any number of values that fit in an array.
    """

    @F.pandas_udf("double")
    def slope(sets: pd.Series) -> pd.Series:
        return pd.Series([median_slope(v) for v in sets], dtype="float64")

    sets = reps.groupBy(*by).agg(_ordered(F.col("value"), usable()).alias("v"))
    return sets.select(*by, slope("v").alias("slope")).withColumn("slope", F.when(~F.isnan("slope"), F.col("slope")))


def paired(reps: DataFrame, source: str, reference: str, key: str = "set_id") -> DataFrame:
    """Positional pairs of two vendors: (key, pos, source, reference, n_source, n_reference), both counts on each row."""
    sides = numbered(reps.where(F.col("vendor").isin(source, reference)), (key, "vendor"))
    mine = F.col("vendor") == source
    rows = sides.groupBy(key, "pos").agg(F.max(F.when(mine, F.col("value"))).alias("source"), F.max(F.when(~mine, F.col("value"))).alias("reference"))
    whole = Window.partitionBy(key)
    return rows.withColumn("n_source", F.count("source").over(whole)).withColumn("n_reference", F.count("reference").over(whole))


def rmse_bias(reps: DataFrame, source: str, reference: str) -> DataFrame:
    """(set_id, n_source, n_reference, rmse, bias): null unless both sides have as many usable reps."""
    d = F.when((F.col("n_source") == F.col("n_reference")), F.col("source") - F.col("reference"))
    return paired(reps, source, reference).groupBy("set_id").agg(
        F.max("n_source").alias("n_source"), F.max("n_reference").alias("n_reference"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias")
    )


def compare_panel(reps: DataFrame, source: str, reference: str) -> DataFrame:
    """Agreement of two vendors a set: absolute measures only where counts match, shape measures always."""
    both = reps.where(F.col("vendor").isin(source, reference))
    shape = velocity_loss(both).join(theil_sen(both), list(KEYS))

    def side(vendor: str, name: str) -> DataFrame:
        return shape.where(F.col("vendor") == vendor).select("set_id", F.col("velocity_loss").alias(f"vl_{name}"), F.col("slope").alias(f"slope_{name}"))

    return (
        rmse_bias(reps, source, reference).join(side(source, "source"), "set_id", "left").join(side(reference, "reference"), "set_id", "left")
        .withColumn("aligned", (F.col("n_source") == F.col("n_reference")) & (F.col("n_source") > 0))
        .withColumn("vl_delta", F.col("vl_source") - F.col("vl_reference"))
        .withColumn("slope_delta", F.col("slope_source") - F.col("slope_reference"))
    )


def guarded_corr(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson's r; null under `least` pairs or where a side is constant (where corr would divide by 0)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sxy = F.avg(a * b) - F.avg(a) * F.avg(b)
    ok = (F.count(a) >= least) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(ok, sxy / (F.stddev_pop(a) * F.stddev_pop(b)))


def bland_altman(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, bias, rmse, r, limits of agreement (sample deviation), slope and intercept of source on reference."""
    d = F.col("source") - F.col("reference")
    both = pairs.where("source is not null and reference is not null")
    sd = F.stddev_samp(d)
    varied = F.stddev_pop("reference") > 0
    return both.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), guarded_corr(F.col("source"), F.col("reference"), 2).alias("r"),
        (F.avg(d) - 1.96 * sd).alias("loa_low"), (F.avg(d) + 1.96 * sd).alias("loa_high"),
        F.when(varied, F.regr_slope("source", "reference")).alias("slope"), F.when(varied, F.regr_intercept("source", "reference")).alias("intercept"),
    )


def strict_pairs(reps: DataFrame, source: str, reference: str) -> DataFrame:
    """Positional pairs; an error where counts differ or are under two."""
    ok = (F.col("n_source") == F.col("n_reference")) & (F.col("n_source") >= 2)
    return paired(reps, source, reference).withColumn("source", F.when(ok, F.col("source")).otherwise(F.raise_error(F.lit("counts differ")).cast("double")))


def head_pairs(reps: DataFrame, source: str, reference: str) -> DataFrame:
    """The first min(n, m) positions."""
    return paired(reps, source, reference).where("source is not null and reference is not null")


def tail_pairs(reps: DataFrame, source: str, reference: str, least: int = 8) -> DataFrame:
    """The last min(n, m) positions, counted from the end, of sets with at least `least` of them."""
    sides = numbered(reps.where(F.col("vendor").isin(source, reference)), KEYS, descending=True)
    mine = F.col("vendor") == source
    rows = sides.groupBy("set_id", "pos").agg(F.max(F.when(mine, F.col("value"))).alias("source"), F.max(F.when(~mine, F.col("value"))).alias("reference"))
    rows = rows.where("source is not null and reference is not null")
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("set_id"))).where(F.col("n") >= least)


def vendor_summary(reps: DataFrame) -> DataFrame:
    """Per set and vendor: usable reps, mean and best (3 places), last rep, loss (1 place)."""
    rows = reps.where(usable()).groupBy(*KEYS).agg(
        F.count("*").alias("n_reps"), F.avg("value").alias("mean_value"), F.max("value").alias("best"), F.max("rep").alias("last_rep"), _ordered(F.col("value"), F.lit(True)).alias("v")
    )
    return rows.select(*KEYS, "n_reps", "mean_value", "best", "last_rep", loss_of(F.col("v")).alias("velocity_loss"))


def common_window(reps: DataFrame) -> DataFrame:
    """Usable rows whose rep every vendor of the set has; sets of two vendors or more. One window a level of grouping."""
    good = reps.where(usable())
    vendors = F.size(F.collect_set("vendor").over(Window.partitionBy("set_id")))
    here = F.size(F.collect_set("vendor").over(Window.partitionBy("set_id", "rep")))
    return good.withColumn("vendors", vendors).withColumn("here", here).where("vendors >= 2 and here = vendors").drop("vendors", "here")


def pivot_reps(reps: DataFrame, vendors: Sequence[str]) -> DataFrame:
    """A column a vendor: full outer alignment on the rep. The vendors are given, so no job looks for them; the least row wins a tie."""
    return reps.where(usable()).groupBy("set_id", "rep").pivot("vendor", list(vendors)).agg(F.min_by("value", F.struct("value")))


def pick_reference(reps: DataFrame, preference: Sequence[str]) -> DataFrame:
    """(set_id, reference): the most preferred vendor present."""
    return reps.where(F.col("vendor").isin(*preference)).groupBy("set_id").agg(F.min_by("vendor", F.array_position(F.array(*map(F.lit, preference)), F.col("vendor"))).alias("reference"))


def agreement(reps: DataFrame, preference: Sequence[str]) -> DataFrame:
    """Per set and vendor, n, bias and rmse on the reps shared with the set's reference vendor."""
    good = reps.where(usable()).select("set_id", "vendor", "rep", "value")
    ref = pick_reference(reps.where(usable()), preference)
    of_ref = good.join(ref, "set_id").where("vendor = reference").select("set_id", "rep", "reference", F.col("value").alias("expected"))
    d = F.col("value") - F.col("expected")
    return good.join(of_ref, ["set_id", "rep"]).where("vendor <> reference").groupBy("set_id", "vendor", "reference").agg(
        F.count("*").alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse")
    )


def rom_prior(reps: DataFrame, by: str = "lift") -> DataFrame:
    """Exact quantiles a lift over positive usable values, with how many reps and sets they rest on. By places in a sort: a lift may hold any number of reps."""
    shares = {"median": 0.5, "q25": 0.25, "q75": 0.75, "p05": 0.05, "p95": 0.95}
    rows = reps.where(usable() & (F.col("value") > 0) & F.col(by).isNotNull()).select(by, "set_id", "value")
    counts = rows.groupBy(by, "set_id").agg(F.count("*").alias("n")).groupBy(by).agg(F.sum("n").alias("n_reps"), F.count("set_id").alias("n_sets"))
    return counts.join(order.quantiles(rows, by, "value", shares), by).select(by, "n_reps", "n_sets", *shares)


def reference_counts(reps: DataFrame, preference: Sequence[str]) -> DataFrame:
    """(set_id, gt_vendor, gt_count, rival, rival_count): the two most preferred vendors that have non-phantom reps."""
    counts = reps.where(F.coalesce("flag", F.lit("")) != "phantom").where(F.col("vendor").isin(*preference)).groupBy(*KEYS).count()
    place = F.array_position(F.array(*map(F.lit, preference)), F.col("vendor"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("set_id").orderBy(place)))
    first = lambda n, c: F.max(F.when(F.col("r") == n, F.col(c)))
    return ranked.groupBy("set_id").agg(first(1, "vendor").alias("gt_vendor"), first(1, "count").alias("gt_count"), first(2, "vendor").alias("rival"), first(2, "count").alias("rival_count"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of weight times value over sum of weights, of finite values; null for none."""
    ok = value.isNotNull() & ~F.isnan(value)
    return F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def leave_one_out(items: DataFrame, group: str, value: str = "value") -> DataFrame:
    """Fits a mean on all other groups and scores each group's rows by their absolute error.

    (group, n, blind, in_sample): the held-out fit is the total less the group's own share, so no group is collected.
    """
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = items.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    per = per.withColumn("total", F.sum("s").over(whole)).withColumn("all", F.sum("n").over(whole))
    fits = per.select(group, F.try_divide(F.col("total") - F.col("s"), (F.col("all") - F.col("n")).cast("double")).alias("others"), (F.col("total") / F.col("all")).alias("everyone"))
    return items.join(fits, group).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(F.abs(F.col(value) - F.col("others"))).alias("blind"), F.avg(F.abs(F.col(value) - F.col("everyone"))).alias("in_sample")
    )


def leave_one_out_median(items: DataFrame, group: str, value: str = "value") -> DataFrame:
    """(group, n, others, blind): each group's rows scored by their absolute error from the median of all other groups, for any number of groups in one plan."""
    others = order.others_median(items, group, value).withColumnRenamed(group, "_g")
    return items.join(others, F.col(group).eqNullSafe(F.col("_g"))).groupBy(group).agg(
        F.count(value).alias("n"), F.first("others").alias("others"), F.avg(F.abs(F.col(value) - F.col("others"))).alias("blind")
    )


def leave_one_out_with(items: DataFrame, group: str, fit, score, most: int = 64) -> DataFrame:
    """The general form: fit(DataFrame) gives parameters of any kind, score(DataFrame, parameters) a DataFrame of held-out scores.

    One pass a group on the driver's plan, so meant for a few groups (lifts, athletes), as its callers have; more than `most` raise.
    """
    names = [r[0] for r in items.select(group).distinct().orderBy(group).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} groups; leave_one_out takes any number")
    out = None
    for name in names:
        held = items.where(F.col(group).eqNullSafe(F.lit(name)))
        part = score(held, fit(items.where(~F.col(group).eqNullSafe(F.lit(name)))))
        out = part if out is None else out.unionByName(part)
    return out


def board_cells(reps: DataFrame, places: int = 2) -> DataFrame:
    """(set_id, vendor, cell): count, a mark if a row says undercount, and the mean of non-phantom rows, halves up."""
    rows = reps.where(F.coalesce("flag", F.lit("")) != "phantom").groupBy(*KEYS).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.max((F.coalesce("flag", F.lit("")) == "undercount").cast("int")).alias("u"))
    return rows.select(*KEYS, F.concat(F.col("n").cast("string"), F.when(F.col("u") == 1, "!").otherwise(""), F.lit("·"), F.format_string(f"%.{places}f", F.round(F.col("m") + TIE, places))).alias("cell"))


def noise_fused(reps: DataFrame, one: str, two: str) -> DataFrame:
    """Two vendors of equal counts fused by the inverse variance of their successive differences.

    The second is first put on the first's mean and deviation. (set_id, pos, fused)
    """
    pairs = paired(reps, one, two).where("n_source = n_reference and n_source >= 3")
    order, whole = Window.partitionBy("set_id").orderBy("pos"), Window.partitionBy("set_id")
    z = (F.col("reference") - F.avg("reference").over(whole)) / (F.stddev_pop("reference").over(whole) + 1e-9)
    scaled = pairs.withColumn("b", z * F.stddev_pop("source").over(whole) + F.avg("source").over(whole))
    steps = scaled.withColumn("da", F.col("source") - F.lag("source").over(order)).withColumn("db", F.col("b") - F.lag("b").over(order))
    wa, wb = 1 / (F.var_pop("da").over(whole) + 1e-9), 1 / (F.var_pop("db").over(whole) + 1e-9)
    return steps.select("set_id", "pos", ((F.col("source") * wa + F.col("b") * wb) / (wa + wb)).alias("fused"))


def watch_board(pairs: DataFrame) -> DataFrame:
    """Per set: rmse, calibrated rmse (population deviation of the differences), guarded r, bias."""
    d = F.col("source") - F.col("reference")
    return pairs.groupBy("set_id").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.stddev_pop(d).alias("rmse_calibrated"),
        guarded_corr(F.col("source"), F.col("reference"), 3).alias("r"), F.avg(d).alias("bias"),
    )


def watch_board_pooled(pairs: DataFrame, by: str = "lift") -> DataFrame:
    """Per lift, and over all (null) with each lift's own bias removed."""
    d = F.col("source") - F.col("reference")
    rows = pairs.select(by, d.alias("d")).withColumn("e", F.col("d") - F.avg("d").over(Window.partitionBy(by)))
    lifts = rows.groupBy(by).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.stddev_pop("d").alias("rmse_calibrated"), F.avg("d").alias("bias"))
    whole = rows.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.stddev_pop("e").alias("rmse_calibrated"), F.avg("d").alias("bias"))
    return lifts.unionByName(whole.withColumn(by, F.lit(None).cast(rows.schema[by].dataType)))


def count_board(counts: DataFrame, by: str = "lift") -> DataFrame:
    """Of (by, n_found, n_true, bias): exact share, mean absolute count error, mean bias of those that have one."""
    delta = F.col("n_found") - F.col("n_true")
    return counts.groupBy(by).agg(
        F.count("*").alias("sets"), F.avg((delta == 0).cast("double")).alias("exact"), F.avg(F.abs(delta).cast("double")).alias("mean_abs_delta"), F.avg("bias").alias("mean_bias")
    )


def velocity_board(reps: DataFrame, source: str, rival: str, reference: str, target: float = 0.05) -> DataFrame:
    """Per set: errors of a source and a rival against the reference, and who wins at the greater of the rival's error and the target."""
    loss = velocity_loss(reps).select("set_id", "vendor", "velocity_loss")
    means = reps.where(usable()).groupBy(*KEYS).agg(F.avg("value").alias("m"))
    rows = loss.join(means, list(KEYS))

    def side(v: str, name: str) -> DataFrame:
        return rows.where(F.col("vendor") == v).select("set_id", F.col("velocity_loss").alias(f"vl_{name}"), F.col("m").alias(f"m_{name}"))

    out = side(source, "s").join(side(reference, "r"), "set_id").join(side(rival, "c"), "set_id", "left")
    bar = F.least(F.abs(F.col("m_c") - F.col("m_r")), F.lit(target))
    return out.select(
        "set_id", F.abs(F.col("vl_s") - F.col("vl_r")).alias("loss_error"), F.abs(F.col("vl_c") - F.col("vl_r")).alias("rival_loss_error"),
        F.abs(F.col("m_s") - F.col("m_r")).alias("mean_error"), F.abs(F.col("m_c") - F.col("m_r")).alias("rival_mean_error"),
        (F.abs(F.col("m_s") - F.col("m_r")) <= bar).alias("wins"),
    )


def consensus(left: DataFrame, right: DataFrame, tolerance: int = 2, agree: float = 0.15, visible: float = 0.6) -> DataFrame:
    """Two estimates (set_id, n, mean[, visibility]) of a set: which spine to take, and how sure it is."""
    a = left.select("set_id", F.col("n").alias("n_a"), F.col("mean").alias("mean_a"), "visibility")
    b = right.select("set_id", F.col("n").alias("n_b"), F.col("mean").alias("mean_b"))
    both = a.join(b, "set_id", "full")
    near = (F.abs(F.col("n_a") - F.col("n_b")) <= tolerance) & (F.col("visibility") >= visible)
    rel = F.try_divide(F.abs(F.col("mean_a") - F.col("mean_b")), F.col("mean_b"))
    return both.select(
        "set_id", F.when(near, "pose").otherwise("fallback").alias("spine"),
        F.when(near & (rel < agree), "HIGH").when(near, "MEDIUM").otherwise("LOW").alias("confidence"),
    )
