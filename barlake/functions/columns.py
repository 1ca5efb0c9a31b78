"""Column expressions. None of them needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import INVALID_FLAGS, LIFT_CODES

GRAVITY = 9.80665
#: A half that is rounded, or a bound that is reached, but for the rounding of doubles, is one; values of two places average to such ties.
TIE = 1e-9
#: Two constants on purpose: each belongs to its own importer.
LB_KG, KG_LB = 0.45359, 2.2046226

# Outer plate diameters in metres by plate size.
IRON_LB = {45.0: 0.450, 35.0: 0.415, 25.0: 0.390, 10.0: 0.250, 5.0: 0.205, 2.5: 0.160}
IRON_KG = {20.0: 0.450, 15.0: 0.400, 10.0: 0.350, 5.0: 0.230, 2.5: 0.190, 1.25: 0.160}
BUMPER = 0.450
# Body segments as fractions of height.
SEGMENTS = {"forearm": 0.146, "upper_arm": 0.186, "hand": 0.108}
# Weight of a lift's tier, by code.
LIFT_WEIGHTS = {"SQ": 1.0, "BN": 1.0, "IB": 1.0, "DL": 1.0, "ROW": 0.5, "RDL": 0.5, "SC": 0.25}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """NaN becomes null, the mark of an undefined measure."""
    return F.when(~F.isnan(_c(x)), _c(x))


def usable(value: Column | str = "value", flag: Column | str = "flag") -> Column:
    """Neither null nor NaN, and not flagged as phantom or missed."""
    v = _c(value)
    return v.isNotNull() & ~F.isnan(v) & ~F.coalesce(_c(flag), F.lit("")).isin(*INVALID_FLAGS)


def vertical_acceleration() -> Column:
    """Acceleration along the gravity vector, up positive, in m/s2, of a motion sample."""
    norm = F.sqrt(sum((F.col(f"g_{k}") * F.col(f"g_{k}") for k in "xyz"), F.lit(0.0)))
    along = sum((F.col(f"ua_{k}") * F.col(f"g_{k}") for k in "xyz"), F.lit(0.0))
    return -(along / F.when(norm == 0, 1.0).otherwise(norm)) * GRAVITY


def lift_code(set_id: Column | str = "set_id") -> Column:
    """Second part of a set id; null if there is none."""
    return F.try_element_at(F.split(_c(set_id), "-"), F.lit(2))


def lift_weight(code: Column) -> Column:
    """Main lifts 1, accessories a quarter, anything else a half."""
    out = F.lit(0.5)
    for name, weight in LIFT_WEIGHTS.items():
        out = F.when(code == name, weight).otherwise(out)
    return out


def lift_name(code: Column) -> Column:
    out = code
    for short, name in LIFT_CODES.items():
        out = F.when(F.upper(code) == short, name).otherwise(out)
    return out


def effective_lift_code(code: Column, custom: Column) -> Column:
    given = F.nullif(F.trim(custom), F.lit(""))
    return F.when((code == "OTHER") & given.isNotNull(), F.upper(given)).otherwise(code)


def provenance(seed: Column, rim: Column, band: Column, scale: Column) -> Column:
    """How much a human helped: with the scale or band, with the seed or rim, or not at all."""
    return F.when(band | scale, "ORACLE").when(seed | rim, "SIMULATED_TAP").otherwise("SEED_FREE")


def nearest(table: dict[float, float], key: Column) -> Column:
    """Value of the table's nearest key; of two as near, the one listed first."""
    rows = F.array(*[F.struct(F.abs(key - F.lit(k)).alias("d"), F.lit(n).alias("n"), F.lit(v).alias("v")) for n, (k, v) in enumerate(table.items())])
    return F.array_min(rows)["v"]


def plate_diameter(top: Column, kind: Column, unit: Column) -> Column:
    """(metres, confidence) of the largest plate; null for an unknown kind."""
    kg = F.when(unit == "lb", top / KG_LB).otherwise(top)
    bumper = F.when(kg >= 9.5, F.struct(F.lit(BUMPER).alias("m"), F.lit(0.95).alias("confidence"))).otherwise(
        F.struct(F.lit(max(0.30, BUMPER * 0.6)).alias("m"), F.lit(0.6).alias("confidence"))
    )
    iron = F.struct(F.when(unit == "lb", nearest(IRON_LB, top)).otherwise(nearest(IRON_KG, top)).alias("m"), F.lit(0.7).alias("confidence"))
    return F.when(F.lower(kind) == "bumper", bumper).when(F.lower(kind) == "iron", iron)


def largest_plate(plates: Column) -> Column:
    return F.array_max(plates)


def angle_policy(angle: Column) -> Column:
    """(valid, confidence, needs_anchor) of a camera angle; null for an unknown one."""
    row = lambda v, c, n: F.struct(F.lit(v).alias("valid"), F.lit(c).alias("confidence"), F.lit(n).alias("needs_anchor"))
    return F.when(angle == "side", row(True, 1.0, False)).when(angle == "diagonal", row(True, 0.7, True)).when(angle == "front", row(False, 0.0, False))


def scale_confidence(top: Column, kind: Column, unit: Column, angle: Column) -> Column:
    return plate_diameter(top, kind, unit)["confidence"] * angle_policy(angle)["confidence"]


def metres_per_pixel(metres: Column, pixels: Column) -> Column:
    """Null where the pixels are not positive."""
    return F.when(pixels > 0, metres / pixels)


def segment_metres_per_pixel(height_m: Column, segment: str, pixels: Column) -> Column:
    return metres_per_pixel(height_m * SEGMENTS[segment], pixels)


def is_4k(resolution: Column | str) -> Column:
    """Longer side of WxH at least 2560; false where it cannot be read."""
    side = F.split(F.lower(_c(resolution)), "x")
    w, h = (F.try_element_at(side, F.lit(k)).try_cast("int") for k in (1, 2))
    return F.coalesce((F.size(side) == 2) & w.isNotNull() & h.isNotNull() & (F.greatest(w, h) >= 2560), F.lit(False))


def regime_hint(velocities: Column) -> Column:
    """Rough kind of a set from its mean velocities: loss against the two slowest, which is not the velocity loss."""
    top, low = F.array_max(velocities), F.slice(F.array_sort(velocities), 1, 2)
    loss = (top - F.aggregate(low, F.lit(0.0), lambda a, x: a + x) / 2) / top
    ok = (F.size(velocities) >= 3) & (top > 0)
    return F.when(ok & (top > 0.7) & (loss < 0.10), "speed_work?").when(ok & (loss > 0.15), "normal?").otherwise("")


def loss_window_label(n: Column, k: int = 2) -> Column:
    """Names the terminal window of a velocity loss over n reps."""
    used = F.greatest(F.lit(1), F.least(F.lit(k), n - 1))
    return F.when(used == 1, F.format_string("best→rep%d", n)).otherwise(F.format_string("best→mean(rep%d–%d)", n - used + 1, n))


def header_has(name: Column, *parts: str) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.contains(F.lower(name), F.lit(p.lower()))
    return out


def unit_in_header(name: Column) -> Column:
    """Last item of the parentheses of a header such as ``velocity (vertical, m/s)``; empty if there is one item only."""
    inner = F.regexp_extract(name, r"\(([^)]*)\)", 1)
    return F.when(F.contains(inner, F.lit(",")), F.lower(F.trim(F.element_at(F.split(inner, ","), -1)))).otherwise("")


def infer_set_id(filename: Column | str) -> Column:
    """Leading date, lift code and number of a file name; second-athlete and underscore names too; else empty."""
    return F.regexp_extract(_c(filename), r"^(\d{8}[a-z]?-[A-Za-z]{2,3}(?:-[A-Z]{2})?[-_]\d+)", 1)


def watch_file(name: Column | str) -> Column:
    """(set_id, vendor) of a watch recording's file name; null for other files."""
    n = _c(name)
    hit = F.regexp_extract(n, r"^(.+?)_watch(_bar)?\.csv$", 1)
    vendor = F.when(F.regexp_extract(n, r"^(.+?)_watch(_bar)?\.csv$", 2) == "_bar", "watch_bar").otherwise("watch_imu")
    return F.when(hit != "", F.struct(hit.alias("set_id"), vendor.alias("vendor")))


def watch_stem(date: Column, code: Column, index: Column, bar: bool = False) -> Column:
    return F.concat(F.date_format(date, "yyyyMMdd"), F.lit("-"), code, F.lit("-"), index.cast("string"), F.lit("_watch_bar" if bar else "_watch"))


def heart_rate_stem(date: Column, index: Column) -> Column:
    """The first of a day bears no number."""
    return F.concat(F.date_format(date, "yyyyMMdd"), F.lit("-workout_hr"), F.when(index > 1, F.concat(F.lit("-"), index.cast("string"))).otherwise(""))


def legacy_stem(started: Column, exercise: Column, session_id: Column) -> Column:
    stamp = F.date_format(started, "yyyyMMdd'T'HHmmss")
    return F.concat(F.lit("VBT_"), stamp, F.lit("Z_"), F.regexp_replace(exercise, r"\s+", "-"), F.lit("_"), F.substring(session_id, 1, 8))


def half_even(x: Column, places: int) -> Column:
    """Rounds halves to the even digit, on the decimal text of x."""
    return F.bround(x, places)


def metres_to_cm(x: Column) -> Column:
    return x * 100


def ms_to_s(x: Column) -> Column:
    return x / 1000


def kg_to_lb(x: Column) -> Column:
    return x / LB_KG


def mean_if(total: Column, n: Column) -> Column:
    return F.try_divide(total, n)


__all__ = [n for n, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not n.startswith("_")] + ["GRAVITY", "LB_KG", "KG_LB"]
