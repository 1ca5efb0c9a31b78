"""The two reports on a corpus: what its boards miss, and what there is of each set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import estimates

#: Widths and heights that begin the size of a clip which has to be transcoded before it can be scored.
LARGE = ("3840", "2160")


def _keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key).where(F.col(key).isNotNull()).distinct()


def coverage_gaps(truth: DataFrame, videos: DataFrame, watches: DataFrame, video_board: DataFrame, watch_board: DataFrame, objects: DataFrame | None = None, key: str = "set_id") -> DataFrame:
    """(section, item, vendors, resolution, large, gap): all that the boards should hold and do not.

    truth: (key, vendor) rows; videos: (key, resolution), resolution null for a local file; watches and boards: (key).
    Sections: ``video`` (a clip with truth that the video board lacks), ``watch`` (a recording that the watch board lacks),
    ``object`` (of objects (name), one whose name no video row has as its file: no section without objects), ``no_signal`` (truth
    without clip and recording: told, but no gap). Null keys are nothing; a set of several clips takes the greatest resolution.
    """
    vendors = truth.where(F.col(key).isNotNull()).groupBy(key).agg(F.concat_ws(",", F.array_sort(F.collect_set("vendor"))).alias("vendors"))
    clips = videos.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("resolution").alias("resolution"))
    recorded, seen, heard = _keys(watches, key), _keys(video_board, key), _keys(watch_board, key)

    def rows(found: DataFrame, section: str, gap: bool = True) -> DataFrame:
        size = F.col("resolution") if "resolution" in found.columns else F.lit(None).cast("string")
        large = F.coalesce(F.substring(size, 1, 4).isin(*LARGE), F.lit(False))
        names = F.col("vendors") if "vendors" in found.columns else F.lit(None).cast("string")
        return found.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("item"), names.alias("vendors"), size.alias("resolution"), large.alias("large"), F.lit(gap).alias("gap"))

    local = clips.withColumn("resolution", F.coalesce("resolution", F.lit("local")))
    out = rows(local.join(vendors, key).join(seen, key, "left_anti"), "video")
    out = out.unionByName(rows(recorded.join(heard, key, "left_anti").join(vendors, key, "left"), "watch"))
    out = out.unionByName(rows(vendors.join(clips, key, "left_anti").join(recorded, key, "left_anti"), "no_signal", gap=False))
    if objects is not None:
        files = videos.select(F.col("file").alias("name")).where("name is not null").distinct()
        lost = _keys(objects, "name").join(files, "name", "left_anti").withColumnRenamed("name", key)
        out = out.unionByName(rows(lost, "object"))
    return out


def coverage_summary(gaps: DataFrame) -> DataFrame:
    """(section, items, large, gaps) of ``coverage_gaps``, and a row ``all``; complete where its gaps are 0."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    every = [F.count("*").alias("items"), count(F.col("large")).alias("large"), count(F.col("gap")).alias("gaps")]
    return gaps.groupBy("section").agg(*every).unionByName(gaps.agg(*every).select(F.lit("all").alias("section"), "items", "large", "gaps"))


def inventory_rows(sets: DataFrame, reps: DataFrame, stored: DataFrame, local: DataFrame, video_counts: DataFrame, watch_counts: DataFrame, truths: list[str], other: str, dash: str = "—", key: str = "set_id") -> DataFrame:
    """A row a set, as text: (key, date, lift, set_index, reps, truth, video, other, auto, watch_auto, watch_adjusted, has_truth, has_video, has_watch).

    reps: (key, vendor, flag), phantoms not counted; truth names the first of the vendors ``truths`` that has reps, with their number, other is the
    number of another vendor's. video: ``store`` before ``git`` before a dash. auto: the video's count, ``?`` where a clip has none yet. A set without
    its number of reps shows ``?``. A dash stands for what there is not.
    """
    real = reps.where(F.coalesce(F.col("flag"), F.lit("")) != "phantom")
    n_of = lambda v: F.nullif(F.count_if(F.col("vendor") == v), F.lit(0).cast("long")).alias(f"_n_{v}")
    counts = real.groupBy(key).agg(*[n_of(v) for v in dict.fromkeys([*truths, other])])
    marks = lambda rows, name: _keys(rows, key).withColumn(name, F.lit(True))
    rows = sets.join(counts, key, "left").join(marks(stored, "_s"), key, "left").join(marks(local, "_l"), key, "left")
    rows = rows.join(video_counts.select(key, F.col("count").alias("_auto")), key, "left").join(watch_counts.select(key, F.col("auto").alias("_wa"), F.col("adjusted").alias("_wd")), key, "left")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(dash))
    truth: Column = F.coalesce(*[F.when(F.col(f"_n_{v}").isNotNull(), F.concat(F.lit(f"{v} "), F.col(f"_n_{v}").cast("string"))) for v in truths])
    video = F.when(F.col("_s"), "store").when(F.col("_l"), "git")
    return rows.select(
        key, F.col("date").cast("string").alias("date"), "lift", F.col("set_index").cast("string").alias("set_index"), F.coalesce(F.col("actual_reps").cast("string"), F.lit("?")).alias("reps"),
        text(truth).alias("truth"), text(video).alias("video"), text(F.col(f"_n_{other}")).alias("other"), F.coalesce(F.col("_auto").cast("string"), F.when(video.isNotNull(), "?"), F.lit(dash)).alias("auto"),
        text(F.col("_wa")).alias("watch_auto"), text(F.col("_wd")).alias("watch_adjusted"), truth.isNotNull().alias("has_truth"), video.isNotNull().alias("has_video"), F.col("_wa").isNotNull().alias("has_watch"),
    )


def inventory_lines(rows: DataFrame) -> DataFrame:
    """(n, line) of ``inventory_rows`` as a Markdown table by date, lift and number, and a last line of totals (n is null)."""
    shown = {c: "%s" for c in ("date", "lift", "set_index", "reps", "truth", "video", "other", "auto", "watch_auto", "watch_adjusted")}
    table = estimates.report(rows, shown, ["date", "lift", "set_index", "set_id"])
    totals = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in ("has_truth", "has_video", "has_watch")])
    line = F.format_string("%d sets, %d with truth, %d with video, %d with watch", "n", "has_truth", "has_video", "has_watch")
    return table.unionByName(totals.select(F.lit(None).cast("int").alias("n"), line.alias("line")))
