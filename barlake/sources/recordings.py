"""Motion, heart-rate and sidecar files, and the writers that match them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import GRAVITY, watch_file
from ..schemas import HEART_RATE, IMU_COLUMNS, IMU_OPTIONAL, IMU_REQUIRED, RECORDING

_FILE = "_metadata.file_name"


def read_motion(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, columns of a motion sample) of CSV files, each by its own header, so files of different columns or orders may lie in one folder.

    A file without a header has the fixed order, 11 columns or more. Optional columns are 0 where absent; blank lines are
    skipped. A missing required column is an error that names it; a required cell that is no number too.
    """
    name = F.col("_metadata.file_path")
    lines = spark.read.text(path).select(name.alias("file"), "value").where("trim(value) <> ''")
    split = F.transform(F.split("value", ","), lambda c: F.trim(c))
    heads = lines.where("value like '%ua_x%'").groupBy("file").agg(F.min(split).alias("head"))
    odd = heads.where(~F.forall(F.array(*map(F.lit, IMU_REQUIRED)), lambda c: F.array_contains("head", c))).first()
    if odd:
        raise ValueError(f"missing columns in {odd['file']}: {[c for c in IMU_REQUIRED if c not in odd['head']]}")
    fixed = F.array(*map(F.lit, IMU_COLUMNS))
    rows = lines.where("value not like '%ua_x%'").join(heads, "file", "left").select("file", F.coalesce("head", fixed).alias("head"), split.alias("cells"))
    bad = F.raise_error(F.lit("bad required cell")).cast("double")
    at = lambda c: F.try_element_at("cells", F.nullif(F.array_position("head", F.lit(c)), F.lit(0)).cast("int")).try_cast("double")
    cells = [F.coalesce(at(c), bad if c in IMU_REQUIRED else F.lit(0.0)).alias(c) for c in IMU_COLUMNS]
    return rows.select(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.csv$", "").alias("recording_id"), *cells)


def motion_line() -> Column:
    """A sample as a line of the motion file: six places each."""
    return F.concat_ws(",", *[F.format_string("%.6f", F.col(c)) for c in IMU_COLUMNS])


def motion_text(rows: DataFrame, key: str = "recording_id") -> DataFrame:
    """(key, text): a whole file a recording, header first, newline last. A recording is one file, so one group."""
    ordered = F.array_sort(F.collect_list(F.struct("t", motion_line().alias("line"))))
    body = F.array_join(F.transform(ordered, lambda r: r["line"]), "\n")
    return rows.groupBy(key).agg(F.concat(F.lit(",".join(IMU_COLUMNS) + "\n"), body, F.lit("\n")).alias("text"))


def write_motion(rows: DataFrame, path: str, key: str = "recording_id") -> None:
    """A folder a recording, headed CSV in time order; the job's commit makes it appear as a whole."""
    out = rows.select(key, *[F.format_string("%.6f", F.col(c)).alias(c) for c in IMU_COLUMNS])
    out.repartition(key).sortWithinPartitions(key, F.col("t").cast("double")).write.partitionBy(key).option("header", "true").mode("overwrite").csv(path)


def read_heart_rate(spark: SparkSession, path: str) -> DataFrame:
    """(workout_id, t, utc, bpm); malformed rows go."""
    lines = spark.read.text(path).select(F.regexp_replace(_FILE, r"\.csv$", "").alias("workout_id"), F.split("value", ",").alias("p"))
    rows = lines.where(F.size("p") == 3).select(
        "workout_id", F.col("p")[0].try_cast("double").alias("t"), F.try_to_timestamp(F.col("p")[1]).alias("utc"), F.col("p")[2].try_cast("double").alias("bpm")
    )
    return rows.where("t is not null and utc is not null and bpm is not null")


def heart_rate_line() -> Column:
    return F.concat_ws(",", F.format_string("%.3f", "t"), F.date_format("utc", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.format_string("%.1f", "bpm"))


def write_heart_rate(rows: DataFrame, path: str, key: str = "workout_id") -> None:
    """A folder a workout with its beats (key, t, utc, bpm) in time order, under the header of the format."""
    out = rows.select(key, F.col("t").alias("_t"), heart_rate_line().alias("line"))
    heads = rows.select(key).distinct().select(key, F.lit(None).cast("double").alias("_t"), F.lit("t,utc,bpm").alias("line"))
    both = heads.unionByName(out).repartition(key).sortWithinPartitions(key, F.col("_t").asc_nulls_first())
    both.select(key, F.col("line").alias("value")).write.partitionBy(key).mode("overwrite").text(path)


def write_session(samples: DataFrame, sidecars: DataFrame, folder: str, key: str = "recording_id") -> None:
    """A recording's samples and its envelope under the same stem: folder/samples and folder/sidecars, a file a recording."""
    write_motion(samples, f"{folder}/samples", key)
    names = sorted(c for c in sidecars.columns if c != key)
    lines = sidecars.select(key, F.to_json(F.struct(*names), {"pretty": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}).alias("value"))
    lines.repartition(key).write.partitionBy(key).mode("overwrite").text(f"{folder}/sidecars")


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Recording envelopes, one JSON object a file: start and stop as timestamps whether written as text or as seconds since 2001."""
    rows = spark.read.schema(RECORDING).option("multiLine", "true").json(path).withColumn("recording_id", F.regexp_replace(_FILE, r"\.json$", ""))
    for c in ("startedAt", "stoppedAt"):
        since = F.timestamp_seconds(F.col(c).try_cast("double") + 978307200)
        rows = rows.withColumn(c, F.coalesce(since, F.try_to_timestamp(F.col(c))))
    return rows.withColumn("osVersion", F.coalesce("osVersion", "watchOSVersion")).drop("watchOSVersion")


def write_sidecar(rows: DataFrame, path: str) -> None:
    names = sorted(rows.columns)
    rows.select(F.to_json(F.struct(*names), {"pretty": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'"}).alias("value")).write.mode("overwrite").text(path)


def with_utc(samples: DataFrame, sidecars: DataFrame, key: str = "recording_id") -> DataFrame:
    """Adds utc: the start plus the uptime since the clock anchor, to the nearest microsecond; null without a sidecar or an anchor."""
    anchors = sidecars.select(key, "startedAt", "clockAnchorUptimeSeconds")
    # in whole microseconds: seconds since 1970 as a double are too coarse
    at = F.timestamp_micros(F.unix_micros("startedAt") + F.round((F.col("t") - F.col("clockAnchorUptimeSeconds")) * 1e6).cast("long"))
    return samples.join(anchors, key, "left").withColumn("utc", at).drop("startedAt", "clockAnchorUptimeSeconds")


def has_gyro(samples: DataFrame, key: str = "recording_id") -> DataFrame:
    return samples.groupBy(key).agg(F.bool_or((F.col("rr_x") != 0) | (F.col("rr_y") != 0) | (F.col("rr_z") != 0)).alias("has_gyro"))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, set_id, vendor) of the watch recordings in a folder; names only, nothing is parsed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_watch*.csv").load(folder)
    named = files.select("path", watch_file(F.element_at(F.split("path", "/"), -1)).alias("f")).where("f is not null")
    return named.select("path", "f.set_id", "f.vendor")


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, csv, json, size, size_label, modified), newest first: pairs of files that landed."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(csv|json)$", "")
    pairs = files.groupBy(stem.alias("stem")).agg(
        F.max(F.when(F.col("path").endswith(".csv"), F.col("path"))).alias("csv"), F.max(F.when(F.col("path").endswith(".json"), F.col("path"))).alias("json"),
        F.sum("length").alias("size"), F.max("modificationTime").alias("modified"),
    )
    label = F.when(F.col("size") < 1_000_000, F.format_string("%.0f KB", F.col("size") / 1e3)).otherwise(F.format_string("%.1f MB", F.col("size") / 1e6))
    return pairs.withColumn("size_label", label).orderBy(F.col("modified").desc(), "stem")


def files_with_hash(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of every file."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def resolved_clips(spark: SparkSession, manifest: DataFrame, folders: list[str]) -> DataFrame:
    """(filename, path, sha256, found, intact) of each manifest row (filename, sha256): the first folder that has the file; intact: the hash agrees, null where none is on record."""
    seen = None
    for rank, folder in enumerate(folders):
        one = files_with_hash(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(rank).alias("rank"), "path", F.col("sha256").alias("actual"))
        seen = one if seen is None else seen.unionByName(one)
    best = seen.groupBy("filename").agg(F.min_by(F.struct("path", "actual"), "rank").alias("f"))
    rows = manifest.select("filename", "sha256").join(best, "filename", "left")
    return rows.select("filename", "f.path", "sha256", F.col("f").isNotNull().alias("found"), (F.col("f.actual") == F.nullif("sha256", F.lit(""))).alias("intact"))


def synthetic_sets(sets: DataFrame, noise_g: float = 0.0, seed: int = 0) -> DataFrame:
    """Motion recordings of known velocity, one for each row (recording_id, n_reps, peak, period, fs): v = peak sin(2 pi t / period) upwards, gravity along -z, unit attitude."""
    w = F.lit(2 * math.pi) / F.col("period")
    rows = sets.select("*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n_reps") * F.col("period") * F.col("fs") + 1e-9).cast("long"))).alias("_i")).withColumn("t", F.col("_i") / F.col("fs"))
    noise = lambda k: F.randn(seed + k) * noise_g if noise_g else F.lit(0.0)
    zero = [F.lit(0.0).alias(c) for c in ("g_x", "g_y")]
    return rows.select(
        "recording_id", "t", noise(1).alias("ua_x"), noise(2).alias("ua_y"), (F.col("peak") * w * F.cos(w * F.col("t")) / GRAVITY + noise(3)).alias("ua_z"), *zero, F.lit(-1.0).alias("g_z"),
        F.lit(1.0).alias("q_w"), *[F.lit(0.0).alias(c) for c in ("q_x", "q_y", "q_z", *IMU_OPTIONAL)],
    )


def synthetic_set(spark: SparkSession, n_reps: int = 5, peak: float = 0.8, period: float = 2.0, fs: float = 200.0, noise_g: float = 0.0, seed: int = 0) -> DataFrame:
    """One such recording."""
    one = spark.range(1).select(F.lit("synthetic").alias("recording_id"), F.lit(n_reps).alias("n_reps"), F.lit(float(peak)).alias("peak"), F.lit(float(period)).alias("period"), F.lit(float(fs)).alias("fs"))
    return synthetic_sets(one, noise_g, seed)


__all__ = ["HEART_RATE", "discover", "files_with_hash", "has_gyro", "heart_rate_line", "landing", "motion_line", "motion_text", "read_heart_rate", "read_motion", "read_sidecar", "resolved_clips", "synthetic_set", "synthetic_sets", "with_utc", "write_heart_rate", "write_motion", "write_session", "write_sidecar"]
