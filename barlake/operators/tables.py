"""Keeping tidy tables: replace by key, upsert, append if absent, constraints, governance joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WATCH_VENDORS = ("watch_imu", "watch_bar")


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("set_id", "vendor")) -> DataFrame:
    """Rows of old whose key is not in new, and all of new: running it again changes nothing."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def replace_watch(old: DataFrame, new: DataFrame) -> DataFrame:
    """Watch rows of a touched set all go, of either watch vendor."""
    touched = new.select("set_id").distinct().withColumn("_t", F.lit(True))
    kept = old.join(touched, "set_id", "left").where(~(F.coalesce("_t", F.lit(False)) & F.col("vendor").isin(*WATCH_VENDORS))).drop("_t")
    return kept.select(*old.columns).unionByName(new)


def append_absent(old: DataFrame, new: DataFrame, key: str = "set_id") -> DataFrame:
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, technical: Sequence[str]) -> DataFrame:
    """Technical columns follow new where it has a value; all others keep what old holds and are filled only if null."""
    other = new.select(key, *[F.col(c).alias(f"_{c}") for c in new.columns if c != key])
    both = old.join(other, key, "full")
    columns = []
    for c in old.columns:
        if c != key and f"_{c}" in both.columns:
            first, second = (f"_{c}", c) if c in technical else (c, f"_{c}")
            columns.append(F.coalesce(first, second).alias(c))
        else:
            columns.append(F.col(c))
    return both.select(*columns).orderBy(key)


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def foreign_key_breaks(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def primary_key_breaks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def nullified(rows: DataFrame) -> DataFrame:
    """Empty text becomes null."""
    return rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def save(rows: DataFrame, name: str, partition_by: Sequence[str] = ("vendor",), replace_partitions: bool = True) -> None:
    """A managed Parquet table; once it exists, only the partitions that rows touch are overwritten."""
    if replace_partitions and rows.sparkSession.catalog.tableExists(name):
        conf, key = rows.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(key)
        conf.set(key, "dynamic")
        try:
            rows.select(*rows.sparkSession.table(name).columns).write.insertInto(name, overwrite=True)
        finally:
            conf.set(key, before)
    else:
        rows.write.format("parquet").mode("overwrite").partitionBy(*partition_by).saveAsTable(name)


def coverage(truth: DataFrame, board: DataFrame, key: str = "set_id") -> DataFrame:
    """(key, gap): keys with truth that no board row has, and board rows without truth."""
    one = truth.select(key).distinct().join(board.select(key).distinct(), key, "left_anti").withColumn("gap", F.lit("not_on_board"))
    two = board.select(key).distinct().join(truth.select(key).distinct(), key, "left_anti").withColumn("gap", F.lit("no_truth"))
    return one.union(two)


def inventory(sets: DataFrame, counts: DataFrame, manifest: DataFrame, local: DataFrame, key: str = "set_id") -> DataFrame:
    """A row a set: its counts and where its files are; the store counts before the local copy, a dash for neither."""
    place = F.when(F.col("_m"), "store").when(F.col("_l"), "local").otherwise("-")
    rows = sets.join(counts, key, "left").join(manifest.select(key).distinct().withColumn("_m", F.lit(True)), key, "left").join(local.select(key).distinct().withColumn("_l", F.lit(True)), key, "left")
    return rows.withColumn("place", place).drop("_m", "_l")


def next_index(existing: DataFrame, keys: Sequence[str] = ("date", "code"), index: str = "set_index") -> DataFrame:
    """The number after the greatest of each key; gaps are not filled."""
    return existing.groupBy(*keys).agg((F.coalesce(F.max(index), F.lit(0)) + 1).alias("next_index"))


def sliced(samples: DataFrame, windows: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Samples (workout_id, at) that fall in windows (workout_id, set_id, start, end), times in seconds.

    Windows are spread over time buckets so that the join is an equi-join with a filter, not a range scan of a workout.
    """
    first, last = F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)
    spread = windows.withColumn("_b", F.explode(F.sequence(first, last)))
    near = samples.withColumn("_b", F.floor(F.col("at") / bucket))
    return near.join(spread, ["workout_id", "_b"]).where(F.col("at").between(F.col("start"), F.col("end"))).drop("_b")
