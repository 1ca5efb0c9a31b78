"""Tables on storage that change as a whole or not at all: staged partitions and a commit that names them.

A commit writes the partitions that it touches to a folder of its own and then one row, the version with the folder of every
partition. Readers go by the last such row, so what is staged is not seen before, and a write that dies leaves nothing that
is. A transaction that is in the log already changes nothing, so it may be run again. Old versions stay readable.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import tables

_COMMIT = "version long, txn string, partition_by string, schema string, parts array<struct<value: string, folder: string>>"
_PART = "_part"


def log(spark: SparkSession, path: str) -> DataFrame:
    """(version, txn, partition_by, schema, parts): the commits of a table, a row each; empty if there is no table."""
    try:
        return spark.read.schema(_COMMIT).option("recursiveFileLookup", "true").json(f"{path}/commits")
    except Exception as x:
        if "PATH_NOT_FOUND" in str(x):
            return spark.createDataFrame([], _COMMIT)
        raise


def _last(spark: SparkSession, path: str, version: int | None = None):
    rows = log(spark, path)
    if version is not None:
        rows = rows.where(F.col("version") == version)
    return rows.orderBy(F.col("version").desc()).first()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its last version, or of another."""
    last = _last(spark, path, version)
    if last is None:
        raise ValueError(f"no table at {path}" + (f" of version {version}" if version is not None else ""))
    return _of(spark, last, [p.folder for p in last.parts])


def _of(spark: SparkSession, commit, folders: list[str]) -> DataFrame:
    shape = StructType.fromJson(json.loads(commit.schema))
    return spark.read.schema(shape).parquet(*folders) if folders else spark.createDataFrame([], shape)


def write(rows: DataFrame, path: str, txn: str, partition_by: str = "vendor") -> int:
    """Makes rows the partitions that they touch, whatever those held; others stay. Returns the version.

    ``txn`` names the change; one that is committed already is not run again. Of two writers at once the later one fails.
    """
    return _commit(rows.sparkSession, path, txn, partition_by, rows.schema.json(), lambda last: (rows, None))


def rewrite(new: DataFrame, path: str, txn: str, change: Callable[[DataFrame, DataFrame], DataFrame], partition_by: str = "vendor") -> int:
    """Puts change(old rows, new rows) in place of the partitions that new touches; only those are read and written."""
    spark = new.sparkSession

    def rows(last):
        touched = [r[0] for r in new.select(F.coalesce(F.col(partition_by).cast("string"), F.lit(""))).distinct().collect()]  # as many as partitions
        folders = [p.folder for p in last.parts if p.value in touched] if last else []
        old = _of(spark, last, folders) if last else new.limit(0)
        return change(old, new).select(*(old.columns if last else new.columns)), touched

    return _commit(spark, path, txn, partition_by, new.schema.json(), rows)


def _commit(spark: SparkSession, path: str, txn: str, partition_by: str, schema: str, made: Callable) -> int:
    done = log(spark, path).where(F.col("txn") == txn).first()
    if done:
        return done.version
    last = _last(spark, path)
    if last and last.partition_by != partition_by:
        raise ValueError(f"the table is partitioned by {last.partition_by}")
    rows, touched = made(last)
    version = last.version + 1 if last else 0
    staged = f"{path}/data/{version:08d}-{txn}"
    value = F.coalesce(F.col(partition_by).cast("string"), F.lit(""))
    # the column stays in the files, so that a folder can be read by itself; the name of a folder is of no consequence
    rows.withColumn(_PART, F.sha2(value, 256)).repartition(_PART).write.mode("overwrite").partitionBy(_PART).parquet(staged)
    written = spark.read.parquet(staged).select(F.col(partition_by), _PART).groupBy(_PART).agg(F.first(value).alias("value")).collect() if not rows.isEmpty() else []
    parts = {p.value: p.folder for p in last.parts} if last else {}
    for gone in touched or []:
        parts.pop(gone, None)
    parts |= {r.value: f"{staged}/{_PART}={r[_PART]}" for r in written}
    row = spark.createDataFrame([(version, txn, partition_by, last.schema if last else schema, sorted(parts.items()))], _COMMIT)
    # a folder that exists is an error: of two that make the same version one fails; one file, so there is no half of a commit
    row.coalesce(1).write.mode("errorifexists").json(f"{path}/commits/{version:08d}")
    return version


def replace_by_key(new: DataFrame, path: str, txn: str, keys: Sequence[str] = ("set_id", "vendor"), partition_by: str = "vendor") -> int:
    """``tables.replace_by_key`` on a stored table; the partition column must be one of the keys."""
    if partition_by not in keys:
        raise ValueError("a key might lie in partitions that are not read")
    return rewrite(new, path, txn, partial(tables.replace_by_key, keys=keys), partition_by)


def append_absent(new: DataFrame, path: str, txn: str, key: str = "set_id", partition_by: str = "vendor") -> int:
    """``tables.append_absent`` within the partitions that new touches."""
    return rewrite(new, path, txn, partial(tables.append_absent, key=key), partition_by)


def upsert(new: DataFrame, path: str, txn: str, key: str, technical: Sequence[str], partition_by: str = "vendor") -> int:
    """``tables.upsert`` within the partitions that new touches."""
    return rewrite(new, path, txn, partial(tables.upsert, key=key, technical=technical), partition_by)


__all__ = ["append_absent", "log", "read", "replace_by_key", "rewrite", "upsert", "write"]
