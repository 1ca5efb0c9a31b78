"""Session settings that the operators rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "barlake", more: dict[str, str] | None = None) -> SparkSession:
    """UTC, ANSI and adaptive execution; the number of shuffle partitions is left to the cluster unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in (more or {}).items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both write: spark.checkpoint.dir; unset, a temporary folder if all runs on this machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        path = tempfile.mkdtemp(prefix="barlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return path.rstrip("/")
