"""Live heart rate and motion, sets from start and stop events, and the heart rate of sets that are still open.

Sets end by an explicit stop, so they are paired by state. State is kept per key in RocksDB and goes by event-time timers:
a silent recording's and a forgotten set's after a while, a beat's once no set that could hold it may still end. Times of
sets are event times of the output, so that the interval join follows in the same query. Watermarks, session windows and
deduplication (``late_windows``, ``sessions``, ``deduplicated``) are additions of this engine.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HEART = "workout_id string, utc timestamp, bpm double"
MOTION = "recording_id string, utc timestamp, t double, ua_x double, ua_y double, ua_z double"
EVENT = "workout_id string, at timestamp, kind string, set_id string"
#: How long the state of a silent recording is kept, and how long a set may last.
IDLE, LONGEST = "6 hours", "2 hours"
#: Events of one file of a replay.
SLICE = 1 << 20
#: Times of a replay, to the microsecond; without a format Spark writes milliseconds only.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_RATES = "recording_id string, n long, rate double"
_RATE_STATE = "n long, first double, last double, seen long"
_SETS = "workout_id string, set_id string, start timestamp, end timestamp"


def read_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """New JSON files of a folder, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def heart_rate(stream: DataFrame, wall: str = "1970-01-01T00:00:00Z", uptime: float = 0.0) -> DataFrame:
    """Adds t: the device's uptime at each sample, from a pair of wall clock and uptime."""
    return stream.withColumn("t", F.unix_micros("utc") / F.lit(1e6) - F.unix_micros(F.lit(wall).cast("timestamp")) / F.lit(1e6) + F.lit(uptime))


def _ms(at: object) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


class _Timed(StatefulProcessor):
    """One value a key and one timer, which moves; what is left when it rings is forgotten."""

    shape: str

    def __init__(self, wait: str) -> None:
        self.wait = pd.Timedelta(wait)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.shape)

    def keep(self, value: tuple, until: int, timers: object) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.value.update(value)
        self.handle.registerTimer(max(until, timers.getCurrentWatermarkInMs() + 1))

    def drop(self) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.value.clear()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def _rate(idle: str) -> Callable:
    """Count, first and last time of a recording; its state comes with the rows, many recordings a batch."""
    wait = pd.Timedelta(idle)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, first, last, seen = state.get if state.exists else (0, math.inf, -math.inf, None)
        seen = None if seen is None else pd.Timestamp(seen, unit="us")
        for part in parts:
            if seen is not None and part["utc"].min() > seen + wait:  # its time would have been up before
                n, first, last = 0, math.inf, -math.inf
            n, first, last, seen = n + len(part), min(first, part["t"].min()), max(last, part["t"].max()), part["utc"].max() if seen is None else max(seen, part["utc"].max())
        state.update((int(n), float(first), float(last), seen.value // 1000))
        state.setTimeoutTimestamp(max(_ms(seen + wait), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"recording_id": [key[0]], "n": [n], "rate": [(n - 1) / (last - first) if last > first else None]})

    return step


def motion_rate(stream: DataFrame, delay: str = "10 minutes", idle: str = IDLE) -> DataFrame:
    """(recording_id, n, rate) so far, for each recording that a batch adds to (update mode); one that was silent for ``idle`` is counted anew, and its state goes when the watermark is that far."""
    return stream.select("recording_id", "utc", "t").withWatermark("utc", delay).groupBy("recording_id").applyInPandasWithState(_rate(idle), _RATES, _RATE_STATE, "update", "EventTimeTimeout")


class _Sets(_Timed):
    """A set opens at start_set and closes at the next start or stop."""

    shape = "set_id string, since timestamp"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        name, since = self.value.get() if self.value.exists() else (None, None)
        since, out = since and pd.Timestamp(since), []
        for row in pd.concat(list(rows)).sort_values(["at", "kind", "set_id"]).itertuples():
            if row.kind in ("stop_set", "stop_workout", "start_set") and name is not None:
                if since < row.at <= since + self.wait:
                    out.append((key[0], name, since, row.at))
                name, since = None, None
            if row.kind == "start_set":
                name, since = row.set_id, row.at
        if name is not None:
            self.keep((name, since.to_pydatetime()), _ms(since + self.wait) + 1, timerValues)
        else:
            self.drop()
        yield pd.DataFrame(out, columns=["workout_id", "set_id", "start", "end"])


def sets_of(events: DataFrame, delay: str = "10 minutes", longest: str = LONGEST) -> DataFrame:
    """(workout_id, set_id, start, end) of control events start_workout, start_set, stop_set and stop_workout, up to a delay late.

    A set ends at the next start_set, stop_set or stop_workout; at equal times events count in the order of their kind, then
    set_id. One of no length is dropped, and so is one that lasts longer than ``longest``: state is kept no longer than that.
    """
    return events.withWatermark("at", delay).groupBy("workout_id").transformWithStateInPandas(_Sets(longest), _SETS, "Append", "EventTime", eventTimeColumnName="end")


def heart_rate_of_sets(stream: DataFrame, sets: DataFrame) -> DataFrame:
    """Samples with the set that they fall in; sets is a static table."""
    return stream.join(sets, "workout_id").where(F.col("utc").between(F.col("start"), F.col("end")))


def heart_rate_of_open_sets(beats: DataFrame, events: DataFrame, delay: str = "10 minutes", longest: str = LONGEST) -> DataFrame:
    """(workout_id, set_id, start, end, utc, bpm): both streams at once; beats wait for the end of the set that they fall in.

    A beat's state goes when no set that holds it may end any more, a set's when no beat within it may come.
    """
    b, s = beats.withWatermark("utc", delay).alias("b"), sets_of(events, delay, longest).alias("s")
    within = "b.workout_id = s.workout_id and b.utc >= s.start and b.utc <= s.end and s.end <= b.utc + interval " + longest
    return b.join(s, F.expr(within)).select("b.workout_id", "s.set_id", "s.start", "s.end", "b.utc", "b.bpm")


def late_windows(stream: DataFrame, delay: str = "30 seconds", width: str = "10 seconds") -> DataFrame:
    """Addition: mean heart rate in tumbling windows, late samples up to a delay."""
    grouped = stream.withWatermark("utc", delay).groupBy("workout_id", F.window("utc", width).alias("w"))
    return grouped.agg(F.avg("bpm").alias("bpm"), F.count("*").alias("n")).select("workout_id", F.col("w.start").alias("start"), "bpm", "n")


def sessions(stream: DataFrame, gap: str = "2 minutes", delay: str = "30 seconds") -> DataFrame:
    """Addition: runs of samples without a gap; only an approximation of sets, which end by an explicit stop."""
    grouped = stream.withWatermark("utc", delay).groupBy("workout_id", F.session_window("utc", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("workout_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(stream: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """Addition: each sample once, within the watermark."""
    return stream.withWatermark("utc", delay).dropDuplicatesWithinWatermark(["workout_id", "utc"])


@contextmanager
def _state_settings(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which typed state and timers need, in as many parts as there are cores; a query keeps what it began with."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
    }
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", limit: float | None = None) -> list:
    """Works off what is there, exactly once, and stops; returns the progress of each batch.

    Append: Parquet files of the sink. Update: the rows of a batch lie in a folder of its number, so a batch that runs again
    replaces its own. With a limit in seconds, a query that is not done by then is stopped and raises.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", sink)
    else:
        writer = writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{sink}/batch={batch}"))
    with _state_settings(spark):
        query = writer.start()
        ended = query.awaitTermination(limit) if limit else (query.awaitTermination(), True)[1]
    if not ended:
        query.stop()
        raise TimeoutError(f"the stream did not end within {limit} s")
    return query.recentProgress


def replay(rows: DataFrame, at: str, folder: str, slices: int | None = None) -> None:
    """Writes rows as a stream would bring them: JSON files in order of time, of about SLICE rows each, one after the other."""
    count = rows.count()
    parts = slices or max(1, math.ceil(count / SLICE))
    seconds = (F.unix_micros(at) / F.lit(1e6)).alias("s")
    cuts = rows.select(seconds).agg(F.percentile_approx("s", [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 and count else []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows
        if low is not None:
            part = part.where(F.unix_micros(at) / F.lit(1e6) >= low)
        if high is not None:
            part = part.where(F.unix_micros(at) / F.lit(1e6) < high)
        part.coalesce(1).write.mode("append").option("timestampFormat", STAMP).json(folder)


def replayed(spark: SparkSession, tables: dict[str, tuple[DataFrame, str, str]], graph: Callable[..., DataFrame], folder: str, mode: str = "append", slices: int | None = None) -> tuple[DataFrame, list]:
    """What a stream graph makes of tables (rows, time column, schema) that come in slices, a file a batch; and its progress."""
    home = f"{folder}/replay-{uuid.uuid4().hex}"
    streams = {}
    for name, (rows, at, schema) in tables.items():
        replay(rows, at, f"{home}/{name}", slices)
        streams[name] = read_stream(spark, f"{home}/{name}", schema, 1)
    progress = run_available(graph(**streams), f"{home}/out", f"{home}/checkpoint", mode)
    return spark.read.parquet(f"{home}/out"), progress


__all__ = ["EVENT", "HEART", "MOTION", "deduplicated", "heart_rate", "heart_rate_of_open_sets", "heart_rate_of_sets", "late_windows", "motion_rate", "read_stream", "replay", "replayed", "run_available", "sessions", "sets_of"]
