"""Recordings as Spark data sources: ``spark.read.format("barlake_motion")`` and ``spark.readStream.format("barlake_motion")``.

A task reads a file, or small ones up to the option ``pack`` (bytes; 0: a task a file); columns are taken by each file's own header, so legacy and reordered files may share a folder, and
only those of the requested schema are parsed. Filters on ``recording_id`` rule files out before they are opened. The stream
reader takes files in order of (time, path). Writing stages a file a recording and moves all into place at commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schemas import IMU_COLUMNS, IMU_OPTIONAL, IMU_REQUIRED

_STAGING = "_staging"
#: Bytes of small files that share a task, unless the option ``pack`` says otherwise.
PACK = 4 << 20


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _stem(path: str) -> str:
    """The recording: a folder named recording_id=..., else the file's name without its ending."""
    parts = path.split("/")
    named = [p.partition("=")[2] for p in parts if p.startswith("recording_id=")]
    return named[-1] if named else parts[-1].removesuffix(".csv")


@dataclass(frozen=True)
class File:
    path: str
    time: int
    size: int


@dataclass
class Files(InputPartition):
    files: list[File]


class _Format:
    """What the kinds of files differ in."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    types: dict[str, pa.DataType] = {}
    #: Names of a file without a header.
    fixed: tuple[str, ...]
    strict: bool

    @classmethod
    def read(cls, path: str, schema: StructType) -> Iterator[pa.RecordBatch]:
        fs, place = _place(path)
        with fs.open_input_stream(place) as f:
            head = f.read(1 << 12).decode("utf-8", "replace")
        lines = [line for line in head.splitlines() if line.strip()]
        if not lines:
            return
        first = [c.strip() for c in lines[0].split(",")]
        headed = cls.required[-1] in first
        names = first if headed else list(cls.fixed)[: len(first)]
        if missing := [c for c in cls.required if c not in names]:
            raise ValueError(f"missing columns in {path}: {missing}")
        wanted = [f.name for f in schema.fields if f.name != "recording_id"]
        present = [c for c in dict.fromkeys([*wanted, *([] if cls.strict else cls.required)]) if c in names]
        rows = pyarrow.csv.open_csv(
            fs.open_input_stream(place),
            pyarrow.csv.ReadOptions(column_names=names, use_threads=False, block_size=1 << 20),
            pyarrow.csv.ParseOptions(ignore_empty_lines=True, invalid_row_handler=lambda row: "error" if cls.strict else "skip"),
            pyarrow.csv.ConvertOptions(include_columns=present, column_types={c: pa.string() for c in present}, strings_can_be_null=True),
        )
        skip, name = headed, _stem(path)
        for batch in rows:
            if skip:
                batch, skip = batch.slice(1), False
            columns = {c: cls.cell(path, c, batch.column(c)) for c in present}
            if not cls.strict:
                whole = pa.array([True] * batch.num_rows)
                for c in cls.required:
                    whole = pc.and_(whole, pc.is_valid(columns[c]))
                columns = {c: v.filter(whole) for c, v in columns.items()}
                n = pc.sum(pc.cast(whole, pa.int64())).as_py() or 0
            else:
                n = batch.num_rows
            out = [pa.array([name] * n, pa.string()) if f.name == "recording_id" else columns.get(f.name, pa.array([0.0 if f.name in cls.optional else None] * n, pa.float64())) for f in schema.fields]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    @classmethod
    def cell(cls, path: str, name: str, values: pa.Array) -> pa.Array:
        """Text to the column's type; of strict formats a required cell that is no number is an error, an optional one 0."""
        text = pc.utf8_trim_whitespace(values)
        if cls.types.get(name) is not None:
            good = pc.match_substring_regex(text, r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z?$")
            plain = pc.replace_substring(pc.if_else(good, text, None), "Z", "")
            return pc.cast(pc.assume_timezone(pc.cast(plain, pa.timestamp("us")), "UTC"), cls.types[name])
        good = pc.fill_null(pc.match_substring_regex(text, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), False)
        if cls.strict and name in cls.required and not pc.all(good, min_count=0).as_py():
            raise ValueError(f"bad required cell in {path}: {name}")
        numbers = pc.cast(pc.if_else(good, text, None), pa.float64())
        return pc.fill_null(numbers, 0.0) if name in cls.optional else numbers


class Motion(_Format):
    required, optional, fixed, strict = IMU_REQUIRED, IMU_OPTIONAL, IMU_COLUMNS, True
    shape = "recording_id string, " + ", ".join(f"{c} double" for c in IMU_COLUMNS)


class HeartRate(_Format):
    """Malformed rows go."""

    required, fixed, strict = ("t", "utc", "bpm"), ("t", "utc", "bpm"), False
    types = {"utc": pa.timestamp("us", "UTC")}
    shape = "recording_id string, t double, utc timestamp, bpm double"


def _files(path: str) -> list[File]:
    """Files below a folder (or the one), by time and path; what is staged, hidden or no CSV is left out."""
    fs, place = _place(path)
    if fs.get_file_info(place).type == pyarrow.fs.FileType.File:
        found = [fs.get_file_info(place)]
    else:
        found = fs.get_file_info(pyarrow.fs.FileSelector(place, recursive=True, allow_not_found=True))
    lead = path[: len(path) - len(place)] if path.endswith(place) else ""
    inside = lambda p: p[len(place) :].split("/")
    kept = [i for i in found if i.type == pyarrow.fs.FileType.File and i.path.endswith(".csv") and not any(x.startswith(("_", ".")) for x in inside(i.path))]
    return sorted((File(lead + i.path, i.mtime_ns or 0, i.size or 0) for i in kept), key=lambda f: (f.time, f.path))


def _packed(files: list[File], pack: int) -> list[Files]:
    """Files one after the other share a task up to so many bytes; 0: a task a file."""
    out: list[Files] = []
    size = 0
    for f in files:
        if not out or size + f.size > pack:
            out.append(Files([]))
            size = 0
        out[-1].files.append(f)
        size += f.size
    return out


class _Reader(DataSourceReader):
    def __init__(self, form: type[_Format], schema: StructType, path: str, pack: int) -> None:
        self.form, self.schema, self.path, self.pack, self.only = form, schema, path, pack, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("recording_id",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            else:
                yield f

    def partitions(self) -> list[Files]:
        return _packed([f for f in _files(self.path) if self.only is None or _stem(f.path) in self.only], self.pack)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for f in partition.files:
            yield from self.form.read(f.path, self.schema)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the time and path of the last file taken; ``settle`` seconds must pass before a file is, so that none of an equal time is overtaken."""

    def __init__(self, form: type[_Format], schema: StructType, path: str, pack: int, settle: float) -> None:
        self.form, self.schema, self.path, self.pack, self.settle = form, schema, path, pack, settle

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        import time

        ripe = [f for f in _files(self.path) if f.time <= (time.time() - self.settle) * 1e9]
        return {"time": ripe[-1].time, "path": ripe[-1].path} if ripe else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return _packed([f for f in _files(self.path) if low < (f.time, f.path) <= high], self.pack)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for f in partition.files:
            yield from self.form.read(f.path, self.schema)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Files of samples in order of time; rows of a recording come together (``write_motion`` sees to it)."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Staged:
        fs, place = _place(self.path)
        folder, staged, name, out = f"{place}/{_STAGING}/{self.job}/{uuid.uuid4().hex}", [], None, None
        fs.create_dir(folder, recursive=True)
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() if c in batch.schema.names else [0.0] * batch.num_rows for c in IMU_COLUMNS]
            for who, *cells in zip(batch.column(batch.schema.get_field_index("recording_id")).to_pylist(), *columns):
                if who != name:
                    if out:
                        out.close()
                    if any(who == s for s, _ in staged):
                        raise ValueError(f"samples of {who} do not stand together")
                    name, file = who, f"{folder}/{len(staged)}.csv"
                    staged.append((who, file))
                    out = fs.open_output_stream(file)
                    out.write((",".join(IMU_COLUMNS) + "\n").encode())
                out.write((",".join(f"{x:.6f}" for x in cells) + "\n").encode())
        if out:
            out.close()
        return _Staged(staged)

    def commit(self, messages: list[_Staged | None]) -> None:
        fs, place = _place(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [n for n, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("samples of a recording lie in several tasks")
        if self.overwrite:
            for old in _files(self.path):
                if _stem(old.path) not in names:
                    fs.delete_file(_place(old.path)[1])
        for who, file in files:
            fs.move(file, f"{place}/{who}.csv")
        fs.delete_dir(f"{place}/{_STAGING}/{self.job}")
        with fs.open_output_stream(f"{place}/_SUCCESS") as f:
            f.write(json.dumps({"files": len(files)}).encode())

    def abort(self, messages: list[_Staged | None]) -> None:
        fs, place = _place(self.path)
        if fs.get_file_info(f"{place}/{_STAGING}/{self.job}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{place}/{_STAGING}/{self.job}")


class _Source(DataSource):
    form: type[_Format]

    def schema(self) -> str:
        return self.form.shape

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.form, schema, self.options["path"], int(self.options.get("pack", PACK)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.form, schema, self.options["path"], int(self.options.get("pack", PACK)), float(self.options.get("settle", "1")))


class MotionSource(_Source):
    form = Motion

    @classmethod
    def name(cls) -> str:
        return "barlake_motion"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


class HeartRateSource(_Source):
    form = HeartRate

    @classmethod
    def name(cls) -> str:
        return "barlake_heart_rate"


def register(spark: SparkSession) -> SparkSession:
    """Makes both formats known to a session. Filters reach the files if spark.sql.python.filterPushdown.enabled is set."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MotionSource)
    spark.dataSource.register(HeartRateSource)
    return spark


def write_motion(rows: DataFrame, path: str, mode: str = "append") -> None:
    """A file a recording, in time order; files appear together when all are written, or none does."""
    register(rows.sparkSession)
    rows.repartition("recording_id").sortWithinPartitions("recording_id", "t").write.format("barlake_motion").mode(mode).save(path)


__all__ = ["HeartRateSource", "MotionSource", "register", "write_motion"]
