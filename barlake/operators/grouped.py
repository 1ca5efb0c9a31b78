"""Steps over whole groups that no window expresses: numpy on ordered groups, many groups an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task gathers before it passes them on.
FLUSH = 1 << 13
Part = dict[str, np.ndarray]


def by_group(rows: DataFrame, key: str | Sequence[str], fn: Callable[[Part], list[tuple]], shape: str, order: Sequence = ("t",)) -> DataFrame:
    """(key..., shape) of fn's tuples for each group of rows; fn gets the group's columns as arrays, in order (nulls of numbers as NaN).

    A window numbers the rows, so the partitioning and order that are there already serve; where the number is 1 a group begins.
    """
    keys = [key] if isinstance(key, str) else list(key)
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    names = rows.columns
    schema = StructType([rows.schema[k] for k in keys] + StructType.fromDDL(shape).fields)
    out_schema = to_arrow_schema(schema)

    def values(pieces: list[pa.RecordBatch], name: str) -> np.ndarray:
        return np.concatenate([p.column(names.index(name)).to_numpy(zero_copy_only=False) for p in pieces])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[tuple] = []

        def done() -> None:
            own = tuple(held[0].column(names.index(k))[0].as_py() for k in keys)
            out.extend((*own, *row) for row in fn({n: values(held, n) for n in names}))
            held.clear()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(map(_plain, c), f.type) for c, f in zip(zip(*out), out_schema)], schema=out_schema)
            out.clear()
            return batch

        for batch in batches:
            starts = np.flatnonzero(batch.column(len(names)).to_numpy() == 1).tolist()
            for a, b in zip([0, *starts], [*starts, batch.num_rows]):
                if a in starts and held:
                    done()
                if b > a:
                    held.append(batch.slice(a, b - a))
                if len(out) >= FLUSH:
                    yield flushed()
        if held:
            done()
        if out:
            yield flushed()

    return numbered.mapInArrow(run, schema)


def _plain(x: object) -> object:
    return x.item() if isinstance(x, np.generic) else x
