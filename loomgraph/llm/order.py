"""Running sums along a sorted table whose groups may be of any size.

A window over a key gathers all rows of the key in one task.  Here the rows are
sorted by range over many tasks, each task adds up its own stretch, and the last
sums of the stretches before (a row for each task) are added to the rows of the
group that a stretch begins with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written


def changes(columns: list[pa.Array], rows: int) -> np.ndarray:
    """For each row but the first, whether any of the columns differs from the row before (null equals null)."""
    out = np.zeros(max(rows - 1, 0), bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(rows - 1, 0))
        differ = pc.fill_null(pc.not_equal(a, b), True)
        out |= np.asarray(pc.and_(differ, pc.invert(pc.and_(pc.is_null(a), pc.is_null(b)))))
    return out


def _stretch(keys: list[str], sums: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, first, last = TaskContext.get().partitionId(), 0, True, None
        state = dict.fromkeys(sums, 0)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            own = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            starts = np.empty(rows, bool)
            head = tuple(c[0].as_py() for c in own)
            starts[0] = last is not None and head != last
            starts[1:] = changes(own, rows)
            group = np.cumsum(starts)
            at = np.flatnonzero(starts)
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for s in sums:
                total = np.cumsum(np.asarray(columns[s], dtype=np.int64))
                base = np.concatenate([[-state[s]], np.concatenate([[0], total])[at]])
                columns[s] = total - base[group]
                state[s] = int(columns[s][-1])
            flags = (group == 0) & first
            first = bool(flags[-1])
            last = tuple(c[-1].as_py() for c in own)
            tags = [pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(n, n + rows)), pa.array(flags)]
            n += rows
            yield pa.RecordBatch.from_arrays([*(pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()), *tags], names=[*columns, "__part", "__n", "__first"])

    return run


def running(df: DataFrame, keys: list[str], order: list[Column], sums: list[str], keep: list[str] | None = None, label: str = "running") -> DataFrame:
    """df's columns keep (all), where each of sums (long, not null) is the sum over the rows of the same keys up to this
    one in the given order.  Rows that the order leaves equal come in any order, so make it tell apart what should differ.
    Without keys the whole table is one group.  The result is a written table with the stretches' carries joined on."""
    keep = keep or df.columns
    by = [*map(F.col, keys), *order]
    narrow = df.repartitionByRange(*by).sortWithinPartitions(*by).select(*keep)
    schema = T.StructType([*narrow.schema.fields]).add("__part", "integer").add("__n", "long").add("__first", "boolean")
    parts = written(narrow.mapInArrow(_stretch(keys, sums), schema), label)
    ends = parts.groupBy("__part").agg(F.min(F.struct("__n", F.struct(F.lit(0), *keys).alias("k"))).alias("a"), F.max(F.struct("__n", F.struct(F.lit(0), *keys).alias("k"), *sums)).alias("z"))
    upto = Window.partitionBy("z.k").orderBy("__part")
    ends = ends.select("__part", F.col("a.k").alias("a"), F.col("z.k").alias("z"), *[F.sum(f"z.{s}").over(upto).alias(s) for s in sums])
    before = Window.orderBy("__part")  # a row for each task
    goes_on = F.lag("z").over(before).eqNullSafe(F.col("a"))
    carry = ends.select("__part", *[F.when(goes_on, F.lag(s).over(before)).otherwise(0).alias(f"__carry_{s}") for s in sums])
    joined = parts.join(F.broadcast(carry), "__part")
    out = joined.select(*[(F.col(c) + F.when(F.col("__first"), F.col(f"__carry_{c}")).otherwise(0)).alias(c) if c in sums else F.col(c) for c in keep])
    out.written_to = parts.written_to
    return out
