"""Helpers that several operators use: the shared folder, written tables, words as arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six (fixed by the data contracts).
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]+"


#: Temporary folders of local sessions without a shared one.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  A temporary one only where that is unset and all tasks
    run in this process; elsewhere executors would write to disks of their own, so an unset name is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = spark.sparkContext.applicationId
        named = _OWN[own] = _OWN.get(own) or "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return named.rstrip("/")


#: Spark then deletes an execution's shuffle files at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives the loss of executors, and frees the disk of the
    shuffles that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if (open_ := _OPEN.get()) is not None:
        open_.append(out)
    return out


#: Tables written in the run that is under way; None outside of one.
_OPEN: ContextVar[list[DataFrame] | None] = ContextVar("open", default=None)


@contextmanager
def run_of_tables() -> Iterator[None]:
    """Tables written inside are deleted at the end, also after an error."""
    token = _OPEN.set([])
    try:
        yield
    finally:
        made = _OPEN.get()
        _OPEN.reset(token)
        removed(*made)


def leaves_one_table(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f with its result written, and every other table that it wrote deleted."""

    @wraps(f)
    def run(*a, **b):
        around = _OPEN.get()
        with run_of_tables():
            out = f(*a, **b)
            inner = _OPEN.set(around)
            try:
                return written(out, f.__name__)
            finally:
                _OPEN.reset(inner)

    return run


def removed(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array column; null: no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_CLASS), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


# ---------------------------------------------------------------- words of an Arrow column as numpy arrays

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def _byte_codes() -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    codes[[ord(c) for c in WHITE]] = 0
    return codes


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after the other, and the n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a run of documents: byte starts and ends, a 64-bit hash each, and the word range of each document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        solid = np.ones(256, bool)
        solid[[ord(c) for c in WHITE]] = False
        on = np.empty(len(raw) + 2, np.int8)
        on[0] = on[-1] = 0
        on[1:-1] = solid[raw]
        edge_start = (on[1:-1] == 1) & (on[:-2] == 0)
        edge_end = (on[1:-1] == 1) & (on[2:] == 0)
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        edge_start[inner] |= on[1:-1][inner] == 1
        edge_end[inner - 1] |= on[1:-1][inner - 1] == 1
        self.raw, self.offsets = raw, offsets
        self.start = np.flatnonzero(edge_start)
        self.end = np.flatnonzero(edge_end) + 1
        self.bound = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bound)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        reach = np.diff(np.append(self.start, len(self.raw)))
        first = int(self.start[0])
        at = np.arange(first, len(self.raw), dtype=np.int64) - np.repeat(self.start, reach)
        value = _byte_codes()[self.raw[first:]]
        value *= powers(0x5851F42D4C957F2D, int(reach.max()))[at]
        return mix(np.add.reduceat(value, self.start - first) + (self.end - self.start).astype(np.uint64))

    def document(self) -> np.ndarray:
        """Number of the document of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return np.repeat(self.bound[1:], self.count) - np.arange(len(self.start))


def gram_hashes(h: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Unmixed hashes of all runs of so many words, by doubling; entry i starts at word i, the last ones run over the end."""
    base, out, by = 0xD1342543DE82EF95, {}, {1: h}
    top = 1
    while top * 2 <= max(sizes):
        prev, step = by[top], np.uint64(pow(base, top, 1 << 64))
        nxt = prev.copy()
        if len(prev) > top:
            nxt[:-top] += step * prev[top:]
        by[top := top * 2] = nxt
    for k in sizes:
        total, done = None, 0
        for part in (1 << b for b in reversed(range(k.bit_length())) if k >> b & 1):
            if total is None:
                total = by[part].copy()
            elif len(h) > done:
                total[: len(h) - done] += np.uint64(pow(base, done, 1 << 64)) * by[part][done:]
            done += part
        out[k] = total
    return out


def slices(batch: pa.RecordBatch, name: str, limit: int = 1 << 20, rows: int = 1 << 30):
    """Parts of a batch with about limit bytes of text, or so many rows, each; a longer document is a part of its own."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (total + n > limit or i - at >= rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def joined_words(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    of = words.document()[keep]
    start, end = words.start[keep], words.end[keep]
    lead = np.zeros(len(of), np.int64)
    lead[1:] = of[1:] == of[:-1]
    size = end - start + lead
    out_at = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(out_at[-1]) + np.repeat(start - lead - out_at[:-1], size)
    out = words.raw[take] if len(take) else np.zeros(0, np.uint8)
    out[out_at[:-1][lead == 1]] = 32
    offsets = out_at[np.searchsorted(of, np.arange(len(words.count) + 1))]
    array = pa.Array.from_buffers(pa.large_string(), len(words.count), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    return array.cast(pa.string())


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of counts[i] values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
