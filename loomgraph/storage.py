"""Tables, the shared folder, and written intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of local sessions without a shared one.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  A temporary one only where that is unset and all tasks run in this
    process; elsewhere executors would write to disks of their own, so an unset name is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = spark.sparkContext.applicationId
        named = _OWN[own] = _OWN.get(own) or "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return named.rstrip("/")


#: Spark then deletes an execution's shuffle files at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders made in the run that is under way; None outside of one.
_OPEN: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("open", default=None)


def new_folder(spark: SparkSession, label: str) -> str:
    """A name in the shared folder; a run that is under way deletes what is there at its end."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (open_ := _OPEN.get()) is not None:
        open_.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage is cut, lost executors don't matter, and the disk of the
    shuffles that made it is freed."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def removed(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        delete_folder(df.sparkSession, df.written_to)


@contextmanager
def run_of_tables() -> Iterator[None]:
    """Folders made inside are deleted at the end, also after an error."""
    token = _OPEN.set([])
    try:
        yield
    finally:
        made = _OPEN.get()
        _OPEN.reset(token)
        for spark, path in made:
            delete_folder(spark, path)


def leaves_one_table(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f with its result written, and everything else that it wrote deleted; f as it is where it writes nothing."""

    @wraps(f)
    def run(*a, **b):
        around = _OPEN.get()
        with run_of_tables():
            out = f(*a, **b)
            if not _OPEN.get():
                return out
            inner = _OPEN.set(around)
            try:
                return written(out, f.__name__)
            finally:
                _OPEN.reset(inner)

    return run


def of_group(df: DataFrame, group_id: str | None, also_default: bool = False) -> DataFrame:
    """The rows of one tenant (None: of all); also_default: with those of the default group."""
    if group_id is None or "group_id" not in df.columns:
        return df
    return df.filter(F.col("group_id").isin(group_id, "default") if also_default else F.col("group_id") == group_id)


def append_rows(df: DataFrame, folder: str) -> None:
    """Appends rows to a stored table, a folder for each tenant, so that a tenant's reads open its own files only."""
    df.write.mode("append").partitionBy("group_id").parquet(folder)


def stored_rows(spark: SparkSession, folder: str, schema, group_id: str | None = None) -> DataFrame:
    return of_group(spark.read.schema(schema).parquet(folder), group_id)


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """target with those rows whose key it lacks, the first of each key; a null in a key never conflicts."""
    known = rows.dropna(subset=keys)
    fresh = first_per_key(known.join(target.select(*keys), keys, "left_anti"), keys, *order)
    loose = rows.filter(" or ".join(f"{k} is null" for k in keys))
    return target.unionByName(fresh.select(*target.columns)).unionByName(loose.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target with rows put in place of the rows of the same key."""
    return target.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*target.columns))
