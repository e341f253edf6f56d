"""Streams over the events: exactly-once deduplication, windows, and supersession with keyed state.

Each flow reads what is there (availableNow), keeps its checkpoint in the shared
folder, and returns what it wrote as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import first_per_key, new_folder, written


#: Rows of a file that a task writes and reads.
FILE_ROWS = 500_000


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")  # a pattern: the table may be one file


def pieces_of(rows: DataFrame, piece: Column, pieces: int) -> DataFrame:
    """rows as a stream of so many micro-batches, in the order of piece (0, 1, ...): each is written as so many files (empty ones
    where it is short of rows), one piece after the other, and so many are read at a time."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "pieces")
    rows = written(rows.withColumn("__piece", piece), "pieces")
    most = rows.groupBy("__piece").count().agg(F.max("count")).first()[0] or 1
    files, schema = -(-most // FILE_ROWS), rows.drop("__piece").schema
    for n in range(pieces):
        own = rows.filter(F.col("__piece") == n).drop("__piece")
        (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(folder)
        for _ in range(files * (n + 1) - len(spark.read.schema(schema).parquet(folder).inputFiles())):
            own.limit(0).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def in_time_order(rows: DataFrame, ts: str = "ts", pieces: int = 3) -> DataFrame:
    """rows as a stream of micro-batches, each later than the one before."""
    cuts = rows.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).approxQuantile("t", [i / pieces for i in range(1, pieces)], 0.01)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return pieces_of(rows, sum((F.when(at > c, 1).otherwise(0) for c in cuts), F.lit(0)), pieces)


def run(stream: DataFrame, label: str, keys: list[str] | None = None, base: str | None = None, complete: bool = False) -> DataFrame:
    """Runs a stream until what is there is done; its rows as table.  A base folder of an earlier run is continued.

    With keys the stream's rows are updates: each batch writes those that changed, the state of what is older than the
    watermark is dropped, and the last row of each key counts.  complete is for finite replays: the state holds all.
    """
    spark = stream.sparkSession
    base = base or new_folder(spark, label)
    if complete:
        keep = lambda df, n: df.write.mode("overwrite").parquet(f"{base}/rows")
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")
    if not keys:
        query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")
    query = each_batch(stream, lambda df, n: df.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/rows/batch={n}"), f"{base}/state")
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])).option("recursiveFileLookup", "true").parquet(f"{base}/rows")
    return first_per_key(rows, keys, F.desc("__batch")).drop("__batch")


def settled(changes: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Runs a stream of changes (change is - or +) until what is there is done: for each key the row that its last batch added, if
    it added one."""
    base = new_folder(changes.sparkSession, label)
    each_batch(changes, lambda df, n: df.withColumn("__batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/rows/batch={n}"), f"{base}/state", "append").awaitTermination()
    rows = changes.sparkSession.read.schema(T.StructType([*changes.schema.fields, T.StructField("__batch", T.LongType())])).option("recursiveFileLookup", "true").parquet(f"{base}/rows")
    return first_per_key(rows, keys, F.desc("__batch"), "change").filter("change = '+'").drop("__batch", "change")


def each_batch(stream: DataFrame, write, state: str, mode: str = "update") -> StreamingQuery:
    """Hands each batch to write(batch, number), once more with the same number after a failure, so writes must replace."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()


def ingest(stream: DataFrame, folder: str, prepare) -> StreamingQuery:
    """Episodes of a stream into a stored table: prepared as a batch, those stored before left out, each batch in its own folder,
    which a repeated batch replaces."""

    def write(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, prepare(batch)
        stored = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").parquet(f"{folder}/rows") if number else rows.limit(0)
        known = stored.select("source_type", "source_id").filter("source_id is not null").distinct()
        fresh = first_per_key(rows.filter("source_id is not null"), ["source_type", "source_id"], "valid_at").join(known, ["source_type", "source_id"], "left_anti").select(*rows.columns)
        fresh.unionByName(rows.filter("source_id is null")).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    return each_batch(stream, write, f"{folder}/state")


def timed(stream: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Event time as a timestamp with a watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "40 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return timed(stream, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and event type."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed(stream, "1 day").groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Events of a user that follow each other within the gap."""
    out = timed(stream, "1 day").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def superseding(stream: DataFrame) -> DataFrame:
    """For each user the intervals of what they did last: an event closes the one before it.  State: the open event."""

    def close(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames = list(frames)
        at, number, kind = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("ts", "event_id", "event_type"))
        if state.exists:
            open_at, open_number, open_kind = state.get
            at, number, kind = np.append(at, np.datetime64(open_at)), np.append(number, open_number), np.append(kind, open_kind)
        order = np.lexsort((number, at))
        at, number, kind = at[order], number[order], kind[order]
        state.update((str(at[-1]), int(number[-1]), kind[-1]))
        yield pd.DataFrame({"user_id": key[0], "event_id": number[:-1], "event_type": kind[:-1], "valid_at": at[:-1], "invalid_at": at[1:]})

    rows = stream.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = rows.groupBy("user_id").applyInPandasWithState(close, "user_id long, event_id long, event_type string, valid_at timestamp, invalid_at timestamp", "at string, number long, kind string", "append", GroupStateTimeout.NoTimeout)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_at", "invalid_at")})
