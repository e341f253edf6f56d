"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has several points on a ring of 64-bit digests.  A row belongs to the
first point clockwise of its key's digest.  A shard takes rows up to its bound, in
the order of a second digest of the key; the rest go on clockwise to the next shard
with room, round by round, until all have a place.  Rounds look at the overflow
only, and each of them fills at least one shard, so there are as many as shards at
most.

Rows of a shard are numbered without gathering them: a sort by range over all
tasks, each task's own numbering, and the counts of the tasks before.  All of it is
made of built-in functions.  What is broadcast has a row for each bucket of the ring
(its size depends on the number of points alone) or for each shard and task.

Defined results: with no slack, shards differ by one row at most (the first shards
hold the odd rows); a null key is a key like any other; equal keys fill their shard
and then the next ones clockwise; rows that differ in a column are told apart by a
digest of all columns, and equal rows are alike in any order; a column named like a
result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import leaves_one_table, written

#: Points of a shard.  More of them make natural shares more alike (about 1 / sqrt(points)), so that fewer rows overflow.
POINTS = 512
BUCKET_BITS = 12
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def key_digest(key: Column) -> Column:
    return F.xxhash64(F.lit("key"), key)


def _bucket(digest: Column) -> Column:
    return F.shiftright(digest, 64 - BUCKET_BITS)


def arcs_of_ring(spark: SparkSession, shards: list[int], points: int = POINTS) -> DataFrame:
    """For each bucket of digests the ends of the arcs in it, ascending, with the shard that owns each."""
    nodes = spark.range(len(shards) * points).select(F.element_at(F.lit(shards), (F.col("id") / points).cast("int") + 1).alias("shard"), (F.col("id") % points).alias("point"))
    nodes = nodes.select("shard", F.xxhash64(F.lit("node"), "shard", "point").alias("end"))
    along = Window.orderBy("end", "shard")  # a row for each point
    arcs = nodes.select("shard", "end", F.coalesce(F.lag("end").over(along), F.lit(LOWEST)).alias("start"))
    first = nodes.agg(F.min(F.struct("end", "shard")).getField("shard").alias("shard"), F.max("end").alias("start")).select("shard", F.lit(HIGHEST).alias("end"), "start")
    spread = arcs.unionByName(first).select("shard", "end", F.explode(F.sequence(_bucket(F.col("start")), _bucket(F.col("end")))).alias("bucket"))
    return spread.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("arcs"))


def _on_ring(rows: DataFrame, shards: list[int], points: int) -> DataFrame:
    """rows (with __key) with the shard that each one's key meets first."""
    arcs = F.broadcast(arcs_of_ring(rows.sparkSession, shards, points).withColumnsRenamed({"bucket": "__bucket", "arcs": "__arcs"}))
    owner = F.element_at(F.filter("__arcs", lambda a: a["end"] >= F.col("__key")), 1)["shard"]
    return rows.withColumn("__bucket", _bucket(F.col("__key"))).join(arcs, "__bucket").withColumn("shard", owner.cast("int")).drop("__bucket", "__arcs")


def _numbered(rows: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """rows, written, with __nth (from 1 in each shard, by the second digest), and the number of rows of each shard."""
    by = ["shard", "__turn", "__tie", "__own"]
    placed = rows.withColumn("__own", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = written(placed.drop("__own").withColumn("__id", F.monotonically_increasing_id()), "shards")
    part = F.shiftright("__id", 33)
    stretches = placed.groupBy("shard", part.alias("__part")).agg(F.count("*").alias("rows"), F.min("__id").alias("__first"))
    stretches = written(stretches, "stretches")
    upto = F.sum("rows").over(Window.partitionBy("shard").orderBy("__part"))  # a row for each task
    before = stretches.select("shard", "__part", "__first", (upto - F.col("rows")).alias("__before"))
    numbered = placed.withColumn("__part", part).join(F.broadcast(before), ["shard", "__part"])
    nth = F.col("__before") + F.col("__id") - F.col("__first") + 1
    counts = {r.shard: r.n for r in stretches.groupBy("shard").agg(F.sum("rows").alias("n")).collect()}  # a row for each shard
    return numbered.withColumn("__nth", nth).drop("__part", "__first", "__before", "__id"), counts


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """The most rows of each shard."""
    if slack:
        return [ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


@leaves_one_table
def sharded(rows: DataFrame, key: str, shards: int, slack: float = 0.0, points: int = POINTS) -> DataFrame:
    """rows with their shard (int, from 0) and slot in it (long, from 0 without gaps).  No shard holds more than 1 + slack times
    the mean; without slack shards are equal but for one row.  More slack moves fewer rows when a shard is added."""
    if shards < 1 or points < 1 or slack < 0:
        raise ValueError("there must be a shard and a point, and slack can't be negative")
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    keyed = rows.select(*[F.col(f"`{c}`") for c in own], key_digest(F.col(f"`{key}`")).alias("__key"))
    keyed = keyed.withColumns({"__turn": F.xxhash64(F.lit("turn"), "__key"), "__tie": F.xxhash64(*[F.col(f"`{c}`") for c in own])})
    held, most, taken, left = [0] * shards, None, [], keyed
    while most is None or sum(waiting.values()):
        spare = [s for s in range(shards) if most is None or held[s] < most[s]]
        numbered, counts = _numbered(_on_ring(left, spare, points))
        most = most or bounds(sum(counts.values()), shards, slack)
        room = {s: most[s] - held[s] for s in spare}
        waiting = {s: max(0, n - room[s]) for s, n in counts.items()}
        at_most = F.element_at(F.lit([room.get(s, 0) for s in range(shards)]), F.col("shard") + 1)
        start = F.element_at(F.lit([int(n) for n in held]), F.col("shard") + 1)
        taken.append(numbered.filter(F.col("__nth") <= at_most).select(*[F.col(f"`{c}`") for c in own], "shard", (start + F.col("__nth") - 1).cast("long").alias("slot")))
        left = numbered.filter(F.col("__nth") > at_most).select(*[F.col(f"`{c}`") for c in own], "__key", "__turn", "__tie")
        for s, n in counts.items():
            held[s] += min(n, room[s])
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out
