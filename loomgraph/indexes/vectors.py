"""A vector index as stored tables: inverted lists by learned centroids, residual product codes, exact re-ranking.

Centroids and codebooks are learned by Lloyd rounds on a sample of a bounded size:
each task assigns its rows and adds them up, the sums of a centroid meet in one
group.  Every vector (scaled to length one) is stored in the list of its nearest
centroid, with one byte for each part of what is left of it; lists are cut into
blocks of a bounded size, whatever their length, and sorted into shelves (folders).

A search joins blocks with the queries that probe their list, a matrix of queries at
once; each pair of a block and a matrix gives its best candidates by codes.  The
vectors of the best candidates of each query are then read by key, and compared
exactly.  functions.vector.nearest_to_each is the exact way.

How many lists a search probes is measured when the index is built: the exact
neighbours of some of its rows are looked up in the lists, and the index probes as
many as hold the share of them that is asked for.  Vectors without clusters need
many lists, clustered ones few.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vector import dot, nearest_to_each, norm
from ..operators.graph import first_n
from ..storage import written

#: Rows that centroids are learned from, rounds, centroids at most (their matrix is broadcast), codewords of a part, rows of a
#: block, queries of a matrix.
SAMPLE, ROUNDS, LISTS, WORDS, BLOCK, QUERIES = 100_000, 6, 4096, 256, 4096, 256
#: Rows whose neighbours are looked up to measure how many lists must be probed, and the share of neighbours to be found there.
MEASURED, FOUND = 64, 0.95


def _matrix(values: pa.Array) -> np.ndarray:
    x = np.asarray(values.flatten(), np.float32).reshape(len(values), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, a bounded number of distances at a time."""
    half, step = (centres**2).sum(axis=1) / 2, max(1, (4 << 20) // len(centres))
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.array_split(x, parts, axis=1)


def learn(sample: DataFrame, parts: int, words: int, residual_of: np.ndarray | None = None, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Centroids of each part of the sample's vectors (column v), or of what is left of them beside their nearest centroid."""
    spark, context = sample.sparkSession, sample.sparkSession.sparkContext

    def rest(values: pa.Array) -> np.ndarray:
        x = _matrix(values)
        return x if residual_of is None else x - residual_of[_nearest(x, residual_of)]

    first = rest(pa.array([r.v for r in sample.orderBy(F.xxhash64("k"), "k").limit(words).collect()], pa.list_(pa.float32())))  # words rows
    centres = _parts(first, parts)

    def sums(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros_like(c, dtype=np.float64) for c in shared.value]
            count = [np.zeros(len(c), np.int64) for c in shared.value]
            for batch in batches:
                for p, x in enumerate(_parts(rest(batch.column(0)), parts)):
                    to = _nearest(x, shared.value[p])
                    np.add.at(total[p], to, x)
                    count[p] += np.bincount(to, minlength=len(count[p]))
            for p in range(parts):
                some = np.flatnonzero(count[p])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), p, np.int32)), pa.array(some), pa.array(count[p][some]), pa.array(list(total[p][some]), pa.list_(pa.float64()))], names=["part", "c", "n", "total"])

        return run

    def added(group: pa.Table) -> pa.Table:
        total = np.sum(np.stack([np.asarray(v) for v in group.column("total").to_pylist()]), axis=0)
        return pa.table({"part": group.column("part")[:1], "c": group.column("c")[:1], "n": [sum(group.column("n").to_pylist())], "total": pa.array([total], pa.list_(pa.float64()))})

    kind = "part int, c long, n long, total array<double>"
    for _ in range(rounds):
        shared = context.broadcast(centres)
        rows = sample.select("v").mapInArrow(sums(shared), kind).groupBy("part", "c").applyInArrow(added, kind).collect()  # a row for each centroid
        centres = [c.copy() for c in centres]
        for r in rows:
            centres[r.part][r.c] = np.asarray(r.total) / r.n
        shared.destroy()
    return centres


def build(rows: DataFrame, key: str, vector: str, folder: str, lists: int | None = None, parts: int = 8, shelves: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Writes an index of rows' vectors to folder.  Null, zero and NaN vectors aren't indexed.  All vectors have one length, of
    which parts is at most as much."""
    spark = rows.sparkSession
    length = norm(F.col("v"))
    data = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v")).filter(F.col("v").isNotNull()).filter((length > 0) & ~F.isnan(length))
    data = written(data, "vectors")
    n = data.count()
    lists = min(lists or max(1, min(LISTS, isqrt(n))), max(n, 1))
    kind = data.schema["k"].dataType
    stored = T.StructType([T.StructField("k", kind), T.StructField("list", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("v", T.ArrayType(T.FloatType()))])
    share = min(1.0, sample / max(n, 1))
    some = data if share == 1 else written(data.filter(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))), "sample")
    centres = learn(some, 1, lists)[0] if n else np.zeros((0, parts), np.float32)
    books = learn(some, parts, min(WORDS, n), centres) if n else [np.zeros((1, 1), np.float32)] * parts
    model = spark.sparkContext.broadcast((centres, books))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = model.value
        for batch in batches:
            x = _matrix(batch.column(1))
            to = _nearest(x, centres)
            code = np.stack([_nearest(p, b) for p, b in zip(_parts(x - centres[to], len(books)), books, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(x), pa.list_(pa.float32()))], names=["k", "list", "code", "v"])

    out = written(data.mapInArrow(encoded, stored), "encoded")
    sizes = F.broadcast(out.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))  # a row for each list
    shelves = shelves or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = out.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).withColumn("shelf", (F.col("list") % shelves))
    blocks = placed.groupBy("shelf", "list", "block").agg(F.collect_list(F.struct("k", "code")).alias("members"))  # about BLOCK of them
    blocks = blocks.select("shelf", "list", "block", F.col("members.k").alias("k"), F.col("members.code").alias("code"))
    blocks.repartition("shelf").sortWithinPartitions("list", "block").write.partitionBy("shelf").mode("overwrite").parquet(f"{folder}/lists")
    placed.select("k", "v", "list", "block").withColumn("shelf", F.pmod(F.xxhash64("k"), F.lit(shelves))).repartition("shelf").sortWithinPartitions("k").write.partitionBy("shelf").mode("overwrite").parquet(f"{folder}/vectors")
    probes = _needed(data, out, centres) if n else 1
    head = spark.createDataFrame([(json.dumps({"shelves": shelves, "key": kind.simpleString(), "probes": probes, "rows": n}), [c.tolist() for c in centres], [b.tolist() for b in books])], "about string, centres array<array<float>>, books array<array<array<float>>>")
    head.coalesce(1).write.mode("overwrite").parquet(f"{folder}/model")
    return VectorIndex(spark, folder)


def _needed(data: DataFrame, encoded: DataFrame, centres: np.ndarray) -> int:
    """Lists to probe for a share of FOUND of the ten nearest neighbours of some rows."""
    asked = data.orderBy(F.xxhash64(F.lit(1), "k"), "k").limit(MEASURED)
    near = nearest_to_each(asked, data, "k", "v").join(encoded.select("k", "list"), "k").join(asked.select(F.col("k").alias("query"), F.col("v").alias("q")), "query")
    rows = near.select("list", "q").collect()  # ten for each of MEASURED
    order = np.argsort(-(_matrix(pa.array([r.q for r in rows], pa.list_(pa.float32()))) @ centres.T), axis=1, kind="stable")
    ranks = np.sort(np.argmax(order == np.array([[r.list] for r in rows]), axis=1))
    return int(ranks[min(len(ranks) - 1, ceil(FOUND * len(ranks)) - 1)]) + 1


class VectorIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        head = spark.read.parquet(f"{folder}/model").first()  # centroids and codebooks: their size doesn't grow with the rows
        about = json.loads(head.about)
        self.shelves, self.key, self.probes, self.rows = about["shelves"], about["key"], about["probes"], about.get("rows")
        self.centres, self.books = np.asarray(head.centres, np.float32), [np.asarray(b, np.float32) for b in head.books]

    def nearest(self, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int | None = None, rerank: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """For each query vector its k nearest of the lists it probes (as many as were measured): query, id, similarity.
        rerank: candidates by codes that are compared exactly (20 times k; from as many as there are rows on, all members of
        a list are compared where they lie, and codes decide nothing).  allowed: ids that may be found; candidates that
        may not count don't take others' places."""
        probes, rerank = min(probes or self.probes, len(self.centres)), rerank or 20 * k
        spark = self.spark
        if not len(self.centres):
            none = T.StructType([T.StructField("query", queries.schema[key].dataType), T.StructField("id", T.DataType.fromDDL(self.key)), T.StructField("similarity", T.DoubleType())])
            return spark.createDataFrame([], none)
        model = spark.sparkContext.broadcast((self.centres, self.books))
        kind = queries.schema[key].dataType
        asked = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("query"), F.col(vector).cast("array<float>").alias("q")).filter((norm(F.col("q")) > 0) & ~F.isnan(norm(F.col("q"))))
        probing = T.StructType([T.StructField("query", kind), T.StructField("q", T.ArrayType(T.FloatType())), T.StructField("list", T.IntegerType())])

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1))
                near = x @ model.value[0].T
                lists = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(len(x)), probes))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(list(x), pa.list_(pa.float32())).take(at), pa.array(lists.ravel().astype(np.int32))], names=["query", "q", "list"])

        sides = asked.mapInArrow(probed, probing)
        many = sides.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("many"))  # a row for each list
        sides = sides.join(F.broadcast(many), "list").withColumn("m", F.pmod(F.xxhash64("query", F.lit(3)), F.col("many")))
        sides = sides.groupBy("list", "m").agg(F.collect_list(F.struct("query", "q")).alias("s"))  # about QUERIES of them
        sides = sides.select("list", F.col("s.query").alias("query"), F.col("s.q").alias("q"))
        lists = spark.read.schema(f"list int, block int, k array<{self.key}>, code array<binary>, shelf int").parquet(f"{self.folder}/lists")
        all_ = self.rows is not None and rerank >= self.rows
        if all_:
            held, what = self._vectors(allowed), "v"
        else:
            held, what = (lists.select("list", "k", "code") if allowed is None else self._only(lists, allowed.select("id"))), "code"
        pairs, rerank = sides.join(held, "list"), 2 * k if all_ else rerank
        schema = T.StructType([T.StructField("query", kind), T.StructField("id", lists.schema["k"].dataType.elementType), T.StructField("near", T.DoubleType())])
        rough = pairs.select("list", "query", "q", "k", what).mapInArrow(_compared(rerank, schema) if all_ else _scored(model, rerank, schema), schema)
        rough = first_n(rough, ["query"], rerank, F.desc("near"), "id")
        stored = spark.read.schema(f"k {self.key}, v array<float>, shelf int").parquet(f"{self.folder}/vectors").select(F.col("k").alias("id"), "v", "shelf")
        rough = rough.withColumn("shelf", F.pmod(F.xxhash64("id"), F.lit(self.shelves)).cast("int"))
        exact = rough.join(stored, ["shelf", "id"]).join(asked, "query").select("query", "id", (dot(F.col("q"), F.col("v")) / norm(F.col("q")) / norm(F.col("v"))).alias("similarity"))
        return first_n(exact, ["query"], k, F.desc("similarity"), "id")

    def _vectors(self, allowed: DataFrame | None) -> DataFrame:
        """Blocks with the vectors of those members that may be found, in place of their codes."""
        each = self.spark.read.schema(f"k {self.key}, v array<float>, list int, block int").parquet(f"{self.folder}/vectors")
        each = each if allowed is None else each.join(allowed.select(F.col("id").alias("k")).distinct(), "k", "left_semi")
        kept = each.groupBy("list", "block").agg(F.collect_list(F.struct("k", "v")).alias("x"))  # about BLOCK of them
        return kept.select("list", F.col("x.k").alias("k"), F.col("x.v").alias("v"))

    def _only(self, lists: DataFrame, ids: DataFrame) -> DataFrame:
        """Blocks with those members that may be found."""
        each = lists.select("list", "block", F.explode(F.arrays_zip("k", "code")).alias("x")).select("list", "block", F.col("x.k").alias("id"), F.col("x.code").alias("code"))
        kept = each.join(ids.distinct(), "id", "left_semi").groupBy("list", "block").agg(F.collect_list(F.struct("id", "code")).alias("x"))
        return kept.select("list", F.col("x.id").alias("k"), F.col("x.code").alias("code"))


def _scored(model, most: int, schema: T.StructType):
    """For each pair of a matrix of queries and a block: the block's best members for each query by their codes."""
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = model.value
        for batch in batches:
            for i in range(batch.num_rows):
                at, asked, q, ids, code = (batch.column(c)[i] for c in range(5))
                x = np.asarray(q.values.flatten(), np.float32).reshape(len(asked.values), -1)
                codes = np.frombuffer(b"".join(code.values.to_pylist()), np.uint8).reshape(len(ids.values), -1)
                near = np.repeat((x @ centres[at.as_py()])[:, None], len(codes), axis=1)
                for p, (part, book) in enumerate(zip(_parts(x, len(books)), books, strict=True)):
                    near += (part @ book.T)[:, codes[:, p]]
                k = min(most, len(codes))
                best = np.argpartition(-near, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([asked.values.take(pa.array(np.repeat(np.arange(len(x)), k))).cast(kinds[0]), ids.values.take(pa.array(best.ravel())).cast(kinds[1]), pa.array(np.take_along_axis(near, best, 1).ravel(), pa.float64())], names=schema.names)

    return run


def _compared(most: int, schema: T.StructType):
    """For each pair of a matrix of queries and a block of vectors: the block's nearest members of each query, and those as near
    as the last of them."""
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, q, ids, v = (batch.column(c)[i] for c in range(1, 5))
                x, y = (np.asarray(m.values.flatten(), np.float64).reshape(len(m.values), -1) for m in (q, v))
                near = x @ y.T
                k = min(most, near.shape[1])
                at, of = np.nonzero(near >= np.partition(near, -k, axis=1)[:, -k, None] - 1e-9)
                yield pa.RecordBatch.from_arrays([asked.values.take(pa.array(at)).cast(kinds[0]), ids.values.take(pa.array(of)).cast(kinds[1]), pa.array(near[at, of], pa.float64())], names=schema.names)

    return run
