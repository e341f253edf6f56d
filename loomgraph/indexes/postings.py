"""A positional inverted index as a stored table.

A row of the postings holds a form of a term and its documents of one block: how
many, the most occurrences in one of them, their numbers in the block and their
places.  A block's ids stand once, in a table of their own with a folder for each
task that made blocks.  Blocks hold documents of like length, so that a block's
maximum is near its members' ranks.  Rows are sorted by range of (term, block) into
shelves, a folder each; a small table has each shelf's first and last term.  A
search opens the shelves of its terms only.

Ranks are those of functions.text: alternatives, of which a term's share follows
from its number of occurrences alone.  A top-k search looks at the blocks' bounds
first, ranks the documents of the most promising blocks, and then only those blocks
whose bound reaches the k-th rank found so far.

A build makes the blocks where the texts are read, and shuffles the finished rows once, by term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.stem import with_stems
from ..storage import removed, written

#: Documents of a block, and its words (more only if one document has more); documents of terms that a shelf has at most by
#: default, so that its task sorts them in memory; rows from which a shelf's bounds are taken.
BLOCK, WORDS, SHELF, SAMPLED = 1024, 1 << 21, 1 << 21, 100
OWN = "term string, block long, n long, most int, docs array<int>, ends array<int>, at array<int>, ids array<string>"
ROWS = "term string, block long, n long, most int, docs array<int>, ends array<int>, at array<int>, shelf int"
IDS = "block long, ids array<string>, part long"
ANALYZERS = ("plain", "english")


def build(rows: DataFrame, key: str, text: Column, folder: str, analyzer: str = "plain", shelves: int | None = None, block: int = BLOCK) -> TextIndex:
    """Writes an index of rows' texts, by their key (unique, as a string), to folder.

    plain keeps the terms of functions.text; english stems the terms of each block, and the forms of a stem keep rows of their own."""
    if analyzer not in ANALYZERS:
        raise ValueError(f"an analyzer is one of {ANALYZERS}")
    spark = rows.sparkSession
    docs = rows.select(F.col(key).cast("string").alias("id"), X.terms(text).alias("terms")).select("id", F.concat_ws(" ", "terms").alias("line"), F.size("terms").alias("n"))
    placed = docs.sortWithinPartitions(F.desc("n"), "id").select(F.spark_partition_id().cast("long").alias("part"), "id", "n", "line")
    made = placed.mapInArrow(_in_blocks(block), OWN)
    if analyzer == "english":
        made = with_stems(made).withColumn("term", F.col("stem")).drop("stem")
    made = written(made, "words")
    made.filter("term is null").select("block", "ids", _part().alias("part")).write.partitionBy("part").mode("overwrite").parquet(f"{folder}/ids")
    own = made.filter("term is not null").drop("ids")
    held = own.agg(F.sum("n")).first()[0] or 1
    shelves = shelves or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // SHELF))
    shelved = own.withColumn("shelf", _shelf(_bounds_of_shelves(own, shelves, held)))
    sorted_ = shelved.repartitionById(shelves, F.col("shelf")).sortWithinPartitions("shelf", "term", "block")
    sorted_.write.partitionBy("shelf").mode("overwrite").parquet(f"{folder}/postings")
    removed(made)
    stored = spark.read.schema(ROWS).parquet(f"{folder}/postings")
    stored.groupBy("shelf").agg(F.min("term").alias("low"), F.max("term").alias("high")).repartition(1).write.mode("overwrite").parquet(f"{folder}/shelves")  # a row for each shelf
    return TextIndex(spark, folder, analyzer)


def _in_blocks(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's documents (part, id, n, line), as they come, cut into blocks; a row for each term of a block, and one without a
    term for its ids.  Documents without terms are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, docs, words = 0, [], 0, 0
        for batch in batches:
            batch, start = batch.filter(pc.greater(batch["n"], 0)), 0
            for i, n in enumerate(batch["n"].to_pylist()):
                if docs == block or docs and words + n > WORDS:
                    yield from _postings([*held, batch.slice(start, i - start)], number)
                    number, held, docs, words, start = number + 1, [], 0, 0, i
                docs, words = docs + 1, words + n
            held.append(batch.slice(start))
        yield from _postings(held, number)

    return run


def _postings(batches: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """The rows of one block: terms with the numbers of their documents, by id, and places."""
    if not sum(b.num_rows for b in batches):
        return
    rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    order = pc.sort_indices(rows["id"])
    ids, terms = rows["id"].take(order), pc.split_pattern(rows["line"].take(order), " ")
    sizes = pc.list_value_length(terms).to_numpy()
    coded = terms.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pair = coded.indices.to_numpy().astype(np.int64) * len(sizes) + doc
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))  # of a term's document
    term, doc = np.divmod(pair[starts], len(sizes))
    first = np.flatnonzero(np.diff(term, prepend=-1))  # of a term
    many = np.diff(np.append(starts, len(pair)))
    held = np.diff(np.append(first, len(term)))  # documents of a term
    lists = lambda ends, n, values: pa.ListArray.from_arrays(pa.array(np.append(ends, n), pa.int32()), pa.array(values, pa.int32()))
    docs = [lists(first, len(term), doc), lists(first, len(term), starts + many - np.repeat(starts[first], held)), lists(starts[first], len(pair), at[order])]
    own = (rows["part"][0].as_py() << 32) + number
    table = lambda *columns: pa.RecordBatch.from_arrays(list(columns), ["term", "block", "n", "most", "docs", "ends", "at", "ids"])
    none = lambda n, kind: pa.nulls(n, pa.list_(kind))
    yield table(pa.nulls(1, pa.string()), pa.array([own]), pa.array([len(ids)]), pa.nulls(1, pa.int32()), *[none(1, pa.int32())] * 3, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids))
    yield table(coded.dictionary.take(pa.array(term[first])), pa.array(np.full(len(first), own)), pa.array(held), pa.array(np.maximum.reduceat(many, first), pa.int32()), *docs, none(len(first), pa.string()))


def _part() -> Column:
    """The task that made a row's block."""
    return F.shiftright("block", 32)


def _docs() -> Column:
    """A row's documents with their places, from its flat lists and the ids of its block."""
    start = lambda i: F.when(i > 0, F.get("ends", i - 1)).otherwise(0)
    return F.transform("docs", lambda d, i: F.struct(F.get("ids", d).alias("id"), F.slice("at", start(i) + 1, F.get("ends", i) - start(i)).alias("at")))


def _bounds_of_shelves(own: DataFrame, shelves: int, held: int) -> list[tuple[str, int]]:
    """The first (term, block) of every shelf but the first, so that shelves hold about as many documents of terms each; from a
    sample of rows, SAMPLED for each shelf, by the documents that they have."""
    rate = min(1.0, shelves * SAMPLED / held)
    chance = F.pmod(F.xxhash64("term", "block"), F.lit(1 << 30)) / (1 << 30)
    some = sorted((r.term, r.block, max(r.n, 1 / rate)) for r in own.filter(chance < F.col("n") * rate).select("term", "block", "n").collect())
    ends, bounds = np.cumsum([w for *_, w in some]), []
    for k in range(1, shelves):
        i = int(np.searchsorted(ends, k * ends[-1] / shelves)) if some else 0
        if i + 1 < len(some) and (not bounds or bounds[-1] < some[i + 1][:2]):
            bounds.append(some[i + 1][:2])
    return bounds


def _shelf(bounds: list[tuple[str, int]], first: int = 0) -> Column:
    """The number of bounds that a row's (term, block) has reached, by halves."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    term, block = bounds[half]
    before = (F.col("term") < term) | ((F.col("term") == term) & (F.col("block") < block))
    return F.when(before, _shelf(bounds[:half], first)).otherwise(_shelf(bounds[half + 1 :], first + half + 1))


def weight(n: Column) -> Column:
    """What n occurrences of a term add to a rank."""
    series = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
    return 0.1 * series / X.BASIS


@dataclass
class Asked:
    """A query in the index's terms: clauses that all must hold, and words of which any may."""

    clauses: list[X.Clause]
    broad: list[str]

    @property
    def strict(self) -> list[str]:
        return X.clause_terms(self.clauses)

    @property
    def terms(self) -> list[str]:
        every = [t for c in self.clauses for p in c.phrases for t in p]
        return list(dict.fromkeys(every + self.broad))


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str, analyzer: str = "plain"):
        self.spark, self.folder, self.analyzer = spark, folder, analyzer

    def asked(self, query: str, broad: bool = True) -> Asked:
        clauses, words = X.websearch(query), X.broad_terms(query) if broad else []
        if self.analyzer == "english":
            every = sorted({t for c in clauses for p in c.phrases for t in p} | set(words))
            rows = with_stems(self.spark.createDataFrame([(t,) for t in every], "term string")).collect()  # the query's words
            stem = {r.term: r.stem for r in rows}
            clauses = [X.Clause(tuple(tuple(stem[t] for t in p) for p in c.phrases), c.negated) for c in clauses]
            words = list(dict.fromkeys(stem[w] for w in words))
        return Asked(clauses, words)

    def shelves_of(self, terms: list[str]) -> list[int]:
        ranges = self.spark.read.parquet(f"{self.folder}/shelves")
        reach = F.lit(False)
        for t in terms:
            reach = reach | ((F.col("low") <= t) & (F.col("high") >= t))
        return sorted(r.shelf for r in ranges.filter(reach).select("shelf").collect())  # shelves of the query's terms

    def postings(self, terms: list[str]) -> DataFrame:
        """The rows of these terms, from the shelves that hold them."""
        return self.spark.read.schema(ROWS).parquet(f"{self.folder}/postings").filter(F.col("shelf").isin(self.shelves_of(terms)) & F.col("term").isin(terms))

    def search(self, query: str, broad: bool = True, limit: int | None = None, allowed: DataFrame | None = None, first: int = 8) -> DataFrame:
        """Documents (id, rank) that match: by the rank of the whole query, or 0.65 of that of any of its words, whichever is
        more.  allowed: ids that may be found.  limit: the best only, by rank and id; the bounds of blocks then tell which
        ones needn't be read (the first ones read are so many)."""
        asked = self.asked(query, broad)
        if not asked.terms:
            return self.spark.createDataFrame([], "id string, rank double")
        rows = self.postings(asked.terms)
        if limit is None:
            return self._ranked(rows, asked, allowed)
        _, also, found = self._promising(rows, asked, allowed, limit, first)
        rest = self._ranked(rows.join(also, "block", "left_semi"), asked, allowed)
        known = self.spark.createDataFrame([tuple(r) for r in found], "id string, rank double")
        return known.unionByName(rest).orderBy(F.desc("rank"), "id").limit(limit)

    def _promising(self, rows: DataFrame, asked: Asked, allowed: DataFrame | None, limit: int, first: int) -> tuple[list[int], DataFrame, list]:
        """The blocks with the highest bounds, the other ones whose bound reaches the limit-th rank in them, and the documents
        found there (at most limit)."""
        bounds = self._bounds(rows, asked)
        best = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(first).select("block").collect()]
        found = self._ranked(rows.filter(F.col("block").isin(best)), asked, allowed).orderBy(F.desc("rank"), "id").limit(limit).collect()
        least = found[-1]["rank"] if len(found) == limit else 0.0
        return best, bounds.filter((F.col("bound") >= least - 1e-12) & ~F.col("block").isin(best)).select("block"), found

    def blocks_read(self, query: str, limit: int, first: int = 8) -> tuple[int, int]:
        """How many blocks a top-k search ranks, and how many its terms have."""
        asked = self.asked(query)
        rows = self.postings(asked.terms)
        best, also, _ = self._promising(rows, asked, None, limit, first)
        return len(best) + also.count(), rows.select("block").distinct().count()

    def _bounds(self, rows: DataFrame, asked: Asked) -> DataFrame:
        """For each block the highest rank that one of its documents can have."""
        most = lambda t: F.sum(F.when(F.col("term") == t, F.col("most")).otherwise(0)).cast("int")  # noqa: E731 - of all forms

        def share(terms: list[str]) -> Column:
            total = F.lit(0.0)
            for t in terms:
                total = total + weight(most(t))
            return total / len(terms) if terms else F.lit(0.0)

        return rows.groupBy("block").agg(F.greatest(share(asked.strict), 0.65 * share(asked.broad)).alias("bound"))

    def _ranked(self, rows: DataFrame, asked: Asked, allowed: DataFrame | None) -> DataFrame:
        ids = self.spark.read.schema(IDS).parquet(f"{self.folder}/ids")
        hits = rows.withColumn("part", _part()).join(ids, ["part", "block"]).select("term", "block", F.explode(_docs()).alias("doc")).select("term", "block", "doc.id", "doc.at")
        if allowed is not None:
            hits = hits.join(allowed.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
        docs = hits.groupBy("block", "id").agg(F.collect_list(F.struct("term", "at")).alias("hits"))  # an entry for each form of an asked term
        names = {t: f"at{n}" for n, t in enumerate(asked.terms)}
        of = lambda t: F.flatten(F.transform(F.filter("hits", lambda h: h["term"] == t), lambda h: h["at"]))
        docs = docs.select("id", *[of(t).alias(n) for t, n in names.items()])
        docs = docs.select("*", *[weight(F.size(n)).alias(f"w_{n}") for n in names.values()])
        at = lambda t: F.col(names[t])

        def phrase(p: tuple[str, ...]) -> Column:
            if len(p) == 1:
                return F.size(at(p[0])) > 0

            def follows(start: Column) -> Column:
                out = F.lit(True)
                for i, t in enumerate(p[1:], 1):
                    out = out & F.array_contains(at(t), start + i)
                return out

            return F.exists(at(p[0]), follows)

        def rank(terms: list[str]) -> Column:
            total = F.lit(0.0)
            for t in terms:
                total = total + F.col(f"w_{names[t]}")
            return total / len(terms) if terms else F.lit(0.0)

        holds = F.lit(bool(asked.clauses))
        for c in asked.clauses:
            any_ = F.lit(False)
            for p in c.phrases:
                any_ = any_ | phrase(p)
            holds = holds & (~any_ if c.negated else any_)
        score: Callable[[list[str]], Column] = rank
        best = F.greatest(F.when(holds, score(asked.strict)).otherwise(0.0), 0.65 * score(asked.broad))
        some = F.filter(F.array(best), lambda r: r > 0)  # in this form nothing is evaluated once more in a filter
        return docs.select("id", F.explode(some).alias("rank"))
