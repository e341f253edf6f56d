"""Trigram postings of names as stored tables, for similarity above a threshold.

A name's distinct trigrams stand in the order of how many names of its kind hold
them.  A posting has the name's number of trigrams (the table is partitioned by
it) and the trigrams in that order.  Names at least t alike have sizes within a
factor of t, share k trigrams among the first size - ceil(t size) + k of either
(if they share k at all), and have enough trigrams left after those; the first is
a filter on folders, the others are made when names meet by k trigrams at once.
k is the greatest for which a name has few such choices: of numbered names very
many share one trigram, and few share three rare ones.  What remains is compared
by whole trigram sets.
"""

from __future__ import annotations

from math import ceil, comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import first_per_key, written

#: Thresholds by which the most alike name is looked for, from the top: few names are left for the lower, dearer ones.
STEPS = (0.9, 0.75, 0.6, 0.45)

#: The most trigrams by which names meet at once, and the most choices of them that a name of the index may have.
AT_ONCE, CHOICES = 3, 200


def _at_once(size: int, least: float) -> int:
    """How many trigrams a name of that size has at least in common with one so alike, and meets it by."""
    longest = int(size / least + 1e-9)
    for k in range(AT_ONCE, 1, -1):
        if ceil(least * size - 1e-9) >= k and comb(longest - ceil(least * longest - 1e-9) + k, k) <= CHOICES:
            return k
    return 1


def _choices(least: float, k: int) -> Column:
    """Each choice of k of the first trigrams of a row (grams in order, size, unknown: so many at the start that the index lacks):
    an array of the choice's hash and the place of its last trigram."""
    size, unknown = F.col("size"), F.col("unknown")
    head = F.slice("grams", unknown + 1, F.greatest(size - F.ceil(least * size - 1e-9).cast("int") + k - unknown, F.lit(0)))
    made = F.transform(head, lambda g, i: F.struct(F.xxhash64(g).alias("sign"), (i + 1).alias("last")))
    for _ in range(k - 1):
        further = lambda c: F.transform(F.slice(head, c["last"] + 1, F.size(head)), lambda g, i: F.struct(F.xxhash64(c["sign"], g).alias("sign"), (c["last"] + i + 1).alias("last")))
        made = F.flatten(F.transform(made, further))
    return F.transform(made, lambda c: F.struct(c["sign"].alias("sign"), (c["last"] + unknown).alias("last")))


def _kind(rows: DataFrame, kind: str | None) -> Column:
    return F.lit("") if kind is None else F.coalesce(F.col(kind).cast("string"), F.lit(""))


def build(names: DataFrame, key: str, name: str, folder: str, kind: str | None = None) -> TrigramIndex:
    """Writes an index of names to folder.  kind: a column; only names of one kind are compared.  Null names aren't indexed."""
    spark = names.sparkSession
    members = names.filter(F.col(name).isNotNull()).select(_kind(names, kind).alias("kind"), F.col(name).alias("name"), F.col(key).alias("id"))
    members.write.mode("overwrite").parquet(f"{folder}/members")
    members = spark.read.schema(members.schema).parquet(f"{folder}/members")
    sets = members.groupBy("kind", "name").agg(F.min("id").alias("first")).withColumn("grams", X.trigrams(F.col("name"))).filter(F.size("grams") > 0)
    sets.write.mode("overwrite").parquet(f"{folder}/names")
    sets = spark.read.schema(sets.schema).parquet(f"{folder}/names")
    rare = sets.select("kind", F.explode("grams").alias("gram")).groupBy("kind", "gram").agg(F.count("*").alias("n"))
    rare.write.mode("overwrite").parquet(f"{folder}/rarity")
    index = TrigramIndex(spark, folder, members.schema["id"].dataType.simpleString())
    index._ordered(sets.select("kind", "first", "grams"), ["kind", "first"]).drop("unknown").repartitionByRange("size", "kind", "first").write.partitionBy("size").mode("overwrite").parquet(f"{folder}/postings")
    return index


class TrigramIndex:
    def __init__(self, spark: SparkSession, folder: str, id_type: str = "string"):
        self.spark, self.folder = spark, folder
        self._postings = f"kind string, first {id_type}, grams array<string>, size int"

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def _ordered(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """rows (keys, grams) with the trigrams in order, their number (size), and how many at the start the index lacks (unknown)."""
        each = rows.select(*keys, F.explode("grams").alias("gram"))
        each = each.join(self.spark.read.schema("kind string, gram string, n long").parquet(f"{self.folder}/rarity"), ["kind", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        one = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("all"))
        return one.select(*keys, F.col("all.gram").alias("grams"), F.size("all").alias("size"), F.size(F.filter("all", lambda s: s["n"] == 0)).alias("unknown"))

    def _met(self, asked: DataFrame, least: float) -> DataFrame:
        """asked (ordered: kind, name, grams, size, unknown) with each name (first) of the kind that may be so alike."""
        postings = self.spark.read.schema(self._postings).parquet(f"{self.folder}/postings").withColumn("unknown", F.lit(0))
        by: dict[int, list[int]] = {1: []}
        for r in asked.select("size").distinct().collect():  # sizes of names
            by.setdefault(_at_once(r.size, least), []).append(r.size)
        met = None
        for k, sizes in by.items():
            q = asked.filter(F.col("size").isin(sizes)).select("kind", "name", F.col("size").alias("q_size"), F.explode(_choices(least, k)).alias("q")).select("kind", "name", "q_size", "q.sign", F.col("q.last").alias("q_last"))
            p = postings.filter(F.col("size").between(int(least * min(sizes, default=1)), int(max(sizes, default=0) / least) + 1))
            p = p.select("kind", "first", "size", F.explode(_choices(least, k)).alias("p")).select("kind", "first", "size", "p.*")
            shared = F.ceil(least / (1 + least) * (F.col("q_size") + F.col("size")) - 1e-9)
            near = (F.col("size") >= least * F.col("q_size") - 1e-9) & (F.col("q_size") >= least * F.col("size") - 1e-9) & (k + F.least(F.col("q_size") - F.col("q_last"), F.col("size") - F.col("last")) >= shared)
            some = q.join(p, ["kind", "sign"]).filter(near).select("kind", "name", "first")
            met = some if met is None else met.unionByName(some)
        return met.distinct()

    def _pairs(self, asked: DataFrame, least: float) -> DataFrame:
        """asked (ordered) with each name (first) of the kind that is at least so alike, and the similarity."""
        sets = self._read("names").select("kind", "first", F.col("grams").alias("h"), F.col("name").alias("known"))
        both = self._met(asked, least).join(asked.select("kind", "name", "grams"), ["kind", "name"]).join(sets, ["kind", "first"])
        return both.select("kind", "name", "first", "known", X.set_similarity(F.col("grams"), F.col("h")).alias("score")).filter(F.col("score") >= least - 1e-12)

    def _asked(self, names: DataFrame, name: str, kind: str | None) -> DataFrame:
        rows = names.filter(F.col(name).isNotNull()).select(_kind(names, kind).alias("kind"), F.col(name).alias("name")).distinct()
        rows = rows.withColumn("grams", X.trigrams(F.col("name"))).filter(F.size("grams") > 0)
        return written(self._ordered(rows, ["kind", "name"]), "asked")

    def alike(self, names: DataFrame, name: str, above: float, kind: str | None = None) -> DataFrame:
        """All ids whose names are more alike to a given one than above: kind, name, id, score."""
        found = self._pairs(self._asked(names, name, kind), above).filter(F.col("score") > above)
        members = self._read("members").withColumnRenamed("name", "known")
        return found.join(members, ["kind", "known"]).select("kind", "name", "id", "score")

    def best(self, names: DataFrame, name: str, above: float, kind: str | None = None) -> DataFrame:
        """The most alike id (the smallest of equals) of each given name, if it is more alike than above: kind, name, id, score.

        The threshold falls step by step; a name that has a match at a step has its best one there."""
        left, found = self._asked(names, name, kind), None
        for least in [*(s for s in STEPS if s > above), above]:
            step = first_per_key(self._pairs(left, least).filter(F.col("score") > above), ["kind", "name"], F.desc("score"), "first")
            step = written(step.select("kind", "name", F.col("first").alias("id"), "score"), "alike")
            found = step if found is None else found.unionByName(step)
            left = left.join(step.select("kind", "name"), ["kind", "name"], "left_anti")
            if least != above:
                left = written(left, "left")
                if left.isEmpty():
                    break
        return found
