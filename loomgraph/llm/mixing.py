"""Mixing sources to target weights by Sainte-Laguë apportionment.

A block is a fixed number of words.  Blocks go to sources by highest quotients
target / (2 seats + 1); each source's blocks go to its shards in the same way.
A shard is a bounded part of a source (by a seeded hash of id and text, so that
rows without an id spread too), so that a source with a third of all rows is many
shards.  In a shard the documents stand in a seeded order and form one stream of
words, cut into blocks (the last one may be shorter).  A shard's quota takes every
block whole rounds over, and for the rest blocks in a seeded shuffle of their
numbers, the last of those in part (its first words).  A task looks at the numbers
of one shard's blocks at a time; only sizes are gathered: one row for each source
and for each shard.

Defined results: a null text has size 0; a null source is a source, the last
one; rows are single documents, whatever their ids (equal rows may swap what is
taken from them); of equal quotients the earlier source or shard has the block;
a text of any length is counted whole, and blocks of it may be taken; no words at all:
nothing is taken; an empty table gives an empty result; other columns pass
through, but for result columns of the same name.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import word_count, words_of, written

#: Rows of a table that may be broadcast (a row here is well under 200 bytes).
BROADCAST_ROWS = 100_000


def sainte_lague(weight: np.ndarray, seats: int, cap: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 seats + 1), none above its cap; the earlier one wins a tie."""
    weight, cap = np.asarray(weight, float), np.asarray(cap, np.int64)
    cap = np.where(weight > 0, cap, 0)
    seats = min(int(seats), int(cap.sum()))
    if seats <= 0:
        return np.zeros(len(weight), np.int64)
    given = lambda x: np.minimum(cap, np.floor(np.minimum(weight * x, 2.0**62) + 0.5).astype(np.int64))
    low, high = 0.0, (2.0 * seats + 2) / weight[weight > 0].min()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if given(mid).sum() <= seats else (low, mid)
    out = given(low * (1 - 1e-12))  # ties go by the queue below
    left = seats - int(out.sum())
    queue = [(-weight[i] / (2 * out[i] + 1), i) for i in np.flatnonzero(out < cap)] if left > 0 else []
    heapq.heapify(queue)
    for _ in range(left):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < cap[i]:
            heapq.heappush(queue, (-weight[i] / (2 * out[i] + 1), i))
    return out


def shares(size: np.ndarray, weight: np.ndarray, total: float, most: float) -> np.ndarray:
    """Targets in proportion to weight; what is above most times the size is shared again until none is above."""
    size, target, free = np.asarray(size, float), np.zeros(len(size)), np.ones(len(size), bool)
    rest = min(total, most * size.sum())
    while free.any():
        share = weight * rest / weight[free].sum()
        over = free & (share > most * size)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = most * size[over]
        rest -= target[over].sum()
        free &= ~over
    return target


def block_takes(total: int, rest: int, block: int, chance: int) -> np.ndarray:
    """Words that are taken (the first ones) of each block of a stream of total words: rest words, by blocks in a seeded shuffle."""
    sizes = np.full(-(-total // block), block, np.int64)
    sizes[-1] -= len(sizes) * block - total
    order = np.random.default_rng(chance & (2**64 - 1)).permutation(len(sizes))
    ends = np.cumsum(sizes[order])
    out = np.empty_like(sizes)
    out[order] = np.clip(rest - ends + sizes[order], 0, sizes[order])
    return out


def _shards(chance: pd.Series, total: pd.Series, rest: pd.Series, block: int):
    """The rows of each shard in a batch, and what is taken of its blocks (with none after the last one)."""
    for (seed, words, some), rows in pd.DataFrame({"c": chance, "t": total, "r": rest}).groupby(["c", "t", "r"]).indices.items():
        if some > 0:
            yield rows, np.append(block_takes(int(words), int(some), block, int(seed)), 0)


def words_taken(block: int) -> Callable[..., Column]:
    """Column function: words of a document (where its shard's stream has it) that lie in taken parts of blocks."""

    @F.pandas_udf("long")
    def count(start: pd.Series, size: pd.Series, total: pd.Series, rest: pd.Series, chance: pd.Series) -> pd.Series:
        out = np.zeros(len(start), np.int64)
        for rows, take in _shards(chance, total, rest, block):
            before = np.cumsum(take) - take
            upto = lambda x: before[x // block] + np.minimum(x % block, take[x // block])
            at = start.to_numpy()[rows]
            out[rows] = upto(at + size.to_numpy()[rows]) - upto(at)
        return pd.Series(out)

    return count


def runs_taken(block: int) -> Callable[..., Column]:
    """As words_taken, but the runs of taken words: the number of words before each run in the document, and its length."""

    @F.pandas_udf("array<struct<at:int,n:int>>")
    def runs(start: pd.Series, size: pd.Series, total: pd.Series, rest: pd.Series, chance: pd.Series) -> pd.Series:
        out: list[list[dict]] = [[] for _ in range(len(start))]
        for rows, take in _shards(chance, total, rest, block):
            for i in rows:
                first, end = int(start.iloc[i]), int(start.iloc[i] + size.iloc[i])
                for b in range(first // block, -(-end // block)):
                    low, high = max(first, b * block), min(end, b * block + int(take[b]))
                    if low >= high:
                        continue
                    if out[i] and out[i][-1]["at"] + out[i][-1]["n"] == low - first:
                        out[i][-1]["n"] += high - low
                    else:
                        out[i].append({"at": low - first, "n": high - low})
        return pd.Series(out)

    return runs


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, shard_words: int = 1_000_000, seed: int = 17, texts: bool = False) -> DataFrame:
    """Rows of docs with size, source_size, target and taken (words the mix takes of it, repeats counted).

    The sources, by code point and null last, weigh as weights repeat, and share share times all words; a target stops at
    most times its source's size.  texts: all columns pass through, and the text too; else only id and source.  With texts,
    taken_runs (at, n) are the words taken beside whole copies.
    """
    key = F.when(F.col(f"`{source_col}`").isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), F.col(f"`{source_col}`"))).alias("__mix_key")
    chance = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).alias("__mix_chance")
    size = word_count(F.col(f"`{text_col}`")).alias("__mix_size")
    kept = [F.col(f"`{c}`") for c in (docs.columns if texts else [id_col, source_col])]
    light = written(docs.select(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), key, chance, size), "sizes")
    rows = docs.select(*kept, key, chance, size) if texts else light

    def per_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__mix_key", key=lambda s: s.map(lambda k: (k == "n", k))).reset_index(drop=True)
        weight = np.array([float(weights[i % len(weights)]) for i in range(len(pdf))])
        words = pdf["words"].to_numpy()
        target = shares(words, weight, share * words.sum(), most)
        cap = np.ceil(most * words / block - 1e-9).astype(np.int64)
        pdf["target"] = target
        full = target >= most * words * (1 - 1e-12)
        blocks = cap.copy()
        blocks[~full] = sainte_lague(target[~full], int(round(target[~full].sum() / block)), cap[~full])
        pdf["blocks"] = blocks
        pdf["shards"] = np.maximum(1, np.ceil(words / shard_words)).astype(np.int64)
        return pdf[["__mix_key", "words", "target", "blocks", "shards"]]

    def per_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__mix_shard").reset_index(drop=True)
        words = pdf["words"].to_numpy()
        pdf["quota"] = sainte_lague(words, int(pdf["blocks"].iloc[0]), np.ceil(most * words / block - 1e-9).astype(np.int64))
        return pdf[["__mix_key", "__mix_shard", "words", "quota"]]

    totals = light.groupBy("__mix_key").agg(F.sum("__mix_size").alias("words"))
    sources = written(totals.withColumn("__mix_all", F.lit(0)).groupBy("__mix_all").applyInPandas(per_source, "__mix_key string, words long, target double, blocks long, shards long"), "sources")

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(F.broadcast(right) if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else right, on)

    def sharded(df: DataFrame) -> DataFrame:
        s = sources.select("__mix_key", F.col("words").alias("__mix_words"), F.col("target").alias("__mix_target"), F.col("blocks").alias("__mix_blocks"), F.col("shards").alias("__mix_shards"))
        return joined(df, s, ["__mix_key"]).withColumn("__mix_shard", F.pmod(F.col("__mix_chance"), F.col("__mix_shards")))

    in_shards = sharded(light).groupBy("__mix_key", "__mix_shard").agg(F.sum("__mix_size").alias("words"), F.first("__mix_blocks").alias("blocks"))
    quotas = written(in_shards.groupBy("__mix_key").applyInPandas(per_shard, "__mix_key string, __mix_shard long, words long, quota long"), "quotas")
    quotas = quotas.select("__mix_key", "__mix_shard", F.col("words").alias("__mix_in"), F.col("quota").alias("__mix_quota"))
    placed = joined(sharded(rows), quotas, ["__mix_key", "__mix_shard"])
    apart = F.when(F.col("__mix_size") == 0, F.col("__mix_chance"))  # rows without words take no place in the stream
    stream = Window.partitionBy("__mix_key", "__mix_shard", apart).orderBy("__mix_chance", F.col(f"`{id_col}`"), "__mix_size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("__mix_size").over(stream) - F.col("__mix_size")
    want = F.least(F.col("__mix_quota") * block, F.floor(F.col("__mix_in") * most)).cast("long")
    placed = placed.withColumn("__mix_start", start).withColumn("__mix_want", want)
    rounds = F.when(F.col("__mix_in") > 0, F.floor(F.col("__mix_want") / F.col("__mix_in"))).otherwise(0)
    rest = F.col("__mix_want") - rounds * F.col("__mix_in")
    where = (F.col("__mix_start"), F.col("__mix_size"), F.col("__mix_in"), rest, F.xxhash64(F.lit(seed), "__mix_key", "__mix_shard"))
    if texts:
        placed = placed.withColumn("__mix_runs", runs_taken(block)(*where))
        once = F.aggregate("__mix_runs", F.lit(0).cast("long"), lambda n, run: n + run["n"])
    else:
        once = words_taken(block)(*where)
    new = {"size": F.col("__mix_size"), "source_size": F.col("__mix_words"), "target": F.col("__mix_target"), "taken": (rounds * F.col("__mix_size") + once).cast("long")}
    if texts:
        new |= {"taken_runs": F.col("__mix_runs")}
    names = docs.columns if texts else [id_col, source_col]
    return placed.select(*[F.col(f"`{c}`") for c in names if c not in new], *[c.alias(n) for n, c in new.items()])


def mixed_texts(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: a row for each whole copy that it takes of a document, and one for the blocks that it takes beside
    those (the words of a run joined by one space, runs by \\n); the columns of docs."""
    added = ("size", "source_size", "target", "taken", "taken_runs")
    marked = docs.withColumnsRenamed({c: f"__own_{c}" for c in added if c in docs.columns})
    out = mix(marked, text_col=text_col, texts=True, **options)
    text: Column = F.col(f"`{text_col}`")
    part = F.aggregate("taken_runs", F.lit(0).cast("long"), lambda n, run: n + run["n"])
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    pieces = F.concat(F.array_repeat(F.lit(True), copies), F.when((part > 0) & (part < F.col("size")), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    out = out.withColumn("__mix_whole", F.explode(pieces))
    runs = F.transform(F.array(words_of(text)), lambda w: F.array_join(F.transform("taken_runs", lambda run: F.array_join(F.slice(w, run["at"] + 1, run["n"]), " ")), "\n"))
    out = out.withColumn(text_col, F.when(F.col("__mix_whole"), text).otherwise(runs[0]))
    return out.select(*[F.col(f"`__own_{c}`").alias(c) if f"__own_{c}" in marked.columns else F.col(f"`{c}`") for c in docs.columns])
