"""Near-duplicate documents by ProbMinHash, banding and verification.

Shingles are five words (a shorter text with words is one shingle), weighted by
1 + ln(times in the text).  Each shingle is a Poisson process with its weight as
rate: its arrivals come at exponential gaps, and each goes to a register that
the shingle's hash picks.  A register keeps the shingle that arrived first, so
two texts agree in a register with their probability Jaccard similarity, the sum
over shared shingles of 1 / sum(max(x'/x, y'/y)) over all shingles x', y' of the
two texts.  A text's arrivals end as soon as they come later than its last
register was filled.

This one measure decides everything: registers agree with its probability, the
bands and the sketch cut are set by it, and a pair is linked if its exact value
is at least 0.8.  (Where no text repeats a shingle it is the Jaccard similarity
of the shingle sets; weights "equal" make it that everywhere.)

Forty bands of six registers find candidates: a pair at 0.8 is missed with a
probability of 5e-6.  Copies of one text are one node.  In each bucket all nodes
are compared with the smallest one first, then with another; only nodes that this
leaves in different components are compared with each other, in blocks of a
bounded size, inside a task, so that no rows are made for pairs that aren't
alike.  A sketch of a byte of each register rules out pairs far below (4.5
standard deviations of the estimate, 3e-6).  The text that many pairs share is
dealt over several keys, so that its pairs are verified in many tasks.  Classes
are the connected components.

Defined results: rows are documents, so one id on rows with different texts may
have several classes, and repeated rows share one; class_id is the smallest id
among a class's rows; a null, empty or blank text has no shingles and only its
exact copies are its class; a null id is never compared: it has a null class and
stays; ties (a pair at exactly the threshold) are links; a text of any length is
shingled whole; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, as_signed, gram_hashes, list_array, mix, powers, removed, slices, text_bytes, written

SHINGLE, BANDS, ROWS = 5, 40, 6
REGISTERS = SKETCH = 480  # the first BANDS * ROWS make the bands
BLOCK = 1000
FAN = 500  # pairs of one text that are verified under one key
WEIGHTS = ("log_count", "equal")
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Document and 64-bit hash of every shingle."""
    if not len(words.start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    by = gram_hashes(words.hashes(), tuple(range(1, SHINGLE + 1)))
    left, doc = words.left(), words.document()
    whole = np.flatnonzero(left >= SHINGLE)
    parts = [(doc[whole], mix(by[SHINGLE][whole]))]
    for k in range(1, SHINGLE):
        short = words.bound[:-1][words.count == k]
        parts.append((doc[short], mix(by[k][short] + np.uint64(k))))
    return np.concatenate([d for d, _ in parts]), np.concatenate([h for _, h in parts])


def distinct(doc: np.ndarray, h: np.ndarray, weights: str = "equal") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct hashes with their weights, in the order of documents."""
    _, at, times = np.unique(mix(h + mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    order = np.argsort(doc[at], kind="stable")
    weight = np.ones(len(order)) if weights == "equal" else 1 + np.log(times[order])
    return doc[at][order], h[at][order], weight


def probability_jaccard(a: tuple, b: tuple, n: int) -> np.ndarray:
    """Exact similarity of n pairs of weighted sets: a and b hold the pair, hash and weight of each element.

    For a shared element with r = y/x, max(x'/x, y'/y) is x'/x where r' <= r, and y'/y elsewhere."""
    pair, h, weight = (np.concatenate(c) for c in zip(a, b, strict=True))
    key = mix(h + mix(pair.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")  # a's element comes before b's
    twin = np.flatnonzero(key[order][1:] == key[order][:-1])
    x, y, of = weight[order[twin]], weight[order[twin + 1]], pair[order[twin]]
    by_ratio = np.lexsort((y / x, of))
    x, y, of = x[by_ratio], y[by_ratio], of[by_ratio]
    all_x, all_y = (np.bincount(s[0], s[2], n)[of] for s in (a, b))
    own_x, own_y = (np.bincount(of, v, n)[of] for v in (x, y))
    begin = np.searchsorted(of, of)
    sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (x, y)]
    upto_x, upto_y = (s[1:] - s[begin] for s in sums)
    total = (all_x - own_x + upto_x) / x + (all_y - upto_y) / y
    return np.bincount(of, 1 / total, n)


def registers(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """For each document and register, the arrival time (float32) and hash (32 bits) of the shingle that came first."""
    best = np.full(n_docs * m, FULL)
    elements = np.bincount(doc, minlength=n_docs)
    share = np.ceil(m * (np.log(m) + 2) / np.maximum(elements, 1)).astype(np.int64)[doc]
    live, time, drawn = np.arange(len(doc)), np.zeros(len(doc)), np.zeros(len(doc), np.int64)
    while len(live):
        k = share[live]
        element = np.repeat(live, k)
        begin = np.cumsum(k) - k
        number = np.arange(len(element)) - np.repeat(begin, k)
        u = mix(h[element] + (drawn[element] + number + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        if (k == 1).all():
            arrival = time[element] + gap / weight[element]
        else:
            run = np.cumsum(gap)
            before = run[begin] - gap[begin]
            arrival = time[element] + (run - np.repeat(before, k)) / weight[element]
        place = doc[element] * m + ((mix(u) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        key = (arrival.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (h[element] >> np.uint64(32))
        np.minimum.at(best, place, key)
        time[live], drawn[live] = arrival[begin + k - 1], drawn[live] + k
        last = (best.reshape(n_docs, m).max(axis=1) >> np.uint64(32)).astype(np.uint32)
        limit = np.where(last == 0xFFFFFFFF, np.float32(np.inf), last.view(np.float32))
        live = live[time[live].astype(np.float32) <= limit[doc[live]]]
        share = np.maximum(share // 4, 1)
    return best.reshape(n_docs, m)


def _sketches(weights: str):
    """From id, digest and text: band hashes (none without shingles) and the sketch."""
    code = powers(0x9E6C63D0676A9A99, ROWS + 1)
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20, 250):
                words = Words(*text_bytes(part.column(2)))
                best = registers(*distinct(*shingles(words), weights), part.num_rows)
                low = best & np.uint64(0xFFFFFFFF)
                has = words.count > 0
                bands = mix(mix((low[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS) * code[1:]).sum(axis=2, dtype=np.uint64)) + salt)
                sketch = low[:, :SKETCH].astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), list_array(as_signed(bands[has].ravel()), has * BANDS, pa.int64()), pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["k", "t", "bands", "sketch"],
                )

    return run


def least_agreement(threshold: float) -> float:
    """Share of equal registers that a pair at the threshold falls below with a probability of 3e-6."""
    return threshold - 4.5 * (threshold * (1 - threshold) / SKETCH) ** 0.5


def _alike(low: float):
    """Pairs whose sketches agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
            keep = (a == b).mean(axis=1) >= low
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    return run


def _crossed(low: float):
    """From rows (b, i, j, own, n, label, sketch, bands) in the order of the first three: pairs of one block pair of a bucket
    with different labels and sketches that agree enough, each in its first common bucket only."""

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        here, i, j = rows[0][:3]
        own, k, label = (np.array([r[x] for r in rows]) for x in (3, 4, 5))
        if len(rows) < 2 or (label == label[0]).all():
            return []
        sketch = np.frombuffer(b"".join(r[6] for r in rows), np.uint8).reshape(-1, SKETCH)
        bands = np.array([r[7] for r in rows])
        out = []
        step = max(1, (16 << 20) // (SKETCH * len(rows)))
        for at in range(0, len(rows), step):
            part = slice(at, at + step)
            near = (label[part, None] < label[None]) & ((own[part, None] != own[None]) if i != j else True)
            x, y = np.nonzero(near)
            for cut in range(0, len(x), 50_000):
                p, q = x[cut : cut + 50_000] + at, y[cut : cut + 50_000]
                fine = (sketch[p] == sketch[q]).mean(axis=1) >= low
                p, q = p[fine], q[fine]
                same = bands[p] == bands[q]
                first = bands[p, same.argmax(axis=1)] == here if len(p) else np.zeros(0, bool)
                out += zip(np.minimum(k[p], k[q])[first].tolist(), np.maximum(k[p], k[q])[first].tolist(), strict=True)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        make = lambda found: pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.int64()) for n in (0, 1)], names=["a", "b"])
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and rows[-1][:3] != row[:3]:
                    if found := pairs(rows):
                        yield make(found)
                    rows = []
                rows.append(row)
        if rows and (found := pairs(rows)):
            yield make(found)

    return run


def _verified(threshold: float, weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", 1 << 20):
                for piece in slices(part, "text_b", 1 << 20):
                    a, b = (distinct(*shingles(Words(*text_bytes(piece.column(i)))), weights) for i in (2, 3))
                    keep = pa.array(probability_jaccard(a, b, piece.num_rows) >= threshold - 1e-9)
                    yield pa.RecordBatch.from_arrays([piece.column(0).filter(keep), piece.column(1).filter(keep)], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """Nodes (n) and the smallest node of their component (label) for edges (a, b).  Smallest labels spread along edges and
    then jump to their labels' labels, so that the number of rounds grows with the logarithm of a component's width."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    step = written(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("a"), F.min("b")).alias("label")).withColumn("moved", F.lit(True)), "labels")
    while not step.filter("moved").isEmpty():
        before, label = step, step.select("n", "label")
        near = both.join(label, both["b"] == label["n"]).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label["n"] == near["a"], "left").select("n", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = step.select(F.col("n").alias("j"), F.col("new").alias("far"))
        new = F.coalesce("far", "new")
        step = written(step.join(jump, step["new"] == jump["j"], "left").select("n", new.alias("label"), (F.col("label") != new).alias("moved")), "labels")
        removed(before)
    removed(both)
    return step.select("n", "label")


def _merged(label: DataFrame, found: DataFrame) -> DataFrame:
    """label (n, label) with the components that the links found join: only links between components are followed."""
    own = lambda side: F.coalesce(f"label_{side}", side)
    named = found
    for side in ("a", "b"):
        named = named.join(label.select(F.col("n").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    between = written(named.select(own("a").alias("a"), own("b").alias("b")).filter("a <> b"), "between")
    if between.isEmpty():
        removed(between)
        return label
    moved = components(between)
    removed(between)
    known = label.join(moved.select(F.col("n").alias("m"), F.col("label").alias("new")), F.col("label") == F.col("m"), "left").select("n", F.coalesce("new", "label").alias("label"))
    return written(known.unionByName(moved.join(label, "n", "left_anti")), "labels")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, weights: str) -> DataFrame:
    """For each distinct text with an id: its digest t, smallest id k, class_id, whether it is its class's first text, n_links."""
    if weights not in WEIGHTS:
        raise ValueError(f"weights must be one of {WEIGHTS}")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("k"), text.alias("text")).filter("k is not null").select("k", F.md5("text").alias("t"), "text")
    sketches = written(keyed.mapInArrow(_sketches(weights), "k long, t string, bands array<long>, sketch binary"), "sketches")
    nodes = sketches.groupBy("t").agg(F.min("k").alias("k"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.withColumn("n", F.monotonically_increasing_id()), "nodes")
    removed(sketches)
    bands = nodes.select("n", F.explode("bands").alias("b"))
    leaders = bands.groupBy("b").agg(F.min("n").alias("a"), F.max("n").alias("z")).filter("a < z").select("b", "a")
    members = written(bands.join(leaders, "b"), "members")
    wanted = nodes.select("n", "k", "t").join(members.select("n").distinct(), "n")
    texts = written(keyed.join(wanted, ["k", "t"]).dropDuplicates(["k", "t"]).select("n", "text"), "texts")
    sketch = nodes.select("n", "sketch")
    low = least_agreement(threshold)

    def of(side: str, table: DataFrame, what: str) -> DataFrame:
        return table.select(F.col("n").alias(side), F.col(what).alias(f"{what}_{side}"))

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(of("a", sketch, "sketch"), "a").join(of("b", sketch, "sketch"), "b")
        return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_alike(low), "a long, b long")

    def links(near: DataFrame) -> DataFrame:
        """The pairs that are alike.  A text with many pairs goes once to each of several keys, with so many pairs each."""
        near = written(near, "near")
        many = near.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("parts")).filter("parts > 1")
        parts = F.coalesce("parts", F.lit(1))
        dealt = near.join(of("b", texts, "text"), "b").join(many, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts)).drop("parts")
        shared = of("a", texts, "text").join(near.select("a").distinct(), "a").join(many, "a", "left")
        shared = shared.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
        both = dealt.join(shared, ["a", "part"]).select("a", "b", "text_a", "text_b")
        found = written(both.mapInArrow(_verified(threshold, weights), "a long, b long"), "links")
        removed(near)
        return found

    def placed(label: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """Members with the label of their component; and the buckets with several labels, their sizes and another member."""
        out = members.join(label, "n", "left").select("n", "b", F.coalesce("label", "n").alias("label"))
        other = F.min(F.struct(F.xxhash64(F.lit(turn), "n").alias("h"), "n", "label"))
        split = out.groupBy("b").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size"), other.alias("other"))
        return out, split.filter("x < y").select("b", "size", F.col("other.n").alias("a"), F.col("other.label").alias("a_label"))

    edges = links(alike(members.filter("a < n").select("a", F.col("n").alias("b")).distinct()))
    label = components(edges)
    out, split = placed(label, 1)
    again = out.join(split, "b").filter("label != a_label").select(F.least("a", "n").alias("a"), F.greatest("a", "n").alias("b")).distinct()
    found = links(alike(again))
    edges, label = edges.unionByName(found), _merged(label, found)
    out, split = placed(label, 2)
    parts = F.ceil(F.col("size") / BLOCK)
    blocks = out.join(split.select("b", "size"), "b").join(nodes.select("n", "sketch", "bands"), "n").withColumn("own", F.pmod(F.xxhash64(F.lit(1), "n"), parts))
    blocks = blocks.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    blocks = blocks.select("b", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "n", "label", "sketch", "bands")
    cross = blocks.repartition("b", "i", "j").sortWithinPartitions("b", "i", "j", "n").mapInArrow(_crossed(low), "a long, b long").distinct()
    found = links(cross)
    edges, label = edges.unionByName(found), _merged(label, found)
    removed(members, texts)
    degree = edges.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("n_links"))
    of_text = nodes.select("t", "k", "n").join(label, "n", "left").join(degree, "n", "left").withColumn("label", F.coalesce("label", "n"))
    first = of_text.groupBy("label").agg(F.min(F.struct("k", "t")).alias("first"))
    return of_text.join(first, "label").select("t", "k", F.col("first.k").alias("class_id"), (F.col("first.t") == F.col("t")).alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, weights: str = "log_count") -> DataFrame:
    """A row for each row of docs: the id, class_id (the smallest id of its class) and n_links, the links found between its
    text and other texts."""
    found = _classes(docs, id_col, text_col, threshold, weights)
    rows = docs.select(F.col(f"`{id_col}`"), F.when(F.col(f"`{id_col}`").isNotNull(), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("__pmh_t"))
    rows = rows.join(found.select(F.col("t").alias("__pmh_t"), "class_id", "n_links"), "__pmh_t", "left")
    return rows.select(F.col(f"`{id_col}`"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, weights: str = "log_count") -> DataFrame:
    """docs with one row of each class: one with the smallest id (of several texts with that id, the one with the smallest
    digest; of repeated rows, any).  Rows without an id stay."""
    found = _classes(docs, id_col, text_col, threshold, weights).filter("first").select(F.col("k").alias("__pmh_k"), F.col("t").alias("__pmh_t"))
    has_id = F.col(f"`{id_col}`").isNotNull()
    keyed = docs.filter(has_id).withColumns({"__pmh_k": F.col(f"`{id_col}`").cast("long"), "__pmh_t": F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))})
    keys = ["__pmh_k", "__pmh_t"]
    return keyed.join(found, keys, "left_semi").dropDuplicates(keys).drop(*keys).unionByName(docs.filter(~has_id))
