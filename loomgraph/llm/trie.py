"""Prefix trie of conversations, with subtree figures by the Euler-tour technique.

A node is a distinct sequence of first turns; its name is (conv_id, depth) of its
smallest member.  Every node has an enter and an exit arc.  The tour's successor
links are made by joins, the list of arcs is ranked by contraction: each task
shortens the stretches of the list that lie within its own block of arcs to one
row; if a round leaves more than a few rows, random mates are joined as well, until
one task may walk what is left (a parameter bounds it); then the offsets go back
down.  The list is weighted, so that the ranking yields, beside the position, the
sums of leaves and savings before each arc: a node's subtree holds the difference
between its exit and its enter arc.

No group is gathered: turns are numbered and prefixes are digested by running sums
over ranges (a conversation may hold most rows), a node's children are numbered the
same way (a node may have most nodes as children), and the members that end at a
node are turned into pieces of text, of which one stream makes the digest (SHA-256
can't be split) in constant memory.

A prefix is told by its length and by sums of 128 bits of digests of its turns and
their places.

Defined results: turns without a conv_id belong to no conversation; null roles and
texts are empty; turns of one number are ordered by role and text; repeated rows
are turns of their own; a negative conv_id has the remainder that SQL gives it;
texts of any length are digested whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import changes, running
from .shared import leaves_one_table, word_count, written

#: Arcs of a block (two for each node), and arcs that one task may walk at the end.
BLOCK = 1 << 19
WALKED = 1 << 18
KEY = ["k1", "k2", "k3", "k4"]
SUMS = ["pos", "leaves", "saved"]


# ---------------------------------------------------------------- turns and prefixes


def _halves(h: Column) -> tuple[Column, Column]:
    return h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text and its words of each turn, with two digests of role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    return own.withColumns({"b1": F.xxhash64("role", "text"), "b2": F.xxhash64(F.lit(7), "text", "role"), "words": word_count(F.col("text"))})


def rebuilt(turns: DataFrame, shared_turns: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first shared_turns turns of conversation head (all if fewer), then the own turns after as
    many.  Both columns are made of conv_id.  Returns their turns (conv_id, depth, b1, b2, words), and all conversations
    with their lengths (conv_id, length)."""
    counts = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "counts")
    ids = counts.withColumns({"h": shared_turns.cast("long"), "head": head})
    heads = ids.select("head").distinct().join(counts.withColumnsRenamed({"conv_id": "head", "n": "n_head"}), "head")
    ids = ids.join(heads, "head", "left").withColumn("lent", F.least("h", F.coalesce("n_head", F.lit(0))))
    ids = written(ids.select("conv_id", "head", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "ids")
    lends = ids.groupBy(F.col("head").alias("conv_id")).agg(F.max("lent").alias("lends"))
    # a row before each conversation's turns carries by how much their places move, and how many of them others take
    zero = F.lit(0).cast("long")
    first = ids.join(lends, "conv_id", "left").select("conv_id", F.lit(0).alias("kind"), zero.alias("pos"), (F.col("lent") - F.col("h")).alias("move"), F.coalesce("lends", zero).alias("lends"))
    rows = turns.withColumns({"kind": F.lit(1), "pos": F.lit(1).cast("long"), "move": zero, "lends": zero})
    order = [F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = running(rows.unionByName(first, allowMissingColumns=True), ["conv_id"], order, ["pos", "move", "lends"], ["conv_id", "kind", "b1", "b2", "words", "pos", "move", "lends"], "turns").filter("kind = 1")
    own = placed.filter(F.col("pos") > shared_turns).select("conv_id", (F.col("pos") + F.col("move")).alias("depth"), "b1", "b2", "words")
    lent = ids.filter("lent > 0").select("conv_id", "head", "lent")
    lendable = placed.filter("pos <= lends").select(F.col("conv_id").alias("head"), F.col("pos").alias("depth"), "b1", "b2", "words")
    lent = lent.join(lendable, "head").filter("depth <= lent").select("conv_id", "depth", "b1", "b2", "words")
    return own.unionByName(lent), ids.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, depth, b1, b2, words) with the digest of the prefix that each one ends (k1 to k4) and of the one before
    it (p1 to p4)."""
    own = dict(zip(["q1", "q2", "q3", "q4"], [*_halves(F.xxhash64("depth", "b1", "b2")), *_halves(F.xxhash64("b2", "depth", "b1"))], strict=True))
    rows = turns.withColumns(own).withColumns({f"k{i}": F.col(f"q{i}") for i in range(1, 5)})
    out = running(rows, ["conv_id"], [F.col("depth")], KEY, ["conv_id", "depth", "words", *own, *KEY], "prefixes")
    return out.select("conv_id", "depth", "words", *KEY, *[(F.col(f"k{i}") - F.col(f"q{i}")).alias(f"p{i}") for i in range(1, 5)])


# ---------------------------------------------------------------- digests of the members that end at a node


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id): the ids of each stretch of one key as comma-joined text."""
    names = ["depth", *KEY, "first", "ids"]
    for batch in batches:
        starts = np.concatenate([[True], changes([batch.column(i) for i in range(5)], batch.num_rows)])
        at = np.flatnonzero(starts)
        ids = batch.column(5)
        texts = [",".join(map(str, ids.slice(a, b - a).to_pylist())) for a, b in zip(at, [*at[1:], batch.num_rows], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in range(6)), pa.array(texts, pa.string())], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, first id, text): the SHA-256 of each key's texts joined by commas."""
    names, kinds = ["depth", *KEY, "ends_sha256"], [pa.int64()] * 5 + [pa.string()]
    key, digest = None, None
    for batch in batches:
        out = []
        for *own, _, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if own == key:
                digest.update(b"," + text.encode())
                continue
            if key is not None:
                out.append([*key, digest.hexdigest()])
            key, digest = own, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*key, digest.hexdigest()], kinds, strict=True)], names=names)


def digests_of_members(ends: DataFrame) -> DataFrame:
    """ends (depth, k1 to k4, conv_id): for each key the SHA-256 of its ids, ascending and joined by commas.  Ranges of ids become
    texts first, so that what one task streams for a key is text of thousands of ids a row."""
    by = ["depth", *KEY]
    pieces = ends.repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id").select(*by, "conv_id")
    pieces = pieces.mapInArrow(_pieces, "depth long, k1 long, k2 long, k3 long, k4 long, first long, ids string")
    return pieces.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, k3 long, k4 long, ends_sha256 string")


# ---------------------------------------------------------------- the weighted ranking of a list


def stretches(at: np.ndarray, following: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of a list that lie in this task, by pointer jumping.  at: names of the elements; following: name of the next
    one; weights: a row for each element.  Returns the index of each element's first one in its part, the weights between
    the two (own one not included), and the index of the next element or -1."""
    order = np.argsort(at, kind="stable")
    place = np.clip(np.searchsorted(at, following, sorter=order), 0, max(len(at) - 1, 0))
    inside = at[order[place]] == following if len(at) else np.zeros(0, bool)
    after = np.where(inside, order[place] if len(at) else 0, -1)
    head = np.arange(len(at))
    head[after[inside]] = np.flatnonzero(inside)
    off = np.where((head != np.arange(len(at)))[:, None], weights[head], 0)
    while True:
        further = head[head]
        if np.array_equal(further, head):
            return head, off, after
        off, head = off + off[head], further


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's elements (at, next, weights): each with its part's first element and the weights between; first ones also
    with the part's next element and its whole weights."""
    found = list(batches)  # a block's elements: numbers only
    if not sum(b.num_rows for b in found):
        return
    at, following, *w = [np.concatenate([np.asarray(b.column(i)) for b in found]) for i in range(5)]
    weights = np.stack(w, axis=1)
    head, off, after = stretches(at, following, weights)
    last = np.flatnonzero(after < 0)
    leads = np.zeros(len(at), bool)
    leads[head[last]] = True
    to, whole = np.zeros(len(at), np.int64), np.zeros_like(weights)
    to[head[last]] = following[last]
    whole[head[last]] = off[last] + weights[last]
    columns = [at, at[head], *off.T, leads, to, *whole.T]
    names = ["at", "head", *(f"o_{s}" for s in SUMS), "leads", "next", *SUMS]
    step = 1 << 16
    for i in range(0, len(at), step):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in columns], names=names)


_SHORTENED = "at long, head long, " + ", ".join(f"o_{s} long" for s in SUMS) + ", leads boolean, next long, " + ", ".join(f"{s} long" for s in SUMS)


def _mates(arcs: DataFrame, seed: int) -> DataFrame:
    """One round of random mates: an element whose coin falls one way takes in the next one if that one's falls the other way."""
    coin = lambda c: F.xxhash64(F.lit(seed), c).bitwiseAND(1)
    takes = arcs.filter(coin("at") == 1).alias("x").join(arcs.filter(coin("at") == 0).alias("y"), F.col("x.next") == F.col("y.at"))
    taken = takes.select(F.col("y.at").alias("at"), F.col("x.at").alias("head"), *[F.col(f"x.{s}").alias(f"o_{s}") for s in SUMS], F.col("y.next").alias("next"), *[(F.col(f"x.{s}") + F.col(f"y.{s}")).alias(s) for s in SUMS])
    taken = written(taken, "mates")
    grown = taken.select(F.col("head").alias("at"), F.col("next").alias("n2"), *[F.col(s).alias(f"w_{s}") for s in SUMS])
    rest = arcs.join(taken.select("at"), "at", "left_anti").join(grown, "at", "left")
    zero = F.lit(0).cast("long")
    leads = rest.select("at", F.col("at").alias("head"), *[zero.alias(f"o_{s}") for s in SUMS], F.lit(True).alias("leads"), F.coalesce("n2", "next").alias("next"), *[F.coalesce(f"w_{s}", s).alias(s) for s in SUMS])
    return leads.unionByName(taken.withColumn("leads", F.lit(False)).select(leads.columns))


def ranked(arcs: DataFrame, block: int = BLOCK, walked: int = WALKED) -> DataFrame:
    """arcs (at, next, pos, leaves, saved): for each element of the list the sums of the weights before it.

    The list has no cycle; elements with near names are near in most of it, or the rounds of random mates do the work
    (each takes a quarter of what is left, so that all rounds together cost a few times the first)."""
    levels, left, n, slow = [], arcs, arcs.count(), False
    if not n:
        return arcs.select("at", *SUMS)
    tasks = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while not levels or n > walked:
        blocks = max(-(-n // block), 1 if levels else tasks)
        step = _mates(left, len(levels)) if slow else left.repartitionByRange(blocks, "at").mapInArrow(_shortened, _SHORTENED)
        levels.append(written(step, "arcs"))
        left = levels[-1].filter("leads").select("at", "next", *SUMS)
        before, n = n, left.count()
        slow = not slow and 4 * n > 3 * before
    levels.append(written(left.repartition(1).mapInArrow(_shortened, _SHORTENED), "arcs"))  # at most `walked` elements
    found = None
    for level in reversed(levels):
        if found is None:
            found = level.select("at", *[F.col(f"o_{s}").alias(s) for s in SUMS])
            continue
        above = found.withColumnsRenamed({"at": "head"} | {s: f"a_{s}" for s in SUMS})
        found = level.join(above, "head").select("at", *[(F.col(f"o_{s}") + F.col(f"a_{s}")).alias(s) for s in SUMS])
    return found


# ---------------------------------------------------------------- the trie


@leaves_one_table
def prefix_trie(conversations: DataFrame, shared_turns: Column | None = None, head: Column | None = None, block: int = BLOCK, walked: int = WALKED) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text): per node conv_id (its smallest member), depth, parent_conv_id
    (null at the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    shared_turns and head, made of conv_id, say which turns of which conversation stand in place of a conversation's first
    ones (none by default).  saved_tokens of a subtree: the words that a cache of prefixes needn't read again, each node's last
    text times its members but one."""
    turns = turns_of(conversations)
    parts, ids = rebuilt(turns, F.lit(0) if shared_turns is None else shared_turns, F.col("conv_id") if head is None else head)
    paths = prefixes(parts)
    by = ["depth", *KEY]
    zeros = [F.lit(0).cast("long").alias(k) for k in KEY]
    nodes = paths.groupBy(*by).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"), *[F.first(f"p{i}").alias(f"p{i}") for i in range(1, 5)])
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    nodes = nodes.unionByName(root.select(F.lit(0).cast("long").alias("depth"), *zeros, "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), *[F.lit(None).cast("long").alias(f"p{i}") for i in range(1, 5)]))
    ends = paths.groupBy("conv_id").agg(F.max(F.struct(*by)).alias("last")).select(*[f"last.{c}" for c in by], "conv_id")
    ends = ends.unionByName(ids.filter("length = 0").select(F.lit(0).cast("long").alias("depth"), *zeros, "conv_id"))
    nodes = nodes.join(digests_of_members(ends), by, "left")
    nodes = nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    nodes = running(nodes.withColumn("g", F.lit(1).cast("long")), [], [F.col("conv_id"), F.col("depth")], ["g"], label="nodes")

    # parents and children under one key, the parent first: running sums hand its name down and number the children
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    as_parent = nodes.select("depth", *KEY, zero.alias("child"), "conv_id", F.col("g").alias("up"), F.col("conv_id").alias("parent"), zero.alias("nth"))
    as_child = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), *[F.col(f"p{i}").alias(f"k{i}") for i in range(1, 5)], F.col("g").alias("child"), "conv_id", zero.alias("up"), zero.alias("parent"), one.alias("nth"))
    family = running(as_parent.unionByName(as_child), by, [F.col("child") > 0, F.col("conv_id")], ["up", "parent", "nth"], ["depth", *KEY, "child", "up", "parent", "nth"], "family")
    children = written(family.filter("child > 0").select(F.col("child").alias("g"), "up", "parent", "nth"), "children")
    brood = children.groupBy(F.col("up").alias("g")).agg(F.max("nth").alias("n_children"), F.min(F.struct("nth", "g")).getField("g").alias("eldest"))
    named = nodes.drop(*KEY, "p1", "p2", "p3", "p4").join(children.select("g", "parent"), "g", "left").join(brood, "g", "left")
    named = written(named, "named")

    # arcs: node g is entered by arc 2g and left by arc 2g + 1
    enter = named.select((F.col("g") * 2).alias("at"), F.coalesce(F.col("eldest") * 2, F.col("g") * 2 + 1).alias("next"), one.alias("pos"), F.col("eldest").isNull().cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    younger = children.select("up", (F.col("nth") - 1).alias("nth"), F.col("g").alias("sibling"))
    leave = children.join(younger, ["up", "nth"], "left").select((F.col("g") * 2 + 1).alias("at"), F.coalesce(F.col("sibling") * 2, F.col("up") * 2 + 1).alias("next"), one.alias("pos"), zero.alias("leaves"), zero.alias("saved"))
    last = named.filter("depth = 0").select((F.col("g") * 2 + 1).alias("at"), F.lit(-1).cast("long").alias("next"), one.alias("pos"), zero.alias("leaves"), zero.alias("saved"))
    arcs = written(enter.unionByName(leave).unionByName(last), "tour")
    sums = ranked(arcs, block, walked)
    side = F.col("at").bitwiseAND(1) * 2 - 1
    below = sums.groupBy(F.shiftright("at", 1).alias("g")).agg(*[F.sum(side * F.col(s)).alias(s) for s in SUMS[1:]])
    out = named.join(below, "g")
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
