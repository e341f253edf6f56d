"""Merkle manifest of a dataset, with a proof for each row by octopus multiproofs.

A row is a leaf: the SHA-256 of its fields, each with its length.  The leaves of a
group, in order, make a tree of runs of three; the groups' roots, in order, make
the tree whose root stands for the dataset.  A proof is the list of siblings on
the way from the leaf to that root.

Trees are built block by block: a block of 3 ** height consecutive leaves becomes
one node in one task, then so do blocks of these nodes.  For the proofs, every
block works out which nodes it lacks: the siblings of its own nodes, level by level,
as long as they can't be derived from its leaves.  That union is fetched once, by
one join on coordinates, for all leaves of the block; the interior nodes that they
share are derived in the task, and each leaf's proof is put together from them.
A block holds a bounded number of rows, whatever the size of its group.

Defined results: a null field counts as "-"; a null group is a group of its own and
stands first; leaves without an order value stand first in their group; leaves of
one order value stand in the order of their digests, and equal rows are leaves of
their own; a group of one leaf has that leaf as its root; a dataset of one group
has the group's root; an empty table gives an empty result; texts of any length are
digested whole; other columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running
from .shared import leaves_one_table, written

ARITY = 3
#: Levels of a block: 3 ** 8 leaves.
HEIGHT = 8
#: The tree over the groups.
TOP = -1


def leaf_digest(fields: list[Column]) -> Column:
    """The SHA-256 of the fields, each as its UTF-8 byte count, a colon and its text, or - if it is null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def parent(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def depth_of(n: int) -> int:
    """Levels between n leaves and their root."""
    depth = 0
    while n > 1:
        n, depth = -(-n // ARITY), depth + 1
    return depth


def missing(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """Coordinates (level, number) of the nodes that the leaves low to high (of n) need for their proofs and don't make up."""
    out, level = [], 0
    while n > 1:
        first, last = low // ARITY, high // ARITY
        out += [(level, j) for j in [*range(first * ARITY, low), *range(high + 1, min((last + 1) * ARITY, n))]]
        low, high, n, level = first, last, -(-n // ARITY), level + 1
    return out


def levels_above(leaves: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> list[tuple[int, dict[int, str]]]:
    """Each level from the leaves to the root as (its size, its known nodes), from consecutive leaves and the nodes they lack."""
    out, level = [(n, dict(leaves))], 0
    while n > 1:
        here, low, high = out[-1][1], min(out[-1][1]), max(out[-1][1])
        first, last = low // ARITY, high // ARITY
        for j in range(first * ARITY, min((last + 1) * ARITY, n)):
            if j not in here:
                here[j] = fetched[level, j]
        above = {p: parent([here[j] for j in range(p * ARITY, min((p + 1) * ARITY, n))]) for p in range(first, last + 1)}
        n, level = -(-n // ARITY), level + 1
        out.append((n, above))
    return out


def proofs_above(levels: list[tuple[int, dict[int, str]]], tail: list[str]) -> dict[int, list[str]]:
    """The siblings of each known leaf up to the root, followed by tail."""
    paths = dict.fromkeys(levels[-1][1], tail)
    for n, here in levels[-2::-1]:
        paths = {i: [here[j] for j in _run(i, n) if j != i] + paths[i // ARITY] for i in here}
    return paths


def _run(i: int, n: int) -> range:
    return range(i // ARITY * ARITY, min((i // ARITY + 1) * ARITY, n))


def folded(digest: str, i: int, levels: list[tuple[int, dict[int, str]]]) -> str:
    """The root that comes of digest in the place of leaf i."""
    for n, here in levels[:-1]:
        digest = parent([digest if j == i else here[j] for j in _run(i, n)])
        i //= ARITY
    return digest


# ---------------------------------------------------------------- trees, block by block


_NODES = "tree long, level int, at long, n long, digest string"


def _grown(height: int, all_levels: bool):
    """A block of nodes of one level: the node above it, or all nodes from these up to it."""

    def run(block: pa.Table) -> pa.Table:
        tree, level, n = (block.column(c)[0].as_py() for c in ("tree", "level", "n"))
        here = dict(sorted(zip(block.column("at").to_pylist(), block.column("digest").to_pylist(), strict=True)))
        rows = [(level, n, here)]
        for _ in range(height):
            if n == 1:
                break
            ids, above = list(here), {}
            for p in range(ids[0] // ARITY, ids[-1] // ARITY + 1):
                above[p] = parent([here[j] for j in _run(p * ARITY, n)])
            here, n, level = above, -(-n // ARITY), level + 1
            rows.append((level, n, here))
        flat = [(tree, lv, at, size, digest) for lv, size, nodes in (rows if all_levels else rows[-1:]) for at, digest in nodes.items()]
        return pa.table(dict(zip(("tree", "level", "at", "n", "digest"), map(pa.array, zip(*flat, strict=True)), strict=True)), schema=_ARROW)

    return run


_ARROW = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])


def _blocks(nodes: DataFrame, height: int):
    return nodes.groupBy("tree", F.expr(f"at div {ARITY**height}").alias("block"))


def all_above(nodes: DataFrame, level: int, most: int, height: int) -> DataFrame:
    """All nodes from the nodes of one level up to the roots.  most: the size of that level in the largest tree."""
    out = None
    while out is None or most > 1:
        grown = written(_blocks(nodes, height).applyInArrow(_grown(height, True), _NODES), "tree")
        level, most = level + height, -(-most // ARITY**height)
        goes_on = (F.col("level") == level) & (F.col("n") > 1)
        nodes = grown.filter(goes_on)
        part = grown.filter(~goes_on) if most > 1 else grown
        out = part if out is None else out.unionByName(part)
    return out


def _lacking(height: int, groups: int):
    """Rows (tree, block, n): the coordinates that each block of leaves lacks, in its tree and in the tree over the groups."""

    def run(batches):
        for batch in batches:
            rows = []
            for tree, block, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                low = block * ARITY**height
                rows += [(tree, block, tree, *c) for c in missing(low, min(low + ARITY**height, n) - 1, n)]
                rows += [(tree, block, TOP, *c) for c in missing(tree, tree, groups)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["tree", "block", "of", "level", "at"])

    return run


def _proofs(groups: int):
    """A block's leaves and the nodes that they lack: their proofs, and the roots that the received leaves lead to."""

    def run(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        tree, n = leaves.column("tree")[0].as_py(), leaves.column("n")[0].as_py()
        got = {}
        for of, level, at, digest in zip(*[fetched.column(c).to_pylist() for c in ("of", "level", "at", "digest") if fetched.num_rows], strict=True):
            got.setdefault(of, {})[level, at] = digest
        ids, own, received = (leaves.column(c).to_pylist() for c in ("at", "digest", "received"))
        levels = levels_above(dict(sorted(zip(ids, own, strict=True))), n, got.get(tree, {}))
        subroot = levels[-1][1][0]
        over = levels_above({tree: subroot}, groups, got.get(TOP, {}))
        root, paths = over[-1][1][0], proofs_above(levels, proofs_above(over, [])[tree])
        roots = [root if r == d else folded(folded(r, i, levels), tree, over) for i, d, r in zip(ids, own, received, strict=True)]
        rows = leaves.num_rows
        columns = {"leaf": own, "subroot": [subroot] * rows, "root": [root] * rows, "proof": pa.array([paths[i] for i in ids], pa.list_(pa.string())), "folded_root": roots}
        return pa.table({"group": leaves.column("group"), "order": leaves.column("order"), **columns})

    return run


@leaves_one_table
def manifest(docs: DataFrame, fields: list[str], group: str, order: str, received: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """Per row of docs: group and order (the columns of these names), leaf, subroot (its group's root), root, proof (the siblings from
    the leaf to the root, each run's from left to right), folded_root (what the received leaf and the proof give) and verified
    (whether that is the root).  received: what a receiver holds in place of some fields; by default the fields themselves."""
    kind = docs.schema[group].dataType.simpleString(), docs.schema[order].dataType.simpleString()
    sent, held = [F.col(f"`{f}`") for f in fields], [(received or {}).get(f, F.col(f"`{f}`")) for f in fields]
    name = F.coalesce(F.concat(F.lit("s"), F.col(f"`{group}`").cast("string")), F.lit(""))  # null first, then by bytes
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    leaves = docs.select(name.alias("name"), F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("order"), leaf_digest(sent).alias("digest"), leaf_digest(held).alias("received"))
    sizes = docs.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    sizes = running(sizes.withColumn("tree", one), [], [F.col("name")], ["tree"], label="groups").withColumn("tree", F.col("tree") - 1)
    groups, most = sizes.agg(F.count("*"), F.coalesce(F.max("n"), zero)).first()
    result = f"group {kind[0]}, order {kind[1]}, leaf string, subroot string, root string, proof array<string>, folded_root string"
    named = [F.col("group").alias(group), F.col("order").alias(order), "leaf", "subroot", "root", "proof", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")]
    if not groups:
        return docs.sparkSession.createDataFrame([], result).select(*named)
    # a row before each group's leaves carries the group's number and size to them
    first = sizes.select("name", F.lit(0).alias("kind"), zero.alias("at"), "n", "tree")
    rows = leaves.withColumns({"kind": F.lit(1), "at": one, "n": zero, "tree": zero}).unionByName(first, allowMissingColumns=True)
    keep = ["group", "order", "digest", "received", "kind", "at", "n", "tree"]
    by = [F.col("kind"), F.col("order").asc_nulls_first(), F.col("digest"), F.col("received")]
    placed = running(rows, ["name"], by, ["at", "n", "tree"], ["name", *keep], "leaves").filter("kind = 1").drop("name", "kind").withColumn("at", F.col("at") - 1)

    tops = _blocks(placed.select("tree", F.lit(0).alias("level"), "at", "n", "digest"), height).applyInArrow(_grown(height, False), _NODES)
    tops = written(tops, "tops")
    above = all_above(tops.filter("n > 1"), height, -(-most // ARITY**height), height) if most > ARITY**height else None
    roots = tops.filter("n = 1")
    roots = roots.unionByName(above.filter("n = 1")) if above is not None else roots
    heads = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("at"), F.lit(groups).cast("long").alias("n"), "digest")
    nodes = all_above(heads, 0, groups, height)
    nodes = nodes.unionByName(above) if above is not None else nodes

    width = ARITY**height
    blocks = sizes.select("tree", F.explode(F.sequence(zero, F.expr(f"(n - 1) div {width}"))).alias("block"), "n")
    lacking = blocks.repartition("tree", "block").mapInArrow(_lacking(height, groups), "tree long, block long, of long, level long, at long")
    digests = nodes.select(F.col("tree").alias("of"), F.col("level").cast("long").alias("level"), "at", "digest")
    fetched = lacking.join(digests, ["of", "level", "at"])
    mine = placed.select(F.expr(f"at div {width}").alias("block"), *placed.columns)
    out = mine.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(_proofs(groups), result)
    return out.select(*named)
