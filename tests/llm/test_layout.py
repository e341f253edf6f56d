"""Prefix trie, sharding and Merkle manifest against plain versions."""

import hashlib
import random
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ring, trie
from loomgraph.llm.merkle import depth_of, levels_above, manifest, missing, parent, proofs_above
from loomgraph.llm.order import running
from loomgraph.llm.queries import ORACLES, QUERIES
from loomgraph.llm.ring import sharded
from loomgraph.llm.shared import run_of_tables, shared_dir, written
from loomgraph.llm.trie import prefix_trie, ranked, stretches

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def files_of(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(f.getPath().getName()) for f in fs.listStatus(path)} if fs.exists(path) else set()


# ---------------------------------------------------------------- running sums


def test_running_sums_cross_tasks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.randint(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(7)
    want, total = {}, Counter()
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        total[k] += v
        want[k, i] = total[k]
    got = running(df, ["k"], [F.col("i")], ["v"]).collect()
    assert {(r.k, r.i): r.v for r in got} == want and len(got) == 3000
    whole = {r.i: r.v for r in running(df.withColumn("one", F.lit(1).cast("long")), [], [F.col("i")], ["one"], ["i", "one"]).select("i", F.col("one").alias("v")).collect()}
    assert whole == {i: i + 1 for i in range(3000)}
    assert running(df.limit(0), ["k"], [F.col("i")], ["v"]).count() == 0


# ---------------------------------------------------------------- the trie


def plain_trie(rows, shared=lambda c: 0, head=lambda c: c):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    paths = {c: turns.get(head(c), [])[: shared(c)] + turns[c][shared(c) :] for c in turns}
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, convs in members.items():
        under = [k for k in members if k[: len(node)] == node]
        leaf = [k for k in under if not any(x[: len(k)] == k and len(x) > len(k) for x in members)]
        saved = sum((len(members[k]) - 1) * (words(k[-1][1]) if k else 0) for k in under)
        ends = sorted(c for c in convs if len(paths[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        children = [k for k in members if len(k) == len(node) + 1 and k[: len(node)] == node]
        out.append((min(convs), len(node), up, len(convs), len(children), len(leaf), saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def trie_rows(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("block,walked", [(1 << 19, 1 << 18), (40, 8), (3, 2)])
def test_trie_against_plain(spark, block, walked):
    rng = random.Random(block)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "a b", "a  b\n"])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", f"t{t} x") for c in range(70, 110) for t in range(3)] + [(200 + c, 0, "user", f"child {c}") for c in range(40)]
    assert trie_rows(prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5), block=block, walked=walked)) == plain_trie(rows)


def test_trie_of_rebuilt_conversations_with_nulls_and_ties(spark):
    rng = random.Random(2)
    rows = [(c, rng.choice([None, 0, 1, 1, 2]), rng.choice(["user", None]), rng.choice([None, "", "x y", "z"])) for c in [*range(-25, 45), None] for _ in range(rng.randint(1, 5)) if c != 20]
    rows += rows[:20] + [(41, 9, "user", "long " * 60_000), (42, 9, "user", "long " * 60_000)]
    h, head = (lambda c: zlib.crc32(str(c).encode()) % 4), (lambda c: c - (c % 20 if c >= 0 else -(-c % 20)))
    c = F.col("conv_id")
    df = spark.createDataFrame(rows, TURNS).withColumns({"pos": F.lit("clash"), "words": F.lit(None)})
    assert trie_rows(prefix_trie(df, F.crc32(c.cast("string")) % 4, c - c % 20, block=64, walked=16)) == plain_trie(rows, h, head)


def test_trie_of_no_rows_leaves_nothing_but_its_result(spark):
    before = files_of(spark)
    assert prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 0, "user", "x")], TURNS)).count() == 0
    assert all(x.startswith("prefix_trie-") for x in files_of(spark) - before)


def test_ranking_of_a_list_in_random_order(spark):
    """No two neighbours of this list are near by name: the rounds of random mates do the work."""
    rng = random.Random(9)
    names = rng.sample(range(100_000), 700)
    rows = [(a, b, 1, rng.randint(0, 1), rng.randint(0, 50)) for a, b in zip(names, [*names[1:], -1], strict=True)]
    got = {r.at: (r.pos, r.leaves, r.saved) for r in ranked(spark.createDataFrame(rows, "at long, next long, pos long, leaves long, saved long"), block=50, walked=20).collect()}
    sums = np.zeros(3, int)
    for at, _, *w in rows:
        assert got[at] == tuple(sums)
        sums += w


def test_stretches_of_one_task():
    head, off, after = stretches(np.array([7, 3, 9, 1]), np.array([3, 50, 7, 9]), np.array([[1], [2], [4], [8]]))
    assert head.tolist() == [3, 3, 3, 3] and off[:, 0].tolist() == [12, 13, 8, 0] and after.tolist() == [1, -1, 0, 2]


# ---------------------------------------------------------------- the ring


def plain_shards(rows, points, n, most):
    """rows: (key digest, turn digest, tie, name); points: (end, shard)."""
    held, out, left = [0] * n, {}, rows
    while left:
        ends = sorted(p for p in points if held[p[1]] < most[p[1]])
        asks = defaultdict(list)
        for row in left:
            asks[ends[bisect_left(ends, (row[0], -1)) % len(ends)][1]].append(row)
        left = []
        for s, asking in asks.items():
            asking.sort(key=lambda r: r[1:3])
            room = most[s] - held[s]
            for k, row in enumerate(asking[:room]):
                out[row[3]] = s, held[s] + k
            left += asking[room:]
            held[s] += len(asking[:room])
    return out


def ring_points(spark, n, points):
    return [(r.end, r.shard) for r in spark.createDataFrame([(s, p) for s in range(n) for p in range(points)], "shard int, point long").select("shard", F.xxhash64(F.lit("node"), "shard", "point").alias("end")).collect()]


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_shards_against_plain(spark, slack):
    df = spark.range(1000).select((F.col("id") * 7).alias("doc_id"), F.lit("kept").alias("slot"), F.col("id").cast("string").alias("text")).repartition(6)
    n, points = 7, 20
    keyed = df.drop("slot").select("doc_id", ring.key_digest(F.col("doc_id")).alias("key"), F.xxhash64("doc_id", "text").alias("tie"))
    rows = [(r.key, r.turn, r.tie, r.doc_id) for r in keyed.withColumn("turn", F.xxhash64(F.lit("turn"), "key")).collect()]
    want = plain_shards(rows, ring_points(spark, n, points), n, ring.bounds(1000, n, slack))
    out = sharded(df, "doc_id", n, slack, points)
    assert out.columns == ["doc_id", "text", "shard", "slot"]
    assert {r.doc_id: (r.shard, r.slot) for r in out.collect()} == want


def check_slots(rows, n, most_apart):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(n)]
    assert max(sizes) - min(sizes) <= most_apart and set(by) <= set(range(n))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_of_hot_null_and_repeated_keys(spark):
    rng = random.Random(4)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, rng.choice(["a", "b", None])) for i in range(900)] + [(5, "a")] * 301
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharded(df, "doc_id", 8).collect()
    check_slots(out, 8, 1)
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    again = sharded(df.repartition(3), "doc_id", 8).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert sharded(df.limit(0), "doc_id", 8).collect() == []
    check_slots(sharded(df.limit(3), "doc_id", 8).collect(), 8, 1)
    with pytest.raises(ValueError):
        sharded(df, "doc_id", 0)


def test_a_new_shard_moves_few_rows(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    moved = {}
    for slack in (0.0, 0.25):
        a, b = ({r.doc_id: r.shard for r in sharded(df, "doc_id", n, slack).collect()} for n in (10, 11))
        moved[slack] = sum(a[k] != b[k] for k in a) / 20_000
    assert moved[0.25] < 0.12 and moved[0.0] < 0.2  # a new deal of all rows would move 0.91


# ---------------------------------------------------------------- the manifest


def plain_tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([parent(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_proof(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 3 * 3
        out += [h for j, h in enumerate(level[lo : lo + 3], lo) if j != i]
        i //= 3
    return out


def plain_fold(digest, levels, i):
    for level in levels[:-1]:
        lo = i // 3 * 3
        digest = parent([digest if j == i else h for j, h in enumerate(level[lo : lo + 3], lo)])
        i //= 3
    return digest


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows, held):
    groups = defaultdict(list)
    for d, s, t in rows:
        groups[s].append(((d is not None, d or 0), leaf([d, s, t]), leaf([d, s, held(t)]), d))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([r[1] for r in sorted(groups[s])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for i, (_, own, got, d) in enumerate(sorted(groups[s])):
            proof = plain_proof(trees[s], i) + plain_proof(top, g)
            fold = plain_fold(plain_fold(got, trees[s], i), top, g)
            out.append((d, s, own, trees[s][-1][0], top[-1][0], tuple(proof), fold, fold == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_against_plain(spark, height):
    rng = random.Random(height)
    rows = [(i, "big", f"é{i}\n" * rng.randint(0, 2)) for i in range(100)] + [(i, rng.choice(["a", "ä", None, ""]), rng.choice([None, "", "x\ny"])) for i in range(60)]
    rows += [(None, "a", "x"), (None, None, None), (7, "big", "twin"), (7, "big", "twin"), (1, "one", "x" * 500_000 + "\n")] + [(1, f"s{i}", "t") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"leaf": F.lit("clash"), "n": F.lit(1)}).repartition(5)
    out = manifest(df, ["doc_id", "source", "text"], "source", "doc_id", {"text": F.translate("text", "\n", "")}, height).collect()
    got = sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple(r.proof), r.folded_root, r.verified) for r in out), key=str)
    assert got == plain_manifest(rows, lambda t: t and t.replace("\n", ""))


def test_manifest_of_few_rows(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    one = manifest(df, ["doc_id", "source", "text"], "source", "doc_id").collect()[0]
    assert one.leaf == one.subroot == one.root == leaf([1, "a", "x"]) and one.proof == [] and one.verified
    before = files_of(spark)
    assert manifest(df.limit(0), ["doc_id", "text"], "source", "doc_id").collect() == []
    assert all(x.startswith("manifest-") for x in files_of(spark) - before)


def test_a_block_lacks_no_more_than_its_siblings():
    for n in (1, 2, 3, 10, 28, 100):
        levels = plain_tree([sha(str(i)) for i in range(n)])
        for low, high in ((0, 0), (0, n - 1), (n // 3, n // 2), (n - 1, n - 1)):
            lacking = missing(low, high, n)
            own = {(0, j) for j in range(low, high + 1)}
            known = levels_above({j: levels[0][j] for j in range(low, high + 1)}, n, {c: levels[c[0]][c[1]] for c in lacking})
            assert known[-1][1] == {0: levels[-1][0]} and len(known) == depth_of(n) + 1
            paths = proofs_above(known, [])
            assert all(paths[j] == plain_proof(levels, j) for j in range(low, high + 1))
            assert len(set(lacking)) == len(lacking) and not own & set(lacking) and len(lacking) <= 4 * depth_of(n)


# ---------------------------------------------------------------- written tables


def test_a_run_deletes_what_it_wrote_even_after_an_error(spark):
    before = files_of(spark)
    with pytest.raises(RuntimeError), run_of_tables():
        written(spark.range(3), "gone")
        raise RuntimeError
    assert files_of(spark) == before


def test_layout_queries_read_all_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = QUERIES["op12_consistent_sharding"](spark, small).collect()
    check_slots(out, 24, 1)
    want = {r.doc_id: (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in out} == want and {(r.law, r.grown_shard) for r in out} == {("rows", None)}
    assert {"op11_prefix_trie", "op13_merkle_manifest"} <= set(ORACLES)
