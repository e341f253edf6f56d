"""Substring dedup and near-duplicates against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import rlz
from loomgraph.llm.probminhash import FAN, near_duplicates, one_of_each, probability_jaccard, registers
from loomgraph.llm.rlz import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def order_of(rows):
    """Each row with its place in the order of documents: the id (of a null id, a hash of its text), then a digest of the text."""
    session = SparkSession.getActiveSession()
    frame = session.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, k long, text string")
    found = frame.select("n", F.coalesce("k", F.xxhash64(F.lit(1), "text")), F.hash("text").bitwiseAND(F.lit(0xFFFFFFFF)), "k", "text").collect()
    return sorted(tuple(r)[1:] for r in found)


def brute_substrings(rows, window=20):
    """Words, removed words and the rest for each row; and the first place of each window."""
    seen, out = {}, []
    for k, t, number, text in order_of(rows):
        w = WORD.findall(text or "")
        cover = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if seen.setdefault(key, (k, t, s)) != (k, t, s):
                cover[s : s + window] = [True] * window
        out.append((number, len(w), sum(cover), " ".join(x for x, c in zip(w, cover) if not c)))
    return out


def check_factors(rows):
    """Factors hold a window at least, equal their sources word by word, start after them, and make up the spans."""
    words = {}
    for r in rows:
        words.setdefault(r.doc_id, []).append(WORD.findall(r.original or ""))
    for r in rows:
        w, covered = WORD.findall(r.original or ""), set()
        for f in r.factors:
            assert f.length >= 20
            covered |= set(range(f.start, f.start + f.length))
            if f.block not in words:
                continue  # a document without an id
            assert any(x[f.position : f.position + f.length] == w[f.start : f.start + f.length] for x in words[f.block])
            assert f.block < r.doc_id or (f.block == r.doc_id and (f.position < f.start or len(words[f.block]) > 1))
        assert covered == {i for s in r.dup_spans for i in range(s.start, s.start + s.length)} and len(covered) == r.n_removed
        assert all(a.start + a.length < b.start for a, b in itertools.pairwise(r.dup_spans))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(60)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(parts)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, " ".join(passages[0] * 30)), (None, " ".join(passages[1] * 2)), (104, "x " * 500)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_match_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"p": F.lit(7), "k": F.lit("clash"), "original": F.col("text")}).repartition(5)
    got = dedup_substrings(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == Counter(brute_substrings(rows))
    check_factors([r for r in got if r.doc_id is not None])


def test_one_id_on_rows_with_several_texts(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(3, one), (5, f"{one} {two}"), (5, f"{two} {one}"), (7, two), (None, f"{three} x"), (None, three), (None, three), (9, f"{three} y"), (9, f"{three} y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in dedup_substrings(docs).collect())
    assert got == Counter(brute_substrings(rows))
    kept = " ".join(t for _, _, _, t in got)
    assert all(x in kept for x in (one, two, three))


@pytest.mark.parametrize("buffer", [1, 50])
def test_buffers_and_slices_of_any_size(spark, buffer):
    """Rows that leave a task's buffer early, and batches that cut groups, give the same result."""
    rows = [r for r in corpus(3) if r[0] is not None]
    table = pa.table({"text": [t for _, t in rows], "__rlz_k": [i for i, _ in rows], "__rlz_t": pa.array([0] * len(rows), pa.int32())})
    saved, rlz.BUFFER = rlz.BUFFER, buffer
    try:
        sent = pa.Table.from_batches(rlz._index_rows(20, "text")(iter(table.to_batches(max_chunksize=7)))).to_pandas()
    finally:
        rlz.BUFFER = saved
    sent = pa.Table.from_pandas(sent.sort_values(["h", "e", "k", "place"]), preserve_index=False)
    whole = [pa.Table.from_batches(rlz._repeats(True)(iter(sent.to_batches(max_chunksize=size)))).to_pandas() for size in (1, 3, 1 << 20)]
    keys = [set(map(tuple, x.values.tolist())) for x in whole]
    assert keys[0] == keys[1] == keys[2] and len(keys[0]) == len(whole[0])


def test_spans_and_clashing_columns(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 5), (2, "x " + text, 6), (2, "x " + text, 6)], "doc_id long, text string, n_words int")
    rows = dedup_substrings(docs).orderBy("doc_id").collect()
    assert rows[0].dup_spans == [] and rows[0].text == text
    assert [(s.start, s.length) for s in rows[1].dup_spans] == [(1, 30)]
    assert [tuple(f) for f in rows[1].factors] == [(1, 30, 1, 0)]
    assert rows[1].text == rows[2].text == "x"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(empty).collect() == []
    assert near_duplicates(empty).collect() == []


def weighted(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
    return {g: 1 + math.log(n) for g, n in Counter(grams).items()}


def similarity(x, y):
    """Sum over shared elements of 1 / sum of max(x'/x, y'/y), straight from the definition."""
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x if i in y)


def brute_classes(rows, least=0.8):
    """Smallest id of its class for each row; rows are documents, equal texts one node."""
    nodes = {}
    for i, t in rows:
        nodes[t or ""] = min(i, nodes.get(t or "", i))
    parent = {t: t for t in nodes}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    sets = {t: weighted(t) for t in nodes}
    for a, b in itertools.combinations(parent, 2):
        overlap = len(sets[a].keys() & sets[b].keys())
        if overlap and similarity(sets[a], sets[b]) >= least - 1e-9:
            parent[find(a)] = find(b)
    smallest = {}
    for t, i in nodes.items():
        smallest[find(t)] = min(i, smallest.get(find(t), i))
    return [smallest[find(t or "")] for _, t in rows]


def classes_of(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.monotonically_increasing_id()).repartition(4)
    return docs, sorted((r.doc_id, r.class_id) for r in near_duplicates(docs, **more).collect())


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, number = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((number, " ".join(copy)))
            number += 1
    rows += [(900, None), (901, ""), (902, "one two"), (903, "one  two"), (904, "one two three"), (905, "a b c d e"), (906, "a b c d e")]
    want = brute_classes(rows)
    docs, got = classes_of(spark, rows)
    assert got == sorted((i, c) for (i, _), c in zip(rows, want, strict=True))
    assert {r.doc_id for r in one_of_each(docs).collect()} == set(want)
    assert one_of_each(docs).columns == docs.columns


def test_passages_that_repeat_unequally_often(spark):
    """Bands, sketch and verification follow one measure: texts that repeat passages get the classes of its definition."""
    rows, number, rng = [], 0, random.Random(8)
    for family in range(10):
        base = [f"b{family}_{i}" for i in range(rng.choice([20, 60, 300]))]
        passage = [f"p{family}_{i}" for i in range(rng.choice([8, 30, 90]))]
        for times in (1, 2, 3, 20, 200):
            rows.append((number, " ".join([*base, *passage * times, f"tail{number}"])))
            number += 1
    want = brute_classes(rows)
    assert 10 < len(set(want)) < len(rows)
    assert classes_of(spark, rows)[1] == sorted((i, c) for (i, _), c in zip(rows, want, strict=True))


def test_probability_jaccard_is_exact():
    rng = np.random.default_rng(4)
    sets = [[{int(k): float(rng.uniform(0.5, 4)) for k in rng.integers(1, 30, rng.integers(0, 25))} for _ in range(2)] for _ in range(40)]
    sides = [tuple(np.array([v for n, pair in enumerate(sets) for v in ((n, k, w)[part] for k, w in pair[side].items())], [np.int64, np.uint64, float][part]) for part in range(3)) for side in (0, 1)]
    assert np.allclose(probability_jaccard(*sides, len(sets)), [similarity(*pair) for pair in sets])


def test_pairs_at_the_threshold_are_found(spark):
    """40 pairs at exactly 0.8, no more: all of them must be linked."""
    rows = []
    for n in range(40):
        words = [f"w{n}_{i}" for i in range(94)]  # 90 shingles
        rows += [(2 * n, " ".join(words[:85])), (2 * n + 1, " ".join(words[9:]))]  # 81 each, 72 shared of 90
    assert similarity(weighted(rows[0][1]), weighted(rows[1][1])) == pytest.approx(0.8)
    assert classes_of(spark, rows)[1] == [(i, i - i % 2) for i in range(80)]


def test_one_id_on_several_rows(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(10, x), (20, x), (20, y), (30, y), (30, y), (40, "other words")]
    docs, got = classes_of(spark, rows)
    assert got == [(10, 10), (20, 10), (20, 20), (30, 20), (30, 20), (40, 40)]
    assert sorted((r.doc_id, r.text) for r in one_of_each(docs).collect()) == [(10, x), (20, y), (40, "other words")]


def test_repeated_rows_make_no_more_links(spark):
    text = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(text))] * 5 + [(2, " ".join([*text, "more"]))] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.class_id, r.n_links) for r in near_duplicates(docs).collect()} == {(1, 1, 1), (2, 1, 1)}
    assert one_of_each(docs).count() == 1


def test_a_text_with_very_many_pairs(spark):
    """More near copies of one text than are verified under one key."""
    text = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*text, f"end{i}"])) for i in range(2 * FAN + 300)]
    assert {c for _, c in classes_of(spark, rows)[1]} == {0}


def test_null_ids_are_never_compared(spark):
    docs = spark.createDataFrame([(None, "same text here now ok"), (1, "same text here now ok"), (None, None)], "doc_id long, text string")
    rows = near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in rows) == [(0, 0), (0, 0), (1, 1)]
    assert one_of_each(docs).count() == 3


def test_registers_estimate_probability_jaccard():
    """For weights a and b the share of equal registers is sum over shared of 1 / sum max(a'/a, b'/b)."""
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
    a[:10], b[-10:] = 0, 0
    exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(60) if a[i] and b[i])
    m = 20_000
    doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    best = registers(doc, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, m)
    same = ((best[0] & np.uint64(0xFFFFFFFF)) == (best[1] & np.uint64(0xFFFFFFFF))).mean()
    assert abs(same - exact) < 0.02
