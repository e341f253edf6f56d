"""Mixing, URL filters, media, the queries as a whole, and the pipeline."""

import hashlib
import heapq
import io
import math
import random
import wave
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import langid, media, urls
from loomgraph.llm.mixing import mix, mixed_texts, sainte_lague, shares
from loomgraph.llm.shared import word_count
from loomgraph.llm.queries import ORACLES, QUERIES
from loomgraph.llm.urls import DigestIndex, build_index, filter_urls


def test_sainte_lague_matches_highest_quotients():
    rng = random.Random(1)
    for _ in range(40):
        n, seats = rng.randint(1, 8), rng.randint(0, 60)
        weight = [rng.choice([0, rng.randint(1, 50)]) for _ in range(n)]
        cap = [rng.choice([1000, rng.randint(0, 9)]) for _ in range(n)]
        out = [0] * n
        queue = [(-weight[i], i) for i in range(n) if weight[i] and cap[i]]
        heapq.heapify(queue)
        for _ in range(seats):
            if not queue:
                break
            _, i = heapq.heappop(queue)
            out[i] += 1
            if out[i] < cap[i]:
                heapq.heappush(queue, (-weight[i] / (2 * out[i] + 1), i))
        assert sainte_lague(np.array(weight), seats, np.array(cap)).tolist() == out


def test_shares_stop_at_the_cap():
    t = shares(np.array([100, 10, 50, 0]), np.array([3.0, 1, 2, 3]), 240, 2)
    assert t.sum() == pytest.approx(240) and t[1] == 20 and t[3] == 0 and (t <= [200, 20, 100, 0]).all()


def test_mix_of_a_skewed_corpus(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 90), rng.choice(["big"] * 8 + ["a", "b", None])) for i in range(600)] + [(900, None, "a"), (901, "x", None), (901, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mix(docs, block=16, shard_words=2000).collect()
    assert len(out) == len(rows)
    taken, size, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert r.source_size >= r.size
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.02 * t + 32
    again = mix(docs.repartition(7), block=16, shard_words=2000)
    assert sorted((r.doc_id, r.taken) for r in again.collect()) == sorted((r.doc_id, r.taken) for r in out)
    texts = mixed_texts(docs, block=16, shard_words=2000)
    assert texts.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in texts.collect()) == sum(taken.values())


def brute_mix(rows, chances, share=1.5, most=2, block=16, shard_words=2000, seed=17):
    """The mix word by word: rows (id, words, source) with their chances, and a function of (source, shard) for a shard's seed."""
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(len(w) for _, w, t in rows if t == s) for s in order}
    target, free, rest = {}, set(order), share * sum(size.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > most * size[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in free}
            break
        target |= {s: float(most * size[s]) for s in over}
        rest, free = rest - sum(target[s] for s in over), free - over

    def highest(quota, seats, caps):
        got = dict.fromkeys(quota, 0)
        for _ in range(seats):
            open_ = [k for k in quota if got[k] < caps[k] and quota[k] > 0]
            if not open_:
                break
            got[max(open_, key=lambda k: quota[k] / (2 * got[k] + 1))] += 1
        return got

    up = lambda n: -(-most * n // block)
    full = {s for s in order if target[s] >= most * size[s] * (1 - 1e-12)}
    some = {s: target[s] for s in order if s not in full}
    seats = highest(some, round(sum(some.values()) / block), {s: up(size[s]) for s in some}) | {s: up(size[s]) for s in full}
    taken = {}
    for s in order:
        shards = max(1, -(-size[s] // shard_words))
        streams = {k: [] for k in range(shards)}
        for (i, words, t), (chance, _) in sorted(zip(rows, chances, strict=True), key=lambda x: (x[1][0], x[0][0], len(x[0][1]))):
            if t == s:
                taken.setdefault(i, 0)
                streams[chance % shards] += [i] * len(words)
        quota = highest({k: len(v) for k, v in streams.items()}, seats[s], {k: up(len(v)) for k, v in streams.items()})
        for k, stream in streams.items():
            left = min(quota[k] * block, most * len(stream))
            while stream and left >= len(stream):
                left -= len(stream)
                for i in stream:
                    taken[i] += 1
            blocks = [stream[j : j + block] for j in range(0, len(stream), block)]
            for j in np.random.default_rng(chances.seed_of(s, k) % 2**64).permutation(len(blocks)) if left else ():
                for i in blocks[j][:left]:
                    taken[i] += 1
                left -= len(blocks[j][:left])
    return taken


def test_mix_matches_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, ["w"] * (rng.choice([0, 1, 5, 15, 16, 17, 90]) if i else 900), rng.choice(["big"] * 6 + ["a", "b", "tiny" if i % 40 == 0 else "a", None])) for i in range(500)]
    docs = spark.createDataFrame([(i, " ".join(w) if w or i % 2 else None, s) for i, w, s in rows], "doc_id long, text string, source string")
    chance = F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), "text")

    class Chances(list):
        @staticmethod
        def seed_of(source, shard):
            row = spark.range(1).select(F.xxhash64(F.lit(17), F.lit("n" if source is None else "k" + source), F.lit(shard).cast("long")).alias("x"))
            return row.first().x

    by_id = {r.doc_id: r.c for r in docs.select("doc_id", chance.alias("c")).collect()}
    expected = brute_mix(rows, Chances([(by_id[i], None) for i, _, _ in rows]))
    assert {r.doc_id: r.taken for r in mix(docs, block=16, shard_words=2000).collect()} == expected
    texts = mixed_texts(docs, block=16, shard_words=2000).select("doc_id", word_count(F.col("text")).alias("n"))
    assert {r.doc_id: r.n for r in texts.groupBy("doc_id").agg(F.sum("n").alias("n")).collect() if r.n} == {i: n for i, n in expected.items() if n}


def test_nothing_to_mix(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty).collect() == [] == mixed_texts(empty).collect()
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken) for r in mix(blank).collect()] == [(0, 0), (0, 0)]


def test_digest_index_confirms_strings(spark, monkeypatch):
    table = spark.createDataFrame([("a", 0), ("b", 1), ("", 2)], "entry string, tag long")
    assert DigestIndex(*build_index(table)).find([b"a", b"b", b"", b"c"]).tolist() == [0, 1, 2, -1]
    monkeypatch.setattr(urls, "RANGE_BYTES", 30)
    many = [(f"e{i}", i) for i in range(50)]
    folder, stems = build_index(spark.createDataFrame(many, "entry string, tag long"))
    assert len(stems) > 3 and DigestIndex(folder, stems).find([f"e{i}".encode() for i in range(51)]).tolist() == [*range(50), -1]
    assert DigestIndex(*build_index(table.limit(0))).find([b"a"]).tolist() == [-1]
    monkeypatch.setattr(urls, "MAX_BYTES", 20)
    with pytest.raises(ValueError, match="bytes"):
        build_index(table)


def test_equal_digests_of_other_strings_do_not_match(tmp_path, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda x: 7)  # all digests collide
    batch = next(urls._hashed(iter([pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([0, 1, 2], pa.int64())], names=["entry", "tag"])])))
    stems = [b.column(0)[0].as_py() for b in urls._write_index(f"file://{tmp_path}")(iter([batch]))]
    assert DigestIndex(f"file://{tmp_path}", stems).find([b"c", b"a", b"x", b"b"]).tolist() == [2, 0, -1, 1]


def test_url_rules(spark):
    urls = {
        1: "http://Example.COM/en/1", 2: "http://www.example.com/en/", 3: "http://x.www.example.com/en/a", 4: "http://notexample.com/en/1", 5: "http://a.net/es/1",
        6: "http://a.net/esx", 7: None, 8: "no scheme.com/en/", 9: "ftp://com", 10: "http://com/", 11: "http://spam-farm.example.org/x", 12: "http://sub.spam-farm.example.org?q=/en/", 13: "http://É.net#/fr/",
    }
    docs = spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(docs).collect()}
    assert got[1] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") == got[3][2:]
    assert got[4][2:] == ("com/", "allow") and got[5][2:] == ("net/es/", "block") and got[6][2:] == (None, "allow")
    assert got[7] == got[8] == ("", "", None, "allow")
    assert got[9] == ("com", "", None, "allow") and got[10][2] == "com/"
    assert got[11][2:] == (None, "block") == got[12][2:] and got[12][1] == "" and got[13][:2] == ("É.net", "")


def test_url_lists_from_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x/1"), (2, "http://b.a.org/y"), (3, "http://c.com/")], "page_id long, url string")
    rules = spark.createDataFrame([("a.org/x/", "block"), ("a.org/x/", "allow"), ("a.org/", "allow"), (None, "block"), ("no path", "block")], "rule string, verdict string")
    hosts = spark.createDataFrame([("c.com",), ("c.com",), (None,)], "host string")
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, rules=rules, blocked_hosts=hosts).collect()}
    assert got == {1: ("a.org/x/", "block"), 2: ("a.org/", "allow"), 3: (None, "block")}
    assert filter_urls(pages.limit(0)).collect() == []
    assert {r.verdict for r in filter_urls(pages, rules={}, blocked_hosts=()).collect()} == {"allow"}


def test_url_lists_from_files(spark, small, tmp_path, monkeypatch):
    (tmp_path / "list.txt").write_text("# hosts\nblock c.com\n\n  block a.org/x/ \nallow a.org/\nallow b.com\nodd line here\nblock example.com\n")
    rules, hosts = urls.read_lists(spark, f"file://{tmp_path}/list.txt")
    assert sorted(map(tuple, rules.collect())) == [("a.org/", "allow"), ("a.org/x/", "block")] and sorted(r.host for r in hosts.collect()) == ["c.com", "example.com"]
    for r in QUERIES["op7_url_filter"](spark, small, lists=f"file://{tmp_path}/list.txt").collect():
        assert r.rule is None and r.verdict == ("block" if f".{r.host}".endswith(".example.com") else "allow")


def test_index_of_a_million_entries(spark, monkeypatch):
    monkeypatch.setattr(urls, "RANGE_BYTES", 4 << 20)
    entry = lambda i: f"host-{i}.example/{i % 7}/"
    rows = spark.range(1_000_000).select(F.format_string("host-%d.example/%d/", "id", F.col("id") % 7).alias("entry"), "id")
    folder, stems = build_index(rows)
    assert len(stems) > 8
    asked = [*range(0, 1_000_000, 997), *range(1_000_000, 1_000_500)]
    mapped, read = DigestIndex(folder, stems), DigestIndex(folder, stems)
    read.mounted = False  # as in a folder that isn't mounted
    for index in (mapped, read):
        assert index.find([entry(i).encode() for i in asked]).tolist() == [i if i < 1_000_000 else -1 for i in asked]
    assert len(read.open) == urls.OPEN_RANGES and index.find([]).tolist() == []


def plain_media(text):
    """The stored form, digests and features of a text, from the contract and the WAV format alone."""
    raw = (text or "").encode()
    payload = raw.ljust(max(64, (len(raw) + 63) // 64 * 64), b"\0")
    stream = io.BytesIO()
    with wave.open(stream, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(8000)
        out.writeframes(payload)
    x = [b - 128 for b in payload]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    feature = f"mean={sum(x) / len(x):.6f};rms={math.sqrt(sum(v * v for v in x) / len(x)):.6f};crossings={crossings};peak={max(map(abs, x))}"
    media_bytes = stream.getvalue()
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media_bytes), hashlib.sha256(media_bytes).hexdigest(), feature


def test_media_query_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *plain_media(r.text)) for r in docs)
    assert sorted(tuple(r) for r in QUERIES["op8_media_columns"](spark, small).collect()) == want


def test_media_round_trip_by_ranges(spark, tmp_path):
    rows = [(i, "é" * i) for i in range(200)] + [(None, None), (7, "dup"), (8, "dup"), (300, "long " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/a"
    assert media.write_archives(docs, folder) == len(rows)
    spark.dataSource.register(media.MediaSource)
    read = spark.read.format("loom_media").option("rangeBytes", "300").load(folder)
    assert read.rdd.getNumPartitions() > 5
    got = media.media_features(read).collect()
    assert len(got) == len(rows)
    want = sorted((n or -1, *(lambda p, k: (k, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))(*media.payload_of(t))) for n, t in rows)
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    twins = {(r.media_sha256, r.feature) for r in got if r.n_bytes == 3 and r.doc_id in (7, 8)}
    assert len(twins) == 1


def test_media_damage(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    media.write_archives(spark.createDataFrame([(1, "abc"), (2, "def")], "doc_id long, text string").coalesce(1), folder)
    archive = next((tmp_path / "b").glob("*.lma"))
    data = bytearray(archive.read_bytes())
    data[50] ^= 255
    archive.write_bytes(bytes(data))
    reader = media.MediaReader({"path": folder})
    with pytest.raises(OSError, match="damaged member"):
        list(reader.read(reader.partitions()[0]))


@pytest.mark.parametrize("failures", [1, 2])
def test_media_member_recovers(spark, tmp_path, monkeypatch, failures):
    """A member that fails once or twice is read again by its offset; the others are read once."""
    folder = f"file://{tmp_path}/d"
    media.write_archives(spark.createDataFrame([(1, "abc"), (2, "def"), (3, "ghi")], "doc_id long, text string").coalesce(1), folder)
    reader, real, seen = media.MediaReader({"path": folder}), zlib.crc32, []

    def shaky(data):
        seen.append(data)
        return real(data) ^ (1 if 1 < len(seen) <= 1 + failures else 0)

    monkeypatch.setattr(media.zlib, "crc32", shaky)
    rows = [r for batch in reader.read(reader.partitions()[0]) for r in batch.to_pylist()]
    assert [r["doc_id"] for r in rows] == [1, 2, 3] and len(seen) == 3 + failures
    assert [media.samples(r["media"]).rstrip(b"\0") for r in rows] == [b"abc", b"def", b"ghi"]


def test_archives_of_other_attempts_are_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    media.write_archives(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), folder)
    stray = media._Writer(folder)
    stray.add(1, "abc from an attempt that was lost")
    stray.close()
    half = media._Writer(folder)
    half.add(2, "an archive without its end")
    half.stream.close()
    assert [r.doc_id for r in media.read_archives(spark, folder).collect()] == [1]


def test_no_media(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    assert media.write_archives(spark.createDataFrame([], "doc_id long, text string"), folder) == 0
    assert media.read_archives(spark, folder).collect() == []


def rows_of(frame):
    return sorted(tuple(repr(v) for v in r) for r in frame)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    frame = QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows_of(frame.select(columns).collect()) == rows_of(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_thirteen_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, small), "test")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] >= 0.97 * sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert out.filter("not lossless").count() == 0 and out.count() == sizes[-1]


def test_pipeline_matches_brute_force(spark, small):
    """Every stage against a plain version, each on what the stage before it kept; nothing of a kept class or text is lost."""
    from test_dedup import brute_classes, brute_substrings
    from test_text_operators import plain_prediction

    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    model = langid.learn(docs.filter(langid.bucket("doc_id") != 1))
    kept = []
    for r in docs.collect():
        if any(c.isalpha() for c in r.text or ""):
            lang, score = plain_prediction(model, r.text)
            if score >= corpus_pipeline.LEAST_SCORE:
                kept.append((r.doc_id, r.text, lang))
    one = corpus_pipeline.written(stages["language ID"](spark, docs, small), "test")
    assert sorted((r.doc_id, r.text, r.lang) for r in one.collect()) == sorted(kept)
    rows = [(i, t) for i, t, _ in kept]
    classes = brute_classes(rows)
    kept = [row for row, c in zip(rows, classes, strict=True) if row[0] == c]
    two = corpus_pipeline.written(stages["MinHash near-dedup"](spark, one, small), "test")
    assert sorted((r.doc_id, r.text) for r in two.collect()) == sorted(kept)
    cut = [(i, t) for i, n, gone, t in brute_substrings(kept) if n == 0 or gone < n]
    three = corpus_pipeline.written(stages["substring dedup"](spark, two, small), "test")
    assert sorted((r.doc_id, r.text) for r in three.collect()) == sorted(cut)
    whole, target, taken = dict(cut), {}, defaultdict(int)
    sources = {r.doc_id: r.source for r in three.collect()}
    for r in mix(three).collect():
        target[r.source] = r.target
    four = corpus_pipeline.written(stages["mixing sources"](spark, three, small), "test")
    for r in four.collect():
        runs, words = [r.text] if r.text == whole[r.doc_id] else r.text.split("\n"), f" {' '.join(whole[r.doc_id].split())} "
        assert r.source == sources[r.doc_id] and (r.text == whole[r.doc_id] or all(f" {run} " in words for run in runs))
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - t) <= 0.02 * t + 128 for s, t in target.items())
    five = stages["SentencePiece encoding"](spark, four, small).collect()
    assert len(five) == four.count() and all(r.lossless and r.n_tokens == len(r.ids) for r in five)


def test_pipeline_takes_hard_rows(spark, small):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "le chien et la rue", "fr", None, 18), (4, "the dog and the road of the town", "en", "a", 9), (4, "the dog and the road of the town", "en", "a", 9), (5, "the dog", None, "b", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    for data in ([(*r, "clash") for r in rows], []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, small)
        docs.collect()
