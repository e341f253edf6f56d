"""Streams with keyed state: any order and batch size ends in the batch operator's rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import temporal as T
from loomgraph.streaming import flows, keyed

START = datetime.datetime(2024, 1, 1)


def facts_of(rng, keys=4, n=60):
    """Facts with ties and hot keys over some months."""
    return [(rng.choice(["hot"] * 5 + [f"k{i}" for i in range(keys)]), START + datetime.timedelta(days=rng.randint(0, 60), hours=rng.choice([0, 0, 5])), f"f{i}") for i in range(n)]


@pytest.mark.parametrize("batches", [1, 7])
def test_late_facts_split_intervals(spark, batches):
    rng = random.Random(batches)
    rows = facts_of(rng)
    said = [(k, t, i, rng.randrange(batches)) for k, t, i in rows] + [(*rows[0], batches - 1), (None, START, "x", 0), ("k0", None, "y", 0), ("k0", START, None, 0)]
    stream = flows.pieces_of(spark.createDataFrame(said, "key string, at timestamp_ntz, id string, piece int"), F.col("piece"), batches)
    got = flows.settled(keyed.intervals(stream.drop("piece"), "key", "at", "id"), "intervals", ["key", "id"])
    facts = spark.createDataFrame([(i, k, "r", "t", t, None) for k, t, i in rows], "id string, source string, relation string, target string, valid_at timestamp_ntz, invalid_at timestamp_ntz")
    relations = spark.createDataFrame([("r", "one_per_source", "always")], "id string, cardinality string, invalidation_policy string")
    want = T.supersede(facts, relations).select(F.col("source").alias("key"), "id", "valid_at", "invalid_at")
    assert sorted(map(str, got.select("key", "id", "valid_at", "invalid_at").collect())) == sorted(map(str, want.collect()))


def test_changes_take_back_what_they_replace(spark):
    day = lambda n: START + datetime.timedelta(days=n)
    said = [("k", day(0), "a", 0), ("k", day(40), "c", 0), ("k", day(20), "b", 1)]
    stream = flows.pieces_of(spark.createDataFrame(said, "key string, at timestamp_ntz, id string, piece int"), F.col("piece"), 2)
    out = flows.run(keyed.intervals(stream, "key", "at", "id"), "changes").collect()
    assert sorted((r.change, r.id, r.invalid_at) for r in out if r.invalid_at) == [("+", "a", day(20)), ("+", "a", day(40)), ("+", "b", day(40)), ("-", "a", day(40))]


def test_intervals_forget_what_the_watermark_settles(spark):
    day = lambda n: START + datetime.timedelta(days=n)
    said = [("k", day(n), f"f{n:03}", n // 10) for n in range(0, 100, 2)] + [("k", day(1), "too late", 9)]
    stream = flows.pieces_of(spark.createDataFrame(said, "key string, at timestamp_ntz, id string, piece int"), F.col("piece"), 10)
    got = {r.id: r.invalid_at for r in flows.settled(keyed.intervals(stream, "key", "at", "id", "15 days"), "intervals", ["key", "id"]).collect()}
    assert got == {f"f{n:03}": day(n + 2) if n < 98 else None for n in range(0, 100, 2)}


def test_expiry_is_cancelled_by_what_rests_on_an_episode(spark):
    at = lambda n: START + datetime.timedelta(days=n)
    rows = [("gone", at(0), "ephemeral", None, None, 0), ("short", at(0), "ephemeral", 1, None, 0), ("kept", at(0), "ephemeral", None, None, 0), ("durable", at(0), "durable", None, None, 0), ("used first", at(0), None, None, True, 0), ("used first", at(1), "ephemeral", None, None, 1)]
    rows += [("kept", at(3), None, None, True, 1), ("new", at(10), "ephemeral", None, None, 2), ("clock", at(15), None, None, None, 2)]
    stream = flows.pieces_of(spark.createDataFrame(rows, "id string, ts timestamp, retention string, ttl_days int, rests boolean, piece int"), F.col("piece"), 3)
    got = {r.id: r.expired_at for r in flows.run(keyed.expiries(stream), "expiries").collect()}
    assert got == {"gone": at(14), "short": at(1)}


def test_pieces_of_many_files_are_a_batch_each(spark, monkeypatch):
    """Also where a piece has fewer rows than files; the intervals are those of one batch, ties and all."""
    monkeypatch.setattr(flows, "FILE_ROWS", 40)
    rng = random.Random(5)
    rows = [(n, rng.randrange(6), START + datetime.timedelta(hours=rng.randint(0, 700)), rng.choice(["a", "b", None])) for n in range(300)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string")
    piece = F.when(F.col("ts") < START + datetime.timedelta(hours=5), 0).when(F.col("ts") < START + datetime.timedelta(hours=200), 1).otherwise(2)
    stream, seen = flows.pieces_of(events, piece, 3), []
    flows.each_batch(stream, lambda df, n: seen.append((df.count(), df.select(piece.alias("p")).distinct().count(), df.rdd.getNumPartitions())), flows.new_folder(spark, "state"), "append").awaitTermination()
    assert [n for n, *_ in seen] == [events.filter(piece == k).count() for k in range(3)] and all(p <= 1 for _, p, _ in seen)
    got = {(r.event_id, r.event_type, r.valid_at, r.invalid_at) for r in flows.run(flows.superseding(flows.pieces_of(events, piece, 3)), "supersede").collect()}
    want = set()
    for user in range(6):
        own = sorted((t, n, k) for n, u, t, k in [(n, u, t, k or "") for n, u, t, k in rows] if u == user)
        want |= {(n, k or None, t, following[0]) for (t, n, k), following in zip(own, own[1:])}
    assert got == want
