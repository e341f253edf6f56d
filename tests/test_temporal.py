"""Temporal operators on a hand-made graph."""

import pytest
from pyspark.sql import functions as F

from loomgraph.bridge import policy_of
from loomgraph.operators import graph as G
from loomgraph.operators import temporal as T
from loomgraph.security import Access

SECURITY = Access(groups=("security",))
FACTS = [
    ("f1", "alice", "works_at", "acme", "2024-01-01", "2024-04-01", "2024-01-02", 0.9, 3),
    ("f2", "alice", "works_at", "beta", "2024-04-01", None, "2024-04-02", 0.95, 3),
    ("f3", "bob", "works_at", "acme", "2024-02-01", None, "2024-06-01", 0.8, 3),
    ("f4", "acme", "owns", "atlas", "2024-01-15", "2024-03-01", "2024-01-15", 0.7, 3),
    ("f5", "acme", "owns", "atlas", "2024-03-01", None, "2024-03-01", 0.75, 3),
    ("f6", "atlas", "blocked_by", "kafka", "2024-03-10", None, "2024-03-10", 0.6, 0),
    ("f7", "kafka", "mentions", "kafka", "2024-03-11", None, "2024-03-11", 0.5, 3),
]


@pytest.fixture(scope="module")
def graph(spark):
    df = spark.createDataFrame(FACTS, "id string, source string, relation string, target string, valid_at string, invalid_at string, created_at string, confidence double, acl int")
    df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_at", "invalid_at", "created_at")})
    facts = df.withColumn("fact_text", F.concat_ws(" ", "source", "relation", "target")).withColumn("visibility", policy_of(F.col("acl")))
    names = sorted({x for f in FACTS for x in (f[1], f[3])})
    entities = spark.createDataFrame([(n, "thing", n, "", 3) for n in names], "id string, entity_type string, name string, summary string, acl int").withColumn("visibility", policy_of(F.col("acl")))
    return entities, facts


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


def test_points_and_intervals(graph):
    e, f = graph
    assert ids(T.as_of(f, e, "2024-04-01", None)) == {"f2", "f3", "f5", "f7"}
    assert ids(T.as_of(f, e, "2024-04-01", SECURITY)) == {"f2", "f3", "f5", "f6", "f7"}
    assert ids(T.valid_during(f, e, "2024-04-01", "2024-04-30", None)) == {"f1", "f2", "f3", "f5", "f7"}
    assert {(r.id, r.change) for r in T.changed_since(f, e, "2024-04-01", None).collect()} == {("f2", "created"), ("f3", "created"), ("f1", "invalidated")}
    assert ids(T.get_facts(f, None)) == {"f2", "f3", "f5", "f7"}


def test_contradictions(spark, graph):
    e, f = graph
    assert [(r.old_id, r.new_id) for r in T.contradictions(f, e, None).collect()] == [("f4", "f5")]
    relations = spark.createDataFrame([("works_at", "one_per_source", "always"), ("owns", "one_between_pair", "always")], "id string, cardinality string, invalidation_policy string")
    assert {(r.old_id, r.new_id) for r in T.contradictions_by_cardinality(f, e, relations, None).collect()} == {("f1", "f2"), ("f4", "f5")}
    said = f.withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))
    got = {r.id: r.invalid_at for r in T.supersede(said, relations).collect()}
    assert str(got["f1"]) == "2024-04-01 00:00:00" and str(got["f4"]) == "2024-03-01 00:00:00" and got["f3"] is None and got["f6"] is None


def test_contradictions_are_counted_after_one_sort(spark, graph):
    e, f = graph
    out = T.contradiction_counts(f, e, None)
    assert {(r.id, r.later, r.next_id) for r in out.collect()} == {("f1", 0, None), ("f4", 1, "f5")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("valid_at#") and sum(line.strip(" :+-*()0123456789").startswith("Sort [") and "valid_at" in line for line in plan.split("== Initial Plan ==")[-1].split("\n")) == 1


def test_late_facts_fall_into_place(spark):
    rows = [("a", "x", "r", "1", "2024-03-01"), ("b", "x", "r", "2", "2024-01-01"), ("c", "x", "r", "3", "2024-02-01")]
    said = spark.createDataFrame(rows, "id string, source string, relation string, target string, valid_at string").withColumn("valid_at", F.col("valid_at").cast("timestamp_ntz")).withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))
    relations = spark.createDataFrame([("r", "one_per_source", "always")], "id string, cardinality string, invalidation_policy string")
    got = {r.id: str(r.invalid_at)[:10] for r in T.supersede(said, relations).collect()}
    assert got == {"b": "2024-02-01", "c": "2024-03-01", "a": "None"}


def test_traversal(spark, graph):
    e, f = graph
    seed = lambda n: spark.createDataFrame([(n,)], "id string")
    hops = lambda who, n: {r.id: r.hop for r in G.traverse(f, G.edges_of(f, e, who), seed(n)).collect()}
    assert hops(None, "alice") == {"f2": 1} == hops(SECURITY, "alice")
    assert hops(SECURITY, "bob") == {"f3": 1, "f5": 2, "f6": 3}
    assert hops(None, "bob") == {"f3": 1, "f5": 2}


def test_timeline(graph):
    e, f = graph
    assert [(r.id, r.status) for r in T.entity_timeline(f, e, "alice", None).collect()] == [("f1", "superseded"), ("f2", "current")]


def test_as_of_join(spark, graph):
    _, f = graph
    events = spark.createDataFrame([("alice", "2024-02-01"), ("alice", "2024-05-01"), ("alice", "2023-01-01"), ("carol", "2024-02-01")], "who string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = {(r.who, str(r.ts)[:10]): r.target for r in T.as_of_join(events, f.filter("relation = 'works_at'"), "who", "ts").collect()}
    assert got == {("alice", "2024-02-01"): "acme", ("alice", "2024-05-01"): "beta", ("alice", "2023-01-01"): None, ("carol", "2024-02-01"): None}
