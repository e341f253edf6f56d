"""Graph kernels: properties on small graphs."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph import bridge, catalog
from loomgraph.operators import graph as G


def frames(spark, nodes, edges, both=True):
    rows = [(a, b, float(w)) for a, b, w in edges] + ([(b, a, float(w)) for a, b, w in edges] if both else [])
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(rows, "src string, dst string, weight double")


def rank(spark, nodes, edges, seeds, **options):
    n, e = frames(spark, nodes, edges)
    return {r.id: r.score for r in G.pagerank(n, e, spark.createDataFrame([(s,) for s in seeds], "id string"), **options).collect()}


PATH = [("A", "B", 1), ("B", "C", 1), ("C", "D", 1)]


def test_pagerank_properties(spark):
    x = rank(spark, "ABCD", PATH, "A")
    assert sum(x.values()) == pytest.approx(1, abs=1e-3) and x["A"] > x["C"] > 0
    x = rank(spark, "ABC", [("A", "B", 10), ("A", "C", 1)], "A")
    assert x["B"] > x["C"]
    near, far = rank(spark, "ABCD", PATH, "A", alpha=0.5), rank(spark, "ABCD", PATH, "A", alpha=0.05)
    assert near["A"] > far["A"] and far["D"] > near["D"]
    star = rank(spark, "HBCDE", [("H", s, 1) for s in "BCDE"], "B")
    assert star["C"] == pytest.approx(star["E"], abs=1e-6)


def test_pagerank_edges(spark):
    assert set(rank(spark, "AB", [("A", "B", 1)], ["nobody"]).values()) == {0.0}
    n, e = frames(spark, "ABC", [])
    x = {r.id: r.score for r in G.pagerank(n, e, spark.createDataFrame([("A",)], "id string")).collect()}
    assert x == {"A": pytest.approx(1), "B": 0, "C": 0}


def labels(spark, nodes, edges):
    n, e = frames(spark, nodes, edges)
    return {r.id: r.label for r in G.propagate_labels(n, e).collect()}


def test_label_propagation(spark):
    assert len(set(labels(spark, "ABC", [("A", "B", 1), ("B", "C", 1), ("A", "C", 1)]).values())) == 1
    two = labels(spark, "ABCDEF", [("A", "B", 5), ("B", "C", 5), ("A", "C", 5), ("D", "E", 5), ("E", "F", 5), ("D", "F", 5), ("C", "D", 0.1)])
    assert len({two[x] for x in "ABC"}) == 1 == len({two[x] for x in "DEF"}) and two["A"] != two["D"]
    alone = labels(spark, "ABX", [("A", "B", 1)])
    assert alone["X"] == "X" and alone["A"] == alone["B"]


def test_components_of_a_long_path(spark):
    names = [f"n{i:03d}" for i in range(40)]
    n, e = frames(spark, [*names, "z"], [(a, b, 1) for a, b in zip(names, names[1:])])
    got = {r.id: r.label for r in G.components(n, e).collect()}
    assert {got[x] for x in names} == {"n000"} and got["z"] == "z"


def test_all_components_match_union_find(spark, small):
    entities = [r.id for r in bridge.entities(spark, small).filter(bridge.sees("acl", "security")).select("id").collect()]
    parent = {i: i for i in entities}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    facts = bridge.facts(spark, small).filter("invalid_at is null").filter(bridge.sees("acl", "security")).select("source", "target").collect()
    for r in facts:
        if r.source in parent and r.target in parent:
            x, y = sorted((find(r.source), find(r.target)))
            parent[y] = x
    want = {i: find(i) for i in entities}
    assert {i.split(":")[0] for i in want} > {"nation", "region", "supplier"}
    assert {r.id: r.label for r in catalog.queries()["all_components"](spark, small).collect()} == want


def test_resolution_reads_aliases(spark, small, tmp_path):
    """An extracted name that is only an alias of a known entity is that entity."""
    for name in os.listdir(small):
        if name != "customer.parquet":
            os.symlink(f"{small}/{name}", tmp_path / name)
    rows = spark.createDataFrame([(1, "unknown#0BUILDING", "x"), (2, "Customer#2", "BUILDING")], "k long, name string, segment string")
    customers = spark.read.parquet(f"{small}/customer.parquet").join(rows, F.col("c_custkey") == F.col("k"))
    customers = customers.withColumn("c_name", F.col("name")).withColumn("c_mktsegment", F.col("segment")).drop("k", "name", "segment")
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.name: (r.decision, r.entity_id, r.score) for r in catalog.queries()["resolve_entities"](spark, str(tmp_path)).collect()}
    assert got["unknown BUILDING"] == ("merge", "customer:1", 0.95)


def test_full_salience_matches_brute_force(spark, small):
    label = {r.id: r.label for r in catalog.queries()["lpa_full"](spark, small).collect()}
    size, inside = Counter(label.values()), Counter()
    for r in bridge.facts(spark, small).filter("invalid_at is null").filter(bridge.sees("acl", "security")).select("source", "target", "confidence").collect():
        if r.source in label and label[r.source] == label.get(r.target):
            inside[label[r.source]] += r.confidence
    want = {x: (n, pytest.approx(math.log1p(n) + math.log1p(inside[x]), abs=2e-5)) for x, n in size.items() if n > 1}
    assert {r.label: (r.size, r.salience) for r in catalog.queries()["community_salience_full"](spark, small).collect()} == want


def test_merge_rewrites_both_endpoints(spark):
    f = spark.createDataFrame([("1", "a", "b"), ("2", "c", "a")], "id string, source string, target string")
    m = spark.createDataFrame([("a", "x")], "duplicate string, canonical string")
    assert sorted(map(tuple, G.merge_entities(f, m).collect())) == [("1", "x", "b"), ("2", "c", "x")]


@pytest.mark.parametrize("least", [0.5, 0.82, 1 / 3])
def test_similar_names_match_brute_force(spark, least):
    rng = random.Random(7)
    words = ["common", *(f"w{i}" for i in range(14))]
    rows = [(i, rng.choice("tu"), " ".join(["common", *rng.sample(words, rng.randint(0, 7))])) for i in range(80)] + [(90, "t", "x"), (91, "t", "")]
    names = spark.createDataFrame(rows, "id long, entity_type string, name string")
    first = {}
    for i, kind, name in rows:
        if t := frozenset(w for w in name.split() if len(w) > 1):
            first.setdefault((kind, t), i)
    want = {(i, j) for (k, t), i in first.items() for (m, u), j in first.items() if k == m and i < j and len(t & u) / len(t | u) >= least}
    assert {(r.a, r.b) for r in G.similar_names(names, least).collect()} == want
    members = {r.id: r.representative for r in G.name_members(names).collect()}
    assert members == {i: first[kind, t] for i, kind, name in rows if (t := frozenset(w for w in name.split() if len(w) > 1))}


def test_rounds_shuffle_what_changes_only(spark, monkeypatch):
    """Edges are dealt by their key once: the plan of a round has no exchange over them, only over labels and sums."""
    seen = []
    keep = G.written
    monkeypatch.setattr(G, "written", lambda df, label: seen.append((label, df._jdf.queryExecution().executedPlan().toString())) or keep(df, label))
    rng = random.Random(5)
    n, e = frames(spark, [f"n{i}" for i in range(60)], [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", 1) for _ in range(150)])
    G.propagate_labels(n, e, 2)
    rounds = [plan for label, plan in seen if label == "labels" and "moved" in plan]
    assert rounds and all("InMemoryTableScan [a#" in plan and "hashpartitioning(a#" not in plan and "hashpartitioning(src" not in plan for plan in rounds)


def test_order_of_numbers_is_that_of_ids(spark):
    ids = ["b", "a", "10", "9", "é", "Z", "a", "customer:10", "customer:9"]
    got = G.numbered(spark.createDataFrame([(i,) for i in ids], "id string")).orderBy("n").collect()
    assert [r.id for r in got] == sorted(set(ids), key=lambda x: x.encode())


def test_edges_to_unknown_nodes_count_in_totals_only(spark):
    """An edge that leaves the nodes takes its share of a score along, and votes; one from elsewhere does nothing."""
    n, e = frames(spark, "AB", [("A", "B", 1), ("A", "X", 3), ("Y", "B", 9)], both=False)
    x = {r.id: r.score for r in G.pagerank(n, e, spark.createDataFrame([("A",), ("X",)], "id string"), rounds=1).collect()}
    assert x == {"A": pytest.approx(0.15), "B": pytest.approx(0.85 / 4)}
    assert {r.id: r.label for r in G.propagate_labels(n, e).collect()} == {"A": "A", "B": "B"}
    assert {r.id: r.label for r in G.components(n, e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))).collect()} == {"A": "A", "B": "A"}


@pytest.mark.parametrize("as_of", [None, "2001-07-25"])
def test_a_search_over_the_graph_makes_its_edges_once_and_shows_what_its_caller_sees(spark, monkeypatch, as_of):
    from loomgraph.bridge import policy_of
    from loomgraph.plans import retrieval as R
    from loomgraph.security import Access

    entities = spark.createDataFrame([(f"n{i}", "node", f"node {i}", "") for i in range(8)], "id string, entity_type string, name string, summary string").withColumn("visibility", policy_of(F.when(F.col("id") == "n7", 0).otherwise(3)))
    data = [(f"f{i}", f"n{i % 8}", "near", f"n{i * 3 % 8}", 0.5 + i / 40, f"2001-07-{1 + i:02}", f"2001-07-{20 + i % 9:02}" if i % 4 == 0 else None, 0 if i == 5 else 3) for i in range(16)]
    facts = spark.createDataFrame(data, "id string, source string, relation string, target string, confidence double, v string, e string, acl int")
    facts = facts.select("id", "source", "relation", "target", "confidence", *[F.col(c).cast("timestamp_ntz").alias(n) for c, n in (("v", "valid_at"), ("e", "invalid_at"), ("v", "created_at"))], F.concat_ws(" ", "source", "relation", "target").alias("fact_text"), policy_of(F.col("acl")).alias("visibility"))
    episodes = facts.select("id", F.col("fact_text").alias("content"), "valid_at", "visibility")
    asked = R.Request("near n1", now="2001-08-01", as_of=as_of, access=Access(groups=("others",)), limit=30, methods=("keyword", "graph", "pagerank", "temporal"), seeds=spark.createDataFrame([("n1",)], "id string"))
    corpus = R.Corpus(entities, facts, episodes)
    want = R.fuse([R.METHODS[m](corpus, asked) for m in R.METHODS if m in asked.methods])
    want = {(r.type, r.id): r.score for r in (want if as_of is None else want.filter(R.true_at(as_of))).withColumn("score", R.recency(F.col("score"), F.col("valid_at"), asked.now)).collect()}
    made, edges_of = [], R.G.edges_of
    monkeypatch.setattr(R.G, "edges_of", lambda *a: made.append(a) or edges_of(*a))
    got = {(r.type, r.id): r.score for r in R.search(corpus, asked).collect()}
    assert len(made) == 1 and got.keys() <= want.keys() and len(got) == min(30, len(want))
    assert all(got[k] == pytest.approx(want[k]) for k in got) and not {("fact", "f5"), ("entity", "n7")} & got.keys()


def test_a_text_is_analyzed_once_for_its_rank(spark):
    from loomgraph.plans import retrieval as R

    rows = spark.range(5).select(F.concat(F.lit("red blue "), "id").alias("text"))
    plan = R.keyword_rank(rows.repartition(2), F.col("text"), "red 3 blue")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
