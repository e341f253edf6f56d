"""The engine over the smallest tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomgraph import bridge
from loomgraph.engine import Engine
from loomgraph.plans.answers import bound, subjects
from loomgraph.plans.retrieval import community_search
from loomgraph.schema import relation_types
from loomgraph.security import Access


@pytest.fixture(scope="module")
def engine(spark, small):
    return Engine(bridge.entities(spark, small), bridge.facts(spark, small), bridge.episodes(spark, small), bridge.memory(spark, small), bridge.aliases(spark, small), relation_types(spark), Access(groups=("security",)))


def test_reads(engine):
    assert engine.get_entity("nation:3").first().entity_type == "nation"
    assert engine.find_entity("nation").count() > 0
    facts = engine.get_facts(either="nation:3")
    assert facts.count() > 0 and facts.filter("invalid_at is not null").count() == 0
    assert engine.related("nation:3").count() > 0
    assert engine.seen_by(None).get_facts().count() < engine.get_facts().count()


def test_writes(spark, engine):
    one = engine.facts.filter("id = 'part_of:3'").withColumns({"id": F.lit("new"), "target": F.lit("region:0"), "valid_at": F.lit("1999-01-01").cast("timestamp_ntz")})
    after = engine.assert_facts(one).facts.filter("source = 'nation:3'").collect()
    assert {(r.id, r.invalid_at is None) for r in after} == {("part_of:3", False), ("new", True)}
    assert engine.assert_facts(engine.facts.limit(5)).facts.count() == engine.facts.count()
    merged = engine.merge(spark.createDataFrame([("nation:3", "nation:4")], "duplicate string, canonical string"))
    assert merged.facts.filter("source = 'nation:3' or target = 'nation:3'").count() == 0 and merged.get_entity("nation:3").count() == 0


def test_clusters_hold_equal_names(spark, engine):
    names = [("x1", "Ada Lovelace"), ("x2", "ada  lovelace"), ("x3", "Ada B Lovelace"), ("x4", "Grace Hopper"), ("x5", "Alan M Turing Bletchley park london"), ("x6", "Alan Turing Bletchley park"), ("x7", "Alan Turing bletchley park")]
    one = engine.entities.filter("id = 'nation:3'").drop("id", "name").crossJoin(spark.createDataFrame(names, "id string, name string"))
    got = replace(engine, entities=one.select(*engine.entities.columns)).canonical_clusters(0.8).collect()
    assert {(r.id, r.canonical, r.band) for r in got} == {("x1", "x1", "apply"), ("x2", "x1", "apply"), ("x3", "x1", "apply"), ("x5", "x5", "ambiguous"), ("x6", "x5", "ambiguous"), ("x7", "x5", "ambiguous")}


def test_answers_cite_what_they_say(engine):
    closed = engine.answer("worthless", methods=("keyword",), now="2001-01-01")
    assert closed.citations.count() == 0 and closed.answer.first().answer == ""  # no subject and no judge
    got = engine.answer("worthless", lambda rows: rows, methods=("keyword",), now="2001-01-01")
    cited, said = got.citations.collect(), got.answer.first()
    assert cited and any("worthless" in r.content.lower() for r in cited) and "[C1]" in said.answer
    nothing = engine.answer("Zanzibar worthless", methods=("keyword",), now="2001-01-01")
    assert nothing.citations.count() == 0 and nothing.answer.first().answer == ""


def test_subjects(spark):
    assert subjects("What did Ada Lovelace say about IBM?") == ["ada lovelace", "ibm"] and subjects("what now") == []
    rows = spark.createDataFrame([("Ada said so",), ("nobody",)], "content string")
    assert [r.content for r in bound(rows, "What did Ada say?").collect()] == ["Ada said so"]


def test_community_search(spark):
    rows = [("a", 2.0, [1.0, 0.0]), ("b", 1.0, [0.0, 1.0]), ("c", 1.0, [0.0, 0.0]), ("d", 1.0, None)]
    out = community_search(spark.createDataFrame(rows, "label string, salience double, embedding array<float>"), [1.0, 0.0]).collect()
    assert [(r.label, r.score) for r in out if r.score == r.score] == [("a", pytest.approx(1.0))]
