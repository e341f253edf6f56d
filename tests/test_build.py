"""Normalizers, batches, clusters, tenants and gates against plain versions."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from loomgraph import bridge
from loomgraph.engine import Engine
from loomgraph.operators import clusters as C
from loomgraph.operators import extraction as E
from loomgraph.operators.normalize import normalize
from loomgraph.plans import build_queries
from loomgraph.plans.answers import unanswerable
from loomgraph.plans.retrieval import Corpus, Request, community_list, expand_sources, snippet_window
from loomgraph.schema import relation_types
from loomgraph.security import Access, simulate, visible
from loomgraph.sources.records import to_episodes
from loomgraph.storage import append_rows, of_group, stored_rows
from loomgraph.streaming import flows


def test_chat_with_thread_files_blocks_and_reactions(spark):
    data = {
        "channel": "ops", "channelId": "C1", "userName": "Ada", "visibleUserIds": ["U1", ""], "deniedGroupIds": ["G9"], "classification": "team",
        "threadMessages": [{"user": "bob", "ts": "1", "text": "yes"}, {"content": "and"}, "plain"], "files": [{"name": "a.txt", "filetype": "txt"}, {}],
        "blocks": [{"type": "section", "text": {"text": "inner"}}, {"text": "only"}], "reactions": [{"name": "ok", "count": 2}, {"name": "eyes"}],
        "visibility": {"allowedGroups": ["staff"]},
    }
    rows = spark.createDataFrame([("slack", "hello", json.dumps(data)), ("note", "as it is", None), ("slack", None, "{}")], "source_type string, content string, metadata string")
    out = normalize(rows).collect()
    assert out[0].content.split("\n") == [
        "Channel: ops", "Channel ID: C1", "Sender name: Ada", "Message: hello", "Thread replies:", "bob @ 1: yes", "user @ unknown: and", "plain",
        "Structured blocks:", "section: inner", "only", "Attachments:", "a.txt | txt", "attachment", "Reactions: ok=2, eyes=1",
    ]
    assert json.loads(out[0].metadata)["originalContentLength"] == 5 and json.loads(out[0].metadata)["normalized"] is True
    assert [(e.provider, e.id, e.type, e.access) for e in out[0].visibility.sourceAcl] == [("slack", "U1", "user", "allow"), ("slack", "G9", "group", "deny")]
    assert out[0].visibility.classification == "team" and out[0].visibility.inheritedFrom == "C1" and out[0].visibility.allowedGroups == ["staff"]
    assert out[1].content == "as it is" and out[1].visibility.sourceAcl == [] and json.loads(out[1].metadata) == {"normalized": True, "originalContentLength": 8}
    assert out[2].content == "Message: "


def test_calls_and_records_without_turns_or_fields(spark):
    rows = spark.createDataFrame([("meeting", "said", '{"speakerMap":{"a":1},"title":"T"}'), ("crm", "c", '{"recordType":"deal","fields":{"x":[1]}}'), ("metric", "", '{"metric":"m","value":3}')], "source_type string, content string, metadata string")
    assert [r.content for r in normalize(rows).collect()] == ['Title: T\nSpeaker map: {"a":1}\nTranscript:\nsaid', 'Record type: deal\nFields: {"x":[1]}\nRecord content: c', "Event: m\nValue: 3"]


def test_records_with_access_lists(spark):
    payload = {"id": 7, "subject": "S", "note": "N", "acl": {"users": ["u1", {"id": "u2"}], "denied_groups": ["g"]}, "size": 3, "parts": [1]}
    r = to_episodes(spark.createDataFrame([(json.dumps(payload),), ('{"x":1}',)], "payload string"), "desk", "ticket").collect()
    assert (r[0].source_id, r[0].content) == ("saas://desk/ticket/7", "S\n\nN") and json.loads(r[0].metadata) == {"id": "7", "subject": "S", "note": "N", "size": "3"}
    assert r[0].visibility.allowedPrincipals == ["desk:user:u1", "desk:user:u2"] and r[0].visibility.deniedGroups == ["desk:g"]
    assert r[1].content == '{"x":1}' and r[1].source_id.startswith("saas://desk/ticket/")


def test_a_matched_deny_is_the_reason(spark):
    text = json.dumps({"sourceAcl": [{"provider": "slack", "id": "C1", "type": "channel", "access": "allow"}, {"provider": "slack", "id": "U2", "type": "user", "access": "deny"}]})
    from loomgraph.security import policy

    df = spark.createDataFrame([(text,)], "t string").withColumn("p", policy("t"))
    said = lambda a: df.select(simulate("p", a).alias("s")).first().s
    both = said(Access(groups=("slack:channel:C1",), source_accounts={"slack": "U2"}))
    assert (both.allowed, both.reason, both.denied_by, both.allowed_by) == (False, "denied", ["slack:user:U2"], ["slack:channel:C1"])
    assert said(Access(groups=("slack:channel:C1",))).reason == "allowed" and said(Access()).reason == "no_match"


def greedy_stars(ids, score, least):
    seen, out = set(), []
    for i in sorted(ids):
        if i in seen:
            continue
        near = sorted(((score(i, j), j) for j in ids if j != i and score(i, j) >= least), reverse=True)
        if near:
            seen |= {i, *(j for _, j in near)}
            out.append((i, frozenset(j for _, j in near), min(0.99, sum(s for s, _ in near) / len(near))))
    return out


def tokens(x):
    return frozenset(w for w in "".join(c if c.isalnum() and c.isascii() else " " for c in x.lower()).split() if len(w) > 1)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_entity_stars_match_the_greedy_pass(spark):
    words = ["ada", "bob", "cat", "dog", "eel", "fox"]
    named = {f"e{n:03d}": " ".join(x) for n, x in enumerate(itertools.combinations(words, 4))}
    also = {"e001": ["zeta ypsilon"], "e014": ["zeta ypsilon", "omega psi chi"]}
    e = spark.createDataFrame([(i, "t", n) for i, n in named.items()] + [("x", "u", "ada bob cat dog")], "id string, entity_type string, name string")
    a = spark.createDataFrame([(i, n) for i, ns in also.items() for n in ns], "entity_id string, alias string")
    sets = {i: [tokens(n), *map(tokens, also.get(i, []))] for i, n in named.items()}
    score = lambda i, j: max(jaccard(x, y) for x in sets[i] for y in sets[j])
    got = {}
    for r in C.entity_clusters(e, a, 0.6).collect():
        got.setdefault(r.centre, [set(), r.canonical, r.confidence])[0].add(r.member)
    want = greedy_stars(list(named), score, 0.6)
    assert {(c, frozenset(m - {c}), round(s, 9)) for c, (m, _, s) in got.items()} == {(c, m, round(s, 9)) for c, m, s in want}
    for c, (members, canonical, _) in got.items():
        assert canonical == min(members, key=lambda i: (-len(also.get(i, [])), len(named[i]), i))


def test_relation_stars_match_the_greedy_pass(spark, small):
    rows = build_queries.relation_clusters(spark, small).collect()
    labels = {r.p.lower().replace(" ", "_") for r in spark.read.parquet(f"{small}/part.parquet").select(F.concat_ws(" ", "p_name", "p_type").alias("p")).collect()}
    want = greedy_stars(list(labels), lambda i, j: jaccard(tokens(i.replace("_", " ")), tokens(j.replace("_", " "))), 0.5)
    got = {}
    for r in rows:
        got.setdefault(r.centre, set()).add(r.member)
    assert {(c, frozenset(m - {c})) for c, m in got.items()} == {(c, m) for c, m, _ in want} and got


def test_clusters_are_applied(spark):
    e = spark.createDataFrame([("a", "t", "Ada L", {"k": "1"}), ("b", "t", "Ada Love", {"k": "2", "m": "3"}), ("c", "t", "C", None)], "id string, entity_type string, name string, attributes map<string,string>")
    f = spark.createDataFrame([("f1", "b", "r", "c")], "id string, source string, relation string, target string")
    al = spark.createDataFrame([("b", "Countess")], "entity_id string, alias string")
    kept, facts, aliases = C.apply_entities(e, f, al, spark.createDataFrame([("b", "a")], "duplicate string, canonical string"))
    assert {r.id: r.attributes for r in kept.collect()} == {"a": {"k": "2", "m": "3", "canonicalizedFrom": "b"}, "c": {}}
    assert facts.first().source == "a" and {(r.entity_id, r.alias) for r in aliases.collect()} == {("a", "Countess"), ("a", "Ada Love")}
    out = C.apply_relations(f, spark.createDataFrame([("r", "rel")], "duplicate string, canonical string")).first()
    assert (out.relation, out.relation_was) == ("rel", "r")


def test_extracted_lists_and_types(spark):
    m = spark.createDataFrame([(1, "Ada Lovelace", "person", {"a": "1"})], "episode_id int, name string, entity_type string, attributes map<string,string>")
    d = spark.createDataFrame([(1, "ada", "person", {"email": "x"}), (1, "bob", "person", {"email": "y"}), (2, "ada", "person", None), (1, "LOVELACE", "person", None)], "episode_id int, name string, entity_type string, attributes map<string,string>")
    got = {(r.episode_id, r.name): r.attributes for r in E.merge_entities(m, d).collect()}
    assert got == {(1, "Ada Lovelace"): {"a": "1", "email": "x"}, (1, "bob"): {"email": "y"}, (2, "ada"): None, (1, "LOVELACE"): None} or got[(1, "Ada Lovelace")] == {"a": "1", "email": "x"}
    f = "episode_id int, source string, relation string, target string"
    facts = E.merge_facts(spark.createDataFrame([(1, "A", "r", "B")], f), spark.createDataFrame([(1, "a", "R", "b"), (2, "A", "r", "B")], f))
    assert sorted(tuple(r) for r in facts.collect()) == [(1, "A", "r", "B"), (2, "A", "r", "B")]


def test_merged_names_against_all_pairs(spark):
    """Names in either direction, empty ones, and 3,000 of an episode, whose pairs are never made."""
    draw = random.Random(5)
    name = lambda n: "".join(draw.choice("aBc") for _ in range(draw.randint(0, n)))
    kind = "episode_id int, name string, entity_type string, attributes map<string,string>"
    m = [(e, x, "m", {"a": "1"}) for e in (1, 2) for x in dict.fromkeys(name(6) for _ in range(12))] + [(3, None, "m", None)]
    d = [(e, x, "d", {"b": x}) for e in (1, 2, 3) for x in dict.fromkeys(name(8) for _ in range(30))]
    want = {(e, x): dict(a or {}) for e, x, _, a in m}
    for e, x, _, a in sorted(d, key=lambda r: r[1]):
        hits = [y for i, y, _, _ in m if i == e and y is not None and (x.lower() in y.lower() or y.lower() in x.lower())]
        if hits:
            want[e, min(hits)] |= a
        else:
            want[e, x] = a
    got = E.merge_entities(spark.createDataFrame(m, kind), spark.createDataFrame(d, kind)).collect()
    assert {(r.episode_id, r.name): r.attributes or {} for r in got} == want and len(got) == len(want)
    many = spark.range(3000).select(F.floor(F.col("id") / 3000).cast("int").alias("episode_id"), F.format_string("n%05d", "id").alias("name"), F.lit("t").alias("entity_type"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("attributes"))
    out = E.merge_entities(many, many.withColumn("name", F.substring("name", 2, 5)))
    assert out.count() == 3000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "contains(lower" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.fixture(scope="module")
def stored(spark, small):
    return {"episodes": bridge.episodes(spark, small), "entities": bridge.entities(spark, small), "aliases": bridge.aliases(spark, small), "facts": bridge.facts(spark, small)}


def test_a_batch_is_resolved_as_a_whole(spark, stored):
    day = "2020-01-01 00:00:00"
    ep = spark.createDataFrame([("n1", "crm", "s1", "t", "{}", day), ("n2", "crm", "s1", "again", "{}", day), ("n3", "crm", "s3", "t", "{}", day)], "id string, source_type string, source_id string, content string, metadata string, valid_at string").withColumn("valid_at", F.col("valid_at").cast("timestamp_ntz"))
    rows = [("n1", "Zork Ltd", "customer", "likes", "ZORK LTD", "customer", "z likes z"), ("n1", "REGION_1", "region", "likes", "Quux", "thing", "a"), ("n3", "quux", "thing", "likes", "Quux", "thing", " A "), ("n2", "gone", "thing", "likes", "Quux", "thing", "b")]
    facts = spark.createDataFrame(rows, "episode_id string, source_name string, source_type string, relation string, target_name string, target_type string, fact_text string").withColumns({"confidence": F.lit(0.9), "valid_at": F.lit(None).cast("timestamp_ntz")})
    names = facts.select("episode_id", F.col("source_name").alias("name"), F.col("source_type").alias("entity_type"))
    out = E.ingest_batch(stored, ep, names, facts, spark.createDataFrame([("likes", "many", "never")], "id string, cardinality string, invalidation_policy string"))
    assert sorted(r.id for r in out.episodes.collect()) == ["n1", "n3"] and out.episodes.filter("id = 'n1'").first().content == "Record content: t"
    made = {(r.entity_type, r.name.lower()) for r in out.entities.collect()}
    assert ("customer", "zork ltd") in made and ("thing", "quux") in made and ("thing", "gone") not in made and len(out.entities.filter("entity_type = 'thing'").collect()) == 1
    got = out.facts.collect()
    assert len(got) == 3 and all(str(r.valid_at) == day for r in got) and any(r.source == r.target for r in got)
    assert {r.alias for r in out.aliases.collect()} == {"Zork Ltd"} or {r.alias.lower() for r in out.aliases.collect()} >= {"zork ltd"}


def test_a_batch_reads_the_facts_of_its_relations(spark, stored):
    new = spark.createDataFrame([("part_of",), ("likes",), (None,)], "relation string")
    held = E.I.of_relations(stored["facts"], new)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "o_custkey" not in plan
    assert {r.id for r in held.collect()} == {r.id for r in stored["facts"].filter("relation = 'part_of'").collect()}


def test_tenants_read_their_own_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("default", 3)], "group_id string, n int")
    append_rows(rows, str(tmp_path / "t"))
    append_rows(rows.filter("n = 1"), str(tmp_path / "t"))
    mine = stored_rows(spark, str(tmp_path / "t"), rows.schema, "a")
    assert [r.n for r in mine.collect()] == [1, 1]
    assert "PartitionFilters: [isnotnull(group_id" in mine._jdf.queryExecution().toString()
    assert of_group(rows, "a", also_default=True).count() == 2 and of_group(rows, None).count() == 3


def test_an_engine_for_one_group(spark, small, stored):
    t = {n: bridge.tenanted(df) if "acl" in df.columns else df for n, df in stored.items()}
    engine = Engine(t["entities"], t["facts"], t["episodes"], bridge.tenanted(bridge.memory(spark, small)), t["aliases"], relation_types(spark), Access(groups=("security",)))
    north = engine.for_group("north")
    assert 0 < north.get_facts().count() < engine.get_facts().count() and north.get_facts().filter("acl >= 3").count() == 0
    assert north.relations.count() == engine.relations.count()


def test_windows_around_snippets(spark):
    text = "x" * 3000 + " Needle here " + "y" * 3000
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    found = one(snippet_window(F.lit(text), F.lit("needle HERE")))
    assert "Needle here" in found and len(found) == 1200 + 11 + 1200
    assert one(snippet_window(F.lit(text), F.lit("absent"))) is None and one(snippet_window(F.lit("the Long words side"), F.lit("a long words of no"))) == "the Long words side"
    ep = spark.createDataFrame([("d", text)], "id string, content string").withColumn("visibility", bridge.policy_of(F.lit(3)))
    hits = spark.createDataFrame([("h1", 0.5, "needle here"), ("h2", 0.4, "absent")], "id string, score double, content string")
    kids = spark.createDataFrame([("h1", "d"), ("h2", "d")], "id string, episode_id string")
    r = expand_sources(hits, kids, ep, None).first()
    assert r.score == pytest.approx(0.85) and r.content.startswith("Source context window 1:\n") and "window 2" not in r.content
    assert expand_sources(hits.drop("content"), kids, ep, None).first().content == text[:2400]


def test_what_evidence_lacks(spark):
    rows = spark.createDataFrame([("Ada said so",), ("nobody",)], "content string")
    missing = lambda q, *c: [r.missing for r in unanswerable(rows, q, c).collect()]
    assert missing("What did Ada say?") == [] and missing("What did Ada tell Zork?") == ["zork"]
    assert missing("what now", "price", "cost") == ["price, cost"] and missing("what now", "SAID") == []


def test_community_list(spark, stored):
    rows = spark.createDataFrame([("a", 2.0, "sa", [1.0, 0.0]), ("b", 1.0, "sb", [0.0, 1.0])], "label string, salience double, summary string, embedding array<float>")
    c = Corpus(stored["entities"], stored["facts"], stored["episodes"], communities=rows)
    assert [(r.type, r.id, r.content, r.pos) for r in community_list(c, Request("q", [1.0, 0.0])).collect()] == [("entity", "community:a", "sa", 0)]
    assert community_list(c, Request("q")).collect() == []


def test_context_for_a_model(spark, stored):
    wanted = spark.createDataFrame([("nation:3",), ("none",)], "id string")
    rows = E.context_lines(stored["facts"], stored["entities"], wanted).collect()
    assert len(rows) == 1 and rows[0].line.count(";") <= 3 and "(nation)" in rows[0].line


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    schema = "id string, source_type string, source_id string, valid_at string"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    put(1, [("1", "s", "a", "1"), ("2", "s", "a", "0"), ("3", "s", None, "1")])
    flows.ingest(read(), str(tmp_path / "out"), lambda df: df).awaitTermination()
    put(2, [("4", "s", "a", "2"), ("5", "s", "b", "2")])
    flows.ingest(read(), str(tmp_path / "out"), lambda df: df).awaitTermination()
    got = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "out" / "rows"))
    assert sorted(r.id for r in got.collect()) == ["2", "3", "5"]
    flows.ingest(read(), str(tmp_path / "out"), lambda df: df).awaitTermination()
    assert got.count() == 3


def test_visible_after_inference(spark):
    rows = spark.createDataFrame([("crm", "c", '{"allowedUserIds":["U1"]}')], "source_type string, content string, metadata string")
    p = normalize(rows)
    assert p.filter(visible("visibility", Access(source_accounts={"crm": "U1"}))).count() == 1 and p.filter(visible("visibility", None)).count() == 0
