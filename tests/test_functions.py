"""Text and vector functions, fusion, sources and skills."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.bridge import policy_of
from loomgraph.functions import text as X
from loomgraph.functions import vector as V
from loomgraph.operators import ingest as I
from loomgraph.operators import memory as M
from loomgraph.plans import retrieval as R
from loomgraph.sources.files import text_files
from loomgraph.sources.rest import Definition, read_rest, records, to_episodes
from loomgraph.sources.webhooks import WebhookSource, local_signature, receive


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_trigrams_and_jaccard(spark):
    assert one(spark, X.similarity(F.lit("word"), F.lit("two words"))) == pytest.approx(0.363636, abs=1e-6)
    assert one(spark, X.similarity(F.lit(""), F.lit("a"))) == 0
    assert one(spark, X.token_jaccard(F.lit("Acme Corp"), F.lit("acme-corp"))) == 1
    assert one(spark, X.token_jaccard(F.lit("a"), F.lit("a"))) == 0


def test_websearch_clauses(spark):
    clauses = X.websearch('alpha "beta gamma" or delta -epsilon')
    hit = lambda t: one(spark, X.matches(X.terms(F.lit(t)), clauses))
    assert hit("alpha beta gamma") and hit("Alpha, delta!") and not hit("alpha gamma beta") and not hit("alpha delta epsilon") and not hit("delta")
    assert not one(spark, X.matches(X.terms(F.lit("x")), X.websearch("the")))


def test_rank_of_two_hits(spark):
    want = (0.1 * (1 + 1 / 4) / X.BASIS + 0) / 2
    assert one(spark, X.rank_any(X.terms(F.lit("cat sat cat")), ["cat", "dog"])) == pytest.approx(want)


def test_extraction(spark):
    assert one(spark, X.emails(F.lit("Send to alice@acme.com and bob@bigco.io"))) == ["alice@acme.com", "bob@bigco.io"]
    assert one(spark, X.mentions(F.lit("Ask @jsmith or a@acme.com"))) == ["jsmith", "acme"]
    assert one(spark, X.mentions(F.lit("Ask @jsmith or a@acme.com"), outside_emails=True)) == ["jsmith"]
    quote = one(spark, X.evidence_quote(F.lit("It was Alice who led."), F.lit("bob"), F.lit("alice")))
    assert quote.quote.startswith("Alice") and quote.start == 7


def test_templates_and_detection(spark):
    payload = F.lit(json.dumps({"a": {"b": 1}, "title": "T", "body": "  ", "text": "hello", "date": "1700000000"}))
    assert one(spark, X.render("x {{a.b}} {{none}}!", payload)) == "x 1 !"
    assert one(spark, X.detect_content(payload)) == "T\nhello"
    assert str(one(spark, X.detect_date(payload))) == "2023-11-14 22:13:20"
    assert one(spark, X.slug(F.lit(" Hello, World! "))) == "hello-world"


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, V.cosine(v(1, 2), v(2, 4))) == pytest.approx(1)
    assert one(spark, V.cosine(v(1, 0), v(0, 1))) == 0
    assert math.isnan(one(spark, V.cosine(v(0, 0), v(0, 1))))
    assert sum(x * x for x in one(spark, V.hashed_embedding(X.terms(F.lit("some words here")), 8))) == pytest.approx(1, abs=1e-5)


def ranked(spark, *ids, kind="fact"):
    return spark.createDataFrame([(kind, i, n, 1.0, f"c{i}") for n, i in enumerate(ids)], "type string, id string, pos long, score double, content string").withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("valid_at", "invalid_at")})


def test_close_pairs_are_exact_over_many_groups(spark, monkeypatch):
    """Copies, zero vectors and long ones too; no pair is left to chance, whatever the number of groups."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 8))
    x[:90] /= np.linalg.norm(x[:90], axis=1, keepdims=True)
    x[5], x[6], x[100] = x[4], 0, 1000 * x[100]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "k long, v array<double>")
    want = {(i, j): pytest.approx(d) for i in range(120) for j in range(i + 1, 120) if (d := float(np.linalg.norm(x[i] - x[j]))) < 1.05}
    assert (4, 5) in want and len(want) > 100
    for cell in (V.CELL, 10):
        monkeypatch.setattr(V, "CELL", cell)
        got = V.close_pairs(rows, "k", "v", 1.05).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.distance for r in got} == want


def test_fusion(spark):
    got = {r.id: r.score for r in R.fuse([ranked(spark, "a", "b"), ranked(spark, "b", "c")]).collect()}
    assert got["b"] == 1.0 and got["a"] == pytest.approx((1 / 60) / (1 / 61 + 1 / 60)) and got["c"] < got["a"]
    assert R.fuse([ranked(spark, "a"), ranked(spark, "a", kind="entity")]).count() == 2
    assert R.fuse([ranked(spark, "a")]).first().score == 1.0


def test_recency(spark):
    t = F.lit("2024-01-01").cast("timestamp_ntz")
    assert one(spark, R.recency(F.lit(1.0), t, "2024-01-01")) == pytest.approx(1.1)
    assert one(spark, R.recency(F.lit(1.0), t, "2026-01-01")) == 1.0
    assert one(spark, R.recency(F.lit(1.0), F.lit(None).cast("timestamp_ntz"), "2024-01-01")) == 1.0


def test_plans_pass_context_on(spark):
    asked = []

    def ask(question):
        asked.append(question)
        return ranked(spark, "x", f"y{len(asked)}")

    out = R.run_plan([R.SubQuery("first"), R.SubQuery("second", (0,))], ask)
    assert asked[1] == "second (Context: cx; cy1)" and sorted(r.id for r in out.collect()) == ["x", "y1", "y2"]


def test_known_names(spark):
    docs = spark.createDataFrame([(1, "We met Bob Zhang at Acme Corp."), (2, "bobzhang"), (3, None)], "id long, text string")
    names = spark.createDataFrame([("bob zhang",), ("acme corp",), ("acme",)], "alias string")
    assert sorted(map(tuple, I.known_names(docs, names, "id", "text").collect())) == [(1, "acme"), (1, "acme corp"), (1, "bob zhang")]


def test_known_names_of_any_length_and_number(spark):
    """Names that tasks hold and names that are shuffled find the same; the texts' words go through no shuffle to meet them."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "x b c"), (2, "b c d e x"), (3, "a b c d"), (None, "c d e x a"), (4, "")], "id long, text string")
    names = spark.createDataFrame([(n,) for n in ("a b c d e f", "b c d e x", "a b c d", "b c", "x", "c d e f g", "b c d e f")], "alias string")
    want = {(1, "a b c d e f"), (1, "a b c d"), (1, "b c"), (1, "x"), (1, "b c d e f"), (2, "b c d e x"), (2, "b c"), (2, "x"), (3, "a b c d"), (3, "b c"), (None, "x")}
    for most in (I.HELD_NAMES, 0):
        found = I.known_names(docs, names, "id", "text", most)
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert I.known_names(docs, names.limit(0), "id", "text").collect() == []
    plan = I.known_names(docs, names, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "rest" not in plan and plan.count("Generate explode") == 1


def test_skills(spark):
    skills = spark.createDataFrame([("query", 1, ["what do we know about"]), ("enrich", 2, ["enrich this person"])], "skill string, priority int, triggers array<string>")
    inputs = spark.createDataFrame([(1, "What do we know about Acme"), (2, "enrich this person"), (3, "nothing fits")], "id long, text string")
    got = {r.id: (r.skill, r.confidence) for r in M.resolve_skills(inputs, skills).collect()}
    deploy = spark.createDataFrame([("ship", 3, ["Deploy", "", None]), ("none", 9, ["x-ray the  thing"])], "skill string, priority int, triggers array<string>")
    inside = {r.id: (r.skill, r.confidence) for r in M.resolve_skills(spark.createDataFrame([(1, "we are deploying now"), (2, "redep"), (3, None), (4, "")], "id long, text string"), deploy).collect()}
    assert inside == {1: ("ship", pytest.approx(0.8 + 0.2 * 6 / 20))}
    assert got[1][0] == "query" and 0.8 < got[1][1] <= 0.95 and got[2] == ("enrich", 1.0) and 3 not in got


def test_memory_derivation(spark):
    rows = [("e", 1, "decision", "Use  Kafka", None, 1.7), ("e", 2, "decision", "use kafka!", "decided", 2.2), ("e", 3, "gossip", "x", None, 0.5), ("e", 4, "risk", "y", "active", None), ("e", 5, "risk", "z" * 300, "open", -1.0), ("e", 6, "risk", "z" * 299, "done", 0.1)]
    rows = spark.createDataFrame(rows, "episode_id string, n int, kind string, summary string, status string, confidence double")
    out = M.derive(rows, ("decision", "risk")).collect()
    assert sorted((r.n, r.kind, r.confidence, r.status) for r in out) == [(1, "decision", 1.0, "observed"), (4, "risk", 0.7, "observed"), (5, "risk", 0.0, "open")]
    assert sorted(r.n for r in M.derive(rows, ("decision", "risk"), most=3, key_chars=None).collect()) == [1, 4, 5]
    assert [r.title for r in M.derive(rows.withColumn("title", F.lit("")), ("decision",)).collect()] == ["decision"]


def test_summaries_hold_public_facts_only(spark):
    at = lambda d: datetime.datetime(2024, 1, d)
    rows = [("1", "e", "Secret plan", at(1), 0), ("2", "e", "Likes tea", at(2), 3), ("3", "e", " likes TEA ", at(3), 3), ("4", "e", "x" * 50, at(4), 3), ("5", "f", "y" * 90, at(1), 3), ("6", "g", "hidden", at(1), 1)]
    facts = spark.createDataFrame(rows, "id string, source string, fact_text string, valid_at timestamp_ntz, acl int").withColumn("visibility", policy_of(F.col("acl")))
    assert {r.id: r.summary for r in I.summary_lines(facts, 60).collect()} == {"e": "Likes tea\n" + "x" * 50, "f": "y" * 90}
    assert {r.id: r.summary for r in I.summary_lines(facts, 59).collect()} == {"e": "x" * 50, "f": "y" * 90}


def test_triage_of_chunks(spark):
    rows = [(1, c, "drop", 0.1, None, ["a", "b"], ["no", "no", "no"]) for c in range(1, 9)] + [(1, 9, "durable", 0.8, None, ["b", "c"], ["yes"]), (2, 1, "ephemeral", 0.4, None, [], []), (2, 2, "ephemeral", 0.6, 9, ["ephemeral_chunk_found"], ["soon"]), (2, 3, "drop", 0.9, 99, ["x"], []), (3, 1, "drop", 0.2, None, [f"s{i:02}" for i in range(30)], ["noise"])]
    chunks = spark.createDataFrame(rows, "id long, chunk int, retention string, score double, ttl_days int, signals array<string>, reasons array<string>").withColumn("chars", F.lit(900))
    got = {r.id: r for r in I.triage(chunks, "id", "chars").collect()}
    assert (got[1].retention, got[1].score, got[1].ttl_days, got[1].signals) == ("durable", 0.8, None, ["triage_chunked", "durable_chunk_found", "a", "b", "c"])
    assert got[1].reasons[:3] == ["Large interaction (900 chars) was triaged in 9 connected chunks.", "1 chunk(s) contained durable organizational memory, so the full source is eligible for extraction.", "Chunk 1 drop: no"] and len(got[1].reasons) == 10
    assert (got[2].retention, got[2].score, got[2].ttl_days, got[2].signals) == ("ephemeral", 0.6, 14, ["triage_chunked", "ephemeral_chunk_found", "x"])
    assert got[2].reasons[1:] == ["2 chunk(s) contained short-lived context, but no chunk justified durable memory.", "Chunk 2 ephemeral: soon"]
    assert (got[3].retention, got[3].score, len(got[3].signals), got[3].signals[1]) == ("drop", 0.2, 20, "all_chunks_drop")
    held = I.triaged(chunks.select("id", "chunk")).first()
    assert (held.retention, held.score, held.ttl_days, held.signals) == ("ephemeral", 0.0, 14, ["llm_required"]) and I.triaged(chunks, enabled=False).first().score == 1.0


def test_answers_cite_quotes_and_average_confidence(spark):
    rows = spark.createDataFrame([(0, 0, "memory", "m", 0.5, "said m", 0.9, "quote m"), (1, 0, "fact", "f", 0.6, "said f", 0.7, None), (1, 1, "episode", "e", 0.5, "said e", None, None), (1, 2, "entity", "n", 9.0, "x", None, None), (2, 0, "fact", "f", 9.0, "again", 0.1, "q")], "list_no int, pos int, type string, id string, score double, content string, confidence double, quote string")
    top = R.evidence(rows)
    assert [(r.id, r.score) for r in top.collect()] == [("n", 9.0), ("e", 0.5), ("m", 0.5), ("f", 0.6)]
    one = R.extractive_answer(R.citations(top)).first()
    assert (one.answer, one.confidence) == ("said e [C1] quote m [C2] said f [C3]", 0.7)


def test_file_source(spark, tmp_path):
    for name, text in {"notes.md": "hello", "readme.txt": "x", "empty.md": " ", "data.json": "{}", "subdir/deep.md": "deep", ".hidden/secret.md": "s", "node_modules/a.md": "n"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    assert {r.source_id for r in text_files(spark, str(tmp_path)).collect()} == {"file://notes.md", "file://readme.txt", "file://subdir/deep.md"}


def pages(url, params):
    at = int(params.get("cursor", 0)) or (params.get("page", 1) - 1) or params.get("offset", 0) // 2
    rows = [{"id": i, "text": f"t{i}"} for i in range(5)][2 * at : 2 * at + 2]
    return json.dumps({"data": rows, "next_cursor": str(at + 1) if 2 * at + 2 < 5 else None})


@pytest.mark.parametrize("kind", ["cursor", "page", "offset"])
def test_rest_pages(kind):
    d = Definition("r", "R", "http://x", "rest", "data", kind, limit=2)
    assert [r["id"] for r in records(d, pages)] == [0, 1, 2, 3, 4]


def test_rest_source(spark):
    def fetch(url, params):
        import json as j

        return j.dumps([{"id": 1, "text": "a"}, {"text": "b"}])

    rows = to_episodes(read_rest(spark, [Definition("r", "R", "http://x", "rest"), Definition("s", "S", "http://y", "rest")], fetch))
    assert sorted(r.content for r in rows.collect()) == ["a", "a", "b", "b"]
    with pytest.raises(ValueError, match="pagination"):
        Definition("r", "R", "u", "t", pagination="odd").check()


def test_webhooks(spark):
    source = WebhookSource("w", "hook", secret="s3", allowed_events=("created",), content_template="{{m}}")
    body = '{"m": "hi", "id": 7}'
    rows = [(body, local_signature(body, source), "created"), (body, "sha256=bad", "created"), (body, local_signature(body, source), "deleted"), (body, local_signature(body, source), None)]
    out = receive(spark.createDataFrame(rows, "body string, signature string, event string"), source).collect()
    assert [(r.source_id, r.content) for r in out] == [("7", "hi")] * 2 and source.shown()["secret"] == "***"
