"""Registered queries: fusion and answers, ingest, memory, skills, evals, sources and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import bridge
from ..bridge import sees, with_model
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import ingest as I
from ..operators import memory as M
from ..schema import relation_types
from ..sources import rest, sync
from ..storage import table
from ..streaming import flows, keyed
from . import coverage as V
from . import retrieval as R
from .search_queries import probe, rank_sql, terms_sql, trigrams_sql
from .temporal_queries import EPHEMERAL_SQL, SECURITY, model

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ fusion and answers

LISTS_SQL = """
WITH busy AS (SELECT 'supplier:' || l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1),
ranked AS (
  SELECT 0 AS list_no, 'supplier:' || s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, 'supplier:' || s_suppkey) - 1 AS pos FROM supplier
  UNION ALL SELECT 1, id, row_number() OVER (ORDER BY n DESC, id) - 1 FROM busy)"""


def ranked_lists(spark, sf_dir):
    text = lambda c: F.concat(F.lit("supplier:"), F.col(c).cast("string")).alias("id")
    rich = table(spark, sf_dir, "supplier").select(text("s_suppkey"), F.col("s_acctbal").alias("score"))
    busy = table(spark, sf_dir, "lineitem").groupBy(text("l_suppkey")).agg(F.count("*").cast("double").alias("score"))
    return [R.as_long_list(R.block(x, "entity", F.col("score"), F.col("score"), F.col("id"), None)) for x in (rich, busy)]


@query(LISTS_SQL + ", r AS (SELECT id, sum(1.0::DOUBLE / (60 + pos)) AS raw FROM ranked GROUP BY id) SELECT 'entity' AS type, id, round(raw / greatest((SELECT max(raw) FROM r), 0.001), 7) AS score FROM r")
def rrf_fusion(spark, sf_dir):
    return R.fuse(ranked_lists(spark, sf_dir)).select("type", "id", F.round("score", 7).alias("score"))


ASKED = "worthless priority"
HYBRID_SQL = f"""
, f AS (SELECT *, {terms_sql("fact_text")} AS a FROM facts WHERE valid_at <= TIMESTAMP '1998-01-01' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1998-01-01') AND {sees("acl", "security")}),
fr AS (SELECT id, fact_text, valid_at, invalid_at, greatest(CASE WHEN list_contains(a, 'worthless') AND list_contains(a, 'priority') THEN {rank_sql("a", ["worthless", "priority"])} ELSE 0 END, 0.65 * CASE WHEN list_contains(a, 'worthless') OR list_contains(a, 'priority') THEN {rank_sql("a", ["worthless", "priority"])} ELSE 0 END) AS rank FROM f),
d AS (SELECT *, {terms_sql("content")} AS a FROM episodes WHERE {sees("acl", "security")}),
dr AS (SELECT id, content, valid_at, greatest(CASE WHEN list_contains(a, 'worthless') AND list_contains(a, 'priority') THEN {rank_sql("a", ["worthless", "priority"])} ELSE 0 END, 0.65 * CASE WHEN list_contains(a, 'worthless') OR list_contains(a, 'priority') THEN {rank_sql("a", ["worthless", "priority"])} ELSE 0 END) AS rank FROM d),
sim AS (SELECT id, valid_at, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM d WHERE embedding IS NOT NULL),
kf AS (SELECT 'fact' AS type, id, row_number() OVER (ORDER BY rank DESC, id) - 1 AS pos, valid_at, invalid_at FROM (SELECT * FROM fr WHERE rank > 0 ORDER BY rank DESC, id LIMIT 40)),
kd AS (SELECT 'episode' AS type, id, (SELECT count(*) FROM kf) + row_number() OVER (ORDER BY rank DESC, id) - 1 AS pos, valid_at, CAST(NULL AS TIMESTAMP) AS invalid_at FROM (SELECT * FROM dr WHERE rank > 0 ORDER BY rank DESC, id LIMIT 5)),
sd AS (SELECT 'episode' AS type, id, row_number() OVER (ORDER BY s DESC, id) - 1 AS pos, valid_at, CAST(NULL AS TIMESTAMP) AS invalid_at FROM (SELECT * FROM sim ORDER BY s DESC, id LIMIT 8) WHERE s > 0.28),
t AS (SELECT 'fact' AS type, f.id, row_number() OVER (ORDER BY f.valid_at DESC, f.id) - 1 AS pos, f.valid_at, f.invalid_at FROM (SELECT f.* FROM f JOIN entities s ON s.id = f.source JOIN entities e ON e.id = f.target WHERE {sees("s.acl", "security")} AND {sees("e.acl", "security")} ORDER BY f.valid_at DESC, f.id LIMIT 40) f),
u AS (SELECT type, id, sum(1.0::DOUBLE / (60 + pos)) AS raw, min(valid_at) AS valid_at, min(invalid_at) AS invalid_at FROM (SELECT * FROM kf UNION ALL SELECT * FROM kd UNION ALL SELECT * FROM sd UNION ALL SELECT * FROM t) GROUP BY type, id),
z AS (SELECT *, raw / (SELECT max(raw) FROM u) AS base, greatest(0, date_diff('day', valid_at, TIMESTAMP '1998-06-01')) AS age FROM u WHERE valid_at <= TIMESTAMP '1998-01-01' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '1998-01-01'))
SELECT type, id, round(base * (1 + 0.1 * greatest(0, 1 - ln(age + 1) / ln(365))), 6) AS score FROM z ORDER BY base * (1 + 0.1 * greatest(0, 1 - ln(age + 1) / ln(365))) DESC, type, id LIMIT 20"""


@query(with_model(HYBRID_SQL, "entities", "facts", "episodes"))
def hybrid_search(spark, sf_dir):
    """Flagship: keyword, vector and temporal lists at a point in time, fused, filtered and boosted."""
    e, f = model(spark, sf_dir)
    corpus = R.Corpus(e, f, bridge.episodes(spark, sf_dir))
    asked = R.Request(ASKED, probe(spark, sf_dir), now="1998-06-01", as_of="1998-01-01", access=SECURITY, limit=20, methods=("keyword", "semantic", "temporal"))
    return R.search(corpus, asked).select("type", "id", F.round("score", 6).alias("score"))


@query()
def graph_hybrid_search(spark, sf_dir):
    """All five methods over the current graph (rows only: five operators that have SQL twins of their own)."""
    e, f = model(spark, sf_dir)
    seeds = spark.createDataFrame([("supplier:3",), ("nation:3",)], "id string")
    asked = R.Request("supplier 3 priority", probe(spark, sf_dir), now="2001-08-01", access=SECURITY, limit=20, methods=tuple(R.METHODS), seeds=seeds)
    return R.search(R.Corpus(e, f, bridge.episodes(spark, sf_dir)), asked).select("type", "id", F.round("score", 6).alias("score"))


@query("SELECT o_orderkey, round(o_totalprice * (1 + 0.1 * greatest(0, 1 - ln(greatest(0, date_diff('day', o_orderdate, TIMESTAMP '2001-08-02')) + 1) / ln(365))), 3) AS score FROM orders")
def recency_boost(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(R.recency(F.col("o_totalprice"), F.col("o_orderdate"), "2001-08-02"), 3).alias("score"))


EVIDENCE_SQL = """
WITH e AS (
  SELECT 'memory' AS type, 'm' || doc_id AS id, text AS content, CAST(quality AS DOUBLE) * 0.5 + (doc_id % 97) / 1000.0 AS base, 0.2 AS boost FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT 'episode', 'e' || doc_id, text, (doc_id % 89) / 100.0, 0.28 FROM documents
  UNION ALL SELECT 'entity', 'p' || p_partkey, p_name, (p_partkey % 83) / 80.0, 0.0 FROM part)
"""


def evidence_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    lab = table(spark, sf_dir, "labels").join(docs, "doc_id")
    row = lambda df, n, kind, p, key, content, score: df.select(F.lit(n).alias("list_no"), F.col(key).alias("pos"), F.lit(kind).alias("type"), F.concat(F.lit(p), F.col(key).cast("string")).alias("id"), content.alias("content"), score.alias("score"))
    out = row(lab, 0, "memory", "m", "doc_id", F.col("text"), F.col("quality") * 0.5 + (k % 97) / 1000)
    out = out.unionByName(row(docs, 1, "episode", "e", "doc_id", F.col("text"), (k % 89) / 100))
    out = out.unionByName(row(table(spark, sf_dir, "part"), 2, "entity", "p", "p_partkey", F.col("p_name"), (F.col("p_partkey") % 83) / 80))
    return out.unionByName(out.withColumn("list_no", F.lit(5)).withColumn("score", F.lit(9.0)))


@query(EVIDENCE_SQL + "SELECT type, id, round(base, 6) AS score FROM e ORDER BY round(base, 6) + boost DESC, type, id LIMIT 12")
def answer_evidence(spark, sf_dir):
    rows = evidence_rows(spark, sf_dir).withColumn("score", F.round("score", 6))
    return R.evidence(rows).select("type", "id", F.round("score", 6).alias("score"))


@query(EVIDENCE_SQL + ", c AS (SELECT content, base, type, row_number() OVER (ORDER BY round(base, 6) + boost DESC, type, id) AS n FROM (SELECT * FROM e ORDER BY round(base, 6) + boost DESC, type, id LIMIT 12) WHERE type <> 'entity') SELECT string_agg(CASE WHEN type = 'memory' THEN content[1:80] ELSE content END || ' [C' || n || ']', ' ' ORDER BY n) AS answer, round(avg(CASE WHEN type = 'memory' THEN 0.9 ELSE round(base, 6) END), 3) AS confidence FROM c WHERE n <= 5")
def extractive_answer(spark, sf_dir):
    """Memory objects bring their confidence and a quote, episodes their score and content."""
    rows = evidence_rows(spark, sf_dir).filter("list_no < 5").withColumn("score", F.round("score", 6))
    own = F.col("type") == "memory"
    rows = rows.withColumns({"confidence": F.when(own, 0.9), "quote": F.when(own, F.substring("content", 1, 80))})
    return R.extractive_answer(R.citations(R.evidence(rows)))


@query(
    with_model(
        f""", c AS (SELECT *, 'doc:' || (doc_id - doc_id % 5) AS episode_id, quality * 0.5 + (doc_id % 10) / 20.0 AS s FROM labels),
d AS (SELECT e.id, e.content, c.doc_id, c.s, CASE WHEN c.doc_id % 2 = 0 THEN substring(e.content, 1 + c.doc_id % 7 * 300, 40) ELSE 'nowhere at all' END AS snippet
  FROM episodes e JOIN c ON c.episode_id = e.id WHERE {sees('e.acl', 'security')}),
p AS (SELECT *, CASE WHEN trim(snippet) <> '' THEN position(lower(snippet) IN lower(content)) ELSE 0 END AS place FROM d),
w AS (SELECT id, s, doc_id, trim(substring(content, greatest(place - 1200, 1), place + length(snippet) + 1200 - greatest(place - 1200, 1))) AS win FROM p WHERE place > 0),
u AS (SELECT id, win, row_number() OVER (PARTITION BY id ORDER BY min(-s), min(CAST(doc_id AS VARCHAR))) AS i FROM w GROUP BY id, win),
x AS (SELECT id, string_agg('Source context window ' || i || ':' || chr(10) || win, chr(10) || chr(10) ORDER BY i) AS shown FROM u GROUP BY id)
SELECT d.id, round(max(d.s) + 0.35, 6) AS score, md5(coalesce(any_value(x.shown), left(any_value(d.content), 2400))) AS context FROM d LEFT JOIN x ON x.id = d.id GROUP BY d.id""",
        "episodes",
    )
)
def source_context(spark, sf_dir):
    """Hits whose contents are cut out of their source, or not found there: the windows around them, or the beginning."""
    k = F.col("doc_id")
    lab = table(spark, sf_dir, "labels")
    source = table(spark, sf_dir, "documents").select(k.alias("source"), "text")
    hits = lab.join(source, k - k % 5 == F.col("source"))
    snippet = F.when(k % 2 == 0, F.substring("text", (1 + k % 7 * 300).cast("int"), F.lit(40))).otherwise("nowhere at all")
    hits = hits.select(k.cast("string").alias("id"), (F.col("quality") * 0.5 + (k % 10) / 20).alias("score"), snippet.alias("content"))
    children = lab.select(k.cast("string").alias("id"), F.concat(F.lit("doc:"), (k - k % 5).cast("string")).alias("episode_id"))
    return R.expand_sources(hits, children, bridge.episodes(spark, sf_dir), SECURITY).select("id", F.round("score", 6).alias("score"), F.md5("content").alias("context"))


# ------------------------------------------------------------------ ingest


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content, count(*) AS turns FROM conversations GROUP BY conv_id")
def normalize_transcript(spark, sf_dir):
    return I.transcript(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT md5(text) AS source_id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_episodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("source_type"), F.md5("text").alias("source_id"), "doc_id")
    return I.deduplicated(d, "doc_id").select("source_id", "doc_id")


EXTRACTED_SQL = "extracted AS (SELECT DISTINCT 'customer' AS entity_type, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1 THEN c_name || ' inc' ELSE 'unknown ' || c_mktsegment END AS name FROM customer WHERE c_custkey < 100000000)"


@query(
    f"""WITH {EXTRACTED_SQL}, known AS (SELECT 'customer:' || c_custkey AS id, c_name, {trigrams_sql("c_name")} AS h FROM customer),
x AS (SELECT e.name, {trigrams_sql("e.name")} AS g, (SELECT min(id) FROM known k WHERE lower(k.c_name) = lower(e.name)) AS exact FROM extracted e),
p AS (SELECT x.name, k.id, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS s FROM x JOIN known k ON x.exact IS NULL),
b AS (SELECT name, id, s FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s DESC, id) AS n FROM p WHERE s > 0.3) WHERE n = 1)
SELECT x.name, CASE WHEN exact IS NOT NULL OR s >= 0.9 THEN 'merge' WHEN s >= 0.75 THEN 'ambiguous' ELSE 'new' END AS decision, CASE WHEN exact IS NOT NULL THEN exact WHEN s >= 0.75 THEN id END AS entity_id,
round(CASE WHEN exact IS NOT NULL THEN 0.95 ELSE coalesce(s, 0) END, 6) AS score FROM x LEFT JOIN b ON b.name = x.name"""
)
def resolve_entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.upper("c_name")).when(k % 3 == 1, F.concat("c_name", F.lit(" inc"))).otherwise(F.concat(F.lit("unknown "), "c_mktsegment"))
    extracted = c.select(F.lit("customer").alias("entity_type"), name.alias("name"))
    return I.resolve_entities(extracted, bridge.entities(spark, sf_dir), bridge.aliases(spark, sf_dir)).select("name", "decision", "entity_id", F.round("score", 6).alias("score"))


NEW_FACTS_SQL = """, new AS (
  SELECT 'n' || o_orderkey AS id, 'customer:' || o_custkey AS source, 'has_priority' AS relation, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'priority:' || o_orderpriority END AS target FROM orders
  UNION ALL SELECT 's' || p_partkey, 'supplier:' || (p_partkey % 100 + 1), 'supplies', 'part:' || p_partkey FROM part),
cur AS (SELECT relation, CASE WHEN relation = 'supplies' THEN source || '|' || target ELSE source END AS key, count(*) AS n, list(lower(fact_text)) AS texts FROM (SELECT * FROM facts WHERE invalid_at IS NULL QUALIFY row_number() OVER (PARTITION BY relation, CASE WHEN relation = 'supplies' THEN source || '|' || target ELSE source END ORDER BY valid_at DESC, id) <= 10) GROUP BY ALL),
r AS (SELECT new.*, n, texts, new.source || ' ' || new.relation || ' ' || new.target AS fact_text FROM new LEFT JOIN cur ON cur.relation = new.relation AND cur.key = CASE WHEN new.relation = 'supplies' THEN new.source || '|' || coalesce(new.target, '') ELSE new.source END),
a AS (SELECT id, n, CASE WHEN source IS NULL OR target IS NULL THEN 'skip' WHEN n IS NULL THEN 'create' WHEN list_contains(texts, lower(fact_text)) THEN 'skip' WHEN relation = 'supplies' THEN 'create' ELSE 'invalidate_existing' END AS action FROM r)
SELECT id, action, CASE WHEN action = 'invalidate_existing' THEN n ELSE 0 END AS n_invalidated FROM a"""


def new_facts(spark, sf_dir):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    new = o.select(text("n", F.col("o_orderkey")).alias("id"), text("customer:", F.col("o_custkey")).alias("source"), F.lit("has_priority").alias("relation"), F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("priority:"), "o_orderpriority")).alias("target"))
    new = new.unionByName(p.select(text("s", F.col("p_partkey")).alias("id"), text("supplier:", F.col("p_partkey") % 100 + 1).alias("source"), F.lit("supplies").alias("relation"), text("part:", F.col("p_partkey")).alias("target")))
    new = new.withColumn("fact_text", F.concat_ws(" ", "source", "relation", "target"))
    return new


@query(with_model(NEW_FACTS_SQL, "facts"))
def resolve_facts(spark, sf_dir):
    return I.resolve_facts(new_facts(spark, sf_dir), bridge.facts(spark, sf_dir), relation_types(spark))


@query(
    with_model(f""", one AS (SELECT source, lower(trim(fact_text)) AS k, min(valid_at) AS seen_at, arg_min(id, (valid_at, id)) AS n, arg_min(fact_text, (valid_at, id)) AS line FROM facts WHERE {sees("acl", None)} GROUP BY ALL),
s AS (SELECT *, sum(length(line) + 1) OVER w AS size, row_number() OVER w AS place FROM one WINDOW w AS (PARTITION BY source ORDER BY seen_at DESC, n DESC ROWS UNBOUNDED PRECEDING))
SELECT source AS id, count(*) AS lines, string_agg(line, chr(10) ORDER BY seen_at, n) AS summary FROM s WHERE size <= 101 OR place = 1 GROUP BY source""", "facts")
)
def entity_summary_lines(spark, sf_dir):
    return I.summary_lines(bridge.facts(spark, sf_dir), 100)


@query("""
WITH c AS (SELECT conv_id, turn, length(text) AS n, length(text) % 100 / 100.0 AS score, CASE WHEN length(text) % 7 > 0 THEN length(text) % 30 END AS ttl, role, CASE WHEN length(text) % 5 = 0 THEN 'durable' WHEN length(text) % 3 = 0 THEN 'ephemeral' ELSE 'drop' END AS r FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chunk FROM c),
d AS (SELECT conv_id, count(*) AS chunks, count(*) FILTER (WHERE r = 'durable') AS nd, count(*) FILTER (WHERE r = 'ephemeral') AS ne, sum(n) AS chars, max(score) AS top, max(score) FILTER (WHERE r = 'durable') AS sd, max(score) FILTER (WHERE r = 'ephemeral') AS se, max(coalesce(ttl, 14)) FILTER (WHERE r = 'ephemeral') AS days FROM k GROUP BY conv_id),
x AS (SELECT conv_id, role AS signal, min(chunk) AS since FROM k GROUP BY ALL),
y AS (SELECT conv_id, array_agg(signal ORDER BY since, signal) AS own FROM x GROUP BY conv_id),
z AS (SELECT conv_id, 'Chunk ' || chunk || ' ' || r || ': ' || why AS line, row_number() OVER (PARTITION BY conv_id ORDER BY chunk, i) AS place FROM (SELECT conv_id, chunk, r, unnest(['n=' || n, role]) AS why, generate_subscripts(['n', 'r'], 1) AS i FROM k)),
w AS (SELECT conv_id, array_agg(line ORDER BY place) AS lines FROM z WHERE place <= 8 GROUP BY conv_id),
v AS (SELECT *, CASE WHEN nd > 0 THEN 'durable' WHEN ne > 0 THEN 'ephemeral' ELSE 'drop' END AS retention FROM d)
SELECT conv_id, retention, round(coalesce(sd, se, top), 3) AS score, CASE WHEN retention = 'ephemeral' THEN days END AS ttl_days,
array_to_string(list_slice(['triage_chunked', CASE retention WHEN 'durable' THEN 'durable_chunk_found' WHEN 'ephemeral' THEN 'ephemeral_chunk_found' ELSE 'all_chunks_drop' END] || own, 1, 20), ',') AS signals,
array_to_string(['Large interaction (' || chars || ' chars) was triaged in ' || chunks || ' connected chunks.', CASE retention WHEN 'durable' THEN nd || ' chunk(s) contained durable organizational memory, so the full source is eligible for extraction.' WHEN 'ephemeral' THEN ne || ' chunk(s) contained short-lived context, but no chunk justified durable memory.' ELSE 'All chunks were classified as low-value noise.' END] || lines, '|') AS reasons
FROM v JOIN y USING (conv_id) JOIN w USING (conv_id)""")
def triage_chunks(spark, sf_dir):
    """Turns as a conversation's chunks, each with a verdict made up from its length."""
    n = F.length("text")
    kind = F.when(n % 5 == 0, "durable").when(n % 3 == 0, "ephemeral").otherwise("drop")
    turns = table(spark, sf_dir, "conversations")
    own = Window.partitionBy("conv_id")
    rows = turns.select("conv_id", F.row_number().over(own.orderBy("turn")).alias("chunk"), (n % 100 / 100).alias("score"), F.when(n % 7 > 0, n % 30).cast("long").alias("ttl_days"), kind.alias("retention"), F.array("role").alias("signals"), F.array(F.concat(F.lit("n="), n.cast("string")), "role", F.lit("unsaid")).alias("reasons"), F.sum(n).over(own).alias("chars"))
    out = I.triage(rows, "conv_id", "chars")
    return out.select("conv_id", "retention", F.round("score", 3).alias("score"), "ttl_days", F.array_join("signals", ",").alias("signals"), F.array_join("reasons", "|").alias("reasons"))


@query(f"SELECT doc_id, round(CASE WHEN len(w) < 50 AND n >= 1 THEN 0.9 WHEN len(w) > 200 AND n < 2 THEN 0.3 ELSE least(0.95, n / greatest(len(w) / 100, 1) * 0.3 + 0.7 * 0.7) END, 6) AS confidence FROM (SELECT doc_id, string_split_regex(trim(text), '\\s+') AS w, len(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b')) AS n FROM documents)")
def extraction_confidence(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).alias("w"), F.size(X.emails(F.col("text"))).alias("n"))
    return d.select("doc_id", F.round(X.extraction_confidence(F.col("w"), F.col("n"), F.lit(0.7)), 6).alias("confidence"))


# ------------------------------------------------------------------ memory, skills, evals


@query(with_model(f" SELECT id, kind, status, owner, valid_at FROM memory WHERE {sees('acl', 'security')} AND kind IN ('risk', 'decision') AND status = 'decided'", "memory"))
def memory_list(spark, sf_dir):
    rows = M.memory_list(bridge.memory(spark, sf_dir), SECURITY, ["risk", "decision"], ["decided"], limit=None)
    return rows.select("id", "kind", "status", "owner", "valid_at")


@query(with_model(f", t AS (SELECT id, kind, status, {terms_sql(chr(111) + 'wner || ' + repr(' ') + ' || subject || ' + repr(' ') + ' || summary')} AS a FROM memory WHERE {sees('acl', 'security')}) SELECT id, kind, status, round({rank_sql('a', ['worthless', 'src3'])}, 6) AS score FROM t WHERE list_contains(a, 'worthless') AND list_contains(a, 'src3')", "memory"))
def memory_search(spark, sf_dir):
    return M.memory_search(bridge.memory(spark, sf_dir), "worthless src3", SECURITY, limit=None).withColumn("score", F.round("score", 6))


@query(
    with_model(
        f""", m AS (SELECT memory.*, embedding, {terms_sql(chr(111) + 'wner || ' + repr(' ') + ' || subject || ' + repr(' ') + ' || summary')} AS a FROM memory LEFT JOIN embeddings ON 'mem:' || vec_id = id WHERE {sees('acl', 'security')}),
n AS (SELECT id, kind, status, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM m WHERE embedding IS NOT NULL ORDER BY score DESC, id LIMIT 20),
b AS (SELECT id, kind, status, {rank_sql('a', ['worthless', 'src3'])} AS score FROM m WHERE list_contains(a, 'worthless') AND list_contains(a, 'src3') UNION ALL SELECT * FROM n)
SELECT id, kind, status, round(max(score), 5) AS score FROM b GROUP BY ALL ORDER BY max(score) DESC, id LIMIT 20""",
        "memory",
    )
)
def memory_search_vector(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("mem:"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    rows = bridge.memory(spark, sf_dir).join(vectors, "id", "left")
    return M.memory_search(rows, "worthless src3", SECURITY, limit=20, vector=probe(spark, sf_dir)).withColumn("score", F.round("score", 5))


@query("""
WITH p AS (SELECT doc_id % 50 AS episode_id, doc_id AS n, CASE doc_id % 3 WHEN 0 THEN 'decision' WHEN 1 THEN 'risk' ELSE 'gossip' END AS kind, text AS summary, CASE doc_id % 4 WHEN 0 THEN 'decided' WHEN 1 THEN 'active' WHEN 2 THEN 'done' END AS status, CASE WHEN doc_id % 5 > 0 THEN doc_id % 13 / 10.0 END AS sure FROM documents),
k AS (SELECT *, left(trim(regexp_replace(lower(summary), '[^a-z0-9]+', ' ', 'g')), 240) AS key FROM p WHERE kind <> 'gossip'),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY episode_id, kind, key ORDER BY n) = 1)
SELECT episode_id, n, kind, CASE WHEN status IN ('decided', 'done') THEN status ELSE 'observed' END AS status, CAST(greatest(0, least(1, coalesce(sure, 0.7))) AS DOUBLE) AS confidence FROM f QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY n) <= 32""")
def memory_derive(spark, sf_dir):
    """Objects proposed for an episode; here documents, 50 episodes' worth of them."""
    k = F.col("doc_id")
    status = F.when(k % 4 == 0, "decided").when(k % 4 == 1, "active").when(k % 4 == 2, "done")
    kind = F.when(k % 3 == 0, "decision").when(k % 3 == 1, "risk").otherwise("gossip")
    rows = table(spark, sf_dir, "documents").select((k % 50).alias("episode_id"), k.alias("n"), kind.alias("kind"), F.col("text").alias("summary"), status.alias("status"), F.when(k % 5 > 0, k % 13 / 10).alias("confidence"))
    return M.derive(rows, ("decision", "risk")).select("episode_id", "n", "kind", "status", "confidence")


SKILLS = [("lookup", 10, ["this is", "the of"]), ("timeline", 5, ["was by", "from that", "hea"]), ("review", 1, ["worthless", "And the to in", "thanedble anea erin"])]


def _skill_sql() -> str:
    rows = ", ".join(f"('{s}', {p}, '{t.lower()}')" for s, p, ts in SKILLS for t in ts)
    return f"""WITH s(skill, priority, g) AS (VALUES {rows}), i AS (SELECT item_id AS id, lower(trim(text)) AS t FROM benchmark),
m AS (SELECT id, skill, priority, CASE WHEN t = g THEN 1.0 WHEN contains(t, g) THEN least(0.95, 0.8 + 0.2 * length(g) / length(t))
  ELSE CAST(len(list_filter(string_split(g, ' '), lambda w: len(list_filter(string_split_regex(t, '\\s+'), lambda v: contains(v, w) OR contains(w, v))) > 0)) AS DOUBLE) / len(string_split(g, ' ')) * CAST(0.7 AS DOUBLE) END AS c FROM i, s)
SELECT id, skill, round(c, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, priority DESC, skill) AS n FROM m WHERE c >= 0.3) WHERE n = 1"""


@query(_skill_sql())
def skill_resolve(spark, sf_dir):
    skills = spark.createDataFrame(SKILLS, "skill string, priority int, triggers array<string>")
    return M.resolve_skills(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), skills)


@query("""SELECT source AS suite, count(*) AS queries, round(avg(score), 6) AS score, round(avg(CASE WHEN score >= 0.8 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM (
SELECT source, ((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END) + 1 - (CASE WHEN contains(lower(text), 'worthless') THEN 1 ELSE 0 END)) / 3 AS score FROM documents) GROUP BY source""")
def eval_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("suite"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array(F.lit("the"), F.lit("tion")).alias("must_include"), F.array(F.lit("worthless")).alias("must_not_include"))
    return M.eval_scores(rows)


@query("SELECT CASE WHEN quality = 1 THEN 'durable' ELSE 'drop' END AS expected, count(*) AS cases, count(*) FILTER (WHERE (quality = 1) = (length(text) > 200)) AS right, round(avg(CASE WHEN (quality = 1) = (length(text) > 200) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def triage_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return M.triage_accuracy(rows.select(F.when(F.col("quality") == 1, "durable").otherwise("drop").alias("expected"), F.when(F.length("text") > 200, "durable").otherwise("drop").alias("actual")))


@query("SELECT * FROM (SELECT 'extraction' AS kind, event_type AS subject, count(*) AS n, CAST(least(0.9, 0.5 + count(*) / 20) AS DOUBLE) AS confidence FROM events GROUP BY event_type) UNION ALL SELECT 'review', lang || ':' || source, count(*), CAST(least(0.85, 0.45 + count(*) / 20) AS DOUBLE) FROM documents GROUP BY lang, source UNION ALL SELECT 'policy', lang, count(*), CAST(least(0.85, 0.45 + count(*) / 25) AS DOUBLE) FROM documents GROUP BY lang")
def improvement_proposals(spark, sf_dir):
    extracted = table(spark, sf_dir, "events").select(F.col("event_type").alias("entity_type"), F.col("user_id").cast("string").alias("name"))
    reviews = table(spark, sf_dir, "documents").select(F.col("lang").alias("type"), F.col("source").alias("reason"))
    return A.improvement_proposals(extracted, reviews)


@query("SELECT event_type AS entity_type, count(*) AS n, array_to_string(list_slice(list_sort(list(DISTINCT CAST(user_id AS VARCHAR))), 1, 5), '|') AS examples FROM events GROUP BY event_type HAVING count(*) >= 3")
def suggest_types(spark, sf_dir):
    return A.suggest_types(table(spark, sf_dir, "events").select(F.col("event_type").alias("entity_type"), F.col("user_id").cast("string").alias("name")))


# ------------------------------------------------------------------ sources and streams


@query("SELECT event_id, 'user ' || user_id || ' did ' || event_type || ' k=' || coalesce(json_extract_string(props, '$.k'), '') AS content FROM events")
def template_render(spark, sf_dir):
    payload = F.to_json(F.struct("user_id", "event_type", F.from_json("props", "k int").alias("props")))
    rows = table(spark, sf_dir, "events").withColumn("payload", payload)
    return rows.select("event_id", X.render("user {{user_id}} did {{event_type}} k={{props.k}}", F.col("payload")).alias("content"))


@query("SELECT CAST(page_id AS VARCHAR) AS source_id, url || chr(10) || html AS content FROM pages")
def pages_to_episodes(spark, sf_dir):
    payload = F.to_json(F.struct(F.col("page_id").alias("id"), F.col("url").alias("title"), F.col("html").alias("body")))
    return rest.to_episodes(table(spark, sf_dir, "pages").select(payload.alias("payload")))[["source_id", "content"]]


@query("SELECT event_id, event_type AS connector FROM events WHERE event_type = 'click' OR ts > TIMESTAMP '2024-01-15'")
def incremental_since(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("connector"), F.col("ts").alias("valid_at"))
    others = rows.select("connector").distinct().filter("connector <> 'click'").select("connector", F.lit("2024-01-15").cast("timestamp_ntz").alias("last_sync_at"))
    return sync.new_rows(rows, others).select("event_id", "connector")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark, sf_dir):
    twice = flows.in_time_order(table(spark, sf_dir, "events"))
    twice = twice.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return flows.run(flows.deduplicated(twice, ["event_id"]).select("event_id", "user_id"), "dedup")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_events(spark, sf_dir):
    return flows.run(flows.tumbling(flows.in_time_order(table(spark, sf_dir, "events"))), "tumbling", ["start", "event_type"])


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, g""")
def session_events(spark, sf_dir):
    """All sessions of a finite replay, open ones too; closed_sessions is the endless form."""
    return flows.run(flows.sessions(flows.in_time_order(table(spark, sf_dir, "events"))), "sessions", complete=True)


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, g HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def closed_sessions(spark, sf_dir):
    """Sessions that the watermark has passed, each written once; their state is dropped."""
    return flows.run(flows.sessions(flows.in_time_order(table(spark, sf_dir, "events"))), "sessions")


@query("SELECT user_id, event_id, event_type, ts AS valid_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS invalid_at FROM events QUALIFY invalid_at IS NOT NULL")
def stream_supersede(spark, sf_dir):
    return flows.run(flows.superseding(flows.in_time_order(table(spark, sf_dir, "events"))), "supersede")


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS id, ts AS valid_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS invalid_at FROM events")
def stream_late_facts(spark, sf_dir):
    """Intervals from events that come in no order, in four batches: late ones split what was written before."""
    events = table(spark, sf_dir, "events")
    mixed = flows.pieces_of(events, F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int"), 4)
    return flows.settled(keyed.intervals(mixed, "user_id", "ts", "event_id"), "intervals", ["key", "id"])


@query("WITH" + EPHEMERAL_SQL + " SELECT id, valid_at + to_days(14) AS expired_at FROM eph WHERE valid_at < TIMESTAMP '2024-03-01' - to_days(14) AND id NOT IN (SELECT 'doc:' || event_id FROM events WHERE user_id % 3 = 0) AND id NOT IN (SELECT 'doc:' || doc_id FROM labels)")
def stream_expiries(spark, sf_dir):
    """ephemeral_ttl as a stream: what episodes rest on comes first, then the episodes, then a row that tells the time."""
    k, none = F.col("doc_id"), F.lit(None)
    doc = lambda c: F.concat(F.lit("doc:"), c.cast("string")).alias("id")
    day = lambda c: (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(c.cast("int"))).alias("ts")
    row = lambda df, i, ts, retention, rests, piece: df.select(doc(i), ts, retention.cast("string").alias("retention"), none.cast("int").alias("ttl_days"), F.lit(rests).alias("rests"), F.lit(piece).alias("piece"))
    used = table(spark, sf_dir, "events").filter("user_id % 3 = 0").select("event_id").unionByName(table(spark, sf_dir, "labels").select(k.alias("event_id")))
    rows = row(used, F.col("event_id"), day(F.lit(0)), none, True, 0)
    rows = rows.unionByName(row(table(spark, sf_dir, "documents"), k, day(F.pmod(k, F.lit(90))), F.when(k % 2 == 0, "ephemeral").otherwise("durable"), False, 1).filter("ts < timestamp '2024-03-01'"))
    rows = rows.unionByName(row(spark.range(1), F.lit("clock"), F.lit("2024-03-01").cast("timestamp").alias("ts"), none, False, 2))
    return flows.run(keyed.expiries(flows.pieces_of(rows, F.col("piece"), 3)), "expiries")


#: Questions of which each source has one, by its number.
QUESTIONS = ["What is the status of Thanedble Anea?", "Why did Attion Thanedble Erin flag it, and when?", "where is it stored", "Tell me more", "Is De La the owner of XQ7 now?"]


@query("""
WITH q AS (SELECT DISTINCT source AS id, CAST(replace(source, 'src', '') AS INTEGER) % 5 AS k FROM documents),
d AS (SELECT source AS id, CAST(doc_id AS VARCHAR) AS citation, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[`"'']', '', 'g'), '[^a-z0-9_.$/\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
h AS (SELECT q.id, k, citation,
  CASE k WHEN 0 THEN contains(t, 'thanedble anea') OR (contains(t, 'thanedble') AND contains(t, 'anea')) WHEN 1 THEN contains(t, 'attion thanedble erin') OR CAST(contains(t, 'attion') AS INT) + CAST(contains(t, 'thanedble') AS INT) + CAST(contains(t, 'erin') AS INT) >= 2 WHEN 4 THEN contains(t, 'de la') OR contains(t, 'xq7') ELSE TRUE END AS own,
  CASE k WHEN 0 THEN [regexp_matches(t, 'issue|incident|missing|blocked|affected|running|ongoing|current')] WHEN 1 THEN [regexp_matches(t, 'by|due|today|tomorrow|monday|friday|eod|pt'), regexp_matches(t, 'root cause|caused|because|suspected|confirmed|not established'), regexp_matches(t, 'risk|blocker|blocked|concern|weak|flag|issue')]
   WHEN 2 THEN [regexp_matches(t, 'stored|lives at|path|location|1password|item')] WHEN 3 THEN [] ELSE [regexp_matches(t, 'owner|owns|responsible|assigned|next update|on-call|on call')] END AS c FROM q LEFT JOIN d USING (id)),
g AS (SELECT id, k, count(citation) AS n, coalesce(bool_or(own) FILTER (WHERE citation IS NOT NULL), FALSE) AS named, list_sort(list(citation) FILTER (WHERE own AND citation IS NOT NULL)) AS supported,
  [coalesce(bool_or(c[1]) FILTER (WHERE citation IS NOT NULL), FALSE), coalesce(bool_or(c[2]) FILTER (WHERE citation IS NOT NULL), FALSE), coalesce(bool_or(c[3]) FILTER (WHERE citation IS NOT NULL), FALSE)] AS cov FROM h GROUP BY id, k),
s AS (SELECT *, CASE k WHEN 0 THEN ['status'] WHEN 1 THEN ['timeline', 'cause', 'risk'] WHEN 2 THEN ['location'] WHEN 3 THEN [] ELSE ['owner'] END AS slots, CASE k WHEN 0 THEN 'Thanedble Anea' WHEN 1 THEN 'Attion Thanedble Erin' WHEN 4 THEN 'De La' END AS subject FROM g),
m AS (SELECT *, list_filter(slots, lambda x, i: NOT cov[i]) AS bare FROM s),
a AS (SELECT *, CASE WHEN n = 0 AND subject IS NOT NULL THEN ['No supporting search results were returned for ' || subject || '.'] WHEN n > 0 AND subject IS NOT NULL AND NOT named THEN ['No returned citation is explicitly bound to ' || subject || ' or a clear alias.']
  WHEN n > 0 AND len(slots) > 0 AND len(bare) = len(slots) THEN ['No returned citation supports the requested coverage: ' || array_to_string(slots, ', ') || '.'] END AS state FROM m)
SELECT id, state IS NULL AS can_answer, array_to_string(coalesce(state, CASE WHEN n > 0 THEN list_transform(bare, lambda x: 'Evidence did not clearly cover requested slot: ' || x || '.') ELSE [] END), '|') AS missing, CASE WHEN state IS NULL THEN coalesce(array_to_string(supported, ','), '') ELSE '' END AS supported FROM a""")
def answer_coverage(spark, sf_dir):
    """Whether the documents labelled good answer a question that is put to their source."""
    docs = table(spark, sf_dir, "documents")
    number = F.regexp_replace("source", "src", "").cast("int") % len(QUESTIONS)
    questions = docs.select(F.col("source").alias("id")).distinct().withColumn("source", F.col("id")).select("id", F.element_at(F.array(*map(F.lit, QUESTIONS)), number + 1).alias("question"))
    good = docs.join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").select(F.col("source").alias("id"), F.col("doc_id").cast("string").alias("citation"), F.col("text").alias("content"))
    out = V.assess(questions, good)
    return out.select("id", "can_answer", F.array_join("missing", "|").alias("missing"), F.array_join("supported", ",").alias("supported"))
