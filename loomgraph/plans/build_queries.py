"""Registered queries: tenants, normalized episodes, records, extraction batches, clusters, and seeds found by the query itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bridge
from ..bridge import sees, with_model
from ..functions import text as X
from ..functions.tables import register
from ..operators import aggregates as A
from ..operators import clusters as C
from ..operators import extraction as E
from ..operators import graph as G
from ..operators import normalize as N
from ..operators import temporal as T
from ..schema import own_or_default
from ..security import Access, visible
from ..sources import records
from ..storage import of_group, table
from . import retrieval as R
from .search_queries import ORACLES as SEARCH_SQL
from .search_queries import jaccard_sql, rank_sql, terms_sql, trigrams_sql, words_sql
from .temporal_queries import DAY, HOLDS, RESULT, SECURITY, joined, model

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ tenants

NORTH = "f.acl < 3 AND s.acl < 3 AND t.acl < 3"


def north(spark, sf_dir):
    return [of_group(bridge.tenanted(df), "north") for df in model(spark, sf_dir)]


@query(with_model(f" SELECT {RESULT} FROM ({joined('security', HOLDS + ' AND ' + NORTH)})"))
def as_of_tenant(spark, sf_dir):
    e, f = north(spark, sf_dir)
    return T.as_of(f, e, DAY, SECURITY, limit=None)


@query(with_model(f", n AS ({joined('security', 'f.invalid_at IS NULL AND ' + NORTH)}) SELECT source AS src, target AS dst, id AS fact_id, confidence AS weight FROM n UNION ALL SELECT target, source, id, confidence FROM n WHERE source <> target"))
def edges_of_tenant(spark, sf_dir):
    e, f = north(spark, sf_dir)
    return G.edges_of(f, e, SECURITY)


@query(with_model(f", t AS (SELECT id, confidence, {terms_sql('fact_text')} AS a FROM facts WHERE invalid_at IS NULL AND {sees('acl', 'security')} AND acl < 3) SELECT id, round(0.65 * {rank_sql('a', ['priority', 'urgent', 'nowhere'])} * confidence, 6) AS score FROM t WHERE (list_contains(a, 'priority') OR list_contains(a, 'urgent')) AND NOT (list_contains(a, 'priority') AND list_contains(a, 'urgent') AND list_contains(a, 'nowhere'))", "facts"))
def keyword_tenant(spark, sf_dir):
    f = of_group(bridge.tenanted(bridge.facts(spark, sf_dir)), "north")
    seen = f.filter("invalid_at is null").filter(visible("visibility", SECURITY))
    return R.keyword_rank(seen, F.col("fact_text"), "priority urgent nowhere").select("id", F.round(F.col("rank") * F.col("confidence"), 6).alias("score"))


@query(with_model(f" SELECT id, kind, status FROM memory WHERE {sees('acl', 'security')} AND acl < 3", "memory"))
def memory_of_tenant(spark, sf_dir):
    m = of_group(bridge.tenanted(bridge.memory(spark, sf_dir)), "north")
    return m.filter(visible("visibility", SECURITY)).select("id", "kind", "status")


# ------------------------------------------------------------------ episodes


@query("""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
f AS (SELECT conv_id, arg_min(text, turn) AS first FROM t GROUP BY conv_id),
r AS (SELECT conv_id, string_agg(CASE WHEN role = '' THEN 'user' ELSE role END || ' @ ' || turn || ': ' || text, chr(10) ORDER BY turn) AS replies, count(*) AS n FROM t GROUP BY conv_id)
SELECT conv_id, 'Channel: C' || conv_id % 7 || chr(10) || 'Sender: U' || conv_id % 11 || chr(10) || 'Message: ' || first || chr(10) || 'Thread replies:' || chr(10) || replies || chr(10) || 'Reactions: eyes=' || n || ', ok=1' AS content FROM f JOIN r USING (conv_id)""")
def normalize_slack(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    talk = rows.groupBy("conv_id").agg(turns.alias("turns"), F.count("*").alias("n"))
    replies = F.transform("turns", lambda t: F.struct(t["role"].alias("user"), t["turn"].alias("ts"), t["text"].alias("text")))
    reactions = F.array(F.struct(F.lit("eyes").alias("name"), F.col("n").alias("count")), F.struct(F.lit("ok").alias("name"), F.lit(None).cast("long").alias("count")))
    data = F.to_json(F.struct(F.concat(F.lit("C"), F.col("conv_id") % 7).alias("channel"), F.concat(F.lit("U"), F.col("conv_id") % 11).alias("userId"), replies.alias("threadMessages"), reactions.alias("reactions")))
    return talk.select("conv_id", N.normalized(F.lit("slack_message"), data, F.element_at("turns", 1)["text"]).alias("content"))


@query("""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, 'Title: Call ' || conv_id || chr(10) || 'Participants: ' || string_agg(DISTINCT role, ', ' ORDER BY role) || chr(10) || 'Structured turns:' || chr(10)
  || trim(string_agg('[' || turn || '] ' || CASE WHEN role = '' THEN 'Speaker' ELSE role END || ': ' || text, chr(10) ORDER BY turn)) AS content FROM t GROUP BY conv_id""")
def normalize_call(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talk = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"), F.array_sort(F.collect_set("role")).alias("who"))
    turns = F.transform("turns", lambda t: F.struct(t["turn"].alias("timestamp"), t["role"].alias("speaker"), t["text"].alias("text")))
    data = F.to_json(F.struct(F.concat(F.lit("Call "), F.col("conv_id")).alias("title"), F.col("who").alias("participants"), turns.alias("turns")))
    return talk.select("conv_id", N.normalized(F.lit("sales_call"), data, F.lit("")).alias("content"))


@query("SELECT event_id, 'Event: ' || event_type || chr(10) || 'Actor: ' || user_id || chr(10) || 'Details: did it' || coalesce(chr(10) || 'Properties: {\"k\":' || json_extract_string(props, '$.k') || '}', '') AS content FROM events")
def normalize_event(spark, sf_dir):
    data = F.to_json(F.struct(F.col("event_type").alias("event"), F.col("user_id").alias("userId"), F.from_json("props", "k int").alias("properties")))
    return table(spark, sf_dir, "events").select("event_id", N.normalized(F.lit("analytics"), data, F.lit("did it")).alias("content"))


@query("SELECT c_custkey, 'Record type: customer' || chr(10) || 'Record ID: ' || c_custkey || chr(10) || 'Stage/status: ' || c_mktsegment || chr(10) || 'Fields: {\"nation\":' || c_nationkey || '}' || chr(10) || 'Record content: ' || c_name AS content FROM customer")
def normalize_record(spark, sf_dir):
    data = F.to_json(F.struct(F.lit("customer").alias("recordType"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.struct(F.col("c_nationkey").alias("nation")).alias("fields")))
    return table(spark, sf_dir, "customer").select("c_custkey", N.normalized(F.lit("crm"), data, F.col("c_name")).alias("content"))


@query("""
SELECT c_custkey, c_custkey % 3 <> 0 OR c_custkey % 2 = 0 AS seen_by_u1, c_custkey % 3 <> 0 AS seen_by_none, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_entries, 'crm' AS provider FROM customer""")
def inferred_acl(spark, sf_dir):
    """Records with an access list for one user in three, a second user among it for every sixth."""
    k = F.col("c_custkey")
    ids = F.when(k % 6 == 0, F.array(F.lit("U9"), F.lit("U1"))).when(k % 3 == 0, F.array(F.lit("U9")))
    data = F.to_json(F.struct(ids.alias("allowedUserIds")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit("crm_record").alias("source_type"), F.col("c_name").alias("content"), data.alias("metadata"))
    p = N.normalize(rows).select("c_custkey", "visibility")
    u1 = Access(source_accounts={"crm": "U1"})
    return p.select("c_custkey", visible("visibility", u1).alias("seen_by_u1"), visible("visibility", None).alias("seen_by_none"), F.size("visibility.sourceAcl").alias("n_entries"), F.col("visibility.sourceSystem").alias("provider"))


@query("""
SELECT 'saas://crm/customer/' || c_custkey AS source_id, c_name || chr(10) || chr(10) || c_mktsegment AS content, 'crm:user:' || c_nationkey AS allowed, c_custkey % 2 = 0 AS is_public_metadata, CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def saas_records(spark, sf_dir):
    k = F.col("c_custkey")
    payload = F.to_json(F.struct(k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), F.col("c_nationkey").alias("nation"), F.struct(F.array(F.col("c_nationkey").cast("string")).alias("users")).alias("permissions"), F.when(k % 2 == 0, "yes").alias("note2")))
    out = records.to_episodes(table(spark, sf_dir, "customer").select(payload.alias("payload")), "crm", "customer")
    return out.select("source_id", "content", F.element_at("visibility.allowedPrincipals", 1).alias("allowed"), F.get_json_object("metadata", "$.note2").isNotNull().alias("is_public_metadata"), F.get_json_object("metadata", "$.nation").alias("nation"))


# ------------------------------------------------------------------ extraction


@query("""
WITH m AS (SELECT c_custkey % 100 AS episode_id, c_name AS name, c_mktsegment AS seg FROM customer),
d AS (SELECT c_custkey % 100 AS episode_id, CASE WHEN c_custkey % 2 = 0 THEN upper(left(c_name, 18)) ELSE 'Person ' || c_custkey END AS name, c_nationkey AS nation, c_custkey FROM customer),
hit AS (SELECT d.episode_id, d.name AS f, min(m.name) AS name FROM d JOIN m ON m.episode_id = d.episode_id AND (contains(lower(m.name), lower(d.name)) OR contains(lower(d.name), lower(m.name))) GROUP BY ALL),
given AS (SELECT hit.episode_id, hit.name, CAST(arg_max(d.nation, d.name) AS VARCHAR) AS nation FROM hit JOIN d ON d.episode_id = hit.episode_id AND d.name = hit.f GROUP BY ALL)
SELECT m.episode_id, m.name, seg, given.nation FROM m LEFT JOIN given ON given.episode_id = m.episode_id AND given.name = m.name
UNION ALL SELECT d.episode_id, d.name, NULL, CAST(d.nation AS VARCHAR) FROM d WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.episode_id = d.episode_id AND hit.f = d.name) AND lower(d.name) NOT IN (SELECT lower(m.name) FROM m WHERE m.episode_id = d.episode_id)""")
def merge_extracted(spark, sf_dir):
    """A model's names with the attributes of found names inside them; found names that fit none are added."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    one = lambda key, v: F.create_map(F.lit(key), v.cast("string"))
    m = c.select((k % 100).alias("episode_id"), F.col("c_name").alias("name"), F.lit("customer").alias("entity_type"), one("seg", F.col("c_mktsegment")).alias("attributes"))
    d = c.select((k % 100).alias("episode_id"), F.when(k % 2 == 0, F.upper(F.substring("c_name", 1, 18))).otherwise(F.concat(F.lit("Person "), k)).alias("name"), F.lit("person").alias("entity_type"), one("nation", F.col("c_nationkey")).alias("attributes"))
    return E.merge_entities(m, d).select("episode_id", "name", F.element_at("attributes", "seg").alias("seg"), F.element_at("attributes", "nation").alias("nation"))


@query("""
SELECT 'default' AS group_id, event_type AS id, 'Shared ' || event_type AS label FROM events GROUP BY ALL
UNION ALL SELECT 'north', event_type, 'Shared ' || event_type FROM events GROUP BY ALL
UNION ALL SELECT 'north', 'seg_' || lower(c_mktsegment), 'Seg ' || upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) FROM customer GROUP BY ALL""")
def register_types(spark, sf_dir):
    known = table(spark, sf_dir, "events").select("event_type").distinct()
    types = known.select(F.lit("default").alias("group_id"), F.col("event_type").alias("id"), F.concat(F.lit("Shared "), "event_type").alias("label"))
    used = known.select(F.col("event_type").alias("id")).unionByName(table(spark, sf_dir, "customer").select(F.concat(F.lit("seg_"), F.lower("c_mktsegment")).alias("id")))
    return E.registered(types, used, "north")


@query("""
WITH o AS (SELECT *, 'doc:' || o_orderkey % 50 AS episode FROM orders),
names AS (SELECT DISTINCT upper(c_name) AS name, 'customer:' || c_custkey AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0),
f AS (SELECT DISTINCT 'customer:' || o_custkey AS source, 'priority:' || o_orderpriority AS target FROM o WHERE o_orderkey % 7 <> 0)
SELECT source, target, count(*) AS n FROM f GROUP BY ALL""")
def ingest_batch(spark, sf_dir):
    """Orders as extracted facts of fifty episodes: customers spelt in capitals resolve to the known ones, one fact for each pair.
    Every seventh order comes from an episode that is stored already and brings nothing."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    said = o.join(c, o["o_custkey"] == c["c_custkey"])
    k = F.col("o_orderkey")
    stored_before = k % 7 == 0
    episode = F.when(stored_before, F.lit("doc:old")).otherwise(F.concat(F.lit("doc:"), (k % 50).cast("string")))
    day = F.lit("2005-01-01").cast("timestamp_ntz")
    episodes = said.select(episode.alias("id"), F.lit("crm_note").alias("source_type"), episode.alias("source_id"), F.lit("x").alias("content"), F.lit("{}").alias("metadata"), day.alias("valid_at")).distinct()
    facts = said.select(episode.alias("episode_id"), F.upper("c_name").alias("source_name"), F.lit("customer").alias("source_type"), F.lit("wants").alias("relation"), F.col("o_orderpriority").alias("target_name"), F.lit("priority").alias("target_type"), F.concat_ws(" ", "c_name", F.lit("wants"), "o_orderpriority").alias("fact_text"), F.lit(0.9).alias("confidence"), F.lit(None).cast("timestamp_ntz").alias("valid_at"))
    names = facts.select("episode_id", F.col("source_name").alias("name"), F.col("source_type").alias("entity_type"))
    e, f = model(spark, sf_dir)
    old = spark.createDataFrame([("doc:old", "crm_note", "doc:old")], "id string, source_type string, source_id string")
    relations = spark.createDataFrame([("wants", "many", "never")], "id string, cardinality string, invalidation_policy string")
    out = E.ingest_batch({"episodes": old, "entities": e, "aliases": bridge.aliases(spark, sf_dir), "facts": f}, episodes, names, facts, relations)
    return out.facts.groupBy("source", "target").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ clusters


def brands(spark, sf_dir):
    """Parts as entities, named by brand and name, with the type as an alias of every second one."""
    p = table(spark, sf_dir, "part")
    e = p.select(F.format_string("p%08d", "p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_size").alias("entity_type"), F.concat_ws(" ", "p_brand", "p_name").alias("name"))
    return e, p.filter("p_partkey % 2 = 0").select(F.format_string("p%08d", "p_partkey").alias("entity_id"), F.concat_ws(" ", "p_name", F.lit("aka")).alias("alias"))


@query()
def entity_clusters(spark, sf_dir):
    """Held against the greedy pass itself in the tests."""
    e, a = brands(spark, sf_dir)
    return C.entity_clusters(e, a, 0.5).withColumn("confidence", F.round("confidence", 6))


RELATION_LABELS = "(SELECT DISTINCT lower(p_name || ' ' || p_type) AS relation FROM part)"


@query(f"WITH t AS (SELECT relation AS id, list_distinct(list_filter({words_sql('relation')}, lambda w: length(w) > 1)) AS t FROM {RELATION_LABELS}) SELECT a.id AS a, b.id AS b, round({jaccard_sql('a.t', 'b.t')}, 6) AS score FROM t a JOIN t b ON a.id < b.id WHERE {jaccard_sql('a.t', 'b.t')} >= 0.5")
def alike_relations(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ", "_").alias("relation"))
    return C.alike_relations(p, 0.5).select(F.replace("a", F.lit("_"), F.lit(" ")).alias("a"), F.replace("b", F.lit("_"), F.lit(" ")).alias("b"), F.round("score", 6).alias("score"))


@query()
def relation_clusters(spark, sf_dir):
    """Clusters of part names and types as relation labels; held against the greedy pass in the tests."""
    p = table(spark, sf_dir, "part").select(F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ", "_").alias("relation"))
    return C.relation_clusters(p, 0.5).withColumn("confidence", F.round("confidence", 6))


@query(with_model(" SELECT e.id, array_to_string(list_sort(coalesce(list(DISTINCT a.alias) FILTER (WHERE a.alias IS NOT NULL), [])), '|') AS aliases FROM entities e LEFT JOIN aliases a ON a.entity_id = e.id GROUP BY e.id", "entities", "aliases"))
def entities_with_aliases(spark, sf_dir):
    e = bridge.entities(spark, sf_dir).select("id")
    return C.with_aliases(e, bridge.aliases(spark, sf_dir)).select("id", F.array_join("aliases", "|").alias("aliases"))


@query(with_model(" SELECT relation, array_to_string(list_slice(list(fact_text ORDER BY confidence DESC, id), 1, 3), '|') AS examples FROM facts GROUP BY relation", "facts"))
def relation_examples(spark, sf_dir):
    return C.relation_examples(bridge.facts(spark, sf_dir)).select("relation", F.array_join("examples", "|").alias("examples"))


# ------------------------------------------------------------------ seeds that the query names

ASKED = "urgent supplier 3"


@query(
    with_model(
        f""", v AS (SELECT id, name, {trigrams_sql("name")} AS g, {trigrams_sql(repr(ASKED))} AS q, {terms_sql("name || ' ' || summary")} AS a FROM entities WHERE {sees("acl", "security")}),
al AS (SELECT v.id, {trigrams_sql("x.alias")} AS g, v.q FROM v JOIN aliases x ON x.entity_id = v.id),
s AS (SELECT id, 0.9 * {jaccard_sql("g", "q")} AS score FROM v WHERE {jaccard_sql("g", "q")} > 0.2
  UNION ALL SELECT id, 0.9 * {jaccard_sql("g", "q")} FROM al WHERE {jaccard_sql("g", "q")} > 0.2
  UNION ALL SELECT id, 0.5 * {rank_sql("a", ["urgent", "supplier"])} FROM v WHERE list_contains(a, 'urgent') OR list_contains(a, 'supplier'))
SELECT id, round(max(score), 6) AS score FROM s GROUP BY id ORDER BY max(score) DESC, id LIMIT 10""",
        "entities",
        "aliases",
    )
)
def find_seeds(spark, sf_dir):
    """The ten entities that the query names best: the whole query's trigrams against names and aliases, and its words."""
    e, f = model(spark, sf_dir)
    corpus = R.Corpus(e, f, bridge.episodes(spark, sf_dir), bridge.aliases(spark, sf_dir))
    return R.find_seeds(corpus, R.Request(ASKED, access=SECURITY)).select("id", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ table functions and small parts


@query(SEARCH_SQL["extract_people"])
def people_lateral(spark, sf_dir):
    """extract_people as a table function of SQL, joined LATERAL."""
    register(spark)
    sql = "select d.doc_id, lower(p.name) as name, p.entity_type, p.confidence, lower(p.value) as value from {docs} d, lateral extract_people(d.text) p"
    return spark.sql(sql, docs=table(spark, sf_dir, "documents"))


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, text, position('der' IN lower(text)) AS pos FROM conversations)
SELECT conv_id, turn, number, substring(text, pos, 160) AS quote FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY number) AS n FROM t WHERE pos > 0) WHERE n = 1""")
def first_quotes(spark, sf_dir):
    """For each conversation the first turn that holds a word, as a table function over partitions."""
    register(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("content"), F.lit("DER").alias("needle"))
    return spark.sql("select conv_id, turn, number, quote from quotes(table(select * from {turns}) partition by conv_id order by (turn), 'content', 'needle')", turns=turns)


@query("SELECT doc_id, CASE WHEN pos > 0 THEN substring(text, pos, 160) END AS quote, CASE WHEN pos > 0 THEN pos - 1 END AS \"start\" FROM (SELECT doc_id, text, CASE WHEN contains(lower(text), 'anea') THEN position('anea' IN lower(text)) ELSE position('ier' IN lower(text)) END AS pos FROM documents)")
def evidence_quotes(spark, sf_dir):
    """The evidence quote of each document for two needles, the first that it holds."""
    q = X.evidence_quote(F.col("text"), F.lit("Anea"), F.lit("IER"))
    return table(spark, sf_dir, "documents").select("doc_id", q.alias("q")).select("doc_id", "q.quote", F.col("q.start").cast("long").alias("start"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS TIMESTAMP) WHEN 1 THEN CAST(o_orderdate AS TIMESTAMP) WHEN 2 THEN CAST(o_orderdate AS TIMESTAMP) END AS valid_at FROM orders")
def detected_dates(spark, sf_dir):
    """Dates of JSON payloads: ISO text, seconds, milliseconds, or none."""
    at, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.unix_seconds(at).cast("string")).when(k == 2, F.unix_millis(at).cast("string")).otherwise("soon")
    payload = F.to_json(F.struct(F.when(k == 0, raw).alias("date"), F.when(k != 0, raw).alias("timestamp")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), X.detect_date(payload).alias("valid_at"))


@query("SELECT id, label, group_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN group_id = 'src3' THEN 0 ELSE 1 END) AS n FROM (SELECT DISTINCT lang AS id, lang || ' of ' || source AS label, CASE WHEN source = 'src3' THEN 'src3' ELSE 'default' END AS group_id FROM documents WHERE source IN ('src3', 'src4') UNION ALL SELECT DISTINCT event_type, event_type, 'default' FROM events)) WHERE n = 1")
def ontology_of_group(spark, sf_dir):
    """A tenant's ontology: its own rows, and the default ones where it has none."""
    d = table(spark, sf_dir, "documents").filter("source in ('src3', 'src4')")
    own = d.select(F.col("lang").alias("id"), F.concat_ws(" of ", "lang", "source").alias("label"), F.when(F.col("source") == "src3", "src3").otherwise("default").alias("group_id")).distinct()
    shared = table(spark, sf_dir, "events").select(F.col("event_type").alias("id"), F.col("event_type").alias("label"), F.lit("default").alias("group_id")).distinct()
    return own_or_default(own.unionByName(shared), "src3").select("id", "label", "group_id")


@query("SELECT event_id AS id, event_type AS entity_type FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS n FROM events WHERE user_id % 2 = 0 AND event_id % 10 / 10.0 > 0.7) WHERE n <= 500")
def sure_and_newest(spark, sf_dir):
    """The rows of an extraction log that suggest_types looks at; a report of the newest 500."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("entity_type"), F.when(F.col("user_id") % 2 == 0, "llm").otherwise("rules").alias("method"), (F.col("event_id") % 10 / 10).alias("confidence"), F.col("ts").alias("created_at"))
    return A.sure_and_newest(log).select("id", "entity_type")


@query("""WITH a AS (SELECT doc_id AS k, lang || ' relation ' || source AS relation, source || ' said' AS text FROM documents)
SELECT k AS id, CASE WHEN relation LIKE 'en %' THEN 'english' ELSE relation END AS relation, CASE WHEN relation LIKE 'en %' THEN relation END AS relation_was FROM a""")
def canonical_relations(spark, sf_dir):
    """Facts with their relations' canonical labels, from a mapping."""
    d = table(spark, sf_dir, "documents")
    facts = d.select(F.col("doc_id").alias("id"), F.concat(F.col("lang"), F.lit(" relation "), F.col("source")).alias("relation"))
    mapping = facts.filter("relation like 'en %'").select(F.col("relation").alias("duplicate"), F.lit("english").alias("canonical")).distinct()
    return C.apply_relations(facts, mapping).select("id", "relation", "relation_was")
