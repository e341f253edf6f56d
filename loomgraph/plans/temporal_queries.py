"""Registered queries: scans, access, temporal operators, aggregates, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bridge
from ..bridge import sees, with_model
from ..operators import aggregates as A
from ..operators import temporal as T
from ..schema import VISIBILITY, broken_rows, relation_types
from ..security import Access, simulate, visible_rows, warning
from ..storage import table, upsert

SECURITY = Access(groups=("security",))
CONTRACTORS = Access(groups=("contractors",))
CHANNEL = Access(groups=("slack:channel:C1",))
DAY = "1998-01-01"
SINCE = "2001-06-01"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return bridge.entities(spark, sf_dir), bridge.facts(spark, sf_dir)


def joined(group: str | None, where: str) -> str:
    """Facts with both endpoints, as a group sees them."""
    return f"""
SELECT f.*, s.name AS source_name, t.name AS target_name, s.entity_type AS source_type, t.entity_type AS target_type
FROM facts f JOIN entities s ON s.id = f.source JOIN entities t ON t.id = f.target
WHERE {sees("f.acl", group)} AND {sees("s.acl", group)} AND {sees("t.acl", group)} AND {where}"""


RESULT = "id, source, relation, target, source_name, target_name, confidence AS score, fact_text, valid_at, invalid_at"
HOLDS = f"f.valid_at <= TIMESTAMP '{DAY}' AND (f.invalid_at IS NULL OR f.invalid_at > TIMESTAMP '{DAY}')"


@query(with_model(" SELECT id, entity_type, name, summary, acl FROM entities", "entities"))
def bridge_entities(spark, sf_dir):
    return bridge.entities(spark, sf_dir).drop("visibility")


@query(with_model(" SELECT id, source, relation, target, fact_text, valid_at, invalid_at, created_at, confidence, acl FROM facts", "facts"))
def bridge_facts(spark, sf_dir):
    return bridge.facts(spark, sf_dir).drop("visibility")


@query(with_model(f" SELECT {RESULT} FROM ({joined('security', HOLDS)}) ORDER BY valid_at DESC, id LIMIT 50"))
def as_of(spark, sf_dir):
    e, f = model(spark, sf_dir)
    return T.as_of(f, e, DAY, SECURITY)


@query(with_model(f" SELECT {RESULT} FROM ({joined(None, HOLDS)})"))
def as_of_public_only(spark, sf_dir):
    e, f = model(spark, sf_dir)
    return T.as_of(f, e, DAY, None, limit=None)


@query(with_model(f" SELECT {RESULT} FROM ({joined('contractors', HOLDS)})"))
def as_of_denied(spark, sf_dir):
    e, f = model(spark, sf_dir)
    return T.as_of(f, e, DAY, CONTRACTORS, limit=None)


@query(with_model(f" SELECT {RESULT} FROM ({joined('slack:channel:C1', HOLDS)}) WHERE relation IN ('has_priority', 'supplies') AND (source_type = 'customer' OR target_type = 'customer')"))
def as_of_filtered(spark, sf_dir):
    e, f = model(spark, sf_dir)
    return T.as_of(f, e, DAY, CHANNEL, limit=None, relations=["has_priority", "supplies"], entity_types=["customer"])


@query(
    with_model(f""", seen AS ({joined("security", "TRUE")}),
changes AS (
  SELECT *, 'created' AS change, created_at AS changed_at FROM seen WHERE created_at >= TIMESTAMP '{SINCE}'
  UNION ALL SELECT *, 'invalidated', invalid_at FROM seen WHERE invalid_at >= TIMESTAMP '{SINCE}' AND created_at < TIMESTAMP '{SINCE}')
SELECT id, source, relation, target, change, changed_at, confidence AS score FROM changes""")
)
def changed_since(spark, sf_dir):
    e, f = model(spark, sf_dir)
    return T.changed_since(f, e, SINCE, SECURITY, limit=None)


@query(with_model(f" SELECT {RESULT} FROM ({joined('security', chr(102) + '.valid_at <= TIMESTAMP ' + repr('1996-06-30') + ' AND (f.invalid_at IS NULL OR f.invalid_at >= TIMESTAMP ' + repr('1996-06-01') + ')')})"))
def valid_during(spark, sf_dir):
    e, f = model(spark, sf_dir)
    return T.valid_during(f, e, "1996-06-01", "1996-06-30", SECURITY, limit=None)


@query(with_model(f" SELECT {RESULT}, CASE WHEN invalid_at IS NULL THEN 'current' ELSE 'superseded' END AS status FROM ({joined('security', 'TRUE')}) WHERE source = 'priority:1-URGENT' OR target = 'priority:1-URGENT'"))
def entity_timeline(spark, sf_dir):
    e, f = model(spark, sf_dir)
    return T.entity_timeline(f, e, "priority:1-URGENT", SECURITY)


PAIR = "o.id AS old_id, n.id AS new_id, o.relation, o.invalid_at AS invalidated_at, o.valid_at AS old_valid_at, n.valid_at AS new_valid_at"


@query(
    with_model(f""", seen AS ({joined("security", "TRUE")}),
counted AS (SELECT *, count(*) OVER (PARTITION BY source, relation, target ORDER BY valid_at RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 1 AS later FROM seen),
o AS (SELECT * FROM counted WHERE later > 0 AND invalid_at >= TIMESTAMP '2000-01-01' ORDER BY invalid_at DESC, id LIMIT 50)
SELECT {PAIR} FROM o JOIN seen n ON o.source = n.source AND o.relation = n.relation AND o.target = n.target
WHERE n.id <> o.id AND n.valid_at >= o.valid_at ORDER BY o.invalid_at DESC, o.id, n.id LIMIT 50""")
)
def recent_contradictions(spark, sf_dir):
    """The report of the newest 50; contradiction_counts looks at all."""
    e, f = model(spark, sf_dir)
    return T.contradictions(f, e, SECURITY, since="2000-01-01")


@query(
    with_model(f""", seen AS ({joined("security", "TRUE")}),
counted AS (SELECT *, count(*) OVER (PARTITION BY source, relation, target ORDER BY valid_at RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 1 AS later, lead(id) OVER (PARTITION BY source, relation, target ORDER BY valid_at, id) AS next_id FROM seen)
SELECT id, relation, invalid_at, later, next_id FROM counted WHERE invalid_at IS NOT NULL""")
)
def contradiction_counts(spark, sf_dir):
    e, f = model(spark, sf_dir)
    return T.contradiction_counts(f, e, SECURITY)


@query(
    with_model(f""", seen AS MATERIALIZED ({joined("security", "TRUE")}), said AS MATERIALIZED (SELECT *, source || '|' || relation || '|' || epoch_us(valid_at) AS begins, source || '|' || relation || '|' || epoch_us(invalid_at) AS ends FROM seen WHERE relation <> 'supplies')
SELECT {PAIR} FROM said o JOIN said n ON o.ends = n.begins WHERE n.id <> o.id""")
)
def contradictions_by_cardinality(spark, sf_dir):
    e, f = model(spark, sf_dir)
    return T.contradictions_by_cardinality(f, e, relation_types(spark), SECURITY, limit=None)


@query(with_model(f" SELECT id, source, relation, target, valid_at, invalid_at FROM facts WHERE {sees('acl', 'security')} AND target = 'priority:2-HIGH' AND valid_at <= TIMESTAMP '{DAY}' AND invalid_at IS NULL", "facts"))
def get_facts(spark, sf_dir):
    return T.get_facts(bridge.facts(spark, sf_dir), SECURITY, target="priority:2-HIGH", ts=DAY, strict_as_of=False).select("id", "source", "relation", "target", "valid_at", "invalid_at")


@query(with_model(f" SELECT id, source, relation, target, valid_at, invalid_at FROM facts f WHERE {sees('acl', 'security')} AND (source = 'nation:3' OR target = 'nation:3') AND {HOLDS}", "facts"))
def get_facts_strict_as_of(spark, sf_dir):
    return T.get_facts(bridge.facts(spark, sf_dir), SECURITY, either="nation:3", ts=DAY).select("id", "source", "relation", "target", "valid_at", "invalid_at")


@query(with_model(" SELECT id, relation, source, valid_at, CASE WHEN relation = 'supplies' THEN NULL ELSE lead(valid_at) OVER (PARTITION BY relation, source ORDER BY valid_at, id) END AS invalid_at FROM facts", "facts"))
def supersede_intervals(spark, sf_dir):
    said = bridge.facts(spark, sf_dir).withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))
    return T.supersede(said, relation_types(spark)).select("id", "relation", "source", "valid_at", "invalid_at")


@query("""
SELECT l_orderkey, l_linenumber, l_shipdate, (
  SELECT arg_max('priority:' || p.o_orderpriority, (p.o_orderdate, p.o_orderkey)) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate <= l.l_shipdate
) AS target FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""")
def as_of_join(spark, sf_dir):
    events = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    events = events.select("l_orderkey", "l_linenumber", "l_shipdate", F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("customer"))
    said = bridge.facts(spark, sf_dir).filter("relation = 'has_priority'")
    latest = said.groupBy("source", "relation", "valid_at").agg(F.max_by("target", F.split("id", ":")[1].cast("long")).alias("target"), F.max("invalid_at").alias("invalid_at"))
    return T.as_of_join(events, latest.withColumn("invalid_at", F.lit(None).cast("timestamp_ntz")), "customer", "l_shipdate").select("l_orderkey", "l_linenumber", "l_shipdate", "target")


@query(
    with_model("""
SELECT e.id, e.entity_type, e.name, CAST(count(DISTINCT f.id) FILTER (WHERE f.invalid_at IS NULL) AS BIGINT) AS current_facts, count(DISTINCT f.id) AS total_facts, max(f.valid_at) AS last_fact_at
FROM entities e LEFT JOIN (SELECT source AS e, * FROM facts UNION ALL SELECT target AS e, * FROM facts WHERE source <> target) f ON f.e = e.id GROUP BY ALL""")
)
def entity_summary(spark, sf_dir):
    e, f = model(spark, sf_dir)
    return A.entity_summary(e, f)


LOG_SQL = """
log AS (SELECT doc_id, text AS input_text, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) AS created_at,
  CASE WHEN doc_id % 3 = 0 THEN 'deterministic' WHEN doc_id % 7 = 0 THEN 'hybrid' ELSE 'llm' END AS method FROM documents)"""


def log(spark, sf_dir):
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        k,
        F.col("text").alias("input_text"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.pmod(k, F.lit(60)).cast("int"))).cast("timestamp_ntz").alias("created_at"),
        F.when(k % 3 == 0, "deterministic").when(k % 7 == 0, "hybrid").otherwise("llm").alias("method"),
    )


@query(
    "WITH"
    + LOG_SQL
    + """ SELECT count(*) AS total, count(*) FILTER (WHERE method = 'deterministic') AS deterministic, count(*) FILTER (WHERE method = 'llm') AS llm, count(*) FILTER (WHERE method = 'hybrid') AS hybrid,
round(count(*) FILTER (WHERE method = 'deterministic') / count(*), 6) AS deterministic_rate FROM log WHERE created_at >= TIMESTAMP '2024-02-01'"""
)
def extraction_stats(spark, sf_dir):
    return A.extraction_stats(log(spark, sf_dir), "2024-02-01")


@query("WITH" + LOG_SQL + " SELECT left(input_text, 100) AS pattern, count(*) AS n FROM log GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10")
def top_patterns(spark, sf_dir):
    return A.top_patterns(log(spark, sf_dir))


@query(with_model(" SELECT id, entity_type, name, left(summary, 300) AS summary, (SELECT 0) + coalesce(degree, 0) AS degree FROM entities LEFT JOIN (SELECT e, count(*) AS degree FROM (SELECT source AS e FROM facts WHERE invalid_at IS NULL UNION ALL SELECT target FROM facts WHERE invalid_at IS NULL AND source <> target) GROUP BY e) ON e = id WHERE acl IN (0, 1, 3, 4)"))
def graph_nodes(spark, sf_dir):
    e, f = model(spark, sf_dir)
    return A.graph_nodes(visible_rows(e, SECURITY), f)


@query(with_model(f" SELECT id, source, target, relation, confidence FROM ({joined('security', 'f.invalid_at IS NULL')})"))
def graph_links(spark, sf_dir):
    e, f = model(spark, sf_dir)
    return A.graph_links(visible_rows(f, SECURITY), visible_rows(e, SECURITY))


@query(with_model(" SELECT coalesce(relation, 'ALL') AS relation, coalesce(y, 0) AS year, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM (SELECT *, CAST(year(valid_at) AS INTEGER) AS y FROM facts) GROUP BY CUBE (relation, y)", "facts"))
def fact_cube(spark, sf_dir):
    return A.fact_cube(bridge.facts(spark, sf_dir))


PEOPLE = {"none": None, "security": SECURITY, "contractors": CONTRACTORS, "channel": CHANNEL}


@query(
    with_model(
        " SELECT who, allowed, reason, count(*) AS n FROM ("
        + " UNION ALL ".join(f"SELECT '{n}' AS who, {sees('acl', g)} AS allowed, {reason} AS reason FROM entities" for n, g, reason in [("none", None, f"CASE WHEN {sees('acl', None)} THEN 'public' ELSE 'no_context' END")] + [(n, g, f"CASE WHEN {sees('acl', g)} THEN CASE WHEN acl IN (0, 2) THEN 'allowed' ELSE 'no_allow_list' END WHEN acl = 1 THEN 'denied' ELSE 'no_match' END") for n, g in (("security", "security"), ("contractors", "contractors"), ("channel", "slack:channel:C1"))])
        + ") GROUP BY ALL",
        "entities",
    )
)
def permission_matrix(spark, sf_dir):
    e = bridge.entities(spark, sf_dir)
    parts = [e.select(F.lit(n).alias("who"), simulate("visibility", a).alias("s")) for n, a in PEOPLE.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("who", "s.allowed", "s.reason").agg(F.count("*").alias("n"))


@query(
    with_model(
        """, p AS (SELECT id, CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) AS k FROM entities WHERE entity_type = 'customer')
SELECT id, k % 2 = 0 AND k % 3 <> 0 AS allowed, CASE WHEN k % 3 = 0 THEN 'denied' WHEN k % 2 = 0 THEN 'allowed' ELSE 'no_match' END AS reason,
  CASE WHEN k % 3 = 0 THEN 'slack:user:U2' ELSE '' END AS denied_by, CASE WHEN k % 2 = 0 THEN 'slack:channel:C1' ELSE '' END AS allowed_by FROM p""",
        "entities",
    )
)
def permission_deny_first(spark, sf_dir):
    """Policies with an allow list and, for some, a deny entry of the same person: the deny is the reason."""
    e = bridge.entities(spark, sf_dir).filter("entity_type = 'customer'")
    k = F.regexp_extract("id", "[0-9]+$", 0).cast("long")
    entry = lambda kind, i, access: F.struct(F.lit("slack").alias("provider"), i.alias("id"), F.lit(kind).alias("type"), F.lit(access).alias("access"), F.lit(None).cast("string").alias("name"))
    allow = F.array(entry("channel", F.when(k % 2 == 0, "C1").otherwise("C9"), "allow"))
    acl = F.concat(allow, F.when(k % 3 == 0, F.array(entry("user", F.lit("U2"), "deny"))).otherwise(F.array().cast(allow_type())))
    s = simulate(F.col("visibility").withField("sourceAcl", acl), Access(groups=("slack:channel:C1",), source_accounts={"slack": "U2"}))
    # the bridge's own lists are left out: they are the subject of permission_matrix
    e = e.withColumn("visibility", bridge.policy_of(F.lit(3)))
    return e.select("id", s.alias("s")).select("id", "s.allowed", "s.reason", F.concat_ws(",", "s.denied_by").alias("denied_by"), F.concat_ws(",", "s.allowed_by").alias("allowed_by"))


def allow_type():
    return VISIBILITY["sourceAcl"].dataType


@query(with_model(" SELECT id, 'classification ''' || 'security-only' || ''' has no access list' AS warning FROM entities WHERE acl IN (3, 4) AND entity_type = 'customer'", "entities"))
def visibility_warnings(spark, sf_dir):
    e = bridge.entities(spark, sf_dir).withColumn("visibility", F.col("visibility").withField("classification", F.when(F.col("entity_type") == "customer", "security-only")))
    return e.select("id", warning("visibility").alias("warning")).filter("warning is not null")


@query(with_model(" SELECT id, 'source' AS problem FROM facts WHERE source NOT IN (SELECT id FROM entities) UNION ALL SELECT id, 'target' FROM facts WHERE target NOT IN (SELECT id FROM entities WHERE entity_type <> 'region')"))
def integrity_check(spark, sf_dir):
    e, f = model(spark, sf_dir)
    lost = e.filter("entity_type <> 'region'")
    return broken_rows(f, lost.unionByName(e.filter("entity_type = 'region'").filter(F.lit(False))), relation_types(spark)).filter("problem <> 'relation'")


EPHEMERAL_SQL = """
eph AS (SELECT 'doc:' || doc_id AS id, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 90 AS INTEGER)) AS valid_at FROM documents WHERE doc_id % 2 = 0)"""


@query("WITH" + EPHEMERAL_SQL + " SELECT id, valid_at FROM eph WHERE valid_at < TIMESTAMP '2024-03-01' - to_days(14) AND id NOT IN (SELECT 'doc:' || event_id FROM events WHERE user_id % 3 = 0) AND id NOT IN (SELECT 'doc:' || doc_id FROM labels)")
def ephemeral_ttl(spark, sf_dir):
    k = F.col("doc_id")
    text = F.concat(F.lit("doc:"), k.cast("string"))
    valid = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.pmod(k, F.lit(90)).cast("int"))).cast("timestamp_ntz")
    kept = F.when(k % 2 == 0, "ephemeral").otherwise("durable")
    docs = table(spark, sf_dir, "documents").select(text.alias("id"), valid.alias("valid_at"), F.to_json(F.struct(F.struct(kept.alias("retention")).alias("triage"))).alias("metadata"))
    used = table(spark, sf_dir, "events").filter("user_id % 3 = 0").select(F.concat(F.lit("doc:"), F.col("event_id").cast("string")).alias("episode_id"))
    kept_by = table(spark, sf_dir, "labels").select(text.alias("episode_id"))
    return T.cleanup_candidates(docs, used, kept_by, "2024-03-01", limit=None).select("id", "valid_at")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment FROM customer")
def upsert_rows(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return upsert(base, base.filter("c_custkey % 10 = 0").withColumn("segment", F.lit("MOVED")), ["c_custkey"])
