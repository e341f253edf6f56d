"""The given tables as the data model, once as DataFrames and once as SQL.

Customers, suppliers, parts, nations, regions, order priorities, users and event
types are entities; their relations are facts.  A row's policy follows its key:
of five keys one is for the group security, one hidden from contractors, one for
a chat channel, and two are public.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import VISIBILITY
from .storage import table

START = "1995-01-01"


def policy_of(acl: Column) -> Column:
    none = F.array().cast("array<string>")
    empty = F.array().cast(VISIBILITY["sourceAcl"].dataType)
    channel = F.array(F.struct(F.lit("slack").alias("provider"), F.lit("C1").alias("id"), F.lit("channel").alias("type"), F.lit("allow").alias("access"), F.lit(None).cast("string").alias("name")))
    blank = F.lit(None).cast("string")
    return F.struct(
        none.alias("allowedPrincipals"),
        none.alias("deniedPrincipals"),
        F.when(acl == 0, F.array(F.lit("security"))).otherwise(none).alias("allowedGroups"),
        F.when(acl == 1, F.array(F.lit("contractors"))).otherwise(none).alias("deniedGroups"),
        blank.alias("classification"),
        blank.alias("inheritedFrom"),
        blank.alias("sourceSystem"),
        F.when(acl == 2, channel).otherwise(empty).alias("sourceAcl"),
    )


#: What a context sees, by acl number; for the SQL side.
SEES = {None: (3, 4), "security": (0, 1, 3, 4), "contractors": (3, 4), "slack:channel:C1": (1, 2, 3, 4)}


def sees(acl: str, group: str | None) -> str:
    """The SQL twin of visible() for one group (None: no context)."""
    return f"{acl} IN {SEES[group]}"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)

    def rows(df: DataFrame, kind: str, key: str, name: Column, summary: Column, number: Column) -> DataFrame:
        return df.select(F.concat(F.lit(kind + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("entity_type"), name.alias("name"), summary.alias("summary"), F.pmod(number, F.lit(5)).cast("int").alias("acl"))

    blank = F.lit("")
    parts = [
        rows(t("customer"), "customer", "c_custkey", F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")),
        rows(t("supplier"), "supplier", "s_suppkey", F.col("s_name"), blank, F.col("s_suppkey")),
        rows(t("part"), "part", "p_partkey", F.col("p_name"), F.concat_ws(" ", "p_brand", "p_type"), F.col("p_partkey")),
        rows(t("nation"), "nation", "n_nationkey", F.col("n_name"), blank, F.lit(3)),
        rows(t("region"), "region", "r_regionkey", F.col("r_name"), blank, F.lit(3)),
        rows(t("orders").select("o_orderpriority").distinct(), "priority", "o_orderpriority", F.col("o_orderpriority"), blank, F.lit(3)),
        rows(t("events").select("user_id").distinct(), "user", "user_id", F.concat(F.lit("user "), F.col("user_id").cast("string")), blank, F.col("user_id")),
        rows(t("events").select("event_type").distinct(), "event_type", "event_type", F.col("event_type"), blank, F.lit(3)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("visibility", policy_of(F.col("acl")))


def tenanted(df: DataFrame) -> DataFrame:
    """Rows of the model as those of two tenants, by their acl number."""
    return df.withColumn("group_id", F.when(F.col("acl") < 3, "north").otherwise("south"))


ENTITIES_SQL = """
entities AS (
  SELECT 'customer:' || c_custkey AS id, 'customer' AS entity_type, c_name AS name, c_mktsegment AS summary, CAST(c_custkey % 5 AS INTEGER) AS acl FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, '', CAST(s_suppkey % 5 AS INTEGER) FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, p_brand || ' ' || p_type, CAST(p_partkey % 5 AS INTEGER) FROM part
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, '', 3 FROM nation
  UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name, '', 3 FROM region
  UNION ALL SELECT DISTINCT 'priority:' || o_orderpriority, 'priority', o_orderpriority, '', 3 FROM orders
  UNION ALL SELECT DISTINCT 'user:' || user_id, 'user', 'user ' || user_id, '', CAST(user_id % 5 AS INTEGER) FROM events
  UNION ALL SELECT DISTINCT 'event_type:' || event_type, 'event_type', event_type, '', 3 FROM events
)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    start = F.lit(START).cast("timestamp_ntz")
    never = F.lit(None).cast("timestamp_ntz")
    text = lambda kind, c: F.concat(F.lit(kind + ":"), F.col(c).cast("string"))

    def rows(df: DataFrame, relation: str, key: Column, source: Column, target: Column, valid: Column, invalid: Column, confidence: Column, number: Column) -> DataFrame:
        return df.select(
            F.concat(F.lit(relation + ":"), key).alias("id"),
            source.alias("source"),
            F.lit(relation).alias("relation"),
            target.alias("target"),
            valid.alias("valid_at"),
            invalid.alias("invalid_at"),
            (valid + F.make_dt_interval(F.pmod(number, F.lit(7)).cast("int"))).cast("timestamp_ntz").alias("created_at"),
            confidence.cast("double").alias("confidence"),
            F.pmod(number, F.lit(5)).cast("int").alias("acl"),
        )

    orders = t("orders").withColumn("next", F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    events = t("events").withColumn("next", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    supplies = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("first"), F.round(1 - F.avg("l_discount"), 6).alias("sure"))
    k = F.get_json_object("props", "$.k").cast("double")
    pair = F.concat(F.col("l_suppkey").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"))
    parts = [
        rows(t("customer"), "located_in", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), text("customer", "c_custkey"), text("nation", "c_nationkey"), start, never, F.lit(1.0), F.col("c_custkey")),
        rows(t("supplier"), "located_in", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), text("supplier", "s_suppkey"), text("nation", "s_nationkey"), start, never, F.lit(1.0), F.col("s_suppkey")),
        rows(t("nation"), "part_of", F.col("n_nationkey").cast("string"), text("nation", "n_nationkey"), text("region", "n_regionkey"), start, never, F.lit(1.0), F.lit(3)),
        rows(supplies, "supplies", pair, text("supplier", "l_suppkey"), text("part", "l_partkey"), F.col("first"), never, F.col("sure"), F.col("l_suppkey") + F.col("l_partkey")),
        rows(orders, "has_priority", F.col("o_orderkey").cast("string"), text("customer", "o_custkey"), text("priority", "o_orderpriority"), F.col("o_orderdate"), F.col("next"), F.lit(0.9), F.col("o_orderkey")),
        rows(events, "last_did", F.col("event_id").cast("string"), text("user", "user_id"), text("event_type", "event_type"), F.col("ts"), F.col("next"), F.round(0.5 + k / 200, 6), F.col("event_id")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("fact_text", F.concat_ws(" ", "source", "relation", "target")).withColumn("visibility", policy_of(F.col("acl")))


def _fact_sql(relation: str, key: str, source: str, target: str, valid: str, invalid: str, confidence: str, number: str, rows: str) -> str:
    return f"SELECT '{relation}:' || {key} AS id, {source} AS source, '{relation}' AS relation, {target} AS target, {valid} AS valid_at, {invalid} AS invalid_at, {valid} + to_days(CAST(({number}) % 7 AS INTEGER)) AS created_at, CAST({confidence} AS DOUBLE) AS confidence, CAST(({number}) % 5 AS INTEGER) AS acl FROM {rows}"


_START, _NEVER = f"TIMESTAMP '{START}'", "CAST(NULL AS TIMESTAMP)"
FACTS_SQL = (
    "\nfacts AS (\n  SELECT *, source || ' ' || relation || ' ' || target AS fact_text FROM (\n  "
    + "\n  UNION ALL ".join(
        [
            _fact_sql("located_in", "'c' || c_custkey", "'customer:' || c_custkey", "'nation:' || c_nationkey", _START, _NEVER, "1.0", "c_custkey", "customer"),
            _fact_sql("located_in", "'s' || s_suppkey", "'supplier:' || s_suppkey", "'nation:' || s_nationkey", _START, _NEVER, "1.0", "s_suppkey", "supplier"),
            _fact_sql("part_of", "n_nationkey", "'nation:' || n_nationkey", "'region:' || n_regionkey", _START, _NEVER, "1.0", "3", "nation"),
            _fact_sql("supplies", "l_suppkey || ':' || l_partkey", "'supplier:' || l_suppkey", "'part:' || l_partkey", "first", _NEVER, "sure", "l_suppkey + l_partkey", "(SELECT l_suppkey, l_partkey, min(l_shipdate) AS first, round(1 - avg(l_discount), 6) AS sure FROM lineitem GROUP BY ALL)"),
            _fact_sql("has_priority", "o_orderkey", "'customer:' || o_custkey", "'priority:' || o_orderpriority", "o_orderdate", "next", "0.9", "o_orderkey", "(SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders)"),
            _fact_sql("last_did", "event_id", "'user:' || user_id", "'event_type:' || event_type", "ts", "next", "round(0.5 + CAST(json_extract_string(props, '$.k') AS DOUBLE) / 200, 6)", "event_id", "(SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)"),
        ]
    )
    + "\n  )\n)"
)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"), F.concat_ws(" ", "p_brand", "p_name").alias("alias"))
    people = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("entity_id"), F.regexp_replace("c_name", "#0+", " ").alias("alias"))
    return parts.unionByName(people)


ALIASES_SQL = """
aliases AS (
  SELECT 'part:' || p_partkey AS entity_id, p_brand || ' ' || p_name AS alias FROM part
  UNION ALL SELECT 'customer:' || c_custkey, regexp_replace(c_name, '#0+', ' ') FROM customer
)"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with the vector of the same number where there is one."""
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    key = F.col("doc_id")
    out = docs.join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return out.select(
        F.concat(F.lit("doc:"), key.cast("string")).alias("id"),
        F.col("text").alias("content"),
        F.col("source").alias("source_type"),
        key.cast("string").alias("source_id"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.pmod(key, F.lit(2000)).cast("int"))).cast("timestamp_ntz").alias("valid_at"),
        "embedding",
        F.pmod(key, F.lit(5)).cast("int").alias("acl"),
        policy_of(F.pmod(key, F.lit(5))).alias("visibility"),
    )


EPISODES_SQL = f"""
episodes AS (
  SELECT 'doc:' || doc_id AS id, text AS content, source AS source_type, CAST(doc_id AS VARCHAR) AS source_id,
         {_START} + to_days(CAST(doc_id % 2000 AS INTEGER)) AS valid_at, embedding, CAST(doc_id % 5 AS INTEGER) AS acl
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id
)"""

#: Kinds and statuses by a document's labels.
MEMORY_SQL = f"""
memory AS (
  SELECT 'mem:' || d.doc_id AS id, CASE WHEN toxic = 1 THEN 'risk' WHEN quality = 1 THEN 'decision' ELSE 'task' END AS kind,
         CASE WHEN quality = 1 THEN 'decided' ELSE 'parked' END AS status, source AS owner, lang AS subject, text AS summary,
         {_START} + to_days(CAST(d.doc_id % 2000 AS INTEGER)) AS valid_at, CASE WHEN quality = 1 THEN 0.9 ELSE 0.7 END AS confidence,
         CAST(d.doc_id % 5 AS INTEGER) AS acl
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
)"""


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    key = F.col("doc_id")
    return out.select(
        F.concat(F.lit("mem:"), key.cast("string")).alias("id"),
        F.when(F.col("toxic") == 1, "risk").when(F.col("quality") == 1, "decision").otherwise("task").alias("kind"),
        F.when(F.col("quality") == 1, "decided").otherwise("parked").alias("status"),
        F.col("source").alias("owner"),
        F.col("lang").alias("subject"),
        F.col("text").alias("summary"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.pmod(key, F.lit(2000)).cast("int"))).cast("timestamp_ntz").alias("valid_at"),
        F.when(F.col("quality") == 1, 0.9).otherwise(0.7).alias("confidence"),
        F.pmod(key, F.lit(5)).cast("int").alias("acl"),
        policy_of(F.pmod(key, F.lit(5))).alias("visibility"),
    )


def with_model(sql: str, *names: str) -> str:
    """SQL after the definitions that it names (default: entities and facts)."""
    parts = {"entities": ENTITIES_SQL, "facts": FACTS_SQL, "aliases": ALIASES_SQL, "episodes": EPISODES_SQL, "memory": MEMORY_SQL}
    return "WITH RECURSIVE " + ",".join(parts[n] for n in names or ("entities", "facts")) + sql
