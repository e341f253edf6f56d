"""Temporal query operators over facts with a validity interval and a transaction time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..security import Access, visible_rows


def moment(value) -> Column:
    """A timestamp without time zone from a Column or text."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


def is_current() -> Column:
    return F.col("invalid_at").isNull()


def holds_at(ts) -> Column:
    """Half-open: true from valid_at, and no longer at invalid_at."""
    return (F.col("valid_at") <= moment(ts)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > moment(ts)))


def overlaps(start, end) -> Column:
    """Closed at both ends."""
    return (F.col("valid_at") <= moment(end)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") >= moment(start)))


def with_endpoints(facts: DataFrame, entities: DataFrame, access: Access | None, entity_types: list[str] | None = None, relations: list[str] | None = None) -> DataFrame:
    """Visible facts with both visible endpoints' names and types."""
    seen = visible_rows(entities, access)
    side = lambda p: seen.select(F.col("id").alias(p), F.col("name").alias(f"{p}_name"), F.col("entity_type").alias(f"{p}_type"))
    rows = visible_rows(facts, access)
    if relations:
        rows = rows.filter(F.col("relation").isin(relations))
    out = rows.join(side("source"), "source").join(side("target"), "target")
    if entity_types:
        out = out.filter(F.col("source_type").isin(entity_types) | F.col("target_type").isin(entity_types))
    return out


def as_result(facts: DataFrame) -> DataFrame:
    """The columns of a fact in a result list."""
    return facts.select("id", "source", "relation", "target", "source_name", "target_name", F.col("confidence").alias("score"), "fact_text", "valid_at", "invalid_at")


def newest(facts: DataFrame, limit: int | None, column: str = "valid_at") -> DataFrame:
    return facts.orderBy(F.desc(column), "id").limit(limit) if limit else facts


def as_of(facts: DataFrame, entities: DataFrame, ts, access: Access | None, limit: int | None = 50, **filters) -> DataFrame:
    """Facts that hold at ts, the newest first."""
    return newest(as_result(with_endpoints(facts.filter(holds_at(ts)), entities, access, **filters)), limit)


def valid_during(facts: DataFrame, entities: DataFrame, start, end, access: Access | None, limit: int | None = 50, **filters) -> DataFrame:
    """Facts whose interval meets [start, end]."""
    return newest(as_result(with_endpoints(facts.filter(overlaps(start, end)), entities, access, **filters)), limit)


def changed_since(facts: DataFrame, entities: DataFrame, since, access: Access | None, limit: int | None = 50, **filters) -> DataFrame:
    """Facts recorded or invalidated since a time; one that was both counts as created."""
    seen = with_endpoints(facts, entities, access, **filters)
    created = seen.filter(F.col("created_at") >= moment(since)).withColumn("change", F.lit("created")).withColumn("changed_at", F.col("created_at"))
    ended = seen.filter((F.col("invalid_at") >= moment(since)) & (F.col("created_at") < moment(since))).withColumn("change", F.lit("invalidated")).withColumn("changed_at", F.col("invalid_at"))
    both = newest(created, limit, "changed_at").unionByName(newest(ended, limit, "changed_at"))
    return newest(both.select("id", "source", "relation", "target", "change", "changed_at", F.col("confidence").alias("score")), limit, "changed_at")


def entity_timeline(facts: DataFrame, entities: DataFrame, entity_id: str, access: Access | None, since=None, until=None, limit: int | None = None) -> DataFrame:
    """All facts that touch an entity, the oldest first, each superseded or current."""
    rows = facts.filter((F.col("source") == entity_id) | (F.col("target") == entity_id))
    if since is not None:
        rows = rows.filter(F.col("valid_at") >= moment(since))
    if until is not None:
        rows = rows.filter(F.col("valid_at") <= moment(until))
    out = as_result(with_endpoints(rows, entities, access)).withColumn("status", F.when(is_current(), "current").otherwise("superseded")).orderBy("valid_at", "id")
    return out.limit(limit) if limit else out


def contradictions(facts: DataFrame, entities: DataFrame, access: Access | None, since=None, limit: int | None = 50) -> DataFrame:
    """Pairs of an invalidated fact and a later one with the same source, relation and target, the latest invalidated first.

    With a limit only so many old facts, each with a later one, meet the others; without one all pairs are the result."""
    rows, keys = with_endpoints(facts, entities, access), ["source", "relation", "target"]
    old = _old(rows, since)
    if limit:
        onwards = Window.partitionBy(*keys).orderBy("valid_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
        old = _old(rows.withColumn("__onwards", F.count("*").over(onwards)).filter("__onwards > 1"), since).orderBy(F.desc("invalid_at"), "id").limit(limit)
    a, b = _sides(old, rows, keys)
    return _newest_pairs(a.join(b, keys).filter((F.col("new_id") != F.col("old_id")) & (F.col("new_valid_at") >= F.col("old_valid_at"))), limit)


def contradiction_counts(facts: DataFrame, entities: DataFrame, access: Access | None, since=None) -> DataFrame:
    """Every invalidated fact with the number of later facts of the same source, relation and target, and the next of them."""
    keys = ["source", "relation", "target"]
    later = Window.partitionBy(*keys).orderBy("valid_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    after = Window.partitionBy(*keys).orderBy("valid_at", "id")
    rows = with_endpoints(facts, entities, access).withColumn("next_id", F.lead("id").over(after)).withColumn("later", F.count("*").over(later) - 1)  # in this order one sort does for both
    return _old(rows, since).select("id", "relation", "invalid_at", "later", "next_id")


def contradictions_by_cardinality(facts: DataFrame, entities: DataFrame, relations: DataFrame, access: Access | None, since=None, limit: int | None = 50) -> DataFrame:
    """Pairs of an invalidated fact and the one that took its place under the relation's cardinality."""
    keyed = with_endpoints(facts, entities, access).join(relations.select(F.col("id").alias("relation"), "cardinality"), "relation")
    rows, keys = keyed.withColumn("key", cardinality_key()), ["relation", "key"]
    a, b = _sides(_old(rows, since), rows, keys)
    met = a.withColumn("new_valid_at", F.col("old_invalid_at")).join(b, [*keys, "new_valid_at"])
    return _newest_pairs(met.filter((F.col("new_id") != F.col("old_id")) & (F.col("new_valid_at") >= F.col("old_valid_at"))), limit)


def _old(rows: DataFrame, since) -> DataFrame:
    old = rows.filter(F.col("invalid_at").isNotNull())
    return old if since is None else old.filter(F.col("invalid_at") >= moment(since))


def _sides(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    return old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("id", "valid_at", "invalid_at")]), new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in ("id", "valid_at")])


def _newest_pairs(pairs: DataFrame, limit: int | None) -> DataFrame:
    out = pairs.select("old_id", "new_id", "relation", F.col("old_invalid_at").alias("invalidated_at"), "old_valid_at", "new_valid_at")
    return out.orderBy(F.desc("invalidated_at"), "old_id", "new_id").limit(limit) if limit else out


def cardinality_key() -> Column:
    """The key under which a relation's facts exclude each other."""
    c = F.col("cardinality")
    return F.when(c == "one_per_source", F.col("source")).when(c == "one_per_target", F.col("target")).otherwise(F.concat_ws("|", "source", "target"))


def supersede(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Validity intervals from facts as they were said: under an `always` policy the next fact of a key ends the one before,
    at its own valid_at; relations with other policies keep what they have.  Late facts fall into their place."""
    policy = relations.select(F.col("id").alias("relation"), "cardinality", "invalidation_policy")
    keyed = facts.join(policy, "relation", "left").withColumn("__key", cardinality_key())
    after = F.lead("valid_at").over(Window.partitionBy("relation", "__key").orderBy("valid_at", "id"))
    ended = F.when(F.col("invalidation_policy") == "always", F.coalesce("invalid_at", after)).otherwise(F.col("invalid_at"))
    return keyed.withColumn("invalid_at", ended).select(*facts.columns)


def get_facts(facts: DataFrame, access: Access | None, source: str | None = None, target: str | None = None, either: str | None = None, relation: str | None = None, ts=None, include_invalidated: bool = False, strict_as_of: bool = True) -> DataFrame:
    """Facts of an entity or a pair, the newest first.  strict_as_of: ts asks what held then; else only what had begun."""
    out = visible_rows(facts, access)
    for column, value in (("source", source), ("target", target), ("relation", relation)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if either is not None:
        out = out.filter((F.col("source") == either) | (F.col("target") == either))
    if ts is not None:
        out = out.filter(holds_at(ts) if strict_as_of else F.col("valid_at") <= moment(ts))
    if not include_invalidated and not (ts is not None and strict_as_of):
        out = out.filter(is_current())
    return out.orderBy(F.desc("valid_at"), "id")


def as_of_join(events: DataFrame, facts: DataFrame, left_key: str, ts: str, value: str = "target") -> DataFrame:
    """Each event with the value of its key's fact that held at the event's time (null: none).

    One sort of both sides by key and time, and the last fact before each event: no join on ranges.  Events without a key or
    a time stay out of it.
    """
    said = facts.select(F.col("source").alias(left_key), F.col("valid_at").alias("__at"), F.struct(F.col(value).alias("v"), F.col("invalid_at").alias("end")).alias("__fact"), F.lit(0).alias("__side"))
    known = F.col(left_key).isNotNull() & F.col(ts).isNotNull()
    asked = events.filter(known).withColumn("__at", F.col(ts)).withColumn("__side", F.lit(1))
    both = asked.unionByName(said, allowMissingColumns=True)
    last = F.last("__fact", ignorenulls=True).over(Window.partitionBy(left_key).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0))
    held = F.when(last["end"].isNull() | (last["end"] > F.col("__at")), last["v"])
    out = both.withColumn(value, held).filter("__side = 1").drop("__at", "__fact", "__side")
    return out.unionByName(events.filter(~known), allowMissingColumns=True)


def cleanup_candidates(episodes: DataFrame, facts: DataFrame, memory: DataFrame, now, days: int = 14, limit: int | None = 1000) -> DataFrame:
    """Ephemeral episodes (metadata.triage.retention) older than their ttl that no fact and no memory object rests on."""
    retention = F.get_json_object("metadata", "$.triage.retention")
    ttl = F.coalesce(F.get_json_object("metadata", "$.triage.ttlDays").cast("int"), F.lit(days))
    old = episodes.filter((retention == "ephemeral") & (F.col("valid_at") < (moment(now) - F.make_dt_interval(ttl)).cast("timestamp_ntz")))
    for rows in (facts, memory):
        used = rows.filter(F.col("episode_id").isNotNull()).select(F.col("episode_id").alias("id")).distinct()
        old = old.join(used, "id", "left_anti")
    out = old.orderBy("valid_at", "id")
    return out.limit(limit) if limit else out
