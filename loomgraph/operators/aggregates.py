"""Aggregates over the graph and the extraction log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import first_n
from .temporal import is_current, moment


def endpoints(facts: DataFrame) -> DataFrame:
    """Each fact once for each different entity that it touches: an equi-join key in place of `source = e OR target = e`."""
    ends = F.array_distinct(F.array("source", "target"))
    return facts.withColumn("entity_id", F.explode(ends))


def entity_summary(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Per entity: current facts, all facts, and the latest valid_at."""
    per = endpoints(facts).groupBy(F.col("entity_id").alias("id")).agg(F.sum(is_current().cast("long")).alias("current_facts"), F.count("*").alias("total_facts"), F.max("valid_at").alias("last_fact_at"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return entities.select("id", "entity_type", "name").join(per, "id", "left").select("id", "entity_type", "name", zero("current_facts"), zero("total_facts"), "last_fact_at")


def extraction_stats(log: DataFrame, since) -> DataFrame:
    """Counts by method since a time, and the share that needed no model."""
    rows = log.filter(F.col("created_at") >= moment(since))
    count = lambda m: F.count_if(F.col("method") == m).alias(m)
    out = rows.agg(F.count("*").alias("total"), count("deterministic"), count("llm"), count("hybrid"))
    return out.withColumn("deterministic_rate", F.when(F.col("total") > 0, F.round(F.col("deterministic") / F.col("total"), 6)).otherwise(0.0))


def top_patterns(log: DataFrame, column: str = "input_text", width: int = 100, limit: int = 10) -> DataFrame:
    """The commonest beginnings."""
    return log.groupBy(F.substring(column, 1, width).alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(limit)


def suggest_types(extracted: DataFrame, least: int = 3, examples: int = 5) -> DataFrame:
    """Types found often enough among extracted (entity_type, name) rows, with the first names."""
    counts = extracted.groupBy("entity_type").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    names = extracted.filter("name is not null").select("entity_type", "name").distinct()
    some = first_n(names, ["entity_type"], examples, "name").groupBy("entity_type").agg(F.concat_ws("|", F.array_sort(F.collect_list("name"))).alias("examples"))
    return counts.join(some, "entity_type", "left").select("entity_type", "n", F.coalesce("examples", F.lit("")).alias("examples"))


def sure_and_newest(log: DataFrame, least: float = 0.7, limit: int = 500) -> DataFrame:
    """The newest model-made rows of an extraction log that are surer than that, whose types suggest_types looks at."""
    return log.filter((F.col("method") == "llm") & (F.col("confidence") > least)).orderBy(F.desc("created_at"), "id").limit(limit)


def improvement_proposals(extracted: DataFrame, reviews: DataFrame) -> DataFrame:
    """Proposals with the confidence that their number of cases gives."""
    by_type = extracted.groupBy(F.col("entity_type").alias("subject")).agg(F.count("*").alias("n")).select(F.lit("extraction").alias("kind"), "subject", "n", F.least(F.lit(0.9), 0.5 + F.col("n") / 20).alias("confidence"))
    by_review = lambda kind, rows, step: rows.select(F.lit(kind).alias("kind"), "subject", "n", F.least(F.lit(0.85), 0.45 + F.col("n") / step).alias("confidence"))
    by_reason = reviews.groupBy(F.concat_ws(":", "type", "reason").alias("subject")).agg(F.count("*").alias("n"))
    by_kind = reviews.groupBy(F.col("type").alias("subject")).agg(F.count("*").alias("n"))
    return by_type.unionByName(by_review("review", by_reason, 20)).unionByName(by_review("policy", by_kind, 25))


def graph_nodes(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Exported nodes with the first 300 characters of their summary and their degree."""
    degree = endpoints(facts.filter(is_current())).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("degree"))
    return entities.select("id", "entity_type", "name", F.substring("summary", 1, 300).alias("summary")).join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def graph_links(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exported current links between exported nodes."""
    ids = nodes.select("id")
    links = facts.filter(is_current())
    for side in ("source", "target"):
        links = links.join(ids.withColumnRenamed("id", side), side, "left_semi")
    return links.select("id", "source", "target", "relation", "confidence")


def fact_cube(facts: DataFrame) -> DataFrame:
    """Counts and mean confidence by relation and year, with subtotals (ALL and 0)."""
    out = facts.withColumn("year", F.year("valid_at")).cube("relation", "year").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return out.withColumns({"relation": F.coalesce("relation", F.lit("ALL")), "year": F.coalesce("year", F.lit(0))})
