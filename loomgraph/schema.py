"""The data model: struct types of the tables, and the seed ontology.

Episodes are immutable source texts; entities and facts are a graph whose facts
hold between valid_at and invalid_at (open: current) and were recorded at
created_at; memory objects are typed records.  All carry a visibility policy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())
ACL_ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("provider", "id", "type", "access", "name")])
VISIBILITY = T.StructType(
    [T.StructField(n, TEXTS) for n in ("allowedPrincipals", "deniedPrincipals", "allowedGroups", "deniedGroups")]
    + [T.StructField("classification", T.StringType()), T.StructField("inheritedFrom", T.StringType()), T.StructField("sourceSystem", T.StringType()), T.StructField("sourceAcl", T.ArrayType(ACL_ENTRY))]
)

KINDS = {"string": T.StringType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType()), "map<string:string>": T.MapType(T.StringType(), T.StringType())}


def _rows(fields: str) -> T.StructType:
    """A struct type from `name kind, ...`, and the policy; without a session."""
    pairs = [f.split() for f in fields.split(",")]
    return T.StructType([T.StructField(n, KINDS[k]) for n, k in pairs] + [T.StructField("visibility", VISIBILITY)])


EPISODES = _rows("group_id string, id string, content string, source_type string, source_id string, valid_at timestamp_ntz, created_at timestamp_ntz, metadata string, embedding array<float>")
ENTITIES = _rows("group_id string, id string, entity_type string, name string, summary string, attributes map<string:string>, embedding array<float>")
FACTS = _rows("group_id string, id string, source string, relation string, target string, fact_text string, valid_at timestamp_ntz, invalid_at timestamp_ntz, created_at timestamp_ntz, confidence double, episode_id string")
MEMORY = _rows("group_id string, id string, episode_id string, kind string, title string, summary string, owner string, subject string, status string, valid_at timestamp_ntz, created_at timestamp_ntz, confidence double")

#: Allowed kinds of the data model.
CARDINALITIES = ("many", "one_per_source", "one_per_target", "one_between_pair")
INVALIDATION = ("never", "always", "llm")
MEMORY_STATUSES = ("observed", "proposed", "decided", "rejected", "parked", "open", "in_progress", "done", "blocked", "unknown")

#: The relations of the bridge: cardinality and what a new fact does to older ones.
RELATIONS = [
    ("located_in", "one_per_source", "always"),
    ("part_of", "one_per_source", "always"),
    ("supplies", "many", "never"),
    ("has_priority", "one_per_source", "always"),
    ("last_did", "one_per_source", "always"),
]


def relation_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "id string, cardinality string, invalidation_policy string")


def own_or_default(rows: DataFrame, group_id: str) -> DataFrame:
    """Ontology rows of a group, with those of the default group where it has none of that id."""
    from .storage import first_per_key

    mine = F.when(F.col("group_id") == group_id, 0).otherwise(1)
    return first_per_key(rows.filter(F.col("group_id").isin(group_id, "default")), ["id"], mine)


def broken_rows(facts: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Facts with an unknown endpoint or relation, and which it is."""
    ids = entities.select(F.col("id").alias("e"))
    checks = [("source", ids, "e"), ("target", ids, "e"), ("relation", relations.select(F.col("id").alias("e")), "e")]
    parts = [facts.join(known, facts[column] == known[key], "left_anti").select("id", F.lit(column).alias("problem")) for column, known, key in checks]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
