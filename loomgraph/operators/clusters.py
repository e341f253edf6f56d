"""Clusters of entities and of relation labels that mean the same, and what a policy makes of them.

Candidates are pairs of equal or like names.  Stars are those of a greedy pass in
the order of ids: who isn't in an earlier star and has a candidate is a centre,
with all of its candidates as members.  A centre is thus a node without a smaller
centre beside it, which is found in rounds over all nodes at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import first_per_key, removed, written
from .graph import canonical_band, first_n, merge_entities, similar_names

MOST = 0.99


def alike_entities(entities: DataFrame, aliases: DataFrame, least: float = 0.82) -> DataFrame:
    """Pairs (a, b, score; a < b) of entities of one type, by the best similarity between any of their names and aliases.

    Names with equal tokens are one node: their entities pair with the smallest id among them only, which stands for
    all of them towards others."""
    named = entities.select("id", "entity_type", "name").unionByName(aliases.join(entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id").select(F.col("entity_id").alias("id"), "entity_type", F.col("alias").alias("name")))
    sets = named.select("id", "entity_type", F.array_sort(tokens(F.col("name"))).alias("t")).filter(F.size("t") > 0).distinct()
    nodes = written(sets.groupBy("entity_type", "t").agg(F.min("id").alias("head")), "name-sets")
    members = sets.join(nodes, ["entity_type", "t"])
    same = members.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    key = F.md5(F.concat_ws(" ", F.col("entity_type"), F.concat_ws(" ", "t")))
    keyed = nodes.select("entity_type", F.concat_ws(" ", "t").alias("name"), key.alias("id"), "head")
    like = similar_names(keyed.select("id", "entity_type", "name"), least)
    heads = keyed.select("id", "head")
    pairs = like.join(heads.select(F.col("id").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("id").alias("b"), F.col("head").alias("y")), "b")
    both = same.unionByName(pairs.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"), "score"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def alike_relations(facts: DataFrame, least: float = 0.78) -> DataFrame:
    """Pairs (a, b, score) of relation labels with like words."""
    labels = facts.select(F.col("relation").alias("id"), F.lit("").alias("entity_type"), F.regexp_replace("relation", "_", " ").alias("name")).distinct()
    sets = labels.select("id", F.array_sort(tokens(F.col("name"))).alias("t")).filter(F.size("t") > 0)
    first = sets.groupBy("t").agg(F.min("id").alias("head"))
    members = written(sets.join(first, "t").select("id", "head"), "labels")
    like = similar_names(labels, least)  # of one label for each set of words, which meet by their rare words only
    both = like.unionByName(members.select(F.col("head").alias("a"), F.col("head").alias("b"), F.lit(1.0).alias("score")).distinct())
    x, y = members.select(F.col("head").alias("a"), F.col("id").alias("x")), members.select(F.col("head").alias("b"), F.col("id").alias("y"))
    pairs = both.join(x, "a").join(y, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")
    return pairs.distinct()


def stars(pairs: DataFrame) -> DataFrame:
    """Stars of pairs (a, b, score): centre, member (the centre too) and the member's score (null for the centre)."""
    both = written(pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")), "pairs")
    smaller = both.filter("b < a").select("a", "b")
    state = written(both.select(F.col("a").alias("id")).distinct().withColumn("centre", F.lit(None).cast("boolean")), "stars")
    while not state.filter("centre is null").isEmpty():
        seen = smaller.join(state.select(F.col("id").alias("b"), "centre"), "b").groupBy(F.col("a").alias("id")).agg(F.bool_or(F.coalesce("centre", F.lit(False))).alias("beside"), F.count_if(F.col("centre").isNull()).alias("open"))
        now = F.when(F.col("centre").isNotNull(), F.col("centre")).when(F.col("beside"), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        before, state = state, written(state.join(seen, "id", "left").select("id", now.alias("centre")), "stars")
        removed(before)
    centres = state.filter("centre").select(F.col("id").alias("centre"))
    return centres.select("centre", F.col("centre").alias("member"), F.lit(None).cast("double").alias("score")).unionByName(both.join(centres, both["a"] == centres["centre"]).select("centre", F.col("b").alias("member"), "score"))


def entity_clusters(entities: DataFrame, aliases: DataFrame, least: float = 0.82) -> DataFrame:
    """Members of entity clusters: centre, member, canonical (most aliases, then the shortest name, then the smallest id),
    confidence (mean score, below one) and band."""
    found = stars(alike_entities(entities, aliases, least))
    counts = aliases.groupBy(F.col("entity_id").alias("member")).agg(F.count("*").alias("n"))
    named = found.join(entities.select(F.col("id").alias("member"), "name"), "member").join(counts, "member", "left")
    best = first_per_key(named, ["centre"], F.coalesce("n", F.lit(0)).desc(), F.length("name"), "member").select("centre", F.col("member").alias("canonical"))
    return _judged(found, best)


def relation_clusters(facts: DataFrame, least: float = 0.78) -> DataFrame:
    """Members of clusters of relation labels: as entity_clusters, with the shortest label as canonical."""
    found = stars(alike_relations(facts, least))
    best = first_per_key(found, ["centre"], F.length("member"), "member").select("centre", F.col("member").alias("canonical"))
    return _judged(found, best)


def _judged(found: DataFrame, best: DataFrame) -> DataFrame:
    sure = found.groupBy("centre").agg(F.least(F.lit(MOST), F.avg("score")).alias("confidence"))
    return found.join(best, "centre").join(sure, "centre").select("centre", "member", "canonical", "confidence", canonical_band(F.col("confidence")).alias("band"))


def relation_examples(facts: DataFrame, n: int = 3) -> DataFrame:
    """Each relation with the texts of its surest facts."""
    top = first_n(facts.select("relation", "confidence", "id", "fact_text"), ["relation"], n, F.desc("confidence"), "id")
    return top.groupBy("relation").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "id", "fact_text"))), lambda s: s["fact_text"]).alias("examples"))


def with_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every entity with its aliases in order (an empty list without any)."""
    lists = aliases.filter("alias is not null").groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return entities.join(lists, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def mapping_of(clusters: DataFrame) -> DataFrame:
    """What clusters that are sure enough replace: duplicate and canonical.  A member of several stars goes to the smallest centre's."""
    sure = clusters.filter("band = 'apply' and member <> canonical")
    one = first_per_key(sure, ["member"], "centre").select(F.col("member").alias("duplicate"), "canonical")
    return one.join(one.select(F.col("duplicate").alias("canonical")), "canonical", "left_anti").select("duplicate", "canonical")


def apply_entities(entities: DataFrame, facts: DataFrame, aliases: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities without duplicates, facts with rewritten endpoints, and the duplicates' names among the aliases.  Attributes, where
    entities have them, go to the canonical entity, which tells whom it stands for."""
    gone = entities.join(mapping, entities["id"] == mapping["duplicate"])
    more = gone.select(F.col("canonical").alias("entity_id"), F.col("name").alias("alias"))
    named = aliases.join(mapping.withColumnRenamed("duplicate", "entity_id"), "entity_id", "left").select(F.coalesce("canonical", "entity_id").alias("entity_id"), "alias")
    kept = entities.join(mapping.select(F.col("duplicate").alias("id")), "id", "left_anti")
    if "attributes" in entities.columns:
        told = F.map_from_entries(F.array(F.struct(F.lit("canonicalizedFrom").alias("key"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("value"))))
        entries = gone.select("canonical", "id", F.explode("attributes").alias("k", "v"))
        one = first_per_key(entries, ["canonical", "k"], F.desc("id")).groupBy(F.col("canonical").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("given"))
        extra = gone.groupBy(F.col("canonical").alias("id")).agg(told.alias("told"))
        none = F.create_map().cast("map<string,string>")
        new = F.map_concat(F.coalesce("given", none), F.coalesce("told", none))
        own = F.map_filter(F.coalesce("attributes", none), lambda k, v: ~F.map_contains_key(new, k))
        kept = kept.join(one, "id", "left").join(extra, "id", "left").withColumn("attributes", F.map_concat(own, new)).select(*entities.columns)
    return kept, merge_entities(facts, mapping), named.unionByName(more).distinct()


def apply_relations(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Facts with their relation's canonical label, and the label that they had."""
    m = mapping.select(F.col("duplicate").alias("relation"), F.col("canonical").alias("__to"))
    out = facts.join(m, "relation", "left").withColumn("relation_was", F.when(F.col("__to").isNotNull(), F.col("relation")))
    return out.withColumn("relation", F.coalesce("__to", "relation")).select(*facts.columns, "relation_was")
