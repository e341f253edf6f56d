"""What was extracted from a batch of episodes, merged, registered and written into the graph as one transformation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import first_per_key, written
from . import ingest as I
from .graph import first_n
from .normalize import normalize
from .temporal import is_current, supersede

SURE, AMBIGUOUS = 0.9, 0.75


def _parts(rows: DataFrame, needles: DataFrame) -> DataFrame:
    """rows (episode_id, low) with each different part of low that is as long as a needle (episode_id, low) of the episode: part."""
    lengths = needles.groupBy("episode_id").agg(F.collect_set(F.length("low")).alias("lengths"))  # as many as the longest name has characters
    each = rows.join(lengths, "episode_id").select(*rows.columns, F.explode("lengths").alias("n")).filter("n <= length(low)")
    cut = F.transform(F.sequence(F.lit(1), F.length("low") - F.col("n") + 1), lambda i: F.substring("low", i, F.col("n")))
    return each.select(*rows.columns, F.explode(F.array_distinct(cut)).alias("part"))


def _first_fit(model: DataFrame, found: DataFrame) -> DataFrame:
    """For found names (episode_id, low) the first name of the model (episode_id, low, name, entity_type) that holds them or that they
    hold: best.  A name's parts are met by equality, so that the work grows with the names, not with their pairs."""
    needle = lambda df: df.withColumnRenamed("low", "part")
    first = F.min(F.struct("name", "entity_type")).alias("best")
    known = model.groupBy("episode_id", "low").agg(first).select("episode_id", "low", "best.*")
    inside = _parts(known, found).join(needle(found), ["episode_id", "part"]).select("episode_id", F.col("part").alias("low"), "name", "entity_type")
    around = _parts(found, known).join(needle(known), ["episode_id", "part"]).select("episode_id", "low", "name", "entity_type")
    return inside.unionByName(around).groupBy("episode_id", "low").agg(first)


def merge_entities(model: DataFrame, found: DataFrame) -> DataFrame:
    """Entities (episode_id, name, entity_type, attributes map) of a model, and those that patterns found: one whose name holds
    the other's, in the same episode, gives its attributes to it; others are added unless the model has that name."""
    low = lambda c: F.lower(F.col(c))
    f = found.select("episode_id", F.col("name").alias("f_name"), F.col("entity_type").alias("f_type"), F.col("attributes").alias("f_attributes"), low("name").alias("low"))
    f = first_per_key(f, ["episode_id", "f_name"], "f_type", F.array_sort(F.map_entries("f_attributes")))
    m = model.select("episode_id", "name", "entity_type", low("name").alias("low")).filter("low is not null")
    fits = _first_fit(m, f.select("episode_id", "low").filter("low is not null").distinct())
    best = f.join(fits, ["episode_id", "low"], "left").withColumns({"fits": F.col("best").isNotNull(), "name": F.col("best.name"), "entity_type": F.col("best.entity_type")}).drop("low", "best")
    gives = F.col("fits") & F.col("f_attributes").isNotNull()
    entries = best.filter(gives).select("episode_id", "name", "entity_type", F.col("f_name"), F.explode("f_attributes").alias("k", "v"))
    given = first_per_key(entries, ["episode_id", "name", "entity_type", "k"], F.desc("f_name")).groupBy("episode_id", "name", "entity_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("more"))
    none = F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce("attributes", none), lambda k, v: ~F.coalesce(F.map_contains_key(F.coalesce(F.col("more"), none), k), F.lit(False)))
    kept = model.join(given, ["episode_id", "name", "entity_type"], "left").withColumn("attributes", F.map_concat(own, F.coalesce("more", none))).select(*model.columns)
    added = best.filter(~gives).select("episode_id", F.col("f_name").alias("name"), F.col("f_type").alias("entity_type"), F.col("f_attributes").alias("attributes"))
    known = model.select("episode_id", low("name").alias("__low")).distinct()
    added = added.withColumn("__low", low("name")).join(known, ["episode_id", "__low"], "left_anti").drop("__low")
    return kept.unionByName(added.select(*model.columns))


def merge_facts(model: DataFrame, found: DataFrame) -> DataFrame:
    """Facts (episode_id, source, relation, target, ...) of a model, and those found facts that it lacks (any case)."""
    keys = [F.lower(c).alias(f"__{c}") for c in ("source", "relation", "target")]
    known = model.select("episode_id", *keys).distinct()
    return model.unionByName(found.select("*", *keys).join(known, ["episode_id", "__source", "__relation", "__target"], "left_anti").select(*model.columns))


def humanized(x: Column) -> Column:
    """Blanks for underscores, and a capital at the start of each word."""
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def registered(types: DataFrame, used: DataFrame, group_id: str, defaults: dict | None = None) -> DataFrame:
    """Types (group_id, id, label, ...) with those that are used (id) and that the group lacks: a copy of the default group's row,
    or one with a humanized label and the given defaults."""
    fresh = used.select("id").filter("id is not null").distinct().join(types.filter(F.col("group_id") == group_id).select("id"), "id", "left_anti")
    shared = types.filter("group_id = 'default'").drop("group_id")
    rows = fresh.join(shared, "id", "left").withColumn("group_id", F.lit(group_id)).withColumn("label", F.coalesce("label", humanized(F.col("id"))))
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(name, F.lit(value)))
    return types.unionByName(rows.select(*types.columns))


def fact_times(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Facts without a time of their own hold from their episode's time on."""
    at = episodes.select(F.col("id").alias("episode_id"), F.col("valid_at").alias("__at"))
    return facts.join(at, "episode_id", "left").withColumn("valid_at", F.coalesce("valid_at", "__at")).drop("__at")


def context_lines(facts: DataFrame, entities: DataFrame, wanted: DataFrame, newest: int = 50, each: int = 3) -> DataFrame:
    """For entities (id) that a text names: a line with type, summary and their newest current facts, as context for a model."""
    rows = facts.filter(is_current()).withColumn("entity", F.explode(F.array_distinct(F.array("source", "target")))).join(wanted.select(F.col("id").alias("entity")).distinct(), "entity", "left_semi")
    names = entities.select(F.col("id"), F.col("name"))
    top = rows.select("id", "source", "relation", "target", "fact_text", "valid_at").distinct().orderBy(F.desc("valid_at"), "id").limit(newest)
    for side in ("source", "target"):
        top = top.join(names.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name")), side)
    line = F.concat_ws(" ", "source_name", "relation", "target_name", F.concat(F.lit("("), "fact_text", F.lit(")")))
    told = top.withColumn("entity", F.explode(F.array_distinct(F.array("source", "target")))).withColumn("line", line)
    told = first_n(told, ["entity"], each, F.desc("valid_at"), "id").groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("valid_at").cast("timestamp"))).alias("t"), "id", "line"))), lambda s: s["line"]), "; ").alias("facts"))
    out = entities.join(wanted.select("id").distinct(), "id", "left_semi").join(told, F.col("id") == F.col("entity"), "left")
    said = F.concat(F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit("): "), F.coalesce(F.nullif("summary", F.lit("")), F.lit("no summary")))
    return out.select("id", F.concat_ws("; facts: ", said, "facts").alias("line"))


@dataclass
class Batch:
    """What a batch adds: new episodes, entities, aliases and facts, and what became of every extracted fact."""

    episodes: DataFrame
    entities: DataFrame
    aliases: DataFrame
    facts: DataFrame
    decisions: DataFrame


def resolved_names(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Extracted (name, entity_type) rows with an entity id: a known one, or one made of group and name, the same for all
    spellings of a name in the batch that differ in case only."""
    found = I.resolve_entities(names, entities, aliases).select("name", "entity_type", "decision", "entity_id")
    made = F.concat(F.lit("new:"), F.md5(F.concat_ws("|", "entity_type", F.lower("name"))))
    return found.withColumn("id", F.when(F.col("decision") == "merge", F.col("entity_id")).otherwise(made))


def ingest_batch(stored: dict[str, DataFrame], episodes: DataFrame, entities: DataFrame, facts: DataFrame, relations: DataFrame) -> Batch:
    """A batch of episodes with what was extracted from them, against the stored tables (episodes, entities, aliases, facts).

    entities: episode_id, name, entity_type; facts: episode_id, source_name, source_type, relation, target_name,
    target_type, fact_text, confidence, valid_at.  All rows are handled as sets: names of one batch are resolved
    together, equal facts of one batch count once (the earliest stays), and the new facts take their place among
    the stored ones under their relations' policies.  Episodes that are stored already bring nothing.
    """
    clean = normalize(episodes)
    fresh = clean.select("source_type", "source_id").distinct().join(stored["episodes"].select("source_type", "source_id"), ["source_type", "source_id"], "left_anti")
    new_episodes = written(first_per_key(clean.join(fresh, ["source_type", "source_id"], "left_semi"), ["source_type", "source_id"], "valid_at", "id"), "episodes")
    of_new = lambda df: df.join(new_episodes.select(F.col("id").alias("episode_id")), "episode_id", "left_semi")
    said = of_new(facts)
    ends = said.select(F.col("source_name").alias("name"), F.col("source_type").alias("entity_type")).unionByName(said.select(F.col("target_name").alias("name"), F.col("target_type").alias("entity_type")))
    names = of_new(entities).select("name", "entity_type").unionByName(ends).filter("name is not null and entity_type is not null").distinct()
    found = written(resolved_names(names, stored["entities"], stored["aliases"]), "names")
    rows = found.filter("decision <> 'merge'").select("id", "entity_type", "name")
    new_entities = first_per_key(rows, ["id"], "name")
    also = rows.join(new_entities.select("id", F.col("name").alias("first")), "id").filter("name <> first").select(F.col("id").alias("entity_id"), F.col("name").alias("alias"))
    for side in ("source", "target"):
        ids = found.select(F.col("name").alias(f"{side}_name"), F.col("entity_type").alias(f"{side}_type"), F.col("id").alias(side))
        used = said.select(f"{side}_name", f"{side}_type").distinct()  # often few, so that their facts needn't meet by them
        said = said.join(ids.join(used, [f"{side}_name", f"{side}_type"], "left_semi"), [f"{side}_name", f"{side}_type"], "left")
    said = fact_times(said, new_episodes)
    said = said.withColumn("id", F.concat(F.lit("fact:"), F.md5(F.concat_ws("|", "source", "relation", "target", F.lower(F.trim("fact_text"))))))
    one = written(first_per_key(said, ["id"], "valid_at", "episode_id"), "said")
    held = I.of_relations(stored["facts"], one)  # others have no key of the new facts
    decided = written(I.resolve_facts(one, held, relations), "decided")
    kept = one.join(decided.filter("action <> 'skip'").select("id"), "id", "left_semi")
    columns = ["id", "source", "relation", "target", "fact_text", "valid_at", "confidence", "episode_id"]
    placed = supersede(held.select("id", "source", "relation", "target", "valid_at", "invalid_at").unionByName(kept.select("id", "source", "relation", "target", "valid_at").withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))), relations)
    new_facts = kept.select(*columns).join(placed.select("id", "invalid_at"), "id")
    return Batch(new_episodes, new_entities, also, new_facts, decided)
