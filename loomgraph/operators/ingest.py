"""Ingest: normalized episodes, deduplication, known names, resolution of entities and facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vector import cosine, match_score, nearest_to_each
from ..indexes.trigrams import build
from ..security import visible_rows
from ..storage import first_per_key, new_folder, written
from .graph import first_n
from .temporal import cardinality_key, is_current

LEAD = 4  # first words of a known name by which texts and names meet
HELD_NAMES = 64 << 20  # bytes of known names that every task may hold
RELATIONS = 1000  # types of relations that are filtered by name
NEWEST = 10  # current facts under one key that a new fact is held against


def transcript(turns: DataFrame, key: str, order: str, speaker: str, text: str) -> DataFrame:
    """One episode for each conversation: its turns as lines, in order."""
    line = F.concat(F.coalesce(F.col(speaker), F.lit("unknown")), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), line.alias("line"))))
    return turns.groupBy(key).agg(F.concat_ws("\n", F.transform(lines, lambda s: s["line"])).alias("content"), F.count("*").alias("turns"))


def deduplicated(episodes: DataFrame, *order) -> DataFrame:
    """The first episode of each source key; those without a source id all stay."""
    keyed = episodes.filter("source_id is not null")
    return first_per_key(keyed, ["source_type", "source_id"], *order).unionByName(episodes.filter("source_id is null"))


def known_names(docs: DataFrame, names: DataFrame, key: str, text: str, most: int = HELD_NAMES) -> DataFrame:
    """Documents with the known names (alias, in analyzed words) that they hold, as whole words.

    Runs of a text's words and the names' first words (LEAD at most) meet by their digests, so that there is no product of all
    texts and names; the whole name is then looked up at that place.  Names of up to so many bytes go to the texts (most);
    of more names, only digests and places of runs are shuffled, and texts with a hit are read again.
    """
    led = names.select("alias").distinct().withColumn("all", F.split("alias", " ")).withColumn("led", F.xxhash64(F.slice("all", 1, LEAD)))
    sizes, held = led.agg(F.collect_set(F.least(F.size("all"), F.lit(LEAD))), F.sum(F.octet_length("alias") + 200)).first()  # LEAD sizes at most
    words = docs.select(key, X.words(F.coalesce(F.col(text), F.lit(""))).alias("w"))

    def digests(n: int) -> Column:
        return F.transform("w", lambda _, i: F.struct((i + 1).alias("i"), F.xxhash64(F.slice("w", i + 1, n)).alias("led")))  # shorter runs at the end

    # outer, as the other form evaluates the runs once more in a filter
    runs = words.select("*", F.explode_outer(F.concat(*[digests(n) for n in sorted(sizes) or [1]])).alias("run"))
    if (held or 0) <= most:
        found = runs.select(key, "w", "run.*").join(F.broadcast(led), "led")
    else:
        hits = runs.select(F.col(key).alias("__key"), "run.*").join(led, "led")
        found = hits.join(words, F.col("__key").eqNullSafe(F.col(key)))
    return found.filter(F.slice("w", F.col("i"), F.size("all")) == F.col("all")).select(key, "alias").distinct()


#: Similarities from which a match is a merge, or worth a look; how names and vectors count together; nearest
#: vectors that are looked at, and how near they must be without a likeness of the names; a fact that says the same.
MERGE, AMBIGUOUS, NAME_SHARE, VECTORS, VECTOR_ALONE, SAME_FACT = 0.9, 0.75, 0.4, 5, 0.8, 0.92


def resolve_entities(extracted: DataFrame, entities: DataFrame, aliases: DataFrame, least: float = 0.3) -> DataFrame:
    """Extracted (name, entity_type) rows with the known entity that they are.

    An alias or name that is equal (any case) and of the same type resolves at 0.95.  Else the best candidate of the type
    decides: 0.90 and above is a merge, 0.75 and above ambiguous (a new entity), below it a new one.  Candidates are the most
    alike name, if its trigrams are more alike than least, and, where both sides have an embedding, the five nearest
    entities: one whose name is more alike than least counts 0.4 of that and 0.6 of the cosine (if that is more), another
    one its cosine from 0.8 on.  Names are looked up in a trigram index, so that they meet by rare trigrams only.
    """
    vectors = "embedding" in extracted.columns and "embedding" in entities.columns
    rows = extracted.select("name", "entity_type").distinct()
    named = entities.select("id", "entity_type", F.lower("name").alias("key"))
    also = aliases.join(entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id").select(F.col("entity_id").alias("id"), "entity_type", F.lower("alias").alias("key"))
    known = named.unionByName(also).groupBy("entity_type", "key").agg(F.min("id").alias("exact"))
    rows = written(rows.withColumn("key", F.lower("name")).join(known, ["entity_type", "key"], "left"), "exact")
    open_ = rows.filter("exact is null")
    asked_kinds = F.broadcast(open_.select("entity_type").distinct())  # types of the ontology
    index = build(entities.select("id", "name", "entity_type").join(asked_kinds, "entity_type", "left_semi"), "id", "name", new_folder(entities.sparkSession, "trigrams"), "entity_type")
    found = index.best(open_, "name", least, "entity_type").select(F.col("kind").alias("entity_type"), "name", "id", "score")
    if vectors:
        asked = first_per_key(extracted.filter("embedding is not null").select("name", "entity_type", "embedding").join(open_.select("name", "entity_type"), ["name", "entity_type"], "left_semi"), ["name", "entity_type"], "embedding")
        asked = written(asked.withColumn("id", F.monotonically_increasing_id()), "asked")
        near_kinds = F.broadcast(asked.select("entity_type").distinct())  # types of the ontology
        held = entities.filter("embedding is not null").join(near_kinds, "entity_type", "left_semi").select("id", "entity_type", "name", "embedding")
        held = written(held.repartition(entities.sparkSession.sparkContext.defaultParallelism), "vectors")  # each task brings its nearest of every query
        near = nearest_to_each(asked, held.select("id", "entity_type", "embedding"), "id", "embedding", VECTORS, "entity_type")
        near = near.join(asked.select(F.col("id").alias("query"), "entity_type", "name"), "query").join(held.select("id", F.col("name").alias("known")), "id")
        t = X.similarity(F.col("name"), F.col("known"))
        both = near.withColumn("t", t).withColumn("score", F.when(F.col("t") > least, match_score(F.col("t"), F.col("similarity"))).when(F.col("similarity") >= VECTOR_ALONE, F.col("similarity")))
        found = found.unionByName(both.filter("score is not null").select("entity_type", "name", "id", "score"))
    best = first_per_key(found, ["name", "entity_type"], F.desc("score"), "id").select("name", "entity_type", F.col("id").alias("near"), "score")
    out = rows.join(best, ["name", "entity_type"], "left")
    score = F.when(F.col("exact").isNotNull(), 0.95).otherwise(F.coalesce("score", F.lit(0.0)))
    decision = F.when(F.col("exact").isNotNull() | (F.col("score") >= MERGE), "merge").when(F.col("score") >= AMBIGUOUS, "ambiguous").otherwise("new")
    return out.select("name", "entity_type", decision.alias("decision"), F.when(decision != "new", F.coalesce("exact", "near")).alias("entity_id"), score.alias("score"))


def of_relations(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Facts under the relations of new ones: those are named where they are few, so that tables of other relations aren't read."""
    used = new.select("relation").filter("relation is not null").distinct()
    names = [r.relation for r in used.limit(RELATIONS + 1).collect()]
    return facts.filter(F.col("relation").isin(names)) if len(names) <= RELATIONS else facts.join(used, "relation", "left_semi")


def resolve_facts(new: DataFrame, facts: DataFrame, relations: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """New facts (id, source, relation, target, fact_text) with what happens to each: skip, create or invalidate_existing.

    In this order: an unresolved endpoint skips; no current fact under the relation's key creates; the same text as one of
    the newest of them skips, and so does an embedding, where both sides have one, nearer than 0.92; a relation that never
    invalidates creates; one that always does ends the newest current facts of the key (NEWEST at most); others create.
    embeddings (vector, embedding): facts then name theirs in a column vector, and it is read for the facts that are compared only.
    """
    named = embeddings is not None
    vectors = named or ("embedding" in new.columns and "embedding" in facts.columns)
    policy = relations.select(F.col("id").alias("relation"), "cardinality", "invalidation_policy")
    keyed = lambda df: df.join(policy, "relation", "left").withColumn("key", cardinality_key())
    text = F.lower(F.trim("fact_text"))
    current = first_n(keyed(facts.filter(is_current())), ["relation", "key"], NEWEST, F.desc("valid_at"), "id")
    newest = current.select("relation", "key", text.alias("text"))
    rows = keyed(new).join(newest.groupBy("relation", "key").agg(F.count("*").alias("n")), ["relation", "key"], "left")
    rows = rows.withColumn("text", text).join(newest.distinct().withColumn("same", F.lit(True)), ["relation", "key", "text"], "left")
    said = F.col("same").isNotNull()
    if vectors:
        if named:
            rows = rows.join(embeddings, "vector", "left")
            current = current.join(keyed(new).select("relation", "key").distinct(), ["relation", "key"], "left_semi").join(embeddings, "vector")
        held = current.filter("embedding is not null").groupBy("relation", "key").agg(F.collect_list("embedding").alias("held"))  # NEWEST at most
        rows = rows.join(held, ["relation", "key"], "left")
        near = F.exists("held", lambda v: cosine(F.col("embedding"), v) > SAME_FACT)
        said = said | F.coalesce(near & F.col("embedding").isNotNull(), F.lit(False))
    action = (
        F.when(F.col("source").isNull() | F.col("target").isNull(), "skip")
        .when(F.col("n").isNull(), "create")
        .when(said, "skip")
        .when(F.col("invalidation_policy") == "never", "create")
        .when(F.col("invalidation_policy") == "always", "invalidate_existing")
        .otherwise("create")
    )
    return rows.select("id", action.alias("action"), F.when(action == "invalidate_existing", F.col("n")).otherwise(0).cast("long").alias("n_invalidated"))


def summary_lines(facts: DataFrame, most: int = 2000) -> DataFrame:
    """Per source entity, the texts of its facts as lines, the oldest first: the newest ones that fit into so many characters, and the
    newest one always.  A summary is read by whoever sees the entity, so only facts that anybody may see count.  Texts that
    differ in case or outer blanks only are one line, where it was said first."""
    rows = visible_rows(facts, None).filter(F.trim("fact_text") != "").withColumn("__key", F.lower(F.trim("fact_text")))
    one = rows.groupBy("source", "__key").agg(F.min(F.struct("valid_at", "id", "fact_text")).alias("first")).select("source", F.col("first.valid_at").alias("at"), F.col("first.id").alias("n"), F.col("first.fact_text").alias("line"))
    newest = [F.desc("at"), F.desc("n")]
    some = first_n(one, ["source"], most // 2 + 1, *newest)  # a line and its end have two characters at least
    along = Window.partitionBy("source").orderBy(*newest)
    size = F.sum(F.length("line") + 1).over(along.rowsBetween(Window.unboundedPreceding, 0))
    kept = some.withColumns({"size": size, "place": F.row_number().over(along)}).filter((F.col("size") <= most + 1) | (F.col("place") == 1))
    return kept.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("lines"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("at", "n", "line"))), lambda s: s["line"])).alias("summary"))


#: Days that an ephemeral text stays, the most signals and reasons of a decision, and those of a chunk that count.
TTL_DAYS, SIGNALS, REASONS, CHUNK_REASONS = 14, 20, 10, 2


def triaged(chunks: DataFrame, enabled: bool = True, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Chunks with retention, score, ttl_days, signals and reasons: all durable where triage is off, ephemeral where no judge is
    injected, else what the judge says; what it doesn't know is dropped."""
    if enabled and judge is not None:
        return judge(chunks).withColumn("retention", F.when(F.col("retention").isin("durable", "ephemeral", "drop"), F.col("retention")).otherwise("drop"))
    kept, score, days, signal, reason = ("ephemeral", 0.0, TTL_DAYS, "llm_required", "No LLM configured for triage.") if enabled else ("durable", 1.0, None, "triage_disabled", "Triage disabled by configuration.")
    return chunks.withColumns({"retention": F.lit(kept), "score": F.lit(score), "ttl_days": F.lit(days).cast("int"), "signals": F.array(F.lit(signal)), "reasons": F.array(F.lit(reason))})


def triage(scored: DataFrame, key: str, chars: str | None = None) -> DataFrame:
    """Chunk decisions (chunk, retention, score, ttl_days, signals, reasons) as one for each episode: any durable chunk makes it
    durable, else any ephemeral one ephemeral, else it is dropped; the score is the highest among the chunks that decide, the
    days the most of ephemeral ones.  Signals are those of all chunks as they come, after two fixed ones; reasons are two fixed
    ones and the first two of each chunk.  chars: a column with the episode's length, which a reason names (else it is the
    greatest that chunks give as their own: 0)."""
    durable, ephemeral = F.col("retention") == "durable", F.col("retention") == "ephemeral"
    length = F.max(chars) if chars else F.lit(0)
    some = lambda kind: F.max(F.when(kind, F.col("score")))
    out = scored.groupBy(key).agg(
        F.when(F.bool_or(durable), "durable").when(F.bool_or(ephemeral), "ephemeral").otherwise("drop").alias("retention"),
        F.coalesce(some(durable), some(ephemeral), F.greatest(F.max("score"), F.lit(0.0))).alias("score"),
        F.max(F.when(ephemeral, F.coalesce("ttl_days", F.lit(TTL_DAYS)))).alias("ttl_days"),
        F.count("*").alias("__chunks"), F.count_if(durable).alias("__durable"), F.count_if(ephemeral).alias("__ephemeral"), length.alias("__chars"),
    )
    said = F.when(F.col("retention") == "durable", "durable_chunk_found").when(F.col("retention") == "ephemeral", "ephemeral_chunk_found").otherwise("all_chunks_drop")
    base = ["triage_chunked", "durable_chunk_found", "ephemeral_chunk_found", "all_chunks_drop"]
    signals = scored.select(key, "chunk", F.posexplode("signals").alias("i", "signal")).groupBy(key, "signal").agg(F.min(F.struct("chunk", "i")).alias("at"))
    signals = first_n(signals, [key], SIGNALS, "at", "signal").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "signal"))).alias("__signals"))
    each = scored.select(key, "chunk", "retention", F.posexplode(F.slice("reasons", 1, CHUNK_REASONS)).alias("i", "reason"))
    each = first_n(each, [key], REASONS - 2, "chunk", "i").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "i", F.concat(F.lit("Chunk "), F.col("chunk"), F.lit(" "), F.col("retention"), F.lit(": "), F.col("reason")).alias("line")))).alias("__reasons"))
    n = lambda c: F.col(c).cast("string")
    whole = F.concat(F.lit("Large interaction ("), n("__chars"), F.lit(" chars) was triaged in "), n("__chunks"), F.lit(" connected chunks."))
    why = (
        F.when(F.col("retention") == "durable", F.concat(n("__durable"), F.lit(" chunk(s) contained durable organizational memory, so the full source is eligible for extraction.")))
        .when(F.col("retention") == "ephemeral", F.concat(n("__ephemeral"), F.lit(" chunk(s) contained short-lived context, but no chunk justified durable memory.")))
        .otherwise("All chunks were classified as low-value noise.")
    )
    none = F.array().cast("array<string>")
    own = F.filter(F.coalesce(F.transform("__signals", lambda s: s["signal"]), none), lambda s: ~((s == base[0]) | (s == said)))
    out = out.join(signals, key, "left").join(each, key, "left")
    return out.select(
        key,
        "retention",
        "score",
        F.when(F.col("retention") == "ephemeral", F.col("ttl_days")).alias("ttl_days"),
        F.slice(F.concat(F.array(F.lit(base[0]), said), own), 1, SIGNALS).alias("signals"),
        F.slice(F.concat(F.array(whole, why), F.coalesce(F.transform("__reasons", lambda s: s["line"]), none)), 1, REASONS).alias("reasons"),
    )
