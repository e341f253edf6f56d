"""Retrieval: ranked lists of one schema, fused by reciprocal ranks.

Every list has the columns type, id, pos (0-based), score, content, valid_at and
invalid_at; a list of several kinds puts them one block after the other, as they
stand.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vector import cosine, nearest
from ..indexes.postings import TextIndex
from ..indexes.trigrams import TrigramIndex
from ..indexes.vectors import VectorIndex
from ..operators import graph as G
from ..operators import temporal as T
from ..security import BYPASS, Access, visible_rows
from ..storage import first_per_key, written

COLUMNS = ["type", "id", "pos", "score", "content", "valid_at", "invalid_at"]
K = 60


def keyword_rank(rows: DataFrame, text: Column, query: str, broad: bool = True) -> DataFrame:
    """Rows that match, with rank: that of the query, or 0.65 of that of any of its words, whichever is more."""
    clauses, words = X.websearch(query), X.broad_terms(query)
    a = F.col("__terms")
    out = rows.withColumn("__terms", X.terms(text))
    strict = F.when(X.matches(a, clauses), X.rank_any(a, X.clause_terms(clauses))).otherwise(0.0)
    loose = F.when(F.arrays_overlap(a, F.array(*[F.lit(w) for w in words])), X.rank_any(a, words)).otherwise(0.0) if broad and words else F.lit(0.0)
    some = F.filter(F.array(F.greatest(strict, 0.65 * loose)), lambda r: r > 0)  # a filter would analyze the text once more for each use
    return out.select("*", F.explode(some).alias("rank")).drop("__terms")


def block(rows: DataFrame, kind: str, order: Column, score: Column, content: Column, limit: int | None, valid: Column | None = None, invalid: Column | None = None) -> DataFrame:
    """The best rows of one kind, with their place in the block."""
    never = F.lit(None).cast("timestamp_ntz")
    out = rows.select(F.lit(kind).alias("type"), "id", order.alias("__order"), score.alias("score"), content.alias("content"), (never if valid is None else valid).alias("valid_at"), (never if invalid is None else invalid).alias("invalid_at"))
    if limit:
        out = out.orderBy(F.desc("__order"), "id").limit(limit)
    return out


def as_list(*blocks: DataFrame) -> DataFrame:
    """Blocks one after the other, with places from 0."""
    out = None
    for n, b in enumerate(blocks):
        b = b.withColumn("__block", F.lit(n))
        out = b if out is None else out.unionByName(b)
    pos = F.row_number().over(Window.orderBy("__block", F.desc("__order"), "id")) - 1  # each block is a top-k
    return out.withColumn("pos", pos).select(COLUMNS)


def ranked(rows: DataFrame, *order) -> DataFrame:
    """A long list: places from 0 over ranges of the order, numbered side by side."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(parts.withColumns({"__part": F.spark_partition_id(), "__n": F.monotonically_increasing_id() % (1 << 33)}), "ranked")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("rows"))
    starts = sizes.select("__part", (F.sum("rows").over(Window.orderBy("__part")) - F.col("rows")).alias("start"))  # a row for each partition
    return parts.join(starts, "__part").withColumn("pos", F.col("start") + F.col("__n"))


def as_long_list(rows: DataFrame) -> DataFrame:
    """One block without a limit, with places from 0."""
    return ranked(rows, F.desc("__order"), "id").select(COLUMNS)


def fuse(lists: list[DataFrame]) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (60 + pos) by type and id, over the largest; the first list's fields."""
    both = None
    for n, rows in enumerate(lists):
        rows = rows.withColumn("__list", F.lit(n))
        both = rows if both is None else both.unionByName(rows)
    fields = F.min_by(F.struct("content", "valid_at", "invalid_at"), F.struct("__list", "pos"))
    fused = both.groupBy("type", "id").agg(F.sum(1.0 / (K + F.col("pos"))).alias("raw"), fields.alias("f"))
    most = fused.agg(F.max("raw").alias("most")).withColumn("__one", F.lit(1))  # one row
    return fused.withColumn("__one", F.lit(1)).join(F.broadcast(most), "__one").select("type", "id", (F.col("raw") / F.greatest("most", F.lit(0.001))).alias("score"), "f.*")


def recency(score: Column, valid_at: Column, now) -> Column:
    """Up to a tenth more for new rows, fading over a year; rows without a time keep their score."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(T.moment(now).cast("timestamp")) - F.unix_micros(valid_at.cast("timestamp"))) / 86_400e6)
    boost = 1 + 0.1 * F.greatest(F.lit(0.0), 1 - F.log(age + 1) / F.log(F.lit(365.0)))
    return F.when(valid_at.isNotNull(), score * boost).otherwise(score)


def true_at(ts) -> Column:
    """For fused rows: begun by ts and not ended; rows without times pass."""
    t = T.moment(ts)
    return (F.col("valid_at").isNull() | (F.col("valid_at") <= t)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t))


@dataclass
class Corpus:
    """The tables that a search reads."""

    entities: DataFrame
    facts: DataFrame
    episodes: DataFrame
    aliases: DataFrame | None = None
    communities: DataFrame | None = None
    #: Stored postings of entities, facts and episodes; tables without one are read whole.
    indexes: dict[str, TextIndex] = field(default_factory=dict)
    #: Stored vectors of entities, facts and episodes (approximate), and trigrams of entity names; tables without are read whole.
    vectors: dict[str, VectorIndex] = field(default_factory=dict)
    names: TrigramIndex | None = None
    #: The edges of the request's facts, where a search has made them for all its methods.
    edges: DataFrame | None = None


@dataclass
class Request:
    """What is asked: text, vector, time, filters, and how much."""

    query: str
    vector: list[float] | None = None
    now: str = "2024-01-01"
    as_of: str | None = None
    access: Access | None = None
    limit: int = 10
    offset: int = 0
    entity_types: list[str] = field(default_factory=list)
    relations: list[str] = field(default_factory=list)
    min_confidence: float | None = None
    min_fact_confidence: float | None = None
    methods: tuple[str, ...] = ("keyword", "semantic", "graph", "temporal")
    seeds: DataFrame | None = None


def _facts(c: Corpus, r: Request) -> DataFrame:
    out = visible_rows(c.facts, r.access).filter(T.is_current() if r.as_of is None else T.holds_at(r.as_of))
    if r.relations:
        out = out.filter(F.col("relation").isin(r.relations))
    return out.filter(F.col("confidence") >= r.min_fact_confidence) if r.min_fact_confidence is not None else out


def _entities(c: Corpus, r: Request) -> DataFrame:
    out = visible_rows(c.entities, r.access)
    return out.filter(F.col("entity_type").isin(r.entity_types)) if r.entity_types else out


def keyword_search(c: Corpus, r: Request) -> DataFrame:
    n = 2 * r.limit

    def ranks(rows: DataFrame, table: str, text: Column, most: int, broad: bool = True) -> DataFrame:
        if table not in c.indexes:
            return keyword_rank(rows, text, r.query, broad)
        return rows.join(c.indexes[table].search(r.query, broad, most, rows.select("id")), "id")

    e = ranks(_entities(c, r), "entities", F.concat_ws(" ", "name", "summary"), n, broad=False)
    f = ranks(_facts(c, r), "facts", F.col("fact_text"), n)
    d = ranks(visible_rows(c.episodes, r.access), "episodes", F.col("content"), min(n, 5))
    return as_list(
        block(e, "entity", F.col("rank"), F.col("rank"), F.concat_ws(": ", "name", "summary"), n),
        block(f, "fact", F.col("rank"), F.col("rank") * F.col("confidence"), F.col("fact_text"), n, F.col("valid_at"), F.col("invalid_at")),
        block(d, "episode", F.col("rank"), 0.7 * F.col("rank"), F.substring("content", 1, 500), min(n, 5), F.col("valid_at")),
    )


def semantic_search(c: Corpus, r: Request) -> DataFrame:
    """Nearest rows of every table that has vectors; the thresholds come after the limits."""
    n, blocks = 2 * r.limit, []
    for rows, kind, least, factor, content, most in ((_entities(c, r), "entity", 0.3, F.lit(1.0), F.concat_ws(": ", "name", "summary"), n), (_facts(c, r), "fact", 0.3, F.col("confidence"), F.col("fact_text"), n), (visible_rows(c.episodes, r.access), "episode", 0.28, F.lit(0.8), F.substring("content", 1, 1200), min(n, 8))):
        if "embedding" in rows.columns:
            stored = c.vectors.get({"entity": "entities", "fact": "facts", "episode": "episodes"}[kind])
            if stored is None:
                near = nearest(rows, "embedding", r.vector, most, least)
            else:
                asked = rows.sparkSession.createDataFrame([(0, r.vector)], "n int, v array<float>")
                best = stored.nearest(asked, "n", "v", most, allowed=rows.select("id")).select("id", "similarity")
                near = rows.join(best.filter(F.col("similarity") > least), "id")
            valid = F.col("valid_at") if "valid_at" in rows.columns else None
            blocks.append(block(near, kind, F.col("similarity"), F.col("similarity") * factor, content, None, valid))
    return as_list(*blocks)


def find_seeds(c: Corpus, r: Request, limit: int = 10) -> DataFrame:
    """Entities that a query names: by vector, by trigrams of the whole query, or by words; the best signal counts."""
    e = visible_rows(c.entities, r.access)
    if c.names is None:
        parts = [e.select("id", X.similarity(F.col("name"), F.lit(r.query)).alias("s")).filter("s > 0.2").select("id", (0.9 * F.col("s")).alias("score"))]
    else:
        alike = c.names.alike(e.sparkSession.createDataFrame([(r.query,)], "q string"), "q", 0.2)
        parts = [alike.join(e.select("id"), "id", "left_semi").select("id", (0.9 * F.col("score")).alias("score"))]
    if c.aliases is not None:
        also = c.aliases.join(e.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        parts.append(also.select(F.col("entity_id").alias("id"), X.similarity(F.col("alias"), F.lit(r.query)).alias("s")).filter("s > 0.2").select("id", (0.9 * F.col("s")).alias("score")))
    words = X.broad_terms(r.query, 1000)
    if words:
        a = X.terms(F.concat_ws(" ", "name", "summary"))
        parts.append(e.filter(F.arrays_overlap(a, F.array(*[F.lit(w) for w in words]))).select("id", (0.5 * X.rank_any(a, words)).alias("score")))
    if r.vector and "embedding" in e.columns:
        parts.append(e.filter("embedding is not null").select("id", cosine(F.col("embedding"), r.vector).alias("score")).filter("score > 0.3"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def _edges(c: Corpus, r: Request) -> DataFrame:
    return c.edges if c.edges is not None else G.edges_of(c.facts, c.entities, r.access, r.as_of, r.relations or None, r.min_fact_confidence)


def graph_search(c: Corpus, r: Request) -> DataFrame:
    start = r.seeds if r.seeds is not None else find_seeds(c, r)
    found = G.traverse(c.facts, _edges(c, r), start.select("id"), 3, 2 * r.limit)
    rows = found.join(c.facts.select("id", "fact_text", "valid_at", "invalid_at"), "id")
    return as_list(block(rows, "fact", F.col("score"), F.col("score"), F.col("fact_text"), None, F.col("valid_at"), F.col("invalid_at")))


def pagerank_search(c: Corpus, r: Request) -> DataFrame:
    start = r.seeds if r.seeds is not None else find_seeds(c, r)
    scores = G.pagerank(visible_rows(c.entities, r.access).select("id"), G.weighted(_edges(c, r)), start.select("id"))
    found = G.pagerank_results(scores, _facts(c, r), 2 * r.limit)
    rows = found.join(c.facts.select(F.lit("fact").alias("type"), "id", "fact_text", "valid_at", "invalid_at"), ["type", "id"], "left")
    rows = rows.withColumn("__order", F.col("score")).withColumn("content", F.coalesce("fact_text", "id"))
    return as_long_list(rows.select("type", "id", "__order", "score", "content", "valid_at", "invalid_at"))


#: Fixed value: days in which facts count as changed of late.
LATELY = 30


def _since(r: Request, window_days: int = LATELY) -> Column:
    return (T.moment(r.now) - F.make_dt_interval(F.lit(window_days))).cast("timestamp_ntz")


def temporal_search(c: Corpus, r: Request, window_days: int = LATELY) -> DataFrame:
    """What held at a time, or else what changed in the last days."""
    n = 2 * r.limit
    if r.as_of is not None:
        rows = T.as_of(c.facts, c.entities, r.as_of, r.access, n, entity_types=r.entity_types, relations=r.relations)
        return as_list(block(rows, "fact", F.col("valid_at").cast("timestamp").cast("double"), F.col("score"), F.col("fact_text"), None, F.col("valid_at"), F.col("invalid_at")))
    rows = T.changed_since(c.facts, c.entities, _since(r, window_days), r.access, n, entity_types=r.entity_types, relations=r.relations)
    rows = rows.join(c.facts.select("id", "fact_text", "valid_at", "invalid_at"), "id")
    return as_list(block(rows, "fact", F.col("changed_at").cast("timestamp").cast("double"), F.col("score"), F.col("fact_text"), None, F.col("valid_at"), F.col("invalid_at")))


def community_search(communities: DataFrame, vector: list[float], limit: int | None = 10, least: float = 0.12) -> DataFrame:
    """Communities (label, salience, embedding) nearest to a vector: 0.9 of the cosine and 0.1 of the salience over the largest."""
    most = communities.agg(F.max("salience").alias("most")).withColumn("__one", F.lit(1))  # one row
    rows = communities.filter("embedding is not null").withColumn("__one", F.lit(1)).join(F.broadcast(most), "__one").withColumn("cos", cosine(F.col("embedding"), vector)).filter((F.col("cos") >= least) & ~F.isnan("cos"))
    score = 0.9 * F.col("cos") + F.when(F.col("most") > 0, 0.1 * F.col("salience") / F.col("most")).otherwise(0.0)
    rows = rows.withColumn("score", score)
    return rows.orderBy(F.desc("score"), "label").limit(limit) if limit else rows


def community_list(c: Corpus, r: Request) -> DataFrame:
    """Communities as a list of entities; empty without communities or a vector."""
    rows = c.communities if c.communities is not None and r.vector is not None else None
    if rows is None:
        return as_list(block(c.entities.limit(0), "entity", F.lit(0.0), F.lit(0.0), F.col("name"), None))
    near = community_search(rows, r.vector, r.limit)
    text = F.col("summary") if "summary" in rows.columns else F.col("label")
    return as_list(block(near.withColumn("id", F.concat(F.lit("community:"), "label")), "entity", F.col("score"), F.col("score"), text, None))


METHODS = {"keyword": keyword_search, "semantic": semantic_search, "graph": graph_search, "pagerank": pagerank_search, "temporal": temporal_search, "community": community_list}


def _read_once(c: Corpus, r: Request) -> tuple[Corpus, Request]:
    """For methods over the graph, which read facts many times: what the caller sees of the entities, and of the facts of the time
    (and those changed of late), as written tables, and the edges."""
    facts = T.is_current() if r.as_of is None else T.holds_at(r.as_of)
    if r.as_of is None and "temporal" in r.methods:
        facts = facts | (F.col("created_at") >= _since(r)) | (F.col("invalid_at") >= _since(r))
    seen = lambda rows, name: written(visible_rows(rows, r.access).drop("visibility"), name)
    own = replace(c, entities=seen(c.entities, "entities"), facts=seen(c.facts.filter(facts), "facts"), episodes=visible_rows(c.episodes, r.access))
    asked = replace(r, access=BYPASS)
    return replace(own, edges=written(_edges(own, asked), "edges")), asked


def search(c: Corpus, r: Request) -> DataFrame:
    """All methods' lists fused, filtered by time and score, boosted for recency, and cut to the page asked for."""
    chosen = [m for m in METHODS if m in r.methods and (m != "semantic" or r.vector is not None)]
    if {"graph", "pagerank"} & set(chosen):
        c, r = _read_once(c, r)
        lists = [written(METHODS[m](c, r), m) for m in chosen]
    else:
        lists = [METHODS[m](c, r) for m in chosen]
    out = fuse(lists)
    if r.as_of is not None:
        out = out.filter(true_at(r.as_of))
    if r.min_confidence is not None:
        out = out.filter(F.col("score") >= r.min_confidence)
    out = out.withColumn("score", recency(F.col("score"), F.col("valid_at"), r.now))
    return out.orderBy(F.desc("score"), "type", "id").offset(r.offset).limit(r.limit)


#: What each intent of a question calls for.
INTENTS = {
    "fact": ("keyword", "semantic"),
    "relationship": ("graph", "pagerank", "semantic"),
    "temporal": ("temporal", "keyword"),
    "overview": ("pagerank", "semantic", "keyword"),
    "default": ("semantic", "keyword", "graph", "pagerank"),
}


def route(intent: str | None = None) -> tuple[str, ...]:
    """The methods for an intent that the caller has found; without one, the default."""
    return INTENTS.get(intent or "default", INTENTS["default"])


@dataclass
class SubQuery:
    question: str
    depends_on: tuple[int, ...] = ()


def run_plan(parts: list[SubQuery], ask, limit: int = 10, context_chars: int = 500) -> DataFrame:
    """Sub-questions in order; a dependent one is asked with the contents found before (cut to a few words).  The first row of
    each type and id stays, by score."""
    found: list[DataFrame] = []
    for p in parts:
        question = p.question
        if p.depends_on:
            known = [row["content"] or "" for i in p.depends_on if i < len(found) for row in found[i].select("content").limit(limit).collect()]
            question += f" (Context: {'; '.join(known)[:context_chars]})"
        found.append(ask(question).withColumn("__part", F.lit(len(found))))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return first_per_key(out, ["type", "id"], "__part").drop("__part").orderBy(F.desc("score"), "type", "id").limit(limit)


#: How source context is cut: windows around snippets, their reach, and what is shown where none is found.
WINDOWS, REACH, LEAD = 8, 1200, 2400


def snippet_window(content: Column, snippet: Column) -> Column:
    """The part of content around a snippet (any case; else around its first eight longer words side by side); null: not there."""
    low, said = F.lower(content), F.lower(snippet)
    longer = F.concat_ws(" ", F.slice(F.filter(F.split(said, r"\s+"), lambda w: F.length(w) > 3), 1, 8))
    at = F.when(F.trim(snippet) != "", F.position(said, low))
    at = F.when(at > 0, at).otherwise(F.when(longer != "", F.position(longer, low)))
    start = F.greatest(at - REACH, F.lit(1))
    return F.when(at > 0, F.trim(content.substr(start, at + F.length(snippet) + REACH - start)))


def expand_sources(hits: DataFrame, children: DataFrame, episodes: DataFrame, access: Access | None) -> DataFrame:
    """Source episodes of hits (id, score, and content if there is one), by children (id, episode_id): the best child's score
    and 0.35, and the windows around the contents of the best hits; the beginning where none of them is found."""
    said = F.col("content") if "content" in hits.columns else F.lit(None).cast("string")
    own = hits.select("id", "score", said.alias("snippet")).join(children, "id")
    best = own.groupBy("episode_id").agg(F.max("score").alias("best"))
    top = G.first_n(own.filter("snippet is not null"), ["episode_id"], WINDOWS, F.desc("score"), "id")
    snippets = top.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "snippet"))).alias("snippets"))
    rows = visible_rows(episodes, access).join(best.join(snippets, "episode_id", "left"), F.col("id") == F.col("episode_id"))
    parts = F.array_distinct(F.filter(F.transform("snippets", lambda s: snippet_window(F.col("content"), s["snippet"])), lambda w: w.isNotNull()))
    shown = F.array_join(F.transform(parts, lambda w, i: F.concat(F.lit("Source context window "), i + 1, F.lit(":\n"), w)), "\n\n")
    return rows.select("id", (F.col("best") + 0.35).alias("score"), F.when(F.size(parts) > 0, shown).otherwise(F.substring("content", 1, LEAD)).alias("content"))


#: What a kind of evidence adds to its score.
EVIDENCE = {"memory": 0.2, "episode": 0.28, "fact": 0.08, "entity": 0.0}


def worth(rows: DataFrame) -> Column:
    """What evidence is sorted by: its score and what its kind adds."""
    return F.col("score") + F.coalesce(*[F.when(F.col("type") == t, b) for t, b in EVIDENCE.items()], F.lit(0.0))


def evidence(rows: DataFrame, limit: int = 12) -> DataFrame:
    """The best evidence, by score and kind (worth); rows (list_no, pos, type, id, score, content) count once, at their first place."""
    return first_per_key(rows, ["type", "id"], "list_no", "pos").withColumn("worth", worth(rows)).orderBy(F.desc("worth"), "type", "id").limit(limit)


def citations(rows: DataFrame, limit: int = 12) -> DataFrame:
    """Citations C1, C2, ... of facts, episodes and memory objects, in the order of their worth (else of their score)."""
    by = [F.desc("worth" if "worth" in rows.columns else "score"), F.col("type"), F.col("id")]
    top = rows.filter(F.col("type").isin("fact", "episode", "memory")).orderBy(*by).limit(limit)
    return top.withColumn("citation", F.concat(F.lit("C"), F.row_number().over(Window.orderBy(*by))))  # limit rows at most


def extractive_answer(cited: DataFrame, quotes: int = 5) -> DataFrame:
    """One row: the first citations' quotes (their contents where they have none) with their names, and the mean of their own
    confidence, or else of their score; one without either counts half."""
    has = lambda c: F.col(c) if c in cited.columns else F.lit(None)
    first = cited.withColumn("n", F.substring("citation", 2, 9).cast("int")).filter(F.col("n") <= quotes)
    first = first.withColumns({"said": F.coalesce(F.nullif(has("quote").cast("string"), F.lit("")), "content"), "sure": F.coalesce(has("confidence").cast("double"), "score", F.lit(0.5))})
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "said", "citation"))), lambda s: F.concat(s["said"], F.lit(" ["), s["citation"], F.lit("]")))
    return first.agg(F.concat_ws(" ", lines).alias("answer"), F.round(F.avg("sure"), 3).alias("confidence"))
