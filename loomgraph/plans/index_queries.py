"""Registered queries over stored indexes: postings, vectors, trigrams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from .. import bridge
from ..bridge import sees, with_model
from ..indexes import communities as C
from ..indexes import postings as P
from ..indexes import trigrams as G
from ..indexes import vectors as V
from ..operators import ingest as I
from ..schema import relation_types
from ..security import visible
from ..storage import new_folder, table
from .flow_queries import EXTRACTED_SQL, NEW_FACTS_SQL, new_facts
from .retrieval import community_search
from .search_queries import FACT_QUERY, LPA_ROUNDS, NAME, lpa_sql, probe, rank_sql, terms_sql, trigrams_sql
from .search_queries import ORACLES as SEARCH_SQL
from .temporal_queries import SECURITY

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ postings


@query(SEARCH_SQL["keyword_facts"])
def postings_facts(spark, sf_dir):
    """keyword_facts from stored postings."""
    facts = bridge.facts(spark, sf_dir)
    index = P.build(facts, "id", F.col("fact_text"), new_folder(spark, "postings"))
    rows = facts.filter("invalid_at is null").filter(visible("visibility", SECURITY)).select("id", "confidence")
    found = index.search(FACT_QUERY, allowed=rows).join(rows, "id")
    return found.select("id", F.round(F.col("rank") * F.col("confidence"), 6).alias("score"))


@query(SEARCH_SQL["keyword_episodes"])
def postings_episodes(spark, sf_dir):
    """keyword_episodes, with its negation, from stored postings."""
    docs = bridge.episodes(spark, sf_dir)
    index = P.build(docs, "id", F.col("content"), new_folder(spark, "postings"))
    found = index.search("worthless then -pathetic", broad=False, allowed=docs.filter(visible("visibility", SECURITY)))
    return found.select("id", F.round(0.7 * F.col("rank"), 6).alias("score"))


PHRASES = '"thanedble anea" or "de la" -les'


@query(
    with_model(f""", t AS (SELECT id, {terms_sql("content")} AS a, ' ' || array_to_string({terms_sql("content")}, ' ') || ' ' AS line FROM episodes WHERE {sees("acl", "security")})
SELECT id, round({rank_sql("a", ["thanedble", "anea", "de", "la"])}, 6) AS score FROM t WHERE (contains(line, ' thanedble anea ') OR contains(line, ' de la ')) AND NOT contains(line, ' les ')""", "episodes")
)
def postings_phrases(spark, sf_dir):
    """Alternatives of two phrases and a word that must be absent, from places in the postings."""
    docs = bridge.episodes(spark, sf_dir)
    index = P.build(docs, "id", F.col("content"), new_folder(spark, "postings"))
    found = index.search(PHRASES, broad=False, allowed=docs.filter(visible("visibility", SECURITY)))
    return found.select("id", F.round("rank", 6).alias("score"))


TOP_WORDS = "thanedble anea ntre"


@query(f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, {terms_sql("text")} AS a FROM documents),
r AS (SELECT id, greatest(CASE WHEN list_has_all(a, ['thanedble', 'anea', 'ntre']) THEN {rank_sql("a", ["thanedble", "anea", "ntre"])} ELSE 0 END, 0.65 * {rank_sql("a", ["thanedble", "anea", "ntre"])}) AS rank FROM t)
SELECT id, round(rank, 6) AS score FROM r WHERE rank > 0 ORDER BY rank DESC, id LIMIT 25""")
def postings_top(spark, sf_dir):
    """The best 25 documents, with blocks skipped whose bound is below the last of them."""
    index = P.build(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), new_folder(spark, "postings"), block=128)
    return index.search(TOP_WORDS, limit=25).select("id", F.round("rank", 6).alias("score"))


STEMMED = "urgently supplying priorities"


def _stemmed_rank() -> str:
    """The rank over the stems of STEMMED: urgent, suppli, prioriti; each with the forms that facts may hold."""
    forms = [["urgent", "urgently"], ["supply", "supplies", "supplied", "supplying"], ["priority", "priorities"]]
    one = lambda f: f"0.1 * coalesce(list_sum(list_transform(range(1, len(list_filter(a, lambda w: list_contains({f!r}, w))) + 1), lambda j: 1.0::DOUBLE / (j * j))), 0) / {P.X.BASIS}"
    return "(" + " + ".join(map(one, forms)) + ") / 3"


@query(with_model(f", t AS (SELECT id, {terms_sql('fact_text')} AS a FROM facts) SELECT id, round(0.65 * {_stemmed_rank()}, 6) AS score FROM t WHERE {_stemmed_rank()} > 0", "facts"))
def postings_english(spark, sf_dir):
    """Facts by stems: priorities finds has_priority, supplying finds supplies."""
    index = P.build(bridge.facts(spark, sf_dir), "id", F.col("fact_text"), new_folder(spark, "postings"), analyzer="english")
    return index.search(STEMMED).select("id", F.round("rank", 6).alias("score"))


# ------------------------------------------------------------------ trigrams, and vectors in resolution


@query(SEARCH_SQL["trigram_find_entity"])
def trigram_index_entity(spark, sf_dir):
    """trigram_find_entity from stored trigram postings."""
    e = bridge.entities(spark, sf_dir)
    index = G.build(e, "id", "name", new_folder(spark, "trigrams"))
    found = index.alike(spark.createDataFrame([(NAME,)], "q string"), "q", 0.2)
    seen = e.filter(visible("visibility", SECURITY)).select("id", F.col("name").alias("n"))
    return found.join(seen, "id").select("id", F.col("n").alias("name"), F.round("score", 6).alias("similarity"))


@query(
    f"""WITH {EXTRACTED_SQL}, known AS (SELECT 'customer:' || c_custkey AS id, c_name, {trigrams_sql("c_name")} AS h, embedding::DOUBLE[] AS v FROM customer LEFT JOIN embeddings ON vec_id = c_custkey),
own AS (SELECT name, min(c_custkey) AS k FROM extracted JOIN customer ON name IN (upper(c_name), c_name || ' inc', 'unknown ' || c_mktsegment) AND name = CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 3 = 1 THEN c_name || ' inc' ELSE 'unknown ' || c_mktsegment END GROUP BY name),
x AS (SELECT e.name, {trigrams_sql("e.name")} AS g, embedding::DOUBLE[] AS v, (SELECT min(id) FROM known k WHERE lower(k.c_name) = lower(e.name)) AS exact FROM extracted e JOIN own USING (name) LEFT JOIN embeddings ON vec_id = own.k),
p AS (SELECT x.name, k.id, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS t, list_cosine_similarity(x.v, k.v) AS c FROM x JOIN known k ON x.exact IS NULL),
n AS (SELECT name, id FROM p WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(c, 9) DESC, id) <= 5),
s AS (SELECT name, id, t AS s FROM p WHERE t > 0.3 UNION ALL SELECT name, id, CASE WHEN t > 0.3 THEN greatest(t, 0.4 * t + 0.6 * c) ELSE c END FROM p JOIN n USING (name, id) WHERE t > 0.3 OR c >= 0.8),
b AS (SELECT name, id, s FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(s, 9) DESC, id) = 1)
SELECT x.name, CASE WHEN exact IS NOT NULL OR s >= 0.9 THEN 'merge' WHEN s >= 0.75 THEN 'ambiguous' ELSE 'new' END AS decision, CASE WHEN exact IS NOT NULL THEN exact WHEN s >= 0.75 THEN id END AS entity_id,
round(CASE WHEN exact IS NOT NULL THEN 0.95 ELSE coalesce(s, 0) END, 5) AS score FROM x LEFT JOIN b ON b.name = x.name"""
)
def resolve_entities_vectors(spark, sf_dir):
    """Extracted customers against all entities, by names and vectors: a customer has the vector of its number, and an extracted
    name that of the first customer it stands for."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    k = F.col("k")
    name = F.when(k % 3 == 0, F.upper("c_name")).when(k % 3 == 1, F.concat("c_name", F.lit(" inc"))).otherwise(F.concat(F.lit("unknown "), "c_mktsegment"))
    extracted = c.groupBy(name.alias("name")).agg(F.min("k").alias("k")).join(vectors, "k", "left").withColumn("entity_type", F.lit("customer")).drop("k")
    known = bridge.entities(spark, sf_dir).withColumn("k", F.when(F.col("entity_type") == "customer", F.substring_index("id", ":", -1).cast("long"))).join(vectors, "k", "left")
    return I.resolve_entities(extracted, known, bridge.aliases(spark, sf_dir)).select("name", "decision", "entity_id", F.round("score", 5).alias("score"))


@query(
    with_model(
        NEW_FACTS_SQL.split("cur AS (")[0]
        + """vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
held AS (SELECT f.*, v FROM facts f LEFT JOIN vec ON vec_id = length(f.id) * 7 % 50 WHERE invalid_at IS NULL),
cur AS (SELECT relation, CASE WHEN relation = 'supplies' THEN source || '|' || target ELSE source END AS key, count(*) AS n, list(lower(fact_text)) AS texts, list(v) FILTER (WHERE v IS NOT NULL) AS vs FROM (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY relation, CASE WHEN relation = 'supplies' THEN source || '|' || target ELSE source END ORDER BY valid_at DESC, id) <= 10) GROUP BY ALL),
r AS (SELECT new.*, n, texts, vs, v, new.source || ' ' || new.relation || ' ' || new.target AS fact_text FROM new LEFT JOIN vec ON vec_id = length(new.id) * 9 % 50 LEFT JOIN cur ON cur.relation = new.relation AND cur.key = CASE WHEN new.relation = 'supplies' THEN new.source || '|' || coalesce(new.target, '') ELSE new.source END),
a AS (SELECT id, n, CASE WHEN source IS NULL OR target IS NULL THEN 'skip' WHEN n IS NULL THEN 'create' WHEN list_contains(texts, lower(fact_text)) THEN 'skip' WHEN len(list_filter(vs, lambda w: list_cosine_similarity(w, v) > 0.92)) > 0 THEN 'skip' WHEN relation = 'supplies' THEN 'create' ELSE 'invalidate_existing' END AS action FROM r)
SELECT id, action, CASE WHEN action = 'invalidate_existing' THEN n ELSE 0 END AS n_invalidated FROM a"""
    )
)
def resolve_facts_vectors(spark, sf_dir):
    """resolve_facts with vectors (here by the length of a fact's id), of which near ones say the same."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector"), "embedding")
    naming = lambda rows, times: rows.withColumn("vector", (F.length("id") * times % 50).cast("long"))
    return I.resolve_facts(naming(new_facts(spark, sf_dir), 9), naming(bridge.facts(spark, sf_dir), 7), relation_types(spark), vectors)


# ------------------------------------------------------------------ vectors


@query()
def vector_index_neighbours(spark, sf_dir):
    """vector_neighbours from inverted lists and product codes: approximate (the tests hold its recall against the exact query),
    with exact similarities."""
    rows = table(spark, sf_dir, "embeddings")
    index = V.build(rows, "vec_id", "embedding", new_folder(spark, "vectors"))
    found = index.nearest(rows.filter("vec_id % 100 = 0"), "vec_id", "embedding")
    return found.select("query", F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


@query(SEARCH_SQL["vector_neighbours"])
def vector_index_all_lists(spark, sf_dir):
    """The same index with every list probed and every candidate compared, which is exact."""
    rows = table(spark, sf_dir, "embeddings")
    index = V.build(rows, "vec_id", "embedding", new_folder(spark, "vectors"), lists=16)
    found = index.nearest(rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", probes=16, rerank=rows.count())
    return found.select("query", F.col("id").alias("vec_id"), F.round("similarity", 5).alias("similarity"))


# ------------------------------------------------------------------ communities


def entities_with_vectors(spark, sf_dir):
    """Customers, suppliers and parts with the vectors of their numbers."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("k"), "embedding")
    rows = bridge.entities(spark, sf_dir).withColumn("k", F.when(F.col("entity_type").isin("customer", "supplier", "part"), F.substring_index("id", ":", -1)))
    return rows.join(vectors, "k", "left").drop("k")


@query(
    with_model(
        lpa_sql(LPA_ROUNDS)
        + f""", c AS (SELECT id, label FROM l{LPA_ROUNDS}),
s AS (SELECT label, count(*) AS size FROM c GROUP BY label HAVING count(*) > 1),
i AS (SELECT a.label, sum(l.confidence) AS x FROM links l JOIN c a ON a.id = l.source JOIN c b ON b.id = l.target WHERE a.label = b.label GROUP BY a.label),
v AS (SELECT label, n, avg(x) AS x FROM (SELECT c.label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS n FROM c JOIN embeddings ON c.id IN ('customer:' || vec_id, 'supplier:' || vec_id, 'part:' || vec_id)) GROUP BY ALL),
m AS (SELECT label, list(x ORDER BY n) AS v FROM v GROUP BY label),
r AS (SELECT s.label, size, ln(1 + size) + ln(1 + coalesce(x, 0)) AS salience, list_cosine_similarity(m.v, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS cos FROM s LEFT JOIN i ON i.label = s.label LEFT JOIN m ON m.label = s.label)
SELECT label, size, size AS n_members, round(0.9 * cos + 0.1 * salience / (SELECT max(salience) FROM r), 5) AS score FROM r WHERE cos >= 0.01"""
    )
)
def stored_community_search(spark, sf_dir):
    """All stored communities near a vector, as one access sees them, with the members that are stored for them."""
    stored = C.StoredCommunities(spark, new_folder(spark, "communities"))
    rows, members = stored.of(entities_with_vectors(spark, sf_dir), bridge.facts(spark, sf_dir), SECURITY, datetime(2001, 8, 1))
    near = community_search(rows, probe(spark, sf_dir), limit=None, least=0.01)
    counted = members.groupBy("label").agg(F.count("*").alias("n_members"))
    return near.join(counted, "label").select("label", "size", "n_members", F.round("score", 5).alias("score"))
