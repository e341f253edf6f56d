"""Registered queries: text search, fuzzy matching, vectors, graph operators, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bridge
from ..bridge import sees, with_model
from ..functions import text as X
from ..functions import vector as V
from ..operators import graph as G
from ..security import visible
from ..storage import table, written
from .temporal_queries import SECURITY, joined, model

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ text


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"


def all_words_sql(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def terms_sql(x: str) -> str:
    stops = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
    return f"list_filter({all_words_sql(x)}, lambda w: NOT list_contains([{stops}], w))"


def trigrams_sql(x: str) -> str:
    return f"list_distinct(flatten(list_transform({all_words_sql(x)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def jaccard_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE 0.0 END)"


NAME = "supplier 12"


@query(with_model(f", t AS (SELECT id, name, {trigrams_sql('name')} AS g, {trigrams_sql(repr(NAME))} AS q FROM entities WHERE {sees('acl', 'security')}) SELECT id, name, round({jaccard_sql('g', 'q')}, 6) AS similarity FROM t WHERE {jaccard_sql('g', 'q')} > 0.2", "entities"))
def trigram_find_entity(spark, sf_dir):
    e = bridge.entities(spark, sf_dir).filter(visible("visibility", SECURITY))
    return e.select("id", "name", X.similarity(F.col("name"), F.lit(NAME)).alias("s")).filter("s > 0.2").select("id", "name", F.round("s", 6).alias("similarity"))


@query(with_model(f", t AS (SELECT entity_id AS id, {trigrams_sql('alias')} AS g, {trigrams_sql(repr('brand 12 ' + NAME))} AS q FROM aliases) SELECT id, round(max({jaccard_sql('g', 'q')}) * 0.9, 6) AS score FROM t WHERE {jaccard_sql('g', 'q')} > 0.2 GROUP BY id", "aliases"))
def trigram_seed(spark, sf_dir):
    a = bridge.aliases(spark, sf_dir).select(F.col("entity_id").alias("id"), X.similarity(F.col("alias"), F.lit(f"brand 12 {NAME}")).alias("s"))
    return a.filter("s > 0.2").groupBy("id").agg(F.round(F.max("s") * 0.9, 6).alias("score"))


def rank_sql(analyzed: str, terms: list[str]) -> str:
    one = lambda t: f"0.1 * coalesce(list_sum(list_transform(range(1, len(list_filter({analyzed}, lambda w: w = '{t}')) + 1), lambda j: 1.0::DOUBLE / (j * j))), 0) / {X.BASIS}"
    return "(" + " + ".join(one(t) for t in terms) + f") / {len(terms)}"


ENTITY_QUERY = "building or machinery"


@query(with_model(f", t AS (SELECT id, name, {terms_sql(chr(110) + 'ame || ' + repr(' ') + ' || summary')} AS a FROM entities WHERE {sees('acl', 'security')}) SELECT id, name, round({rank_sql('a', ['building', 'machinery'])}, 6) AS score FROM t WHERE list_contains(a, 'building') OR list_contains(a, 'machinery')", "entities"))
def keyword_entities(spark, sf_dir):
    clauses = X.websearch(ENTITY_QUERY)
    e = bridge.entities(spark, sf_dir).filter(visible("visibility", SECURITY)).withColumn("a", X.terms(F.concat_ws(" ", "name", "summary")))
    return e.filter(X.matches(F.col("a"), clauses)).select("id", "name", F.round(X.rank_any(F.col("a"), X.clause_terms(clauses)), 6).alias("score"))


FACT_QUERY = 'priority "1 urgent"'


@query(
    with_model(f""", t AS (SELECT id, confidence, {terms_sql("fact_text")} AS a, ' ' || array_to_string({terms_sql("fact_text")}, ' ') || ' ' AS line FROM facts WHERE invalid_at IS NULL AND {sees("acl", "security")}),
r AS (SELECT id, confidence, CASE WHEN contains(line, ' priority ') AND contains(line, ' 1 urgent ') THEN {rank_sql("a", ["priority", "1", "urgent"])} ELSE 0 END AS strict, CASE WHEN list_contains(a, 'priority') OR list_contains(a, 'urgent') THEN {rank_sql("a", ["priority", "urgent"])} ELSE 0 END AS broad FROM t)
SELECT id, round(greatest(strict, 0.65 * broad) * confidence, 6) AS score FROM r WHERE strict > 0 OR broad > 0""", "facts")
)
def keyword_facts(spark, sf_dir):
    from .retrieval import keyword_rank

    f = bridge.facts(spark, sf_dir).filter("invalid_at is null").filter(visible("visibility", SECURITY))
    f = keyword_rank(f, F.col("fact_text"), FACT_QUERY)
    return f.select("id", F.round(F.col("rank") * F.col("confidence"), 6).alias("score"))


@query(with_model(f", t AS (SELECT id, {terms_sql('content')} AS a FROM episodes WHERE {sees('acl', 'security')}) SELECT id, round(0.7 * {rank_sql('a', ['worthless', 'then'])}, 6) AS score FROM t WHERE list_contains(a, 'worthless') AND list_contains(a, 'then') AND NOT list_contains(a, 'pathetic')", "episodes"))
def keyword_episodes(spark, sf_dir):
    clauses = X.websearch("worthless then -pathetic")
    d = bridge.episodes(spark, sf_dir).filter(visible("visibility", SECURITY)).withColumn("a", X.terms(F.col("content")))
    return d.filter(X.matches(F.col("a"), clauses)).select("id", F.round(0.7 * X.rank_any(F.col("a"), X.clause_terms(clauses)), 6).alias("score"))


@query(
    r"""
SELECT doc_id, 'email' AS kind, lower(x) AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b', 0, 'i')) AS x FROM documents)
UNION ALL SELECT doc_id, 'mention', lower(x) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '@([a-z][a-z0-9_-]{1,38})\b', 1, 'i')) AS x FROM documents)"""
)
def extract_emails_mentions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    found = lambda kind, x: d.select("doc_id", F.lit(kind).alias("kind"), F.explode(x).alias("v")).select("doc_id", "kind", F.lower("v").alias("value"))
    return found("email", X.emails(F.col("text"))).unionByName(found("mention", X.mentions(F.col("text"))))


@query(
    r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b', 0, 'i')) AS x FROM documents),
h AS (SELECT doc_id, unnest(regexp_extract_all(text, '@([a-z][a-z0-9_-]{1,38})\b', 1, 'i')) AS x FROM documents)
SELECT doc_id, lower(regexp_replace(split_part(x, '@', 1), '[._-]', ' ', 'g')) AS name, 'person' AS entity_type, CAST(0.7 AS DOUBLE) AS confidence, lower(x) AS value FROM m GROUP BY ALL
UNION ALL SELECT doc_id, lower(x), 'person', 0.6, lower(x) FROM h GROUP BY ALL"""
)
def extract_people(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(X.people(F.col("text"))).alias("p")).select("doc_id", F.lower("p.name").alias("name"), "p.entity_type", "p.confidence", F.lower("p.value").alias("value"))


def phrase_sql(x: str) -> str:
    return f"' ' || array_to_string({words_sql(x)}, ' ') || ' '"


@query(f"WITH names AS (SELECT DISTINCT array_to_string({words_sql('text')}, ' ') AS alias FROM benchmark WHERE len({words_sql('text')}) > 0), d AS (SELECT doc_id, {phrase_sql('text')} AS line FROM documents) SELECT doc_id, alias FROM d JOIN names ON contains(line, ' ' || alias || ' ')")
def known_entity_match(spark, sf_dir):
    from ..operators.ingest import known_names

    names = table(spark, sf_dir, "benchmark").select(F.concat_ws(" ", X.words(F.col("text"))).alias("alias")).filter("alias <> ''").distinct()
    return known_names(table(spark, sf_dir, "documents").select("doc_id", "text"), names, "doc_id", "text")


def part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("entity_type"), F.concat_ws(" ", "p_brand", "p_name").alias("name"), F.col("p_partkey").alias("id"))


NAMES_SQL = "WITH RECURSIVE names AS (SELECT p_type AS entity_type, p_brand || ' ' || p_name AS name, min(p_partkey) AS id FROM part GROUP BY ALL)"


@query(
    NAMES_SQL
    + f""", t AS (SELECT entity_type, id, list_sort(list_distinct(list_filter({words_sql("name")}, lambda w: length(w) > 1))) AS t FROM names),
u AS (SELECT entity_type, t, min(id) AS id FROM t WHERE len(t) > 0 GROUP BY ALL)
SELECT a.id AS a, b.id AS b, round({jaccard_sql("a.t", "b.t")}, 6) AS score FROM u a JOIN u b ON a.entity_type = b.entity_type AND a.id < b.id WHERE {jaccard_sql("a.t", "b.t")} >= 0.5"""
)
def token_jaccard_pairs(spark, sf_dir):
    return G.similar_names(part_names(spark, sf_dir), 0.5).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH t AS (SELECT p_partkey AS id, p_type AS entity_type, list_sort(list_distinct(list_filter({words_sql("p_brand || ' ' || p_name")}, lambda w: length(w) > 1))) AS t FROM part)
SELECT id, min(id) OVER (PARTITION BY entity_type, t) AS representative FROM t WHERE len(t) > 0""")
def token_set_members(spark, sf_dir):
    """Every part with the representative that stands for it in token_jaccard_pairs."""
    return G.name_members(part_names(spark, sf_dir))


@query(
    f"""WITH d AS (SELECT doc_id, {words_sql("text")} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
q AS (SELECT doc_id, t, i FROM p WHERE t IN ('the', 'worthless', 'then') QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY i) <= 256)
SELECT a.doc_id, round(1 - product(1 - 0.1 * sqrt(CASE WHEN abs(a.i - b.i) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.i - b.i) / 1.5 - 2)) END)), 6) AS score
FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.t < b.t GROUP BY a.doc_id HAVING count(DISTINCT a.t) + count(DISTINCT b.t) = 4 AND count(DISTINCT a.t || b.t) = 3"""
)
def keyword_all(spark, sf_dir):
    """Documents that hold all three words, by how near to each other these stand."""
    words = ["the", "worthless", "then"]
    d = table(spark, sf_dir, "documents").select("doc_id", X.words(F.coalesce("text", F.lit(""))).alias("w"))
    return d.select("doc_id", F.round(X.rank_all(F.col("w"), words), 6).alias("score"), F.forall(F.array(*[F.lit(w) for w in words]), lambda t: F.array_contains("w", t)).alias("all")).filter("all").drop("all")


# ------------------------------------------------------------------ vectors

COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
FROM_QUERY = "FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def probe(spark, sf_dir) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


@query(f"SELECT vec_id, round({COS}, 5) AS similarity {FROM_QUERY} ORDER BY {COS} DESC, vec_id LIMIT 20")
def semantic_top(spark, sf_dir):
    rows = V.nearest(table(spark, sf_dir, "embeddings"), "embedding", probe(spark, sf_dir), 20, key="vec_id")
    return rows.select("vec_id", F.round("similarity", 5).alias("similarity"))


@query(f"SELECT vec_id, label, round({COS}, 5) AS similarity {FROM_QUERY} WHERE {COS} > 0.3")
def semantic_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("c", V.cosine(F.col("embedding"), probe(spark, sf_dir)))
    return rows.filter("c > 0.3").select("vec_id", "label", F.round("c", 5).alias("similarity"))


@query("SELECT label, i, round(sum(x * w) / sum(w), 5) AS mean FROM (SELECT label, vec_id % 7 + 1 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL")
def vector_weighted_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    means = V.weighted_mean(rows, "label", "embedding", F.col("vec_id") % 7 + 1)
    return means.select("label", F.posexplode("mean").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("mean"))


DISTANCE = 1.05


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < {DISTANCE}")
def lsh_candidates(spark, sf_dir):
    pairs = V.close_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", DISTANCE)
    return pairs.select("a", "b", F.round("distance", 5).alias("distance"))


@query("""WITH s AS (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS c FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0)
SELECT query, vec_id, round(c, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, vec_id) AS n FROM s) WHERE n <= 10""")
def vector_neighbours(spark, sf_dir):
    """The ten nearest of all rows for each row whose id 100 divides."""
    rows = table(spark, sf_dir, "embeddings")
    return V.nearest_to_each(rows.filter("vec_id % 100 = 0"), rows, "vec_id", "embedding").select("query", "vec_id", F.round("similarity", 5).alias("similarity"))


@query(f"SELECT e.vec_id, round(greatest(t, 0.4 * t + 0.6 * coalesce({COS}, t)), 5) AS score FROM (SELECT *, (vec_id % 10) / 10.0 AS t FROM embeddings) e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def name_and_vector_score(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.round(V.match_score(F.col("vec_id") % 10 / 10, V.cosine(F.col("embedding"), probe(spark, sf_dir))), 5).alias("score"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS i, md5(substring(text, i * 4500 + 1, 5000)) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(floor((length(text) - 500 - 1) / 4500) + 1, 1) AS BIGINT))) AS i FROM documents)")
def text_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(V.chunked(F.col("text"), 5000, 500)).alias("i", "chunk")).select("doc_id", "i", F.md5("chunk").alias("chunk"))


# ------------------------------------------------------------------ graph

SEEDS = ["supplier:3", "nation:3"]


def seeds(spark):
    return spark.createDataFrame([(s,) for s in SEEDS], "id string")


SEED_LIST = ", ".join(f"'{s}'" for s in SEEDS)
EDGES_SQL = f""", links AS ({joined("security", "f.invalid_at IS NULL")}),
edges AS (SELECT source AS src, target AS dst, id AS fact_id, confidence AS weight FROM links UNION ALL SELECT target, source, id, confidence FROM links WHERE source <> target)"""


def graph(spark, sf_dir, **filters):
    e, f = model(spark, sf_dir)
    return e, f, G.edges_of(f, e, SECURITY, **filters)


BFS_SQL = f"""{EDGES_SQL},
walk(id, hop) AS (SELECT unnest([{SEED_LIST}]), 0 UNION SELECT e.dst, w.hop + 1 FROM walk w JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = w.id WHERE w.hop < 2),
near AS (SELECT id, min(hop) AS d FROM walk GROUP BY id),
hops AS (SELECT fact_id, min(d) + 1 AS hop FROM edges JOIN near ON near.id = edges.src GROUP BY fact_id)
SELECT f.id, source, relation, target, CAST(hop AS INTEGER) AS hop, round(confidence * 0.9 ** hop, 6) AS score FROM facts f JOIN hops ON hops.fact_id = f.id"""


@query(with_model(BFS_SQL))
def bfs_3hop(spark, sf_dir):
    e, f, edges = graph(spark, sf_dir)
    return G.traverse(f, edges, seeds(spark), 3, limit=None).withColumn("score", F.round("score", 6))


@query(with_model(BFS_SQL.replace("f.invalid_at IS NULL", "f.invalid_at IS NULL AND f.relation IN ('located_in', 'part_of')")))
def bfs_relation_filter(spark, sf_dir):
    e, f, edges = graph(spark, sf_dir, relations=["located_in", "part_of"])
    return G.traverse(f, edges, seeds(spark), 3, limit=None).withColumn("score", F.round("score", 6))


@query(
    with_model(
        f""", v AS (SELECT f.relation, s.entity_type AS st, t.entity_type AS tt, f.fact_text, f.confidence, f.id FROM facts f JOIN entities s ON s.id = f.source JOIN entities t ON t.id = f.target WHERE f.invalid_at IS NULL),
n AS (SELECT e.entity_type AS label, e.id, e.name FROM entities e),
top AS (SELECT label, array_to_string(list_slice(list(name ORDER BY name, id), 1, 5), ', ') AS names, count(*) AS size FROM n GROUP BY label HAVING count(*) > 1),
inner_ AS (SELECT st AS label, array_to_string(list_slice(list(fact_text ORDER BY confidence DESC, id), 1, 3), '; ') AS said FROM v WHERE st = tt GROUP BY st)
SELECT top.label, size, 'This community consists of ' || size || ' entities: ' || names || '. Key relationships include: ' || coalesce(said, '') || '.' AS summary FROM top LEFT JOIN inner_ ON inner_.label = top.label"""
    )
)
def community_sentences(spark, sf_dir):
    """Sentences for communities; here the entities of one type are one."""
    e, f = model(spark, sf_dir)
    return G.community_summaries(e.select("id", F.col("entity_type").alias("label")), e, f.filter("invalid_at is null"))


@query(with_model(f"{EDGES_SQL} SELECT DISTINCT dst AS id FROM edges WHERE src = 'nation:3' AND dst <> 'nation:3'"))
def related_entities(spark, sf_dir):
    _, _, edges = graph(spark, sf_dir)
    return G.related(edges, "nation:3", limit=None)


def ppr_sql(rounds: int = 20) -> str:
    steps = f"""{EDGES_SQL}, w AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM edges GROUP BY ALL),
steps AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM w),
x0 AS MATERIALIZED (SELECT id, CASE WHEN id IN ({SEED_LIST}) THEN 1.0 / {len(SEEDS)} ELSE 0.0 END::DOUBLE AS s, CASE WHEN id IN ({SEED_LIST}) THEN 1.0 / {len(SEEDS)} ELSE 0.0 END::DOUBLE AS score FROM entities WHERE {sees("acl", "security")})"""
    for i in range(1, rounds + 1):
        steps += f""",
x{i} AS MATERIALIZED (SELECT n.id, n.s, 0.15 * n.s + 0.85 * coalesce(f.flow, 0) AS score FROM x{i - 1} n LEFT JOIN (SELECT dst, sum(score * p) AS flow FROM x{i - 1} JOIN steps ON src = id GROUP BY dst) f ON f.dst = n.id)"""
    return steps


def scores(spark, sf_dir):
    e, f, edges = graph(spark, sf_dir)
    nodes = e.filter(visible("visibility", SECURITY)).select("id")
    return e, f, G.pagerank(nodes, G.weighted(edges), seeds(spark), tolerance=None)


@query(with_model(ppr_sql() + " SELECT id, round(score, 7) AS score FROM x20"))
def ppr_scores(spark, sf_dir):
    return scores(spark, sf_dir)[2].select("id", F.round("score", 7).alias("score"))


@query(
    with_model(
        ppr_sql()
        + """, top AS (SELECT id, score FROM x20 WHERE score > 0 ORDER BY score DESC, id LIMIT 20)
SELECT 'entity' AS type, id, round(score, 7) AS score FROM top UNION ALL
SELECT 'fact', l.id, round(max(t.score) * any_value(l.confidence), 7) FROM links l JOIN top t ON t.id IN (l.source, l.target) GROUP BY l.id"""
    )
)
def ppr_results(spark, sf_dir):
    e, f, x = scores(spark, sf_dir)
    links = f.filter("invalid_at is null").filter(visible("visibility", SECURITY))
    seen = e.filter(visible("visibility", SECURITY)).select("id")
    for side in ("source", "target"):
        links = links.join(seen.withColumnRenamed("id", side), side, "left_semi")
    return G.pagerank_results(x, links).withColumn("score", F.round("score", 7))


def lpa_sql(rounds: int) -> str:
    out = f"""{EDGES_SQL}, w AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM edges WHERE src <> dst GROUP BY ALL),
l0 AS MATERIALIZED (SELECT id, id AS label, (SELECT max(weight) FROM w WHERE src = e.id) AS vote FROM entities e WHERE {sees("acl", "security")})"""
    for i in range(1, rounds + 1):
        out += f""",
l{i} AS MATERIALIZED (SELECT n.id, coalesce(b.label, n.label) AS label, n.vote FROM l{i - 1} n LEFT JOIN (
  SELECT id, arg_min(label, (-total, label)) AS label FROM (SELECT id, label, round(sum(x), 6) AS total FROM (
    SELECT src AS id, label, weight AS x FROM w JOIN l{i - 1} ON dst = id UNION ALL SELECT id, label, vote FROM l{i - 1} WHERE vote IS NOT NULL) GROUP BY ALL) GROUP BY id) b ON b.id = n.id)"""
    return out


LPA_ROUNDS = 10  # the operator's and the reference's


def labels(spark, sf_dir):
    e, f, edges = graph(spark, sf_dir)
    edges = written(edges, "edges")
    return e, f, edges, G.propagate_labels(e.filter(visible("visibility", SECURITY)).select("id"), edges, LPA_ROUNDS)


@query(with_model(lpa_sql(LPA_ROUNDS) + f" SELECT id, label FROM l{LPA_ROUNDS}"))
def lpa_full(spark, sf_dir):
    return labels(spark, sf_dir)[3]


SALIENCE_SQL = with_model(
    lpa_sql(LPA_ROUNDS)
    + f""", c AS (SELECT id, label FROM l{LPA_ROUNDS})
SELECT s.label, s.n AS size, round(ln(1 + s.n) + ln(1 + coalesce(i.x, 0)), 5) AS salience FROM (SELECT label, count(*) AS n FROM c GROUP BY label HAVING count(*) > 1) s
LEFT JOIN (SELECT a.label, sum(l.confidence) AS x FROM links l JOIN c a ON a.id = l.source JOIN c b ON b.id = l.target WHERE a.label = b.label GROUP BY a.label) i ON i.label = s.label"""
)


@query(SALIENCE_SQL)
def community_salience_full(spark, sf_dir):
    return salience(spark, sf_dir)


def salience(spark, sf_dir):
    _, _, edges, found = labels(spark, sf_dir)
    return G.communities(found, edges).withColumn("salience", F.round("salience", 5))


def components_sql(rounds: int = 14) -> str:
    """The smallest id within so many hops of a node; more than the graph is wide, which the last column shows."""
    out = f"""{EDGES_SQL}, w AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE src <> dst), l0 AS MATERIALIZED (SELECT id, id AS label FROM entities WHERE {sees("acl", "security")})"""
    for i in range(1, rounds + 1):
        out += f""",
l{i} AS MATERIALIZED (SELECT n.id, least(n.label, coalesce(b.label, n.label)) AS label FROM l{i - 1} n LEFT JOIN (SELECT src AS id, min(label) AS label FROM w JOIN l{i - 1} ON dst = id GROUP BY src) b ON b.id = n.id)"""
    return out


@query(with_model(components_sql() + " SELECT l14.id, l14.label FROM l14 JOIN l13 ON l13.id = l14.id WHERE l14.label = l13.label"))
def all_components(spark, sf_dir):
    """Components over all visible entities and current facts."""
    e, _, edges = graph(spark, sf_dir)
    return G.components(e.filter(visible("visibility", SECURITY)).select("id"), edges)


#: The same under the names by which these were first registered.
for _short, _long in (("lpa_sync", "lpa_full"), ("community_salience", "community_salience_full"), ("components", "all_components")):
    QUERIES[_short], ORACLES[_short] = QUERIES[_long], ORACLES[_long]


@query(with_model(", m AS (SELECT 'part:' || p_partkey AS duplicate, 'part:' || min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS canonical FROM part) SELECT f.id, f.source, coalesce(m.canonical, f.target) AS target FROM facts f LEFT JOIN m ON m.duplicate = f.target", "facts"))
def merge_entities(spark, sf_dir):
    first = table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("k"))
    text = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string"))
    mapping = table(spark, sf_dir, "part").join(first, ["p_name", "p_brand"]).select(text("p_partkey").alias("duplicate"), text("k").alias("canonical"))
    return G.merge_entities(bridge.facts(spark, sf_dir), mapping).select("id", "source", "target")
