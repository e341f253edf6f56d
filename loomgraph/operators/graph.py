"""Graph operators on entities and facts, as rounds of joins and aggregates.

Facts become edges in both directions once; every operator joins them by equal
keys.  Rounds work on nodes' numbers; they end in tables written to the shared
folder, so that lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..security import Access, visible_rows
from ..storage import first_per_key, written
from .temporal import holds_at, is_current


def edges_of(facts: DataFrame, entities: DataFrame, access: Access | None, ts=None, relations: list[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """Visible facts of a time between visible entities, in both directions: src, dst, fact_id, weight."""
    rows = visible_rows(facts, access).filter(is_current() if ts is None else holds_at(ts))
    if relations:
        rows = rows.filter(F.col("relation").isin(relations))
    if min_confidence is not None:
        rows = rows.filter(F.col("confidence") >= min_confidence)
    seen = visible_rows(entities, access).select("id")
    for side in ("source", "target"):
        rows = rows.join(seen.withColumnRenamed("id", side), side, "left_semi")
    one = lambda a, b: rows.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("id").alias("fact_id"), F.col("confidence").alias("weight"))
    return one("source", "target").unionByName(one("target", "source").filter("src <> dst"))


def weighted(edges: DataFrame) -> DataFrame:
    """Parallel edges added up."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def numbered(nodes: DataFrame) -> DataFrame:
    """Distinct nodes (id) with a number n each, in the order of their ids, so that the smaller number is the smaller id."""
    return written(nodes.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("n", F.monotonically_increasing_id()), "numbers")


def coded(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) by their ends' numbers: a, b (null: not a node), weight.  Those from elsewhere are left out."""
    a, b = numbers.select(F.col("id").alias("src"), F.col("n").alias("a")), numbers.select(F.col("id").alias("dst"), F.col("n").alias("b"))
    return written(edges.join(a, "src").join(b, "dst", "left").select("a", "b", "weight"), "edges")


def laid(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows on the executors' disks, dealt and sorted by a key once: rounds that join them by it shuffle the other side only.  A
    lost executor's part is made again from the written tables; unpersist frees them."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)


def named(labels: DataFrame, numbers: DataFrame) -> DataFrame:
    """Numbered labels (n, label) as ids again: id, label."""
    own = labels.join(numbers, "n").select("id", F.col("label").alias("n"))
    return written(own.join(numbers.withColumnRenamed("id", "of"), "n").select("id", F.col("of").alias("label")), "labels")


def distances(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Nodes (id) within so many hops of the seeds (id), and their distance: a frontier that leaves visited nodes out.  Written
    edges are read as they are."""
    edges = edges if hasattr(edges, "written_to") else written(edges.select("src", "dst").distinct(), "edges")
    seen = written(seeds.select("id").distinct().withColumn("distance", F.lit(0)), "bfs")
    frontier = seen
    for hop in range(1, hops + 1):
        nxt = edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = written(nxt.join(seen, "id", "left_anti").withColumn("distance", F.lit(hop)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def traverse(facts: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 3, limit: int | None = 50) -> DataFrame:
    """Facts within so many hops: hop is one more than the nearer endpoint's distance; score is confidence * 0.9 ^ hop."""
    edges = edges if hasattr(edges, "written_to") else written(edges, "edges")
    reach = distances(edges, seeds, hops - 1).select(F.col("id").alias("src"), "distance")
    near = edges.join(reach, "src").groupBy("fact_id").agg((F.min("distance") + 1).alias("hop"))
    out = facts.join(near, facts["id"] == near["fact_id"]).select("id", "source", "relation", "target", "hop", (F.col("confidence") * F.pow(F.lit(0.9), F.col("hop"))).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(limit) if limit else out


def related(edges: DataFrame, entity_id: str, limit: int | None = 50, depth: int = 1) -> DataFrame:
    """Other entities within depth hops."""
    if depth == 1:
        out = edges.filter(F.col("src") == entity_id).select(F.col("dst").alias("id")).distinct().filter(F.col("id") != entity_id)
    else:
        spark = edges.sparkSession
        out = distances(edges, spark.createDataFrame([(entity_id,)], "id string"), depth).filter("distance > 0").select("id")
    return out.orderBy("id").limit(limit) if limit else out


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, rounds: int = 20, tolerance: float | None = 1e-6, keep: int = 5) -> DataFrame:
    """Personalized PageRank: nodes (id) with score, for edges (src, dst, weight) and seeds (id).

    x' = alpha s + (1 - alpha) (P x + dangling mass to the seeds).  Every keep rounds the scores are written, and
    the rounds end where they changed by less than tolerance in all.  Seeds that aren't nodes don't count; without any, all
    scores are 0.
    """
    numbers = numbered(nodes)
    arcs = coded(edges, numbers)
    valid = written(numbers.join(seeds.select("id").distinct(), "id", "left_semi"), "seeds")
    n = valid.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("score"))
    out_weight = arcs.groupBy("a").agg(F.sum("weight").alias("total"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = laid(arcs.filter("b is not null").join(out_weight, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("p")), "a", parts)
    start = numbers.select("n").join(valid.select("n", F.lit(1.0 / n).alias("s")), "n", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    ends = out_weight.select(F.col("a").alias("n"), F.lit(1).alias("linked"))
    start = laid(start.join(ends, "n", "left").select("n", "s", F.col("linked").isNull().alias("dangling")), "n", parts)
    loose = start.filter("dangling and s > 0").limit(1).count() > 0
    score = start.select("n", F.col("s").alias("score"))
    before = score
    for i in range(1, rounds + 1):
        lost = score.join(start.filter("dangling").select("n"), "n", "left_semi").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0] if loose else 0.0
        flow = steps.join(score.filter("score > 0").select(F.col("n").alias("a"), "score"), "a").groupBy(F.col("b").alias("n")).agg(F.sum(F.col("score") * F.col("p")).alias("flow"))
        score = start.join(flow, "n", "left").select("n", (alpha * F.col("s") + (1 - alpha) * (F.coalesce("flow", F.lit(0.0)) + lost * F.col("s"))).alias("score"))
        if i % keep == 0 and i < rounds:
            score = written(score, "scores")
            if tolerance is not None:
                change = score.join(before.select("n", F.col("score").alias("old")), "n").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
                if change is not None and change < tolerance:
                    break
            before = score
    out = written(numbers.join(score, "n").select("id", "score"), "scores")
    for df in (steps, start):
        df.unpersist()
    return out


def pagerank_results(scores: DataFrame, facts: DataFrame, limit: int = 20) -> DataFrame:
    """The best entities, and each fact that touches one, from its better endpoint: one list by score."""
    top = scores.filter("score > 0").orderBy(F.desc("score"), "id").limit(limit)
    ends = facts.withColumn("node", F.explode(F.array_distinct(F.array("source", "target")))).join(top.select(F.col("id").alias("node"), F.col("score").alias("s")), "node")
    best = first_per_key(ends, ["id"], F.desc("s"), "node").select(F.lit("fact").alias("type"), "id", (F.col("s") * F.col("confidence")).alias("score"))
    return top.select(F.lit("entity").alias("type"), "id", "score").unionByName(best)


def propagate_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Communities by synchronous weighted label propagation: nodes (id) with label.

    A node takes the label with the most edge weight among its neighbours' last labels and its own, for which it votes with
    its heaviest edge (so that pairs don't swap labels for ever); ties go to the smaller label.
    """
    numbers = numbered(nodes)
    arcs = coded(weighted(edges.filter("src <> dst")), numbers)
    own = arcs.groupBy(F.col("a").alias("n")).agg(F.max("weight").alias("vote"))
    labels = written(numbers.join(own, "n", "left").select("n", F.col("n").alias("label"), "vote"), "nodes")
    near = laid(arcs.filter("b is not null"), "b")
    for _ in range(rounds):
        heard = near.join(labels.select(F.col("n").alias("b"), "label"), "b").select(F.col("a").alias("n"), "label", F.col("weight").alias("w"))
        said = labels.filter("vote is not null").select("n", "label", F.col("vote").alias("w"))
        sums = heard.unionByName(said).groupBy("n", "label").agg(F.round(F.sum("w"), 6).alias("w"))
        best = sums.groupBy("n").agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("best"))
        step = written(labels.join(best, "n", "left").select("n", F.coalesce("best.label", "label").alias("label"), "vote", (F.coalesce("best.label", "label") != F.col("label")).alias("moved")), "labels")
        labels = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    near.unpersist()
    return named(labels, numbers)


def communities(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Communities of two members or more: size and salience ln(1 + n) + ln(1 + internal weight)."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).filter("size > 1")
    a, b = labels.select(F.col("id").alias("src"), "label"), labels.select(F.col("id").alias("dst"), F.col("label").alias("other"))
    inside = edges.filter("src <= dst").join(a, "src").join(b, "dst").filter("label = other").groupBy("label").agg(F.sum("weight").alias("weight"))
    out = sizes.join(inside, "label", "left")
    return out.select("label", "size", (F.log1p(F.col("size").cast("double")) + F.log1p(F.coalesce("weight", F.lit(0.0)))).alias("salience"))


def community_summaries(labels: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """A sentence for each community: its size, its first members by name, and its three surest facts."""
    named = labels.join(entities.select("id", "name"), "id")
    some = first_n(named, ["label"], 5, "name", "id").groupBy("label").agg(F.array_sort(F.collect_list("name")).alias("names"))
    members = named.groupBy("label").agg(F.count("*").alias("size")).filter("size > 1").join(some, "label")
    a, b = labels.select(F.col("id").alias("source"), "label"), labels.select(F.col("id").alias("target"), F.col("label").alias("other"))
    inside = facts.join(a, "source").join(b, "target").filter("label = other")
    top = first_n(inside, ["label"], 3, F.desc("confidence"), "id").groupBy("label").agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "id", "fact_text"))), lambda s: s["fact_text"])).alias("facts"))
    said = F.concat(F.lit("This community consists of "), F.col("size"), F.lit(" entities: "), F.concat_ws(", ", "names"), F.lit(". Key relationships include: "), F.coalesce("facts", F.lit("")), F.lit("."))
    return members.join(top, "label", "left").select("label", "size", said.alias("summary"))


def first_n(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each key; all but n of a task's rows stay out of the shuffle."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= n).drop("__rank")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: nodes (id) with the smallest id that they reach.  Labels spread and then jump to their labels'
    labels, so rounds grow with the logarithm of the width."""
    numbers = numbered(nodes)
    near = laid(coded(edges.select("src", "dst", F.lit(1.0).alias("weight")).distinct(), numbers).filter("b is not null").select("a", "b"), "b")
    labels = numbers.select("n", F.col("n").alias("label"))
    while True:
        heard = near.join(labels.select(F.col("n").alias("b"), "label"), "b").groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        step = labels.join(heard, "n", "left").select("n", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = step.select(F.col("n").alias("new"), F.col("new").alias("far"))
        step = step.join(jump, "new", "left").select("n", F.coalesce("far", "new").alias("next"), "label")
        step = written(step.select("n", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")), "labels")
        labels = step.select("n", "label")
        if step.filter("moved").isEmpty():
            near.unpersist()
            return named(labels, numbers)


def name_members(names: DataFrame) -> DataFrame:
    """Rows (id, entity_type, name) with name tokens, and the smallest id of their type with the same token set: id, representative."""
    sets = _token_sets(names)
    first = sets.groupBy("entity_type", "t").agg(F.min("id").alias("representative"))
    return sets.join(first, ["entity_type", "t"]).select("id", "representative").distinct()


def similar_names(names: DataFrame, least: float) -> DataFrame:
    """Pairs of representatives (name_members) of one type whose name tokens have at least this Jaccard similarity.

    A set's tokens stand in the order of their number of sets.  Two sets that are alike enough share a token among
    their first size - ceil(least * size) + 1, so they meet by those only, and tokens of most names make few pairs.
    """
    from ..functions.text import set_similarity

    sets = written(_token_sets(names).groupBy("entity_type", "t").agg(F.min("id").alias("id")), "sets")
    by = sets.select("entity_type", F.explode("t").alias("token"), "id", "t")
    counts = by.groupBy("entity_type", "token").agg(F.count("*").alias("n"))
    ordered = by.join(counts, ["entity_type", "token"]).groupBy("entity_type", "id", "t").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("o"))
    prefix = F.slice("o", F.lit(1), F.size("t") - F.ceil(least * F.size("t") - 1e-9).cast("int") + 1)
    heads = written(ordered.select("entity_type", F.explode(F.transform(prefix, lambda x: x["token"])).alias("token"), "id", "t"), "heads")
    pairs = heads.join(heads.select("entity_type", "token", F.col("id").alias("id2"), F.col("t").alias("t2")), ["entity_type", "token"]).filter("id < id2").select("id", "id2", "t", "t2").distinct()
    return pairs.select(F.col("id").alias("a"), F.col("id2").alias("b"), set_similarity(F.col("t"), F.col("t2")).alias("score")).filter(F.col("score") >= least)


def _token_sets(names: DataFrame) -> DataFrame:
    from ..functions.text import tokens

    return names.select("entity_type", F.array_sort(tokens(F.col("name"))).alias("t"), "id").filter(F.size("t") > 0)


def merge_entities(facts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Facts with endpoints rewritten by mapping (duplicate, canonical)."""
    out = facts
    for side in ("source", "target"):
        m = mapping.select(F.col("duplicate").alias(side), F.col("canonical").alias("__to"))
        out = out.join(m, side, "left").withColumn(side, F.coalesce("__to", side)).drop("__to")
    return out.select(*facts.columns)


def canonical_band(score):
    """apply from 0.92, ambiguous from 0.75, else telemetry."""
    return F.when(score >= 0.92, "apply").when(score >= 0.75, "ambiguous").otherwise("telemetry")
