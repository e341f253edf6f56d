"""Memory objects, skills and evals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vector import nearest
from ..schema import MEMORY_STATUSES
from ..security import Access, visible_rows
from ..storage import first_per_key
from .graph import first_n


def memory_list(memory: DataFrame, access: Access | None, kinds: list[str] | None = None, statuses: list[str] | None = None, limit: int | None = 50) -> DataFrame:
    """Memory objects of kinds and statuses, the newest first."""
    out = visible_rows(memory, access)
    if kinds:
        out = out.filter(F.col("kind").isin(kinds))
    if statuses:
        out = out.filter(F.col("status").isin(statuses))
    return out.orderBy(F.desc("valid_at"), "id").limit(limit) if limit else out


def memory_search(memory: DataFrame, query: str, access: Access | None, limit: int | None = 20, vector: list[float] | None = None, **filters) -> DataFrame:
    """Objects that hold all words of the query, by rank, and the nearest by vector; the better score counts."""
    words = [w for w in X.broad_terms(query) if w not in X.STOP_WORDS]
    rows = memory_list(memory, access, limit=None, **filters)
    a = X.terms(F.concat_ws(" ", "owner", "subject", "summary"))
    all_in = F.size(F.array_except(F.array(*[F.lit(w) for w in words]), a)) == 0
    found = rows.filter(all_in).select("id", "kind", "status", X.rank_any(a, words).alias("score"))
    if vector is not None and "embedding" in rows.columns:
        near = nearest(rows, "embedding", vector, limit or 100).select("id", "kind", "status", F.col("similarity").alias("score"))
        found = first_per_key(found.unionByName(near), ["id"], F.desc("score"))
    return found.orderBy(F.desc("score"), "id").limit(limit) if limit else found


def derive(objects: DataFrame, kinds: tuple[str, ...], most: int = 32, order: str = "n", key_chars: int | None = 240) -> DataFrame:
    """Proposed objects (episode_id, kind, summary, status, confidence, and their place n in the episode's list): unknown kinds go,
    a missing or unknown status becomes observed, a missing confidence 0.7, and it is clamped; of an episode's objects of one
    kind whose summaries are alike in letters and digits (the first key_chars of them; None: all) the first stays; so many for
    each episode, in order.  A title, where there is such a column, defaults to the kind."""
    key = F.trim(F.regexp_replace(F.lower("summary"), "[^a-z0-9]+", " "))
    rows = objects.filter(F.col("kind").isin(list(kinds))).withColumn("__key", key if key_chars is None else F.substring(key, 1, key_chars))
    known = F.when(F.col("status").isin(list(MEMORY_STATUSES)), F.col("status")).otherwise("observed")
    rows = rows.withColumns({"confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.7)))), "status": known})
    if "title" in rows.columns:
        rows = rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "kind"))
    one = first_per_key(rows, ["episode_id", "kind", "__key"], order, "summary")
    return first_n(one, ["episode_id"], most, order, "kind", "__key").drop("__key")


def _alike(left: DataFrame, right: DataFrame) -> DataFrame:
    """Words of left (a) and of right (b), distinct, of which one contains the other.  The longer one's parts of a length that the
    shorter ones have are joined with these by equality, so that there is no product of the two."""

    def contained(long: DataFrame, l: str, short: DataFrame, s: str) -> DataFrame:  # noqa: E741
        most = short.agg(F.coalesce(F.max(F.length(s)), F.lit(0)).alias("most"))  # one row
        size = F.least(F.length(l), F.col("most"))
        parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(l)), lambda i: F.transform(F.sequence(F.lit(1), F.least(size, F.length(l) - i + 1)), lambda n: F.substring(l, i, n)))))
        cut = long.filter(F.length(l) > 0).withColumn("__one", F.lit(1)).join(F.broadcast(most.withColumn("__one", F.lit(1))), "__one").filter("most > 0")
        return cut.select(l, F.explode(parts).alias(s)).join(short, s).select("a", "b")

    return contained(left, "a", right, "b").unionByName(contained(right, "b", left, "a")).distinct()


def resolve_skills(inputs: DataFrame, skills: DataFrame, least: float = 0.3) -> DataFrame:
    """Inputs (id, text) with the skill (skill, priority, triggers) whose trigger fits best, any case: equal 1.0; anywhere inside the
    input up to 0.95, by its share of the length; else 0.7 of the share of its words that contain, or stand inside, a word of the
    input; by confidence, then priority.  Empty triggers fit nothing."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    i = inputs.select("id", F.trim(low(F.col("text"))).alias("t"))
    said = i.select("id", F.explode(F.array_distinct(F.split("t", r"\s+"))).alias("a")).filter("a <> ''")
    s = skills.select("skill", "priority", F.explode("triggers").alias("trigger")).select("skill", "priority", low(F.col("trigger")).alias("g")).filter("trim(g) <> ''").distinct()
    asked = s.select("skill", "priority", "g", F.posexplode(F.split(F.trim("g"), r"\s+")).alias("pos", "b"))
    pairs = _alike(said.select("a").distinct(), asked.select("b").distinct())
    heard = said.join(pairs, "a").select("id", "b").distinct()
    met = heard.join(asked, "b").groupBy("id", "skill", "priority", "g").agg(F.count("*").alias("hits")).join(i, "id")
    size = F.size(F.split(F.trim("g"), r"\s+"))
    score = F.when(F.col("t") == F.col("g"), 1.0).when(F.col("t").contains(F.col("g")), F.least(F.lit(0.95), 0.8 + 0.2 * F.length("g") / F.length("t"))).otherwise(F.col("hits") / size * 0.7)
    out = met.withColumn("confidence", score).filter(F.col("confidence") >= least)
    return first_per_key(out, ["id"], F.desc("confidence"), F.desc("priority"), "skill").select("id", "skill", F.round("confidence", 6).alias("confidence"))


def eval_scores(answers: DataFrame, least: float = 0.8) -> DataFrame:
    """Answers (suite, id, content, must_include, must_not_include) scored by terms; a suite passes if all of its answers do."""
    low = F.lower("content")
    good = F.size(F.filter("must_include", lambda t: low.contains(F.lower(t))))
    bad = F.size(F.filter("must_not_include", lambda t: low.contains(F.lower(t))))
    total = F.size("must_include") + F.size("must_not_include")
    score = F.when(total > 0, (good + F.size("must_not_include") - bad) / total).otherwise(1.0)
    return answers.withColumn("score", score).groupBy("suite").agg(F.count("*").alias("queries"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg((F.col("score") >= least).cast("double")), 6).alias("pass_rate"))


def triage_accuracy(cases: DataFrame) -> DataFrame:
    """Expected against actual retention: cases, right ones, and their share."""
    right = F.col("expected") == F.col("actual")
    return cases.groupBy("expected").agg(F.count("*").alias("cases"), F.count_if(right).alias("right"), F.round(F.avg(right.cast("double")), 6).alias("accuracy"))
