"""Whether evidence answers a question: subjects, coverage slots, and what is missing, for many questions at once.

A question's frame is found by its form alone (a caller may give a better one): names
of several capitalised words with acronyms near them, other acronyms, slots by the
words that ask for them, and whether it asks for something sensitive.  Everything is
built of column functions: one projection for the frames, one for the citations, and
one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a question that ask for a slot, and words of evidence that cover it.
ASKS = {
    "status": ["what is happening", "status", "current", "issue", "incident", "what happened"],
    "customer_message": ["tell the customer", "customer facing", "externally", "should not be said", "what should we tell"],
    "workaround": ["workaround", "mitigation", "fallback"],
    "limits": ["limit", "limits", "scope", "risk", "risks"],
    "owner": ["owner", "owns", "responsible", "next steps"],
    "refund": ["refund", "cash refund", "service credit", "credit approved"],
    "entity_separation": ["same as", "same customer", "different", "separate", "confuse", "merge"],
    "location": ["where is", "stored", "path", "location", "lives at"],
    "security": ["token", "secret", "credential", "access key", "password", "compliance", "soc2"],
    "timeline": ["timeline", "when", "by", "due"],
    "cause": ["root cause", "caused", "why"],
    "decision": ["decision", "decided", "approved"],
    "risk": ["risk", "blocker", "concern", "concerns", "flag", "flags"],
}
COVERS = {
    "status": ["issue", "incident", "missing", "blocked", "affected", "running", "ongoing", "current"],
    "customer_message": ["customer facing", "tell", "do not say", "externally", "update", "customer"],
    "workaround": ["workaround", "mitigation", "fallback", "enable", "temporary", "until"],
    "limits": ["limit", "scope", "only", "risk", "slower", "does not include", "not available", "do not"],
    "owner": ["owner", "owns", "responsible", "assigned", "next update", "on-call", "on call"],
    "refund": ["refund", "cash refund", "service credit", "finance", "legal", "approved"],
    "entity_separation": ["not related", "separate", "do not confuse", "do not merge", "not the same", "is not", "prospect"],
    "location": ["stored", "lives at", "path", "location", "1password", "item"],
    "security": ["token", "secret", "credential", "restricted", "security", "access", "compliance", "soc2"],
    "timeline": ["by", "due", "today", "tomorrow", "monday", "friday", "eod", "pt"],
    "cause": ["root cause", "caused", "because", "suspected", "confirmed", "not established"],
    "decision": ["decision", "decided", "approved", "not approved", "no decision"],
    "risk": ["risk", "blocker", "blocked", "concern", "weak", "flag", "issue"],
}
SENSITIVE = ["token", "secret", "credential", "access key", "password", "private path", "1password", "soc2"]
NOT_SUBJECTS = "who what where when why how it they them this that these those".split()
FILLERS = "the and or for with about into from that this what where when who how why".split()
ASKING = "What|Who|Where|When|Why|How|Is|Are|Does|Do|Did|Can|Could|Should"
#: How far (in characters) an acronym may stand from a name to be its alias; the most groups of a form and of a frame.
NEAR, FORM_GROUPS, GROUPS = 28, 4, 6


def normalized(x: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[`\"']", "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9_.$/\s-]", " "), r"\s+", " "))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def slots_of(question: Column) -> Column:
    """The slots that a question asks for."""
    text = normalized(question)
    return F.array_compact(F.array(*[F.when(_any(text, words), slot) for slot, words in ASKS.items()]))


def subjects_of(question: Column) -> Column:
    """Groups of names that mean one subject each."""
    q = F.coalesce(question, F.lit(""))
    titles = F.regexp_extract_all(q, F.lit(r"\b[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)+\b"), 0)
    titles = F.filter(F.transform(titles, lambda t: F.regexp_replace(t, rf"^({ASKING})\s+", "")), lambda t: t.contains(" "))
    acronyms = F.regexp_extract_all(q, F.lit(r"\b[A-Z][A-Z0-9]+\b"), 0)
    beside = lambda t: F.filter(acronyms, lambda a: F.abs(F.position(a, q) - F.position(t, q)) <= NEAR)
    named = F.transform(titles, lambda t: F.concat(F.array(t), beside(t)))
    alone = F.transform(F.filter(acronyms, lambda a: ~F.exists(titles, lambda t: F.array_contains(beside(t), a))), lambda a: F.array(a))
    groups = F.concat(named, alone)
    keys = F.transform(groups, lambda g: F.lower(F.array_join(g, "|")))
    return F.slice(F.filter(groups, lambda g, i: F.array_position(keys, F.lower(F.array_join(g, "|"))) == i + 1), 1, FORM_GROUPS)


def _usable(groups: Column) -> Column:
    fits = lambda a: (F.length(normalized(a)) >= 2) & ~normalized(a).isin(NOT_SUBJECTS)
    return F.slice(F.filter(F.transform(groups, lambda g: F.filter(F.transform(g, lambda a: F.trim(a)), fits)), lambda g: F.size(g) > 0), 1, GROUPS)


def binds(text: Column, group: Column) -> Column:
    """Whether normalized evidence names a subject: by an alias, or by most words of one that has several."""

    def named(alias: Column) -> Column:
        a = normalized(alias)
        words = F.filter(F.split(a, " "), lambda w: (F.length(w) > 2) & ~w.isin(FILLERS))
        hits = F.size(F.filter(words, lambda w: text.contains(w)))
        return (F.length(a) >= 2) & (text.contains(a) | ((F.size(words) >= 2) & (hits >= F.greatest(F.lit(2), F.ceil(F.size(words) * 0.6)))))

    return F.exists(group, named)


def frames(questions: DataFrame) -> DataFrame:
    """questions (id, question) with subjects, slots, sensitive and strict; columns of these names hold what a caller knows."""
    has = lambda name, found: F.coalesce(F.col(name), found) if name in questions.columns else found
    out = questions.withColumn("subjects", _usable(has("subjects", subjects_of(F.col("question")))))
    out = out.withColumn("slots", F.array_intersect(has("slots", slots_of(F.col("question"))), F.array(*map(F.lit, ASKS))))
    out = out.withColumn("sensitive", has("sensitive", _any(normalized(F.col("question")), SENSITIVE)))
    return out.withColumn("strict", has("strict", F.lit(True)) & (F.size("subjects") > 0))


def assess(questions: DataFrame, citations: DataFrame) -> DataFrame:
    """For each question (id, question) whether its citations (id, citation, content, and quote if there is one) answer it:
    can_answer, missing (sentences), and supported (citations that name a subject; all where none is asked for).

    A question for a subject needs it named by some citation (if it is sensitive, the first subject); one that isn't strict
    about it needs one citation that names any.  Slots that nothing covers are missing; if none is covered, there is no answer."""
    framed = frames(questions).select("id", "subjects", "slots", "sensitive", "strict")
    framed = framed.withColumn("bound", F.when(F.col("sensitive"), F.slice("subjects", 1, 1)).otherwise(F.col("subjects")))
    quote = F.nullif(F.trim("quote"), F.lit("")) if "quote" in citations.columns else F.lit(None).cast("string")
    text = normalized(F.concat_ws(" ", "content", F.when(quote != F.trim("content"), quote)))
    rows = framed.join(citations.select("id", "citation", text.alias("text")), "id", "left")
    here = F.col("citation").isNotNull()
    hits = [F.coalesce(F.max(here & binds(F.col("text"), F.get("bound", F.lit(i)))), F.lit(False)).alias(f"g{i}") for i in range(GROUPS)]
    own = here & ((F.size("bound") == 0) | F.exists("bound", lambda g: binds(F.col("text"), g)))
    covers = [F.coalesce(F.max(here & _any(F.col("text"), words)), F.lit(False)).alias(f"c_{slot}") for slot, words in COVERS.items()]
    names = ["id", "subjects", "slots", "bound", "strict"]
    one = rows.groupBy("id").agg(*[F.first(c).alias(c) for c in names[1:]], F.count("citation").alias("n"), F.array_sort(F.collect_list(F.when(own, F.col("citation")))).alias("supported"), *hits, *covers)
    one = one.withColumn("absent", F.array_compact(F.array(*[F.when((F.size("bound") > i) & ~F.col(f"g{i}"), F.get(F.get("bound", F.lit(i)), F.lit(0))) for i in range(GROUPS)])))
    one = one.withColumn("bare", F.array_except("slots", F.array_compact(F.array(*[F.when(F.col(f"c_{slot}"), slot) for slot in COVERS]))))
    target = F.array_join(F.transform("subjects", lambda g: F.get(g, F.lit(0))), " / ")
    lost = F.array_join("absent", " / ")
    say = lambda *parts: F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    state = (
        F.when((F.col("n") == 0) & F.col("strict"), say("No supporting search results were returned for ", target, "."))
        .when((F.col("n") > 0) & F.col("strict") & (F.size("absent") > 0), say("No returned citation is explicitly bound to ", lost, " or a clear alias."))
        .when((F.col("n") > 0) & ~F.col("strict") & (F.size("bound") > 0) & (F.size("supported") == 0), say("No returned citation is sufficiently bound to the requested process/object: ", lost, "."))
        .when((F.col("n") > 0) & (F.size("slots") > 0) & (F.size("bare") == F.size("slots")), say("No returned citation supports the requested coverage: ", F.array_join("slots", ", "), "."))
    )
    gaps = F.when(F.col("n") > 0, F.transform("bare", lambda s: F.concat(F.lit("Evidence did not clearly cover requested slot: "), s, F.lit(".")))).otherwise(F.array().cast("array<string>"))
    return one.select("id", state.isNull().alias("can_answer"), F.coalesce(state, gaps).alias("missing"), F.when(state.isNull(), F.col("supported")).otherwise(F.array().cast("array<string>")).alias("supported"))
