"""Grounded answers: memory and search results as evidence, gates, citations, and an extractive answer."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import memory as M
from ..security import visible_rows
from . import retrieval as R


def subjects(question: str) -> list[str]:
    """Names that a question is about: runs of capitalised words (not at its start alone) and acronyms, lower-cased."""
    found = re.findall(r"\b(?:[A-Z][\w&-]*(?:\s+[A-Z][\w&-]*)*)\b", question)
    out = [" ".join(w for w in f.split() if w.lower() not in (*STOP_WORDS, "what", "who", "when", "where", "why", "how", "did", "does", "which")) for f in found]
    return list(dict.fromkeys(o.lower() for o in out if o))


def bound(rows: DataFrame, question: str, share: float = 0.6) -> DataFrame:
    """Evidence that names a subject of the question by at least this share of the subject's words; all of it where the
    question names none."""
    named = subjects(question)
    if not named:
        return rows
    hit = F.lit(False)
    for s in named:
        hit = hit | _names(F.lower("content"), s, share)
    return rows.filter(hit)


def _names(low: Column, subject: str, share: float = 0.6) -> Column:
    words = subject.split()
    return sum((low.contains(w).cast("int") for w in words), F.lit(0)) >= max(1, round(share * len(words)))


@dataclass
class Answer:
    """One row with the answer and its confidence, and the citations that it rests on."""

    answer: DataFrame
    citations: DataFrame


def unanswerable(rows: DataFrame, question: str, coverage: tuple[str, ...] = ()) -> DataFrame:
    """What evidence (content) lacks, one row each (missing): subjects of the question that no row names, and, if no row holds any
    of the words of coverage, these."""
    low = F.lower("content")
    named = subjects(question)
    parts = [F.when(F.count_if(_names(low, s)) == 0, F.lit(s)) for s in named]
    if coverage:
        some = F.lit(False)
        for word in coverage:
            some = some | low.contains(word.lower())
        parts.append(F.when(F.count_if(some) == 0, F.lit(", ".join(coverage))))
    return rows.agg(F.array_compact(F.array(*parts) if parts else F.array().cast("array<string>")).alias("m")).select(F.explode("m").alias("missing"))


def trace(corpus: R.Corpus, memory: DataFrame, request: R.Request) -> dict[str, DataFrame]:
    """What an answer could rest on: the newest visible episodes, facts and memory objects, and each method's list."""
    newest = lambda rows, n: visible_rows(rows, request.access).orderBy(F.desc("valid_at"), "id").limit(n)
    lists = {m: R.METHODS[m](corpus, request) for m in R.METHODS if m in request.methods and (m != "semantic" or request.vector is not None)}
    return {"episodes": newest(corpus.episodes, 40), "facts": newest(corpus.facts, 60), "memory": newest(memory, 60)} | lists


def answer(corpus: R.Corpus, memory: DataFrame, request: R.Request, relevant: Callable[[DataFrame], DataFrame] | None = None, coverage: tuple[str, ...] = (), limit: int = 12) -> Answer:
    """Memory objects and search results, with the source episodes of facts, as one evidence list; only evidence that names the
    question's subjects is cited, and none where one of them is named nowhere, or nothing holds a word of the asked coverage.
    A question that names no subject and asks no coverage has no such proof: there a judge must be injected that lets evidence
    through; without one the gate is closed and nothing is cited.  Without citations the answer is empty."""
    none = {"confidence": F.lit(None).cast("double"), "quote": F.lit(None).cast("string")}
    own = lambda rows: [rows[c] if c in rows.columns else none[c].alias(c) for c in none]
    columns = ["type", "id", "score", "content", *none]
    said = M.memory_search(memory, request.query, request.access, 8).join(memory.select("id", F.col("summary").alias("content"), *own(memory)), "id")
    lists = [said.withColumns({"type": F.lit("memory"), "list_no": F.lit(0)}).select("list_no", *columns)]
    found = R.search(corpus, request)
    sure = corpus.facts.select(F.lit("fact").alias("type"), "id", *own(corpus.facts))
    lists.append(found.join(sure, ["type", "id"], "left").withColumn("list_no", F.lit(1)).select("list_no", *columns))
    if "episode_id" in corpus.facts.columns:
        source = R.expand_sources(found.select("id", "score", "content"), corpus.facts.select("id", "episode_id"), corpus.episodes, request.access)
        lists.append(source.withColumns({"type": F.lit("episode"), "list_no": F.lit(2)} | none).select("list_no", *columns))
    rows = lists[0]
    for more in lists[1:]:
        rows = rows.unionByName(more)
    found_rows = R.evidence(rows.withColumn("pos", -F.col("score")), limit)
    kept = bound(found_rows, request.query)
    if subjects(request.query) or coverage:
        gate = unanswerable(found_rows, request.query, coverage).agg((F.count("*") == 0).alias("open")).filter("open").withColumn("__one", F.lit(1))  # a row or none
        kept = kept.withColumn("__one", F.lit(1)).join(F.broadcast(gate), "__one", "left_semi").drop("__one")
    else:
        kept = relevant(kept) if relevant else kept.limit(0)
    cited = R.citations(kept, limit)
    return Answer(R.extractive_answer(cited), cited)
