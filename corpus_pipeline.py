"""The corpus pipeline: five stages, each over the documents that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, whatever other columns docs has and however
they are named.

Defined results, for each stage as for its operator: a document with a null or
letterless text goes (language ID); null ids, sources and languages stay null;
repeated rows are exact copies, of which one stays; texts of any length are
worked on whole; empty documents make an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.langid import bucket, identify, learn
from loomgraph.llm.mixing import mixed_texts
from loomgraph.llm.pieces import round_trip
from loomgraph.llm.probminhash import one_of_each
from loomgraph.llm.queries import PIECE_MODEL
from loomgraph.llm.rlz import dedup_substrings
from loomgraph.llm.shared import removed, written

#: A document goes if its language can't be told (`und`) or the machines are less sure than this.
LEAST_SCORE = 0.05
#: Columns that substring dedup adds.
REMOVAL = ("n_words", "n_removed", "factors", "dup_spans")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels documents with their predicted language (in lang) and drops those without one."""
    model = learn(docs.filter(bucket("doc_id") != 1))
    named = docs.withColumnsRenamed({c: f"__own_{c}" for c in ("lang_pred", "score") if c in docs.columns})
    kept = identify(named, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    kept = kept.withColumn("lang", F.col("lang_pred")).drop("lang_pred", "score")
    return kept.withColumnsRenamed({f"__own_{c}": c for c in ("lang_pred", "score")}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near copies; rows without an id stay."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of repeated 20-word windows; a document that loses all of its words goes."""
    named = docs.withColumnsRenamed({c: f"__own_{c}" for c in REMOVAL if c in docs.columns})
    kept = dedup_substrings(named).filter((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    kept = kept.withColumn("n_chars", F.length("text").cast("long")).drop(*REMOVAL)
    return kept.withColumnsRenamed({f"__own_{c}": c for c in REMOVAL}).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources: a row for each copy, or part, that the mix takes of a document."""
    return mixed_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, their number, and whether they decode to the text."""
    return round_trip(docs, PIECE_MODEL)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: The learned machines, near copies and pieces have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
        if before is not None:
            removed(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
