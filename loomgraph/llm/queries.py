"""One query for each operator, over the whole tables, and the SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_examples, read_back
from .htmltext import main_text
from .langid import bucket, identify, learn
from .media import media_features, new_folder, read_archives, write_archives
from .merkle import manifest
from .mixing import mix
from .oracles import ORACLES  # noqa: F401
from .pieces import round_trip
from .probminhash import near_duplicates
from .quality import quality
from .ring import sharded
from .rlz import dedup_substrings
from .shared import table
from .trie import prefix_trie
from .urls import BLOCKED_HOSTS, RULES, filter_urls, read_lists

#: A public tokenizer's model file; a parameter of the queries that need one.
PIECE_MODEL = os.environ.get("LOOMGRAPH_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Text files of allowed and blocked URLs (urls.read_lists); unset: the lists of urls.py, which the SQL states.
URL_LISTS = os.environ.get("LOOMGRAPH_URL_LISTS")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its main text, the text's length, and the lines that page differencing deleted."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars", "n_shared")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, removed words, digest of the words that stay."""
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base counts, the base verdict, and the verdict of the threshold table."""
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = PIECE_MODEL) -> DataFrame:
    """Per document: piece ids, their number, and whether they decode to the text."""
    return round_trip(table(spark, sf_dir, "documents"), model_file)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, read back from its formatted examples: turns, the text under the loss mask, and sizes."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    return read_back(chat_examples(rows.unionByName(probe)))


def op7_url_filter(spark: SparkSession, sf_dir: str, lists: str | None = URL_LISTS) -> DataFrame:
    """Per page: host, path, the longest rule that fits, and the verdict.  lists: text files in place of the default lists."""
    rules, hosts = read_lists(spark, lists) if lists else (RULES, BLOCKED_HOSTS)
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules=rules, blocked_hosts=hosts).drop("url")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: digests and features of its media form, as read back from archives."""
    folder = new_folder(spark)
    write_archives(table(spark, sf_dir, "documents"), folder)
    return media_features(read_archives(spark, folder))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it was held out, its language and score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(bucket("doc_id") != 1))
    out = docs.select("doc_id", "text", F.coalesce(bucket("doc_id") == 1, F.lit(False)).alias("held_out"))
    return identify(out, model).drop("text")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its class of near copies, and whether it stays (the smallest id of each class does)."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("n_links")
    return out.withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per node of the trie of rebuilt conversations: its members, children, leaves, savings, and the digest of those that end there."""
    c = F.col("conv_id")
    return prefix_trie(table(spark, sf_dir, "conversations"), F.crc32(c.cast("string")) % 4, c - c % 20)


def op12_consistent_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its shard of 24 and its slot there; shards differ by one row at most."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharded(docs, "doc_id", 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its leaf, roots and proof, and whether what a receiver holds (some texts without line ends) proves right."""
    held = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    out = manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": held})
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_source_mixing": op5_source_mixing,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_url_filter": op7_url_filter,
    "op8_media_columns": op8_media_columns,
    "op9_language_id": op9_language_id,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_consistent_sharding": op12_consistent_sharding,
    "op13_merkle_manifest": op13_merkle_manifest,
}
