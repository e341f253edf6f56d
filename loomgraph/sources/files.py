"""A folder of text files as episodes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of text files.
EXTENSIONS = ("md", "txt", "markdown")


def text_files(spark: SparkSession, folder: str, since: str | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files below folder with such an extension, not blank, not in hidden folders or node_modules, changed since a time."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    if since:
        reader = reader.option("modifiedAfter", since)
    root = folder.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root) + "/", "")
    rows = reader.load(folder).withColumn("rel", rel).withColumn("content", F.decode("content", "UTF-8"))
    rows = rows.filter(~F.col("rel").rlike(r"(^|/)(\.|node_modules(/|$))")).filter(F.trim("content") != "")
    return rows.select(
        F.concat(F.lit("file://"), "rel").alias("source_id"),
        F.lit("file").alias("source_type"),
        "content",
        F.col("modificationTime").cast("timestamp_ntz").alias("valid_at"),
        F.to_json(F.struct(F.col("rel").alias("path"), F.col("length").alias("size"))).alias("metadata"),
    )
