"""Stored communities: found once for a tenant and an access, and read until they are old or what they rest on has changed.

A build is a folder with the communities and their members; its row in the list of builds is written last and makes it
count, so that a build that was cut off is never read.  The list is partitioned by tenant and by a digest of the access:
who asks reads the builds of exactly the same rights only.  A build keeps a digest of the entities and facts that it was
made from, as that access sees them: a change of a hidden row doesn't make it stale.

Defined results: communities have two members or more; entities without a vector are members but don't count in a
community's vector, which is null where no member has one; without entities there are no communities.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import weighted_mean
from ..operators import graph as G
from ..operators.temporal import is_current
from ..security import Access, visible_rows
from ..storage import delete_folder, of_group, run_of_tables, written

BUILDS = "build string, built_at timestamp_ntz, state string, group_id string, access string"
COMMUNITIES = "label string, size long, salience double, level int, summary string, embedding array<double>"
MEMBERS = "label string, id string, name string"


def fingerprint(access: Access | None) -> str:
    """A digest of all that an access is judged by; equal for the same rights in another order."""
    if access is None:
        return "none"
    rights = [access.bypass, sorted(set(access.principals())), sorted(set(access.groups)), sorted(set(access.roles)), sorted(access.source_accounts.items())]
    return hashlib.sha256(json.dumps(rights).encode()).hexdigest()


def state(entities: DataFrame, facts: DataFrame) -> str:
    """A digest of rows in any order: their number and the sum of their hashes."""
    parts = []
    for rows, columns in ((entities, ("id", "name", "embedding")), (facts, ("id", "source", "relation", "target", "fact_text", "confidence"))):
        row = F.xxhash64(F.to_json(F.struct(*[c for c in columns if c in rows.columns])))
        n, total = rows.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
        parts.append(f"{n}:{total or 0}")
    return " ".join(parts)


@dataclass
class StoredCommunities:
    """The communities in a folder.  keep: builds of one tenant and access whose data stay, for those who still read them."""

    spark: SparkSession
    folder: str
    seconds: int = 300
    keep: int = 2

    def _builds(self, group_id: str, access: Access | None) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/builds")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        rows = self.spark.read.schema(BUILDS).parquet(f"{self.folder}/builds")
        return rows.filter((F.col("group_id") == group_id) & (F.col("access") == fingerprint(access))).orderBy(F.desc("built_at"), F.desc("build"))

    def _table(self, build: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/data/{build}/{name}")

    def current(self, entities: DataFrame, facts: DataFrame, access: Access | None, now: datetime, group_id: str = "default") -> str | None:
        """The name of the newest build, unless it is older than so many seconds or its rows have changed."""
        builds = self._builds(group_id, access)
        newest = builds.first() if builds is not None else None
        if newest is None or not 0 <= (now - newest["built_at"]).total_seconds() < self.seconds:
            return None
        seen = [visible_rows(of_group(rows, group_id), access) for rows in (entities, facts.filter(is_current()))]
        return newest["build"] if newest["state"] == state(*seen) else None

    def build(self, entities: DataFrame, facts: DataFrame, access: Access | None, now: datetime, group_id: str = "default") -> str:
        """Finds the communities of what an access sees now and stores them."""
        name = uuid.uuid4().hex
        with run_of_tables():
            seen = written(visible_rows(of_group(entities, group_id), access), "seen")
            held = written(visible_rows(of_group(facts, group_id).filter(is_current()), access), "held")
            edges = written(G.edges_of(held, seen, access), "edges")
            labels = G.propagate_labels(seen.select("id"), edges)
            found = written(G.communities(labels, edges), "communities")
            members = labels.join(found.select("label"), "label", "left_semi").join(seen, "id")
            members.select("label", "id", "name").write.parquet(f"{self.folder}/data/{name}/members")
            rows = found.join(G.community_summaries(labels, seen, held).select("label", "summary"), "label", "left")
            if "embedding" in seen.columns:
                rows = rows.join(weighted_mean(members.filter("embedding is not null"), "label", "embedding", F.lit(1.0)).withColumnRenamed("mean", "embedding"), "label", "left")
            else:
                rows = rows.withColumn("embedding", F.lit(None))
            rows.select("label", "size", "salience", F.lit(0).alias("level"), "summary", F.col("embedding").cast("array<double>").alias("embedding")).write.parquet(f"{self.folder}/data/{name}/communities")
            row = [(name, now, state(seen, held), group_id, fingerprint(access))]
            self.spark.createDataFrame(row, BUILDS).coalesce(1).write.mode("append").partitionBy("group_id", "access").parquet(f"{self.folder}/builds")
        for old in self._builds(group_id, access).limit(self.keep + 8).collect()[self.keep :]:  # a few: those before were deleted by earlier builds
            delete_folder(self.spark, f"{self.folder}/data/{old['build']}")
        return name

    def of(self, entities: DataFrame, facts: DataFrame, access: Access | None, now: datetime, group_id: str = "default") -> tuple[DataFrame, DataFrame]:
        """Communities (label, size, salience, level, summary, embedding) and members (label, id, name): stored ones, or new."""
        name = self.current(entities, facts, access, now, group_id) or self.build(entities, facts, access, now, group_id)
        return self._table(name, "communities", COMMUNITIES), self._table(name, "members", MEMBERS)
