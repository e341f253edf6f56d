"""Stored communities: kept apart by access, made again when they are old or what they rest on has changed."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.bridge import policy_of
from loomgraph.indexes.communities import StoredCommunities, fingerprint
from loomgraph.security import Access
from loomgraph.storage import new_folder

NOW = datetime(2001, 1, 1)
INSIDE = Access(groups=("security", "ops"))
LINKS = [("f1", "a", "b", 3), ("f2", "b", "c", 3), ("f3", "x", "y", 0), ("f4", "y", "z", 0)]  # the second group is for security


def rows(spark, links):
    names = [(n, f"name {n}", [1.0, 0.0] if n < "m" else ([0.0, 1.0] if n != "z" else None), 3 if n < "m" else 0) for n in "abcxyz"]
    e = spark.createDataFrame(names, "id string, name string, embedding array<float>, acl int").withColumn("visibility", policy_of(F.col("acl")))
    f = spark.createDataFrame([(i, s, "r", t, f"{s} r {t}", 0.5, a) for i, s, t, a in links], "id string, source string, relation string, target string, fact_text string, confidence double, acl int")
    never = F.lit(None).cast("timestamp_ntz")
    return e, f.withColumn("valid_at", never).withColumn("created_at", never).withColumn("invalid_at", never).withColumn("visibility", policy_of(F.col("acl")))


def names(stored, e, f, access, now=NOW):
    found, members = stored.of(e, f, access, now)
    held = {r.label: sorted(r.ids) for r in members.groupBy("label").agg(F.collect_list("id").alias("ids")).collect()}
    assert {r.label: r.size for r in found.collect()} == {label: len(ids) for label, ids in held.items()}
    return sorted(held.values()), {r.label: r.embedding and list(r.embedding) for r in found.collect()}


@pytest.fixture
def stored(spark):
    return StoredCommunities(spark, new_folder(spark, "communities-test"))


def test_another_access_never_reads_them(spark, stored):
    e, f = rows(spark, LINKS)
    groups, vectors = names(stored, e, f, INSIDE)
    assert groups == [["a", "b", "c"], ["x", "y", "z"]] and sorted(vectors.values()) == [[0.0, 1.0], [1.0, 0.0]]
    assert stored.current(e, f, None, NOW) is None and stored.current(e, f, Access(groups=("security",)), NOW) is None
    assert names(stored, e, f, None)[0] == [["a", "b", "c"]]
    assert stored.current(e, f, Access(groups=("ops", "security", "ops")), NOW) == stored.current(e, f, INSIDE, NOW) is not None
    assert fingerprint(None) != fingerprint(Access()) != fingerprint(Access(bypass=True))


def test_they_are_made_again_when_stale(spark, stored):
    e, f = rows(spark, LINKS)
    first = stored.build(e, f, None, NOW)
    assert stored.current(e, f, None, NOW + timedelta(seconds=299)) == first
    assert stored.current(e, f, None, NOW + timedelta(seconds=300)) is None and stored.current(e, f, None, NOW - timedelta(seconds=1)) is None
    assert stored.current(*rows(spark, LINKS[:3]), None, NOW) == first  # a hidden fact went
    assert stored.current(*rows(spark, LINKS[1:]), None, NOW) is None
    assert names(stored, *rows(spark, LINKS[1:]), None, NOW + timedelta(seconds=1))[0] == [["b", "c"]]


def test_a_build_that_was_cut_off_is_not_read_and_old_ones_go(spark, stored):
    e, f = rows(spark, LINKS)
    first = stored.build(e, f, None, NOW)
    spark.range(1).write.parquet(f"{stored.folder}/data/cut-off/communities")
    assert stored.current(e, f, None, NOW) == first
    later = [stored.build(e, f, None, NOW + timedelta(seconds=s)) for s in (1, 2)]
    assert stored.current(e, f, None, NOW + timedelta(seconds=3)) == later[1]
    assert stored._table(later[0], "members", "id string").count() == 3
    with pytest.raises(Exception, match="(?i)path.*not.*exist"):
        stored._table(first, "members", "id string").count()


def test_empty_tables(spark, stored):
    e, f = rows(spark, LINKS)
    assert names(stored, e.limit(0), f.limit(0), INSIDE) == ([], {})
