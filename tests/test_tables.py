"""Table functions in SQL."""

import pytest

from loomgraph.functions.tables import register


def test_people_and_quotes_by_lateral_join_and_partition(spark):
    register(spark)
    docs = spark.createDataFrame([(1, "Ask jo.doe@x.org or @Anna or JO.DOE@x.org"), (2, None), (3, "")], "id long, text string")
    got = spark.sql("select d.id, p.* from {docs} d, lateral extract_people(d.text) p", docs=docs).collect()
    assert [(r.id, r.name, r.confidence) for r in got if r.value == "jo.doe@x.org"] == [(1, "jo doe", 0.7)] and {r.name for r in got} >= {"Anna"} and {r.id for r in got} == {1}
    said = spark.createDataFrame([("a", 2, "find ME here", "me"), ("a", 1, "nothing", "me"), ("a", 3, "me again", "me"), ("b", 1, None, "me"), ("c", 1, "me", "")], "k string, at int, content string, needle string")
    out = spark.sql("select * from quotes(table(select * from {said}) partition by k order by (at), 'content', 'needle')", said=said)
    assert out.columns == ["k", "at", "number", "quote"] and [tuple(r) for r in out.collect()] == [("a", 2, 2, "ME here")]
    with pytest.raises(Exception, match="no text column 'nope'"):
        spark.sql("select * from quotes(table(select * from {said}) partition by (k), 'nope', 'needle')", said=said).collect()
