"""Every registered query of the graph engine against its SQL twin, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from loomgraph import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


#: Queries without SQL, and where they are held against plain versions.
ELSEWHERE = {"graph_hybrid_search": "below", "entity_clusters": "test_build", "relation_clusters": "test_build", "vector_index_neighbours": "test_indexes"}
#: Second names of one query.
TWICE = {"lpa_sync", "community_salience", "components"}


def test_queries_without_sql_are_tested_elsewhere():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set(ELSEWHERE)


def test_graph_search_is_the_fusion_of_its_lists(spark, small):
    """The five lists, fused, boosted and cut in plain Python, are the query's rows."""
    from loomgraph import bridge
    from loomgraph.plans import retrieval as R
    from loomgraph.plans.search_queries import probe
    from loomgraph.plans.temporal_queries import SECURITY

    e, f = bridge.entities(spark, small), bridge.facts(spark, small)
    seeds = spark.createDataFrame([("supplier:3",), ("nation:3",)], "id string")
    asked = R.Request("supplier 3 priority", probe(spark, small), now="2001-08-01", access=SECURITY, limit=20, methods=tuple(R.METHODS), seeds=seeds)
    raw, valid = {}, {}
    for n, method in enumerate(R.METHODS):
        for r in R.METHODS[method](R.Corpus(e, f, bridge.episodes(spark, small)), asked).collect():
            key = (r.type, r.id)
            raw[key] = raw.get(key, 0) + 1 / (60 + r.pos)
            valid.setdefault(key, ((n, r.pos), r.valid_at))
            valid[key] = min(valid[key], ((n, r.pos), r.valid_at), key=lambda v: v[0])
    most, out = max(raw.values()), []
    for key, value in raw.items():
        at = valid[key][1]
        age = max(0.0, (datetime.datetime(2001, 8, 1) - at).total_seconds() / 86400) if at else None
        out.append((value / most * (1 if age is None else 1 + 0.1 * max(0.0, 1 - math.log(age + 1) / math.log(365))), key))
    out.sort(key=lambda x: (-x[0], x[1]))
    got = catalog.queries()["graph_hybrid_search"](spark, small).collect()
    assert [(r.type, r.id) for r in got] == [key for _, key in out[:20]] and [r.score for r in got] == [pytest.approx(s, abs=2e-6) for s, _ in out[:20]]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - {"graph_hybrid_search"} - TWICE))
def test_query_matches_sql(spark, small, duck, name):
    frame = catalog.queries()[name](spark, small)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(plain, r)) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    if name not in catalog.oracle_sql():
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
