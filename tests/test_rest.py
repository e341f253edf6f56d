"""REST sources: requests, waits, and streams that are stopped and go on."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.sources.rest import Client, Definition, filled, page, records, stream_rest


def test_requests_carry_config_auth_and_since():
    asked = []

    def fetch(url, params, headers):
        asked.append((url, params, headers))
        return json.dumps({"d": []})

    d = Definition("r", "R", "http://{{host}}/x", "rest", "d", since_param="from", since_format="unix", limit_param="n", headers={"X-Org": "{{org}}"}, auth="bearer", auth_value="{{key}}", config={"host": "h", "org": "o", "key": "s"})
    assert list(records(d.check(), fetch, "2024-01-01")) == []
    assert asked == [("http://h/x", {"from": "1704067200", "n": 100}, {"X-Org": "o", "Authorization": "Bearer s"})] and "'s'" not in repr(d)
    with pytest.raises(ValueError, match="missing config variable 'key'"):
        Definition("r", "R", "http://x", "rest", auth="query", auth_name="k", auth_value="{{key}}").check()
    assert filled("{{ a }}-b", {"a": 1}) == "1-b"
    basic = Definition("r", "R", "u", "t", auth="basic", auth_value="me:pw").request()[2]
    assert basic == {"Authorization": "Basic bWU6cHc="} and Definition("r", "R", "u", "t", auth="query", auth_name="k", auth_value="v").request()[1] == {"k": "v"}


def test_a_client_waits_as_it_is_told_and_gives_up():
    answers, slept = [(429, {"Retry-After": "7"}, ""), (429, {}, ""), OSError("down"), "[1]"], []

    def fetch(url, params):
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    assert Client(fetch, pause=1, sleep=slept.append).get("u", {}) == [1] and slept == [7.0, 2, 4]
    with pytest.raises(PermissionError, match="403"):
        Client(lambda u, p: (403, {}, "no"), sleep=slept.append).get("u", {})
    with pytest.raises(OSError):
        Client(lambda u, p: (429, {}, ""), tries=2, sleep=slept.append).get("u", {})
    spaced = []
    client = Client(lambda u, p: "[]", spacing=5, sleep=spaced.append)
    client.get("u", {}), client.get("u", {})
    assert len(spaced) == 1 and 4 < spaced[0] <= 5


@pytest.mark.parametrize("kind", ["cursor", "page", "offset"])
def test_a_stream_that_is_stopped_and_started_reads_each_record_once(spark, tmp_path, kind):
    store = tmp_path / "records.json"
    store.write_text(json.dumps(list(range(7))))

    def fetch(url, params, path=str(store)):
        with open(path) as f:
            rows = json.load(f)
        start = int(params.get("cursor", 0)) if kind == "cursor" else (params["page"] - 1) * 2 if kind == "page" else params["offset"]
        out = {"data": [{"id": r} for r in rows[start : start + 2]]}
        if kind == "cursor" and start + 2 < len(rows):
            out["next_cursor"] = str(start + 2)
        return json.dumps(out)

    d = Definition("r", "R", "http://x", "rest", "data", kind, limit=2)
    assert page(d, Client(fetch), None)[0] == [{"id": 0}, {"id": 1}]

    def run(fail=False):
        def write(batch, number):
            if fail and number == 1:
                raise RuntimeError("killed")
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{tmp_path}/rows/{number}")

        query = stream_rest(spark, [d], fetch, pages=2).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/rows").collect()
        return Counter(json.loads(r.payload)["id"] for r in rows)

    with pytest.raises(Exception, match="killed"):
        run(fail=True)
    assert run() == Counter(range(7))
    store.write_text(json.dumps(list(range(12))))
    assert run() == Counter(range(12)) and run() == Counter(range(12))
