"""REST sources: a definition, and a Spark data source that reads pages, one partition for each start.

A page is fetched by an injected function (url, parameters, headers) -> JSON text, or
(status, headers, text), so that recorded pages and live services read alike.
Fetches keep a distance, are retried with growing pauses, and wait as long as a
service that is asked too often (429) says.

As a stream, a source that only grows is read page by page: the driver follows the
pages' cursors (or numbers) and hands out references to the parts of pages that are
new; the executors fetch those pages side by side.  The offsets in the stream's
checkpoint hold each definition's cursor, the rows read of its last page, and the
batch's references, so a batch that is done again reads the same records.
"""

from __future__ import annotations

import base64
import inspect
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions import text as X

Fetch = Callable[..., str | tuple[int, dict, str]]


@dataclass
class Definition:
    """What a REST source is: where its records are in a page, and how pages follow each other."""

    id: str
    name: str
    url: str
    source_type: str
    records: str = ""
    pagination: str = "none"  # none, cursor, page or offset
    cursor_field: str = "next_cursor"
    cursor_param: str = "cursor"
    limit: int = 100
    content: str | None = None
    source_id: str | None = None
    since_param: str | None = None
    since_format: str = "iso"  # iso or unix (seconds)
    limit_param: str | None = None
    params: dict = field(default_factory=dict)
    headers: dict = field(default_factory=dict)  # templates over config, as url and auth_value are
    auth: str = "none"  # none, bearer, basic, header or query
    auth_name: str = "Authorization"
    auth_value: str = ""
    config: dict = field(default_factory=dict, repr=False)  # may hold secrets
    spacing: float = 0.0  # seconds between requests

    def check(self) -> Definition:
        if not (self.id and self.url and self.source_type):
            raise ValueError("a definition needs id, url and source_type")
        if self.pagination not in ("none", "cursor", "page", "offset"):
            raise ValueError(f"unknown pagination {self.pagination!r}")
        if self.auth not in ("none", "bearer", "basic", "header", "query"):
            raise ValueError(f"unknown auth {self.auth!r}")
        self.request()
        return self

    def request(self, since: str | None = None) -> tuple[str, dict, dict]:
        """URL, parameters and headers, with the values of config filled in."""
        url, params = filled(self.url, self.config), dict(self.params)
        headers = {k: filled(v, self.config) for k, v in self.headers.items()}
        secret = filled(self.auth_value, self.config)
        if self.auth == "bearer":
            headers["Authorization"] = f"Bearer {secret}"
        elif self.auth == "basic":
            headers["Authorization"] = f"Basic {base64.b64encode(secret.encode()).decode()}"
        elif self.auth == "header":
            headers[self.auth_name] = secret
        elif self.auth == "query":
            params[self.auth_name] = secret
        if since and self.since_param:
            at = datetime.fromisoformat(since)
            at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
            params[self.since_param] = str(int(at.timestamp())) if self.since_format == "unix" else since
        if self.limit_param:
            params[self.limit_param] = self.limit
        return url, params, headers


def filled(template: str, config: dict) -> str:
    """{{name}} replaced by config's values; a name that config lacks is an error."""

    def value(m: re.Match) -> str:
        if m[1] not in config:
            raise ValueError(f"missing config variable {m[1]!r}")
        return str(config[m[1]])

    return re.sub(r"\{\{\s*([\w.]+)\s*\}\}", value, template)


def at_path(value, path: str):
    for key in filter(None, path.split(".")):
        value = value.get(key) if isinstance(value, dict) else None
    return value


class Client:
    """Fetches one after the other, with a distance, retries and the waits that a service asks for."""

    def __init__(self, fetch: Fetch, spacing: float = 0.0, tries: int = 4, pause: float = 0.2, sleep: Callable[[float], None] = time.sleep):
        self.fetch, self.spacing, self.tries, self.pause, self.sleep, self.last = fetch, spacing, tries, pause, sleep, None
        self.takes_headers = sum(p.default is p.empty for p in inspect.signature(fetch).parameters.values()) > 2

    def get(self, url: str, params: dict, headers: dict | None = None) -> dict | list:
        for attempt in range(self.tries):
            if self.last is not None and (wait := self.spacing - (time.monotonic() - self.last)) > 0:
                self.sleep(wait)
            self.last, wait = time.monotonic(), self.pause * 2**attempt
            try:
                got = self.fetch(url, params, headers or {}) if self.takes_headers else self.fetch(url, params)
                status, said, text = got if isinstance(got, tuple) else (200, {}, got)
                if status == 429:
                    after = {k.lower(): v for k, v in said.items()}.get("retry-after")
                    wait = float(after) if after else wait
                    raise OSError("asked too often (429)")
                if status >= 400:
                    raise PermissionError(f"{url} answered {status}: {text[:200]}")
                return json.loads(text)
            except PermissionError:
                raise
            except (OSError, ValueError):
                if attempt == self.tries - 1:
                    raise
                self.sleep(wait)
        raise AssertionError


def page(d: Definition, client: Client, at, since: str | None = None) -> tuple[list, object]:
    """The records of the page at a position (None: the first one; a cursor, or a number from 0), and the next position or None."""
    url, params, headers = d.request(since)
    if d.pagination == "cursor" and at is not None:
        params[d.cursor_param] = at
    elif d.pagination == "page":
        params["page"] = (at or 0) + 1
    elif d.pagination == "offset":
        params["offset"] = (at or 0) * d.limit
    body = client.get(url, params, headers)
    rows = at_path(body, d.records) if d.records else body
    rows = rows if isinstance(rows, list) else []
    if d.pagination == "cursor":
        return rows, at_path(body, d.cursor_field) or None
    return rows, (at or 0) + 1 if d.pagination != "none" and len(rows) >= d.limit else None


def records(d: Definition, fetch: Fetch, since: str | None = None, most: int = 1_000_000) -> Iterator[dict]:
    """All records of all pages, in order."""
    client, at, seen = Client(fetch, d.spacing), None, 0
    while seen < most:
        rows, at = page(d, client, at, since)
        yield from rows
        seen += len(rows)
        if at is None:
            return


@dataclass
class Start(InputPartition):
    number: int


class RestReader(DataSourceReader):
    def __init__(self, definitions: list[Definition], fetch: Fetch, since: str | None):
        self.definitions, self.fetch, self.since = definitions, fetch, since

    def partitions(self) -> list[Start]:
        return [Start(i) for i in range(len(self.definitions))]

    def read(self, part: Start) -> Iterator[tuple]:
        d = self.definitions[part.number]
        for row in records(d, self.fetch, self.since):
            yield d.id, d.source_type, json.dumps(row, ensure_ascii=False)


def read_rest(spark: SparkSession, definitions: list[Definition], fetch: Fetch, since: str | None = None) -> DataFrame:
    """Records of REST sources (connector, source_type, payload), one partition for each definition."""
    checked = [d.check() for d in definitions]

    class RestSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "loom_rest"

        def schema(self) -> str:
            return "connector string, source_type string, payload string"

        def reader(self, schema) -> RestReader:
            return RestReader(checked, fetch, since)

    spark.dataSource.register(RestSource)
    return spark.read.format("loom_rest").load()


def stream_rest(spark: SparkSession, definitions: list[Definition], fetch: Fetch, since: str | None = None, pages: int = 32) -> DataFrame:
    """Records of REST sources that only grow, as a stream (connector, source_type, payload); so many pages of each definition a batch.

    A page is fetched twice: by the driver for its number of records and its successor, of which it keeps references only, and by
    the executor that reads it."""
    checked = {d.id: d.check() for d in definitions}

    class PageStream(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"at": {name: [None, 0] for name in checked}, "pages": []}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            ends, new = dict(start["at"]), []
            for name, d in checked.items():
                client, (at, seen) = Client(fetch, d.spacing), ends.get(name, [None, 0])
                for _ in range(pages):
                    rows, after = page(d, client, at, since)
                    if len(rows) > seen:
                        new.append([name, json.dumps(at), seen, len(rows)])
                    if after is None:
                        seen = len(rows)
                        break
                    at, seen = after, 0
                ends[name] = [at, seen]
            end = {"at": ends, "pages": new} if new else start
            return iter(map(tuple, new)), end

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter(map(tuple, end["pages"]))

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "loom_rest_pages"

        def schema(self) -> str:
            return "connector string, at string, begin int, end int"

        def simpleStreamReader(self, schema) -> PageStream:
            return PageStream()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clients = {name: Client(fetch, d.spacing) for name, d in checked.items()}
        for batch in batches:
            for row in batch.to_pylist():
                d = checked[row["connector"]]
                rows = page(d, clients[d.id], json.loads(row["at"]), since)[0][row["begin"] : row["end"]]
                texts = [json.dumps(r, ensure_ascii=False) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([d.id] * len(rows), pa.string()), pa.array([d.source_type] * len(rows), pa.string()), pa.array(texts, pa.string())], names=["connector", "source_type", "payload"])

    spark.dataSource.register(PageSource)
    refs = spark.readStream.format("loom_rest_pages").load()
    return refs.repartition("connector", "at").mapInArrow(read, "connector string, source_type string, payload string")


def to_episodes(rows: DataFrame, payload: str = "payload", content: str | None = None, source_id: str | None = None) -> DataFrame:
    """Episodes from JSON payloads: content and id by template, or found in the usual fields."""
    p: Column = F.col(payload)
    body = X.render(content, p) if content else X.detect_content(p)
    key = X.render(source_id, p) if source_id else F.coalesce(F.get_json_object(p, "$.id"), F.md5(p))
    return rows.select(*[c for c in rows.columns if c != payload], key.alias("source_id"), body.alias("content"), X.detect_date(p).alias("valid_at"))
