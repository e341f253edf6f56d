"""URL filters on a sorted digest array.

All list entries (rules host/path, and blocked hosts; small ones from Python, any
size as DataFrames) go into one index: their 64-bit xxhash digests, sorted, and
the full strings in the same order.  Spark sorts the entries by digest, and each
range of digests becomes files in the shared folder.  The index is checked against
MAX_BYTES; each executor maps the files into memory, or, where the folder isn't
mounted, holds OPEN_RANGES ranges at most.  A batch's candidate strings (every parent
domain of the host, with every path prefix as long as some rule's path) are hashed,
sent to the range of their digest, and probed there by one vectorised binary search; a
hit counts only if the stored string is equal, so that colliding digests can't match.

The longest rule that fits decides; a URL without a rule is blocked if its host
or a parent domain is a blocked host, else allowed.

Defined results: a null URL or one without :// has an empty host and path and is
allowed; of rules of one length the last by code points wins (two that fit are
then equal, so it is the same one); an entry on several rows counts once, a rule
with several verdicts blocks; a null entry is none; repeated rows are judged
alike; a URL of any length is judged whole; an empty table gives an empty result,
an empty list allows all; other columns pass through (a result column replaces one
of that name).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_dir

MAX_BYTES = 1 << 30
RANGE_BYTES = 64 << 20
OPEN_RANGES = 4  # held at once by a task that can't map them

#: The rules of the data contract, and the hosts that the default list blocks.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
BLOCKED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com", "adult-x.example.net", "free-bets.example.com", "casino-win.example.org", "ads-track.example.org")


def read_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules (rule, verdict) and blocked hosts (host) from text files of any size.  A line is `allow host/path`, `block host/path`
    or `block host`; blank lines, those that begin with # and those of another form are none."""
    line = r"^\s*(allow|block)\s+(\S+)\s*$"
    rows = spark.read.text(path).select(F.regexp_extract("value", line, 1).alias("verdict"), F.regexp_extract("value", line, 2).alias("entry")).filter("verdict <> ''")
    rules = rows.filter("instr(entry, '/') > 0").select(F.col("entry").alias("rule"), "verdict")
    return rules, rows.filter("instr(entry, '/') = 0 and verdict = 'block'").select(F.col("entry").alias("host"))


def _write_index(folder: str):
    """Rows (digest, entry, tag) of one range, in order: their files, and a row with the range's name, which begins with its
    first digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        table = pa.Table.from_batches(batches, pa.schema([("digest", pa.int64()), ("entry", pa.string()), ("tag", pa.int64())]))
        if table.num_rows:
            strings = [x.encode() for x in table.column("entry").to_pylist()]
            digests = np.asarray(table.column("digest")).view(np.uint64) ^ np.uint64(1 << 63)
            stem = f"{int(digests[0]):016x}-{uuid.uuid4().hex}"
            for kind, raw in (("digests", digests.tobytes()), ("offsets", np.cumsum([0, *map(len, strings)]).astype(np.int64).tobytes()), ("strings", b"".join(strings)), ("tags", np.asarray(table.column("tag")).tobytes())):
                with files.open_output_stream(f"{root}/{stem}-{kind}") as out:
                    out.write(raw)
            yield pa.RecordBatch.from_arrays([pa.array([stem])], names=["stem"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each entry, in signed order."""
    for batch in batches:
        keys = np.array([xxhash.xxh64_intdigest(x.encode()) for x in batch.column(0).to_pylist()], np.uint64) ^ np.uint64(1 << 63)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.columns], names=["digest", "entry", "tag"])


def build_index(entries: DataFrame) -> tuple[str, list[str]]:
    """Writes the index of entries (entry string, tag long; one row for each entry): its folder, and its ranges in order."""
    spark = entries.sparkSession
    total = entries.agg(F.sum(F.octet_length("entry") + 24)).first()[0] or 0
    if total > MAX_BYTES:
        raise ValueError(f"the list takes {total} bytes; at most {MAX_BYTES} can be mapped by each executor")
    folder = f"{shared_dir(spark)}/urls-{uuid.uuid4().hex}"
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root)
    ranges = max(1, -(-total // RANGE_BYTES))
    ordered = entries.mapInArrow(_hashed, "digest long, entry string, tag long").repartitionByRange(ranges, "digest").sortWithinPartitions("digest", "entry")
    return folder, sorted(r.stem for r in ordered.mapInArrow(_write_index(folder), "stem string").collect())


class DigestIndex:
    """Sorted digests, and the strings and tags in the same order, in ranges: files that are mapped where the folder is mounted,
    and else read when a key falls into their range."""

    def __init__(self, folder: str, stems: list[str]):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.mounted = isinstance(self.files, fs.LocalFileSystem)
        self.stems, self.open = stems, {}
        self.firsts = np.array([int(s[:16], 16) for s in stems], np.uint64)

    def _column(self, stem: str, kind: str, of: type) -> np.ndarray:
        path = f"{self.root}/{stem}-{kind}"
        if not self.files.get_file_info(path).size:
            return np.zeros(0, of)
        if self.mounted:
            return np.memmap(path, of, "r")
        with self.files.open_input_file(path) as source:
            return np.frombuffer(source.read(), of)

    def _range(self, i: int) -> list[np.ndarray]:
        if i not in self.open:
            while not self.mounted and len(self.open) >= OPEN_RANGES:
                del self.open[next(iter(self.open))]
            self.open[i] = [self._column(self.stems[i], kind, of) for kind, of in (("digests", np.uint64), ("offsets", np.int64), ("strings", np.uint8), ("tags", np.int64))]
        return self.open[i]

    def find(self, texts: list[bytes]) -> np.ndarray:
        """The tag of each string; -1: not in the index."""
        keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
        out = np.full(len(texts), -1, np.int64)
        home = np.searchsorted(self.firsts, keys, "right") - 1  # equal digests are of one range
        order = np.argsort(home, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            if not len(own) or home[own[0]] < 0:
                continue
            digests, offsets, strings, tags = self._range(int(home[own[0]]))
            at, live = np.searchsorted(digests, keys[own]), np.arange(len(own))
            while len(live):
                live = live[at[live] < len(digests)]
                live = live[digests[at[live]] == keys[own[live]]]
                same = np.array([strings[offsets[at[i]] : offsets[at[i] + 1]].tobytes() == texts[own[i]] for i in live], bool)
                out[own[live[same]]] = tags[at[live[same]]]
                live = live[~same]
                at[live] += 1
        return out


ALLOW, BLOCK, HOST = 0, 1, 2  # tags of entries


def _judge(folder: str, stems: list[str], widths: list[int], fields: list[str]):
    def candidates(host: str, path: str) -> list[bytes]:
        labels = host.split(".")
        parents = [".".join(labels[i:]) for i in range(len(labels))] if host else []
        return [(p + path[:w]).encode() for p in parents for w in widths if len(path) >= w] + [b"\0" + p.encode() for p in parents]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex(folder, stems)
        known: dict[tuple[str, str], tuple[str | None, str]] = {}
        reach = max(widths, default=0)
        for batch in batches:
            old = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            keys = [(h, p[:reach]) for h, p in zip(old["host"].to_pylist(), old["path"].to_pylist(), strict=True)]
            if len(known) > 200_000:
                known.clear()
            fresh = [k for k in dict.fromkeys(keys) if k not in known]
            groups = [candidates(*k) for k in fresh]
            tags = index.find([t for g in groups for t in g])
            done = 0
            for k, g in zip(fresh, groups, strict=True):
                own = tags[done : done + len(g)].tolist()
                done += len(g)
                fits = [(x.decode(), tag) for x, tag in zip(g, own, strict=True) if tag in (ALLOW, BLOCK)]
                rule = max(fits, key=lambda r: (len(r[0]), r[0]), default=None)
                known[k] = (rule[0], ("allow", "block")[rule[1]]) if rule else (None, "block" if HOST in own else "allow")
            new = {"rule": pa.array([known[k][0] for k in keys], pa.string()), "verdict": pa.array([known[k][1] for k in keys], pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(f, old.get(f)) for f in fields], names=fields)

    return run


def filter_urls(pages: DataFrame, url_col: str = "url", rules: dict[str, str] | DataFrame = RULES, blocked_hosts: tuple[str, ...] | DataFrame = BLOCKED_HOSTS) -> DataFrame:
    """pages with host, path, rule (the longest that fits, or null) and verdict (allow or block).

    rules: {host/path: verdict}, or a DataFrame (rule, verdict); blocked_hosts: names, or a DataFrame (host)."""
    spark: SparkSession = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules.items()), "rule string, verdict string")
    if not isinstance(blocked_hosts, DataFrame):
        blocked_hosts = spark.createDataFrame([(h,) for h in blocked_hosts], "host string")
    of_rules = rules.filter("rule is not null and instr(rule, '/') > 0").select(F.col("rule").alias("entry"), F.when(F.col("verdict") == "allow", ALLOW).otherwise(BLOCK).alias("tag"))
    of_hosts = blocked_hosts.filter("host is not null").select(F.concat(F.lit("\0"), F.col("host")).alias("entry"), F.lit(HOST).alias("tag"))
    folder, stems = build_index(of_rules.unionByName(of_hosts).groupBy("entry").agg(F.max("tag").cast("long").alias("tag")))
    widths = [r[0] for r in of_rules.select((F.length("entry") - F.instr("entry", "/") + 1).alias("w")).distinct().orderBy("w").collect()]
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = {"host": F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), upper, lower), "path": F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)}
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(n) for n, c in parts.items()])
    schema = T.StructType([*split.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return split.mapInArrow(_judge(folder, stems, widths, schema.names), schema)
