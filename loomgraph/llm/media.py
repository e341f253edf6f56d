"""Media columns: archives of members, and a Spark data source that reads them by byte ranges.

write_archives packs one member for each row into archive files in a folder that
all executors share: a member is a small header and the compressed media bytes,
and an archive ends with the table of its members.  The data source `loom_media`
plans byte ranges over the folder's archives; a task reads the members that begin
in its range, streams them as Arrow batches of a bounded size, and retries each
member by its own offset.  Archives have names of their own for each attempt of a
task; those that count are in the manifest, a Parquet table beside them to which
Spark commits one attempt of each task.  The reader plans by the manifest alone,
so that archives of lost, repeated or speculative attempts are never read.

The stored form of a text is a WAV file of 8-bit mono samples: its UTF-8 bytes,
filled with zeros to a positive multiple of 64.  Defined results: a null text is
empty (64 zeros); a null id is kept; equal texts have equal stored forms, and
repeated rows are members of their own; a text of any length is one member, held
whole by the task that writes or reads it; an empty table makes no archive and
reads as no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import shared_dir

UNIT, RATE = 64, 8000
HEADER = "<qBIIIQ"  # id, has an id, stored bytes, media bytes, crc of the stored bytes, unpadded bytes
FOOTER = "<QI4s"  # place of the table, its entries, mark
MARK = b"LMA1"
MANIFEST = "manifest"
ARCHIVE_BYTES, BATCH_BYTES, RANGE_BYTES, TRIES = 64 << 20, 8 << 20, 8 << 20, 3
SCHEMA = "doc_id long, n_bytes long, media binary, archive string, offset long"


def wav(payload: bytes) -> bytes:
    """8-bit mono samples as a WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of a WAV file."""
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    return media[at + 8 : at + 8 + struct.unpack_from("<I", media, at + 4)[0]]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded bytes of a text, and how many are its own."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


class _Writer:
    def __init__(self, folder: str):
        self.files, self.root = fs.FileSystem.from_uri(folder)
        self.name, self.stream, self.table = "", None, []

    def add(self, number: int | None, text: str | None) -> bool:
        """Appends a member; true if the archive is full."""
        if self.stream is None:
            self.name = f"{uuid.uuid4().hex}.lma"
            self.stream, self.table = self.files.open_output_stream(f"{self.root}/{self.name}"), []
        payload, own = payload_of(text)
        media = wav(payload)
        stored = pa.compress(media, "zstd", asbytes=True)
        self.table.append(self.stream.tell())
        self.stream.write(struct.pack(HEADER, number or 0, number is not None, len(stored), len(media), zlib.crc32(stored), own))
        self.stream.write(stored)
        return self.stream.tell() >= ARCHIVE_BYTES

    def close(self) -> tuple[str, int, int]:
        """Ends an archive: its name, members and bytes."""
        at = self.stream.tell()
        self.stream.write(np.array(self.table, np.int64).tobytes())
        self.stream.write(struct.pack(FOOTER, at, len(self.table), MARK))
        size = self.stream.tell()
        self.stream.close()
        self.stream = None
        return self.name, len(self.table), size


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Packs the texts into archives in a shared folder, with their manifest; the number of members."""
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = _Writer(folder), []
        for batch in batches:
            for number, text in zip(batch.column(0), batch.column(1), strict=True):
                if writer.add(number.as_py(), text.as_py()):
                    done.append(writer.close())
        if writer.stream is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "members", "bytes"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    rows.mapInArrow(run, "archive string, members long, bytes long").write.parquet(f"{folder}/{MANIFEST}")
    return docs.sparkSession.read.parquet(f"{folder}/{MANIFEST}").agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.range_bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        files, root = fs.FileSystem.from_uri(self.folder)
        manifest = dataset.dataset(f"{root}/{MANIFEST}", filesystem=files, format="parquet", exclude_invalid_files=False).to_table(columns=["archive", "bytes"])
        found = sorted((f"{root}/{name}", size) for name, size in zip(*(c.to_pylist() for c in manifest.columns), strict=True))
        return [ByteRange(path, at, min(at + self.range_bytes, size)) for path, size in found for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        files, _ = fs.FileSystem.from_uri(self.folder)
        source, rows, held = files.open_input_file(part.archive), [], 0

        def member(at: int) -> tuple:
            """One member by its offset; another attempt opens the archive anew."""
            nonlocal source
            for attempt in range(TRIES):
                try:
                    source.seek(at)
                    number, has, stored, media, crc, own = struct.unpack(HEADER, source.read(struct.calcsize(HEADER)))
                    data = source.read(stored)
                    if len(data) != stored or zlib.crc32(data) != crc:
                        raise OSError(f"{part.archive} at {at}: a damaged member")
                    return number if has else None, own, pa.decompress(data, media, "zstd", asbytes=True), part.archive, at
                except (OSError, struct.error):
                    if attempt == TRIES - 1:
                        raise
                    source = files.open_input_file(part.archive)
            raise AssertionError

        size = source.size()
        source.seek(size - struct.calcsize(FOOTER))
        at, entries, mark = struct.unpack(FOOTER, source.read(struct.calcsize(FOOTER)))
        if mark != MARK:
            raise OSError(f"{part.archive} isn't an archive")
        source.seek(at)
        table = np.frombuffer(source.read(8 * entries), np.int64)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
        names = ["doc_id", "n_bytes", "media", "archive", "offset"]
        make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for offset in table[(table >= part.start) & (table < part.end)].tolist():
            rows.append(member(offset))
            held += len(rows[-1][2])
            if held >= BATCH_BYTES:
                yield make()
                rows, held = [], 0
        if rows:
            yield make()


class MediaSource(DataSource):
    """spark.read.format("loom_media").load(folder): the members of a folder of archives."""

    @classmethod
    def name(cls) -> str:
        return "loom_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaSource)
    return spark.read.format("loom_media").load(folder)


def feature(payload: bytes) -> str:
    """Mean, root mean square, crossings of the middle, and peak of 8-bit samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};crossings={crossings};peak={int(np.abs(x).max())}"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media = [x.as_py() for x in batch.column(2)]
        data = [samples(m) for m in media]
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([len(x) for x in data], pa.int64()),
                sha(data),
                pa.array([zlib.crc32(x[-UNIT:]) for x in data], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                sha(media),
                pa.array([feature(x) for x in data], pa.string()),
            ],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of the members of archives, as read."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, schema)


def new_folder(spark: SparkSession) -> str:
    """A fresh archive folder in the shared folder."""
    return f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
