"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is a reference block.  The index of all blocks holds the first
(block, position) of every cell: a cell is a run of consecutive windows that
share the same smallest word n-gram, its anchor.  Which n-gram is smallest
depends on a window's own words only, so equal windows meet at equal anchors
wherever they stand.  A document is parsed against the whole index at once.  The
parse is greedy: a factor (start, length, block, position) takes cell after cell
as long as the next cell's entry continues the same block, and ends where it
doesn't.  A cell that is the first of its kind, but shares its anchor with other
contents, lies at a factor boundary: there the windows are looked up one by one,
and those that start earlier become factors too.  The words under all factors are
the duplicate spans; a factor has one window at least, so none is shorter.

Cells and windows are confirmed by 128 bits of hashes of their words (the anchor
and the contents, or two of the window), not by stored words.

Rows move as follows: anchors by their hash, repeated cells with their entries
back to their document, the texts once, and only the windows of boundary cells by
their own hash.  In each task the repeats of what the task has seen take that as
their entry at once, so that a frequent cell sends one row from a buffer of a
million, not all; the rows of one anchor are then streamed in order, so that no
group is held in memory.

Defined results: a null text has no words; rows are documents in the order of id
and, for one id, of a digest of the text (32 bits tell texts of one id apart);
rows equal in both count once and are treated alike; a null id stays null and has
the place in the order that a hash of its text gives; a text of any length is
parsed whole; an empty table gives an empty result; other columns pass through
unchanged, whatever their names (but for __rlz_*).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Words, as_signed, gram_hashes, joined_words, list_array, mix, slices, text_bytes, written

GRAM = 6
BUFFER = 1_000_000  # rows of a task that are held against repeats
LOW = (1 << 31) - 1  # the bits of a place that are the position; the 32 above it are the digest of the text
ROW = "h long, e long, k long, place long"
FOUND = "k long, t int, at long, block long"  # at: position << 32 | position in the block + 1; 0 there: a first cell at a boundary


def _smallest(g: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost smallest of g[i : i + span] for each i with span entries left."""
    value, at, width = g, np.arange(len(g), dtype=np.int64), 1
    while width < span:
        step = min(width, span - width)
        left, right = value[:-step], value[step:]
        first = left <= right
        value, at = np.where(first, left, right), np.where(first, at[:-step], at[step:])
        width += step
    return at


class Cells:
    """The cells of a run of documents: anchor position and hash, first window, number of windows, and a hash of the contents."""

    def __init__(self, words: Words, window: int):
        n = len(words.start)
        self.words = words
        empty = np.zeros(0, np.int64)
        self.anchor = self.first = self.size = empty
        self.hash = self.content = self.grams = empty.astype(np.uint64)
        if n < window:
            return
        by = gram_hashes(words.hashes(), (GRAM, window))
        short, self.grams = mix(by[GRAM]), mix(by[window])
        at = np.flatnonzero(words.left() >= window)
        if not len(at):
            return
        anchor = _smallest(short[: n - GRAM + 1], window - GRAM + 1)[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(fresh)
        self.size = np.diff(np.append(head, len(at)))
        self.first, self.anchor = at[head], anchor[head]
        self.hash = short[self.anchor]
        inside = np.arange(len(at)) - np.repeat(head, self.size)
        salt = mix(np.arange(1, window + 1, dtype=np.uint64))
        value = self.grams[at] * (salt[np.minimum(inside, window - 1)] | np.uint64(1))
        self.content = mix(np.add.reduceat(value, head) + salt[np.minimum(self.anchor - self.first, window - 1)] + self.size.astype(np.uint64))


class _Combined:
    """Rows (h, e, k, place) of one task.  Repeats of (h, e) among the held rows leave as found rows: h and e are then the
    block and the position that they repeat, and place is negative (~place)."""

    names = ["h", "e", "k", "place"]

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, h: np.ndarray, e: np.ndarray, k: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((h.astype(np.uint64).view(np.int64), e.astype(np.uint64).view(np.int64), k, place))
        self.held += len(h)
        if self.held > BUFFER:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        h, e, k, place = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        some = np.zeros(len(h), bool)
        some[1:] |= same
        some[:-1] |= same
        some = order[some]
        some = some[np.lexsort((place[some], k[some], e[some], h[some]))]
        fresh = np.ones(len(some), bool)
        fresh[1:] = (h[some][1:] != h[some][:-1]) | (e[some][1:] != e[some][:-1])
        source = some[np.maximum.accumulate(np.where(fresh, np.arange(len(some)), 0))][~fresh]
        late = some[~fresh]
        real = (k[late] != k[source]) | (place[late] != place[source])  # an equal row is no repeat
        h2, e2, place2 = h.copy(), e.copy(), place.copy()
        h2[late], e2[late], place2[late] = k[source], place[source] & LOW, ~place[late]
        keep = np.ones(len(h), bool)
        keep[late[~real]] = False
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h2, e2, k, place2)], names=self.names)


def _places(part: pa.RecordBatch, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id and the place of position at in each row doc."""
    k, t = (np.asarray(part.column(part.schema.get_field_index(c))) for c in ("__rlz_k", "__rlz_t"))
    return k[doc], (t[doc].view(np.uint32).astype(np.int64) << 31) | at


def _index_rows(window: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combined = _Combined()
        for batch in batches:
            for part in slices(batch, text):
                words = Words(*text_bytes(part.column(part.schema.get_field_index(text))))
                cells = Cells(words, window)
                doc = np.searchsorted(words.bound, cells.anchor, side="right") - 1
                yield from combined.add(cells.hash, cells.content, *_places(part, doc, cells.anchor - words.bound[doc]))
        yield from combined.rows()

    return run


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    combined = _Combined()
    for batch in batches:
        at, row = _flat(batch, "__rlz_at")
        w1, w2 = (_flat(batch, c)[0] for c in ("__rlz_w1", "__rlz_w2"))
        yield from combined.add(w1, w2, *_places(batch, row, at.astype(np.int64)))
    yield from combined.rows()


def _repeats(boundaries: bool):
    """From rows in the order h, e, k, place: each row after the first of its (h, e), with that first one as its entry; and,
    if boundaries are asked for, the first rows of an h that has several e."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(k: np.ndarray, place: np.ndarray, block: np.ndarray, position: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array((place >> 31).astype(np.uint32).view(np.int32)), pa.array((place & LOW) << 32 | position), pa.array(block)], names=["k", "t", "at", "block"])

        def first(rows: tuple) -> pa.RecordBatch:
            return found(rows[2], rows[3], np.zeros(len(rows[2]), np.int64), np.zeros(len(rows[2]), np.int64))

        held, mixed_before = None, False  # the first row of the last (h, e) so far, and whether its h had another e before
        for batch in batches:
            h, e, k, place = (np.asarray(c) for c in batch.columns)
            done = place < 0
            if done.any():
                yield found(k[done], ~place[done], h[done], e[done] + 1)
                h, e, k, place = (x[~done] for x in (h, e, k, place))
            if not len(h):
                continue
            if held is not None:
                h, e, k, place = (np.concatenate([[x], y]) for x, y in zip(held, (h, e, k, place), strict=True))
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (e[1:] != e[:-1])
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
            late = ~fresh & ((k != k[head]) | (place != place[head]))
            if late.any():
                yield found(k[late], place[late], k[head[late]], (place[head[late]] & LOW) + 1)
            h, e, k, place = (x[fresh] for x in (h, e, k, place))
            mixed = np.zeros(len(h), bool)
            same = h[1:] == h[:-1]
            mixed[1:] |= same
            mixed[:-1] |= same
            mixed[0] |= held is not None and mixed_before
            held, mixed_before = (h[-1], e[-1], k[-1], place[-1]), bool(mixed[-1])
            mixed[-1] = False
            if boundaries and mixed.any():
                yield first((h[mixed], e[mixed], k[mixed], place[mixed]))
        if boundaries and mixed_before:
            yield first(tuple(np.array([x]) for x in held))

    return run


def _factors(at: np.ndarray, size: np.ndarray, doc: np.ndarray, block: np.ndarray, position: np.ndarray, window: int) -> tuple:
    """Greedy factors of runs of windows (first window, number, row, block, position of the first window in it), in order:
    first word, length, row, block and position."""
    if not len(at):
        return at, at, doc, block, position
    begin = np.ones(len(at), bool)
    step = size[:-1]
    begin[1:] = (doc[1:] != doc[:-1]) | (block[1:] != block[:-1]) | (at[1:] != at[:-1] + step) | (position[1:] != position[:-1] + step)
    head = np.flatnonzero(begin)
    last = np.append(head[1:], len(at)) - 1
    return at[head], at[last] + size[last] - at[head] + window - 1, doc[head], block[head], position[head]


def _covered(first: np.ndarray, size: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words the windows first .. first + size - 1 cover."""
    depth = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(first + size + window - 1, minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:n] > 0


def _packed(column: pa.Array, wanted: np.ndarray) -> pa.Array:
    """The wanted texts, compressed: they travel once more."""
    return pa.array([pa.compress(x.as_py().encode(), "zstd", asbytes=True) if w else None for x, w in zip(column, wanted, strict=True)], pa.binary())


def _unpacked(batch: pa.RecordBatch, sizes: str, name: str) -> pa.Array:
    raw, n = batch.column(batch.schema.get_field_index(name)), batch.column(batch.schema.get_field_index(sizes))
    return pa.array([pa.decompress(x.as_py(), k.as_py(), "zstd", asbytes=True).decode() for x, k in zip(raw, n, strict=True)], pa.string())


def _flat(part: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each; null: none."""
    column = part.column(part.schema.get_field_index(name))
    counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    return np.asarray(column.flatten()), np.repeat(np.arange(len(counts)), counts)


def _replaced(part: pa.RecordBatch, schema: pa.Schema, new: dict[str, pa.Array]) -> pa.RecordBatch:
    old = {n: part.column(i) for i, n in enumerate(part.schema.names)}
    return pa.RecordBatch.from_arrays([(new.get(f) if f in new else old[f]) for f in schema.names], names=schema.names)


FACTOR = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("block", pa.int64()), ("position", pa.int32())]))
FACTORS = T.ArrayType(T.StructType().add("start", "integer").add("length", "integer").add("block", "long").add("position", "integer"))


def _factor_lists(words: Words, window: int, first: tuple, more: tuple | None = None) -> pa.Array:
    """Factors as one list for each document, positions within the document; those that continue each other are one."""
    start, length, doc, block, position = first if more is None else (np.concatenate(x) for x in zip(first, more, strict=True))
    order = np.lexsort((start, doc))
    start, end, doc, block, position = (x[order] for x in (start, start + length, doc, block, position))
    begin = np.ones(len(start), bool)
    begin[1:] = (doc[1:] != doc[:-1]) | (block[1:] != block[:-1]) | (np.diff(position - start) != 0) | (start[1:] > end[:-1] - window + 1)
    head = np.flatnonzero(begin)
    end = np.maximum.reduceat(end, head) if len(head) else end
    start, doc, block, position = (x[head] for x in (start, doc, block, position))
    length = end - start
    values = pa.StructArray.from_arrays([pa.array(x.astype(t)) for x, t in zip((start - words.bound[doc], length, block, position), (np.int32, np.int32, np.int64, np.int32), strict=True)], fields=list(FACTOR.value_type))
    counts = np.bincount(doc, minlength=len(words.count))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _found(part: pa.RecordBatch, name: str, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of a list of (at, block): word, block, and position in the block; -1 there: a first cell at a boundary."""
    column = part.column(part.schema.get_field_index(name))
    counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    row, flat = np.repeat(np.arange(len(counts)), counts), column.flatten()
    at, block = (np.asarray(flat.field(i)) for i in (0, 1))
    place = words.bound[row] + (at >> 32)
    fine = place < words.bound[row + 1]
    return place[fine], block[fine], (at[fine] & 0xFFFFFFFF) - 1


def _parse(window: int, text: str, names: list[str]):
    """Documents with the entries of their cells: their factors, and the windows of boundary cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                words = Words(*text_bytes(part.column(part.schema.get_field_index(text))))
                n = len(words.start)
                cells = Cells(words, window)
                place, block, position = _found(part, "__rlz_found", words)
                entry = np.full(n, -1)
                entry[place] = np.arange(len(place))
                entry = entry[cells.anchor]
                known = entry >= 0
                gone = np.flatnonzero(known)[position[entry[known]] >= 0]
                open_ = np.flatnonzero(known)[position[entry[known]] < 0]
                first, size = cells.first[gone], cells.size[gone]
                cover = _covered(first, size, window, n)
                doc = np.searchsorted(words.bound, first, side="right") - 1
                own = _factors(first, size, doc, block[entry[gone]], position[entry[gone]] - (cells.anchor[gone] - first), window)
                size = cells.size[open_]
                at = np.repeat(cells.first[open_] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                doc = np.searchsorted(words.bound, at, side="right") - 1
                waiting = np.bincount(doc, minlength=len(words.count))
                other = mix(gram_hashes(mix(words.hashes() ^ np.uint64(0xA24BAED4963EE407)), (window,))[window]) if len(at) else cells.grams
                column = part.column(part.schema.get_field_index(text))
                kept = joined_words(words, np.flatnonzero(~cover))
                new = {
                    text: pa.compute.if_else(pa.array(waiting == 0), kept, pa.scalar(None, pa.string())),
                    "__rlz_raw": _packed(column, waiting > 0),
                    "__rlz_bytes": pa.array(np.diff(words.offsets)),
                    "__rlz_n": pa.array(words.count.astype(np.int64)),
                    "__rlz_removed": pa.array(np.bincount(words.document()[cover], minlength=len(words.count)).astype(np.int64)),
                    "__rlz_factors": _factor_lists(words, window, own),
                    "__rlz_at": list_array(at - words.bound[doc], waiting, pa.int32()),
                    "__rlz_w1": list_array(as_signed(cells.grams[at]), waiting, pa.int64()),
                    "__rlz_w2": list_array(as_signed(other[at]), waiting, pa.int64()),
                }
                yield _replaced(part, pa.schema([(x, pa.null()) for x in names]), new)

    return run


def _settle(window: int, text: str, names: list[str]):
    """Documents with boundary cells: their windows that start earlier become factors too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                words = Words(*text_bytes(_unpacked(part, "__rlz_bytes", "__rlz_raw")))
                n = len(words.start)
                column = part.column(part.schema.get_field_index("__rlz_factors"))
                counts = np.asarray(pa.compute.list_value_length(column))
                row, flat = np.repeat(np.arange(len(counts)), counts), column.flatten()
                start, length, block, position = (np.asarray(flat.field(i)).astype(np.int64) for i in range(4))
                start = words.bound[row] + start
                late, late_block, late_position = _found(part, "__rlz_late", words)
                late, order = np.unique(late, return_index=True)  # rows that are equal have found it once each
                late_block, late_position = late_block[order], late_position[order]
                one = np.ones(len(late), np.int64)
                more = _factors(late, one, np.searchsorted(words.bound, late, side="right") - 1, late_block, late_position, window)
                cover = _covered(np.concatenate([start, late]), np.concatenate([length - window + 1, one]), window, n)
                new = {
                    text: joined_words(words, np.flatnonzero(~cover)),
                    "__rlz_removed": pa.array(np.bincount(words.document()[cover], minlength=len(words.count)).astype(np.int64)),
                    "__rlz_factors": _factor_lists(words, window, (start, length, row, block, position), more),
                }
                yield _replaced(part, pa.schema([(x, pa.null()) for x in names]), new)

    return run


def _spans(factors):
    """The runs of words under factors (in the order of start), as (start, length)."""
    span = lambda start, length: F.struct(start.alias("start"), length.alias("length"))

    def add(spans, f):
        last = F.element_at(spans, -1)
        end = last["start"] + last["length"]
        longer = F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(span(last["start"], F.greatest(end, f["start"] + f["length"]) - last["start"])))
        return F.when((F.size(spans) > 0) & (f["start"] <= end), longer).otherwise(F.concat(spans, F.array(span(f["start"], f["length"]))))

    return F.aggregate(factors, F.array().cast("array<struct<start:int,length:int>>"), add)


def _lists(rows: DataFrame, name: str) -> DataFrame:
    """Found rows as one list for each document."""
    return rows.groupBy(F.col("k").alias("__rlz_k"), F.col("t").alias("__rlz_t")).agg(F.collect_list(F.struct("at", "block")).alias(name))


def _resolved(rows: DataFrame, boundaries: bool) -> DataFrame:
    return rows.repartition("h").sortWithinPartitions("h", "e", "k", "place").mapInArrow(_repeats(boundaries), FOUND)


def _parsed(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumns({"__rlz_k": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.lit(1), text)), "__rlz_t": F.hash(text)})
    found = _resolved(keyed.select("__rlz_k", "__rlz_t", text).mapInArrow(_index_rows(window, text_col), ROW), True)
    joined = keyed.join(_lists(found, "__rlz_found"), ["__rlz_k", "__rlz_t"], "left")
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    schema = T.StructType([f for f in joined.schema.fields if f.name != "__rlz_found"])
    for name, kind in (("raw", "binary"), ("bytes", "long"), ("n", "long"), ("removed", "long"), ("factors", FACTORS), ("at", ints), ("w1", longs), ("w2", longs)):
        schema = schema.add(f"__rlz_{name}", kind)
    return written(joined.mapInArrow(_parse(window, text_col, schema.names), schema), "rlz")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """docs with the words of repeated windows removed from text_col (the rest joined by one space), and n_words,
    n_removed, factors, the parse as array of (start, length, block, position) in words, and dup_spans, the removed runs as
    array of (start, length).  A result column replaces one of that name in docs."""
    if window < GRAM + 1:
        raise ValueError(f"window must be over {GRAM} words")
    docs = docs.drop("n_words", "n_removed", "dup_spans", "factors")
    parsed = _parsed(docs, id_col, text_col, window)
    waiting = F.size("__rlz_at") > 0
    late = _lists(_resolved(parsed.filter(waiting).select("__rlz_k", "__rlz_t", "__rlz_at", "__rlz_w1", "__rlz_w2").mapInArrow(_window_rows, ROW), False), "__rlz_late")
    open_ = parsed.filter(waiting).drop("__rlz_at", "__rlz_w1", "__rlz_w2").join(late, ["__rlz_k", "__rlz_t"], "left")
    last = T.StructType([f for f in parsed.schema.fields if f.name not in ("__rlz_raw", "__rlz_bytes", "__rlz_at", "__rlz_w1", "__rlz_w2")])
    settled = open_.mapInArrow(_settle(window, text_col, last.names), last)
    out = parsed.filter(~waiting).select(*last.names).unionByName(settled)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__rlz_n").alias("n_words"), F.col("__rlz_removed").alias("n_removed"), F.col("__rlz_factors").alias("factors"), _spans(F.col("__rlz_factors")).alias("dup_spans"))
