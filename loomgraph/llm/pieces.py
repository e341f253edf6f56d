"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads a text's bytes once; at each
byte the pieces that end there, found along the output links from the longest to
the shortest, relax the best score of that position.  A character that no piece
covers alone may be an unknown one (ten below the worst score), written as byte
pieces.  The scores are those of the given model file, whatever its kind.

No piece holds a space after another character, so the best split of a text is
the best splits of its space-led chunks, one after the other.  Long chunks (text
without spaces) are cut further between two characters that stand side by side in
no piece, where no piece can cross.  Each batch's distinct chunks, confirmed byte
by byte, go through the automaton side by side, as numpy arrays; chunks that are
still very long go alone.  The automaton is built once from the model file (its size
is bounded by MAX_BYTES) and broadcast.

Defined results: a null or empty text has no ids, and no ids decode to an empty
text.  Decoding gives back every text exactly, a literal U+2581 included (it is
written as bytes, and never stands for a space).  Of splits with equal scores the
one whose last piece is longer wins; repeated rows have equal ids; a text of any
length is encoded whole; an empty table gives an empty result.  Other columns pass
through, but for result columns of the same name.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import list_array, mix, powers, slices, text_bytes

MAX_BYTES = 256 << 20
SPACE = 32
LONG = 512


class Automaton:
    """Dense transitions, output links, and the pieces by node; piece bytes by id."""

    def __init__(self, pieces: list[tuple[bytes, int, float]], byte_ids: list[int], n_ids: int):
        children: list[dict[int, int]] = [{}]
        ends = {}
        for piece, number, score in pieces:
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                node = nxt
            ends.setdefault(node, (number, len(piece), score))
        n = len(children)
        if n * 256 * 4 > MAX_BYTES:
            raise ValueError("the vocabulary is too large for a dense automaton")
        self.go = np.zeros((n, 256), np.uint16 if n < 1 << 16 else np.int32)
        self.piece, self.length, self.score = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n)
        for node, (number, size, score) in ends.items():
            self.piece[node], self.length[node], self.score[node] = number, size, score
        fail, self.link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        queue = deque()
        for b, child in children[0].items():
            self.go[0, b] = child
            queue.append(child)
        while queue:
            node = queue.popleft()
            back = fail[node]
            self.link[node] = back if self.piece[back] >= 0 else self.link[back]
            self.go[node] = self.go[back]
            for b, child in children[node].items():
                fail[child] = self.go[back, b]
                self.go[node, b] = child
                queue.append(child)
        self.first = np.where(self.piece >= 0, np.arange(n), self.link).astype(np.int32)
        self.unknown = min(s for _, _, s in pieces) - 10.0
        chars = [p.decode() for p, _, _ in pieces]
        self.pairs = np.unique(np.array([ord(x) << 32 | ord(y) for p in chars for x, y in zip(p, p[1:])], np.uint64))
        self.byte_ids = np.array(byte_ids, np.int32)
        text = {number: piece for piece, number, _ in pieces} | {number: bytes([b]) for b, number in enumerate(byte_ids)}
        parts = [text.get(i, b"") for i in range(n_ids)]
        self.raw = np.frombuffer(b"".join(parts), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def load(model_file: str) -> Automaton:
    """The automaton of a model file with byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, byte_ids = [], [-1] * 256
    for i in range(sp.get_piece_size()):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append((name.replace("▁", " ").encode(), i, sp.get_score(i)))
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces")
    if any(b" " in p.lstrip(b" ") for p, _, _ in pieces):
        raise ValueError("the model has pieces with inner spaces")
    return Automaton(pieces, byte_ids, sp.get_piece_size())


def _char_lengths(raw: np.ndarray) -> np.ndarray:
    """At each last byte of a character, its number of bytes; elsewhere 0."""
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    out = np.zeros(len(raw), np.int32)
    end = np.append(at[1:], len(raw)) - 1
    out[end] = end - at + 1
    return out


def _one(a: Automaton, raw: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: unknown) and first bytes of the best split of one chunk, byte by byte."""
    n = len(raw)
    best, piece, length = [0.0] + [-np.inf] * n, [-1] * (n + 1), [0] * (n + 1)
    node, go, first, link = 0, a.go, a.first, a.link
    for j, b in enumerate(raw.tolist()):
        node = int(go[node, b])
        top, own, size, alone = -np.inf, -1, 0, False
        out = int(first[node])
        while out:
            k = int(a.length[out])
            value = best[j + 1 - k] + float(a.score[out])
            alone |= k == char[j]
            if value > top:
                top, own, size = value, int(a.piece[out]), k
            out = int(link[out])
        if char[j] and not alone and best[j + 1 - char[j]] + a.unknown > top:
            top, own, size = best[j + 1 - char[j]] + a.unknown, -1, int(char[j])
        best[j + 1], piece[j + 1], length[j + 1] = top, own, size
    ids, at, j = [], [], n
    while j:
        j, k = j - length[j], j
        ids.append(piece[k])
        at.append(j)
    return np.array(ids[::-1], np.int32), np.array(at[::-1], np.int64)


def _split(a: Automaton, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best splits of chunks (first bytes and sizes), one after the other, and how many each has."""
    char = _char_lengths(raw)
    chunks, ids, starts = [], [], []
    for i in np.flatnonzero(size > LONG):
        own, begin = _one(a, raw[at[i] : at[i] + size[i]], char[at[i] : at[i] + size[i]])
        chunks.append(np.full(len(own), i))
        ids.append(own)
        starts.append(at[i] + begin)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= LONG]
    if len(order):
        begin, length = at[order], size[order]
        row = np.cumsum(length + 1) - (length + 1)
        total = int((length + 1).sum())
        best, own, step = np.full(total, -np.inf), np.full(total, -1, np.int32), np.zeros(total, np.int32)
        best[row] = 0.0
        state = np.zeros(len(order), np.int64)
        live = len(order)
        for j in range(int(length[0])):
            live = int(np.searchsorted(-length, -j, side="left"))
            byte = begin[:live] + j
            state = a.go[state[:live], raw[byte]].astype(np.int64)
            here, width = row[:live] + j + 1, char[byte]
            alone = np.zeros(live, bool)
            some = np.flatnonzero(a.first[state])
            node = a.first[state[some]]
            while len(some):
                k = a.length[node]
                value = best[here[some] - k] + a.score[node]
                alone[some] |= k == width[some]
                better = value > best[here[some]]
                spot = here[some[better]]
                best[spot], own[spot], step[spot] = value[better], a.piece[node[better]], k[better]
                node = a.link[node]
                some, node = some[node > 0], node[node > 0]
            lone = np.flatnonzero((width > 0) & ~alone)
            value = best[here[lone] - width[lone]] + a.unknown
            lone, value = lone[better := value > best[here[lone]]], value[better]
            best[here[lone]], own[here[lone]], step[here[lone]] = value, -1, width[lone]
        place, who = row + length, np.arange(len(order))
        while len(who):
            chunks.append(order[who])
            ids.append(own[place])
            place = place - step[place]
            starts.append(begin[who] + place - row[who])
            on = place > row[who]
            who, place = who[on], place[on]
    if not chunks:
        return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
    chunk, number, start = np.concatenate(chunks), np.concatenate(ids), np.concatenate(starts)
    order = np.lexsort((start, chunk))
    chunk, number, start = chunk[order], number[order], start[order]
    n_bytes = np.append(start[1:], 0) - start
    last = np.append(chunk[1:] != chunk[:-1], True)
    n_bytes[last] = (at + size)[chunk[last]] - start[last]
    spread = np.where(number < 0, n_bytes, 1)
    out = np.repeat(number, spread)
    inside = np.arange(len(out)) - np.repeat(np.cumsum(spread) - spread, spread)
    low = out < 0
    out[low] = a.byte_ids[raw[(np.repeat(start, spread) + inside)[low]]]
    return out, np.bincount(chunk, weights=spread, minlength=len(at)).astype(np.int64)


def _ragged(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.cumsum(size) - size
    return values[np.arange(int(size.sum())) + np.repeat(at - out, size)]


def _cuts(a: Automaton, raw: np.ndarray) -> np.ndarray:
    """First bytes of the characters of a chunk that no piece joins with the character before."""
    text = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    pair = text[:-1] << np.uint64(32) | text[1:]
    near = np.searchsorted(a.pairs, pair)
    joined = a.pairs[np.minimum(near, len(a.pairs) - 1)] == pair if len(a.pairs) else np.zeros(len(pair), bool)
    return np.flatnonzero((raw & 0xC0) != 0x80)[1:][~joined]


def encode_column(a: Automaton, column: pa.Array) -> pa.Array:
    """Ids of each text."""
    raw, offsets = text_bytes(column)
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    led = np.zeros(len(raw) + n, np.uint8)
    begin = offsets[:-1] + np.arange(n)
    led[begin] = SPACE
    mask = np.ones(len(led), bool)
    mask[begin] = False
    led[mask] = raw
    full = lengths > 0
    space = led == SPACE
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[begin] = True
    empty = begin[~full]
    head[empty] = False
    at = np.flatnonzero(head)
    if not len(at):
        return list_array(np.zeros(0, np.int32), np.zeros(n, np.int64), pa.int32())
    ends = np.sort(np.concatenate([at, empty, [len(led)]]))
    size = ends[np.searchsorted(ends, at, side="right")] - at
    more = [at[i] + _cuts(a, led[at[i] : at[i] + size[i]]) for i in np.flatnonzero(size > LONG)]
    at = np.sort(np.concatenate([at, *more]))
    edge = np.sort(np.concatenate([at, empty, [len(led)]]))
    size = edge[np.searchsorted(edge, at, side="right")] - at
    place = np.arange(len(led)) - np.repeat(edge[:-1] if edge[0] == 0 else np.concatenate([[0], edge[:-1]]), np.diff(edge if edge[0] == 0 else np.concatenate([[0], edge])))
    value = mix(led.astype(np.uint64) + np.uint64(1)) * powers(0x5851F42D4C957F2D, int(place.max()) + 1)[place]
    key = mix(np.add.reduceat(value, edge[:-1])[np.searchsorted(edge, at)] + size.astype(np.uint64))
    _, which, twin = np.unique(key, return_index=True, return_inverse=True)
    other = np.flatnonzero(size != size[which[twin]])
    same = np.flatnonzero(size == size[which[twin]])
    unlike = _ragged(led, at[same], size[same]) != _ragged(led, at[which[twin[same]]], size[same])
    if len(other) or unlike.any():  # equal hashes of different chunks: those stand for themselves
        begin_same = np.cumsum(size[same]) - size[same]
        other = np.union1d(other, same[np.add.reduceat(unlike, begin_same) > 0])
        twin[other] = len(which) + np.arange(len(other))
        which = np.concatenate([which, other])
    ids, count = _split(a, led, at[which], size[which])
    begin_ids = np.cumsum(count) - count
    out = _ragged(ids, begin_ids[twin], count[twin])
    doc = np.searchsorted(begin, at, side="right") - 1
    return list_array(out, np.bincount(doc, weights=count[twin], minlength=n).astype(np.int64), pa.int32())


def decode_column(a: Automaton, column: pa.ListArray) -> pa.Array:
    """The text of each row of ids."""
    counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)).astype(np.int64)
    ids = np.asarray(column.flatten()).astype(np.int64)
    size = a.at[ids + 1] - a.at[ids]
    at = a.at[ids].copy()
    first = (np.cumsum(counts) - counts)[counts > 0]
    led = first[(size[first] > 0) & (a.raw[np.minimum(at[first], len(a.raw) - 1)] == SPACE)]
    at[led] += 1
    size[led] -= 1
    out = _ragged(a.raw, at, size)
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    array = pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)])
    return array.cast(pa.string())


def _applied(shared, work, source: str, target: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for batch in batches:
            for part in slices(batch, source, 1 << 19) if work is encode_column else (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                old = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                new = {target: work(a, old[source])}
                yield pa.RecordBatch.from_arrays([new.get(f, old.get(f)) for f in names], names=names)

    return run


def encode(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col, the array of piece ids of text_col (it replaces a column of that name)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_file))
    docs = docs.drop(ids_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_applied(shared, encode_column, text_col, ids_col, schema.names), schema)


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col, the text of ids_col (it replaces a column of that name)."""
    shared = df.sparkSession.sparkContext.broadcast(load(model_file))
    df = df.drop(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType())])
    return df.mapInArrow(_applied(shared, decode_column, ids_col, text_col, schema.names), schema)


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ids, n_tokens, and whether decoding gives the text back."""
    out = decode(encode(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__piece_text")), model_file, "__piece_text"), model_file)
    return out.select(F.col(f"`{id_col}`"), "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("__piece_text", F.lit(""))).alias("lossless"))
