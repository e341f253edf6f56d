"""Language identification by hierarchical discrimination.

One-versus-rest linear support vector machines choose the language family; the
one-versus-one machines of that family then separate its languages.  Features
are hashed byte bigrams and trigrams of the lower-cased whole text.  The
machines learn on the driver from a sample with a documented bound
(max_rows texts, drawn by a hash of the id at one rate for each language);
prediction runs over all documents in Arrow batches, without a shuffle.

Defined results: a null text or one without a letter is `und` with score 0, as
is every text when there was nothing to learn from; with one learned language
every text with a letter has it, with score 1; rows without an id are never
learned from and aren't held out; repeated rows are predicted alike (and may all
be learned from); of languages with equal votes the first by code wins, as does
the first family of equal margins; a text of any length is read whole; an empty
table gives an empty result, and nothing to learn from; other columns pass
through, but for result columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices, text_bytes

#: Families of common languages by code; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi", "fy"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"],
    "turkic": ["tr", "az", "kk", "uz", "ky", "tk"],
    "uralic": ["fi", "et", "hu"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa"],
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}

DIMS = 2048
LEAST_ROWS = 10
LETTER = r"\p{L}"


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: the square roots of its n-grams' shares, in DIMS hashed places."""
    lower = pc.utf8_lower(pc.fill_null(column, ""))
    raw, offsets = text_bytes(lower)
    n = len(offsets) - 1
    keep = np.zeros(256, np.uint8)
    keep[128:] = np.arange(128, 256)
    keep[97:123] = np.arange(97, 123)
    code = keep[raw].astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.zeros(n * DIMS)
    for size, factor in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        if len(code) < size:
            continue
        value = code[: len(code) - size + 1].copy()
        for i in range(1, size):
            value = value * np.uint32(257) + code[i : len(code) - size + 1 + i]
        whole = doc[: len(value)] == doc[size - 1 :]
        whole &= value != 0
        place = (value * np.uint32(factor)) >> np.uint32(21)
        counts += np.bincount(doc[: len(value)][whole] * DIMS + place[whole], minlength=n * DIMS)
    counts = counts.reshape(n, DIMS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 30.0, rounds: int = 150) -> np.ndarray:
    """A linear support vector machine (squared hinge, bias last) for y in -1 and 1, by accelerated gradient steps."""
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    v, t = w.copy(), 1.0
    step = np.float32(1.0 / (1 + 2 * cost * float(share @ (np.einsum("ij,ij->i", x, x) + 1))))
    for _ in range(rounds):
        pull = share * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        nxt = v - step * (v - np.float32(2 * cost) * np.append(pull @ x, pull.sum()).astype(np.float32))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w, v, t = nxt, nxt + np.float32((t - 1) / t2) * (nxt - w), t2
    return w


class Model:
    """Learned languages, their families, and the machines."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.langs = sorted(set(lang))
        family = np.array([FAMILY.get(v, v) for v in lang], dtype=object)
        self.families = sorted(set(family))
        self.members = {f: [v for v in self.langs if FAMILY.get(v, v) == f] for f in self.families}
        self.family_w = np.stack([_machine(x, np.where(family == f, 1, -1).astype(np.float32)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for names in self.members.values():
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    own = (lang == a) | (lang == b)
                    self.pairs[a, b] = _machine(x[own], np.where(lang[own] == a, 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row."""
        n = len(x)
        sure = lambda margin: 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
        family, score = np.zeros(n, int), np.ones(n)
        if self.family_w is not None:
            margin = x @ self.family_w[:, :-1].T + self.family_w[:, -1]
            family = margin.argmax(axis=1)
            score = sure(margin[np.arange(n), family])
        out = np.empty(n, object)
        for i, f in enumerate(self.families):
            rows, names = np.flatnonzero(family == i), self.members[f]
            votes = np.zeros((len(rows), len(names)))
            least = np.ones((len(rows), len(names)))
            for (a, b), w in self.pairs.items():
                if a in names:
                    j, k = names.index(a), names.index(b)
                    p = sure(x[rows] @ w[:-1] + w[-1])
                    votes[:, j] += (p >= 0.5) + 0.01 * p
                    votes[:, k] += (p < 0.5) + 0.01 * (1 - p)
                    least[:, j], least[:, k] = np.minimum(least[:, j], p), np.minimum(least[:, k], 1 - p)
            best = votes.argmax(axis=1)
            out[rows] = np.array(names, object)[best]
            score[rows] *= least[np.arange(len(rows)), best]
        return out, score


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", rows=1000):
            x = features(part.column(1)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])


def bucket(id_col: str):
    """crc32(id as text) mod 3, the fold of a document; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3


def learn(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 4000) -> Model | None:
    """A model from at most max_rows of the labelled rows; None if there are none.  Languages share the bound equally; each
    needs LEAST_ROWS of it, so that more than max_rows / LEAST_ROWS languages are an error, not cut."""
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter("lang is not null and id is not null").filter(F.coalesce(F.col("text").rlike(LETTER), F.lit(False)))
    per_lang = rows.groupBy("lang").count()
    if (n_langs := per_lang.count()) > max_rows // LEAST_ROWS:
        raise ValueError(f"{n_langs} languages need max_rows of {n_langs * LEAST_ROWS} at least")
    counts = dict(per_lang.collect())
    if not counts:
        return None
    each = max_rows // len(counts)
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.coalesce(*[F.when(F.col("lang") == v, F.lit(0.95 * each / n)) for v, n in counts.items()])
    some = rows.filter(draw < rate).select("lang", "text", draw.alias("draw")).orderBy("draw").limit(max_rows).select("lang", "text")
    sample = some.mapInArrow(_vectors, "lang string, x binary").toArrow()
    if not sample.num_rows:
        return None
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
    return Model(x, np.array(sample.column("lang").to_pylist(), object))


def _label(model: Model | None, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, rows=500):
                column = part.column(part.schema.get_field_index(text))
                letter = np.asarray(pc.fill_null(pc.match_substring_regex(column, LETTER), False))
                lang, score = (np.full(part.num_rows, "und", object), np.zeros(part.num_rows)) if model is None else model.predict(features(column))
                lang, score = np.where(letter, lang, "und"), np.where(letter, np.clip(score, 0, 1), 0.0)
                old = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                new = {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score.astype(np.float64))}
                yield pa.RecordBatch.from_arrays([new.get(f, old.get(f)) for f in names], names=names)

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; a result column replaces one of that name."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_label(model, text_col, schema.names), schema)
