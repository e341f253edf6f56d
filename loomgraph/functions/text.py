"""Text search and fuzzy matching as built-in expressions.

The analyzer lower-cases, splits at everything but letters and digits of any script,
and drops stop words; it is the specification that ranks and matches rest on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the analyzer.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to was were will with".split()

BASIS = 1.64493406685


def words(x: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")


def all_words(x: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms(x: Column) -> Column:
    return F.filter(all_words(F.coalesce(x, F.lit(""))), lambda w: ~w.isin(STOP_WORDS))


def trigrams(x: Column) -> Column:
    """The distinct trigrams of all words, each padded with two blanks in front and one behind."""
    padded = F.transform(all_words(x), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if either is empty.  Each array is made once for a row."""

    def of(s: Column) -> Column:
        shared = F.size(F.array_intersect(s["a"], s["b"]))
        return F.when((F.size(s["a"]) > 0) & (F.size(s["b"]) > 0), shared / (F.size(s["a"]) + F.size(s["b"]) - shared)).otherwise(0.0)

    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of), 1)


def similarity(a: Column, b: Column) -> Column:
    """Trigram similarity."""
    return set_similarity(trigrams(a), trigrams(b))


def tokens(x: Column) -> Column:
    """Distinct words of two characters or more."""
    return F.array_distinct(F.filter(words(x), lambda w: F.length(w) > 1))


def token_jaccard(a: Column, b: Column) -> Column:
    same = F.concat_ws(" ", words(a)) == F.concat_ws(" ", words(b))
    base = set_similarity(tokens(a), tokens(b))
    return F.when(same & (F.size(tokens(a)) > 0), 1.0).otherwise(base)


def broad_terms(query: str, most: int = 12) -> list[str]:
    """The query's words over two characters, in order, at most so many."""
    found = [w for w in re.split(r"[\W_]+", query.lower()) if len(w) > 2]
    return list(dict.fromkeys(found))[:most]


@dataclass(frozen=True)
class Clause:
    """Alternatives (each a phrase as tuple of terms), one of which must, or must not, occur."""

    phrases: tuple[tuple[str, ...], ...]
    negated: bool = False


def websearch(query: str) -> list[Clause]:
    """A query with quoted phrases, `or` between words, and -negation as clauses that all must hold."""
    parts = re.findall(r'-?"[^"]*"|\S+', query.lower())
    clauses: list[Clause] = []
    either = False
    for part in parts:
        if part == "or":
            either = bool(clauses)
            continue
        negated = part.startswith("-") and len(part) > 1
        phrase = tuple(w for w in re.split(r"[\W_]+", part.strip('-"')) if w and w not in STOP_WORDS)
        if not phrase:
            continue
        if either and not negated and not clauses[-1].negated:
            clauses[-1] = Clause((*clauses[-1].phrases, phrase))
        else:
            clauses.append(Clause((phrase,), negated))
        either = False
    return clauses


def matches(analyzed: Column, clauses: list[Clause]) -> Column:
    """Whether analyzed terms satisfy all clauses; no clauses match nothing."""
    line = F.concat(F.lit(" "), F.concat_ws(" ", analyzed), F.lit(" "))
    out = F.lit(bool(clauses))
    for c in clauses:
        hit = F.lit(False)
        for p in c.phrases:
            hit = hit | line.contains(f" {' '.join(p)} ")
        out = out & (~hit if c.negated else hit)
    return out


def rank_any(analyzed: Column, query_terms: list[str]) -> Column:
    """Rank of the alternatives form: for each term 0.1 * sum 1/j^2 over its occurrences, scaled, and averaged over terms."""
    if not query_terms:
        return F.lit(0.0)
    count = lambda t: F.size(F.filter(analyzed, lambda w: w == t))
    total = F.lit(0.0)
    for t in query_terms:
        n = count(t)
        series = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))
        total = total + 0.1 * series / BASIS
    return total / len(query_terms)


#: The most places of a word that count, and how the closeness of two places is weighed.
PLACES, FAR = 256, 100


def places(all_words: Column, term: str) -> Column:
    """Where a word stands among all words of a text, stop words included, from 1."""
    return F.slice(F.array_compact(F.transform(all_words, lambda w, i: F.when(w == term, i + 1))), 1, PLACES)


def _pairs(a: Column, b: Column, of) -> Column:
    """of(x, y) for all x of a and y of b."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: of(x, y))))


def rank_all(all_words: Column, query_terms: list[str]) -> Column:
    """Rank of the form in which all terms must occur: 1 - product of (1 - w) over all pairs of places of different terms, where w
    falls with their distance; one term alone ranks as an alternative."""
    if len(query_terms) < 2:
        return rank_any(all_words, query_terms)

    def near(a: Column, b: Column) -> Column:
        d = F.abs(a - b)
        return 0.1 * F.sqrt(F.when(d > FAR, 1e-30).otherwise(1 / (1.005 + 0.05 * F.exp(d / 1.5 - 2))))

    at = {t: places(all_words, t) for t in query_terms}
    left, every = F.lit(1.0), F.lit(True)
    for n, a in enumerate(query_terms):
        every = every & (F.size(at[a]) > 0)
        for b in query_terms[n + 1 :]:
            left = left * F.aggregate(_pairs(at[a], at[b], near), F.lit(1.0), lambda s, w: s * (1 - w))
    return F.when(every, 1 - left).otherwise(0.0)


def clause_terms(clauses: list[Clause]) -> list[str]:
    return list(dict.fromkeys(t for c in clauses if not c.negated for p in c.phrases for t in p))


#: Addresses, and handles of a letter and 1 to 38 more characters.  A word ends where ASCII letters, digits and
#: underscores do.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
EMAIL = EDGE + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}" + EDGE
MENTION = "@([A-Za-z][A-Za-z0-9_-]{1,38})" + EDGE


def emails(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"({EMAIL})"), 1)


def mentions(x: Column, outside_emails: bool = False) -> Column:
    """Handles after @; by default also those inside e-mail addresses."""
    return F.regexp_extract_all(F.regexp_replace(x, EMAIL, " ") if outside_emails else x, F.lit(MENTION), 1)


def people(x: Column) -> Column:
    """The people that a text names by address (0.7) or handle (0.6), each once, as array of (name, entity_type, confidence,
    value): an address's name is its local part with blanks for dots, dashes and underscores."""
    row = lambda name, sure, v: F.struct(name.alias("name"), F.lit("person").alias("entity_type"), F.lit(sure).alias("confidence"), v.alias("value"))
    first = lambda values: F.filter(values, lambda v, i: F.array_position(F.transform(values, F.lower), F.lower(v)) == i + 1)
    mails = F.transform(first(emails(x)), lambda v: row(F.regexp_replace(F.substring_index(v, "@", 1), "[._-]", " "), 0.7, v))
    return F.concat(mails, F.transform(first(mentions(x)), lambda v: row(v, 0.6, v)))


def extraction_confidence(n_words: Column, n_entities: Column, mean_confidence: Column) -> Column:
    """How far a text's entities can be trusted, from its length and their number."""
    density = n_entities / F.greatest(n_words / 100, F.lit(1))
    return F.when((n_words < 50) & (n_entities >= 1), 0.9).when((n_words > 200) & (n_entities < 2), 0.3).otherwise(F.least(F.lit(0.95), density * 0.3 + mean_confidence * 0.7))


def evidence_quote(content: Column, *needles: Column, width: int = 160) -> Column:
    """The first needle that content holds (any case): its text from there (at least width characters), start and end."""
    low = F.lower(content)
    places = [F.when(n.isNotNull() & (n != ""), F.position(F.lower(n), low)) for n in needles]
    at = F.coalesce(*[F.when(p > 0, p) for p in places])
    length = F.coalesce(*[F.when(p > 0, F.greatest(F.length(n), F.lit(width))) for p, n in zip(places, needles, strict=True)])
    quote = content.substr(at, length)
    return F.when(at.isNotNull(), F.struct(quote.alias("quote"), (at - 1).alias("start"), (at - 1 + F.length(quote)).alias("end")))


def render(template: str, payload: Column) -> Column:
    """{{a.b}} in a template replaced by JSON paths of payload; missing: empty."""
    parts = re.split(r"\{\{\s*([\w.]+)\s*\}\}", template)
    cells = [F.lit(p) if i % 2 == 0 else F.coalesce(F.get_json_object(payload, f"$.{p}"), F.lit("")) for i, p in enumerate(parts) if p or i % 2]
    return F.concat(*cells) if cells else F.lit("")


#: Fields in the order in which content, title and date are looked for.
CONTENT_FIELDS = ("content", "text", "body", "description", "message", "summary", "note")
TITLE_FIELDS = ("title", "name", "subject")
DATE_FIELDS = ("created_at", "date", "timestamp", "updated_at")


def _first_field(payload: Column, fields: tuple[str, ...]) -> Column:
    some = lambda f: F.nullif(F.trim(F.get_json_object(payload, f"$.{f}")), F.lit(""))
    return F.coalesce(*[some(f) for f in fields])


def detect_content(payload: Column) -> Column:
    """The first content field, led by a title; else the whole payload."""
    return F.concat_ws("\n", _first_field(payload, TITLE_FIELDS), F.coalesce(_first_field(payload, CONTENT_FIELDS), payload))


def detect_date(payload: Column) -> Column:
    """The first date field: ISO text, or seconds or milliseconds since 1970."""
    raw = _first_field(payload, DATE_FIELDS)
    number = F.try_to_number(raw, F.lit("9999999999999")).cast("double")
    epoch = F.timestamp_millis(F.when(number < 1e10, number * 1000).otherwise(number).cast("long")).cast("timestamp_ntz")
    return F.when(raw.rlike("^[0-9]+$"), epoch).otherwise(F.try_to_timestamp(raw).cast("timestamp_ntz"))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def humanized(x: Column) -> Column:
    return F.initcap(F.regexp_replace(x, "[_-]+", " "))
