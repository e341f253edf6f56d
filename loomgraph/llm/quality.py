"""Quality rules: a threshold table compiled into one Spark projection.

Every count and ratio is a built-in expression on the text, so the whole table
is one projection without user functions, shuffles or joins.  Defined results:
a null, empty or blank text has no words, fails the base rule and isn't kept;
repeated rows are judged alike; a measure at a limit passes; a text of any length
is measured whole; other columns pass through (a result column replaces one of
that name); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WHITE, words_of

#: The commonest function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by this are or from at an a he "
    "de la le et les des en un du une que est pour qui dans par sur au pas avec "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als "
    "el y los del se las por para con no su al lo"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """low <= measure <= high; None: open on that side."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The default table; measures are those of ratios().
RULES = (
    Rule("mean word length", "mean_word_chars", 2.5, 12.0),
    Rule("symbols per word", "symbol_ratio", None, 0.1),
    Rule("stop words", "stop_ratio", 0.06, None),
    Rule("repeated lines", "dup_line_ratio", None, 0.4),
)


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, window: int = 8) -> Column:
    """Words inside windows of so many words that are found twice or more, the first included."""

    def covered(keys: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            equal = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.coalesce(a["k"] == b["k"], F.lit(False)))

            def of_equal(e: Column) -> Column:
                twin = F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda a, b: F.coalesce(a, F.lit(False)) | b)
                at = F.filter(F.zip_with(s, twin, lambda a, t: F.when(t, a["i"])), lambda x: x.isNotNull())
                gaps = lambda p: F.zip_with(p, F.slice(p, F.lit(2), F.size(p)), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
                return F.aggregate(_let(F.sort_array(at), gaps), F.lit(0), lambda total, x: total + x)

            return _let(equal, of_equal)

        pairs = F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(_let(F.sort_array(pairs), of_sorted))

    keys = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(window))))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(_let(keys, covered)).cast("long")


def measures(text: Column) -> Column:
    """A struct of counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    plain = lambda w: F.lower(F.regexp_replace(w, "[.,;:!?]+$", ""))

    def of_words(words: Column) -> Column:
        of_lines = lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
        line = _let(lines, of_lines)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            line.alias("line"),
            repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.length(w).between(1, 8) & plain(w).isin(STOP_WORDS))).cast("long").alias("n_stop"),
        )

    return _let(words_of(text), of_words)


def ratios(m: Column) -> dict[str, Column]:
    """Measures of the threshold table, from measures(); null where there are no words or lines."""
    n, lines = m["n_words"], m["line"]["all"]
    over = lambda a, b: F.when(b > 0, a / b)
    return {
        "n_words": n.cast("double"),
        "mean_word_chars": over(m["word_chars"], n),
        "symbol_ratio": over(m["n_symbols"], n),
        "stop_ratio": over(m["n_stop"], n),
        "dup_line_ratio": over(m["line"]["dup"], lines),
        "repeat_ratio": over(m["n_repeat_words"], n),
    }


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True if every rule of the table holds."""
    value, out = ratios(m), F.lit(True)
    for rule in rules:
        x = value[rule.measure]
        out = out & F.coalesce(x >= rule.low if rule.low is not None else F.lit(True), F.lit(False)) & F.coalesce(x <= rule.high if rule.high is not None else F.lit(True), F.lit(False))
    return out


def quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    m = F.col("__quality_m")
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    new = {
        "n_words": m["n_words"],
        "word_chars": m["word_chars"],
        "n_symbols": m["n_symbols"],
        "n_dup_lines": m["line"]["dup"].cast("long"),
        "n_repeat_words": m["n_repeat_words"],
        "base_failed": failed,
        "kept": ~failed & verdict(m, rules),
    }
    return docs.withColumn("__quality_m", measures(F.col(f"`{text_col}`"))).select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[c.alias(n) for n, c in new.items()])
