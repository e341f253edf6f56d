"""English stemming (Porter2) as column expressions over a table of distinct words.

Every step is a projection: the word so far and the places where its regions
begin travel along as columns, a suffix is found by one regular expression
(alternatives that end at the word's end match from the left, so the longest one
wins), and its replacement is looked up in a literal map.  Words of one or two
letters stay; letters other than a to z count as consonants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the algorithm: words with a stem of their own, and words that stay after the first step.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAYING = "inning outing canning herring earring proceed exceed succeed".split()
#: Suffixes of the steps with what replaces them.
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

V, C = "[aeiouy]", "[^aeiouy]"
REGION = f"{C}*{V}+{C}"
#: A short syllable at the end: a vowel between consonants of which the last isn't w, x or Y, or a vowel and a consonant that are all.
SHORT = f"(?:{C}{V}[^aeiouywxY]|^{V}{C})$"


def _ends(words: list[str]) -> str:
    return f"({'|'.join(words)})$"


def _without(w: Column, n: Column | int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _lookup(found: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in found.items() for x in pair]), key)


def with_stems(words: DataFrame, word: str = "term", out: str = "stem") -> DataFrame:
    """words with the stem of a column of lower-case words."""
    w, p1, p2, s = F.col("__w"), F.col("__p1"), F.col("__p2"), F.col("__s")
    begins = F.length(w) - F.length(s)

    def region(text: Column, special: str = "") -> Column:
        return F.length(F.regexp_extract(text, f"^({special}{REGION})", 1))

    def step(df: DataFrame, suffixes: list[str], new: Column) -> DataFrame:
        """One step: __s is the longest of the suffixes that the word ends in."""
        return df.withColumn("__s", F.regexp_extract(w, _ends(suffixes), 1)).withColumn("__w", F.when(s == "", w).otherwise(new))

    stays = (F.length(word) < 3) | ~F.col(word).rlike(V)  # null from here, so that numbers pass by all expressions
    df = words.withColumn("__w", F.when(~stays, F.regexp_replace(F.regexp_replace(F.col(word), "(^|[aeiou])y", "$1Y"), "yy", "yY")))
    first = region(w, "gener|commun|arsen|")
    df = df.withColumn("__p1", F.when(first > 0, first).otherwise(F.length(w)))
    second = region(w.substr(p1 + 1, F.length(w)))
    df = df.withColumn("__p2", F.when(second > 0, p1 + second).otherwise(F.length(w)))

    # 1a: plurals
    vowel_before = _without(w, 2).rlike(V)
    df = step(df, ["sses", "ied", "ies", "us", "ss", "s"], F.when(s == "sses", _without(w, 2)).when(s.isin("ied", "ies"), _without(w, F.when(F.length(w) > 4, 2).otherwise(1))).when((s == "s") & vowel_before, _without(w, 1)).otherwise(w))
    df = df.withColumn("__done", w.isin(STAYING))
    # 1b: past and progressive forms
    cut = _without(w, F.length(s))
    fixed = F.when(cut.rlike("(?:at|bl|iz)$"), F.concat(cut, F.lit("e"))).when(cut.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _without(cut, 1)).when((p1 >= F.length(cut)) & cut.rlike(SHORT), F.concat(cut, F.lit("e"))).otherwise(cut)
    df = step(df, ["eedly", "eed", "edly", "ed", "ingly", "ing"], F.when(F.col("__done"), w).when(s.isin("eed", "eedly"), F.when(begins >= p1, F.concat(cut, F.lit("ee"))).otherwise(w)).when(cut.rlike(V), fixed).otherwise(w))
    # 1c: y after a consonant that isn't the first letter
    df = df.withColumn("__w", F.when(~F.col("__done"), F.regexp_replace(w, f"(?<=.{C})[yY]$", "i")).otherwise(w))
    # 2 to 4: suffixes in the first or second region
    free = ~F.col("__done")
    may = F.when(s == "ogi", cut.endswith("l")).when(s == "li", cut.rlike("[cdeghkmnrt]$")).otherwise(True)
    df = step(df, list(STEP2), F.when(free & (begins >= p1) & may, F.concat(cut, _lookup(STEP2, s))).otherwise(w))
    df = step(df, list(STEP3), F.when(free & (begins >= F.when(s == "ative", p2).otherwise(p1)), F.concat(cut, _lookup(STEP3, s))).otherwise(w))
    df = step(df, STEP4, F.when(free & (begins >= p2) & ((s != "ion") | cut.rlike("[st]$")), cut).otherwise(w))
    # 5: a last e or l
    df = step(df, ["e", "l"], F.when(free & (s == "e") & ((begins >= p2) | ((begins >= p1) & ~cut.rlike(SHORT))), cut).when(free & (s == "l") & (begins >= p2) & cut.endswith("l"), cut).otherwise(w))
    stem = F.when(stays, F.col(word)).otherwise(F.coalesce(_lookup(SPECIAL, F.col(word)), F.replace(w, F.lit("Y"), F.lit("y"))))
    return df.withColumn(out, stem).drop("__w", "__p1", "__p2", "__s", "__done")
