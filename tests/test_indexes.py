"""Stemming and stored indexes against plain versions."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.bridge import policy_of
from loomgraph.functions import text as X
from loomgraph.functions.stem import with_stems
from loomgraph.functions.vector import nearest_to_each
from loomgraph.indexes import postings as P
from loomgraph.indexes import trigrams as T
from loomgraph.indexes import vectors as V
from loomgraph.operators import ingest as I
from loomgraph.plans import retrieval as R
from loomgraph.storage import leaves_one_table, new_folder, run_of_tables, shared_dir, written

# ---------------------------------------------------------------- stems

#: Words and their published stems.
STEMS = """consign consign consigned consign consistency consist consolatory consolatori conspiracy conspiraci constancy constanc
knackeries knackeri kneeling kneel knees knee knightly knight knives knive knitting knit priorities prioriti priority prioriti
generously generous generate generat communication communic arsenal arsenal saying say by by cry cri happy happi hopping hop hoping hope
agreed agre falling fall hissing hiss dying die skies sky news news luxuriated luxuri analogously analog electrical electr goodness good
adoption adopt controlling control ties tie gas gas this this caress caress cries cri youth youth boyish boyish shred shred""".split()


class Plain:
    """Porter2 letter by letter, without regular expressions."""

    def __init__(self, word):
        self.w = word

    vowel = staticmethod(lambda c: c in "aeiouy")

    def region(self, start):
        seen = False
        for i in range(start, len(self.w)):
            if self.vowel(self.w[i]):
                seen = True
            elif seen:
                return i + 1
        return len(self.w)

    def short_end(self, w):
        if len(w) == 2:
            return self.vowel(w[0]) and not self.vowel(w[1])
        return len(w) > 2 and not self.vowel(w[-3]) and self.vowel(w[-2]) and not self.vowel(w[-1]) and w[-1] not in "wxY"

    def replace(self, table, start):
        for suffix in sorted(table, key=len, reverse=True):
            if self.w.endswith(suffix):
                at = len(self.w) - len(suffix)
                new, least, before = table[suffix]
                if at >= start[least] and (before is None or (at and self.w[at - 1] in before)):
                    self.w = self.w[:at] + new
                return

    def stem(self):
        w = self.w
        if len(w) < 3:
            return w
        special = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
        if w in special:
            return special[w]
        if w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"):
            return w
        out = ""
        for c in w:
            out += "Y" if c == "y" and (not out or self.vowel(out[-1])) else c
        self.w = out
        r1 = next((len(p) for p in ("gener", "commun", "arsen") if out.startswith(p)), None)
        r1 = self.region(0) if r1 is None else r1
        r2 = self.region(r1)
        w = self.w
        if w.endswith("sses"):
            w = w[:-2]
        elif w.endswith(("ied", "ies")):
            w = w[:-2] if len(w) > 4 else w[:-1]
        elif w.endswith("s") and not w.endswith(("us", "ss")) and any(map(self.vowel, w[:-2])):
            w = w[:-1]
        if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
            return w
        for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
            if w.endswith(s):
                cut = w[: -len(s)]
                if s in ("eed", "eedly"):
                    w = cut + "ee" if len(cut) >= r1 else w
                elif any(map(self.vowel, cut)):
                    w = cut
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                        w = w[:-1]
                    elif r1 >= len(w) and self.short_end(w):
                        w += "e"
                break
        if len(w) > 2 and w[-1] in "yY" and not self.vowel(w[-2]):
            w = w[:-1] + "i"
        self.w, start = w, {1: r1, 2: r2}
        two = "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less"
        table = {a: (b, 1, None) for a, b in (p.split(":") for p in two.split())}
        self.replace(table | {"ogi": ("og", 1, "l"), "li": ("", 1, "cdeghkmnrt")}, start)
        three = {a: (b, 1, None) for a, b in (p.split(":") for p in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness:".split())}
        self.replace(three | {"ative": ("", 2, None)}, start)
        four = {a: ("", 2, None) for a in "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()}
        self.replace(four | {"ion": ("", 2, "st")}, start)
        w = self.w
        if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not self.short_end(w[:-1]))):
            w = w[:-1]
        elif w.endswith("ll") and len(w) - 1 >= r2:
            w = w[:-1]
        return w.replace("Y", "y")


def stems_of(spark, words):
    return {r.term: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in words], "term string")).collect()}


def test_published_stems(spark):
    want = dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    assert stems_of(spark, want) == want


def test_stems_of_all_document_words_and_made_up_ones(spark, small):
    words = {w for (t,) in duckdb.sql(f"select text from '{small}/documents.parquet'").fetchall() for w in re.split(r"[\W_]+", (t or "").lower()) if w}
    rng = random.Random(1)
    ends = "s sses ied ies us ss ed edly ing ingly eed eedly y li ogi ization ational fulness ative ement ion sion tion e l le ll able yed ying".split()
    words |= {"".join(rng.choice("abeioylstzrwx") for _ in range(rng.randint(0, 7))) + rng.choice(ends) for _ in range(20_000)}
    words |= {"", "a", "yyy", "ayyyb", "byy", "naïve", "über", "1st", "y" * 9}
    got = stems_of(spark, sorted(words))
    assert {w: s for w, s in got.items() if s != Plain(w).stem()} == {}


# ---------------------------------------------------------------- postings


def plain_terms(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w and w not in X.STOP_WORDS]


def weight(n):
    return 0.1 * sum(1 / j**2 for j in range(1, n + 1)) / X.BASIS


def plain_search(texts, query, broad=True, stem=lambda w: w):
    clauses, words = X.websearch(query), X.broad_terms(query) if broad else []
    clauses = [(c.negated, [[stem(w) for w in p] for p in c.phrases]) for c in clauses]
    words, out = list(dict.fromkeys(map(stem, words))), {}
    strict = list(dict.fromkeys(w for no, ps in clauses if not no for p in ps for w in p))
    for key, text in texts.items():
        a = [stem(w) for w in plain_terms(text)]
        has = lambda p, a=a: any(a[i : i + len(p)] == p for i in range(len(a)))
        holds = bool(clauses) and all(any(map(has, ps)) != no for no, ps in clauses)
        score = max(sum(weight(a.count(w)) for w in strict) / len(strict) if holds and strict else 0, 0.65 * sum(weight(a.count(w)) for w in words) / len(words) if words else 0)
        if score > 0:
            out[key] = score
    return out


QUERIES = ["red", "red blue", '"red green" -blue', '"green green" or blue', "-red", "red -red", "the", "", "Naïve or élan", "blues naïve", '"blue red green"']


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = ["red", "green", "blue", "the", "naïve", "élan", "blues", "x1"]
    texts = {str(i): " ".join(rng.choices(words, [5, 4, 3, 6, 1, 1, 1, 1], k=rng.randint(0, 30))) for i in range(300)} | {"none": None, "empty": "", "stops": "the a of", "long": "red green, " * 30_000 + "blue"}
    rows = spark.createDataFrame(list(texts.items()), "id string, text string").withColumns({"term": F.lit("clash"), "block": F.lit(1)})
    return texts, rows


@pytest.mark.parametrize("analyzer", P.ANALYZERS)
def test_postings_against_plain(spark, corpus, analyzer):
    texts, rows = corpus
    index = P.build(rows, "id", F.col("text"), new_folder(spark, "postings"), analyzer, shelves=5, block=16)
    stem = (lambda w: Plain(w).stem()) if analyzer == "english" else lambda w: w
    for q in QUERIES:
        want = plain_search(texts, q, stem=stem)
        got = {r.id: r["rank"] for r in index.search(q).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want), q
        if q in QUERIES[:4]:
            top = [(r.id, pytest.approx(r["rank"])) for r in index.search(q, limit=10, first=2).collect()]
            assert top == sorted(want.items(), key=lambda x: (-round(x[1], 12), x[0]))[:10], q
    some = rows.filter("id in ('1', '2', 'long')")
    assert {r.id for r in index.search("red", allowed=some).collect()} == {k for k in plain_search(texts, "red", stem=stem) if k in ("1", "2", "long")}


def test_postings_are_keyword_rank(spark, corpus):
    _, rows = corpus
    index = P.build(rows, "id", F.col("text"), new_folder(spark, "postings"), block=16)
    for q in ('"red green" -blue', "blue or élan"):
        want = {r.id: pytest.approx(r["rank"]) for r in R.keyword_rank(rows, F.col("text"), q).collect()}
        assert {r.id: r["rank"] for r in index.search(q).collect()} == want


def test_keyword_search_over_an_index(spark, corpus):
    _, rows = corpus
    none, rows = F.lit(None), rows.withColumn("visibility", policy_of(F.lit(3)))
    facts = rows.select("id", F.col("text").alias("fact_text"), F.lit(0.5).alias("confidence"), none.cast("timestamp_ntz").alias("valid_at"), none.cast("timestamp_ntz").alias("invalid_at"), "visibility")
    entities = rows.limit(5).select("id", F.col("text").alias("name"), F.lit("red").alias("summary"), "visibility")
    episodes = rows.filter("id = 'long'").select("id", F.col("text").alias("content"), none.cast("timestamp_ntz").alias("valid_at"), "visibility")
    plain, asked = R.Corpus(entities, facts, episodes), R.Request("red -blue", limit=4)
    indexed = R.Corpus(entities, facts, episodes, indexes={"facts": P.build(facts, "id", F.col("fact_text"), new_folder(spark, "postings"), block=16)})
    want = [tuple(r) for r in R.keyword_search(plain, asked).collect()]
    assert [tuple(r) for r in R.keyword_search(indexed, asked).collect()] == want and len(want) > 4


def test_a_search_opens_the_shelves_of_its_terms_and_the_blocks_that_may_win(spark, corpus):
    texts, rows = corpus
    index = P.build(rows, "id", F.col("text"), new_folder(spark, "postings"), shelves=6, block=8)
    plan = index.postings(["x1"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "shelf" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(index.shelves_of(["x1"])) < 3 and spark.read.parquet(f"{index.folder}/postings").select("shelf").distinct().count() == 6
    read, all_ = index.blocks_read("red", 3, first=1)
    assert read < all_ / 2


def test_an_index_of_no_rows(spark, corpus):
    _, rows = corpus
    index = P.build(rows.limit(0), "id", F.col("text"), new_folder(spark, "postings"))
    assert index.search("red").collect() == [] and index.search("red", limit=3).collect() == []
    with pytest.raises(ValueError):
        P.build(rows, "id", F.col("text"), "x", "klingon")


def test_blocks_are_cut_by_words_and_shelves_grow_with_the_rows(spark, corpus, monkeypatch):
    texts, rows = corpus
    monkeypatch.setattr(P, "SHELF", 100)
    monkeypatch.setattr(P, "WORDS", 50)
    index = P.build(rows, "id", F.col("text"), new_folder(spark, "postings"))
    stored = spark.read.schema(P.ROWS).parquet(f"{index.folder}/postings")
    assert stored.select("shelf").distinct().count() > 10 and stored.agg(F.max("n")).first()[0] < 50
    assert stored.groupBy("term", "block").count().filter("count > 1").count() == 0
    want = plain_search(texts, '"red green" -blue')
    assert {r.id: pytest.approx(r["rank"]) for r in index.search('"red green" -blue').collect()} == want


def test_shelves_hold_as_many_documents_each(spark):
    """A word of every document fills as much of a shelf as a thousand rare words, not as much as one."""
    rows = spark.range(4000).select("id", F.concat(F.lit("has every w"), "id").alias("text"))
    index = P.build(rows, "id", F.col("text"), new_folder(spark, "postings"), shelves=6, block=64)
    held = [r.n for r in spark.read.schema(P.ROWS).parquet(f"{index.folder}/postings").groupBy("shelf").agg(F.sum("n").alias("n")).collect()]
    assert sum(held) == 12000 and max(held) < 4000


def test_an_english_index_names_a_document_once_and_counts_all_forms_of_a_stem(spark):
    """Forms keep rows of their own, so no posting has an id, and nothing but finished rows is shuffled."""
    rng = random.Random(5)
    texts = {str(i): " ".join([f"w{i}", *rng.choices(["supply", "supplies", "supplying", "supplied"], k=rng.randint(0, 6))]) for i in range(60)} | {"none": None}
    rows = spark.createDataFrame(list(texts.items()), "id string, text string")
    index = P.build(rows, "id", F.col("text"), new_folder(spark, "postings"), "english", block=8)
    held = spark.read.schema(P.IDS).parquet(f"{index.folder}/ids").select(F.explode("ids").alias("id"))
    assert sorted(r.id for r in held.collect()) == sorted(texts.keys() - {"none"})
    assert [f.name for f in spark.read.parquet(f"{index.folder}/postings").schema if "string" in f.dataType.simpleString()] == ["term"]
    want = sorted(plain_search(texts, "supplies", stem=lambda w: Plain(w).stem()).items(), key=lambda x: (-round(x[1], 12), x[0]))[:5]
    assert [(r.id, pytest.approx(r["rank"])) for r in index.search("supplies", limit=5, first=1).collect()] == want


# ---------------------------------------------------------------- trigrams


def grams(name):
    return {f"  {w} "[i : i + 3] for w in re.split(r"[\W_]+", name.lower()) if w for i in range(len(w) + 1)}


def alike(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("above", [0.2, 0.3, 0.62])
def test_trigram_index_against_all_pairs(spark, above):
    rng = random.Random(8)
    base = ["Customer#000000%03d" % i for i in range(60)] + ["Acme Corp", "acme-corp", "ACME Corporation", "Zürich Bank", "zurich bank", "", "!!", "a", "x" * 900]
    names = [(i, rng.choice(["k", "l", None]), n) for i, n in enumerate(base + base[:9])] + [(500, "k", None)]
    asked = [("k", "customer#000000005 inc"), ("k", "Acme"), ("l", "zürich"), (None, "Customer#000000059"), ("k", "nothing like it"), ("k", ""), ("k", None), ("k", "x" * 899), ("z", "Acme Corp")]
    rows = spark.createDataFrame(names, "key long, kind string, name string").withColumns({"first": F.lit(1), "grams": F.lit("clash")})
    index = T.build(rows, "key", "name", new_folder(spark, "trigrams"), "kind")
    q = spark.createDataFrame(asked, "kind string, q string")
    want = {(k or "", n, i): alike(n, m) for k, n in asked if n for i, l, m in names if m is not None and k == l and alike(n, m) > above}
    got = {(r.kind, r.name, r.id): r.score for r in index.alike(q, "q", above, "kind").collect()}
    assert got == pytest.approx(want)
    best = {}
    for (k, n, i), s in want.items():
        best[k, n] = min(best.get((k, n), (0, 0)), (-round(s, 9), i))
    assert {(r.kind, r.name): (-round(r.score, 9), r.id) for r in index.best(q, "q", above, "kind").collect()} == best


@pytest.mark.parametrize("least", [0.45, 0.6, 0.75, 0.9])
def test_names_meet_by_several_trigrams_at_once(spark, least):
    """Numbered names all share their common trigrams, and many one rare one: those that meet are about as many as those alike."""
    rng = random.Random(9)
    known = sorted({f"Customer#{rng.randrange(10**6):09d}" for _ in range(1500)} | {"ab", "a b", "abc", "b", "Ab c", "x y z w"} | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    asked = [n + " inc" for n in known[::40]] + ["abc", "a", "B a", "ab c d", "cab", known[5].replace("C", "K")]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(known)], "id long, n string")
    index = T.build(rows, "id", "n", new_folder(spark, "trigrams"))
    sets, want = [grams(n) for n in known], {}
    for n in asked:
        g = grams(n)
        want |= {(n, i): len(g & h) / len(g | h) for i, h in enumerate(sets) if len(g & h) / len(g | h) > least}
    q = spark.createDataFrame([(n,) for n in asked], "q string")
    assert {(r.name, r.id): r.score for r in index.alike(q, "q", least).collect()} == pytest.approx(want)
    if least == 0.75:
        assert all(T._at_once(s, least) == 3 for s in range(5, 24)) and T._at_once(2, least) < 3
        assert index._met(index._asked(q, "q", None), least).count() < 2 * len(want) + 100  # 2,000 and more by one trigram


def test_trigram_index_of_no_names(spark):
    none = spark.createDataFrame([], "id string, name string")
    index = T.build(none, "id", "name", new_folder(spark, "trigrams"))
    q = spark.createDataFrame([("x",)], "q string")
    assert index.alike(q, "q", 0.2).collect() == [] and index.best(q, "q", 0.3).collect() == []
    some = T.build(q, "q", "q", new_folder(spark, "trigrams"))
    assert some.best(none, "name", 0.3).collect() == []


def test_vectors_raise_and_find_matches(spark):
    entities = spark.createDataFrame([("a", "org", "Acme Corporation", [1.0, 0.0]), ("b", "org", "Globex", [0.0, 1.0]), ("c", "org", "Initech", None), ("d", "person", "Acme Corp", [1.0, 0.0]), ("e", "org", "Zero", [0.0, 0.0])], "id string, entity_type string, name string, embedding array<float>")
    aliases = spark.createDataFrame([("c", "IT")], "entity_id string, alias string")
    asked = [("Acme Corp", "org", [1.0, 0.05]), ("The Globe Corporation of Springfield", "org", [0.1, 1.0]), ("it", "org", [1.0, 0.0]), ("Nobody", "org", [-1.0, -1.0]), ("Initec", "org", None)]
    extracted = spark.createDataFrame(asked, "name string, entity_type string, embedding array<float>")
    got = {r.name: (r.decision, r.entity_id, round(r.score, 3)) for r in I.resolve_entities(extracted, entities, aliases).collect()}
    t = alike("Acme Corp", "Acme Corporation")
    assert got["Acme Corp"] == ("ambiguous", "a", round(0.4 * t + 0.6 * 0.99875, 3)) and got["The Globe Corporation of Springfield"] == ("merge", "b", 0.995)
    assert got["it"] == ("merge", "c", 0.95) and got["Nobody"] == ("new", None, 0.0) and got["Initec"][0] == "new" and got["Initec"][2] == round(alike("Initec", "Initech"), 3)


def test_near_vectors_say_the_same_fact(spark):
    columns = "id string, source string, relation string, target string, fact_text string, valid_at timestamp_ntz, invalid_at timestamp_ntz, embedding array<float>"
    facts = spark.createDataFrame([("f", "s", "r", "t", "old", None, None, [1.0, 0.0])], columns)
    new = spark.createDataFrame([("1", "s", "r", "u", "x", None, None, [1.0, 0.1]), ("2", "s", "r", "u", "y", None, None, [1.0, 0.6]), ("3", "s", "r", "u", "OLD ", None, None, None), ("4", "s", "r", "u", "z", None, None, None)], columns)
    relations = spark.createDataFrame([("r", "one_per_source", "always")], "id string, cardinality string, invalidation_policy string")
    assert {r.id: r.action for r in I.resolve_facts(new, facts, relations).collect()} == {"1": "skip", "2": "invalidate_existing", "3": "skip", "4": "invalidate_existing"}


def test_facts_may_name_their_vectors(spark):
    """Facts that name their vectors are judged as by the vectors themselves; a name without a vector counts as none."""
    columns = "id string, source string, relation string, target string, fact_text string, valid_at timestamp_ntz, invalid_at timestamp_ntz, vector long"
    facts = spark.createDataFrame([("f", "s", "r", "t", "old", None, None, 1), ("g", "other", "r", "t", "old", None, None, 9)], columns)
    new = spark.createDataFrame([("1", "s", "r", "u", "x", None, None, 2), ("2", "s", "r", "u", "y", None, None, 3), ("3", "s", "r", "u", "OLD ", None, None, None), ("4", "s", "r", "u", "z", None, None, 7)], columns)
    relations = spark.createDataFrame([("r", "one_per_source", "always")], "id string, cardinality string, invalidation_policy string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.6])], "vector long, embedding array<float>")
    assert {r.id: r.action for r in I.resolve_facts(new, facts, relations, vectors).collect()} == {"1": "skip", "2": "invalidate_existing", "3": "skip", "4": "invalidate_existing"}


# ---------------------------------------------------------------- vectors


def made_vectors(spark, n=1500, dims=16, clusters=20):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(clusters, dims))[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, dims))
    x[: n // 3] = x[0]  # a third of all vectors are one
    rows = [(f"r{i}", [float(v) for v in x[i]], i) for i in range(n)] + [("null", None, -1), ("zero", [0.0] * dims, -2), ("nan", [float("nan")] * dims, -3)]
    return spark.createDataFrame(rows, "id string, v array<float>, n long").withColumns({"list": F.lit("clash"), "code": F.lit(1)})


def test_vector_index_finds_what_the_exact_search_finds(spark):
    rows = made_vectors(spark)
    index = V.build(rows, "id", "v", new_folder(spark, "vectors"), lists=25, parts=4)
    asked = rows.filter("n % 50 = 0")
    exact = {(r.query, r.id): r.similarity for r in nearest_to_each(asked, rows, "id", "v").collect()}
    found = {(r.query, r.id): r.similarity for r in index.nearest(asked, "id", "v").collect()}
    best = {q: sorted((-s for (p, _), s in exact.items() if p == q))[-1] for q, _ in exact}
    right = sum(-s <= best[q] + 1e-6 for (q, _), s in found.items())  # equal vectors are as good as one another
    assert index.probes < 25 and right >= 0.9 * len(exact) and len(found) == len(exact)
    every = {(r.query, r.id): r.similarity for r in index.nearest(asked, "id", "v", probes=25, rerank=2000).collect()}
    assert every.keys() == exact.keys() and all(every[k] == pytest.approx(exact[k], abs=1e-6) for k in exact)
    some = rows.filter("n % 7 = 0").select("id")
    own = {r.id for r in index.nearest(rows.filter("n = 0"), "id", "v", k=5, probes=25, allowed=some).collect()}
    assert len(own) == 5 and all(int(i[1:]) % 7 == 0 for i in own)
    assert index.nearest(rows.filter("n < 0"), "id", "v").collect() == []


def test_all_lists_compare_members_where_they_lie(spark, monkeypatch):
    """Every list and every candidate: the exact neighbours, ties by id, of allowed rows only where so asked; a block hands on few
    members for each query, not all."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8))
    x[10:40] = x[10]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    index = V.build(rows, "id", "v", new_folder(spark, "vectors"), lists=4, parts=4)
    most, keep = [], V.first_n
    monkeypatch.setattr(V, "first_n", lambda df, *a: most.append(df.count()) or keep(df, *a))
    asked = rows.filter("id % 100 = 10")
    for allowed in (None, rows.filter("id % 2 = 0").select("id")):
        of = rows if allowed is None else rows.join(allowed, "id", "left_semi")
        want = {(r.query, r.id): pytest.approx(r.similarity, abs=1e-6) for r in nearest_to_each(asked, of, "id", "v", 5).collect()}
        got = index.nearest(asked, "id", "v", 5, probes=4, rerank=600, allowed=allowed).collect()
        assert {(r.query, r.id): r.similarity for r in got} == want and len(got) == 30
    assert max(most) <= 6 * 4 * (10 + 30)  # of 6 * 600


def test_vector_index_of_few_rows(spark):
    rows = made_vectors(spark).filter("n in (1, 2, -1)")
    index = V.build(rows, "id", "v", new_folder(spark, "vectors"), parts=4)
    assert {r.id for r in index.nearest(rows, "id", "v").collect()} == {"r1", "r2"}
    none = V.build(rows.limit(0), "id", "v", new_folder(spark, "vectors"), parts=4)
    assert none.nearest(rows, "id", "v").collect() == []


def test_semantic_search_and_seeds_over_indexes(spark):
    none, policy = F.lit(None).cast("timestamp_ntz"), policy_of(F.lit(3))
    rows = made_vectors(spark)
    facts = rows.select("id", F.col("id").alias("fact_text"), F.lit(0.5).alias("confidence"), none.alias("valid_at"), none.alias("invalid_at"), F.col("v").alias("embedding"), policy.alias("visibility"))
    entities = rows.select("id", F.col("id").alias("name"), F.lit("").alias("summary"), policy.alias("visibility"))
    episodes = rows.limit(0).select("id", F.col("id").alias("content"), none.alias("valid_at"), policy.alias("visibility"))
    asked = R.Request("r700 r71", vector=[float(x) for x in rows.filter("n = 700").first().v], limit=4)
    plain = R.Corpus(entities, facts, episodes)
    index = V.build(rows, "id", "v", new_folder(spark, "vectors"), lists=25, parts=4)
    indexed = R.Corpus(entities, facts, episodes, vectors={"facts": index}, names=T.build(entities, "id", "name", new_folder(spark, "trigrams")))
    assert [r.id for r in R.semantic_search(indexed, asked).collect()] == [r.id for r in R.semantic_search(plain, asked).collect()]
    assert [tuple(r) for r in R.find_seeds(indexed, asked).collect()] == [tuple(r) for r in R.find_seeds(plain, asked).collect()]


def test_exact_neighbours_of_groups_with_bounded_products(spark, monkeypatch):
    from loomgraph.functions import vector

    monkeypatch.setattr(vector, "PRODUCTS", 64)
    monkeypatch.setattr(vector, "BLOCK_BYTES", 700)
    rows = made_vectors(spark, 90, 8, 5).withColumn("g", F.col("n") % 3)
    got = {(r.query, r.id): r.similarity for r in nearest_to_each(rows.filter("n % 9 = 0"), rows, "id", "v", 4, "g").collect()}
    data = {r.id: (np.asarray(r.v, np.float32).astype(float), r.g) for r in rows.filter("n >= 0").collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for q in (i for i in data if int(i[1:]) % 9 == 0):
        want = sorted(((-round(cos(data[q][0], v), 12), i) for i, (v, g) in data.items() if g == data[q][1]))[:4]
        assert sorted(-s for (p, _), s in got.items() if p == q) == pytest.approx([s for s, _ in want])


def test_exact_neighbours_in_tiles_with_equal_vectors_zeros_and_groups(spark, monkeypatch):
    """Tiles of queries and rows, most of which bring nothing; of equal vectors the smaller keys are nearest, in whatever tile they are."""
    from loomgraph.functions import vector

    monkeypatch.setattr(vector, "SIDE", 16)
    monkeypatch.setattr(vector, "PRODUCTS", 512)
    rng = np.random.default_rng(7)
    some = rng.normal(size=(60, 6)).astype(np.float32).tolist() + [[0.0] * 6]
    data = [(f"r{n:03}", some[n * 7 % 61], "abb"[n % 3] if n else "alone") for n in range(400)]
    rows = spark.createDataFrame(data, "id string, v array<float>, g string").repartition(3, "id")
    asked = spark.createDataFrame([(n, *data[n][1:]) for n in range(0, 400, 3)] + [(-1, some[0], "none")], "id long, v array<float>, g string")
    got = {}
    for r in nearest_to_each(asked, rows, "id", "v", 3, "g").collect():
        got.setdefault(r.query, []).append((-round(r.similarity, 9), r.id))
    unit = {i: np.float64(v) / np.linalg.norm(v) for i, v, _ in data if any(v)}
    want = {n: sorted((-round(float(unit[data[n][0]] @ unit[i]), 9), i) for i, _, g in data if g == data[n][2] and i in unit)[:3] for n in range(0, 400, 3) if data[n][0] in unit}
    assert {q: sorted(x) for q, x in got.items()} == want and len(want) > 100


# ---------------------------------------------------------------- runs of tables


def files_of(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return {str(f.getPath().getName()) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}


def test_a_run_leaves_its_result_only(spark):
    written(spark.range(1), "other")
    before = files_of(spark)

    @leaves_one_table
    def sums(n):
        return written(spark.range(n), "numbers").agg(F.sum("id").alias("s"))

    assert sums(5).first().s == 10
    assert [x.split("-")[0] for x in files_of(spark) - before] == ["sums"]
    with pytest.raises(RuntimeError), run_of_tables():
        sums(3)
        raise RuntimeError
    assert [x.split("-")[0] for x in files_of(spark) - before] == ["sums"]
    assert not leaves_one_table(lambda: spark.range(2))().inputFiles()
