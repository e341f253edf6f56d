"""HTML, quality, pieces, language and chat against brute force."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import htmltext, langid, pieces
from loomgraph.llm.chat import chat_examples, escaped, parsed, read_back, unescaped
from loomgraph.llm.quality import Rule, quality
from loomgraph.llm.queries import PIECE_MODEL


# ---------------------------------------------------------------- pages


def text_of(html):
    return [text for text, state in htmltext.lines_of(html) if state != htmltext.GONE]


def test_markup_that_goes_and_stays():
    html = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class='has-menu'><header>Site</header><nav><a>m</a></nav>"
        "<script>var x='</p>';</script><!-- c --><div class='cookie-notice'>C</div><aside>S</aside><article><header><h1>Head &amp; more</h1></header>"
        "<p>One\n  <b>two</b>three<br>four &lt;x&gt;</p><p>unclosed<p>next<form>f</form><div class='ad'>A</div></article>"
        "<section id='comments'><p>reader</p></section><footer>F</footer>"
    )
    assert text_of(html) == ["Head & more", "One twothree four <x>", "unclosed", "next"]


def test_names_that_only_hold_a_marking_word():
    assert text_of('<div class="content no-sidebar"><p>Main text</p></div>') == ["Main text"]
    assert text_of('<article><div class="entry-content social"><p>Body of it</p></div><div class="social">Share</div></article>') == ["Body of it"]
    assert text_of('<main><section id="related-work">A</section><div class="social-science">B</div><div class="related">C</div><p>A longer line</p></main>') == ["A", "B", "A longer line"]
    assert text_of('<div class="sidebar"><article>Whole text</article></div>') == ["Whole text"]


def test_menus_that_never_end():
    assert text_of("<nav><ul><li>Home<li>More</ul><article><p>x</p></article><footer>F</footer>") == ["x"]
    assert text_of("<body><header>Site<main><h1>T</h1><p>Text</p></main>") == ["T", "Text"]
    assert text_of("<aside><article>Teaser</article></aside><article><p>The long text of the article</p></article>") == ["The long text of the article"]


def test_many_comments_are_still_comments():
    html = "<article><p>Short</p><div id='comments'>" + "<p>a reader said much</p>" * 50 + "</div></article><article class='comment'>me too</article>"
    assert text_of(html) == ["Short"]


def test_odd_markup():
    assert text_of(None) == [] == text_of("") == text_of("<script>x")
    assert text_of("a < b <i title='>'>c</i> &am &amp") == ["a < b c &am &"]
    assert text_of("<p>x" * 3 + "<td>y<td>z") == ["x", "x", "x", "y", "z"]
    assert len(text_of("<div>" * 3000 + "deep")) == 1
    assert text_of("a<button>no</button>b <span class='ad'>A</span>c") == ["ab c"]
    assert text_of("kept<a href='never ends") == ["kept"]


@pytest.mark.parametrize("part", ["<script", "<", "<x", "<a '> '", '<a b="', "<div>", "<b>", "</i>", "<li>", "<p><b>", "&", "x ", "<!--", "<a =\"", "<svg>", "<nav class=ad>", "<li></li><b>"])
def test_damaged_pages_are_read_in_linear_time(part):
    for page in (part * (1_000_000 // len(part)), "<li><div>" + "<b>" * 100_000 + part * (600_000 // len(part)), part * (900_000 // len(part)) + ">"):
        began = time.process_time()
        htmltext.lines_of(page)
        assert time.process_time() - began < 6  # under two seconds on an idle machine


def test_long_pages_are_aligned():
    a = [i % 7 if i % 3 else i for i in range(12_000)]
    began = time.process_time()
    left, right = htmltext.shared_lines(a, a[5:6000] + a[6100:] + [1] * 500)
    assert len(left) >= 11_800 and [a[i] for i in left] == [(a[5:6000] + a[6100:] + [1] * 500)[j] for j in right]
    assert time.process_time() - began < 10


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        left, right = htmltext.shared_lines(a, b)
        assert len(left) == best[-1][-1] and [a[i] for i in left] == [b[j] for j in right]
        assert left == sorted(set(left)) and right == sorted(set(right))


def brute_main_text(rows):
    """The texts of pages straight from the definition."""
    split = lambda url: re.search(r"://([^/?#]*)([^?#]*)", url or "")
    lines = {i: htmltext.lines_of(html) for i, _, html in rows}
    place = {i: ((m := split(url)) and m[1].lower() or "", m and m[2] or "") for i, url, _ in rows}
    known = {}
    for i, _, _ in rows:
        if lines[i]:
            key = (place[i][0], tuple(t for t, _ in lines[i]))
            known[key] = min(place[i][1], known.get(key, place[i][1]))
    out = {}
    for i, _, _ in rows:
        own, shared = tuple(t for t, _ in lines[i]), []
        order = sorted((path, digest(ts), ts) for (host, ts), path in known.items() if host == place[i][0])
        at = next((n for n, x in enumerate(order) if x[2] == own), None)
        if at is not None:
            near = [(len(os.path.commonprefix([order[at][0], order[n][0]])), n < at, order[n][2]) for n in (at - 1, at + 1) if 0 <= n < len(order)]
            if near:
                _, before, other = max(near)
                shared = htmltext.shared_lines(own, other)[0] if not before else htmltext.shared_lines(other, own)[1]
        out[i] = "\n\n".join(t for n, (t, s) in enumerate(lines[i]) if s == htmltext.STAYS or (s == htmltext.OPEN and n not in shared))
    return out


def digest(texts):
    return hashlib.blake2b(b"".join(htmltext._line_hash(t).to_bytes(8, "little", signed=True) for t in texts), digest_size=16).hexdigest()


def test_main_text_matches_brute_force(spark, small):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        menu = "".join(f"<div>Menu {j}</div>" for j in range(rng.randint(1, 6)))
        body = "".join(f"<p>{rng.choice(['Own ' + str(i), 'Seen everywhere', 'Line ' + str(rng.randrange(9))])}</p>" for _ in range(rng.randrange(6)))
        body = rng.choice(["{}", "<article>{}</article>", "<main>{}", "<div class='social'>{}</div>"]).format(body)
        rows.append((i, rng.choice(["http://A.com", "https://b.org", "http://c.net"]) + f"/x/{rng.randrange(40)}" + rng.choice(["", "?q=1"]), menu + body + "<div>Legal</div>"))
    rows += [(200, None, "<p>x"), (201, "no scheme", "<p>x"), (202, "http://a.com/x/3", None), (203, "http://a.com/x/3", ""), (204, "http://one.org/", "<div>alone</div>")]
    rows += [(1000 + r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"n_chars": F.lit("clash"), "host": F.lit(1), "line": F.lit(2)})
    got = {r.page_id: r.text for r in htmltext.main_text(pages.repartition(6)).collect()}
    assert got == brute_main_text(rows)


def test_shared_lines_of_neighbours_go(spark):
    page = lambda i: f"<div>Menu</div><div>Own {i} text</div><div>Legal</div>"
    rows = [(i, f"http://H.com/x/{i}?q", page(i)) for i in range(20)] + [(50, "http://h.com/x/3", page(3)), (51, None, page(7)), (52, "http://other/x", page(1)), (53, "http://h.com/x/9", None)]
    rows += [(54, "http://h.com/y/copy", page(3).replace("<div>", "<div id=1>")), (60, "http://h.com/z/1", "<p>Menu</p><article><p>Menu</p><p>A</p></article>"), (61, "http://h.com/z/1", "<article><p>teaser</p></article><div>Menu<p>Body of it</p></div>")]
    out = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()
    got = {r.page_id: r.text for r in out}
    assert all(got[i] == f"Own {i} text" for i in range(20))
    assert got[50] == got[54] == "Own 3 text" and got[53] == "" and got[60] == "Menu\n\nA" and got[61] == "teaser\n\nBody of it"
    assert got[51] == "Menu\n\nOwn 7 text\n\nLegal" == got[52].replace("Own 1", "Own 7")
    assert {r.n_shared for r in out if r.page_id < 20} == {2}


def test_no_pages(spark):
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# ---------------------------------------------------------------- quality


def test_quality_counts_match_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a#b *$ |", "x\nx\n \nx y\nx y", "the " * 400, " ".join(rng.choice("abc") for _ in range(300)), "É\x0bé\x0c<ü>"]
    texts += ["\n".join(" ".join(rng.choice(["the", "of", "ab", "#x"]) for _ in range(rng.randrange(9))) for _ in range(40)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("clash"))
    from tests_words import counts  # noqa: PLC0415

    for r in quality(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_no_texts_to_judge(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert quality(empty).collect() == []


def test_rules_decide(spark):
    good = " ".join(f"the word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, good), (2, good.replace("the", "zzz")), (3, good.replace("the", "the###"))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality(docs).collect()} == {1: True, 2: False, 3: False}
    assert {r.doc_id: r.kept for r in quality(docs, rules=(Rule("words", "n_words", 10, None),)).collect()} == {1: True, 2: True, 3: True}


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def automaton():
    return pieces.load(PIECE_MODEL)


HARD = [None, "", " ", "  ", "a", "é▁x ▁", "🙂\n\t x", "word" * 400, "x " * 90 + "日本語", "\u0000", " lead", "tail  ", "<s> </s> <0x41>"]


def test_pieces_round_trip(automaton):
    column = pa.array(HARD)
    ids = pieces.encode_column(automaton, column)
    assert pieces.decode_column(automaton, ids).to_pylist() == [x or "" for x in HARD]
    assert ids.to_pylist()[:2] == [[], []]


def test_pieces_take_the_best_split(automaton):
    """Against a plain dynamic programme over all pieces."""
    table = {}
    for node in range(len(automaton.piece)):
        if automaton.piece[node] >= 0:
            table[automaton.raw[automaton.at[automaton.piece[node]] : automaton.at[automaton.piece[node] + 1]].tobytes()] = automaton.score[node]
    rng = random.Random(6)
    for text in ["the theatre", "hello  world", "naïve façade", "".join(rng.choice("abcdeé ") for _ in range(60)), "ab" * 400]:
        raw = b" " + text.encode()
        best = [0.0] + [float("-inf")] * len(raw)
        for j in range(1, len(raw) + 1):
            for k in range(1, min(j, 64) + 1):
                score = table.get(raw[j - k : j])
                if score is not None:
                    best[j] = max(best[j], best[j - k] + score)
        score = {int(automaton.piece[n]): automaton.score[n] for n in range(len(automaton.piece)) if automaton.piece[n] >= 0}
        ids = pieces.encode_column(automaton, pa.array([text])).to_pylist()[0]
        assert sum(score[i] for i in ids) == pytest.approx(best[-1])


def test_pieces_query_is_lossless(spark, small):
    from loomgraph.llm.queries import op4_sentencepiece

    out = op4_sentencepiece(spark, small)
    assert out.filter("not lossless or lossless is null").count() == 0
    assert out.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_long_texts_without_spaces(automaton):
    """Cut where no piece crosses, they get the split of the byte-by-byte search, in a fraction of its time."""
    rng = random.Random(9)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(400)), "日本語の文章" * 120, "x" * 700 + "人大" * 90, "é▁" * 300 + "ab"]
    got = pieces.encode_column(automaton, pa.array(texts)).to_pylist()
    for text, ids in zip(texts, got, strict=True):
        raw = np.frombuffer(b" " + text.encode(), np.uint8)
        own, at = pieces._one(automaton, raw, pieces._char_lengths(raw))
        ends = [*at[1:].tolist(), len(raw)]
        assert ids == [x for i, a, e in zip(own.tolist(), at.tolist(), ends, strict=True) for x in ([i] if i >= 0 else automaton.byte_ids[raw[a:e]].tolist())]
    long = "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(200_000))
    began = time.process_time()
    assert pieces.decode_column(automaton, pieces.encode_column(automaton, pa.array([long]))).to_pylist() == [long]
    assert time.process_time() - began < 8


def test_equal_chunk_hashes_are_confirmed(automaton, monkeypatch):
    texts = ["the cat", "the dog  the cat", "a b c", None, "catcat  dog"]
    want = pieces.encode_column(automaton, pa.array(texts)).to_pylist()
    monkeypatch.setattr(pieces, "mix", lambda x: np.zeros(len(x), np.uint64))  # all hashes collide
    assert pieces.encode_column(automaton, pa.array(texts)).to_pylist() == want


def test_pieces_with_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "old", 3.0), (1, "a b", "old", 3.0)], "doc_id long, text string, ids string, decoded double")
    out = pieces.decode(pieces.encode(docs, PIECE_MODEL), PIECE_MODEL)
    assert out.columns == ["doc_id", "text", "ids", "decoded"] and [r.decoded for r in out.collect()] == ["a b", "a b"]
    assert pieces.round_trip(docs.limit(0), PIECE_MODEL).collect() == []


# ---------------------------------------------------------------- language


def plain_features(text):
    """Shares of hashed byte bigrams and trigrams of letters, square-rooted, one by one."""
    code = [b if b >= 128 or 97 <= b <= 122 else 0 for b in text.lower().encode()]
    counts = Counter()
    for size, factor in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        for i in range(len(code) - size + 1):
            value = 0
            for c in code[i : i + size]:
                value = (value * 257 + c) % 2**32
            if value:
                counts[value * factor % 2**32 >> 21] += 1
    total = sum(counts.values())
    return {place: math.sqrt(n / total) for place, n in counts.items()}


def plain_prediction(model, text):
    x = plain_features(text)
    margin = lambda w: sum(v * float(w[place]) for place, v in x.items()) + float(w[-1])
    sure = lambda m: 1 / (1 + math.exp(-4 * m))
    score, family = 1.0, model.families[0]
    if len(model.families) > 1:
        score, family = max((sure(margin(w)), f) for w, f in zip(model.family_w, model.families, strict=True))
    names = model.members[family]
    wins, least = Counter({n: 0 for n in names}), {n: 1.0 for n in names}
    for (a, b), w in model.pairs.items():
        if a in names:
            p = sure(margin(w))
            wins[a] += (p >= 0.5) + 0.01 * p
            wins[b] += (p < 0.5) + 0.01 * (1 - p)
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
    best = max(names, key=lambda n: wins[n])
    return best, score * least[best]


def test_language_query_matches_brute_force(spark, small):
    """Features, margins of families and pairs, and votes, written out one by one, give the query's rows."""
    from loomgraph.llm.queries import op9_language_id

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(langid.bucket("doc_id") != 1))
    got = {r.doc_id: r for r in op9_language_id(spark, small).collect()}
    for r in docs.collect():
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        want = ("und", 0.0) if not any(c.isalpha() for c in r.text or "") else plain_prediction(model, r.text)
        assert got[r.doc_id].lang_pred == want[0] and got[r.doc_id].score == pytest.approx(want[1], abs=1e-3)


def test_more_languages_than_the_sample_can_hold(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    with pytest.raises(ValueError, match="60 languages"):
        langid.learn(docs, max_rows=500)


def test_language_on_held_out_documents(spark, small):
    from loomgraph.llm.queries import op9_language_id

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    rows = op9_language_id(spark, small).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(i, f"der hund und die katze {i}" if i % 2 else f"le chien et la rue {i}", "de" if i % 2 else "fr") for i in range(60)] + [(70, None, "de"), (71, "123 !!", "fr"), (None, "le chat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[70] == got[71] == ("und", 0.0) and got[None][0] == "fr" and got[3][0] == "de"
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(docs.filter("doc_id < 0"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0), None).collect() == []


# ---------------------------------------------------------------- chat


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "<turn>user<text>\n</turn>\n", "\\b\\l\\\\<", "", "é\n🙂"]
    rows = [(c, t, "assistant" if t % 2 else "user", hard[(c + t) % 5]) for c in range(5) for t in range(5)]
    rows += [(50, 0, "user", "only"), (51, 0, None, None), (51, 0, "assistant", None), (None, 3, "assistant", "x"), (52, 1, "assistant", "a"), (52, 0, "assistant", "b"), (52, 1, "assistant", "a")]
    got = {r.conv_id: r for r in read_back(chat_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_chats_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "x", "y"), (1, 1, "user", "z", "y")], "conv_id long, turn long, role string, text string, turns string")
    assert [(r.n, r.trainable, r.loss_length) for r in chat_examples(rows).orderBy("n").collect()] == [(1, True, 1), (2, False, 0)]
    assert chat_examples(rows.limit(0)).collect() == [] == read_back(chat_examples(rows.limit(0))).collect()


def test_chat_examples_hold_the_turns_before(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "first"), (1, 3, "user", "v"), (1, 4, "assistant", "second")], "conv_id long, turn long, role string, text string")
    out = chat_examples(rows).orderBy("n").collect()
    assert [r.n for r in out] == [3, 5]
    assert [r.formatted[r.loss_start : r.loss_start + r.loss_length] for r in out] == ["first", "second"]
    assert out[1].formatted.startswith(out[0].formatted)
    one = spark.range(1).select(unescaped(escaped(F.lit("\\b<\\l"))).alias("x"), parsed(F.lit(out[0].formatted)).alias("t")).first()
    assert one.x == "\\b<\\l" and [(t.role, t.text) for t in one.t] == [("system", "s"), ("user", "u"), ("assistant", "first")]


@pytest.mark.parametrize(
    "html,lines",
    [
        ('<form id="aspnetForm"><div class="content"><p>Article para.</p><p>Second para.</p></div><button>Go</button></form>', ["Article para.", "Second para."]),
        ("<body><form><label>Search</label><input></form><p>Real</p></body>", ["Real"]),
        ("<nav><a>Home</a> <a>News</a><div><p>Article long para.</p><p>More", ["Article long para.", "More"]),
        ("<nav><a>Home</a><p>Closed menus go whole</p></nav><p>Text</p>", ["Text"]),
        ('<article><p>E is <math>E</math>.</p><aside class="pull-quote">Quoted</aside><aside>Side</aside><footer>By me</footer></article>', ["E is E.", "Quoted"]),
        (f'<div class="cookie-notice">{"We use cookies. " * 50}</div><p>Short.</p>', ["Short."]),
        ('<div class="main sidebar-right wrapper"><p>All of the page</p></div>', ["All of the page"]),
        ('<div id="cookie-notice"><p>Only a notice</p></div>', []),
        (f"<nav>{'<div>' * 5100}MENU{'</div>' * 5100}</nav><p>Text</p>", ["Text"]),
        ('<p title="a>b">Quoted > sign</p><p title="open>Never <b>closed</b>', ["Quoted > sign", "Never closed"]),
        (f'{"<i title=x\'>" * 60}<p title="a>b">Still read</p>', ["Still read"]),
    ],
)
def test_articles_in_odd_pages(html, lines):
    assert text_of(html) == lines
