"""Main text of web pages by nearest-URL page differencing.

Pages of one host are put in the order of their paths; neighbours in this order
are pages of one template.  All text lines of a page (a line is a block's text)
are aligned with those of its nearest neighbour (the one with the longer common
path) by longest common subsequence, and shared lines are deleted: they belong to
the template.  Markup settles two kinds of lines beside that: a line that stands
in an article or main element is the article's and stays, shared or not (a
sentence that two articles quote is no template), and a line of an element that
names itself a menu, header, footer, sidebar, notice, advert, form or comment
goes, shared or not.  Every other line stays if it isn't shared.  A page without
such lines needn't wait for its neighbours, but its lines count in theirs.

Names of elements count as whole class or id tokens, whose parts must all be
known (cookie-notice, left-sidebar; not no-sidebar or social-science), and never
for an element that holds an article, or, but for comments, most of the text.  A
menu that holds the article ends where the article begins; one that is never closed
ends where text begins that is no link; a form around all of a page isn't dropped; a
notice or an advert goes however long it is.

Order and neighbours are found without gathering a host: small rows (path and
line hashes) are sorted by range, numbered, and joined with the next number.
Pages of a host with equal lines are one row there, at the smallest of their
paths, so that no page is compared with its own copy.

Defined results: a null html has an empty text; a null URL or one without ://
has an empty host and path; pages without lines are nobody's neighbours; a page
without a neighbour on its host keeps its undecided lines; of two equally near
neighbours the one before counts; repeated rows get the same text; damaged markup
is read in linear time (a tag that never ends takes the rest of the page with
it); a page of any length is read whole, its memory grows with its length; an
empty table gives an empty result; other columns pass through (the html column
doesn't; a result column replaces one of that name).
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from math import isqrt
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices, written

#: Elements by kind.
DROPPED = set("head script style noscript template iframe object svg canvas nav aside footer form button select textarea dialog menu datalist audio video map".split())
RAW = set("script style noscript template iframe textarea title svg select object".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
ARTICLES = {"article", "main"}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
#: Words of class and id names that mark something other than the article; reader comments; and words that may stand beside them.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs masthead topbar toolbar footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations search pagination pager skip copyright".split()
)
#: Of these, the ones that never name an element around the article.
NOTICES = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login".split())
COMMENTS = set("comment comments commentlist respond reply replies disqus".split())
BESIDE = set("site main top bottom left right primary secondary box container wrapper wrap block area bar list item items form link links button buttons header global sticky".split())

GONE, OPEN, STAYS = 0, 1, 2

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
QUOTED = re.compile(r"(?<![a-z])(?:pull-?_?quote|blockquote)s?(?![a-z])", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
SPECIAL = re.compile("[>\"']")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}


class TagEnds:
    """Where the tags of a damaged page end: for each > and quote, the > that ends a tag which is outside of quotes there (-1:
    none).  One pass from the back."""

    def __init__(self, html: str):
        self.at = [m.start() for m in SPECIAL.finditer(html)]
        self.end, same = [-1] * (len(self.at) + 1), {}
        for i in range(len(self.at) - 1, -1, -1):
            c = html[self.at[i]]
            self.end[i] = self.at[i] if c == ">" else self.end[same[c] + 1] if c in same else -1
            same[c] = i

    def of(self, start: int) -> int:
        return self.end[bisect_left(self.at, start)]


def scanned(html: str) -> Iterator[tuple[str, str, str]]:
    """Parts of a page in order: (text, "", the text), (open, name, attributes), (close, name, ""), (raw, name, "")."""
    at, ends_of, n = 0, None, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt != at:
            yield "text", "", html[at:] if lt < 0 else html[at:lt]
        if lt < 0:
            return
        following = html[lt + 1 : lt + 2]
        if following in ("!", "?"):
            ends = ("-->", lt + 4) if html.startswith("<!--", lt) else ("]]>", lt + 9) if html.startswith("<![CDATA[", lt) else (">", lt + 2)
            end = html.find(*ends)
            if end < 0:
                return
            at = end + len(ends[0])
            continue
        name = NAME.match(html, lt + 1 + (following == "/"))
        if not name:
            yield "text", "", "<"
            at = lt + 1
            continue
        tag = TAG.match(html, lt) if ends_of is None else None
        if tag is None and ends_of is None:
            ends_of = TagEnds(html)
        end = tag.end() - 1 if tag else ends_of.of(name.end())
        end = html.find(">", name.end()) if end < 0 else end
        if end < 0:
            return
        at, what = end + 1, name[0].lower()
        if following == "/":
            yield "close", what, ""
        elif what in RAW:
            yield "raw", what, ""
            close = ENDS[what].search(html, at)
            at = close.end() if close else n
        else:
            yield "open", what, html[name.end() : end]


def _named(tokens: str, words: set[str]) -> bool:
    """Whether a class or id token consists of known words, one of them of these."""
    for token in tokens.split():
        parts = {w.lower() for w in WORD.findall(token)}
        if parts & words and parts <= MARKS | COMMENTS | BESIDE:
            return True
    return False


def _kind(name: str, rest: str, in_article: bool) -> str:
    """What an element says of itself: gone (it isn't the article's), comments, marked (by a name only), article, or nothing."""
    if name in DROPPED or (name == "header" and not in_article):
        return "form" if name == "form" else "quote" if name == "aside" and in_article and QUOTED.search(rest) else "gone"
    if rest.strip(" /\t\r\n"):
        has = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(rest)}
        role = has.get("role", "").lower()
        style = has.get("style", "").replace(" ", "").lower()
        if "hidden" in has or has.get("aria-hidden", "").lower() == "true" or "display:none" in style or role in ROLES:
            return "gone"
        names = has.get("class", "") + " " + has.get("id", "")
        if name not in ("html", "body", "main") and _named(names, COMMENTS):
            return "comments"
        if role == "main" or has.get("itemprop", "").lower() == "articlebody":
            return "article"
        if name not in ("html", "body", *ARTICLES) and (_named(names, MARKS) or (not in_article and names.split() == ["header"])):
            return "notice" if _named(names, NOTICES) else "marked"
    return "article" if name in ARTICLES else ""


class Page:
    """Elements of a page as a tree (element 0 is the page), and its pieces of text: (line, element, text, in a link)."""

    def __init__(self, html: str):
        self.up, self.kind, self.pieces = [-1], [""], []
        stack, names, articles, line, link = [0], [""], 0, 0, False
        where, blocks = defaultdict(list), []  # depths of the open elements of each name, and of open blocks
        self.begin, self.closed = [0], [True]  # number of pieces before each element; whether its end tag is there

        def close(depth: int) -> None:
            nonlocal articles
            for name, e in zip(names[depth:], stack[depth:], strict=True):
                where[name].pop()
                articles -= self.kind[e] == "article"
            while blocks and blocks[-1] >= depth:
                blocks.pop()
            del stack[depth:], names[depth:]

        for what, name, rest in scanned(html):
            if what == "text" or what == "raw" or name == "br":
                if name != "title":
                    self.pieces.append((line, stack[-1], rest if what == "text" else " ", link))
                continue
            if name == "a":
                link = what == "open"
            if name in BLOCKS:
                line += 1
            if what == "close":
                if where[name]:
                    depth = where[name][-1]
                    self.closed[stack[depth]] = True
                    close(depth)
                continue
            if name in VOID:
                continue
            if name in BLOCKS and blocks and (names[blocks[-1]] == "p" or name == names[blocks[-1]] == "li"):
                close(blocks[-1])
            kind = _kind(name, rest, articles > 0)
            if kind or name in BLOCKS:
                where[name].append(len(stack))
                if name in BLOCKS:
                    blocks.append(len(stack))
                stack.append(len(self.up))
                names.append(name)
                articles += kind == "article"
                self.up.append(stack[-2])
                self.kind.append(kind)
                self.begin.append(len(self.pieces))
                self.closed.append(False)

    def states(self) -> list[int]:
        """GONE, OPEN or STAYS for each piece."""
        found = self._states(("gone", "form"))
        if any(s and t.strip() for s, (_, _, t, _) in zip(found, self.pieces, strict=True)):
            return found
        return self._states(("gone",))  # a form around the whole page is no form of the article's

    def _states(self, dropped: tuple[str, ...]) -> list[int]:
        up, kind, n, last = self.up, self.kind, len(self.up), len(self.pieces)
        chars, article, around, first = [0] * n, [0] * n, [0] * n, [last] * n
        for i in range(last - 1, -1, -1):
            _, e, text, link = self.pieces[i]
            chars[e] += len(text.strip())
            if text.strip() and not link:
                first[e] = i
        for e in range(n - 1, 0, -1):  # article: the first article in an element (0 for none); first: its first text outside of links
            if kind[e] == "article" and chars[e]:
                article[e] = e
            chars[up[e]] += chars[e]
            first[up[e]] = min(first[up[e]], first[e])
            if article[e]:
                article[up[e]] = article[e]
        hidden = [False] * n
        for e in range(1, n):
            hidden[e] = hidden[up[e]] or (kind[e] in dropped and not article[e])
            around[e] = e if kind[e] == "article" else around[up[e]]
        shown = chars[0] - sum(chars[e] for e in range(1, n) if hidden[e] and not hidden[up[e]])
        upto = [0] * n  # pieces before this number are gone
        for e in range(1, n):
            most = 2 * chars[e] > (chars[around[e]] if around[e] else shown)
            gone = kind[e] in dropped or kind[e] == "comments"
            if gone and article[e] and (most or not self.closed[e]):
                own = self.begin[article[e]]
            elif gone and not self.closed[e] and kind[e] != "comments":
                own = first[e]  # never closed: it ends where something else than links begins
            elif gone or (kind[e] == "notice" and not article[e]) or (kind[e] == "marked" and not article[e] and not (most and (around[e] or not article[0]))):
                own = last
            else:
                own = 0
            upto[e] = max(upto[up[e]], own)
        return [GONE if i < upto[e] else STAYS if around[e] else OPEN for i, (_, e, _, _) in enumerate(self.pieces)]


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """Text lines of a page in order, and what markup says of each: GONE, OPEN or STAYS.  What is gone of a line that
    otherwise isn't is left out of its text."""
    page, out, parts, number = Page(html or ""), [], [], -1

    def flush() -> None:
        text = _clean([t for s, t in parts if s])
        state = max((s for s, _ in parts), default=GONE) if text else GONE
        text = text or _clean([t for _, t in parts])
        if text:
            out.append((text, state))
        parts.clear()

    for (line, _, text, _), state in zip(page.pieces, page.states(), strict=True):
        if line != number:
            flush()
            number = line
        parts.append((state, text))
    flush()
    return out


def shared_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions in a and in b of a longest common subsequence.

    A row of the table of lengths is a number whose zero bits mark where the length grows, so a row takes a few
    operations on len(b) bits.  One row in a block is kept, and a block's rows are made again on the way back."""
    skip = 0
    while skip < min(len(a), len(b)) and a[skip] == b[skip]:
        skip += 1
    tail = 0
    while tail < min(len(a), len(b)) - skip and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    rows, columns = a[skip : len(a) - tail], b[skip : len(b) - tail]
    where: dict[int, int] = {}
    known = set(rows)
    for j, x in enumerate(columns):
        if x in known:
            where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(columns)) - 1

    def next_row(row: int, x: int) -> int:
        own = row & where.get(x, 0)
        return (row + own | row - own) & full

    block = isqrt(len(rows)) + 1
    kept, row = [], full
    for i, x in enumerate(rows):
        if i % block == 0:
            kept.append(row)
        row = next_row(row, x)
    left, right, j = [], [], len(columns)
    for start in range((len(kept) - 1) * block, -1, -block):
        table = [kept[start // block]]
        for x in rows[start : start + block]:
            table.append(next_row(table[-1], x))
        i = len(table) - 1
        while i and j:
            if table[i] >> (j - 1) & 1:
                j -= 1
            elif table[i - 1] >> (j - 1) & 1:
                i, j = i - 1, j - 1
                left.append(skip + start + i)
                right.append(skip + j)
            else:
                i -= 1
    ends = range(tail, 0, -1)
    return [*range(skip), *left[::-1], *(len(a) - x for x in ends)], [*range(skip), *right[::-1], *(len(b) - x for x in ends)]


def _line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


BLOCK = pa.list_(pa.struct([("line", pa.int32()), ("stays", pa.bool_()), ("text", pa.string())]))
BLOCK_TYPE = T.ArrayType(T.StructType().add("line", "integer").add("stays", "boolean").add("text", "string"))


def _parsed(html: str, names: list[str]):
    """Pages with their lines; and either their text, where markup settles every line, or their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                old = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                lines, digests, blocks, texts = [], [], [], []
                for page in old[html]:
                    found = lines_of(page.as_py())
                    lines.append([_line_hash(text) for text, _ in found])
                    digests.append(hashlib.blake2b(b"".join(h.to_bytes(8, "little", signed=True) for h in lines[-1]), digest_size=16).hexdigest())
                    loose = any(state == OPEN for _, state in found)
                    blocks.append([{"line": i, "stays": state == STAYS, "text": text} for i, (text, state) in enumerate(found) if state] if loose else None)
                    texts.append(None if loose else "\n\n".join(text for text, state in found if state))
                new = {"__diff_sig": pa.array(digests, pa.string()), "__diff_lines": pa.array(lines, pa.list_(pa.int64())), "__diff_blocks": pa.array(blocks, BLOCK), "__diff_text": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_arrays([new[f] if f in new else old[f] for f in names], names=names)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([part] * rows, pa.int32()), pa.array(range(n, n + rows), pa.int64()), *batch.columns], names=["part", "n", *batch.schema.names])
        n += rows


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of neighbours a row for either: how much of the path is common, whether the other one comes before,
    and the shared lines."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.int32())]
    for batch in batches:
        for host, path, sig, lines, host2, path2, sig2, lines2 in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            near = len(commonprefix([path, path2]))
            left, right = shared_lines(lines, lines2)
            columns = [host, host2], [sig, sig2], [near, near], [False, True], [left, right]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "sig", "near", "before", "shared"])


def _assembled(names: list[str]):
    """Rows with blocks and shared lines: the text of the blocks that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts, dropped = [], []
            for blocks, shared in zip(old["__diff_blocks"], old["__diff_shared"], strict=True):
                blocks, shared = blocks.as_py(), set(shared.as_py() or ())
                own = [b["text"] for b in blocks if b["stays"] or b["line"] not in shared]
                texts.append("\n\n".join(own))
                dropped.append(len(shared) - sum(b["line"] in shared and b["stays"] for b in blocks))
            new = {"text": pa.array(texts, pa.string()), "n_shared": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[f] if f in new else old[f] for f in names], names=names)

    return run


def main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """pages without html_col, with text (blocks joined by two line ends), n_chars, and n_shared, the number of lines that
    were deleted because the nearest page has them too."""
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars", "n_shared") or c in (html_col, url_col)])
    url = F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    keyed = pages.withColumns({"__diff_host": F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)), "__diff_path": F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)})
    kept = [f for f in keyed.schema.fields if f.name != html_col]
    own = [f for f in kept if not f.name.startswith("__diff_") and f.name not in ("text", "n_chars", "n_shared")]
    schema = T.StructType(kept).add("__diff_sig", "string").add("__diff_lines", T.ArrayType(T.LongType())).add("__diff_blocks", BLOCK_TYPE).add("__diff_text", "string")
    parsed = written(keyed.mapInArrow(_parsed(html_col, schema.names), schema), "pages")
    light = parsed.filter(F.size("__diff_lines") > 0).groupBy(F.col("__diff_host").alias("host"), F.col("__diff_sig").alias("sig"))
    light = light.agg(F.min("__diff_path").alias("path"), F.max(F.col("__diff_blocks").isNotNull()).alias("loose"), F.first("__diff_lines").alias("lines"))
    light = light.select("host", "path", "sig", "loose", "lines")
    order = light.repartitionByRange("host", "path", "sig").sortWithinPartitions("host", "path", "sig")
    order = written(order.mapInArrow(_numbered, "part int, n long, host string, path string, sig string, loose boolean, lines array<long>"), "order")
    sizes = order.groupBy("part").agg(F.count("*").alias("rows"))
    starts = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("start"))  # a row for each partition
    placed = order.join(starts, "part").select((F.col("start") + F.col("n")).alias("g"), "host", "path", "sig", "loose", "lines")
    nexts = placed.select((F.col("g") - 1).alias("g"), *[F.col(c).alias(f"{c}2") for c in ("host", "path", "sig", "loose", "lines")])
    pairs = placed.join(nexts, "g").filter("host = host2 and (loose or loose2)").drop("g", "loose", "loose2").mapInArrow(_differences, "host string, sig string, near int, before boolean, shared array<int>")
    nearest = pairs.groupBy(F.col("host").alias("__diff_host"), F.col("sig").alias("__diff_sig")).agg(F.max(F.struct("near", "before", "shared")).alias("__diff_best"))
    names = [F.col(f"`{f.name}`") for f in own]
    joined = parsed.filter("__diff_blocks is not null").join(nearest, ["__diff_host", "__diff_sig"], "left").select(*names, "__diff_blocks", F.col("__diff_best.shared").alias("__diff_shared"))
    out = T.StructType(own).add("text", "string").add("n_shared", "long")
    settled = parsed.filter("__diff_blocks is null").select(*names, F.col("__diff_text").alias("text"), F.lit(0).cast("long").alias("n_shared"))
    texts = settled.unionByName(joined.mapInArrow(_assembled(out.names), out))
    return texts.select(*names, "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
