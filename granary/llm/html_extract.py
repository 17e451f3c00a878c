"""Main text of web pages: what a site repeats on many pages goes first, what tags and words name as no article after it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialize

#: A subtree is a template's if it is on so many different pages of its host, however many pages the host has.
MIN_PAGES = 5
#: Hashes of templates that are sent to every task, 8 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: An end tag is implied over so many open elements at most, and after so many tags without an end quotes no longer count.
REACH, BROKEN = 256, 8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Never part of an article, whatever they hold, and those that aren't unless they hold the heading or most of the text.
DROPPED = RAW | frozenset("head nav footer aside button select template svg math object canvas audio video dialog menu".split())
GUARDED = frozenset("form header".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements and void ones that stand in running text without ending a block.
FLOWING = INLINE | RAW | (VOID - {"hr"}) | frozenset("button select option template svg math object canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text: never taken for a template by themselves.
TEXTUAL = HEADINGS | frozenset("p pre blockquote figure figcaption li dd dt td th tr tbody thead".split())
ENDS_P = HEADINGS | frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form header hr main menu nav ol p pre section table ul".split())
#: What an open element is closed by, and what keeps it open.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words in class and id that name what is not the article, if all other words of the name are plain ones.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup share sharing social related recommended comment comments commentlist respond reply replies disqus widget toolbar pagination pager".split()
)
PLAIN = frozenset("area articles bar block bottom box buttons class container content group id inner item items js left links list main message outer page panel policy posts primary right row secondary section site slot stories text thread title top unit wrap wrapper".split())

ATTRIBUTE = re.compile(r"""(?<![^\s/"'])([^\s=/"']++)\s*+=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NAME = re.compile(r"/?([a-zA-Z][^\s/<>]*)")
PLAIN_END = re.compile(r"[>\"']")


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _named(attributes: str) -> bool:
    """Whether role, class or id name something else than the article."""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(a or b or c)
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in WORDS.findall(one)}
                if words & MARKS and words <= MARKS | PLAIN:
                    return True
    return False


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)


def tokens(html: str) -> Iterator[tuple[str, str, bool]]:
    """(tag, attributes, is an end tag) of each tag and ("", text, False) of each text; what raw elements hold is passed over.

    A ">" in quotes doesn't end a tag, unless the quotes leave none to end it. Linear in the page, however broken.
    """
    pos, end, broken = 0, len(html), 0
    last = html.rfind(">")  # there are no tags after it
    unclosed: set[str] = set()
    while pos < end:
        if html[pos] != "<":
            stop = html.find("<", pos)
            stop = end if stop < 0 else stop
            yield "", html[pos:stop], False
            pos = stop
            continue
        if html.startswith(("<!", "<?"), pos):
            stop = html.find("-->", pos + 4) + 2 if html.startswith("<!--", pos) else html.find(">", pos)
            pos = stop + 1 if stop > pos else end
            continue
        if pos > last:
            yield "", html[pos:], False
            return
        m = NAME.match(html, pos + 1)
        stop = -1
        if m:
            at = m.end()
            while broken < BROKEN and (q := PLAIN_END.search(html, at)):
                if q[0] == ">":
                    stop = q.start()
                    break
                at = q.end()
                if q[0] not in unclosed:
                    closing = html.find(q[0], at)
                    if closing < 0:
                        unclosed.add(q[0])
                    else:
                        at = closing + 1
            if stop < 0:
                broken += 1
                stop = html.find(">", m.end())
        if stop < 0:
            yield "", "<", False
            pos += 1
            continue
        tag, closes = m[1].lower(), html[pos + 1] == "/"
        yield tag, html[m.end() : stop], closes
        pos = stop + 1
        if tag in RAW and not closes:
            found = _end_of(tag).search(html, pos)
            pos = found.end() if found else end


class Page:
    """Elements of a page in order, each after its parent, and blocks of text as pieces with the element each is in.

    Everything is linear in the page: what holds for an element's inside is handed down from parent to child.
    """

    def __init__(self, html: str):
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.named: list[bool] = []
        self.hashes: list[int] = []
        #: Pieces (element, text) of each block.
        self.blocks: list[list[tuple[int, str]]] = []
        self._read(html)
        self._weigh()

    def _read(self, html: str) -> None:
        tags, stack = self.tags, []
        parts: list[list[str]] = []  # what each open element's hash is made of
        text: list[tuple[int, str]] = []
        opened: dict[str, int] = {}

        def finish() -> None:
            nonlocal text
            if text:
                self.blocks.append(text)
                text = []

        def close(depth: int) -> None:
            while len(stack) > depth:
                e = stack.pop()
                opened[tags[e]] -= 1
                if tags[e] not in FLOWING:
                    finish()
                h = xxhash.xxh64_intdigest("\x1f".join([tags[e], *parts.pop()]))
                self.hashes[e] = h
                if parts:
                    parts[-1].append(f"{h:x}")

        for tag, value, closes in tokens(html):
            here = stack[-1] if stack else -1
            if not tag:
                piece = unescape(value) if "&" in value else value
                text.append((here, piece))
                if parts and (squeezed := " ".join(piece.split())):
                    parts[-1].append(squeezed)
            elif tag == "br":
                text.append((here, " "))
            elif closes:
                if opened.get(tag):
                    depth = len(stack) - 1
                    while tags[stack[depth]] != tag:
                        depth -= 1
                    close(depth)
                elif tag == "p":
                    finish()
            else:
                if tag not in FLOWING:
                    finish()
                if tag in VOID:
                    continue
                least = max(0, len(stack) - REACH)
                if tag in ENDS_P and opened.get("p"):
                    for depth in range(len(stack) - 1, least - 1, -1):
                        if (name := tags[stack[depth]]) == "p":
                            close(depth)
                            break
                        if name not in FLOWING:
                            break
                if tag in CLOSES and any(opened.get(x) for x in CLOSES[tag][0]):
                    ending, holding = CLOSES[tag]
                    lowest = None
                    for depth in range(len(stack) - 1, least - 1, -1):
                        name = tags[stack[depth]]
                        if name in holding:
                            break
                        if name in ending:
                            lowest = depth
                    if lowest is not None:
                        close(lowest)
                tags.append(tag)
                self.parents.append(stack[-1] if stack else -1)
                self.named.append(bool(value) and tag not in ("html", "body", "article", "main") and _named(value))
                self.hashes.append(0)
                if tag not in RAW:
                    stack.append(len(tags) - 1)
                    parts.append([])
                    opened[tag] = opened.get(tag, 0) + 1
        close(0)
        finish()

    def _weigh(self) -> None:
        """holds: the heading or an article. guarded: that or most of the text. outside: in what is never part of an article."""
        n = len(self.tags)
        self.outside, size, holds = [False] * n, [0] * n, [t in ("h1", "article", "main") for t in self.tags]
        for e, (tag, up) in enumerate(zip(self.tags, self.parents, strict=True)):
            self.outside[e] = tag in DROPPED or (up >= 0 and self.outside[up])
        for block in self.blocks:
            for e, piece in block:
                if e >= 0 and not self.outside[e]:
                    size[e] += len(piece) - piece.count(" ")
        for e in range(n - 1, 0, -1):
            if (up := self.parents[e]) >= 0:
                size[up] += size[e]
                holds[up] = holds[up] or holds[e] and not self.outside[e]
        most = sum(x for x, up in zip(size, self.parents, strict=True) if up < 0) / 2
        self.holds = holds
        self.guarded = [h or x > most for h, x in zip(holds, size, strict=True)]

    def containers(self) -> list[int]:
        """Elements that can be a template's: no running text, and without the heading or an article in them."""
        return [e for e, t in enumerate(self.tags) if t not in FLOWING and t not in TEXTUAL and t not in ("html", "head", "body") and not self.holds[e]]

    def text(self, gone: set[int] | frozenset[int] = frozenset()) -> str:
        """The blocks of the main part, joined by two newlines, without the elements in `gone`.

        The main part is the articles, else the main element, else the body, without what tags, roles, classes and ids
        name as something else, unless that holds the heading or most of the text; of a header in an article or main
        element only headings stay.
        """
        tags = self.tags
        root: list[str] = []  # the article or main element that each is in
        kept: list[bool] = []
        header: list[bool] = []
        heading: list[bool] = []
        for e, (tag, up) in enumerate(zip(tags, self.parents, strict=True)):
            above = root[up] if up >= 0 else ""
            root.append("article" if tag == "article" or above == "article" else "main" if tag == "main" or above == "main" else "")
            unwanted = self.outside[e] or e in gone or not self.guarded[e] and (self.named[e] or tag in GUARDED and tag != "header")
            kept.append(not unwanted and (up < 0 or kept[up]))
            header.append(tag == "header" or up >= 0 and header[up])
            heading.append(tag in HEADINGS or up >= 0 and heading[up])
        found: dict[str, list[str]] = {"article": [], "main": [], "": []}
        for block in self.blocks:
            pieces: dict[str, list[str]] = {}
            for e, piece in block:
                where = root[e] if e >= 0 else ""
                if e < 0 or kept[e] and (not header[e] or where and heading[e]):
                    pieces.setdefault(where, []).append(piece)
            for where, several in pieces.items():
                if joined := " ".join("".join(several).split()):
                    found[where].append(joined)
        return "\n\n".join(found["article"] or found["main"] or found[""])


def template_keys(host: str | None, page: Page) -> list[tuple[int, int]]:
    """(element, hash of its subtree and the host, signed) for each element that can be a template's."""
    seed = xxhash.xxh64_intdigest(host or "")
    out = []
    for e in page.containers():
        h = xxhash.xxh64_intdigest(page.hashes[e].to_bytes(8, "little"), seed)
        out.append((e, h - (1 << 64 if h >> 63 else 0)))
    return out


def main_text(html: str | None, host: str | None = None, templates: set[int] | frozenset[int] = frozenset()) -> str:
    """The main text without the subtrees whose keys are in `templates`."""
    if not html:
        return ""
    page = Page(html)
    return page.text({e for e, key in template_keys(host, page) if key in templates} if templates else frozenset())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, key, body): the keys of a page's subtrees, with hashes of the page and of its text."""
    for batch in batches:
        rows, keys, bodies = [], [], []
        for row, host, html in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "html")), strict=True):
            page = Page(html or "")
            if found := {key for _, key in template_keys(host, page)}:
                rows += [row] * len(found)
                keys += sorted(found)
                bodies += [xxhash.xxh64_intdigest(page.text()) >> 1] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows, keys, bodies)], ["row", "key", "body"])


def _extract(templates: np.ndarray | None):
    """Main texts; templates: sorted keys of all of them, or None where each row brings its own in `gone`."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frozenset(templates.tolist()) if templates is not None else None
        for batch in batches:
            gone = batch.column("gone").to_pylist() if known is None else [known] * batch.num_rows
            texts = [main_text(html, host, frozenset(g or ())) for host, html, g in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), gone, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return extract


def recurring(pages: DataFrame, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """(row, key, body) of all containers of pages (row, host, html), and (key) of those on min_pages different pages of a host."""
    found = materialize(pages.mapInArrow(_count, "row long, key long, body long"))
    often = found.select("key", "body").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return found, materialize(often.select("key"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    Every container's subtree is hashed with its host and counted; one on at least min_pages pages of its host is
    removed, be it a small share of them: templates of a section or a language are on few of a large host's pages.
    Pages of equal main text count as one, so copies of a page don't remove its text. Paragraphs, headings and list
    items are never a template's by themselves, nor is what holds the heading or an article.
    Tags, roles, classes and ids decide about what is left, as on hosts of few pages. Pages whose url has no host count
    as one host. A null html gives the empty text; rows that repeat a page_id, or have none, are extracted each. Broken
    and deeply nested pages take linear time; an end tag is implied over at most REACH open elements. Other columns are
    ignored.

    The pages are read twice and not shuffled where the templates are few enough to be sent to every task; beyond
    `broadcast` of them those of each page are joined to it.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host_of("url"))
    rows = rows.withColumn("row", F.xxhash64("host", "html"))
    found, often = recurring(rows.select("row", "host", "html"), min_pages)
    schema = "page_id long, url string, text string, n_chars long"
    if often.count() <= broadcast:
        keys = np.sort(np.array([r.key for r in often.collect()], np.int64))
        return rows.select("page_id", "url", "host", "html").mapInArrow(_extract(keys), schema)
    gone = found.select("row", "key").distinct().join(often, "key").groupBy("row").agg(F.collect_list("key").alias("gone"))
    return rows.join(gone, "row", "left").select("page_id", "url", "host", "html", "gone").mapInArrow(_extract(None), schema)
