"""Main text of web pages: site templates are found by counting subtrees, and removed.

Each page is parsed into a tree, and its elements are hashed with the tags and texts below
them, whatever they are called. The hashes are counted for each host in Spark, and subtrees
that recur on many of the host's pages are template: they go first, with all below them.
Of what is left, elements go that say what they are (navigation, footers, forms, adverts,
comments and the like, by tag, role, class or id), as these need not recur or a host may
have too few pages to tell. An article that a page marks (``article`` or ``main``) is never
template as a whole, and its blocks only if they recur in most of the host's different
articles; single words, headings, cells and items in it are no blocks. Text outside of
articles stays if it is neither.

Parsing takes time in proportion to a page, however broken its markup is.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.session import ship, written

# HTML's elements without an end tag, those whose content is no markup, those
# that end by themselves when another begins, and those within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY_BLOCK = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul".split()
)
SIBLINGS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]), "thead": frozenset(["tbody", "tr", "td", "th"]),
    "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]), "tfoot": frozenset(["tbody", "tr", "td", "th"]),
}
SIBLING_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}

# Elements that are never main text, and words of a class, id or role that say so.
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select textarea input dialog menu iframe object "
    "embed svg canvas audio video map title noembed noframes".split()
)
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner banners sponsor sponsored sponsors promo promos "
    "promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer header masthead "
    "topbar toolbar sidebar sidebars aside rail cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations widget "
    "widgets complementary contentinfo search "
    "search-form skip hidden".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
# How surely an element is no main text: by its tag or as comments, or by another word.
SURE, HINTED = 2, 1
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())
ARTICLE = frozenset(["article", "main"])
# Blocks that recur in articles without being template: headings, cells and items.
PARTS_OF_TEXT = frozenset("h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption figcaption legend option header".split())
# Keeps the hashes of blocks in articles apart from those outside.
IN_ARTICLE = 0x5BD1E995
TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)",
    re.S,
)
SPECIAL = re.compile(r"[>\"']")
HINTS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true)", re.I)
SPACES = re.compile(r"\s+")


# Parts into which a host's pages are dealt.
HOST_PARTS = 64


class Node:
    __slots__ = ("tag", "parent", "children", "dropped")

    def __init__(self, tag: str, parent: Node | None, dropped: int = 0):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []


def _says_dropped(tag: str, attributes: str) -> int:
    if tag in DROPPED:
        return SURE
    if not attributes or tag in ("html", "body"):
        return 0
    level = HINTED if HIDDEN.search(attributes) else 0
    for name, *values in HINTS.findall(attributes):
        value = "".join(values).lower()
        if name.lower() == "role" and value in DROPPED_ROLES:
            level = HINTED
        for word in value.split():
            parts = {word, *re.split(r"[-_]+", word)}
            if not parts.isdisjoint(COMMENT_WORDS):
                return SURE
            if not parts.isdisjoint(DROPPED_WORDS):
                level = HINTED
    return 0 if tag in ARTICLE else level


class TagEnds:
    """Where a tag ends: at the first ``>`` that is in no quotes.

    The places of quotes and ends are listed once. Where the search has once come to a quote
    without an end, it is not made again, so all tags of a page take time in proportion to it.
    """

    def __init__(self, source: str):
        self.size = len(source)
        self.places = [m.start() for m in SPECIAL.finditer(source)]
        self.letters = [source[p] for p in self.places]
        last: dict[str, int] = {}
        self.partner = [0] * len(self.places)  # the next one of the same kind
        for i in range(len(self.places) - 1, -1, -1):
            self.partner[i] = last.get(self.letters[i], -1)
            last[self.letters[i]] = i
        self.failed: set[int] = set()

    def after(self, at: int) -> int:
        """The place after the end of the tag whose attributes begin at ``at``; -1 if quotes don't end."""
        i, seen = bisect_left(self.places, at), []
        while i < len(self.places):
            if self.letters[i] == ">":
                return self.places[i] + 1
            seen.append(i)
            if i in self.failed or self.partner[i] < 0:
                self.failed.update(seen)
                return -1
            i = self.partner[i] + 1
        return self.size


class Open:
    """The open elements, and at which depths those of each tag are."""

    def __init__(self, root: Node):
        self.stack, self.depths = [root], {}

    def deepest(self, tags) -> int:
        """The depth of the innermost open element among ``tags``, or 0."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        """Close the element at that depth and all in it."""
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()


P_SCOPE = ("article", "main", "section", "div", "td", "li", "body", "table", "blockquote", "button")


def parse(source: str) -> Node:
    """The page as a tree of elements and raw texts, however its tags are nested."""
    root = Node("", None)
    open_, ends = Open(root), TagEnds(source)
    at = begun = 0  # where to look for a tag, and where the text before it begins
    n = len(source)
    while at < n:
        token = TOKENS.search(source, at)
        if token is None:
            break
        tag, after = token[2], token.end()
        if tag is not None and (after := ends.after(after)) < 0:
            at = token.start() + 1  # no tag after all
            continue
        if token.start() > begun:
            open_.stack[-1].children.append(source[begun : token.start()])
        begun = at = after
        if tag is None:
            if source.startswith("<![CDATA[", token.start()):
                open_.stack[-1].children.append(html.escape(source[token.start() + 9 : at].removesuffix("]]>")))
            continue
        tag, attributes = tag.lower(), source[token.end() : at].removesuffix(">")
        if token[1]:
            if depth := open_.deepest((tag,)):
                open_.close(depth)
            elif tag == "p":
                open_.stack[-1].children.append(Node("p", open_.stack[-1]))
            continue
        # Elements that end by themselves here, if nothing in between holds them open.
        closed, scope = (("p",), P_SCOPE) if tag in CLOSED_BY_BLOCK else (SIBLINGS.get(tag, ()), SIBLING_SCOPE.get(tag, ("table",)))
        if closed and (depth := open_.deepest(closed)) > open_.deepest(scope):
            open_.close(depth)
        node = Node(tag, open_.stack[-1], _says_dropped(tag, attributes))
        open_.stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag in ("path", "use", "circle", "rect", "line"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else n])
            begun = at = end.end() if end else n
            continue
        open_.push(node)
    if begun < n:
        open_.stack[-1].children.append(source[begun:])
    return root


def whole_hash(root: Node) -> int | None:
    """A hash of all tags and texts below an element; null if it holds no text."""
    parts, texts, stack = [], False, [root]
    while stack:
        item = stack.pop()
        if isinstance(item, Node):
            parts.append(b"<" + item.tag.encode("utf-8", "replace"))
            stack.append(None)
            stack.extend(reversed(item.children))
        elif item is None:
            parts.append(b">")
        elif word := SPACES.sub(" ", item).strip():
            parts.append(word.encode("utf-8", "replace"))
            texts = True
    return xxhash.xxh3_64_intdigest(b"\0".join(parts)) - (1 << 63) if texts else None


def subtree_hashes(root: Node) -> tuple[list[tuple[Node, int, int | None, int]], list[tuple[int, int]]]:
    """What can be template, ``(node, hash, article, bytes)``, and the articles, ``(hash, bytes)``.

    Outside of articles these are all elements that hold text and no article, and article
    is null. In an article (the nearest one counts) they are blocks, and bytes is the text
    of a block that is in no smaller one. Elements that say that they are no main text
    are hashed as a whole, wherever they are, and left out of what holds them.
    """
    digests: dict[int, bytes] = {}
    holders: set[int] = set()
    left: dict[int, int] = {}
    found: list[tuple[Node, int, int | None, int]] = []
    articles: list[tuple[int, int]] = []
    inside: list[list[tuple[Node, int, int]]] = []
    stack: list[tuple[Node, bool]] = [(root, True)]
    while stack:
        node, entering = stack.pop()
        if entering:
            if node.tag in ARTICLE:
                inside.append([])
            stack.append((node, False))
            for child in reversed(node.children):
                if not isinstance(child, Node):
                    continue
                if not child.dropped:
                    stack.append((child, True))
                elif (number := whole_hash(child)) is not None:
                    found.append((child, number, None, 0))
            continue
        parts, size, holds = [node.tag.encode("utf-8", "replace")], 0, False
        for child in node.children:
            if isinstance(child, Node):
                if child.dropped:
                    continue
                if digest := digests.pop(id(child)):
                    parts.append(digest)
                size += left.pop(id(child))
                holds |= id(child) in holders
            elif word := SPACES.sub(" ", child).strip():
                parts.append(word.encode("utf-8", "replace"))
                size += len(parts[-1])
        if len(parts) == 1:
            digests[id(node)] = b""
        else:
            digests[id(node)] = xxhash.xxh3_64_digest(b"\0".join(parts))
        number = int.from_bytes(digests[id(node)], "little", signed=True)
        left[id(node)] = size
        if node.tag in ARTICLE:
            units = inside.pop()
            articles.append((number, size + sum(n for _, _, n in units)))
            found += [(unit, digest, number, n) for unit, digest, n in units]
            holders.add(id(node))
            left[id(node)] = 0
        elif holds:
            holders.add(id(node))
        elif len(parts) > 1 and inside:
            if node.tag not in INLINE and node.tag not in PARTS_OF_TEXT:
                inside[-1].append((node, number ^ IN_ARTICLE, size))
                left[id(node)] = 0
        elif len(parts) > 1 and node.tag not in ("", "html", "body", "head"):
            found.append((node, number, None, 0))
    return found, articles


def _articles(root: Node) -> list[Node]:
    """The outermost marked articles; what holds one isn't dropped for a mere word."""
    marked: dict[str, list[Node]] = {"article": [], "main": []}
    # An element, and which of both kinds it is in already.
    stack: list[tuple[Node, frozenset]] = [(root, frozenset())]
    while stack:
        node, within = stack.pop()
        if node.dropped >= SURE:
            continue
        if node.tag in ARTICLE:
            if node.tag not in within:
                marked[node.tag].append(node)
            within = within | {node.tag}
        stack.extend((c, within) for c in reversed(node.children) if isinstance(c, Node))
    found = marked["article"] or marked["main"]
    kept: set[int] = set()
    for node in found:
        up = node.parent
        while up is not None and id(up) not in kept:
            kept.add(id(up))
            up.dropped = 0
            up = up.parent
    return found


class Extracted(NamedTuple):
    """The main text, and how many elements went by count and by what they say."""

    text: str
    by_count: int = 0
    by_hint: int = 0


def main_text(root: Node, template: set[int], outside: bool = False) -> Extracted:
    """Text of the blocks that are left, decoded, white space collapsed, joined by a space.

    Of marked articles only, if there are any, or with what is left ``outside`` of them.
    """
    articles = _articles(root)
    marked = {id(n) for n in articles}
    gone = {id(n) for n, digest, _, _ in subtree_hashes(root)[0] if digest in template} if template else set()
    blocks: list[str] = []
    line: list[str] = []
    counted = hinted = 0

    def end_block() -> None:
        block = SPACES.sub(" ", html.unescape("".join(line))).strip()
        line.clear()
        if block:
            blocks.append(block)

    for top in [root] if outside else articles or [root]:
        # What is left to read, and whether it is in an article.
        stack: list[tuple[Node | str | None, bool]] = [(None, False), (top, False)]
        while stack:
            item, inside = stack.pop()
            if item is None:
                end_block()
            elif isinstance(item, str):
                line.append(item)
            elif item is not top and id(item) in gone:
                counted += 1
                end_block()
            elif item is not top and (item.dropped or item.tag == "header" and not inside):
                # A header outside of an article is the site's.
                hinted += 1
                end_block()
            else:
                if item.tag not in INLINE:
                    end_block()
                    stack.append((None, False))
                inside = inside or id(item) in marked
                stack.extend((c, inside) for c in reversed(item.children))
    return Extracted(" ".join(blocks), counted, hinted)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)), F.lit(""))


SEEN_ROWS = "host string, article long, digest long, n long, whole long"


def templates(pages: DataFrame, least_pages: int, share: float, article_share: float) -> DataFrame:
    """``(host, digest)`` of subtrees on ``least_pages`` pages of a host and ``share`` of all of them.

    For blocks in articles it is ``article_share`` of the articles.

    ``pages`` has host and html. A page's subtrees are counted within its task first. Blocks
    in articles are counted by distinct articles instead of pages, so that copies of a page
    count once. An article of which more than half recurs is a near copy of others and
    doesn't count, or the paragraphs of near copies would be template.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            units: dict[tuple[str, int, int | None], list[int]] = {}
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                root = parse(source)
                _articles(root)
                found, articles = subtree_hashes(root)
                whole = dict(articles)
                for article, size in articles:
                    units[host, article, None] = [0, size]
                on_page: dict[tuple[int, int], int] = {}
                for _, digest, article, size in found:
                    if article is not None:
                        on_page[article, digest] = on_page.get((article, digest), 0) + size
                for (article, digest), size in on_page.items():
                    units[host, article, digest] = [size, whole[article]]
                for digest in {d for _, d, article, _ in found if article is None}:
                    counts[host, digest] = counts.get((host, digest), 0) + 1
            rows = [(h, None, d, n, None) for (h, d), n in counts.items()]
            rows += [(h, a, d, *n) for (h, a, d), n in units.items()]
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                names = ["host", "article", "digest", "n", "whole"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    seen = written(pages.filter("html is not null").mapInArrow(scan, SEEN_ROWS), "subtrees")

    def often(counted: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
        many = F.greatest(F.lit(least_pages), F.ceil(F.col("all") * share))
        return counted.join(sizes, "host").filter(F.col("times") >= many).select("host", "digest")

    outside = seen.filter("article is null").groupBy("host", "digest").agg(F.sum("n").alias("times"))
    sites = often(outside, pages.groupBy("host").agg(F.count("*").alias("all")), share)

    # Most blocks are found too seldom; they are left out by a hash, before articles are told apart.
    inside = seen.filter("article is not null").withColumn("key", F.xxhash64("host", "digest"))
    likely = inside.filter("digest is not null").groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least_pages)
    blocks = inside.join(likely, "key", "left_semi").unionByName(inside.filter("digest is null")).drop("key")
    units = written(blocks.groupBy("host", "article", "digest").agg(F.max("n").alias("n"), F.max("whole").alias("whole")), "units")

    def in_articles(units: DataFrame) -> DataFrame:
        times = units.filter("digest is not null").groupBy("host", "digest").agg(F.count("*").alias("times"))
        return often(times, units.filter("digest is null").groupBy("host").agg(F.count("*").alias("all")), article_share)

    recurring = units.join(in_articles(units), ["host", "digest"]).groupBy("host", "article")
    copies = recurring.agg((2 * F.sum("n") > F.max("whole")).alias("copy")).filter("copy").select("host", "article")
    return sites.union(in_articles(units.join(copies, ["host", "article"], "left_anti")))


def extract(
    pages: DataFrame, least_pages: int = 5, share: float = 0.1, article_share: float = 0.5, url: str = "url", source: str = "html"
) -> DataFrame:
    """``pages`` with ``main_text`` in place of ``html``; empty where there is none.

    ``by_count`` and ``by_hint`` tell how many elements went as template and by what they
    say. One row for each row of ``pages``, in any order, with all other columns; columns
    of these names are replaced. Null html is empty, and a null url has an empty host,
    whose pages are one site. Repeated rows are pages of their own, but their articles
    are one article. Text is never cut, and what is outside of articles stays too.
    """
    ship(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (source, "main_text", "by_count", "by_hint")]
    rows = pages.withColumn("_host", host_of(F.col(url))).withColumn("_html", F.col(source))
    found = templates(rows.select(F.col("_host").alias("host"), F.col("_html").alias("html")), least_pages, share, article_share)
    # A subtree is on a share of the pages at least, so a host's list holds no more than
    # the subtrees of a few pages, however many pages it has.
    lists = found.groupBy("host").agg(F.collect_set("digest").alias("_template")).withColumnRenamed("host", "_host")
    # Copies of the lists let the pages of a large host be dealt over as many tasks.
    salt = F.pmod(F.xxhash64("_html"), F.lit(HOST_PARTS)).cast("int")
    rows = rows.withColumn("_part", salt)
    lists = lists.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))))
    schema = rows.select(*kept).schema.add("main_text", "string").add("by_count", "integer").add("by_hint", "integer")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, template = batch.column("_html").to_pylist(), batch.column("_template").to_pylist()
            found = [main_text(parse(h or ""), set(t or ()), outside=True) for h, t in zip(sources, template)]
            made = [pa.array(values, kind) for values, kind in zip(zip(*found), (pa.string(), pa.int32(), pa.int32()))] if found else []
            if made:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=schema.names)

    return rows.join(lists, ["_host", "_part"], "left").select(*kept, "_html", "_template").mapInArrow(cut, schema)
