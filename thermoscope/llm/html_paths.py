"""Main-text extraction from web pages with consensus paths per host.

Every page is parsed once to score its containers: a container's score is its
share of the page's text outside boilerplate and links.  From the deepest
container that holds ``DOMINANT`` of it the page climbs as long as an enclosing
container adds such text, and votes for the container it reaches.  The body of
the page counts as enclosing only for text of its own (headings, paragraphs) and
for articles, sections and quotes; other blocks beside the container there are
page furniture.  A vote names the container by its generalised path: tags and
classes from the root, digits removed.

Spark adds up the votes of each host, and a second parse extracts the text.  A
page whose own vote is shared by another page of the host follows it, or the
host's better path around it; any other page follows the host's best path that
it has, climbing there in the same way, and last its own vote.

Left out everywhere: markup, comments in the markup, scripts and styles, forms
and form controls, menus, headers, footers, sidebars, and elements whose class,
id or role says advert, notice, menu, sharing, related links or reader comments.
Character references are decoded, white space inside a block becomes one space,
and blocks are trimmed and joined by one space in page order.

Edge cases: null or empty html gives the empty text; a null or odd url counts as
host ''; a page of text without markup is its own container; broken nesting is
mended by closing elements with their parents; repeated rows give repeated
results; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

DOMINANT = 0.7
PATHS_OF_HOST = 8              # best paths of a host that its pages can follow
BROADCAST_BYTES = 32 << 20     # the table of host paths is broadcast only below this

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# content of these is raw text up to their end tag
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
SKIP = RAW | frozenset("""head nav header footer aside form button select option fieldset label template svg math
canvas object audio video menu dialog datalist""".split())
CONTAINERS = frozenset("body main article section div td center blockquote".split())
CONTENT = frozenset("main article section blockquote".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rt rp s samp
small span strike strong sub sup time tt u var wbr""".split())
# an opening tag of the key closes an open element of the value, up to the nearest container
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("""address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4
h5 h6 header hr main menu nav ol p pre section table ul""".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|sidebar|side-bar|widget|menu|nav|"
    r"navbar|navigation|breadcrumbs?|pagination|pager|masthead|header|footer|copyright|comments?|commentlist|disqus|"
    r"replies|respond)(?=$|[\s_-]|\d)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_DIGITS = re.compile(r"\d+")


class Element:
    __slots__ = ("tag", "path", "skip", "link", "parent", "size", "depth")

    def __init__(self, tag, path, skip, link, parent):
        self.tag, self.path, self.skip, self.link, self.parent = tag, path, skip, link, parent
        self.size = 0
        self.depth = parent.depth + 1 if parent else 0


def _attributes(text: str) -> dict:
    return {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(text)} if text else {}


def events(page: str):
    """Walk a page: yields (element, text) for text and (element, None) for every block boundary.

    Elements know their generalised path, whether they are left out and whether
    they are inside a link.
    """
    top = Element("", "", False, False, None)
    stack, at, n = [top], 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield stack[-1], page[at:]
            return
        if m.start() > at:
            yield stack[-1], page[at:m.start()]
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in CONTAINERS and tag not in CONTAINERS and tag not in SKIP \
                        and tag not in ("html", "body", "table", "ul", "ol"):
                    break
            if tag not in INLINE:
                yield stack[-1], None
            continue
        if tag not in INLINE:
            shut = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut or (stack[k].tag == "p" and tag in CLOSES_P):
                    del stack[k:]
                    break
                if stack[k].tag in CONTAINERS or stack[k].tag in ("table", "ul", "ol", "dl", "button"):
                    break
            yield stack[-1], None
        if tag in VOID or m.group(3).endswith("/") and tag not in CONTAINERS and tag not in RAW:
            continue
        up = stack[-1]
        a = _attributes(m.group(3))
        name = a.get("class", "") or a.get("id", "")
        skip = (up.skip or tag in SKIP or "hidden" in a or a.get("aria-hidden", "") == "true"
                or a.get("role", "").lower() in ROLES
                or (tag not in ("html", "body", "main", "article")
                    and any(BOILERPLATE.search(a[k]) for k in ("class", "id") if a.get(k))))
        label = tag + "".join("." + _DIGITS.sub("", c) for c in sorted(name.split())[:3])
        node = Element(tag, f"{up.path}/{label}" if tag in CONTAINERS else up.path, skip, up.link or tag == "a", up)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(node)


class Layout:
    """One page's events with the size of its own text by exact path; ``up`` has (parent path, tag) of every path."""

    def __init__(self, page: str):
        self.events = list(events(page))
        self.own: dict[str, int] = {}
        self.up: dict[str, tuple[str, str]] = {}
        for node, text in self.events:
            if text is None or node.skip:
                continue
            size = len(html_lib.unescape(text).split()) if not node.link else 0
            if size:
                self.own[node.path] = self.own.get(node.path, 0) + size
            while node.parent is not None:
                if node.tag in CONTAINERS:
                    if node.path in self.up:
                        break
                    self.up[node.path] = node.parent.path, node.tag
                node = node.parent

    def climb(self, path: str) -> str:
        """The highest path around ``path`` that adds text of the page."""
        best = here = path
        while here in self.up:
            parent = self.up[here][0]
            beside = [q for q in self.own if within(q, parent) and not within(q, here)]
            if parent and self.up[parent][1] != "body":
                adds = bool(beside)
            else:
                adds = any(q == parent or q[len(parent) + 1:].split("/")[0].split(".")[0] in CONTENT for q in beside)
            best = parent if adds else best
            here = parent
        return best

    def vote(self) -> str | None:
        """Path of the container reached from the deepest one that holds most of the page's own text."""
        nodes, total = {}, 0
        for node, text in self.events:
            if text is None or node.skip:
                continue
            size = len(html_lib.unescape(text).split()) if not node.link else 0
            if size:
                total += size
                while node is not None:
                    if node.tag in CONTAINERS or node.parent is None:
                        nodes[id(node)] = node
                        node.size += size
                    node = node.parent
        best = None
        for node in nodes.values():
            if node.size >= DOMINANT * total and (best is None or node.depth > best.depth):
                best = node
        return self.climb(best.path) if best else None

    def text(self, path: str) -> str:
        """Text of the elements on a path."""
        found = []
        for node, text in self.events:
            if within(node.path, path):
                if text is None:
                    found.append(" ")
                elif not node.skip:
                    found.append(text)
        return " ".join(html_lib.unescape("".join(found)).split())


def within(path: str, outer: str) -> bool:
    """Whether a path is the outer one or below it: containers extend it by a slash."""
    return outer == "" or path == outer or path.startswith(outer + "/")


def vote(page: str) -> str | None:
    """Path of the container that holds the page's own text."""
    return Layout(page).vote()


def extract(page: str, paths: list[str], votes: list[int]) -> str:
    """Main text of a page by its host's best paths and their votes, and by its own vote."""
    layout = Layout(page)
    own = layout.vote()
    if own in paths:
        shared = votes[paths.index(own)] > 1
    else:   # below the listed paths, so shared by others only if the last of a full list is
        shared = len(paths) == PATHS_OF_HOST and votes[-1] > 1
    tried = [p for p in paths if not shared or own is None or within(own, p)]
    for p in tried + [own]:
        out = layout.text(layout.climb(p)) if p is not None else ""
        if out:
            return out
    return ""


def _votes(batches):
    for batch in batches:
        pages = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([vote(p) if p else None for p in pages], pa.string())], ["host", "path"])


def _texts(batches):
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))
        out = [extract(page, paths or [], votes or []) if page else "" for page, paths, votes in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())],
                                         ["page_id", "url", "text"])


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, paths, votes``: the best voted paths of every host and their votes, best first.

    Votes are counted per (host, path) with map-side sums, so a host with a third
    of all pages sends a few rows per task; the ranking sees one row per path.
    """
    votes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")) \
        .mapInArrow(_votes, "host string, path string").where(F.col("path").isNotNull())
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "path"))
    top = counted.withColumn("r", rank).where(F.col("r") <= PATHS_OF_HOST)
    best = top.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("r", "path", "n"))).alias("best"))
    return best.select("host", F.col("best.path").alias("paths"), F.col("best.n").alias("votes"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text`` of every page."""
    paths = Scratch(pages.sparkSession).write(host_paths(pages, url_col, html_col), "paths")
    size = paths.agg(F.sum(F.length("host") + F.length(F.concat_ws("", "paths")) + 48).alias("b")).first()["b"] or 0
    paths = paths.withColumnRenamed("host", "_host")
    if size < BROADCAST_BYTES:
        paths = F.broadcast(paths)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    joined = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
              .join(paths, host_of(F.col("url")) == F.col("_host"), "left").select("page_id", "url", "html", "paths", "votes"))
    return joined.mapInArrow(_texts, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string") \
        .withColumnsRenamed({"page_id": id_col, "url": url_col})
