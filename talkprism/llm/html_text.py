"""Main text of web pages, with site templates removed.

Pages are parsed in Spark tasks into element trees, and every element of a page, inside articles
and outside, is hashed with its subtree and counted per host in Spark, over pages of different
content. What recurs on many pages of a host is template and is deleted before the main text is
chosen. What is not the article on a page of its own goes by what the page says of it: element
(``nav``, ``aside``, ``footer``, ``form``, scripts), role, hidden state; a container (``div``,
``section``, a list) also by its class or id, where one of them starts with a word of NAMES.
Elements inside a run of text (a bold word) stay with their paragraph. Copies of an article keep
their text: exact copies are one content, and inside articles near copies are mostly one too, as
contents are told apart there by the least hash of their word triples.

A host has at most a page's elements times 1 / MIN_SHARE templates. All templates are counted
before they are joined to the pages: up to BROADCAST_HASHES they are broadcast and pages don't
move; beyond, pages and templates meet by host and a salt, so a hot host is spread over tasks.

Parsing takes time in proportion to the page: each character is read a bounded number of times,
and trees of any depth are walked with an own stack. As in browsers, a slash does not close an
element (but for ``svg`` and ``math``), and a tag that the page's end cuts off is no text.

Defined cases: null or empty html, or a page without main text, gives an empty text; very long
and very deep pages are read whole; null urls share one host; repeated pages count as one
content; an empty table gives an empty result; other columns, whatever their names, are left
alone.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkprism.llm.common import materialize

#: A subtree is template on a host if it recurs on so many pages of different content and on this share of them.
MIN_PAGES = 10
MIN_SHARE = 0.05
#: The share inside articles, where a sentence may be quoted by some pages of a host.
MIN_SHARE_INSIDE = 0.25
#: Hashes of templates that may be broadcast: 8 MB.
BROADCAST_HASHES = 1_000_000
SALTS = 64

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav aside footer form script style textarea title noscript iframe template head button select input svg canvas menu dialog object embed audio video map xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Elements that go where a class or id starts with a word of NAMES; a paragraph or heading never goes for its name.
CONTAINERS = frozenset("div section ul ol dl table details figure center span iframe ins".split())
#: Words that start the class or id of what is not the article.
NAMES = frozenset(
    "ad ads adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommended replies respond sharing sidebar signup skip sponsor sponsored subscribe toolbar widget widgets".split()
)
#: An opening tag of the first kind ends open elements of the second, up to the boundary of its scope.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
_TABLE_PARTS = frozenset("thead tbody tfoot tr td th".split())
_BOUNDARY = frozenset("article aside body div footer header html main nav ol section table td th ul dl form blockquote figure".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: One step inside a tag: spaces and slashes, or an attribute without its value, or with the sign of one.
_STEP = re.compile(r"""[\s/]++|(?:[^\s/>=]|=(?=[^\s>=/]))[^\s/>=]*+(?P<sign>\s*+=\s*+)?+|=""")
_BARE = re.compile(r"[^\s>]*+")
_COMMENT_END = re.compile("--!?>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_FIRST_WORD = re.compile(r"(?<![^\s])[a-z0-9]+")
_TRIPLE = np.uint64(0x9E3779B97F4A7C15)


class Node:
    __slots__ = ("tag", "attributes", "children", "article", "junk", "digest")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.article, self.junk, self.digest = tag in ("article", "main"), False, b""


def _judge(node: Node) -> None:
    """Set junk by element, role, hidden state or, for containers, the first words of class and id."""
    if node.tag in DROPPED:
        node.junk = True
    elif "=" in node.attributes or "hidden" in node.attributes:
        values: dict[str, str] = {}
        for k, v in _ATTRIBUTE.findall(node.attributes):
            values.setdefault(k.lower(), v.strip("\"'").lower())
        role = values.get("role", "")
        node.article = node.article or role == "main"
        style = values.get("style", "").replace(" ", "")
        named = node.tag in CONTAINERS and not NAMES.isdisjoint(_FIRST_WORD.findall(values.get("class", "")) + _FIRST_WORD.findall(values.get("id", "")))
        node.junk = node.tag not in ("html", "body") and (role in ROLES or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style or named)


class _Open:
    """The open elements, with counts by scope, so what a tag closes is found without a walk."""

    def __init__(self, root: Node):
        self.stack, self.tags = [root], Counter()
        self.blocks, self.tables = [Counter()], [Counter()]

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.tags[node.tag] += 1
        if node.tag in _TABLE_PARTS:
            self.tables[-1][node.tag] += 1
        elif node.tag not in _BOUNDARY:
            self.blocks[-1][node.tag] += 1
        if node.tag == "table":
            self.tables.append(Counter())
        if node.tag in _BOUNDARY:
            self.blocks.append(Counter())

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.tags[tag] -= 1
        if tag in _BOUNDARY:
            self.blocks.pop()
        if tag == "table":
            self.tables.pop()
        if tag in _TABLE_PARTS:
            self.tables[-1][tag] -= 1
        elif tag not in _BOUNDARY:
            self.blocks[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """An end tag: all open elements up to the last one of its kind, if there is one."""
        if self.tags[tag]:
            while self.pop() != tag:
                pass

    def before(self, tag: str) -> None:
        """What a start tag ends: parts of its list or table, or a paragraph."""
        kinds = _CLOSES.get(tag) or (("p",) if tag in BLOCKS else ())
        scopes = self.tables if tag in _TABLE_PARTS else self.blocks
        while any(scopes[-1][k] for k in kinds):
            self.pop()


def _tag_end(page: str, at: int, end: int, lost: dict[str, int]) -> tuple[int, bool]:
    """Where the tag whose name ends at ``at`` ends (the place of its >, or -1 if the page ends before), and whether a slash stands before it. ``lost``: quotes known to occur no more."""
    slash = False
    while at < end and page[at] != ">":
        m = _STEP.match(page, at)
        at, slash = m.end(), m[0][-1] == "/" and not m["sign"]
        if not m["sign"] or at >= end:
            continue
        sign = page[at]
        if sign in "\"'" and sign not in lost:
            close = page.find(sign, at + 1)
            if close >= 0:
                at = close + 1
                continue
            lost[sign] = at
        if sign != ">":  # a bare value, or a quote that never ends: up to a space or >
            at = _BARE.match(page, at).end()
    return (at if at < end else -1), slash


def parse(page: str) -> Node:
    """The page as a tree; text is in the children lists, raw as in the page."""
    root = Node("#root")
    opened, at, end = _Open(root), 0, len(page)
    lowered, lost = None, {}
    add = lambda x: opened.stack[-1].children.append(x)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        sign = page[start + 1 : start + 2]
        name = _NAME.match(page, start + 2 if sign == "/" else start + 1)
        if not name and (not sign or sign not in "!?/" or sign == "/" and start + 2 >= end):
            add(page[at : start + 1])  # no tag: the sign itself
            at = start + 1
            continue
        if start > at:
            add(page[at:start])
        if not name:
            if page.startswith("<!--", start):
                m = _COMMENT_END.search(page, start + 2)
                at = m.end() if m else end
            else:
                close = page.find(">", start)
                at = close + 1 if close >= 0 else end
            continue
        tag = name[0].lower()
        close, slash = _tag_end(page, name.end(), end, lost)
        if close < 0:
            break
        at = close + 1
        if sign == "/":
            opened.close(tag)
            continue
        opened.before(tag)
        node = Node(tag, page[name.end() : close].strip())
        _judge(node)
        add(node)
        if tag in RAW:
            lowered = page.lower() if lowered is None else lowered
            if len(lowered) != end:  # a few letters change length in lower case
                lowered = re.sub("[A-Z]", lambda c: c[0].lower(), page)
            stop = lowered.find("</" + tag, at)
            at = end if stop < 0 else stop
        elif tag not in VOID and not (slash and tag in ("svg", "math")):
            opened.push(node)
    return root


def walk(root: Node, into_junk: bool = True) -> Iterator[Node]:
    """``root`` and the elements below it in page order; without what lies in junk if so asked (nor the junk itself)."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and (into_junk or not c.junk))


def _mark_articles(root: Node) -> None:
    """An element that holds an article is not junk for its name."""
    holds: set[int] = set()
    for node in reversed(list(walk(root))):
        inside = any(isinstance(c, Node) and id(c) in holds for c in node.children)
        if inside and node.tag not in DROPPED:
            node.junk = False
        if (inside or node.article) and not node.junk:
            holds.add(id(node))


def main_nodes(root: Node) -> tuple[list[Node], bool]:
    """The elements that hold the main text, and whether they are articles; else the main element, the body or all."""
    _mark_articles(root)
    articles, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == "article":
            articles.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.junk)
    if articles:
        return articles, True
    main = next((n for n in walk(root, into_junk=False) if n.article), None)
    if main:
        return [main], True
    return [next((n for n in walk(root, into_junk=False) if n.tag == "body"), root)], False


def block_text(nodes: list[Node], guarded: bool) -> str:
    blocks: list[list[str]] = [[]]
    for top in nodes:
        blocks.append([])
        stack = [iter(top.children)]
        ends = [True]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                if ends.pop():
                    blocks.append([])
            elif not isinstance(child, Node):
                blocks[-1].append(child)
            elif child.tag == "br":
                blocks[-1].append(" ")
            else:
                block = child.tag in BLOCKS
                if block:
                    blocks.append([])
                if not (child.junk or child.tag == "header" and not guarded):
                    stack.append(iter(child.children))
                    ends.append(block)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(line for line in lines if line)


def hash_subtrees(root: Node) -> None:
    """Set each element's hash from its tag, attributes, text (white space made equal) and the hashes of its elements."""
    for node in reversed(list(walk(root))):
        digest = xxhash.xxh64(f"<{node.tag} {' '.join(node.attributes.split())}>".encode("utf-8", "surrogatepass"), seed=7)
        for child in node.children:
            if isinstance(child, Node):
                digest.update(b"\x01" + child.digest)
            else:
                digest.update(b"\x00" + " ".join(child.split()).encode("utf-8", "surrogatepass") + b"\x00")
        node.digest = digest.digest()


def subtree_hash(node: Node) -> int:
    """Signed 64-bit hash of an element's subtree."""
    return int.from_bytes(node.digest, "big", signed=True)


def _standing(node: Node) -> list[Node]:
    """The child elements that may be template: blocks, and others that stand alone between blocks."""
    own = [c for c in node.children if isinstance(c, Node) or c.strip()]
    block = [isinstance(c, Node) and c.tag in BLOCKS for c in own]
    ends = [True, *block, True]
    return [c for i, c in enumerate(own) if isinstance(c, Node) and c.tag not in VOID and (block[i] or ends[i] and ends[i + 2])]


def subtrees(root: Node, articles: list[Node]) -> dict[int, bool]:
    """Hashes of the subtrees that may be template, and whether each lies inside one of ``articles`` (else it is one or lies outside)."""
    out: dict[int, bool] = {}
    starts = {id(n) for n in articles}
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or id(node) in starts
        for child in _standing(node):
            out[subtree_hash(child)] = inside
        stack.extend((c, inside) for c in node.children if isinstance(c, Node) and not c.junk)
    return out


def prune(root: Node, templates: frozenset[int]) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        gone = {id(c) for c in _standing(node) if subtree_hash(c) in templates}
        # A block that goes still parts the text around it.
        node.children = [Node("hr") if id(c) in gone else c for c in node.children]
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.junk)


def sketch(text: str) -> int:
    """The least hash of the text's word triples: near copies mostly share it, texts with some lines in common seldom do."""
    own = text.encode("utf-8", "surrogatepass").split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in own), dtype=np.uint64, count=len(own))
    if len(hashes) > 2:
        hashes = (hashes[:-2] * _TRIPLE + hashes[1:-1]) * _TRIPLE + hashes[2:]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _TRIPLE
    return int(hashes.min(initial=np.uint64(2**64 - 1))) >> 1


def extract(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    if not page:
        return ""
    root = parse(page)
    if templates:
        _mark_articles(root)
        hash_subtrees(root)
        prune(root, templates)
    return block_text(*main_nodes(root))


def _census(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for host, page in zip(batch["host"], batch["html"], strict=True):
            if not page:
                continue
            root = parse(page)
            nodes, guarded = main_nodes(root)
            hash_subtrees(root)
            text = block_text(nodes, guarded)
            contents = xxhash.xxh64_intdigest(text) >> 1, sketch(text)
            rows += [(host, 0, contents[inside], inside, True) for inside in (False, True)]
            rows += [(host, h, contents[inside], inside, False) for h, inside in subtrees(root, nodes if guarded else []).items()]
        yield pd.DataFrame(rows, columns=["host", "subtree", "content", "inside", "page"])


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [extract(p, frozenset(t) if t is not None else frozenset()) for p, t in zip(batch["html"], batch["templates"], strict=True)]
        yield batch[["page_id", "url"]].assign(text=texts)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_share_inside: float = MIN_SHARE_INSIDE) -> DataFrame:
    """(host, templates): the hashes of subtrees that recur on many pages of the host. ``pages``: host, html."""
    seen = pages.select("host", "html").mapInPandas(_census, "host string, subtree long, content long, inside boolean, page boolean").distinct()
    counts = seen.groupBy("host", "inside", "page", "subtree").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.where(F.col("page") | (F.col("n") >= min_pages)), "subtree-counts")
    totals = counts.where("page").select("host", "inside", F.col("n").alias("total"))
    common = counts.where(~F.col("page")).join(totals, ["host", "inside"]).where(F.col("n") >= F.when(F.col("inside"), min_share_inside).otherwise(min_share) * F.col("total"))
    return common.groupBy("host").agg(F.collect_set("subtree").alias("templates"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(page_id, url, text) of every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    kind = dict(rows.dtypes)["page_id"]
    templates = materialize(site_templates(rows, min_pages, min_share), "templates")
    if (templates.agg(F.sum(F.size("templates") + 1)).first()[0] or 0) <= BROADCAST_HASHES:
        found = rows.join(F.broadcast(templates), "host", "left")
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        found = rows.join(templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), ["host", "salt"], "left")
    found = found.select("page_id", "url", "html", "templates")
    return found.mapInPandas(_extracted, f"page_id {kind}, url string, text string")
