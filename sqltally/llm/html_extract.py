"""Main text of web pages by wrapper induction.

Pages of one host come from few templates.  Every page is parsed into a tree of blocks; runs of
equal siblings are one node.  A host's pages fall into types by the outline of their trees; the most
frequent tree of a type is its pivot, and the trees of its pages are aligned to it by simple tree
matching.  Nodes whose texts repeat from page to page are template, nodes whose text varies are slots; the
region that holds most of the varying text is the content.  A page keeps its blocks in that region that are
neither template nor marked as menus, adverts, notices, forms or comments.

Pages with the same longest text count once, so reposts of one body do not make the body a template.  Names
never mark an article, a main element, or anything that holds one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqltally.functions.skew import salted_join
from sqltally.llm.common import cut_lineage

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rb rt rp".split())
#: Their whole content is no text.
HIDDEN = frozenset("script style noscript template iframe svg math object select textarea button head title".split())
RAW = frozenset("script style noscript iframe textarea title".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div main aside nav form".split())
#: Elements and name parts that mark what is no article text.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog header".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices alert comment comments reply replies disqus sidebar side menu nav navigation navbar breadcrumb breadcrumbs footer header share sharing social related recommended subscribe newsletter popup modal widget widgets login signup search pagination pager toolbar".split()
)
#: Other parts of a name that is made of several, such as ``site-footer``.
NEUTRAL_NAMES = frozenset("area bar block bottom box container entry global inner item items left link links list main page panel primary right row secondary section site thread top wrap wrapper".split())
CONTENT_TAGS = ("article", "main")
#: A node is template if this share of its pages have a text that this many pages have there, or a text of a host's pages wherever it stands.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 4
#: Levels of a tree that make the outline of a page type.
OUTLINE_LEVELS = 4
#: Wrappers up to this many bytes are broadcast.
BROADCAST_BYTES = 32 << 20
#: A child that holds this share of a region's varying text is the region.
REGION_SHARE = 0.6


class Node:
    __slots__ = ("name", "tag", "boiler", "children")

    def __init__(self, tag: str, name: str, boiler: bool):
        self.tag, self.name, self.boiler, self.children = tag, name, boiler, []


def marks(name: str) -> bool:
    """Whether a class, id or role names what is no article text: a listed word, or one with neutral words only."""
    if name in BOILERPLATE_NAMES:
        return True
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    return not BOILERPLATE_NAMES.isdisjoint(parts) and all(p in BOILERPLATE_NAMES or p in NEUTRAL_NAMES for p in parts)


@lru_cache(maxsize=4096)
def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """Name of an element in a signature, and whether its tag or its names mark it."""
    name, marked = tag, tag in BOILERPLATE_TAGS
    if "=" in attributes:
        words = {w for m in ATTRIBUTE.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split()}
        marked = marked or any(map(marks, words))
        name = ".".join([tag, *sorted({p for w in words for p in re.split(r"[^a-z]+", w) if p})])
    # a mark travels in the name, so that a tree's signature tells it
    protected = tag in CONTENT_TAGS or tag in ("html", "body")
    return (name, False) if protected else (name + "!" * marked, marked)


def _opened(tag: str, attributes: str, stack: list[Node]) -> Node:
    name, marked = _named(tag, attributes)
    if marked and tag == "header" and any(n.tag in CONTENT_TAGS for n in stack):
        name, marked = name.rstrip("!"), False  # the heading of an article
    if tag in CONTENT_TAGS:
        for n in stack:  # what holds an article is no boilerplate
            n.name, n.boiler = n.name.rstrip("!"), False
    return Node(tag, name, marked)


def parse(html: str) -> Node:
    """Tree of block elements with their text pieces in place; inline tags only join text.

    Children are Nodes, or (text, inside a link) pieces; a piece of None is white space.
    """
    root = Node("html", "html", False)
    stack, at, linked = [root], 0, 0
    size = len(html)
    while at < size:
        m = TAG.search(html, at)
        start = m.start() if m else size
        if start > at:
            stack[-1].children.append((html[at:start], linked > 0))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                linked = max(0, linked - 1)
            elif tag not in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        linked = 0
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in ("br", "hr", "wbr") or tag in VOID:
            stack[-1].children.append((" ", False))
            continue
        if tag == "a":
            linked += 1
            continue
        if tag in INLINE or tag in ("html",):
            continue
        linked = 0
        closing = SAME.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closing or (stack[k].tag == "p" and tag in CLOSES_P):
                del stack[k:]
                break
            if stack[k].tag in SCOPES:
                break
        node = _opened(tag, m[3] or "", stack)
        stack[-1].children.append(node)
        if not (m[3] or "").endswith("/"):
            stack.append(node)
    return root


def blocks_of(root: Node) -> tuple[str, list[tuple[int, bool, str, int]]]:
    """Signature of the page's tree, and its blocks in order: (tree node, boilerplate, text, link characters).

    Sibling runs of one signature are one tree node; nodes are numbered in the order of the signature.
    """
    # bottom up: signature of every node, with runs of equal siblings joined
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    signature: dict[int, str] = {}
    for node in reversed(order):
        parts: list[str] = []
        for c in node.children:
            if isinstance(c, Node) and c.tag not in HIDDEN and (not parts or parts[-1] != signature[id(c)]):
                parts.append(signature[id(c)])
        signature[id(node)] = f"{node.name}({' '.join(parts)})" if parts else node.name
    blocks: list[tuple[int, bool, str, int]] = []
    number = 0

    def close(at: int, boiler: bool, pieces: list[tuple[str, bool]]) -> None:
        text = SPACE.sub(" ", unescape("".join(p for p, _ in pieces))).strip()
        if text:
            blocks.append((at, boiler, text, sum(len(p) for p, linked in pieces if linked)))
        pieces.clear()

    def size(text: str) -> int:
        return text.count("(") + text.count(" ") + 1

    # top down with an explicit stack of (node, number, boilerplate, child iterator, pieces, next number, last signature)
    frames = [[root, number, root.boiler, iter(root.children), [], number + 1, None, number + 1]]
    while frames:
        frame = frames[-1]
        for c in frame[3]:
            if not isinstance(c, Node):
                frame[4].append(c)
                continue
            if c.tag in HIDDEN:
                continue
            close(frame[1], frame[2], frame[4])
            own = signature[id(c)]
            if own != frame[6]:
                frame[6], frame[7] = own, frame[5]
                frame[5] += size(own)
            frames.append([c, frame[7], frame[2] or c.boiler, iter(c.children), [], frame[7] + 1, None, frame[7] + 1])
            break
        else:
            close(frame[1], frame[2], frame[4])
            frames.pop()
    return signature[id(root)], blocks


@lru_cache(maxsize=2048)
def tree(signature: str) -> tuple[tuple[str, ...], tuple[int, ...], tuple[tuple[int, ...], ...]]:
    """Names, parents and children of the nodes of a signature, numbered in its order."""
    names, parents, kids, at = [], [], [], []
    for name, mark in re.findall(r"([^() ]+)|([()])", signature):
        if name:
            parents.append(at[-1] if at else -1)
            if at:
                kids[at[-1]].append(len(names))
            names.append(name)
            kids.append([])
        elif mark == "(":
            at.append(len(names) - 1)
        else:
            at.pop()
    return tuple(names), tuple(parents), tuple(map(tuple, kids))


@lru_cache(maxsize=4096)
def align(pivot: str, page: str) -> tuple[int, ...]:
    """Pivot node of every page node (-1: none) by simple tree matching of equal names."""
    a_names, _, a_kids = tree(pivot)
    b_names, _, b_kids = tree(page)
    tables: dict[tuple[int, int], list[list[int]]] = {}

    def weight(pair: tuple[int, int]) -> int:
        return tables[pair][-1][-1] + 1 if pair in tables else 0

    # children have larger numbers than parents, so pairs from the end are solved bottom up
    where: dict[str, list[int]] = {}
    for i, n in enumerate(a_names):
        where.setdefault(n, []).append(i)
    for j in range(len(b_names) - 1, -1, -1):
        for i in where.get(b_names[j], ()):
            rows = [[0] * (len(b_kids[j]) + 1)]
            for x in a_kids[i]:
                last, row = rows[-1], [0]
                for y, child in enumerate(b_kids[j]):
                    row.append(max(row[-1], last[y + 1], last[y] + weight((x, child))))
                rows.append(row)
            tables[i, j] = rows
    found = [-1] * len(b_names)
    todo = [(0, 0)] if (0, 0) in tables else []
    while todo:
        i, j = todo.pop()
        found[j] = i
        rows, x, y = tables[i, j], len(a_kids[i]), len(b_kids[j])
        while x and y:
            pair = (a_kids[i][x - 1], b_kids[j][y - 1])
            if rows[x][y] == rows[x - 1][y]:
                x -= 1
            elif rows[x][y] == rows[x][y - 1]:
                y -= 1
            else:
                todo.append(pair)
                x, y = x - 1, y - 1
    return tuple(found)


def region(signature: str, masses: dict[int, float]) -> int:
    """Node of the content: down from the root into the child that holds most varying text."""
    names, parents, kids = tree(signature)
    total = [masses.get(k, 0.0) for k in range(len(names))]
    boiler = [False] * len(names)
    for k, name in enumerate(names):
        boiler[k] = name.endswith("!") or (k > 0 and boiler[parents[k]])
        if boiler[k]:
            total[k] = 0.0
    for k in range(len(names) - 1, 0, -1):
        total[parents[k]] += total[k]
    marked = [k for k, n in enumerate(names) if n.split(".")[0] in CONTENT_TAGS and not boiler[k] and total[k] > 0]
    if marked:
        top = max(marked, key=lambda k: (total[k], -k))
        return top
    at = 0
    while True:
        inner = [k for k in kids[at] if kids[k] and total[k] > 0 and total[k] >= REGION_SHARE * total[at]]
        if not inner:
            return at
        at = inner[0]


def _within(parents: tuple[int, ...], node: int, top: int) -> bool:
    while node > top:
        node = parents[node]
    return node == top


def outline(signature: str) -> int:
    """Page type: the names on the first levels of a tree, each with its depth."""
    level, seen = 0, set()
    for name, mark in re.findall(r"([^() ]+)|([()])", signature):
        if name and level < OUTLINE_LEVELS:
            seen.add(f"{level} {name}")
        level += {"(": 1, ")": -1}.get(mark, 0)
    return _digest(" ".join(sorted(seen)))


def content(html: str, wrappers: dict[int, tuple[str, dict[int, float], frozenset[int]]], fixed: frozenset[int]) -> str:
    """Text of the page's blocks in the content region of its page type's wrapper.

    ``wrappers`` has (pivot, masses, template) by page type, ``fixed`` the texts that most pages of the host have.
    Without a wrapper, or where its region has no counterpart in the page, the page's own text decides about
    the region.  If names and tags leave nothing, only texts of the template are taken out.
    """
    signature, blocks = blocks_of(parse(html))
    _, parents, _ = tree(signature)
    pivot, masses, template = wrappers.get(outline(signature), (None, {}, frozenset()))
    top = -1
    if pivot is not None:
        matched = align(pivot, signature)
        aim = region(pivot, masses)
        top = matched.index(aim) if aim in matched else -1
    if top < 0:
        own: dict[int, float] = {}
        for at, _, text, linked in blocks:
            own[at] = own.get(at, 0.0) + max(0, len(text) - linked)
        top = region(signature, own)
    inside = [(at, text) for at, boiler, text, _ in blocks if not boiler and _within(parents, at, top)]
    gone = {at for at, digest, _ in node_texts(blocks) if digest in template or digest in fixed}
    kept = [text for at, text in inside if at not in gone] or [text for _, text in inside]
    return "\n".join(kept or [text for at, _, text, _ in blocks if at not in gone])


def node_texts(blocks: list[tuple[int, bool, str, int]]) -> list[tuple[int, int, int]]:
    """(tree node, digest of its whole text, characters outside links) of a page's nodes with text."""
    texts: dict[int, list[str]] = {}
    sizes: dict[int, int] = {}
    for at, _, text, linked in blocks:
        texts.setdefault(at, []).append(text)
        sizes[at] = sizes.get(at, 0) + max(0, len(text) - linked)
    return [(at, _digest("\n".join(t)), sizes[at]) for at, t in texts.items()]


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def host_of(url: str = "url"):
    """Host in lower case without port and user; '' where there is none."""
    found = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return found


def _page_blocks(pages: DataFrame) -> DataFrame:
    """(host, type, signature, longest, nodes, digests, sizes) per page, the arrays over its nodes with text."""
    names = ["host", "type", "signature", "longest", "nodes", "digests", "sizes"]
    kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signatures, longest, cells = [], [], [[], [], []]
            for html in b.column(1):
                signature, blocks = blocks_of(parse(html.as_py()))
                signatures.append(signature)
                found = node_texts(blocks)
                longest.append(max(found, key=lambda n: (n[2], n[1]))[1] if found else 0)
                for cell, values in zip(cells, list(zip(*found)) or [(), (), ()]):
                    cell.append(list(values))
            types = pa.array(map(outline, signatures), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), types, pa.array(signatures, pa.string()), pa.array(longest, pa.int64()), *[pa.array(c, k) for c, k in zip(cells, kinds)]], names
            )

    layout = "host string, type bigint, signature string, longest bigint, nodes array<int>, digests array<bigint>, sizes array<bigint>"
    return pages.select("host", "html").mapInArrow(made, layout)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, types, fixed) from ``pages`` with columns host and html.

    ``types`` lists (type, pivot, masses, template): ``masses`` maps pivot nodes to their varying text and
    ``template`` lists digests of node texts that repeat.  ``fixed`` lists those that most pages of the host
    have.  Pages with one longest text are counted once, by their first node texts.
    """
    seen = _page_blocks(pages)
    one = ["host", "type", "longest"]
    seen = cut_lineage(seen.groupBy(*one).agg(F.min(F.struct("signature", "nodes", "digests", "sizes")).alias("p")).select(*one, "p.*"))
    group = ["host", "type"]
    per = seen.groupBy(*group, "signature").agg(F.count(F.lit(1)).alias("n"))
    first = F.max(F.struct("n", "signature"))
    pivots = cut_lineage(per.groupBy(*group).agg(first["signature"].alias("pivot"), F.sum("n").alias("pages")))

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, signature = b.column("pivot").to_pylist(), b.column("signature").to_pylist()
            nodes = [[align(p, s)[k] for k in own] for p, s, own in zip(pivot, signature, b.column("nodes").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("host"), b.column("type"), b.column("pages"), pa.array(nodes, pa.list_(pa.int32())), b.column("digests"), b.column("sizes")],
                ["host", "type", "pages", "nodes", "digests", "sizes"],
            )

    joined = salted_join(seen, pivots, group, spread=["signature", "longest"])
    joined = joined.mapInArrow(aligned, "host string, type bigint, pages bigint, nodes array<int>, digests array<bigint>, sizes array<bigint>")
    cells = joined.select(*group, "pages", F.explode(F.arrays_zip("nodes", "digests", "sizes")).alias("c")).select(*group, "pages", "c.*").where("nodes >= 0")
    counted = cells.groupBy(*group, "pages", "nodes", "digests").agg(F.count(F.lit(1)).alias("n"), F.sum("sizes").alias("size"))
    # a text of nearly all pages is template; so are texts that many pages share at a node where few others stand
    often = (F.col("n") >= TEMPLATE_PAGES) & (F.col("n") * 10 >= F.col("pages"))
    always = often & (F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    mass = lambda gone: F.sum(F.when(gone, 0).otherwise(F.col("size"))).cast("double")
    listed = lambda gone: F.collect_list(F.when(gone, F.col("digests")))
    node = counted.groupBy(*group, "nodes").agg(
        mass(always).alias("mass"), listed(always).alias("fixed"), mass(often).alias("rest"), listed(often).alias("shared"),
        (F.sum(F.when(often, F.col("n")).otherwise(0)) >= TEMPLATE_SHARE * F.sum("n")).alias("repeats"),
    )
    either = lambda a, b: F.when(F.col("repeats"), F.col(a)).otherwise(F.col(b))
    node = node.select(*group, "nodes", either("rest", "mass").alias("mass"), either("shared", "fixed").alias("fixed"))
    per_type = node.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct("nodes", "mass"))).alias("masses"), F.flatten(F.collect_list("fixed")).alias("template")
    )
    typed = pivots.select(*group, "pivot").join(per_type, group, "left")
    typed = typed.groupBy("host").agg(F.collect_list(F.struct("type", "pivot", "masses", "template")).alias("types"))
    pages_of = pivots.groupBy("host").agg(F.sum("pages").alias("pages"))
    texts = seen.select("host", F.explode(F.array_distinct("digests")).alias("digest")).groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n"))
    common = texts.where(F.col("n") >= TEMPLATE_PAGES).join(pages_of, "host").where(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    return typed.join(common.groupBy("host").agg(F.collect_list("digest").alias("fixed")), "host", "left")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, text), one row per row of ``pages``; a null html counts as empty.

    Pages without a host form one group.  Wrappers are broadcast while they take at most ``broadcast_bytes``;
    beyond that they are joined, with hosts of many pages spread over tasks.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(url).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    known = cut_lineage(wrappers(rows))
    one = F.aggregate("types", F.lit(0).cast("bigint"), lambda n, t: n + F.octet_length(t["pivot"]) + 16 * F.coalesce(F.cardinality(t["masses"]), F.lit(0)) + 8 * F.coalesce(F.cardinality(t["template"]), F.lit(0)))
    size = known.agg(F.sum(one + 8 * F.coalesce(F.cardinality("fixed"), F.lit(0)) + F.octet_length("host"))).first()[0] or 0
    joined = rows.join(F.broadcast(known), "host", "left") if size <= broadcast_bytes else salted_join(rows, known, ["host"], "left", spread=["page_id", "url"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ready: dict[str, tuple] = {}
            texts = []
            for n, host in enumerate(b.column("host").to_pylist()):
                if host not in ready:
                    types, fixed = b.column("types")[n].as_py(), b.column("fixed")[n].as_py()
                    by_type = {t["type"]: (t["pivot"], dict(t["masses"] or ()), frozenset(t["template"] or ())) for t in types or ()}
                    ready[host] = by_type, frozenset(fixed or ())
                texts.append(content(b.column("html")[n].as_py(), *ready[host]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema[page_id].dataType.simpleString()
    return joined.select("page_id", "url", "html", "host", "types", "fixed").mapInArrow(made, f"page_id {kind}, url string, text string")
