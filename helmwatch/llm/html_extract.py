"""Main-text extraction from web pages by wrapper induction.

Every page becomes a tree of its block elements, in which like siblings are one repeated node. Trees of a host's pages
are aligned by simple tree matching and merged: each task merges its own pages host by host, then the partial trees of
a host meet, in two steps. The merged tree, the host's wrapper, tells for every node on how many pages it stands in
its place, whether its text is the same on all of them, and how much of it is links. Constant nodes and link lists are
template; varying slots are content, wherever in the page they stand. Pages are then cut along their host's wrapper.
Elements that by their name hold no main text (navigation, forms, scripts and so on) are left out in any case, also
where a host has too few pages for a wrapper. No element is needed to mark the main text: an article element only makes
the wrapper more careful inside it.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmwatch.llm.common import read_table, written

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title svg annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym area audio b base bdi bdo big canvas cite code data del dfn em embed font i img input ins kbd label link map mark meta object picture q rp rt ruby s samp small source span strike strong sub sup time track tt u var video wbr".split())
FORMULA = frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
# What is not shown or stands in a line does not end a block either.
INLINE |= FORMULA | (RAW - {"title"}) | {"button", "option", "optgroup", "select"}
BOILERPLATE = frozenset("head nav header footer aside form button dialog menu select".split()) | RAW
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
ARTICLE = ("article", "main")
#: Words of a class or id that mark an element as no part of the main text.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?=$|[\s_-])",
    re.I,
)
ROLES = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu)\b", re.I)
# A quote counts in a tag only behind "=", and only if it is closed; no part is tried twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_LABEL = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass(frozen=True)
class Limits:
    """When the wrapper takes a node for template. Pages of hosts with fewer than min_pages pages are cut by names only.

    min_pages, share: it is constant on at least so many pages, and on this share of the pages its parent stands on;
    link lists need the pages only. min_pages_inside, share_inside: the same within an article or main element.
    link_share: the part of a link list's text that links hold. max_depth: what lies deeper in a page belongs, in the
    wrapper, to its ancestor of this depth; texts are extracted at every depth."""

    min_pages: int = 3
    share: float = 0.5
    min_pages_inside: int = 10
    share_inside: float = 0.9
    link_share: float = 0.6
    max_depth: int = 60


LIMITS = Limits()


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, label), ("close", tag, "") and ("text", text, "") in page order; raw elements' text is skipped."""
    at, n = 0, len(page)
    open_ended: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        m = _TOKEN.match(page, lt)
        if not m:
            yield "text", "<", ""
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, ""
            continue
        attributes = m[3] or ""
        label = " ".join(filter(None, (x for g in _LABEL.findall(attributes) for x in g)))
        yield "open", tag, ("role-none " if ROLES.search(attributes) else "") + label
        if tag in RAW:
            end = None if tag in open_ended else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end is None:
                open_ended.add(tag)
            at = end.end() if end else (n if tag in ("script", "style") else at)
            yield "close", tag, ""


def marked(tag: str, label: str) -> bool:
    return tag in BOILERPLATE or bool(label) and (label.startswith("role-none") or bool(MARKS.search(label)))


class Walk:
    """A walk over a page's events that keeps the stack of open elements; unclosed elements end with their parents."""

    def __init__(self, page: str):
        self.stack: list[tuple[str, str]] = []
        self.names: Counter[str] = Counter()
        self.page = page

    def _pop(self) -> str:
        top = self.stack.pop()[0]
        self.names[top] -= 1
        return top

    def __iter__(self) -> Iterator[tuple[str, str]]:
        stack = self.stack
        for kind, name, label in events(self.page):
            if kind == "text":
                yield "text", name
            elif kind == "open":
                if name not in INLINE and name not in VOID:
                    while stack and (stack[-1][0] in INLINE or stack[-1][0] in CLOSED_BY_BLOCK):
                        self._pop()
                        yield "pop", ""
                if name == "li":
                    while stack and stack[-1][0] == "li":
                        self._pop()
                        yield "pop", ""
                yield ("break" if name not in INLINE else "inline"), name
                if name not in VOID:
                    stack.append((name, label))
                    self.names[name] += 1
                    yield "push", name
            elif self.names[name]:
                while True:
                    top = self._pop()
                    yield "pop", ""
                    if top == name:
                        break
                if name not in INLINE:
                    yield "break", name


def _key(tag: str, label: str) -> str:
    return tag + ("." + ".".join(sorted(set(re.sub(r"\d+", "#", label).split()))) if label else "")


# A tree node: [pages, text length, link length, checksum of the own text or None if it varies, children by key].
PAGES, TEXT, LINKS, SUM, CHILDREN = range(5)


def page_tree(page: str, max_depth: int = LIMITS.max_depth) -> list:
    """The tree of a page's block elements, like siblings merged."""
    root: list = [1, 0, 0, 0, {}]
    path, depth, links = [("", root)], [], 0
    texts: list[list[str]] = [[]]

    def leave() -> None:
        (key, node), parts = path.pop(), texts.pop()
        node[SUM] = zlib.crc32(" ".join("".join(parts).split()).encode("utf-8", "replace"))
        siblings = path[-1][1][CHILDREN]
        if key in siblings:
            _repeat(siblings[key], node)
        else:
            siblings[key] = node

    walk = Walk(page)
    for kind, value in walk:
        if kind == "push":
            tag, label = walk.stack[-1]
            node = tag not in INLINE and len(path) <= max_depth
            depth.append((tag, node))
            links += tag == "a"
            if node:
                path.append((_key(tag, label), [1, 0, 0, 0, {}]))
                texts.append([])
        elif kind == "pop":
            tag, node = depth.pop()
            links -= tag == "a"
            if node:
                leave()
        elif kind == "text" and (n := len(value.strip())):
            texts[-1].append(value)
            path[-1][1][TEXT] += n
            path[-1][1][LINKS] += n if links else 0
    while len(path) > 1:
        leave()
    return root


def _repeat(node: list, other: list) -> None:
    """Add a like sibling of the same page: one node whose text is all of theirs, in order."""
    node[TEXT], node[LINKS] = node[TEXT] + other[TEXT], node[LINKS] + other[LINKS]
    node[SUM] = zlib.crc32(f"{node[SUM]},{other[SUM]}".encode())
    for key, child in other[CHILDREN].items():
        if key in node[CHILDREN]:
            _repeat(node[CHILDREN][key], child)
        else:
            node[CHILDREN][key] = child


def _heaviest_in_order(places: list[int], weights: list[int]) -> tuple[int, list[int]]:
    """The largest weight that increasing places can have together, and their indexes. The places are all different."""
    rank = {p: i for i, p in enumerate(sorted(places), 1)}
    best = [(0, -1)] * (len(places) + 1)  # prefix maxima by rank, as a binary indexed tree
    before: list[int] = []
    top = (0, -1)
    for i, (place, weight) in enumerate(zip(places, weights, strict=True)):
        j, found = rank[place] - 1, (0, -1)
        while j:
            found = max(found, best[j])
            j &= j - 1
        before.append(found[1])
        here = (found[0] + weight, i)
        top, j = max(top, here), rank[place]
        while j < len(best):
            best[j] = max(best[j], here)
            j += j & -j
    chosen, i = [], top[1]
    while i >= 0:
        chosen.append(i)
        i = before[i]
    return top[0], chosen[::-1]


def match(a: list, b: list, found: dict) -> int:
    """Simple tree matching: the size of the largest order-preserving common top of two trees of the same key. found
    keeps, for each pair of nodes, the keys of the children that go together. As keys differ among siblings, the best
    alignment of children is the heaviest set of shared keys that stand in the same order on both sides."""
    place = {key: i for i, key in enumerate(b[CHILDREN])}
    shared = [key for key in a[CHILDREN] if key in place]
    size, chosen = _heaviest_in_order([place[k] for k in shared], [match(a[CHILDREN][k], b[CHILDREN][k], found) for k in shared])
    found[id(a), id(b)] = {shared[i] for i in chosen}
    return 1 + size


def merge(a: list, b: list) -> list:
    """The wrapper of both trees: page counts of aligned nodes add up, a text stays constant only if it is the same in
    both. A child that stands in another order on the other side is the same slot, since slots are named by their path,
    but the pages of the smaller side do not support it."""
    found: dict = {}
    match(a, b, found)
    return _merge(a, b, True, found)


def _merge(a: list, b: list, aligned: bool, found: dict) -> list:
    ours, theirs, pairs = a[CHILDREN], b[CHILDREN], found[id(a), id(b)]
    fresh = iter([k for k in theirs if k in pairs or k not in ours])
    children: dict = {}
    for key, child in ours.items():
        if key in pairs:
            for k in fresh:
                if k == key:
                    break
                children[k] = theirs[k]
        children[key] = _merge(child, theirs[key], key in pairs, found) if key in theirs else child
    children.update((k, theirs[k]) for k in fresh)
    pages = a[PAGES] + b[PAGES] if aligned else max(a[PAGES], b[PAGES])
    return [pages, a[TEXT] + b[TEXT], a[LINKS] + b[LINKS], a[SUM] if a[SUM] == b[SUM] else None, children]


def _step(path: bytes, key: str) -> bytes:
    """The path one level down, as 8 bytes at every depth."""
    return blake2b(path + key.encode("utf-8", "replace"), digest_size=8).digest()


def wrapper_rules(tree: list, limits: Limits = LIMITS) -> list[str]:
    """The wrapper's template nodes, by their paths' digests."""
    drop: list[str] = []

    def text(node: list) -> int:
        return node[TEXT] + sum(map(text, node[CHILDREN].values()))

    def constant(node: list) -> bool:
        return node[SUM] is not None and all(c[PAGES] == node[PAGES] and constant(c) for c in node[CHILDREN].values())

    def link_list(node: list) -> bool:
        """Every part of it that has text is mostly links."""
        return node[LINKS] >= limits.link_share * node[TEXT] and all(link_list(c) for c in node[CHILDREN].values() if text(c))

    def holds_article(node: list) -> bool:
        return any(k.split(".")[0] in ARTICLE or holds_article(c) for k, c in node[CHILDREN].items())

    def visit(node: list, path: bytes, inside: bool) -> None:
        differ = not constant(node)
        for key, child in node[CHILDREN].items():
            where, tag = _step(path, key), key.split(".")[0]
            if inside:
                enough = child[PAGES] >= max(limits.min_pages_inside, limits.share_inside * node[PAGES])
                template = enough and differ and constant(child) and tag not in ("h1", "h2")
            else:
                enough = child[PAGES] >= limits.min_pages and tag not in ARTICLE and not holds_article(child)
                template = enough and (differ and constant(child) and child[PAGES] >= limits.share * node[PAGES] or link_list(child))
            if template and text(child):
                drop.append(where.hex())
            else:
                visit(child, where, inside or tag in ARTICLE)

    visit(tree, b"", False)
    return drop


def extract(page: str, rules: frozenset[str] = frozenset(), max_depth: int = LIMITS.max_depth, named: bool = True) -> str:
    """The page's main text: all text outside the wrapper's template nodes and, where named, outside elements that by
    their names hold none. White space in a block becomes one space, blocks are joined by a line break."""
    texts: list[str] = []
    block: list[str] = []
    skipped = 0
    path: list[bytes] = [b""]
    opened: list[tuple[bool, bool]] = []

    def flush() -> None:
        if block:
            if text := " ".join(html.unescape("".join(block)).split()):
                texts.append(text)
            block.clear()

    walk = Walk(page)
    for kind, value in walk:
        if kind == "text":
            if not skipped:
                block.append(value)
        elif kind == "break":
            flush()
        elif kind == "push":
            tag, label = walk.stack[-1]
            node = bool(rules) and tag not in INLINE and len(path) <= max_depth
            if node:
                path.append(_step(path[-1], _key(tag, label)))
            # Headers go, also those inside an article; the content of raw elements never comes here.
            skip = named and marked(tag, label) or node and path[-1].hex() in rules
            skipped += skip
            opened.append((skip, node))
        elif kind == "pop" and opened:
            skip, node = opened.pop()
            skipped -= skip
            if node:
                path.pop()
    flush()
    return "\n".join(texts)


#: Hosts whose trees a task holds at once.
HELD_HOSTS = 5000
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _learner(max_depth: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = page_tree(page.as_py(), max_depth)
                trees[host] = merge(trees[host], tree) if host in trees else tree
                if len(trees) >= HELD_HOSTS:
                    yield _rows(trees)
                    trees = {}
        if trees:
            yield _rows(trees)

    return learn


def _rows(trees: dict[str, list]) -> pa.RecordBatch:
    part = TaskContext.get().partitionId() % 64
    return pa.RecordBatch.from_arrays([pa.array(list(trees)), pa.array([part] * len(trees), pa.int32()), pa.array([json.dumps(t) for t in trees.values()])], names=["host", "part", "tree"])


def _merged(table: pa.Table) -> pa.Table:
    whole = None
    for t in sorted(table.column("tree").to_pylist()):
        whole = json.loads(t) if whole is None else merge(whole, json.loads(t))
    return pa.table({"host": [table.column("host")[0].as_py()], "part": pa.array([0], pa.int32()), "tree": [json.dumps(whole)]})


def induce_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", limits: Limits = LIMITS) -> DataFrame:
    """One row (host, tree) per host, learnt from all its pages; tree is the merged tree as JSON."""
    rows = pages.select(_host(url_col), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    kind = "host string, part int, tree string"
    partial = rows.mapInArrow(_learner(limits.max_depth), kind)
    return partial.groupBy("host", "part").applyInArrow(_merged, kind).groupBy("host").applyInArrow(_merged, kind).drop("part")


def _host(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), HOST, 1)).alias("host")


def _cutter(max_depth: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, frozenset] = {}
        for batch in batches:
            out = []
            for page, rules in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                rules = rules or "[]"
                if rules not in known:
                    known[rules] = frozenset(json.loads(rules))
                out.append(extract(page.as_py() or "", known[rules], max_depth))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_row", "text"])

    return cut


#: Wrapper rules of more bytes than this are joined by host instead of broadcast.
BROADCAST_BYTES = 16 << 20


def _ruler(limits: Limits):
    def rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([json.dumps(wrapper_rules(json.loads(t), limits)) for t in batch.column(1).to_pylist()], pa.string())], names=["host", "rules"])

    return rules


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", limits: Limits = LIMITS) -> DataFrame:
    """One row (id_col, url_col, text) per row of pages.

    A null html counts as empty and gives an empty text; pages without a url share the host "". Repeated rows count as
    often as they occur, also as pages of their host. Where all pages of a host are the same, nothing tells template
    from content, and only link lists and named elements go. Elements nested to any depth and texts of any length are read whole; tags that never
    end reach to the end of the page. An empty table gives an empty result; other columns are ignored.
    """
    rules = written(induce_wrappers(pages, url_col, html_col, limits).select("host", "tree").mapInArrow(_ruler(limits), "host string, rules string"), "wrappers").where("rules <> '[]'")
    size = rules.agg(F.coalesce(F.sum(F.octet_length("rules") + F.octet_length("host") + 64), F.lit(0))).first()[0]
    rows = pages.select(F.struct(F.col(id_col).alias("id"), F.col(url_col).alias("url")).alias("_row"), F.col(html_col).cast("string").alias("html"), _host(url_col))
    joined = rows.join(F.broadcast(rules) if size <= BROADCAST_BYTES else rules, "host", "left").select("_row", "html", "rules")
    kind = joined.schema["_row"].dataType.simpleString()
    out = joined.mapInArrow(_cutter(limits.max_depth), f"_row {kind}, text string")
    return out.select(F.col("_row.id").alias(id_col), F.col("_row.url").alias(url_col), "text")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
