"""Main text of web pages by wrapper induction.

Pages of a host are made by one template.  A page is reduced to its tree of block elements, in which equal
siblings are one repeated node; trees are aligned by simple tree matching (the largest common top-down tree in
which order is kept), and merging aligned trees gives the host's template.  A template node carries
sums over pages: how many have it, characters of text and of links, and links.  Then each page is aligned to the
template and the pages of every (node, block text) are counted exactly, whatever a text's length or the number of its
siblings.  Text that stays constant over the pages is template; slots whose text varies are
content, unless the slot is a menu, header, footer, sidebar, notice, advert, form or comment by its element,
its class or id, or its link density.

Trees merge in any order, so a host of any size is merged in groups of ``GROUP`` trees, level by level; equal trees are
merged once, which keeps copies of a page from looking constant.  Each page is aligned to its host's template and read off.

Edge cases: null and empty html give an empty text; a null url is a host of its own; broken markup is read as far as
it goes; rows that repeat an id stand for themselves; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from typing import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

GROUP = 400
#: A block text is template if it is on this share of a node's different pages, which are at least so many.
CONSTANT, CONSTANT_PAGES = 0.8, 5
LINK_DENSITY, MENU_LINKS = 0.8, 3
#: Elements nested deeper than this are read as siblings, as browsers do.
DEPTH = 300

# Fixed values of HTML and of common page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math object select".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY = {"p": set("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())}
CLOSED_BY |= {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}, "head": {"body"}}
BOUNDS = set("table ul ol dl article section div body html nav aside main footer header form".split())
FURNITURE = set("head nav footer aside form button input menu dialog fieldset header".split())
HINTS = set(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead comment comments disqus respond replies reply share sharing social related recommended newsletter subscribe subscription popup modal "
    "overlay widget toolbar pagination pager skip login signup search".split()
)
MAIN = ("article", "main")

_TOKEN = re.compile(
    r"<(?:!--(?:.*?-->|.*)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attr2>[^>]*)>|[!?/][^>]*>)", re.S
)
_ATTR = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("tag", "key", "dropped", "children")

    def __init__(self, tag: str, attr: str = ""):
        self.tag, self.key, self.dropped, self.children = tag, tag, tag in FURNITURE, []
        if attr:
            named = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attr)]
            tokens = sorted({t for k, v in named if k != "hidden" for t in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", v).lower()) if t})
            if tokens:
                self.key += "." + ".".join(tokens)
            if HINTS.intersection(tokens) and tag not in ("body", "html", "article", "main") or any(k == "hidden" for k, _ in named):
                self.dropped = True


def parse(html: str) -> Node:
    """The element tree; text is kept as strings among the children, still with its character references."""
    root = Node("html")
    stack, at = [root], 0
    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].children.append(text)
        if not m:
            return root
        at = m.end()
        tag = (m["name"] or m["name2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in BOUNDS and (tag in INLINE or tag in CLOSED_BY):
                    break  # a stray end tag does not close a container
            continue
        if tag == "html":
            continue
        if tag in RAW:
            if not (m["attr"] or m["attr2"] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        for k in range(len(stack) - 1, 0, -1):
            if tag in CLOSED_BY.get(stack[k].tag, ()):
                del stack[k:]
                break
            if stack[k].tag in BOUNDS:
                break
        node = Node(tag, m["attr"] or m["attr2"] or "")
        stack[-1].children.append(node)
        if tag not in VOID and len(stack) < DEPTH:
            stack.append(node)


class Tree:
    """A template node: sums over the pages that have it.  ``texts`` are hashes of the block texts of one page's node."""

    __slots__ = ("key", "n", "chars", "linked", "links", "texts", "children")

    def __init__(self, key, n=1, chars=0, linked=0, links=0, texts=None, children=None):
        self.key, self.n, self.chars, self.linked, self.links = key, n, chars, linked, links
        self.texts, self.children = texts if texts is not None else [], children if children is not None else []

    def dump(self):
        return [self.key, self.n, self.chars, self.linked, self.links, self.texts, [c.dump() for c in self.children]]

    @staticmethod
    def load(x) -> "Tree":
        return Tree(*x[:6], [Tree.load(c) for c in x[6]])

    def shape(self) -> tuple:
        return (self.key, tuple(c.shape() for c in self.children))


def blocks(node: Node, visit, path: tuple = ()) -> None:
    """Call ``visit(path, text, characters in links, links)`` for each block of text in page order; a path holds the block
    elements from the root."""
    text: list[str] = []
    link = [0, 0]

    def flush(path):
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                visit(path, line, link[0], link[1])
            text.clear()
            link[0] = link[1] = 0

    def walk(node, path, in_link):
        for c in node.children:
            if isinstance(c, str):
                text.append(c)
                if in_link:
                    link[0] += len(c)
            elif c.tag in INLINE:
                if c.tag == "br":
                    text.append(" ")
                elif not c.dropped:
                    link[1] += c.tag == "a"
                    walk(c, path, in_link or c.tag == "a")
            else:
                flush(path)
                walk(c, path + (c,), in_link)
                flush(path + (c,))

    walk(node, path + (node,), False)
    flush(path + (node,))


def skeleton(page: Node) -> Tree:
    """The page as a tree of block elements with its own sums; siblings of one key are one node."""
    root = Tree(page.key)
    of: dict[int, Tree] = {id(page): root}

    def grow(node, tree):
        for c in node.children:
            if not isinstance(c, str):
                if c.tag in INLINE:
                    grow(c, tree)
                    continue
                t = next((x for x in tree.children if x.key == c.key), None)
                if t is None:
                    t = Tree(c.key)
                    tree.children.append(t)
                of[id(c)] = t
                grow(c, t)

    grow(page, root)

    def visit(path, line, linked, links):
        t = of[id(path[-1])]
        t.chars += len(line)
        t.linked += linked
        t.links += links
        t.texts.append(xxhash.xxh3_64_hexdigest(line))

    blocks(page, visit)
    for t in of.values():
        t.texts = sorted(set(t.texts))
    return root


def match(a: Tree, b: Tree, memo: dict) -> int:
    """Simple tree matching: nodes in the largest order-keeping common top-down tree."""
    if a.key != b.key:
        return 0
    k = (id(a), id(b))
    if k not in memo:
        memo[k] = 1 + _table(a.children, b.children, memo)[-1][-1]
    return memo[k]


def _table(xs: list[Tree], ys: list[Tree], memo: dict) -> list[list[int]]:
    m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs, 1):
        for j, y in enumerate(ys, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + match(x, y, memo))
    return m


def pairs(xs: list[Tree], ys: list[Tree], memo: dict) -> list[tuple[int | None, int | None]]:
    """Aligned positions of two lists of siblings, in an order that keeps both."""
    m, out, i, j = _table(xs, ys, memo), [], len(xs), len(ys)
    while i or j:
        w = match(xs[i - 1], ys[j - 1], memo) if i and j else 0
        if w and m[i][j] == m[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif j and (not i or m[i][j] == m[i][j - 1]):
            j -= 1
            out.append((None, j))
        else:
            i -= 1
            out.append((i, None))
    return out[::-1]


def merge(a: Tree, b: Tree) -> Tree:
    """The template of both: aligned nodes add up, others keep their place."""
    return _merge(a, b, {})


def _merge(a: Tree, b: Tree, memo: dict) -> Tree:
    children = []
    for i, j in pairs(a.children, b.children, memo):
        children.append(a.children[i] if j is None else b.children[j] if i is None else _merge(a.children[i], b.children[j], memo))
    return Tree(a.key, a.n + b.n, a.chars + b.chars, a.linked + b.linked, a.links + b.links, None, children)


def merge_all(trees: list[Tree]) -> Tree:
    """Balanced merging; trees of one shape first, whose alignment is plain."""
    trees = sorted(trees, key=lambda t: repr(t.shape()))
    while len(trees) > 1:
        trees = [merge(*trees[k : k + 2]) if k + 1 < len(trees) else trees[k] for k in range(0, len(trees), 2)]
    return trees[0]


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


KINDS = "host string, template string"


def page_trees(pages: DataFrame, host: str = "host", html_col: str = "html") -> DataFrame:
    """(host, template): the different trees of each host's pages, with their block texts, as JSON."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [json.dumps(skeleton(parse(h.as_py() or "")).dump()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "template"])

    return pages.select(F.col(host), F.col(html_col)).mapInArrow(trees, KINDS).distinct()


def templates(rows: DataFrame) -> DataFrame:
    """(host, template): one row per host, the template as JSON."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [json.dumps(merge_all([Tree.load(json.loads(t)) for t in ts.as_py()]).dump()) for ts in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["host", "template"])

    while True:
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        # groups of at most about GROUP trees by a hash of the tree; smaller hosts are merged on the last level
        salted = rows.withColumn("s", F.pmod(F.xxhash64("template"), F.lit(-(-most // GROUP) or 1)))
        lists = salted.groupBy("host", "s").agg(F.array_sort(F.collect_list("template")).alias("ts"))
        rows = lists.select("host", "ts").mapInArrow(merged, KINDS)
        rows = written(rows, "templates")
        if most <= GROUP:
            return rows


def nodes(t: Tree) -> list[Tree]:
    """A tree's nodes, parents first."""
    out, todo = [], [t]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += reversed(x.children)
    return out


def constants(rows: DataFrame, induced: DataFrame) -> DataFrame:
    """(host, constants): the block texts, as "node:hash", that are on ``CONSTANT`` of the different pages of a template node."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[int, tuple] = {}
        for batch in batches:
            hosts, at, texts = [], [], []
            for host, page, t in zip(*(c.to_pylist() for c in batch.columns)):
                key = xxhash.xxh3_64_intdigest(t)
                if key not in wrappers:
                    if len(wrappers) > 200:
                        wrappers.clear()
                    w = Wrapper(Tree.load(json.loads(t)))
                    wrappers[key] = w, {id(x): k for k, x in enumerate(nodes(w.template))}
                w, number = wrappers[key]
                tree = Tree.load(json.loads(page))
                slots, seen = w.align(tree), set()
                for x in nodes(tree):
                    slot = slots.get(id(x))
                    if slot is not None:
                        # a row without a text counts the node's pages
                        seen.update((number[id(slot)], h) for h in (None, *x.texts))
                for k, h in seen:
                    hosts.append(host)
                    at.append(k)
                    texts.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(at, pa.int32()), pa.array(texts, pa.string())], ["host", "node", "text"])

    met = rows.join(induced.withColumnRenamed("template", "of_host"), "host").select("host", "template", "of_host")
    counts = met.mapInArrow(places, "host string, node int, text string").groupBy("host", "node", "text").count()
    # a text on fewer pages is on too few of any node that counts
    counts = written(counts.filter(F.col("text").isNull() | (F.col("count") >= CONSTANT * CONSTANT_PAGES)), "text-counts")
    pages_of = counts.filter(F.col("text").isNull() & (F.col("count") >= CONSTANT_PAGES)).select("host", "node", F.col("count").alias("n"))
    kept = counts.filter(F.col("text").isNotNull()).join(pages_of, ["host", "node"]).filter(F.col("count") >= CONSTANT * F.col("n"))
    return kept.groupBy("host").agg(F.array_sort(F.collect_list(F.concat_ws(":", "node", "text"))).alias("constants"))


class Wrapper:
    """What a host's template says about its nodes; pages are aligned to it once for each shape."""

    def __init__(self, template: Tree, constants: list[str] = ()):
        self.template = template
        every = nodes(template) if constants else []
        self.constants = {(id(every[int(k)]), h) for k, h in (c.split(":") for c in constants)}
        self.known: dict[tuple, dict] = {}

    def align(self, page: Tree) -> dict[int, Tree]:
        """Template nodes of the page's nodes, by the id of the page's node."""
        shape, order = page.shape(), []

        def flat(t):
            order.append(t)
            for c in t.children:
                flat(c)

        flat(page)
        if shape not in self.known:
            if len(self.known) > 2000:
                self.known.clear()
            found: dict[int, Tree] = {}
            memo: dict = {}

            def down(t, p):
                found[id(p)] = t
                for i, j in pairs(t.children, p.children, memo):
                    if i is not None and j is not None:
                        down(t.children[i], p.children[j])

            if self.template.key == page.key:
                down(self.template, page)
            self.known[shape] = [found.get(id(t)) for t in order]
        return {id(t): s for t, s in zip(order, self.known[shape]) if s is not None}


def is_menu(t: Tree) -> bool:
    """A container whose text is links for the most part, on the average page."""
    chars = linked = links = 0
    todo = [t]
    while todo:
        x = todo.pop()
        chars, linked, links = chars + x.chars, linked + x.linked, links + x.links
        todo += x.children
    return t.key.split(".")[0] in ("ul", "ol", "div", "table", "section", "dl") and links >= MENU_LINKS * t.n and linked >= LINK_DENSITY * chars > 0


def main_text(html: str, wrapper: Wrapper) -> str:
    page = parse(html)
    tree = skeleton(page)
    slots = wrapper.align(tree)
    # each block element's place in the page's tree
    of: dict[int, Tree] = {id(page): tree}

    def place(node, t):
        for c in node.children:
            if not isinstance(c, str):
                if c.tag in INLINE:
                    place(c, t)
                    continue
                x = next(x for x in t.children if x.key == c.key)
                of[id(c)] = x
                place(c, x)

    place(page, tree)
    kept: list[tuple[bool, str]] = []
    menus: dict[int, bool] = {}

    def visit(path, line, linked, links):
        inside = False
        for node in path:
            if node.dropped and not (node.tag == "header" and inside and node.key == "header"):
                return
            inside = inside or node.tag in MAIN
            slot = slots.get(id(of[id(node)]))
            if slot is not None:
                if id(slot) not in menus:
                    menus[id(slot)] = is_menu(slot)
                if menus[id(slot)]:
                    return
        slot = slots.get(id(of[id(path[-1])]))
        if slot is not None and wrapper.constants and (id(slot), xxhash.xxh3_64_hexdigest(line)) in wrapper.constants:
            return
        kept.append((inside, line))

    blocks(page, visit)
    if any(inside for inside, _ in kept):
        kept = [x for x in kept if x[0]]
    return "\n\n".join(line for _, line in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    rows = small_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(url_col).alias("host"))
    trees = written(page_trees(rows), "page-trees")
    induced = templates(trees)
    induced = induced.join(constants(trees, induced), "host", "left").withColumn("constants", F.coalesce("constants", F.array().cast("array<string>")))
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[int, Wrapper] = {}
        for batch in batches:
            out = []
            for h, t, fixed in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                key = xxhash.xxh3_64_intdigest(" ".join([t, *fixed]))
                if key not in wrappers:
                    if len(wrappers) > 200:
                        wrappers.clear()
                    wrappers[key] = Wrapper(Tree.load(json.loads(t)), fixed)
                out.append(main_text(h.as_py() or "", wrappers[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], schema.names)

    return rows.join(induced, "host").select("page_id", "url", "html", "template", "constants").mapInArrow(read, schema)
