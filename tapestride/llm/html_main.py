"""Main text of web pages by minimum-cut labelling.

A page becomes its text blocks in page order, each with its path of open elements. A classifier's log-odds from
the block's own features and its ancestors set the block's terminal capacities, all finite; all neighbouring blocks
are joined by smoothness edges that weigh more the closer they stand in the element tree. The minimum cut, found by
max-flow, separates content from boilerplate: a weak block between strong ones, such as a list or a short line of an
article that no element marks as one, goes with its neighbours against its own sign.

Blocks are cut at block-level tags; inline tags and <br> stay inside a block. Character references are decoded,
white space inside a block becomes one space. Cases: a null or empty page, or one without content, gives an empty
text; unclosed, stray and truncated tags are tolerated; a very long page is cut in whole; repeated rows are
extracted row by row; only the id, url and html columns are read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import field_ddl, table, text_of

TOKEN = re.compile(r"(?s)<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
ATTRIBUTE = re.compile(r"(?s)([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")

# HTML's own element classes.
RAW = frozenset("script style noscript template textarea title iframe svg canvas object select annotation annotation-xml".split())
#: Of these, an element without an end tag lasts to the end of the page; of the others only the tag is dropped.
TO_END = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An element of the first kind ends where a block-level element, or one of the same kind, begins.
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: Elements and roles that are chrome; name parts, and forms, that speak against a block.
CHROME = frozenset("nav footer aside menu dialog button fieldset search head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside widget widgets share sharing social related recommended recommendations comment comments disqus respond replies reply login signin signup subscribe subscription newsletter search searchbox pagination pager toolbar skip masthead topbar copyright disclaimer".split()
)
#: A header counts against its blocks, unless it heads the article itself: then its headings and paragraphs are the article's.
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Log-odds of the linear block classifier. Pages carry no labels, so the weights are set by hand: chrome outweighs an
#: article's five and any neighbours, a page's header anything but an article; a block's own form decides little.
WEIGHTS = {"bias": -1.0, "article": 5.0, "log_chars": 0.55, "sentence": 0.8, "link_share": -5.0, "paragraph": 0.8, "heading": 0.6, "list_item": -0.6, "chrome": -40.0, "header": -20.0}
#: Cost of a form, of a class or id all of whose parts are chrome names, and of one with other parts, such as has-sidebar.
#: It falls from an element with half of the page's text to nothing for one with all of it.
NAMED, PARTLY = 12.0, 1.5
#: Smoothness between neighbours whose parents are the same, and at each further level of the tree.
SMOOTH, FADE = 1.6, 0.5


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    chrome: bool
    article: bool
    header: bool
    cost: float = 0.0
    chars: int = 0
    paid: float = 0.0


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    links: int = 0
    text: str = ""


def is_chrome(tag: str, attributes: str) -> bool:
    if tag in CHROME:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = values[0] or values[1] or values[2], name.lower()
        if name == "role" and value.strip().lower() in CHROME_ROLES:
            return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            return True
    return False


def name_cost(tag: str, attributes: str) -> float:
    """What an element's class and id speak against its blocks; those of an article or main only as much as a part."""
    cost = NAMED if tag == "form" else 0.0
    if not attributes or tag in ("html", "body"):
        return cost
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id") and tag != "main":
            for token in (values[0] or values[1] or values[2]).split():
                parts = [p.lower() in CHROME_NAMES for p in PIECE.findall(token)]
                if any(parts):
                    cost = max(cost, NAMED if all(parts) and tag != "article" else PARTLY)
    return cost


def weigh(blocks: list[Block]) -> None:
    """Sets what each node and its ancestors cost, by their shares of the text that no certain chrome holds."""
    total, nodes = 0, {}
    for b in blocks:
        n = 0 if b.node.chrome else len(b.text)
        total += n
        b.node.chars += n
        node = b.node
        while node and id(node) not in nodes:
            nodes[id(node)] = node
            node = node.parent
    order = sorted(nodes.values(), key=lambda x: x.depth)
    for node in reversed(order):
        if node.parent:
            node.parent.chars += node.chars
    for node in order:
        own = node.cost * min(1.0, 2 - 2 * node.chars / max(1, total))
        node.paid = own + (node.parent.paid if node.parent else 0.0)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with decoded, single-spaced text."""
    root = Node("", None, 0, False, False, False)
    top, out, now = root, [], Block(root)
    link_depth, at, n = 0, 0, len(page)

    def flush():
        nonlocal now
        raw = "".join(now.parts)
        now.text = SPACE.sub(" ", entities.unescape(raw)).strip()
        if now.text:
            out.append(now)
        now = Block(top)

    while at < n:
        lt = page.find("<", at)
        text = page[at : lt if lt >= 0 else n]
        if text:
            now.parts.append(text)
            if link_depth:
                now.links += len(text.strip())
        if lt < 0:
            break
        m = TOKEN.match(page, lt)
        if not m:  # a lone "<" is text
            now.parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"(?is)</{tag}\b[^>]*(?:>|\Z)").search(page, at)
                at = end.end() if end else n if tag in TO_END else at
        elif tag == "option":  # its end tag is optional, and it holds text only
            at = at if closing else max(page.find("<", at), 0) or n
        elif tag == "a":
            link_depth = max(0, link_depth + (-1 if closing else 1))
        elif tag == "br":
            now.parts.append(" ")
        elif tag in BLOCK:
            flush()
            if closing:
                node = top
                while node.parent and node.tag != tag:
                    node = node.parent
                if node.parent:
                    top = node.parent
            else:
                while top.tag == "p" or tag in SELF_CLOSING.get(top.tag, ()):
                    top = top.parent
                if tag not in VOID:
                    article = top.article or tag in ("article", "main") or "articlebody" in attributes.lower() or bool(re.search(r"(?i)role\s*=\s*[\"']?main\b", attributes))
                    top = Node(tag, top, top.depth + 1, top.chrome or is_chrome(tag, attributes), article, top.header or tag == "header", name_cost(tag, attributes))
                link_depth = 0
            now.node = top
        elif tag in ("label", "input"):
            now.parts.append(" ")
    flush()
    weigh(out)
    return out


def log_odds(b: Block) -> float:
    """For content, from the block's form, its ancestors and its names."""
    node = b.node
    heading = node.tag in HEADS
    w, n = WEIGHTS, len(b.text)
    share = min(1.0, b.links / max(1, n))
    return (
        w["bias"] - node.paid + w["article"] * node.article + w["log_chars"] * math.log(n) / 1.5 + w["sentence"] * bool(re.search(r"[.!?…。]\W*$", b.text))
        + w["link_share"] * share + w["paragraph"] * (node.tag in ("p", "pre", "blockquote")) + w["heading"] * heading + w["list_item"] * (node.tag in ("li", "td", "th"))
        + w["chrome"] * node.chrome + w["header"] * (node.header and not (node.article and (heading or node.tag == "p")))
    )


def distance(a: Node, b: Node) -> int:
    """Levels from the deeper node up to the common ancestor, less one."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return max(0, steps - 2)


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays with the source (content); Dinic's max-flow on blocks, symmetric edges."""
    n = len(source)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def add(a, b, x, y):
        head[a].append(len(to))
        to.append(b)
        cap.append(x)
        head[b].append(len(to))
        to.append(a)
        cap.append(y)

    for k in range(n):
        through = min(source[k], sink[k])  # the path source, block, sink is full from the start
        add(s, k, source[k] - through, 0.0)
        add(k, t, sink[k] - through, 0.0)
    for a, b, x in edges:
        add(a, b, x, x)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn, path = [0] * (n + 2), []
        at = s
        while True:
            if at == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                at = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[at] < len(head[at]):
                e = head[at][turn[at]]
                if cap[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(head[at]):
                path.append(head[at][turn[at]])
                at = to[path[-1]]
            elif at == s:
                break
            else:
                level[at] = -1
                at = to[path.pop() ^ 1]


def main_blocks(page: str | None) -> list[str]:
    """The page's content blocks, in page order."""
    blocks = blocks_of(page or "")
    odds = [log_odds(b) for b in blocks]
    source, sink = [max(0.0, o) for o in odds], [max(0.0, -o) for o in odds]
    edges = [(k, k + 1, SMOOTH * FADE ** distance(blocks[k].node, blocks[k + 1].node)) for k in range(len(blocks) - 1)]
    return [b.text for b, keep in zip(blocks, min_cut(source, sink, edges)) if keep]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars, blocks."""
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), text_of(pages[html_col]).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_blocks(x.as_py()) for x in batch.column(2)]
            texts = ["\n\n".join(x) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(len, found)), pa.int64())], names=[id_col, url_col, "text", "n_chars", "n_blocks"])

    return rows.mapInArrow(run, f"{field_ddl(rows, 'id', id_col)}, {field_ddl(rows, 'url', url_col)}, text string, n_chars bigint, n_blocks bigint")


def op3_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
