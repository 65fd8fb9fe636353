"""Main text of web pages by site style trees (Yi, Liu and Li 2003).

The DOMs of the pages of one host are merged: pages that show an element with the same sequence of child tags share a
style node, and below it the children share element nodes.  An element seen on m pages with l styles of shares p has the
presentation importance 1 if m = 1, else -sum p log_m p; a text node has the content importance 1 minus the mean entropy of
its sentences over the N pages of the site, log n / log N for one on n of them.  An element's composite importance is
(1 - g^l) times its own plus g^l times the p-weighted mean of its styles' children.  From each page the branches of
less importance than THRESHOLD are removed, and the text of the others is returned.

Since the weights sum to one, 1 - importance is linear in the tree and 0 where m = 1: only nodes that pages share take
part.  Each node's sum over its descendants is found by doubling: a node knows its ancestor 1, 2, 4, ... levels up and the
product of the weights between, so that a tree of depth D takes log D joins of all nodes at once, and no driver loop by level.

Defined results: a null or empty page has an empty text; pages of a null or malformed URL and of hosts with fewer than
MIN_PAGES different pages are merged with none and lose nothing; equal pages of a host count once; rows that repeat a page
are extracted each for itself; a null page_id stays null; markup that is not closed ends with its parent, text outside any
tag counts as a paragraph; an empty table has no rows.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfeat.llm.shared import read, written

DAMPING, THRESHOLD, MIN_PAGES = 0.9, 0.65, 2
LOCAL_NODES = 2_000_000  # nodes to remove that tasks hold themselves; beyond, they are joined with the nodes of the pages

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_CLASS = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HOST = re.compile(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_SENTENCE = re.compile(r"[.!?;\n·|]+")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe"}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - {"body", "html"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "body", "nav"}


class Node:
    __slots__ = ("tag", "label", "children", "text")

    def __init__(self, tag: str, label: str, text: str = ""):
        self.tag, self.label, self.text, self.children = tag, label, text, []


def parse(html: str) -> Node:
    """The tree of what a browser shows of the body; text nodes have the tag ``#text``."""
    root = Node("body", "body")
    stack = [root]
    pos, n, lower = 0, len(html), None
    while pos < n:
        m = _TOKEN.match(html, pos)
        if m is None:
            break
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            piece = m.group()
            if piece[0] == "<" and len(piece) > 1:
                continue
            if piece.strip():
                last = stack[-1].children
                if last and last[-1].tag == "#text":
                    last[-1].text += piece
                else:
                    last.append(Node("#text", "#text", piece))
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _RAW or tag == "head":
            lower = html.lower() if lower is None else lower
            end = lower.find("</" + tag, pos)
            pos = n if end < 0 else n if html.find(">", end) < 0 else html.find(">", end) + 1
            continue
        if tag in ("html", "body"):
            continue
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in _SIBLING:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _SIBLING[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE:
                    break
        marks = " ".join(x for g in _CLASS.findall(m.group(3)) for x in g if x) if m.group(3) else ""
        node = Node(tag, f"{tag}.{marks}" if marks else tag)
        stack[-1].children.append(node)
        if tag not in _VOID and not m.group(3).endswith("/"):
            stack.append(node)
    return root


def _key(*parts: object) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else None


def walk(root: Node, host: str) -> Iterator[tuple[Node, int, int, int, int]]:
    """(node, key, style of the parent, own style, depth); 0 is no style.  Iterative, for any depth."""
    todo = [(root, _key(host), 0, 0)]
    while todo:
        node, key, above, depth = todo.pop()
        style = _key(key, *(c.label for c in node.children)) if node.children else 0
        yield node, key, above, style, depth
        todo += [(c, _key(style, j), style, depth + 1) for j, c in enumerate(node.children)]


def sentences(text: str) -> set[str]:
    return {s for s in (" ".join(x.split()) for x in _SENTENCE.split(unescape(text).lower())) if s}


_NODES = "site long, key long, above long, style long, children int, depth int, text boolean, n long"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: how many pages have each (element, style), and each (text node, sentence)."""
    for batch in batches:
        nodes: Counter = Counter()
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host = host_of(url)
            if host is None or not html:
                continue
            site = _key(host)
            for node, key, above, style, depth in walk(parse(html), host):
                if node.tag == "#text":
                    nodes[site, key, above, 0, 0, depth, True] += 1
                    for s in sentences(node.text):
                        nodes[site, key, 0, _key(s), -1, 0, True] += 1
                else:
                    nodes[site, key, above, style, len(node.children), depth, False] += 1
        if nodes:
            columns = [*zip(*nodes, strict=True), list(nodes.values())]
            kinds = (pa.int64(),) * 4 + (pa.int32(),) * 2 + (pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["site", "key", "above", "style", "children", "depth", "text", "n"])


def importance(pages: DataFrame, damping: float = DAMPING, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, key, importance) of the nodes that two or more pages of a site share."""
    # equal pages of a host count once: the html itself stays where it is, only hashes are grouped
    known = pages.filter("url is not null and html is not null").select("url", "html", F.lower(F.regexp_extract("url", _HOST.pattern, 1)).alias("host"), F.xxhash64("html").alias("_h"))
    twin = known.groupBy("host", "_h").agg(F.count("*").alias("c")).filter("c > 1").select("host", "_h")
    same = written(twin)
    if not same.isEmpty():
        extra = same.count() <= LOCAL_NODES
        dup = known.join(F.broadcast(same) if extra else same, ["host", "_h"], "left_semi").groupBy("host", "_h").agg(F.min(F.struct("url", "html")).alias("r"))
        known = known.join(F.broadcast(same) if extra else same, ["host", "_h"], "left_anti").select("url", "html").union(dup.select("r.url", "r.html"))
    rows = known.select("url", "html").mapInArrow(_merge, _NODES)
    rows = written(rows.groupBy("site", "key", "above", "style", "children", "depth", "text").agg(F.sum("n").alias("n")))
    sites = rows.filter("depth = 0 and children >= 0").groupBy("site").agg(F.sum("n").alias("pages")).filter(F.col("pages") >= min_pages)
    own = rows.filter("children >= 0")
    n = F.col("n").cast("double")
    elements = own.groupBy("site", "key", "above", "depth", "text").agg(F.sum(n).alias("m"), F.sum(n * F.log(n)).alias("s"), F.count("*").alias("l")).filter("m > 1")
    said = rows.filter("children = -1").groupBy("key").agg(F.sum(n).alias("said"), F.sum(n * F.log(n)).alias("entropy"))
    elements = elements.join(sites, "site").join(said, "key", "left")
    damp = F.pow(F.lit(damping), F.col("l"))
    shown = (F.log("m") - F.col("s") / F.col("m")) / F.log("m")
    lack = F.when(F.col("text"), F.coalesce(F.col("entropy") / F.col("said") / F.log(F.col("pages").cast("double")), F.lit(1.0))).otherwise((1 - damp) * (1 - shown))
    elements = written(elements.select("site", "key", "above", "depth", "m", damp.alias("damp"), lack.alias("lack")))
    # what a child adds to its parent's lack, by the style that they share
    styles = own.filter("children > 0").select("key", F.col("style").alias("above"), n.alias("c"), "children").join(elements.select("key", "m", "damp"), "key")
    up = styles.select("above", F.col("key").alias("parent"), (F.col("damp") * F.col("c") / F.col("m") / F.col("children")).alias("share"))
    nodes = written(elements.join(up, "above", "left").select("site", "key", "depth", "lack", "parent", "share"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    total = nodes.select("site", "key", "lack")
    up = written(nodes.filter("parent is not null").select("key", F.col("parent").alias("to"), F.col("share").alias("by")))
    for _ in range(int(deepest).bit_length()):
        # the descendants less than twice as far: those of the node 2^k below as well
        more = up.join(total, "key").groupBy(F.col("to").alias("key")).agg(F.sum(F.col("by") * F.col("lack")).alias("more"))
        total = written(total.join(more, "key", "left").select("site", "key", (F.col("lack") + F.coalesce("more", F.lit(0.0))).alias("lack")))
        above = up.select(F.col("key").alias("to"), F.col("to").alias("to2"), F.col("by").alias("by2"))
        up = written(up.join(above, "to").select("key", F.col("to2").alias("to"), (F.col("by") * F.col("by2")).alias("by")))
    return total.select("site", "key", F.round(1 - F.col("lack"), 9).alias("importance"))


def text_of(root: Node, host: str | None, noise: Callable[[int], bool]) -> tuple[str, int]:
    """(text of the branches that stay, number of branches removed)."""
    out: list[str] = []
    removed = 0
    todo: list[tuple] = [(root, _key(host) if host else 0)]
    while todo:
        node, key = todo.pop()
        if node is None:
            out.append("\n")
            continue
        if host and node is not root and noise(key):
            removed += 1
            continue
        if node.tag == "#text":
            out.append(re.sub(r"\s+", " ", unescape(node.text)))
            continue
        if node.tag in _BLOCK or node.tag == "br":
            out.append("\n")
            todo.append((None, 0))
        style = _key(key, *(c.label for c in node.children)) if host and node.children else 0
        todo += [(c, _key(style, j) if host else 0) for j, c in reversed(list(enumerate(node.children)))]
    lines = (line.strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), removed


_TEXT = "page_id long, host string, text string, removed int"


def _extract(find: Callable[[pa.RecordBatch], Iterator[Callable[[int], bool]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = [host_of(u) for u in batch.column(1).to_pylist()]
            done = [text_of(parse(html or ""), host, noise) for host, html, noise in zip(hosts, batch.column(2).to_pylist(), find(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hosts, pa.string()), pa.array([t for t, _ in done], pa.string()), pa.array([r for _, r in done], pa.int32())], ["page_id", "host", "text", "removed"])

    return run


def main_text(pages: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """(page_id, host, text, removed) of every row."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    noise = written(importance(pages, damping, min_pages).filter(F.col("importance") < threshold).select("site", "key"))
    if noise.count() <= local_nodes:
        keys = frozenset(np.asarray(noise.select("key").toArrow()["key"]).tolist())
        return pages.mapInArrow(_extract(lambda batch: (keys.__contains__ for _ in range(len(batch)))), _TEXT)
    row = F.sha2(F.concat_ws("\x1f", "url", "html"), 256)
    own = pages.filter("url is not null and html is not null").select(row.alias("row"), "url", "html").mapInArrow(_keys, "row string, key long").distinct()
    by_row = own.join(noise.select("key").hint("merge"), "key", "left_semi").groupBy("row").agg(F.collect_list("key").alias("noise"))  # nodes of one page
    joined = pages.withColumn("row", row).join(by_row.hint("merge"), "row", "left").select("page_id", "url", "html", "noise")
    return joined.mapInArrow(_extract(lambda batch: (frozenset(x or ()).__contains__ for x in batch.column(3).to_pylist())), _TEXT)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, key) of the nodes of each page."""
    for batch in batches:
        at, keys = [], []
        for r, (url, html) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            host = host_of(url)
            if host is not None and html:
                own = {key for _, key, *_ in walk(parse(html), host)}
                at += [r] * len(own)
                keys += own
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.int64())], ["row", "key"])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))
