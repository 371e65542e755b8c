"""Main text of web pages: recurring subtrees and small parts named as boilerplate are removed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

# Loops are possessive, so neither a long tag nor an unbalanced quote makes the scan backtrack; a tag whose
# quotes do not close ends at its first ">".
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_HINT = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_WORD = re.compile(r"[a-z]+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "xmp", "noembed", "noframes"}
#: Elements whose content is no text of the page.
HIDDEN = RAW | {"head", "template", "select", "datalist", "iframe", "object", "svg", "canvas", "audio", "video"}
#: Elements that say they are not the article; evidence for small parts only, see ``_dropped``.
GONE = {"noscript", "nav", "menu", "footer", "aside", "form", "button", "dialog"}
#: Words in class, id or role that do the same.
NAMED = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
         "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "disqus", "footer", "gdpr", "masthead", "menu",
         "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "replies",
         "search", "share", "sharing", "sidebar", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget"}
BLOCK = {"address", "article", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption",
         "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section",
         "summary", "table", "caption", "tbody", "thead", "tfoot", "td", "th", "tr", "ul"} | GONE | HIDDEN
#: Pieces of a line: a block is deleted by elements that hold all of it, so these are hashed within their parents only.
INLINE = {"b", "i", "em", "strong", "a", "span", "u", "s", "code", "sub", "sup", "small", "q", "cite", "font", "mark"}
#: An article's own prose, which is never counted: articles share paragraphs and headings without any being a template.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption"}
#: Cells and items of an article's tables and lists, which are counted as wholes.
ITEMS = {"li", "dd", "dt", "td", "th", "tr", "caption"}
#: An open element of the first kind ends where one of the second kind begins.
ENDS = {"head": {"body"}, "p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
        "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
#: The same by the element that begins.
ENDED_BY = {tag: [t for t, later in ENDS.items() if tag in later] for tag in set().union(*ENDS.values())}
#: An open element is not closed from inside these.
FENCE = {"table", "td", "th", "ul", "ol", "dl", "div", "section", "article", "main", "body", "html", "button", "aside", "nav", "footer",
         "header", "form"}


def _named(tag: str, attributes: str) -> bool:
    if tag in ("html", "body", "article", "main") or "=" not in attributes:
        return False
    for kind, *values in _HINT.findall(attributes):
        words = _WORD.findall("".join(values).lower())
        if any(w in NAMED for w in words):
            return True
    return False


class _Node:
    __slots__ = ("parent", "tag", "hidden", "article", "mark", "digest", "inner", "size", "holds", "drop")

    def __init__(self, parent, tag, hidden, article, mark):
        self.parent, self.tag, self.hidden, self.article, self.mark = parent, tag, hidden, article, mark
        self.digest, self.inner, self.size, self.holds, self.drop = None, [], 0, tag in ("article", "main"), None


def _dropped(root: _Node, blocks: list) -> list:
    """Blocks left when the parts named as boilerplate are out.

    A name counts only for a part that holds no article or main element and at most half of the page's text.
    Class words are the weaker evidence: where the parts they name hold over half of the text together, they
    count for nothing. A page never loses all its blocks to names.
    """
    def leaving(marks):
        for node in nodes:  # parents come before their children
            small = not node.holds and 2 * node.size <= root.size
            node.drop = (node.parent is not None and node.parent.drop) or (node.mark in marks and small)
        return [b for b in blocks if not b[1].drop]

    nodes, seen = [], set()
    for _, owner in blocks:
        line = []
        while owner is not None and owner not in seen:
            seen.add(owner)
            line.append(owner)
            owner = owner.parent
        nodes += reversed(line)
    left = leaving({"tag", "class"})
    by_class = sum(n.size for n in nodes if n.drop and n.mark == "class" and not n.parent.drop)
    if 2 * by_class > root.size:
        left = leaving({"tag"})
    return left or blocks


def parse(html: str | None) -> tuple[list[tuple[str, bool, int]], list[tuple[int, int, bool]]]:
    """Blocks (text, inside an article, node) in page order, and nodes (hash, parent, counted), parents first.

    One scan builds the open elements as a stack. Hashes cover tag names and texts of whole subtrees, bottom
    up, whatever their names. A node stands once, with a link to the one around it (-1: none), so a page's result
    and time grow with its length however deep it is. Small parts named as boilerplate are left out. Counted are
    elements that can hold a template: not a line's pieces, not an article's own prose, cells and items.
    """
    from xxhash import xxh64_intdigest

    html = html or ""
    root = _Node(None, "", False, False, None)
    stack, blocks, pending = [root], [], []
    owner = None
    # where the open elements of each name stand in the stack, and the fences among them
    open_at, fences = {}, [0]

    def flush():
        nonlocal pending, owner
        if pending:
            text = "".join(pending)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((text, owner))
        pending, owner = [], None

    def say(text):
        nonlocal owner
        top = stack[-1]
        if not top.hidden:
            if owner is None:
                owner = top
            pending.append(text)
            text = " ".join(text.split())
            top.inner.append(text)
            top.size += len(text)

    def pop():
        node = stack.pop()
        open_at[node.tag].pop()
        if node.tag in FENCE:
            fences.pop()
        if node.tag in BLOCK:
            flush()
        if not node.hidden:
            node.digest = xxh64_intdigest(f"<{node.tag}>" + "\x1f".join(x if isinstance(x, str) else f"{x:x}" for x in node.inner))
            above = stack[-1]
            above.inner.append(node.digest)
            above.size += node.size
            above.holds = above.holds or node.holds

    at = 0
    size = len(html)
    while at < size:
        found = _TAG.search(html, at)
        if found is None:
            say(html[at:])
            break
        if found.start() > at:
            say(html[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if closing:
            depth = open_at[tag][-1] if open_at.get(tag) else 0
            if depth and (tag in FENCE or depth >= fences[-1]):
                while len(stack) > depth:
                    pop()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        depth = max((open_at[t][-1] for t in ENDED_BY.get(tag, ()) if open_at.get(t)), default=0)
        if depth and depth >= fences[-1]:
            while len(stack) > depth:
                pop()
        if tag in BLOCK:
            flush()
        top = stack[-1]
        article = top.article or tag in ("article", "main")
        mark = "tag" if tag in GONE or (tag == "header" and not article) else "class" if _named(tag, attributes) else None
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            close = html.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else size
            continue
        if not attributes.rstrip().endswith("/") or tag in BLOCK:
            open_at.setdefault(tag, []).append(len(stack))
            if tag in FENCE:
                fences.append(len(stack))
            stack.append(_Node(top, tag, top.hidden or tag in HIDDEN, article, mark))
    while len(stack) > 1:
        pop()
    flush()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    out, places, nodes = [], {root: -1}, []
    for text, node in _dropped(root, blocks):
        line = []
        while node not in places:
            line.append(node)
            node = node.parent
        for one in reversed(line):
            counted = one.tag not in INLINE and one.tag not in ("html", "body", "article", "main") and not (one.article and one.tag in PROSE | ITEMS)
            places[one] = len(nodes)
            nodes.append((signed(one.digest), places[one.parent], counted))
        owner = line[0] if line else node
        out.append((text, owner.article, places[owner]))
    return out, nodes


def site(url: str) -> Column:
    """Host of a URL, lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


PAGE = ("row long, page_id {key}, url {url}, host string, blocks array<struct<text: string, article: boolean, node: int>>, "
        "nodes array<struct<digest: long, parent: int, counted: boolean>>")


def page_blocks(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(row, page_id, url, host, blocks, nodes): the parsed blocks of every page and the elements around them."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block = pa.list_(pa.struct([("text", pa.string()), ("article", pa.bool_()), ("node", pa.int32())]))
        around = pa.list_(pa.struct([("digest", pa.int64()), ("parent", pa.int32()), ("counted", pa.bool_())]))
        for batch in batches:
            parsed = [parse(x.as_py()) for x in batch.column(4)]
            blocks = pa.array([[{"text": t, "article": a, "node": n} for t, a, n in found] for found, _ in parsed], block)
            nodes = pa.array([[{"digest": d, "parent": p, "counted": c} for d, p, c in own] for _, own in parsed], around)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], blocks, nodes], ["row", "page_id", "url", "host", "blocks", "nodes"])

    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("page_id"), F.col(url).alias("url"),
                        site(url).alias("host"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, PAGE.format(key=kinds[key], url=kinds[url]))


def _subtrees() -> Column:
    return F.array_distinct(F.transform(F.filter("nodes", lambda n: n["counted"]), lambda n: n["digest"]))


def left_text(blocks: list[dict], nodes: list[dict], template: set[int]) -> str:
    """The blocks under no deleted element; those inside articles alone, if there are any."""
    gone = []
    for n in nodes:  # parents come first
        gone.append((n["parent"] >= 0 and gone[n["parent"]]) or (n["counted"] and n["digest"] in template))
    kept = [b for b in blocks if b["node"] < 0 or not gone[b["node"]]]
    return "\n".join(b["text"] for b in [b for b in kept if b["article"]] or kept)


def recurring_subtrees(blocks: DataFrame, min_pages: int = 5, min_share: float = 0.01) -> DataFrame:
    """(host, subtree): hashes that stand on at least ``min_pages`` pages and ``min_share`` of their host's pages.

    Pages of a host with the same blocks are one page here: copies of a page do not make a template of it.
    """
    pages = blocks.select("host", F.xxhash64("blocks").alias("page"), _subtrees().alias("own")).dropDuplicates(["host", "page"])
    marks = pages.select("host", F.explode("own").alias("subtree")).groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages"))
    marks = marks.where(F.col("pages") >= min_pages)
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    return marks.join(hosts, "host").where(F.col("pages") >= F.col("all") * min_share).select("host", "subtree")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = 5, min_share: float = 0.01) -> DataFrame:
    """(page_id, url, text, n_chars) for every page, by site template removal.

    All subtrees of more than a line's piece are hashed and counted per host in Spark; those that recur on many
    pages of their host are deleted, whole containers inside articles too. An article's own paragraphs and
    headings are never counted, and its cells and items go with their tables and lists only. Small parts that
    say what they are (tags and class, id or role words) go without a count, but names never delete an article
    or main element or most of a page's text. Where a page marks an article or main element, only that is its
    text; else what is left of the page.

    White space in a block becomes one space, character references are decoded, blocks are joined by a line
    feed. Null or empty HTML gives an empty text; a null URL counts as a host of its own, and pages without a
    host are one. Repeated rows give repeated results. Other columns are not read.
    """
    blocks = stored(page_blocks(pages, key, url, html), "page-blocks")
    recurring = stored(recurring_subtrees(blocks, min_pages, min_share), "templates")
    touched = blocks.select("row", "host", F.explode(_subtrees()).alias("subtree")).join(recurring, ["host", "subtree"])
    # a list per page, of subtrees that this page itself holds
    marks = stored(touched.groupBy("row").agg(F.collect_set("subtree").alias("template")), "page-templates")

    kinds = dict(blocks.dtypes)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            columns = (batch.column(i) for i in (2, 3, 4))
            texts = [left_text(b.as_py(), n.as_py(), set(t.as_py() or ())) for b, n, t in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = blocks.join(marks, "row", "left").select("page_id", "url", "blocks", "nodes", "template")
    text = joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
