"""HTML columns to text, structure, links and metadata, all in JVM expressions.

Comments, scripts and styles are cut out first, so markup inside them never
counts; script and style text is not part of the body text.
"""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip

_NOISE = r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)"
# Every loop is possessive: a repeated alternation that may give back recurses for each turn and overflows on
# long tags. A tag whose quotes do not close ends at its first ">".
_ATTRS = r"""(?:[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+(?=>)|[^>]*+)"""
_TAG = rf"""</?[A-Za-z]{_ATTRS}>|<[!?][^>]*+>"""
_MARK = "\u0001"

# Counted elements.
COUNTED = {
    "h1": "h1", "h2": "h2", "h3": "h3", "h4_h6": "h[456]", "paragraphs": "p", "lists": "[uo]l", "list_items": "li",
    "links": "a", "images": "img", "tables": "table", "forms": "form", "divs": "div", "spans": "span",
}


def unescape(text: Column) -> Column:
    """Character references to characters (the full HTML table of the standard library)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _html.unescape(t) if t is not None and "&" in t else t)

    return run(text)


def unescape_all(texts: Column) -> Column:
    """``unescape`` for every element of an array."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda own: own if own is None else [_html.unescape(t) if t is not None and "&" in t else t for t in own])

    return run(texts)


def clean(html: Column) -> Column:
    return F.regexp_replace(html, _NOISE, "")


def _plain(fragment: Column) -> Column:
    """Text nodes of a fragment, still with character references."""
    return F.regexp_replace(F.regexp_replace(fragment, _TAG, _MARK), f"{_MARK}+", "")


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute; null when absent, empty when it has no value."""
    found = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(found), value).when(tag.rlike(rf"(?i)\s{name}[\s>/]"), "")


def html_text(df: DataFrame, html: str = "html") -> DataFrame:
    """Body text (whole document without a body): text nodes joined by blanks, lines trimmed, empty ones dropped."""
    source = clean(F.col(html))
    inner = F.regexp_extract(source, rf"(?is)<body\b{_ATTRS}>(.*?)(?:</body\s*>|\z)", 1)
    body = F.when(source.rlike(r"(?i)<body[\s>]"), inner).otherwise(source)
    spaced = F.regexp_replace(F.regexp_replace(body, _TAG, _MARK), f"{_MARK}+", " ")
    lines = F.filter(F.transform(F.split(F.col("text"), r"\r?\n"), strip), lambda v: v != "")
    return df.withColumn("text", unescape(spaced)).withColumn("text", F.array_join(lines, "\n"))


def html_structure(df: DataFrame, html: str = "html") -> DataFrame:
    """Element counts, title, and ``headings`` as array of (level, text)."""
    source = F.col("_clean")
    counts = [F.regexp_count(source, F.lit(rf"(?i)<{tag}[\s/>]")).alias(name) for name, tag in COUNTED.items()]
    found = F.regexp_extract_all(source, F.lit(r"(?is)<h[1-6](?:\s[^>]*)?>.*?(?=</h[1-6]|<h[1-6][\s>]|\z)"), F.lit(0))
    texts = F.transform(unescape_all(F.transform(found, _plain)), strip)
    levels = F.transform(found, lambda h: F.substring(h, 3, 1).cast("int"))
    headings = F.filter(
        F.zip_with(levels, texts, lambda n, t: F.struct(n.alias("level"), t.alias("text"))), lambda h: h["text"] != "")
    return df.withColumn("_clean", clean(F.col(html))).select(
        *[c for c in df.columns if c != html], *counts, title(source).alias("title"), headings.alias("headings")
    )


def title(source: Column) -> Column:
    text = strip(unescape(F.regexp_extract(source, r"(?is)<title(?:\s[^>]*)?>(.*?)</title", 1)))
    return F.when(text != "", text)


def html_headings(df: DataFrame, html: str = "html") -> DataFrame:
    """One row per heading: position, level, text."""
    rest = [c for c in df.columns if c != html]
    return html_structure(df, html).select(*rest, F.posexplode("headings").alias("position", "h")).select(
        *rest, "position", F.col("h.level").alias("level"), F.col("h.text").alias("text")
    )


def html_links(df: DataFrame, html: str = "html") -> DataFrame:
    """One row per ``a`` with href: position, href, text or ``(no text)``."""
    source = clean(F.col(html))
    found = F.regexp_extract_all(source, F.lit(rf"(?is)<a(\s{_ATTRS})>(.*?)(?=</a\s*>|<a[\s>]|\z)"), F.lit(0))
    rest = [c for c in df.columns if c != html]
    tag = F.regexp_extract("_a", rf"(?is)^<a(\s{_ATTRS}>)", 1)
    parts = df.select(*rest, F.posexplode(found).alias("position", "_a")).select(
        *rest, "position", unescape(_attribute(tag, "href")).alias("href"), strip(unescape(_plain(F.col("_a")))).alias("_t")
    )
    return parts.filter(F.col("href").isNotNull()).select(
        *rest, "position", "href", F.when(F.col("_t") == "", "(no text)").otherwise(F.col("_t")).alias("text")
    )


def _metas(source: Column) -> Column:
    """Array of (name, content), decoded: meta tags by name, property or http-equiv, then ``title`` and ``lang``."""
    tags = F.regexp_extract_all(source, F.lit(rf"(?is)<meta(\s{_ATTRS})>"), F.lit(0))
    names = F.transform(tags, lambda m: F.coalesce(_attribute(m, "name"), _attribute(m, "property"), _attribute(m, "http-equiv")))
    contents = F.transform(tags, lambda m: _attribute(m, "content"))
    page_title = strip(F.regexp_extract(source, r"(?is)<title(?:\s[^>]*)?>(.*?)</title", 1))
    root = F.regexp_extract(source, rf"(?is)<html(\s{_ATTRS}>)", 1)
    own = F.array(F.when(page_title != "", page_title), _attribute(root, "lang"))
    pairs = F.zip_with(
        F.concat(names, F.array(F.lit("title"), F.lit("lang"))), unescape_all(F.concat(contents, own)),
        lambda n, c: F.struct(n.alias("name"), c.alias("content")))
    return F.filter(pairs, lambda p: p["name"].isNotNull() & p["content"].isNotNull())


def html_metadata(df: DataFrame, html: str = "html") -> DataFrame:
    """Rows (name, content): meta tags by name, property or http-equiv, then ``title`` and ``lang``."""
    rest = [c for c in df.columns if c != html]
    found = df.withColumn("_clean", clean(F.col(html))).select(*rest, _metas(F.col("_clean")).alias("_all"))
    return found.select(*rest, F.posexplode("_all").alias("position", "_p")).select(*rest, "position", "_p.name", "_p.content")


MODES = {"text": html_text, "structure": html_structure, "links": html_links, "metadata": html_metadata}


def html_analyze(df: DataFrame, mode: str = "all", html: str = "html", key: str = "page_id") -> DataFrame:
    """One mode, or ``all``: text, counts, title, headings, links (``link_list``) and ``metas`` in one pass, all decoded."""
    if mode in MODES:
        return MODES[mode](df, html)
    if mode != "all":
        raise ValueError(f"unknown mode: {mode}")
    source = F.col("_clean0")
    kept = df.withColumn("_clean0", clean(F.col(html)))
    found = F.regexp_extract_all(source, F.lit(rf"(?is)<a(\s{_ATTRS})>(.*?)(?=</a\s*>|<a[\s>]|\z)"), F.lit(0))
    hrefs = F.transform(found, lambda a: _attribute(F.regexp_extract(a, rf"(?is)^<a(\s{_ATTRS}>)", 1), "href"))
    texts = F.transform(unescape_all(F.transform(found, _plain)), strip)
    links = F.zip_with(unescape_all(hrefs), texts, lambda h, t: F.struct(h.alias("href"), F.when(t == "", "(no text)").otherwise(t).alias("text")))
    lang = _attribute(F.regexp_extract(source, rf"(?is)<html(\s{_ATTRS}>)", 1), "lang")
    with_links = kept.select(
        *df.columns, F.filter(links, lambda x: x["href"].isNotNull()).alias("link_list"), _metas(source).alias("metas"), lang.alias("lang")
    )
    texted = html_text(with_links, html)
    return html_structure(texted, html)
