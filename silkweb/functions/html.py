"""Readable text and links of HTML pages, and the Arrow UDFs that read columns of them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.functions.batches import small_batches
from silkweb.functions.htmltree import Comment, Node, parse_html
from silkweb.functions.selectors import SelectorError, compile_selector, select
from silkweb.functions.urls import UrlError, parse

__all__ = ["Node", "SelectorError", "compile_selector", "discover_links", "discover_links_column", "extract_text", "extract_text_column", "links_of", "page_column", "parse_html", "select", "stripped", "text_of"]

_RAW = {"script", "style"}


# --- text and links ----------------------------------------------------------------------------------------------------

#: Characters that count as blanks in readable text.
BLANKS = "\u200b\u00a0\u2028\u2029\u202f\u00ad\u2060\ufeff"
#: What the web's regular expressions take for white space, once BLANKS are blanks.
SPACES = "\t\n\x0b\x0c\r \u1680\u2000-\u200a\u205f\u3000"
_NOT_PAGES = re.compile(r"(?i)(?:mailto|tel|javascript|data):")


def tidy(text: str) -> str:
    """Line feeds and odd blanks to spaces, escaped quotes plain, runs of white space one space, edges bare."""
    text = re.sub(r"\\(['\"\\])", r"\1", text.replace("\n", " "))
    text = re.sub(f"[{BLANKS}]", " ", text)
    text = re.sub(f"[{SPACES}]{{2,}}", " ", text)
    return re.sub(f"^[{SPACES}]+|[{SPACES}]+$", "", text)


def tidy_column(text: Column) -> Column:
    """``tidy`` in native expressions."""
    out = F.regexp_replace(F.translate(text, "\n", " "), r"\\(['\"\\])", "$1")
    out = F.regexp_replace(out, f"[{BLANKS}]", " ")
    out = F.regexp_replace(out, f"[{SPACES}]{{2,}}", " ")
    return F.regexp_replace(out, f"^[{SPACES}]+|[{SPACES}]+$", "")


def _texts(node: Node, gone: set[int], out: list[str]) -> None:
    stack = list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            if not isinstance(child, Comment):
                out.append(child)
        elif id(child) not in gone and child.tag not in _RAW and child.tag != "#content":
            stack.extend(reversed(child.children))


def _removed(root: Node, selectors: list[str]) -> set[int]:
    if not selectors:
        return set()
    return {id(n) for n in select(root, ",".join(selectors))}


def _under_removed(node: Node, gone: set[int]) -> bool:
    while node is not None:
        if id(node) in gone:
            return True
        node = node.parent
    return False


def text_of(page: Node, remove: list[str] = (), root: str | list[str] | None = None, fallback: str | None = "body") -> str:
    """Text of the elements that ``root`` selects, or the fallback where it selects none, without what ``remove`` does.

    Texts of nodes are parted by spaces, scripts and styles never read; nested roots give their text each.
    """
    gone = _removed(page, list(remove))

    def found(selector: str) -> list[Node]:
        return [n for n in select(page, selector) if not _under_removed(n, gone)]

    wanted = ",".join(root) if isinstance(root, (list, tuple)) else root
    roots = (found(wanted) if wanted else []) or found(fallback or "body")
    out: list[str] = []
    for element in roots:
        _texts(element, gone, out)
    return tidy(" ".join(out))


def stripped(page: Node, remove: list[str]) -> Node:
    """The page itself without comments and what ``remove`` selects; texts on either side stay apart."""
    gone = _removed(page, list(remove))
    for node in [page, *page.elements()]:
        node.children = [c for c in node.children if not isinstance(c, Comment) and id(c) not in gone]
    return page


def links_of(page: Node, base: str) -> list[str]:
    """Distinct absolute links of the anchors, in document order; links within the page and to no page are left out."""
    try:
        here = parse(base)
    except UrlError:
        here = None
    out: dict[str, None] = {}
    for node in page.elements():
        href = node.attrs.get("href") if node.tag == "a" else None
        if not href or href[0] == "#" or _NOT_PAGES.match(href):
            continue
        try:
            out[str(parse(href, here))] = None
        except (UrlError, UnicodeError):
            continue
    return list(out)


def extract_text(html: str, remove_selectors: list[str] = (), root: str | list[str] | None = None, root_fallback: str | None = "body") -> str:
    return text_of(parse_html(html), remove_selectors, root, root_fallback)


def discover_links(html: str, base: str) -> list[str]:
    return links_of(parse_html(html), base)


def extract_text_column(html: Column, remove_selectors: list[str] = (), root: str | list[str] | None = None, root_fallback: str | None = "body") -> Column:
    """Readable text of a column of pages; null pages give null. Selectors are checked here, before any row is read."""
    remove = list(remove_selectors)
    for s in [*remove, *([root] if isinstance(root, str) else root or []), *([root_fallback] if root_fallback else [])]:
        compile_selector(s)
    small_batches()

    @F.pandas_udf(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: None if h is None else extract_text(h, remove, root, root_fallback))

    return run(html)


def page_column(html: Column, base: Column, texts: list[dict]) -> Column:
    """struct<links, texts> of a column of pages, each parsed once: its links, and a text for each of ``texts``, which are
    arguments of ``extract_text``. Null pages have no links and null texts."""
    for t in texts:
        for s in [*t.get("remove_selectors", ()), t.get("root") or "body"]:
            compile_selector(s)
    small_batches()

    @F.pandas_udf(T.StructType().add("links", T.ArrayType(T.StringType())).add("texts", T.ArrayType(T.StringType())))
    def run(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        out = []
        for h, b in zip(pages, bases):
            page = None if h is None else parse_html(h)
            found = [None if page is None else text_of(page, t.get("remove_selectors", ()), t.get("root"), t.get("root_fallback", "body")) for t in texts]
            out.append(([] if page is None else links_of(page, b or ""), found))
        return pd.DataFrame(out, columns=["links", "texts"])

    return run(html, base)


def discover_links_column(html: Column, base: Column) -> Column:
    """Links of a column of pages; null pages have none."""
    small_batches()

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([discover_links(h or "", b or "") for h, b in zip(pages, bases)])

    return run(html, base)
