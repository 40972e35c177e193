"""Sitemaps and sitemap indexes, read tolerantly."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.functions.batches import small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([^\s/>]+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?|([^<]+)", re.S)


def parse_sitemap(xml: str) -> tuple[list[str], list[str]]:
    """(sitemaps, urls): locations under ``sitemap`` and ``url`` elements; of a file with neither, all locations."""
    found: list[tuple[str | None, str]] = []
    open_tags: list[str] = []
    texts: list[tuple[int, str | None, list[str]]] = []  # of open locations: depth, parent, text
    for m in _TOKEN.finditer(xml):
        cdata, closing, tag, rest, text = m.groups()
        if text is not None or cdata is not None:
            for loc in texts:
                loc[2].append(cdata if cdata is not None else unescape(text))
        elif tag is None:
            continue
        elif closing:
            if tag in open_tags:
                del open_tags[len(open_tags) - 1 - open_tags[::-1].index(tag) :]
            while texts and texts[-1][0] >= len(open_tags):
                _, parent, parts = texts.pop()
                found.append((parent, "".join(parts).strip()))
        else:
            parent = open_tags[-1] if open_tags else None
            if tag == "loc":
                texts.append((len(open_tags), parent, []))
            open_tags.append(tag)
            if rest.endswith("/"):
                open_tags.pop()
                if tag == "loc":
                    texts.pop()
    found.extend((parent, "".join(parts).strip()) for _, parent, parts in texts)
    sitemaps = [t for parent, t in found if parent == "sitemap" and t]
    urls = [t for parent, t in found if parent == "url" and t]
    if not sitemaps and not urls:
        urls = [t for _, t in found if t]
    return sitemaps, urls


@F.pandas_udf(T.StructType().add("sitemaps", T.ArrayType(T.StringType())).add("urls", T.ArrayType(T.StringType())))
def _parse_sitemap_udf(files: pd.Series) -> pd.DataFrame:
    made = [parse_sitemap(x or "") for x in files]
    return pd.DataFrame({"sitemaps": [m[0] for m in made], "urls": [m[1] for m in made]})


def parse_sitemap_column(xml: Column) -> Column:
    """struct<sitemaps, urls> of a column of files."""
    small_batches()
    return _parse_sitemap_udf(xml)
