"""The most specific rule for a URL, as CASE chains that the driver builds: site overrides and output routes."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from silkweb.functions.patterns import Pattern, compile_pattern, matches, matches_any
from silkweb.functions.urls import path_prefixes


def most_specific(url: Column, patterns: list[tuple[Pattern, object]]) -> Column:
    """Value of the longest pattern that fits, of equally long ones the first; null where none does."""
    ranked = sorted(patterns, key=lambda x: -compile_pattern(x[0]).length)
    if not ranked:
        return F.lit(None)
    chain = F.when(matches(url, ranked[0][0]), F.lit(ranked[0][1]))
    for pattern, value in ranked[1:]:
        chain = chain.when(matches(url, pattern), F.lit(value))
    return chain


def site_rule(url: Column, sites: list[Mapping]) -> Column:
    """Position of the site whose pattern fits most specifically, -1 where none does."""
    rules = [(pattern, k) for k, site in enumerate(sites) for pattern in site["match"]]
    return F.coalesce(most_specific(url, rules).cast("int"), F.lit(-1))


def effective(config: Mapping, rule: int) -> dict:
    """Content types and extraction of a site rule, over those of all."""
    site = config["sites"][rule] if rule >= 0 else {}
    types = site.get("allowed_content_types")
    return {"allowed_content_types": config["allowed_content_types"] if types is None else types, "extract": {**config["extract"], **(site.get("extract") or {})}}


def route(url: Column, routes: Mapping[str, Mapping[str, str]], exclude: list[Pattern] = (), directory: str = "") -> Column:
    """Output file of a URL, null where none takes it.

    The longest fitting route alone decides: in it the longest leading run of path segments that it names, else ``*``.
    """
    prefixes = path_prefixes(url)
    out = F.lit(None).cast("string")
    for pattern in sorted(routes, key=lambda p: compile_pattern(p).length):
        files = {k: posixpath.normpath(posixpath.join(directory, v)) for k, v in routes[pattern].items() if v}
        for f in files.values():
            if f.startswith("..") or (directory and not f.startswith(posixpath.normpath(directory) + "/")):
                raise ValueError(f"route leaves the output directory: {f}")
        named = {k: v for k, v in files.items() if k != "*"}
        here = F.lit(files.get("*")).cast("string")
        if named:
            pairs = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])
            here = F.coalesce(F.try_element_at(F.filter(F.transform(prefixes, lambda p: F.try_element_at(pairs, p)), lambda f: f.isNotNull()), F.lit(1)), here)
        out = F.when(matches(url, pattern), here).otherwise(out)
    return F.when(~matches_any(url, exclude), out)
