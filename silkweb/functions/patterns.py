"""URL patterns: regular expressions, URL prefixes and substrings, compiled once into boolean Columns.

A pattern is a Python ``re.Pattern``, or a string: ``/source/flags`` is a regular expression, ``http(s)://…`` a URL
prefix by origin and whole path segments, and any other string a substring.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.functions import urls
from silkweb.functions.jspattern import JsPatternError, translated

Pattern = str | re.Pattern


class PatternError(ValueError):
    """The pattern can't be compiled."""


@lru_cache(maxsize=512)
def _python(text: str):
    """The twin of what Java runs."""
    return regex.compile(text, regex.V0)


def _searched(text: str):
    """The test of a column by Python's engine."""

    @F.pandas_udf(T.BooleanType())
    def run(values: pd.Series) -> pd.Series:
        found = _python(text)
        return pd.Series([None if v is None else found.search(v) is not None for v in values], dtype=object)

    return run


@dataclass(frozen=True)
class Compiled:
    kind: str
    text: str
    #: Length by which the most specific pattern is found; of a regular expression with slashes and flags.
    length: int
    #: The expression for Java's engine, None where only Python's can run it.
    java: str | None = None

    def test(self, value: str) -> bool:
        if self.kind == "regex":
            return _python(self.text).search(value) is not None
        if self.kind == "substring":
            return self.text in value
        try:
            prefix, url = urls.parse(self.text if self.text.endswith("/") else self.text + "/"), urls.parse(value)
        except urls.UrlError:
            return value.startswith(self.text)
        path = prefix.path.removesuffix("/")
        return prefix.origin == url.origin and (not path or url.path == path or url.path.startswith(path + "/"))

    def column(self, value: Column) -> Column:
        """The same test over a column of canonical URLs."""
        if self.kind == "regex":
            return _searched(self.text)(value) if self.java is None else value.rlike(self.java)
        if self.kind == "substring":
            return value.contains(self.text)
        try:
            prefix = urls.parse(self.text if self.text.endswith("/") else self.text + "/")
        except urls.UrlError:
            return value.startswith(self.text)
        path = prefix.path.removesuffix("/")
        same = urls.origin_of(value) == prefix.origin
        here = urls.path_of(value)
        return same & ((here == path) | here.startswith(path + "/")) if path else same


def compile_pattern(pattern: Pattern) -> Compiled:
    """Raises PatternError for what isn't a pattern or doesn't compile, before any row is read."""
    if isinstance(pattern, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if pattern.flags & bit)
        text = (f"(?{flags})" if flags else "") + pattern.pattern
        return Compiled("regex", text, len(pattern.pattern) + 2 + len(flags), text)
    if not isinstance(pattern, str):
        raise PatternError(f"not a pattern: {pattern!r}")
    end = pattern.rfind("/")
    if pattern.startswith("/") and end > 0:
        try:
            text, java = translated(pattern[1:end], pattern[end + 1 :])
            _python(text)
        except (JsPatternError, regex.error) as e:
            raise PatternError(f"{pattern!r}: {e}") from None
        return Compiled("regex", text, len(pattern), java)
    if pattern.startswith(("http://", "https://")):
        return Compiled("prefix", pattern, len(pattern))
    return Compiled("substring", pattern, len(pattern))


def matches_pattern(value: str, pattern: Pattern) -> bool:
    return compile_pattern(pattern).test(value)


def matches_any_pattern(value: str, patterns: list[Pattern] = ()) -> bool:
    return any(matches_pattern(value, p) for p in patterns)


def matches(value: Column, pattern: Pattern) -> Column:
    return F.coalesce(compile_pattern(pattern).column(value), F.lit(False))


def matches_any(value: Column, patterns: list[Pattern] = ()) -> Column:
    """Whether any of the patterns fits; of none, false."""
    return reduce(lambda a, b: a | b, (matches(value, p) for p in patterns), F.lit(False))


def admitted(url: Column, starts: list[str], exclude: list[Pattern], include: list[Pattern]) -> Column:
    """What may be crawled: start URLs always, else what no exclusion and some inclusion fits."""
    allowed = ~matches_any(url, exclude) & matches_any(url, include)
    return url.isin(*starts) | allowed if starts else allowed
