"""URLs by the WHATWG rules: parsing, resolving, and the canonical form under which pages are known.

``normalize_url`` is a Column function: clean ASCII http(s) URLs go through native expressions, all others through an
Arrow UDF with the full parser. Both give null for what is no URL.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from dataclasses import dataclass, replace
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.functions.batches import small_batches

#: Schemes whose URLs have a host, with their default ports.
SPECIAL = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21", "file": ""}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_BAD_HOST = set("\x00\t\n\r #/:<>?@[\\]^|%\x7f") | {chr(c) for c in range(32)}
_DOT, _DOTS = {".", "%2e"}, {"..", ".%2e", "%2e.", "%2e%2e"}


class UrlError(ValueError):
    """The text is no URL."""


def _escaped(text: str, extra: str) -> str:
    out = []
    for ch in text:
        if ch in extra or not " " <= ch <= "~":
            out.extend(f"%{b:02X}" for b in ch.encode("utf-8", "replace"))
        else:
            out.append(ch)
    return "".join(out)


@dataclass(frozen=True)
class Url:
    scheme: str
    userinfo: str | None
    host: str | None
    port: str
    path: str
    query: str | None = None
    fragment: str | None = None
    opaque: bool = False

    @property
    def special(self) -> bool:
        return self.scheme in SPECIAL

    @property
    def authority(self) -> str:
        """Host with its port, if that isn't the default."""
        return (self.host or "") + (f":{self.port}" if self.port else "")

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.authority}" if self.special and self.scheme != "file" else "null"

    def __str__(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            out += "//" + (f"{self.userinfo}@" if self.userinfo else "") + self.authority
        elif not self.opaque and self.path.startswith("//"):
            out += "/."
        out += self.path
        return out + ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")


def _ipv4(host: str) -> str | None:
    """Dotted form of a host whose last label is a number; None if it is a name."""
    labels = host.split(".")
    if labels[-1] == "" and len(labels) > 1:
        labels.pop()
    last = labels[-1]
    if not (last.isdigit() or re.fullmatch(r"0[xX][0-9A-Fa-f]*", last)):
        return None
    if len(labels) > 4:
        raise UrlError(host)
    numbers = []
    for label in labels:
        try:
            numbers.append(int(label[2:] or "0", 16) if label[:2].lower() == "0x" else int(label, 8) if len(label) > 1 and label[0] == "0" else int(label))
        except ValueError:
            raise UrlError(host) from None
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise UrlError(host)
    value = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def _host(text: str, special: bool) -> str:
    if text.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(text[1:-1] if text.endswith(']') else '').compressed}]"
        except ValueError:
            raise UrlError(text) from None
    if not special:
        if set(text) & (_BAD_HOST - {"%"}):
            raise UrlError(text)
        return _escaped(text, "")
    name = unquote_to_bytes(text.encode("utf-8", "replace")).decode("utf-8", "replace")
    name = name.lower() if name.isascii() else _punycode(name)
    if not name or set(name) & _BAD_HOST:
        raise UrlError(text)
    return _ipv4(name) or name


#: Letters that keep their own form in names, and those that names drop (beside variation selectors).
_KEPT, _DROPPED = "\u00df\u03c2\u200c\u200d", "\u00ad\u034f\u200b\u2060\u2064\ufeff" + "".join(map(chr, (*range(0xFE00, 0xFE10), *range(0x180B, 0x180E))))


def _mapped(c: str) -> str:
    """A character of a host's name as the compatibility mapping for names (UTS #46, not transitional) has it."""
    if c in _KEPT:
        return c
    if c in _DROPPED:
        return ""
    if c == "\u1e9e":
        return "\u00df"
    plain = unicodedata.normalize("NFKC", c)
    return unicodedata.normalize("NFKC", "".join(x if x in _KEPT else x.casefold() for x in plain))


def _label(label: str) -> str:
    """One part of a name in ASCII. UrlError for what no name may hold."""
    if label.startswith("xn--"):
        try:
            label = label[4:].encode("ascii").decode("punycode")
        except UnicodeError:
            raise UrlError(label) from None
        if label.isascii() or "".join(map(_mapped, label)) != label:
            raise UrlError(label)
    if label.isascii():
        return label
    kinds = [unicodedata.bidirectional(c) for c in label]
    right = {"R", "AL"} & {*kinds}
    bad = (
        unicodedata.category(label[0]).startswith("M")
        or any(unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs", "Zl", "Zp", "Zs") for c in label)
        or any(c in "\u200c\u200d" and (not k or unicodedata.combining(label[k - 1]) != 9) for k, c in enumerate(label))
        or right and ("L" in kinds or kinds[0] not in ("R", "AL") or next((k for k in reversed(kinds) if k != "NSM"), "") not in ("R", "AL", "EN", "AN"))
    )
    if bad:
        raise UrlError(label)
    return "xn--" + label.encode("punycode").decode()


def _punycode(name: str) -> str:
    mapped = unicodedata.normalize("NFC", "".join(map(_mapped, name)))
    return ".".join(map(_label, re.split("[.\u3002]", mapped)))


def _path(text: str, special: bool, base: list[str]) -> str:
    """Absolute path of ``text`` under the segments ``base``, without dot segments."""
    parts = re.split(r"[/\\]", text) if special else text.split("/")
    out = list(base)
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        low = part.lower()
        if low in _DOTS:
            if out:
                out.pop()
            if last:
                out.append("")
        elif low in _DOT:
            if last:
                out.append("")
        else:
            out.append(_escaped(part, " \"#<>?^`{}"))
    return "/" + "/".join(out)


def _tail(text: str) -> tuple[str, str | None, str | None]:
    """Path, query and fragment of what follows the authority."""
    text, found, fragment = text.partition("#")
    fragment = _escaped(fragment, ' "<>`') if found else None
    text, found, query = text.partition("?")
    return text, query if found else None, fragment


def _query(text: str | None, special: bool) -> str | None:
    return None if text is None else _escaped(text, " \"#<>'" if special else ' "#<>')


def _with_authority(scheme: str, rest: str) -> Url:
    special = scheme in SPECIAL
    end = re.search(r"[/?#\\]" if special else r"[/?#]", rest)
    authority, tail = (rest[: end.start()], rest[end.start() :]) if end else (rest, "")
    userinfo, found, hostport = authority.rpartition("@")
    if found:
        name, colon, password = userinfo.partition(":")
        encode = " \"#<>?^`{}/:;=@[\\]|"
        userinfo = _escaped(name, encode) + (":" + _escaped(password, encode) if colon and password else "")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", hostport, re.S)
    if not m or (m[2] and not re.fullmatch(r"[0-9]+", m[2])):
        raise UrlError(rest)
    if special and scheme != "file" and not m[1]:
        raise UrlError(rest)
    host = _host(m[1], special) if m[1] else ""
    port = str(int(m[2])) if m[2] else ""
    if port and int(port) > 65535:
        raise UrlError(rest)
    path, query, fragment = _tail(tail)
    if path or special:
        path = _path(path[1:], special, [])
    return Url(scheme, userinfo or None, host, "" if port == SPECIAL.get(scheme) else port, path, _query(query, special), fragment)


def parse(text: str, base: Url | None = None) -> Url:
    """The URL that ``text`` is, relative to ``base``; UrlError if it is none."""
    text = text.strip("".join(map(chr, range(33))))
    text = re.sub("[\t\n\r]", "", text)
    m = _SCHEME.match(text)
    scheme = m[1].lower() if m else None
    if scheme:
        rest = text[m.end() :]
        if scheme in SPECIAL:
            if base is not None and base.scheme == scheme and not re.match(r"[/\\]{2}", rest) and scheme != "file":
                return _relative(rest, base)
            if scheme == "file":
                return _with_authority(scheme, rest.lstrip("/\\") if re.match(r"[/\\]{2}", rest) else "/" + rest.lstrip("/\\"))
            return _with_authority(scheme, rest.lstrip("/\\"))
        if rest.startswith("//"):
            return _with_authority(scheme, rest[2:])
        path, query, fragment = _tail(rest)
        if rest.startswith("/"):
            return Url(scheme, None, None, "", _path(path[1:], False, []), _query(query, False), fragment)
        return Url(scheme, None, None, "", _escaped(path, ""), _query(query, False), fragment, opaque=True)
    if base is None:
        raise UrlError(text)
    return _relative(text, base)


def _relative(text: str, base: Url) -> Url:
    if base.opaque:
        if not text.startswith("#"):
            raise UrlError(text)
        return replace(base, fragment=_tail(text)[2])
    slash = r"[/\\]" if base.special else "/"
    if re.match(slash + slash, text):
        return _with_authority(base.scheme, text[2:])
    path, query, fragment = _tail(text)
    if re.match(slash, path):
        return replace(base, path=_path(path[1:], base.special, []), query=_query(query, base.special), fragment=fragment)
    if not path:
        return replace(base, query=_query(query, base.special) if query is not None else base.query, fragment=fragment)
    above = base.path.split("/")[1:-1]
    return replace(base, path=_path(path, base.special, above), query=_query(query, base.special), fragment=fragment)


def normalize(text: str) -> str:
    """Canonical form: no query or fragment, https for special schemes, one leading ``www.`` and one trailing slash off."""
    url = replace(parse(text), query=None, fragment=None)
    if url.special and url.scheme != "file":
        url = replace(url, scheme="https", port="" if url.port == "443" else url.port)
    if url.host and url.host.startswith("www.") and len(url.host) > 4:
        url = replace(url, host=url.host[4:])
    if not url.opaque and len(url.path) > 1 and url.path.endswith("/"):
        url = replace(url, path=url.path[:-1])
    return str(url)


def normalize_or_none(text: str | None) -> str | None:
    try:
        return None if text is None else normalize(text)
    except (UrlError, UnicodeError):
        return None


def resolve(href: str, base: str) -> str | None:
    """Absolute form of a link on the page ``base``; None if it is malformed."""
    try:
        return str(parse(href, parse(base)))
    except (UrlError, UnicodeError):
        return None


# --- Column functions --------------------------------------------------------------------------------------------------

#: URLs that native expressions normalise: lower-case names, no port, no user, plain path characters, no dot segments.
_CLEAN = r"^https?://(?!www\.www\.)[a-z][a-z0-9-]*(\.[a-z][a-z0-9-]*)*(/(?!\.)[A-Za-z0-9_~!$&()*+,;=:@%-][A-Za-z0-9_.~!$&()*+,;=:@%-]*)*/?([?#][!-~]*)?$"


@F.pandas_udf(T.StringType())
def _normalize_udf(urls: pd.Series) -> pd.Series:
    return urls.map(normalize_or_none)


def normalize_url(url: Column, native: bool = True) -> Column:
    """Canonical form of a URL column; null for null and for what is no URL.

    The UDF runs over all rows of its stage, so the fast path hands it null for clean URLs: it then has nothing to parse.
    """
    small_batches()
    if not native:
        return _normalize_udf(url)
    # xn-- names need the IDNA check, %2e the dot-segment rule.
    clean = url.rlike(_CLEAN) & ~url.rlike(r"(?i)xn--|%2e|/\.") & ~url.rlike(r"^https?://www\.?([/?#]|$)")
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^https?://(www\.)?", "https://")
    bare = F.regexp_replace(bare, r"^(https://[^/]+)$", "$1/")
    bare = F.regexp_replace(bare, r"^(https://[^/]+/.*[^/])/$", "$1")
    return F.coalesce(F.when(clean, bare), _normalize_udf(F.when(~F.coalesce(clean, F.lit(False)), url)))


def authority_of(url: Column) -> Column:
    """Host and port of a canonical URL."""
    return F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def origin_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^([a-z][a-z0-9+.\-]*://[^/?#]*)", 1), r"//[^@/]*@", "//")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def path_segments(url: Column) -> Column:
    """Non-empty segments of the path, still percent-encoded."""
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def path_prefixes(url: Column) -> Column:
    """Leading runs of segments joined by slashes, the longest first."""
    parts = path_segments(url)
    longest_first = F.when(F.size(parts) > 0, F.sequence(F.size(parts), F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.transform(longest_first, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def sitemap_url(url: Column) -> Column:
    """The place where a site's map is by default."""
    return F.concat(origin_of(url), F.lit("/sitemap.xml"))
