"""Configuration: defaults, merging, list directives, checks. A resolved configuration is a nested dict of its own."""

from __future__ import annotations

import copy
import posixpath
import re
from collections.abc import Mapping

from silkweb.functions.patterns import compile_pattern
from silkweb.functions.urls import normalize

#: When a page counts as loaded, and the kinds of resources that a browser may leave out.
BROWSER_WAIT_UNTIL = ("load", "domcontentloaded", "networkidle0", "networkidle2")
BROWSER_BLOCKABLE_RESOURCES = ("image", "stylesheet", "font", "media")
#: File endings that are no pages.
BINARY_ENDINGS = [
    "zip", "rar", "webp", "png", "jpg", "jpeg", "gif", "mp3", "mp4", "pdf", "css", "js", "svg", "ico", "eot", "ttf",
    "woff", "woff2", "otf", "webm", "ogg", "wav", "flac", "m4a", "mkv", "mov", "avi", "wmv", "flv", "swf", "exe",
    "msi", "dmg", "iso", "bin",
]
#: Elements that hold no readable text.
REMOVED_ELEMENTS = [
    "script", "noscript", "style", "meta", "link", "svg", "path", "img", "input", "textarea", "embed", "object",
    "iframe", "nav", "header", "footer", "aside", "button", "[aria-modal]", '[role="dialog"]', '[role="alert"]',
    '[role="banner"]', '[role="form"]', '[role="navigation"]', '[role="search"]',
]

#: Defaults, the first start URL and its route among them.
DEFAULT_CONFIG = {
    "start_urls": ["https://crawler-test.com/"],
    "include": [],
    "exclude": [re.compile(rf"\.({'|'.join(BINARY_ENDINGS)})$", re.I)],
    "allowed_content_types": ["text/html"],
    "sites": [],
    "fetcher": "http",
    "browser": {"wait_until": "load", "block_resources": ["image", "font", "media"]},
    "log_level": "info",
    "signals": True,
    "storage": {"dir": "dataset"},
    "request": {"timeout": 10_000, "max_redirects": 5, "max_content_length": 20 << 20, "user_agent": "Mozilla/5.0 (compatible; silkweb/1.0)", "headers": {}},
    "retry": {"max": 1, "status_codes": [408, 500, 502, 503, 504], "delay": 1000},
    "rate_limit": {"fallback_delay": 60_000, "exit_on_limit": False, "exit_code": 10},
    "crawl": {"concurrency": 5, "delay": 200, "lease": 60_000, "max_depth": None, "max_pages": None, "reset_on_complete": True, "retry_errors": False, "retry_skipped": False, "sitemap": False},
    "extract": {"root": None, "root_fallback": "body", "json": True, "remove_selectors": REMOVED_ELEMENTS},
    "output": {"format": "json", "exclude": [], "routes": {"https://crawler-test.com": {"*": "general.json"}}},
}


class ConfigError(ValueError):
    """The configuration can't be used."""


def merged(base: Mapping, over: Mapping) -> dict:
    """``base`` with the values of ``over``; mappings merge key by key, everything else replaces."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if both else value
    return out


def listed(value, default: list) -> list:
    """A list as given, or the default with what the directive replaces, prepends, extends or appends."""
    if isinstance(value, (list, tuple)):
        return list(value)
    if not isinstance(value, Mapping):
        return list(default)
    parts = {k: list(v) for k, v in value.items() if isinstance(v, (list, tuple))}
    if "replace" in parts:
        return parts["replace"]
    return parts.get("prepend", []) + list(default) + parts.get("extend", parts.get("append", []))


def assert_browser_config(browser: Mapping) -> None:
    if browser.get("wait_until") not in BROWSER_WAIT_UNTIL:
        raise ConfigError(f"browser.wait_until must be one of {', '.join(BROWSER_WAIT_UNTIL)}, not {browser.get('wait_until')!r}")
    blocked = browser.get("block_resources")
    if not isinstance(blocked, (list, tuple)):
        raise ConfigError("browser.block_resources must be a list")
    if odd := [x for x in blocked if x not in BROWSER_BLOCKABLE_RESOURCES]:
        raise ConfigError(f"browser.block_resources may hold {', '.join(BROWSER_BLOCKABLE_RESOURCES)}, not {odd[0]!r}")


def load_config(user: Mapping | None = None) -> dict:
    """The defaults with the user's values; bad URLs, patterns and browser options fail here."""
    out = merged(copy.deepcopy(DEFAULT_CONFIG), user or {})
    for place, key in ((out, "exclude"), (out, "allowed_content_types")):
        place[key] = listed(place[key], DEFAULT_CONFIG[key])
    out["include"] = listed(out["include"], [])
    remove = listed(out["extract"]["remove_selectors"], REMOVED_ELEMENTS)
    out["extract"]["remove_selectors"] = remove
    out["output"]["exclude"] = listed(out["output"]["exclude"], [])
    sites = []
    for site in out["sites"] or []:
        match = site.get("match")
        site = {**site, "match": list(match) if isinstance(match, (list, tuple)) else [match]}
        if "remove_selectors" in (site.get("extract") or {}):
            site["extract"] = {**site["extract"], "remove_selectors": listed(site["extract"]["remove_selectors"], remove)}
        sites.append(site)
    out["sites"] = sites
    top = out["storage"]["dir"]
    out["storage"] |= {"queue_path": posixpath.join(top, "queue"), "crawled_dir": posixpath.join(top, "crawled"), "formatted_dir": posixpath.join(top, "formatted")}
    out["start_urls"] = list(out["start_urls"])
    starts = [normalize(u) for u in out["start_urls"]]
    out["include"] = out["include"] or starts
    for pattern in [*out["include"], *out["exclude"], *out["output"]["exclude"], *out["output"]["routes"], *(p for s in sites for p in s["match"])]:
        compile_pattern(pattern)
    assert_browser_config(out["browser"])
    return out
