"""silkweb: web pages to text datasets, as DataFrame plans.

The names below can be imported from here; they are loaded when first asked for.
"""

from importlib import import_module

_NAMES = {
    "Crawler": "plans.crawler",
    "create_crawler": "plans.crawler",
    "crawl_site": "plans.crawler",
    "run_crawlers": "plans.crawler",
    "load_config": "plans.config",
    "DEFAULT_CONFIG": "plans.config",
    "BROWSER_WAIT_UNTIL": "plans.config",
    "BROWSER_BLOCKABLE_RESOURCES": "plans.config",
    "ConfigError": "plans.config",
    "Hooks": "plans.hooks",
    "RateLimitError": "sources.fetch",
    "FetchError": "sources.fetch",
    "HttpFetcher": "sources.fetch",
    "TableFetcher": "sources.fetch",
    "resolve_fetcher": "sources.fetch",
    "normalize": "functions.urls",
    "normalize_url": "functions.urls",
    "matches_pattern": "functions.patterns",
    "matches_any_pattern": "functions.patterns",
    "extract_text": "functions.html",
    "extract_text_column": "functions.html",
    "discover_links_column": "functions.html",
    "classify_content_type": "functions.content",
    "parse_json": "functions.content",
    "parse_sitemap": "functions.sitemap",
    "route": "operators.rules",
    "write_records": "plans.output",
    "format_records": "plans.output",
}
__all__ = sorted(_NAMES)


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(name)
    return getattr(import_module(f"silkweb.{_NAMES[name]}"), name)
