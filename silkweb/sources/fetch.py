"""Where responses come from: a table, HTTP, or an object of the user's, all as one DataFrame contract.

A fetcher has ``name`` and either ``fetch_frame(frontier, config)``, a DataFrame of ``FETCHED`` for a DataFrame with url,
or ``fetch(url)``, a dict with data, status and headers that raises FetchError; optional ``init()`` and ``close()``.
"""

from __future__ import annotations

import http.client
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from datetime import timezone
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkweb.functions.urls import normalize_url, resolve
from silkweb.sources.shared import written

#: Connections that a thread keeps; bytes of an answer without use that are read so that its connection can be kept.
KEPT, UNREAD = 32, 1 << 16
_OPEN = threading.local()
FETCHED = "url STRING, data BINARY, status INT, headers MAP<STRING,STRING>, error STRING, rate_limited BOOLEAN"


class FetchError(Exception):
    def __init__(self, message: str, status: int | None = None, headers: dict | None = None) -> None:
        super().__init__(message)
        self.status, self.headers = status, headers or {}


class RateLimitError(Exception):
    """The crawl stopped as a host answered 429; ``code`` is for the process to exit with."""

    def __init__(self, message: str = "Rate limited", code: int = 10) -> None:
        super().__init__(message)
        self.code = code


def rate_limit_wait(headers: dict[str, str], fallback_ms: float, now: float | None = None) -> float:
    """Milliseconds to wait after a 429: ``retry-after`` as seconds or a date, else ``x-ratelimit-reset``, else the fallback."""
    now = time.time() if now is None else now
    after = headers.get("retry-after")
    if after is not None:
        try:
            return float(after.strip() or 0) * 1000
        except ValueError:
            pass
        try:
            when = parsedate_to_datetime(after)
            return max(0.0, (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp() - now) * 1000
        except (TypeError, ValueError):
            return fallback_ms
    reset = headers.get("x-ratelimit-reset", "").strip().split(".")[0]
    if reset.lstrip("-").isdigit():
        return max(0.0, int(reset) - now) * 1000
    return fallback_ms


def attempted(fetch: Callable[[str], dict], url: str, tries: int, retry: dict, rate_limit: dict) -> tuple[dict | None, int, float]:
    """One request after ``tries`` that failed: its row, or None with the tries by now and the seconds to wait.

    Statuses that pass are tried again ``max`` times; waits for 429 don't count as tries.
    """
    try:
        got = fetch(url)
        return {"url": url, "data": got["data"], "status": got["status"], "headers": got["headers"], "error": None, "rate_limited": False}, tries, 0.0
    except Exception as e:
        status = getattr(e, "status", None)
        if status == 429:
            if rate_limit["exit_on_limit"]:
                return {"url": url, "data": None, "status": 429, "headers": dict(e.headers), "error": None, "rate_limited": True}, tries, 0.0
            return None, tries, rate_limit_wait(e.headers, rate_limit["fallback_delay"]) / 1000
        if (status is None or status in retry["status_codes"]) and tries < retry["max"]:
            return None, tries + 1, max(0, retry["delay"]) / 1000
        return {"url": url, "data": None, "status": status, "headers": None, "error": str(e) or type(e).__name__, "rate_limited": False}, tries, 0.0


def with_retries(fetch: Callable[[str], dict], url: str, retry: dict, rate_limit: dict, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Result row of a fetch with all its tries."""
    tries = 0
    while True:
        row, tries, seconds = attempted(fetch, url, tries, retry, rate_limit)
        if row:
            return row
        if seconds > 0:
            sleep(seconds)


class HttpFetcher:
    """Plain HTTP with redirects followed one by one, a time limit per hop and a limit on the body's bytes. Connections
    are kept for the host's next URL."""

    name = "http"

    def __init__(self, request: dict) -> None:
        self.request = request

    def fetch(self, url: str) -> dict:
        left = self.request["max_redirects"]
        while True:
            answer = self._once(url)
            if not 300 <= answer["status"] < 400:
                break
            where = answer["headers"].get("location")
            if not where:
                raise FetchError("Redirect without location header", answer["status"], answer["headers"])
            if left <= 0:
                raise FetchError("Max redirects reached", answer["status"], answer["headers"])
            left -= 1
            onward = resolve(where, url)
            if onward is None:
                raise FetchError(f"Invalid redirect location: {where}")
            url = onward
        if not 200 <= answer["status"] < 300:
            raise FetchError(f"Invalid status code: {answer['status']}", answer["status"], answer["headers"])
        return answer

    def _once(self, url: str) -> dict:
        parts = urlsplit(url)
        seconds = self.request["timeout"] / 1000
        host, by = parts.netloc.rpartition("@")[2], time.monotonic() + seconds
        target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        try:
            connection, response = self._answer((parts.scheme, host, seconds), target)
            whole = False
            try:
                headers = {k.lower(): v for k, v in response.getheaders()}
                if not 200 <= response.status < 300:
                    response.read(UNREAD)
                    data = b""
                else:
                    data = self._body(response, headers, by)
                whole = response.isclosed()  # read to its end, so the next request may follow
                return {"data": data, "status": response.status, "headers": headers}
            finally:
                self._keep((parts.scheme, host, seconds), connection if whole else None)
        except TimeoutError:
            raise FetchError(f"Request timed out after {self.request['timeout']}ms", 408) from None

    def _answer(self, key: tuple, target: str):
        """The connection and its response: by one that this thread kept, else or if that one is gone by a new one."""
        kept = _OPEN.__dict__.setdefault("kept", OrderedDict()).pop(key, None)
        kind = http.client.HTTPSConnection if key[0] == "https" else http.client.HTTPConnection
        for connection in (kept, kind(key[1], timeout=key[2])):
            if connection is None:
                continue
            try:
                connection.request("GET", target, headers={"User-Agent": self.request["user_agent"], **self.request["headers"]})
                return connection, connection.getresponse()
            except (ConnectionError, http.client.HTTPException):
                connection.close()
                if connection is not kept:
                    raise
            except BaseException:
                connection.close()
                raise

    @staticmethod
    def _keep(key: tuple, connection) -> None:
        """Keep a connection for the host's next URL, the most recent ``KEPT`` of a thread; without one, drop it."""
        if connection is None or connection.sock is None:
            return
        _OPEN.kept[key] = connection
        if len(_OPEN.kept) > KEPT:
            _OPEN.kept.popitem(last=False)[1].close()

    def _body(self, response, headers: dict, by: float) -> bytes:
        most = self.request["max_content_length"]
        if most > 0 and headers.get("content-length", "").isdigit() and int(headers["content-length"]) > most:
            raise FetchError(f"Response too large: {headers['content-length']} bytes (max {most})", 413, headers)
        parts, size = [], 0
        while chunk := response.read(1 << 16):
            size += len(chunk)
            if 0 < most < size:
                raise FetchError(f"Response exceeded max size of {most} bytes", 413, headers)
            if time.monotonic() > by:
                raise TimeoutError
            parts.append(chunk)
        return b"".join(parts)


class TableFetcher:
    """Responses from a table with url, body and, where it has them, status, content_type, location and fail_times.

    Redirects are followed by joins, one per hop. ``fail_times`` answers of a row come before its success: with its
    status 429 they are waited for (or end the crawl), else they use up retries.
    """

    name = "table"

    def __init__(self, pages: DataFrame) -> None:
        have = set(pages.columns)
        pick = lambda c, kind, default: (F.col(c) if c in have else F.lit(default)).cast(kind).alias(c)
        rows = pages.select(normalize_url(F.col("url")).alias("key"), F.col("body").cast("binary").alias("body"), pick("status", "int", 200), pick("content_type", "string", "text/html"), pick("location", "string", None), pick("fail_times", "int", 0))
        # Of several rows with one canonical URL, the least in all columns answers.
        best = F.min(F.struct("status", "content_type", "location", "fail_times", "body")).alias("r")
        self._pages = rows.where("key IS NOT NULL").groupBy("key").agg(best).select("key", "r.*")
        self._written: DataFrame | None = None

    @property
    def pages(self) -> DataFrame:
        """The web by canonical URL, written when it is first asked for."""
        if self._written is None:
            self._written = written(self._pages, "web")
        return self._written

    def fetch_frame(self, frontier: DataFrame, config: dict) -> DataFrame:
        most, retry, limit = config["request"]["max_content_length"], config["retry"], config["rate_limit"]
        at = frontier.select("url", F.col("url").alias("key"))
        done = None
        for hop in range(config["request"]["max_redirects"] + 1):
            met = written(at.join(self.pages, "key", "left"), "answers")  # most often the first hop is the last
            onward = F.col("status").between(300, 399)
            settled = met.where(~F.coalesce(onward, F.lit(False)) | F.col("location").isNull() | F.lit(hop == config["request"]["max_redirects"]))
            done = settled if done is None else done.unionByName(settled)
            target = F.when(F.col("location").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("location")).otherwise(_resolved("location", "key"))
            at = met.where(onward & F.col("location").isNotNull()).select("url", normalize_url(target).alias("key"))
            if not at.take(1):
                break
        status = F.coalesce("status", F.lit(404))
        failing = F.coalesce("fail_times", F.lit(0))
        limited = (status == 429) & (failing > 0)
        broken = ~limited & (failing > retry["max"])
        answered = F.when((failing > 0) & (limited | ~broken), F.lit(200)).otherwise(F.when(broken & (status < 400), F.lit(503)).otherwise(status))
        size = F.octet_length("body")
        error = (
            F.when(answered.between(300, 399) & F.col("location").isNull(), "Redirect without location header")
            .when(answered.between(300, 399), "Max redirects reached")
            .when(~answered.between(200, 299), F.concat(F.lit("Invalid status code: "), answered.cast("string")))
            .when(F.lit(most > 0) & (size > most), F.concat(F.lit("Response too large: "), size.cast("string"), F.lit(f" bytes (max {most})")))
        )
        stops = limited & F.lit(limit["exit_on_limit"]) | (status == 429) & F.lit(limit["exit_on_limit"])
        headers = F.map_filter(F.create_map(F.lit("content-type"), F.col("content_type")), lambda _, v: v.isNotNull())
        return done.select(
            "url",
            F.when(error.isNull() & ~stops, F.coalesce("body", F.lit(b""))).alias("data"),
            F.when(F.lit(most > 0) & (size > most) & answered.between(200, 299), 413).otherwise(F.when(stops, 429).otherwise(answered)).cast("int").alias("status"),
            headers.alias("headers"),
            F.when(~stops, error).alias("error"),
            stops.alias("rate_limited"),
        )


def _resolved(href: str, base: str):
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def run(hrefs: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([None if h is None or b is None else resolve(h, b) for h, b in zip(hrefs, bases)], dtype=object)

    return run(href, base)


def resolve_fetcher(config: dict):
    """The configured fetcher: an object with fetch or fetch_frame, or the name of a built-in one."""
    wanted = config["fetcher"]
    if hasattr(wanted, "fetch") or hasattr(wanted, "fetch_frame"):
        return wanted
    if wanted in (None, "http"):
        return HttpFetcher(config["request"])
    if wanted == "browser":
        raise NotImplementedError("no browser here: give an object with fetch(url) that drives one")
    raise ValueError(f"Unknown fetcher: {wanted}")
