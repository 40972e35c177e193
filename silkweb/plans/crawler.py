"""The crawler: waves of fetch, gate, parse and enqueue over the queue's table, then routed output.

Its order is that of one worker taking the queue first in, first out, wave by wave; what a wave's lease leaves is the
next one's. A wave is one plan; what it leaves is written, so a crawl that ends in any way goes on from its last complete
wave.
"""

from __future__ import annotations

import hashlib
import logging
import signal
import time
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.functions.batches import small_batches
from silkweb.functions.content import content_kind, gate_passes, parse_json, parse_strict, skip_reason, stringify, to_text
from silkweb.functions.html import extract_text, links_of, parse_html, stripped, text_of
from silkweb.functions.patterns import admitted
from silkweb.functions.sitemap import parse_sitemap_column
from silkweb.functions.urls import authority_of, normalize, normalize_url, resolve
from silkweb.operators import frontier as fr
from silkweb.operators.rules import effective, site_rule
from silkweb.plans.config import load_config
from silkweb.plans.hooks import Hooks, reduced
from silkweb.plans.output import format_records, save_json
from silkweb.sources.fetch import FetchError, RateLimitError, resolve_fetcher, with_retries
from silkweb.sources.polite import StopLine, fetched
from silkweb.sources.shared import written
from silkweb.sources.store import LOGS, Store

SITEMAP_LEVELS = 6
#: Sitemaps that the log names when they can't be read.
WARNINGS = 20
#: Seconds until the next look at a frontier whose hosts all have to wait.
IDLE = 1.0
_PARSED = T.StructType([T.StructField("seq", T.LongType()), T.StructField("url", T.StringType()), T.StructField("content", T.StringType()), T.StructField("data", T.StringType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType())), T.StructField("hash", T.StringType()), T.StructField("links", T.ArrayType(T.StringType())), T.StructField("failed", T.StringType())])
_FIXED = ("url", "content", "crawledAt", "data")


@F.pandas_udf(T.StringType())
def _texts(bodies: pd.Series) -> pd.Series:
    return bodies.map(to_text)


def parsed(passed: DataFrame, config: Mapping, hooks: Mapping[str, list] | None = None, now: str = "") -> DataFrame:
    """Content, links and hash of responses that passed the gate (seq, url, depth, data, status, headers, kind, rule).

    Pages are parsed once, for links before anything is removed and for text after; the hook for links sees the whole
    page, the one for text what is left of it.
    """
    hooks = hooks or {}
    rules = {k: effective(config, k)["extract"] for k in range(-1, len(config["sites"]))}

    def one(row) -> tuple:
        entry = {"seq": row.seq, "url": row.url, "depth": row.depth, "referrer": row.referrer}
        result = {"data": row.data, "status": row.status, "headers": dict(row.headers or {})}
        extract, page, links, data = rules[row.rule], None, [], None
        if row.kind == "html":
            page = parse_html(to_text(row.data))
            links = reduced(hooks.get("links", ()), links_of(page, row.url), page, entry, result)
            content = text_of(stripped(page, extract["remove_selectors"]), [], extract["root"], extract["root_fallback"])
        elif row.kind == "json" and extract["json"] is not False:
            data, content = parse_json(row.data)
        else:
            content = to_text(row.data)
        if page is None:
            links = reduced(hooks.get("links", ()), links, None, entry, result)
        content = reduced(hooks.get("extract", ()), content, page, entry, result)
        url, extra = row.url, {}
        if hooks.get("transform"):
            record = {"url": url, "content": content, "crawledAt": now} | ({} if data is None else {"data": parse_strict(data)})
            record = reduced(hooks["transform"], record, entry, result)
            url, content = record["url"], record.get("content")
            data = stringify(record["data"]) if record.get("data") is not None else None
            extra = {k: stringify(v) for k, v in record.items() if k not in _FIXED}
        return url, content, data, extra, hashlib.sha256((content or "").encode("utf-8", "surrogatepass")).hexdigest(), [str(x) for x in links or []], None

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    out.append((row.seq, *one(row)))
                except Exception as e:  # a hook of the user's failed: the page is an error
                    out.append((row.seq, row.url, None, None, None, None, [], str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=_PARSED.names)

    small_batches(passed.sparkSession)
    return passed.select("seq", "url", "depth", "referrer", "data", "status", "headers", "kind", "rule").mapInPandas(run, _PARSED)


def watched(answers: DataFrame, hooks: list) -> DataFrame:
    """``answers`` after the response hooks, which see all of them, may change data, status and headers, and make an
    answer an error by raising."""
    schema = T.StructType([f for f in answers.schema.fields])
    columns = answers.columns

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                entry = {k: row[k] for k in ("seq", "url", "depth", "referrer")}
                result = {"data": row["data"], "status": row["status"], "headers": dict(row["headers"] or {})}
                try:
                    for fn in hooks:
                        fn(result, entry)
                    row |= result
                except Exception as e:
                    row["error"] = str(e) or type(e).__name__
                out.append([row[c] for c in columns])
            yield pd.DataFrame(out, columns=columns)

    small_batches(answers.sparkSession)
    return answers.mapInPandas(run, schema)


class Crawler:
    """A crawl of one configuration. Stages can be run one by one; ``on`` registers hooks."""

    def __init__(self, spark: SparkSession, user: Mapping | None = None) -> None:
        self.spark, self.config = spark, load_config(user)
        self.hooks = Hooks()
        self.on = self.hooks.on
        self.fetcher = resolve_fetcher(self.config)
        self.store = Store(spark, self.config["storage"])
        self.starts = [normalize(u) for u in self.config["start_urls"]]
        self.logger = logging.getLogger(f"silkweb.{id(self)}")
        level = {"silent": logging.CRITICAL + 1, "error": logging.ERROR, "warn": logging.WARNING, "debug": logging.DEBUG}
        self.logger.setLevel(level.get(self.config["log_level"], logging.INFO))
        self.stopped, self._line = False, None
        self.statistics: dict[str, int] = {}

    # --- state ---

    @property
    def queue(self) -> DataFrame:
        """Every place of the queue as it now is."""
        return self.store.queue()

    def counts(self) -> dict[str, int]:
        return self.store.current()["counts"]

    def _seed(self) -> None:
        first = list(dict.fromkeys(self.starts))
        rows = self.spark.createDataFrame([(k, u, None, 0) for k, u in enumerate(first)], LOGS["found"])
        self.store.append(found=rows, change={"pending": len(first)}, next=len(first))

    def _requeue(self, which: str) -> int:
        now = self.store.current()
        n = now["counts"][which]
        if n:
            old = self.queue.where(fr.state() == which).select("seq", "url", "referrer", "depth")
            back = written(fr.numbered(old.withColumnRenamed("seq", "old"), ["old"], now["next"], "seq"), "requeued")
            self.store.append(found=back, dropped=back.select(F.col("old").alias("seq")), change={which: -n, "pending": n}, next=now["next"] + n)
        return n

    def requeue_errors(self) -> int:
        """Errors are pending again, after all others, and stay so on disk."""
        return self._requeue("error")

    def requeue_skipped(self) -> int:
        return self._requeue("skipped")

    def init(self) -> None:
        """Seed a new queue, go on with an old one, or start anew where all of it was done."""
        crawl = self.config["crawl"]
        if crawl["retry_errors"]:
            self.requeue_errors()
        if crawl["retry_skipped"]:
            self.requeue_skipped()
        n = self.counts()
        if not any(n.values()):
            self._seed()
        elif not n["pending"] and crawl["reset_on_complete"]:
            self.store.reset()
            self._seed()

    def stop(self) -> None:
        """End the crawl: requests that run are finished and kept, no other starts."""
        self.stopped = True
        if self._line:
            self._line.cut()

    # --- stages ---

    def fetch(self, url: str) -> dict:
        if hasattr(self.fetcher, "fetch"):
            return with_retries(self.fetcher.fetch, normalize(url), self.config["retry"], self.config["rate_limit"])
        one = self.spark.createDataFrame([(0, normalize(url))], "seq BIGINT, url STRING")
        return fetched(self.fetcher, one, self.config).drop("due", "put_off").first().asDict()

    def extract(self, html: str, url: str | None = None) -> dict:
        from silkweb.functions.patterns import compile_pattern

        rule = -1
        if url is not None:
            fits = [(-compile_pattern(p).length, k) for k, s in enumerate(self.config["sites"]) for p in s["match"] if compile_pattern(p).test(url)]
            rule = min(fits)[1] if fits else -1
        e = effective(self.config, rule)["extract"]
        return {"url": url, "content": extract_text(html, e["remove_selectors"], e["root"], e["root_fallback"])}

    def _admit(self, found: DataFrame) -> DataFrame:
        """Of links (raw, referrer, depth, parent, pos) those that may be crawled, under their canonical URLs."""
        links = found.withColumn("url", normalize_url(F.col("raw"))).where("url IS NOT NULL")
        links = links.where(admitted(F.col("url"), self.starts, self.config["exclude"], self.config["include"])).drop("raw")
        vetoes = self.hooks.of("should_enqueue")["should_enqueue"]
        if vetoes:

            @F.pandas_udf(T.BooleanType())
            def allowed(urls: pd.Series, referrers: pd.Series) -> pd.Series:
                return pd.Series([reduced(vetoes, True, u, r) is not False for u, r in zip(urls, referrers)])

            links = links.where(allowed("url", "referrer"))
        return links

    def _new(self, found: DataFrame) -> tuple[DataFrame, int]:
        """Places for what the rules admit and the queue doesn't have, and their number."""
        first = fr.first_of_each(self._admit(found), self.config["crawl"]["max_depth"])
        rows = written(fr.numbered(self.store.unseen(first), ["parent", "pos", "url"], self.store.current()["next"], "seq"), "new")
        return rows, rows.count()

    def _enqueue(self, found: DataFrame) -> int:
        rows, n = self._new(found)
        if n:
            self.store.append(found=rows, change={"pending": n}, next=self.store.current()["next"] + n)
        return n

    def enqueue(self, urls: str | list[str], depth: int = 0, referrer: str | None = None) -> int:
        """Add what the rules admit and the queue doesn't have; how many that was."""
        listed = [urls] if isinstance(urls, str) else list(urls)
        if not listed:
            return 0
        return self._enqueue(self.spark.createDataFrame([(u, referrer, depth, 0, k) for k, u in enumerate(listed)], "raw STRING, referrer STRING, depth INT, parent BIGINT, pos INT"))

    def seed_sitemaps(self) -> int:
        """Enqueue what sitemaps list, following indexes a few levels down.

        A level is fetched and parsed as a whole; sitemaps that an earlier level had, by the address as it is written,
        are left out. The queue is written once, after the last level.
        """
        wanted = self.config["crawl"]["sitemap"]
        if not wanted:
            return 0
        first = list(wanted) if isinstance(wanted, (list, tuple)) else [resolve("/sitemap.xml", u) for u in self.starts]
        level = self.spark.createDataFrame([(u, 0, k) for k, u in enumerate(first)], "raw STRING, parent BIGINT, pos INT")
        seen, found, done = None, None, 0
        for _ in range(SITEMAP_LEVELS):
            fresh = level.groupBy("raw").agg(F.min(F.struct("parent", "pos")).alias("f")).select("raw", "f.*")
            fresh = fresh if seen is None else fresh.join(seen, "raw", "left_anti")
            maps = written(fr.numbered(fresh, ["parent", "pos"], done, "seq").withColumn("url", normalize_url(F.col("raw"))), "sitemaps")
            n = maps.count()
            if not n:
                break
            done += n
            seen = maps.select("raw") if seen is None else seen.union(maps.select("raw"))
            named = maps.where("url IS NOT NULL")
            got = written(fetched(self.fetcher, named.groupBy("url").agg(F.min("seq").alias("seq")), self.config), "sitemaps-fetched")
            if got.where("rate_limited").take(1):
                raise RateLimitError(code=self.config["rate_limit"]["exit_code"])
            self._warn_of(maps, got)
            listed = written(named.join(got.where("error IS NULL").select("url", parse_sitemap_column(_texts(F.col("data"))).alias("s")), "url").select("seq", "raw", "s.*"), "sitemaps-parsed")
            urls = listed.select(F.posexplode("urls").alias("pos", "url"), F.col("raw").alias("referrer"), F.lit(0).alias("depth"), F.col("seq").alias("parent")).withColumnRenamed("url", "raw")
            found = urls if found is None else found.unionByName(urls)
            level = listed.select(F.posexplode("sitemaps").alias("pos", "raw"), F.col("seq").alias("parent"))
        return 0 if found is None else self._enqueue(found)

    def _warn_of(self, maps: DataFrame, got: DataFrame) -> None:
        """Sitemaps that can't be read, in the log: the first of them by name, the others by number."""
        bad = maps.join(got.select("url", "error"), "url", "left").where("url IS NULL OR error IS NOT NULL").select("seq", "raw", F.coalesce("error", F.lit("not a URL")).alias("error"))
        for row in bad.orderBy("seq").limit(WARNINGS).collect():
            self.logger.warning("sitemap %s: %s", row["raw"], row["error"])
        if (n := bad.count()) > WARNINGS:
            self.logger.warning("%d more sitemaps can't be read", n - WARNINGS)

    def _wave(self, todo: DataFrame) -> bool:
        """Fetch and digest rows of the queue; whether a host's limit ended it."""
        config, before = self.config, self.store.current()
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
        todo = written(todo.select("seq", "url", "depth", "referrer"), "wave")
        due, began = self.store.due(), int(time.time() * 1000)
        waits = None if due is None else due.select("host", (F.col("due") - began).alias("due"))
        asked = written(todo.join(fetched(self.fetcher, todo, config, waits, config["crawl"]["lease"], self._line and self._line.address), "url"), "fetched")
        got = asked.where("NOT put_off").drop("put_off", "due")
        answers = got.where("error IS NULL AND NOT rate_limited")
        on_response = self.hooks.of("response")["response"]
        if on_response:
            seen = written(watched(answers, on_response), "watched")
            got = got.where("error IS NOT NULL OR rate_limited").unionByName(seen)
            answers = seen.where("error IS NULL")
        answers = answers.withColumn("ct", F.try_element_at("headers", F.lit("content-type"))).withColumn("rule", site_rule(F.col("url"), config["sites"]))
        passes = gate_passes(F.col("ct"), effective(config, -1)["allowed_content_types"])
        for k in range(len(config["sites"])):
            passes = F.when(F.col("rule") == k, gate_passes(F.col("ct"), effective(config, k)["allowed_content_types"])).otherwise(passes)
        passed = answers.where(passes).withColumn("kind", content_kind(F.col("ct")))
        pages = written(parsed(passed, config, self.hooks.of("links", "extract", "transform"), now), "parsed")
        good = pages.where("failed IS NULL")
        named = written(fr.numbered(good.drop("links"), ["seq"], before["files"] + 1, "n").withColumn("file", F.concat(F.col("n").cast("string"), F.lit(".json"))), "named")
        batch = self.store.add_records(named.select("seq", "url", "content", F.lit(now).alias("crawled_at"), "data", "hash", "extra", "file"))
        skipped = answers.where(~passes).select("seq", "status", skip_reason(F.col("ct")).alias("skipped"))
        none = F.lit(None).cast("string")
        outcome = (
            named.select("seq", "file", none.alias("error"), none.alias("skipped"))
            .unionByName(skipped.select("seq", none.alias("file"), none.alias("error"), "skipped"))
            .unionByName(pages.where("failed IS NOT NULL").select("seq", none.alias("file"), F.col("failed").alias("error"), none.alias("skipped")))
            .unionByName(got.where("error IS NOT NULL").select("seq", none.alias("file"), "error", none.alias("skipped")))
        )
        outcome = written(outcome.join(got.select("seq", "status"), "seq"), "outcome")
        links = good.join(todo.select("seq", F.col("url").alias("referrer"), "depth"), "seq")
        found = links.select(F.posexplode("links").alias("pos", "raw"), "referrer", (F.col("depth") + 1).alias("depth"), F.col("seq").alias("parent"))
        new, n = self._new(found)
        limited = bool(got.where("rate_limited").take(1))
        made = {r["state"]: r["n"] for r in fr.state_counts(outcome).collect()}
        # A wave takes the first places that are pending. Those before the first that it left are all done.
        rest = todo.count() - sum(made.values())
        first = todo.join(outcome.select("seq"), "seq", "left_anti").agg(F.min("seq")).first()[0] if rest else todo.agg(F.max("seq") + 1).first()[0]
        self.store.append(new if n else None, outcome, None, batch, {**made, "pending": n - sum(made.values())}, self._due_after(asked, due), next=before["next"] + n, files=before["files"] + made.get("crawled", 0), pending_from=first)
        if not any(made.values()) and not limited:
            time.sleep(IDLE)  # every host has to wait longer than a lease
        self._tell(todo, outcome, got, named.withColumn("crawledAt", F.lit(now)))
        return limited

    def _due_after(self, asked: DataFrame, before: DataFrame | None) -> DataFrame | None:
        """Hosts that a next wave has to wait for: what is due later than now only, so a few of a long crawl's."""
        if hasattr(self.fetcher, "fetch_frame"):
            return None
        rows = asked.select(authority_of(F.col("url")).alias("host"), "due")
        rows = rows if before is None else rows.unionByName(before)
        return rows.where(F.col("due") > int(time.time() * 1000)).groupBy("host").agg(F.max("due").alias("due"))

    def _tell(self, todo: DataFrame, outcome: DataFrame, got: DataFrame, named: DataFrame) -> None:
        """Hooks that watch on the driver, row by row in the queue's order: page(record, entry, result),
        skip(entry, {reason, status, result}) and error(error, entry). Rows come one partition at a time."""
        if not any(self.hooks.has(h) for h in ("page", "skip", "error")):
            return
        entries = todo.join(outcome, "seq").select("seq", F.struct("seq", "url", "depth", "referrer", "file", "status", "error", "skipped").alias("entry"))
        answers = got.select("seq", F.struct("data", "status", "headers").alias("result"))
        rows = outcome.select("seq", "file", "error", "skipped", "status").join(entries, "seq").join(answers, "seq")
        if self.hooks.has("page"):
            records = named.select("seq", F.struct("url", "content", "crawledAt", "data", "hash", "extra").alias("record"))
            for row in rows.join(records, "seq").orderBy("seq").toLocalIterator():
                record = row["record"].asDict()
                extra, data = dict(record.pop("extra") or {}), record.pop("data")
                record |= ({} if data is None else {"data": parse_strict(data)}) | {k: parse_strict(v) for k, v in extra.items()}
                self.hooks.emit("page", record, row["entry"].asDict(), self._result(row))
        if self.hooks.has("skip"):
            for row in rows.where("skipped IS NOT NULL").orderBy("seq").toLocalIterator():
                self.hooks.emit("skip", row["entry"].asDict(), {"reason": row["skipped"], "status": row["status"], "result": self._result(row)})
        if self.hooks.has("error"):
            for row in rows.where("error IS NOT NULL").orderBy("seq").toLocalIterator():
                self.hooks.emit("error", FetchError(row["error"], row["status"]), row["entry"].asDict())

    @staticmethod
    def _result(row) -> dict:
        return {"data": None if row["result"]["data"] is None else bytes(row["result"]["data"]), "status": row["result"]["status"], "headers": dict(row["result"]["headers"] or {})}

    def _banner(self) -> None:
        crawl, config = self.config["crawl"], self.config
        name = getattr(self.fetcher, "name", type(self.fetcher).__name__)
        lines = [
            f"Start URLs: {', '.join(config['start_urls'])}",
            f"Fetcher: {name}",
            *([f"Browser wait until: {config['browser']['wait_until']}"] if name == "browser" else []),
            f"Concurrency: {crawl['concurrency']}",
            f"Per-host delay: {crawl['delay']} ms",
            f"Max depth: {crawl['max_depth']}",
            f"Max pages: {crawl['max_pages']}",
            f"Allowed content types: {', '.join(config['allowed_content_types'])}",
            f"Output format: {config['output']['format']}",
        ]
        self.logger.info("crawl starts\n%s", "\n".join(f"  - {x}" for x in lines))

    def crawl(self) -> dict[str, int]:
        """Waves until nothing is pending, ``stop`` was called, or max_pages are crawled; counts by state."""
        self.stopped, self._line = False, StopLine(self.spark)
        most = self.config["crawl"]["max_pages"]
        old = self._catch_signals()
        try:
            if hasattr(self.fetcher, "init"):
                self.fetcher.init()
            self.init()
            self._banner()
            self.seed_sitemaps()
            while not self.stopped:
                n = self.counts()
                left = None if most is None else most - n["crawled"]
                if not n["pending"] or (left is not None and left <= 0):
                    break
                todo = self.store.pending()
                if left is not None and left < n["pending"]:
                    last = fr.page_cutoff(todo.select("seq", F.lit(True).alias("ok")), left).agg(F.max("seq")).first()[0]
                    todo = todo.where(F.col("seq") <= last)
                self.logger.info("%d of %d done, %d to fetch", sum(n.values()) - n["pending"], sum(n.values()), n["pending"] if left is None else min(left, n["pending"]))
                if self._wave(todo):
                    raise RateLimitError(code=self.config["rate_limit"]["exit_code"])
            n = self.counts()
            self.statistics = {**n, "total": sum(n.values())}
            self.logger.info("crawl ends: %s", ", ".join(f"{k} {v}" for k, v in self.statistics.items()))
            return n
        finally:
            for s, handler in old.items():
                signal.signal(s, handler)
            self._line.close()
            self._line = None

    def _catch_signals(self) -> dict:
        if not self.config["signals"]:
            return {}

        def handle(number, frame):
            if self.stopped:
                raise SystemExit(1)
            self.logger.warning("stopping after the requests that run")
            self.stop()

        try:
            return {s: signal.signal(s, handle) for s in (signal.SIGINT, signal.SIGTERM)}
        except ValueError:  # not the main thread
            return {}

    def records(self) -> DataFrame:
        return self.store.records()

    def format(self, records: DataFrame | None = None) -> dict[str, int]:
        """Write the routed files; records per file."""
        return format_records(self.records() if records is None else records, self.config["output"], self.config["storage"]["formatted_dir"])

    def save_json(self, directory: str) -> dict[str, int]:
        """Write queue and records as pretty JSON into a folder; rows of each."""
        return save_json(self.queue, self.records(), directory)

    def run(self) -> DataFrame:
        try:
            self.crawl()
            self.format()
        finally:
            if hasattr(self.fetcher, "close"):
                self.fetcher.close()
        return self.queue


def create_crawler(spark: SparkSession, user: Mapping | None = None) -> Crawler:
    return Crawler(spark, user)


def crawl_site(spark: SparkSession, user: Mapping | None = None) -> DataFrame:
    """Create a crawler and run it; its queue."""
    return Crawler(spark, user).run()


def run_crawlers(spark: SparkSession, items: list, concurrency: int = 1) -> list[DataFrame]:
    """Queues of several crawlers or configurations, in their order, some at a time."""
    made = [x if hasattr(x, "run") else Crawler(spark, x) for x in items]
    with ThreadPoolExecutor(max(1, min(concurrency, len(made) or 1))) as pool:
        return list(pool.map(lambda c: c.run(), made))

