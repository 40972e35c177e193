"""Queries that run the crawler and its fetchers over webs made of the driver's tables, with the SQL that says the same."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.functions import urls
from silkweb.operators import frontier as fr
from silkweb.operators.schedule import leased
from silkweb.plans.config import load_config
from silkweb.plans.crawler import Crawler, parsed
from silkweb.sources.fetch import TableFetcher, rate_limit_wait
from silkweb.sources.shared import shared_dir
from silkweb.sources.store import prune, write_text

SITE = "https://w.example.com"
MAX_DEPTH = 6


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/silkweb/{name}-{uuid.uuid4().hex}"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every page_id, linking to two others, of which some don't exist, and to a file; some of them move,
    aren't pages, or answer at the second try."""
    i, n = F.col("page_id"), _pages(spark, sf_dir).agg(F.max("page_id")).first()[0]
    link = lambda to: F.concat(F.lit('<a href="/p/'), to.cast("string"), F.lit('"></a>'))
    body = F.concat(F.lit("<html><body><p>text "), i.cast("string"), F.lit("</p>"), link((3 * i + 1) % (2 * n)), link(F.concat(((5 * i + 2) % (2 * n)).cast("string"), F.lit("#x"))), F.lit('<a href="/x.pdf"></a></body></html>'))
    rows = _pages(spark, sf_dir).where("page_id > 0").select(
        F.concat(F.lit(f"{SITE}/p/"), i.cast("string")).alias("url"),
        F.when(i % 13 == 0, 301).when(i % 7 == 0, 200).when(i % 11 == 0, 503).otherwise(200).alias("status"),
        F.when((i % 13 != 0) & (i % 7 == 0), "image/gif").otherwise("text/html").alias("content_type"),
        F.when(i % 13 == 0, "/p/1").alias("location"),
        body.alias("body"),
        F.when((i % 13 != 0) & (i % 7 != 0) & (i % 11 == 0), 1).otherwise(0).alias("fail_times"),
    )
    home = spark.createDataFrame([(f"{SITE}/", 200, "text/html", None, "<html><body><p>home</p><a href=/p/1></a><a href=/p/2></a><a href=http://www.w.example.com/p/3/?q></a></body></html>", 0)], rows.schema)
    return rows.union(home)


def crawler_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl to its end, cut off after ten pages and taken up by another crawler; its queue and its records."""
    user = {"start_urls": [f"{SITE}/"], "fetcher": TableFetcher(_web(spark, sf_dir)), "signals": False, "log_level": "silent", "storage": {"dir": _place(spark, "fixpoint")}, "crawl": {"max_depth": MAX_DEPTH, "delay": 0, "max_pages": 10}}
    for most in (10, None):
        crawler = Crawler(spark, {**user, "crawl": {**user["crawl"], "max_pages": most}})
        crawler.on("should_enqueue", lambda allow, url, referrer: False if url.endswith("/p/5") else None)
        crawler.on("transform", lambda record, entry, result: {**record, "content": record["content"].upper()})
        crawler.crawl()
    records = crawler.records().select("seq", "content", "hash")
    return crawler.queue.withColumn("state", fr.state()).join(records, "seq", "left").select("seq", "url", "depth", "referrer", "state", "file", "status", "error", "skipped", "content", "hash")


def sitemap_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index of sitemaps, one of them the index again, puts in the queue."""
    loc = lambda x: F.concat(F.lit("<url><loc>"), x, F.lit("</loc></url>"))
    page = F.concat(F.lit(f"{SITE}/p/"), F.col("page_id").cast("string"))
    maps = _pages(spark, sf_dir).groupBy((F.col("page_id") % 4).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", loc(page).alias("x")))), lambda s: s["x"]), "").alias("x"))
    bodies = maps.select(F.concat(F.lit(f"{SITE}/s"), F.col("k").cast("string"), F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("body"))
    listed = "".join(f"<sitemap><loc>{SITE}/{m}.xml</loc></sitemap>" for m in ("s0", "s1", "sitemap", "s2", "s3", "none"))
    index = spark.createDataFrame([(f"{SITE}/sitemap.xml", f"<sitemapindex>{listed}</sitemapindex>")], bodies.schema)
    crawler = Crawler(spark, {"start_urls": [f"{SITE}/"], "fetcher": TableFetcher(bodies.union(index)), "signals": False, "log_level": "silent", "storage": {"dir": _place(spark, "sitemaps")}, "crawl": {"sitemap": True}})
    crawler.init()
    crawler.seed_sitemaps()
    return crawler.queue.select("seq", "url", "depth", "referrer")


def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for every event's URL: pages, redirects, failures that pass or don't, bodies beyond the limit, gaps."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("e"))
    at = lambda k: F.concat(F.lit("https://f.example.com/"), k.cast("string"))
    k = F.col("e") % 6
    web = e.where(k != 5).select(
        at(F.col("e")).alias("url"),
        F.when(k == 1, 301).when(k == 2, 503).when(k == 4, 404).otherwise(200).alias("status"),
        F.when(k == 1, F.concat(F.lit("/"), (F.col("e") + 1).cast("string"))).alias("location"),
        F.when(k == 3, F.repeat(F.lit("x"), 60)).otherwise(F.lit("ok")).alias("body"),
        F.when(k == 2, F.when(F.col("e") % 12 < 6, 1).otherwise(2)).otherwise(0).alias("fail_times"),
    )
    config = load_config({"start_urls": [f"{SITE}/"], "request": {"max_content_length": 50}})
    got = TableFetcher(web).fetch_frame(e.select(F.col("e").alias("seq"), at(F.col("e")).alias("url")), config)
    return got.select("url", "status", "error", F.octet_length("data").cast("long").alias("n"), "rate_limited")


def rate_limit_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds to wait after a 429 by its headers, at second 1000."""

    @F.pandas_udf(T.DoubleType())
    def wait(after: pd.Series, reset: pd.Series) -> pd.Series:
        named = [{k: v for k, v in (("retry-after", a), ("x-ratelimit-reset", r)) if v is not None} for a, r in zip(after, reset)]
        return pd.Series([rate_limit_wait(h, 60_000, 1000.0) for h in named])

    i = F.col("event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        F.when(i % 5 == 0, (i % 90).cast("string")).when(i % 5 == 1, "Thu, 01 Jan 1970 00:20:00 GMT").when(i % 5 == 2, "soon").alias("after"),
        F.when(i % 5 == 3, (i % 2000).cast("string")).alias("reset"),
    )
    return rows.select("event_id", wait("after", "reset").alias("ms"))


def fetch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When pages may be asked for, 250 ms apart for each host, within a lease of 5 s; some hosts were asked before."""
    at = _pages(spark, sf_dir).select(F.col("page_id").alias("seq"), urls.normalize_url(F.col("url")).alias("url")).where("url IS NOT NULL")
    host = urls.authority_of(F.col("url"))
    due = at.select(host.alias("host")).distinct().select("host", (F.length("host") % 5 * 700 - 300).alias("due"))
    return leased(at, 250, 5_000, due).select("seq", "host", "turn", "start")


def malformed_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of which some can't be parsed: those have no canonical form and go."""
    i = F.col("page_id")
    raw = F.when(i % 6 == 0, "no url").when(i % 6 == 1, "https://").when(i % 6 == 2, "https://a b.com/").when(i % 6 == 3, "https://h:99999/").when(i % 6 == 4, F.concat(F.lit("https://www.h"), i.cast("string"), F.lit(".com:443/a/../b/?q"))).otherwise(F.concat(F.lit("http://H"), i.cast("string"), F.lit(".com/%7Ea/#f")))
    return _pages(spark, sf_dir).select("page_id", urls.normalize_url(raw).alias("norm")).where("norm IS NOT NULL")


def parsed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of texts and of JSON, by a site that wants it printed and one that takes it as text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url"), F.coalesce("text", F.lit("")).alias("body"), F.lit("text").alias("kind"), F.lit(-1).alias("rule"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("url"), F.col("props").alias("body"), F.lit("json").alias("kind"), (F.col("event_id") % 2 - 1).cast("int").alias("rule"))
    rows = d.union(e).select(F.xxhash64("url").alias("seq"), "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("referrer"), F.col("body").cast("binary").alias("data"), F.lit(200).alias("status"), F.lit(None).cast("map<string,string>").alias("headers"), "kind", "rule")
    config = load_config({"start_urls": [f"{SITE}/"], "sites": [{"match": "raw", "extract": {"json": False}}]})
    return parsed(rows, config).select("url", "hash", F.col("data").isNotNull().alias("has_data"), F.size("links").alias("links"), "failed")


def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are left when those that no route writes any more go."""
    place = _place(spark, "stale")
    names = [r[0] for r in _pages(spark, sf_dir).select((F.col("page_id") % 5).cast("string")).distinct().collect()]  # five
    for name in names:
        write_text(spark, f"{place}/{name}/x.txt", name)
    prune(spark, place, {f"{place}/{name}/x.txt" for name in names if name in "024"})
    left = spark.read.text(place, wholetext=True, recursiveFileLookup=True)
    return left.select(F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+/x.txt)$", 1).alias("file"), F.col("value").alias("body"))


def queries() -> dict:
    return {f.__name__: f for f in (crawler_fixpoint, sitemap_levels, fetch_outcomes, fetch_schedule, rate_limit_waits, malformed_dropped, parsed_bodies, stale_files)}


def _fixpoint_sql() -> str:
    """Levels of a breadth-first search, one after the other."""
    kind = "CASE WHEN i = 0 THEN 'home' WHEN NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = i) THEN 'none' WHEN i % 13 = 0 THEN 'moved' WHEN i % 7 = 0 THEN 'image' ELSE 'page' END"
    parts = [
        "n AS (SELECT max(page_id) AS n FROM pages)",
        "own AS (SELECT page_id AS i, 0 AS pos, (3 * page_id + 1) % (2 * n) AS t FROM pages, n WHERE page_id > 0 UNION ALL SELECT page_id, 1, (5 * page_id + 2) % (2 * n) FROM pages, n WHERE page_id > 0 UNION ALL SELECT 0, k, k + 1 FROM range(3) r(k))",
        # A page that moved shows the links of page 1, an image none. Page 0 doesn't exist under /p/.
        "links AS (SELECT i, pos, t FROM own WHERE i = 0 OR (i % 13 <> 0 AND i % 7 <> 0) UNION ALL SELECT p.page_id, o.pos, o.t FROM pages p JOIN own o ON o.i = 1 WHERE p.page_id % 13 = 0 AND p.page_id > 0)",
        "l0 AS (SELECT 0::BIGINT AS seq, 0::BIGINT AS i, 0 AS depth, NULL::BIGINT AS parent, true AS home)",
    ]
    for d in range(1, MAX_DEPTH + 1):
        before = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(d))
        parts.append(f"b{d} AS ({before})")
        parts.append(
            f"l{d} AS (SELECT (SELECT max(seq) FROM b{d}) + row_number() OVER (ORDER BY f.seq, f.pos) AS seq, t AS i, {d} AS depth, f.i AS parent, false AS home FROM ("
            f"SELECT l.t, min(struct_pack(seq := s.seq, pos := l.pos, i := CASE WHEN s.home THEN -1 ELSE s.i END)) AS f FROM l{d - 1} s JOIN links l ON l.i = s.i AND (s.home OR s.i > 0) WHERE l.t <> 5 AND l.t NOT IN (SELECT i FROM b{d} WHERE NOT home) GROUP BY l.t))"
        )
    every = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(MAX_DEPTH + 1))
    return f"""WITH {", ".join(parts)}, q AS ({every}),
k AS (SELECT *, CASE WHEN home THEN 'home' WHEN i = 0 THEN 'none' ELSE {kind} END AS kind FROM q),
c AS (SELECT *, CASE kind WHEN 'home' THEN 'HOME' WHEN 'moved' THEN 'TEXT 1' WHEN 'page' THEN 'TEXT ' || i END AS content FROM k)
SELECT seq, CASE WHEN home THEN '{SITE}/' ELSE '{SITE}/p/' || i END AS url, depth, CASE WHEN parent = -1 THEN '{SITE}/' WHEN parent IS NOT NULL THEN '{SITE}/p/' || parent END AS referrer,
  CASE kind WHEN 'none' THEN 'error' WHEN 'image' THEN 'skipped' ELSE 'crawled' END AS state,
  CASE WHEN content IS NOT NULL THEN count(content) OVER (ORDER BY seq) || '.json' END AS file, CASE kind WHEN 'none' THEN 404 ELSE 200 END::INT AS status,
  CASE kind WHEN 'none' THEN 'Invalid status code: 404' END AS error, CASE kind WHEN 'image' THEN 'content-type: image/gif' END AS skipped, content, sha256(content) AS hash
FROM c"""


def oracle_sql() -> dict[str, str]:
    return {
        "crawler_fixpoint": _fixpoint_sql(),
        "sitemap_levels": f"SELECT 0::BIGINT AS seq, '{SITE}/' AS url, 0 AS depth, NULL::VARCHAR AS referrer UNION ALL SELECT row_number() OVER (ORDER BY page_id % 4, page_id), '{SITE}/p/' || page_id, 0, '{SITE}/s' || (page_id % 4) || '.xml' FROM pages",
        "fetch_outcomes": f"""WITH t AS (SELECT event_id AS e, CASE event_id % 6 WHEN 1 THEN event_id + 1 ELSE event_id END AS k FROM events),
s AS (SELECT e, CASE WHEN k NOT IN (SELECT event_id FROM events) THEN 404 ELSE CASE k % 6 WHEN 2 THEN CASE WHEN k % 12 < 6 THEN 200 ELSE 503 END WHEN 3 THEN 413 WHEN 4 THEN 404 WHEN 5 THEN 404 ELSE 200 END END AS status FROM t)
SELECT 'https://f.example.com/' || e AS url, status::INT AS status, CASE status WHEN 413 THEN 'Response too large: 60 bytes (max 50)' WHEN 200 THEN NULL ELSE 'Invalid status code: ' || status END AS error, CASE WHEN status = 200 THEN 2 END::BIGINT AS n, false AS rate_limited FROM s""",
        "fetch_schedule": r"""WITH h AS (SELECT page_id AS seq, regexp_extract(url, '^https?://(?:www\.)?([^/?#]+)', 1) AS host FROM pages WHERE url IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) - 1 AS turn FROM h), s AS (SELECT *, greatest(0, length(host) % 5 * 700 - 300) + turn * 250 AS start FROM t)
SELECT seq, host, turn, start FROM s WHERE start < 5000""",
        "rate_limit_waits": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN (event_id % 90) * 1000 WHEN 1 THEN 200000 WHEN 3 THEN greatest(0, event_id % 2000 - 1000) * 1000 ELSE 60000 END::DOUBLE AS ms FROM events",
        "malformed_dropped": "SELECT page_id, CASE page_id % 6 WHEN 4 THEN 'https://h' || page_id || '.com/b' ELSE 'https://h' || page_id || '.com/%7Ea' END AS norm FROM pages WHERE page_id % 6 >= 4",
        "parsed_bodies": """WITH e AS (SELECT event_id, props, regexp_extract(props, '(-?[0-9]+)', 1) AS k FROM events)
SELECT 'd' || doc_id AS url, sha256(coalesce(text, '')) AS hash, false AS has_data, 0 AS links, NULL::VARCHAR AS failed FROM documents
UNION ALL SELECT 'e' || event_id, sha256(CASE WHEN event_id % 2 = 1 THEN props ELSE '{' || chr(10) || '  "k": ' || k || chr(10) || '}' END), event_id % 2 = 0, 0, NULL FROM e""",
        "stale_files": "SELECT DISTINCT (page_id % 5) || '/x.txt' AS file, (page_id % 5)::VARCHAR AS body FROM pages WHERE page_id % 5 IN (0, 2, 4)",
    }
