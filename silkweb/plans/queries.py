"""Queries of the engine's own operators over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkweb.functions import content, html, patterns, sitemap, urls
from silkweb.operators import frontier as fr
from silkweb.operators import rule_index as rule_index_of
from silkweb.operators import rules
from silkweb.plans import crawl_queries, output
from silkweb.plans.config import REMOVED_ELEMENTS, load_config
from silkweb.sources.shared import shared_dir, written
from silkweb.sources.store import Store

CONFIG = load_config(
    {
        "start_urls": ["https://ththre.example.com/fr/825"],
        "include": ["https://blog.ththan.example.net", "/example\\.(com|org)\\/(en|fr)/", "https://spam-farm.example.org/en"],
        "exclude": {"extend": ["/spam-/", "therin"]},
        "sites": [
            {"match": "example.net", "extract": {"root": "h1"}},
            {"match": ["https://blog.ththan.example.net/en", "/^https:\\/\\/m\\./"], "extract": {"root": "article"}, "allowed_content_types": ["application/json"]},
        ],
        "output": {
            "format": "jsonl",
            "exclude": ["cheap-pills"],
            "routes": {
                "example.com": {"en": "com/en.txt", "fr": "com/fr.txt", "*": "com/rest.txt"},
                "https://spam-farm.example.org": {"en": "spam.txt"},
                "/\\.net\\//": {"*": "net.txt"},
                "example.org": {"de": "org-de.txt", "*": "org.txt"},
            },
        },
    }
)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).withColumn("norm", urls.normalize_url(F.col("url")))


# The SQL for pages' URLs, which are clean ASCII.
NORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://(www\\.)?', 'https://'), '^(https://[^/]+)$', '\\1/'), '^(https://[^/]+/.*[^/])/$', '\\1')"
_N = f"n AS (SELECT *, {NORM} AS norm FROM pages)"
_PATH = "regexp_extract(norm, '^https://[^/]+(/.*)$', 1)"
_ORIGIN = "regexp_extract(norm, '^(https://[^/]+)', 1)"
# Readable text of pages' fixed template.
_STRIP = r"regexp_replace(regexp_replace({}, '(?s)<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>|<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_ENTITIES = "regexp_replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;?', '&', 'g')"


def _text_sql(part: str) -> str:
    return f"trim(regexp_replace(replace({_ENTITIES.format(_STRIP.format(part))}, chr(10), ' '), ' {{2,}}', ' ', 'g'))"


def _links_sql() -> str:
    """(page_id, norm, pos, href, dst) of the pages' distinct links; their hrefs are root-relative."""
    escaped = "replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '%21', '!')"
    return f"""{_N}, h AS (SELECT page_id, norm, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(generate_series(1, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS k FROM n),
l AS (SELECT page_id, norm, href, min(k) AS k, {_ORIGIN} || {escaped} AS dst FROM h WHERE href <> '' AND href[1] <> '#' GROUP BY page_id, norm, href),
links AS (SELECT page_id, norm, dst, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos FROM l)"""


def url_normalize(spark, sf_dir):
    return _known(spark, sf_dir).select("page_id", "norm")


#: Hosts in letters of many kinds, and what they are called.
HOSTS = (
    ("fa\u00df.de", "xn--fa-hia.de"),
    ("\u03b2\u03cc\u03bb\u03bf\u03c2.com", "xn--nxasmm1c.com"),
    ("B\u00dcCHER.example", "xn--bcher-kva.example"),
    ("\uff45\uff58\uff41\uff4d\uff50\uff4c\uff45.com", "example.com"),
    ("\u2615.us", "xn--53h.us"),
    ("www.a\u3002b\u00ad.com", "a.b.com"),
)


def idn_hosts(spark, sf_dir):
    """Canonical URLs on hosts that aren't ASCII."""
    host = F.element_at(F.array(*[F.lit(h) for h, _ in HOSTS]), (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    return _pages(spark, sf_dir).select("page_id", urls.normalize_url(F.concat(F.lit("http://"), host, F.lit("/"), F.col("page_id").cast("string"), F.lit("/?q"))).alias("norm"))


def url_parts(spark, sf_dir):
    n = F.col("norm")
    return _known(spark, sf_dir).select("page_id", urls.authority_of(n).alias("host"), F.array_join(urls.path_segments(n), "|").alias("segments"), F.array_join(urls.path_prefixes(n), "|").alias("prefixes"), urls.sitemap_url(n).alias("sitemap"))


def _pattern(pattern: str):
    return lambda spark, sf_dir: _known(spark, sf_dir).select("page_id", patterns.matches(F.col("norm"), pattern).alias("matched"))


def pattern_any(spark, sf_dir):
    n = F.col("norm")
    return _known(spark, sf_dir).select("page_id", patterns.matches_any(n, ["/\\/EN\\//i", "blog."]).alias("matched"), patterns.matches_any(n, []).alias("none"))


def crawl_admission(spark, sf_dir):
    starts = [urls.normalize(u) for u in CONFIG["start_urls"]]
    return _known(spark, sf_dir).where(patterns.admitted(F.col("norm"), starts, CONFIG["exclude"], CONFIG["include"])).select("page_id", "norm")


def exclude_binary(spark, sf_dir):
    endings = F.element_at(F.array(*map(F.lit, (".pdf", ".HTML", ".Png", ""))), (F.col("page_id") % 4 + 1).cast("int"))
    named = _known(spark, sf_dir).select("page_id", F.concat("norm", endings).alias("norm"))
    return named.where(~patterns.matches_any(F.col("norm"), CONFIG["exclude"][:1]))


def frontier_dedup(spark, sf_dir):
    found = _known(spark, sf_dir).select(F.col("norm").alias("url"), F.col("url").alias("referrer"), F.lit(0).alias("depth"), F.col("page_id").alias("parent"), F.lit(0).alias("pos"))
    place = f"{shared_dir(spark)}/silkweb/dedup-{uuid.uuid4().hex}"
    store = Store(spark, {"queue_path": f"{place}/queue", "crawled_dir": f"{place}/crawled"})
    known = _known(spark, sf_dir).where("page_id % 7 = 0").groupBy(F.col("norm").alias("url")).agg(F.min("page_id").alias("seq"))
    store.append(found=known.select("seq", "url", F.lit(None).alias("referrer"), F.lit(0).alias("depth")))
    return store.unseen(fr.first_of_each(found)).select("url", F.col("parent").alias("page_id"))


def extract_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.extract_text_column(F.col("html"), REMOVED_ELEMENTS).alias("content"))


def extract_text_root(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html.extract_text_column(F.col("html"), REMOVED_ELEMENTS, root="article").alias("content"))


#: Faults put before a page's article: an anchor in an anchor, markup in a text field, a table that holds all that follows.
FAULTS = '<p><a href="/one">1<a href="/two">2</a><b>3<i>4</b>5</i></p><textarea><b>6</b></textarea><table><tr><td>7</td></tr>'


def faulty_pages(spark, sf_dir):
    """Text and links of pages with faults, which only the standard's tree tells: what follows the table comes before it."""
    page = F.replace("html", F.lit("<article>"), F.lit(FAULTS + "<article>"))
    rows = _known(spark, sf_dir).where("contains(html, '<article>')").select("page_id", "norm", page.alias("html"))
    texts = [{"remove_selectors": REMOVED_ELEMENTS}, {"root": "table td, textarea, p:has(> a ~ a) > :not(a)"}]
    read = rows.select("page_id", html.page_column(F.col("html"), F.col("norm"), texts).alias("p"))
    links = F.filter("p.links", lambda x: x.endswith("/one") | x.endswith("/two"))
    return read.select("page_id", F.col("p.texts")[0].alias("content"), F.array_join(links, " ").alias("links"), F.col("p.texts")[1].alias("cells"))


def selected_text(spark, sf_dir):
    """Text by selectors of structure and content, a site's own among them."""
    sites = [{"match": "example.net", "extract": {"root": "article > p:nth-child(2)", "remove_selectors": {"replace": ["nav", "article > :last-child:not(:nth-child(2))"]}}}]
    config = load_config({"start_urls": CONFIG["start_urls"], "sites": sites, "extract": {"root": "article:not(:empty)", "remove_selectors": {"extend": ["article > :nth-child(n + 2)", "nav li:nth-last-child(2)"]}}})
    rule = rules.site_rule(F.col("norm"), config["sites"])
    rows = _known(spark, sf_dir).where("contains(html, '<article>')").withColumn("rule", rule)
    made = [rules.effective(config, k)["extract"] for k in (-1, 0)]
    each = [rows.where(F.col("rule") == k - 1).select("page_id", html.extract_text_column(F.col("html"), e["remove_selectors"], e["root"]).alias("content")) for k, e in enumerate(made)]
    return each[0].union(each[1])


def _links(spark, sf_dir) -> DataFrame:
    rows = _known(spark, sf_dir).select("page_id", "norm", "html")
    return rows.select("page_id", "norm", F.posexplode(html.discover_links_column(F.col("html"), F.col("norm"))).alias("pos", "dst"))


def discover_links(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "dst")


def link_outdegree(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("links"))


def link_first_discovery(spark, sf_dir):
    found = _links(spark, sf_dir).select(F.col("dst").alias("url"), F.col("norm").alias("referrer"), F.lit(1).alias("depth"), F.col("page_id").alias("parent"), "pos")
    known = _known(spark, sf_dir).select(F.col("norm").alias("url"))
    return fr.first_discovered(found, known, max_depth=1).select("url", "referrer", F.col("parent").alias("page_id"), "pos")


def _bodies(spark, sf_dir) -> DataFrame:
    """Responses of several types made from pages, events and documents."""
    kinds = [("pages", "page_id", "text/html; charset=utf-8", "html"), ("events", "event_id", "application/json", "props"), ("documents", "doc_id", "text/plain", "text")]
    out = None
    for name, key, kind, body in kinds:
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        odd = F.when(F.col(key) % 10 == 3, F.lit(None)).when(F.col(key) % 10 == 4, F.lit("")).when(F.col(key) % 10 == 5, F.lit("Text/HTML")).otherwise(F.lit(kind))
        rows = t.select(F.lit(name).alias("origin"), F.col(key).alias("id"), odd.alias("ct"), F.col(body).alias("body"))
        out = rows if out is None else out.unionByName(rows)
    return out


def content_gate(spark, sf_dir):
    ct = F.col("ct")
    rows = _bodies(spark, sf_dir).select("origin", "id", content.gate_passes(ct, ["text/html", "application/json"]).alias("passes"), content.content_kind(ct).alias("kind"), content.skip_reason(ct).alias("reason"))
    return rows.select("origin", "id", "passes", "kind", F.when(~F.col("passes"), F.col("reason")).alias("reason"))


def parse_json_pretty(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", content.parse_json_column(F.col("props")).alias("j")).select("event_id", "j.data", "j.content")


def content_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


def duplicate_content(spark, sf_dir):
    same = content_hash(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return same.where("n > 1")


def site_override(spark, sf_dir):
    return _known(spark, sf_dir).select("page_id", rules.site_rule(F.col("norm"), CONFIG["sites"]).alias("rule"))


def _many_rules(spark, sf_dir) -> DataFrame:
    """Forty rules from every page: prefixes of hosts and paths, pieces of URLs, regular expressions."""
    rows = _known(spark, sf_dir).select("page_id", "norm", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    host, segment = F.split_part("norm", F.lit("/"), F.lit(3)), F.split_part("norm", F.lit("/"), F.lit(4))
    k, i = F.col("k"), F.col("page_id")
    prefix = F.concat(F.lit("https://"), host, F.when(k % 16 == 0, F.lit("")).when(k % 16 == 4, F.concat(F.lit("/"), segment)).otherwise(F.concat(F.lit("/"), segment, F.lit("/"), ((i * 40 + k) % 1000).cast("string"))))
    piece = F.substr("norm", (F.lit(9) + (i + k) % 17).cast("int"), (F.lit(4) + k % 7).cast("int"))
    expression = F.concat(F.lit("/"), F.replace(host, F.lit("."), F.lit("\\.")), F.lit("\\/[a-e]"), segment.substr(2, 9), F.lit("\\/"), (i % 10).cast("string"), F.lit("+/"))
    return rows.select((i * 40 + k).alias("rule"), F.when(k % 4 == 0, prefix).when(k % 4 == 3, expression).otherwise(piece).alias("pattern"))


def rule_index(spark, sf_dir):
    """The most specific of forty rules for each page, over all pages."""
    return rule_index_of.most_specific(_known(spark, sf_dir).select("page_id", "norm"), _many_rules(spark, sf_dir), "norm").select("page_id", "rule")


def route_index(spark, sf_dir):
    """The configuration's routes as tables."""
    pages = _known(spark, sf_dir).where(~patterns.matches_any(F.col("norm"), CONFIG["output"]["exclude"])).select("page_id", "norm")
    return rule_index_of.routed_by(pages, *rule_index_of.rules_of(spark, CONFIG["output"]["routes"]), "norm").select("page_id", F.concat(F.lit("out/"), "file").alias("file"))


def _routed(spark, sf_dir) -> DataFrame:
    rows = _known(spark, sf_dir).select(F.col("page_id").alias("seq"), F.col("norm").alias("url"), F.lit("x").alias("content"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("map<string,string>").alias("extra"))
    return output.routed(rows, CONFIG["output"], "out")


def route_records(spark, sf_dir):
    return _routed(spark, sf_dir).select(F.col("seq").alias("page_id"), "file")


def route_counts(spark, sf_dir):
    return _routed(spark, sf_dir).groupBy("file").agg(F.count("*").alias("n"))


def output_exclude(spark, sf_dir):
    return _known(spark, sf_dir).where(~patterns.matches_any(F.col("norm"), CONFIG["output"]["exclude"])).select("page_id")


def _files(spark, sf_dir, form: str) -> DataFrame:
    """The files as they are written, with their records' number."""
    place = f"{shared_dir(spark)}/silkweb/files-{uuid.uuid4().hex}"
    # URLs are written first: else routing and printing normalise them again, each in Python workers of its own.
    known = written(_known(spark, sf_dir).select("page_id", "norm"), "files-urls")
    rows = known.select(F.col("page_id").alias("seq"), F.col("norm").alias("url"), F.lit("x").alias("content"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("map<string,string>").alias("extra"))
    counts = output.format_records(rows, {**CONFIG["output"], "format": form}, f"{place}/out")
    number = spark.createDataFrame([(f[f.index("/out/") + 1 :], n) for f, n in counts.items()], "file string, n long")
    bodies = spark.read.text(f"{place}/out", wholetext=True, recursiveFileLookup=True)
    named = bodies.select(F.regexp_extract(F.col("_metadata.file_path"), r"/(out/[^/].*)$", 1).alias("file"), F.col("value").alias("body"))
    return named.join(number, "file")


def output_lines(spark, sf_dir):
    return _files(spark, sf_dir, "lines")


def output_jsonl(spark, sf_dir):
    return _files(spark, sf_dir, "jsonl")


def output_json(spark, sf_dir):
    return _files(spark, sf_dir, "json")


def _queue(spark, sf_dir) -> DataFrame:
    """A queue with rows in all states, some with more than one mark."""
    k = F.col("page_id")
    rows = _known(spark, sf_dir)
    return rows.select(
        k.alias("seq"),
        F.col("norm").alias("url"),
        F.when(k % 3 == 0, F.concat((k * 7 % 1000).cast("string"), F.lit(".json"))).alias("file"),
        F.when(k % 3 < 2, F.lit(200)).cast("int").alias("status"),
        F.when(k % 4 == 0, F.lit("boom")).alias("error"),
        F.when(k % 5 == 0, F.lit("content-type: none")).alias("skipped"),
        F.lit(None).cast("string").alias("referrer"),
        F.lit(0).alias("depth"),
    )


def queue_states(spark, sf_dir):
    return fr.state_counts(_queue(spark, sf_dir))


def next_dataset_id(spark, sf_dir):
    return fr.last_file_number(_queue(spark, sf_dir))


def requeue_errors(spark, sf_dir):
    return fr.requeued(_queue(spark, sf_dir), "error").select("seq", "url", "file", "status", "error", "skipped")


def max_pages_cutoff(spark, sf_dir):
    return fr.page_cutoff(_queue(spark, sf_dir).select("seq", (F.col("seq") % 3 != 1).alias("ok")), 40)


def crawl_bfs(spark, sf_dir):
    """Two levels of a crawl with the pages as seeds and as the web: seeds are there, what they link to is not."""
    first = written(_known(spark, sf_dir).select("page_id", "norm").groupBy("norm").agg(F.min("page_id").alias("page_id")), "bfs-first")
    pages = first.join(_pages(spark, sf_dir).select("page_id", "html"), "page_id")
    seeds = first.select(F.col("norm").alias("url"), F.lit("crawled").alias("state"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("referrer"))
    links = pages.select("page_id", "norm", F.posexplode(html.discover_links_column(F.col("html"), F.col("norm"))).alias("pos", "raw"))
    found = links.select(urls.normalize_url(F.col("raw")).alias("url"), F.col("norm").alias("referrer"), F.lit(1).alias("depth"), F.col("page_id").alias("parent"), "pos")
    new = fr.first_discovered(found, seeds, max_depth=1)
    met = new.join(first.select(F.col("norm").alias("url"), F.lit("crawled").alias("met")), "url", "left")
    return seeds.unionByName(met.select("url", F.coalesce("met", F.lit("error")).alias("state"), "depth", "referrer"))


def parse_sitemap(spark, sf_dir):
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), F.replace("norm", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>x</lastmod></url></urlset>"))
    return _known(spark, sf_dir).select("page_id", sitemap.parse_sitemap_column(xml).alias("s")).select("page_id", F.size("s.sitemaps").alias("maps"), F.col("s.urls")[0].alias("loc"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to routed records: canonical URL, first one wins, readable text, hash, output file."""
    # Small columns go through the shuffles: whole pages are read where they lie, those of the first rows alone.
    first = written(_known(spark, sf_dir).select("page_id", "norm").where("norm IS NOT NULL").groupBy("norm").agg(F.min("page_id").alias("page_id")), "flagship-first")
    pages = _pages(spark, sf_dir).select("page_id", "html").join(first.select("page_id"), "page_id", "left_semi")
    texts = pages.select("page_id", html.extract_text_column(F.col("html"), REMOVED_ELEMENTS).alias("content"))
    hashed = texts.select("page_id", F.sha2("content", 256).alias("hash"), F.char_length("content").alias("chars"))
    rows = first.join(hashed, "page_id").withColumn("file", rules.route(F.col("norm"), CONFIG["output"]["routes"], CONFIG["output"]["exclude"], "out"))
    return rows.select("page_id", F.col("norm").alias("url"), "file", "hash", "chars")


PATTERNS = {"pattern_regex": "/example\\.(com|net)\\/en/", "pattern_substring": "blog.th", "pattern_url_prefix": "https://blog.ththan.example.net/en"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (flagship, url_normalize, idn_hosts, url_parts, pattern_any, crawl_admission, exclude_binary, frontier_dedup, extract_text, extract_text_root, faulty_pages, selected_text, discover_links, link_outdegree, link_first_discovery, content_gate, parse_json_pretty, content_hash, duplicate_content, site_override, rule_index, route_index, route_records, route_counts, output_exclude, output_lines, output_jsonl, output_json, queue_states, next_dataset_id, requeue_errors, max_pages_cutoff, crawl_bfs, parse_sitemap)
    return {f.__name__: f for f in plain} | {name: _pattern(p) for name, p in PATTERNS.items()} | crawl_queries.queries()


_ROUTE = """CASE WHEN contains(norm, 'cheap-pills') THEN NULL
  WHEN norm LIKE 'https://spam-farm.example.org/%' THEN CASE WHEN seg = 'en' THEN 'out/spam.txt' END
  WHEN contains(norm, 'example.com') THEN CASE seg WHEN 'en' THEN 'out/com/en.txt' WHEN 'fr' THEN 'out/com/fr.txt' ELSE 'out/com/rest.txt' END
  WHEN contains(norm, 'example.org') THEN CASE seg WHEN 'de' THEN 'out/org-de.txt' ELSE 'out/org.txt' END
  WHEN contains(norm, '.net/') THEN 'out/net.txt' END"""
_R = f"{_N}, r AS (SELECT * FROM (SELECT page_id, norm, {_ROUTE} AS file FROM (SELECT *, split_part({_PATH}, '/', 2) AS seg FROM n)) WHERE file IS NOT NULL)"
_BODIES = """b AS (SELECT origin, id, CASE id % 10 WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN 'Text/HTML' ELSE ct END AS ct FROM (
  SELECT 'pages' AS origin, page_id AS id, 'text/html; charset=utf-8' AS ct FROM pages UNION ALL SELECT 'events', event_id, 'application/json' FROM events UNION ALL SELECT 'documents', doc_id, 'text/plain' FROM documents))"""
_Q = f"""{_N}, q AS (SELECT page_id AS seq, norm AS url, CASE WHEN page_id % 3 = 0 THEN (page_id * 7 % 1000) || '.json' END AS file, CASE WHEN page_id % 3 < 2 THEN 200 END::INT AS status,
  CASE WHEN page_id % 4 = 0 THEN 'boom' END AS error, CASE WHEN page_id % 5 = 0 THEN 'content-type: none' END AS skipped FROM n),
s AS (SELECT *, CASE WHEN file IS NOT NULL THEN 'crawled' WHEN error IS NOT NULL THEN 'error' WHEN skipped IS NOT NULL THEN 'skipped' ELSE 'pending' END AS state FROM q)"""
_FIRST = "f AS (SELECT norm, min(page_id) AS page_id FROM n GROUP BY norm)"


def oracle_sql() -> dict[str, str]:
    order = "ORDER BY norm COLLATE en_us, page_id"
    article = "coalesce(nullif(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), ''), html)"
    return crawl_queries.oracle_sql() | {
        "flagship": f"WITH {_N}, {_FIRST}, t AS (SELECT f.page_id, f.norm, html, split_part({_PATH.replace('norm', 'f.norm')}, '/', 2) AS seg FROM f JOIN pages USING (page_id)), u AS (SELECT page_id, norm AS url, {_ROUTE} AS file, {_text_sql('html')} AS content FROM t) SELECT page_id, url, file, sha256(content) AS hash, length(content) AS chars FROM u",
        "url_normalize": f"WITH {_N} SELECT page_id, norm FROM n",
        "idn_hosts": f"SELECT page_id, 'https://' || CASE page_id % {len(HOSTS)} {' '.join(f"WHEN {k} THEN '{name}'" for k, (_, name) in enumerate(HOSTS))} END || '/' || page_id AS norm FROM pages",
        "url_parts": f"""WITH {_N}, p AS (SELECT page_id, {_ORIGIN} AS origin, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS seg FROM n)
SELECT page_id, origin[9:] AS host, array_to_string(seg, '|') AS segments, array_to_string(list_transform(range(len(seg), 0, -1), lambda i: array_to_string(seg[1:i], '/')), '|') AS prefixes, origin || '/sitemap.xml' AS sitemap FROM p""",
        "pattern_regex": f"WITH {_N} SELECT page_id, regexp_matches(norm, 'example\\.(com|net)/en') AS matched FROM n",
        "pattern_substring": f"WITH {_N} SELECT page_id, contains(norm, 'blog.th') AS matched FROM n",
        "pattern_url_prefix": f"WITH {_N} SELECT page_id, norm = 'https://blog.ththan.example.net/en' OR norm LIKE 'https://blog.ththan.example.net/en/%' AS matched FROM n",
        "pattern_any": f"WITH {_N} SELECT page_id, regexp_matches(norm, '(?i)/EN/') OR contains(norm, 'blog.') AS matched, false AS none FROM n",
        "crawl_admission": f"""WITH {_N} SELECT page_id, norm FROM n WHERE norm = 'https://ththre.example.com/fr/825' OR (NOT (regexp_matches(norm, 'spam-') OR contains(norm, 'therin') OR regexp_matches(norm, '(?i)\\.(pdf|png|css|js)$'))
  AND (norm LIKE 'https://blog.ththan.example.net/%' OR regexp_matches(norm, 'example\\.(com|org)/(en|fr)') OR norm LIKE 'https://spam-farm.example.org/en/%'))""",
        "exclude_binary": f"WITH {_N}, m AS (SELECT page_id, norm || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.HTML' WHEN 2 THEN '.Png' ELSE '' END AS norm FROM n) SELECT * FROM m WHERE NOT regexp_matches(norm, '(?i)\\.(pdf|png)$')",
        "frontier_dedup": f"WITH {_N} SELECT norm AS url, min(page_id) AS page_id FROM n WHERE norm NOT IN (SELECT norm FROM n WHERE page_id % 7 = 0) GROUP BY norm",
        "extract_text": f"SELECT page_id, {_text_sql('html')} AS content FROM pages",
        "extract_text_root": f"SELECT page_id, {_text_sql(article)} AS content FROM pages",
        "faulty_pages": f"""WITH {_N}, s AS (SELECT page_id, {_ORIGIN} AS o, {_text_sql("split_part(html, '<article>', 1)")} AS a, {_text_sql("regexp_extract(html, '(?s)<article>.*$', 0)")} AS b FROM n WHERE contains(html, '<article>'))
SELECT page_id, trim(regexp_replace(a || ' 1 2 3 4 5 ' || b || ' 7', ' {{2,}}', ' ', 'g')) AS content, o || '/one ' || o || '/two' AS links, '3 4 5 <b>6</b> 7' AS cells FROM s""",
        "selected_text": f"""WITH {_N} SELECT page_id, CASE WHEN contains(norm, 'example.net') THEN {_text_sql("regexp_extract(html, '(?s)</h1><p>(.*?)(</?p>|</article>)', 1)")} ELSE {_text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} END AS content FROM n WHERE contains(html, '<article>')""",
        "discover_links": f"WITH {_links_sql()} SELECT page_id, pos, dst FROM links",
        "link_outdegree": f"WITH {_links_sql()} SELECT page_id, count(*) AS links FROM links GROUP BY page_id",
        "link_first_discovery": f"WITH {_links_sql()}, o AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY page_id, pos) AS rn FROM links WHERE dst NOT IN (SELECT norm FROM n)) SELECT dst AS url, norm AS referrer, page_id, pos FROM o WHERE rn = 1",
        "content_gate": f"""WITH {_BODIES}, g AS (SELECT *, coalesce(ct <> '' AND (contains(ct, 'text/html') OR contains(ct, 'application/json')), false) AS passes FROM b)
SELECT origin, id, passes, CASE WHEN contains(lower(coalesce(ct, '')), 'json') THEN 'json' WHEN contains(lower(coalesce(ct, '')), 'html') THEN 'html' ELSE 'text' END AS kind, CASE WHEN NOT passes THEN 'content-type: ' || coalesce(ct, 'none') END AS reason FROM g""",
        "parse_json_pretty": "SELECT event_id, '{\"k\":' || regexp_extract(props, '(-?[0-9]+)', 1) || '}' AS data, '{' || chr(10) || '  \"k\": ' || regexp_extract(props, '(-?[0-9]+)', 1) || chr(10) || '}' AS content FROM events",
        "content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents",
        "duplicate_content": "SELECT sha256(coalesce(text, '')) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
        "site_override": f"WITH {_N} SELECT page_id, CASE WHEN norm = 'https://blog.ththan.example.net/en' OR norm LIKE 'https://blog.ththan.example.net/en/%' OR norm LIKE 'https://m.%' THEN 1 WHEN contains(norm, 'example.net') THEN 0 ELSE -1 END::INT AS rule FROM n",
        "rule_index": f"""WITH {_N}, k AS (SELECT page_id AS i, norm, split_part(norm, '/', 3) AS host, split_part(norm, '/', 4) AS seg, unnest(range(40)) AS k FROM n),
r AS (SELECT i * 40 + k AS rule, k % 4 AS kind, CASE WHEN k % 4 = 0 THEN 'https://' || host || CASE k % 16 WHEN 0 THEN '' WHEN 4 THEN '/' || seg ELSE '/' || seg || '/' || ((i * 40 + k) % 1000) END
  WHEN k % 4 = 3 THEN replace(host, '.', '\\.') || '/[a-e]' || seg[2:10] || '/' || (i % 10) || '+' ELSE norm[9 + (i + k) % 17 : 12 + (i + k) % 17 + k % 7] END AS text FROM k),
u AS (SELECT DISTINCT norm FROM n),
m AS (SELECT norm, rule, length(text) + CASE WHEN kind = 3 THEN 4 ELSE 0 END AS size FROM u JOIN r ON CASE kind WHEN 0 THEN norm = rtrim(text, '/') OR starts_with(norm, rtrim(text, '/') || '/') WHEN 3 THEN regexp_matches(norm, text) ELSE contains(norm, text) END),
b AS (SELECT norm, arg_min(rule, struct_pack(a := -size, b := rule)) AS rule FROM m GROUP BY norm)
SELECT page_id, rule FROM n LEFT JOIN b USING (norm)""",
        "route_index": f"WITH {_R} SELECT page_id, file FROM r",
        "route_records": f"WITH {_R} SELECT page_id, file FROM r",
        "route_counts": f"WITH {_R} SELECT file, count(*) AS n FROM r GROUP BY file",
        "output_exclude": f"WITH {_N} SELECT page_id FROM n WHERE NOT contains(norm, 'cheap-pills')",
        "output_lines": f"WITH {_R} SELECT file, string_agg(norm || ' x', chr(10) {order}) AS body, count(*) AS n FROM r GROUP BY file",
        "output_jsonl": f"""WITH {_R} SELECT file, string_agg('{{"url":"' || norm || '","content":"x"}}', chr(10) {order}) || chr(10) AS body, count(*) AS n FROM r GROUP BY file""",
        "output_json": f"""WITH {_R} SELECT file, '[' || chr(10) || string_agg('  {{' || chr(10) || '    "url": "' || norm || '",' || chr(10) || '    "content": "x"' || chr(10) || '  }}', ',' || chr(10) {order}) || chr(10) || ']' AS body, count(*) AS n FROM r GROUP BY file""",
        "queue_states": f"WITH {_Q} SELECT state, count(*) AS n FROM s GROUP BY state",
        "next_dataset_id": f"WITH {_Q} SELECT max(regexp_extract(file, '(\\d+)\\.json$', 1)::BIGINT) AS n FROM q WHERE file IS NOT NULL",
        "requeue_errors": f"WITH {_Q} SELECT CASE WHEN state = 'error' THEN (SELECT max(seq) FROM s) + row_number() OVER (PARTITION BY state = 'error' ORDER BY seq) ELSE seq END AS seq, url, file, CASE WHEN state <> 'error' THEN status END AS status, CASE WHEN state <> 'error' THEN error END AS error, CASE WHEN state <> 'error' THEN skipped END AS skipped FROM s",
        "max_pages_cutoff": f"WITH {_Q}, o AS (SELECT seq, seq % 3 <> 1 AS ok FROM q), c AS (SELECT *, coalesce(sum(ok::INT) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM o) SELECT seq, ok FROM c WHERE done < 40",
        "crawl_bfs": f"WITH {_links_sql()}, {_FIRST}, o AS (SELECT l.norm, dst, row_number() OVER (PARTITION BY dst ORDER BY l.page_id, pos) AS rn FROM links l JOIN f USING (page_id) WHERE dst NOT IN (SELECT norm FROM n)) SELECT norm AS url, 'crawled' AS state, 0 AS depth, NULL::VARCHAR AS referrer FROM f UNION ALL SELECT dst, 'error', 1, norm FROM o WHERE rn = 1",
        "parse_sitemap": f"WITH {_N} SELECT page_id, 0 AS maps, norm AS loc FROM n",
    }
