import http.server
import threading

import pytest

from silkweb.functions.html import select, text_of
from silkweb.plans.config import load_config
from silkweb.plans.crawler import Crawler, parsed, run_crawlers
from silkweb.sources.fetch import FetchError, HttpFetcher, RateLimitError, TableFetcher
from silkweb.streaming.ingest import stream_records


def page(*links, text=""):
    return f"<html><body><p>{text}</p>{''.join(f'<a href={x}>l</a>' for x in links)}</body></html>"


WEB = [
    ("https://w.com/", 200, "text/html", None, page("/a", "/b", "/c.pdf", "https://other.com/x", "/", text="home"), 0),
    ("http://www.w.com/a/?q#f", 200, "text/html", None, page("/d", "/b#x", text="page a"), 0),
    ("https://w.com/b", 200, "text/html; charset=utf-8", None, page("/d", "/e", "/json", "/img", "/gone", text="page b"), 0),
    ("https://w.com/d", 200, "text/html", None, page("/f", "/a", text="page d"), 0),
    ("https://w.com/e", 301, None, "/f2", "", 0),
    ("https://w.com/f2", 200, "text/html", None, page(text="moved"), 0),
    ("https://w.com/f", 503, "text/html", None, page(text="at last"), 1),
    ("https://w.com/json", 200, "application/json", None, '{"b":1.0}', 0),
    ("https://w.com/img", 200, "image/gif", None, "x", 0),
    ("https://w.com/sitemap.xml", 200, "text/xml", None, "<sitemapindex><sitemap><loc>https://w.com/s2.xml</loc></sitemap></sitemapindex>", 0),
    ("https://w.com/s2.xml", 200, "text/xml", None, "<urlset><url><loc>https://w.com/s</loc></url></urlset>", 0),
    ("https://w.com/s", 200, "text/html", None, page(text="from the map"), 0),
]
SCHEMA = "url string, status int, content_type string, location string, body string, fail_times int"


def crawler(spark, tmp_path, rows=WEB, **crawl):
    fetcher = TableFetcher(spark.createDataFrame(rows, SCHEMA))
    user = {"start_urls": ["http://www.w.com/"], "fetcher": fetcher, "signals": False, "storage": {"dir": f"{tmp_path}/data"}, "allowed_content_types": ["text/html", "application/json"], "crawl": crawl, "output": {"format": "lines", "routes": {"https://w.com": {"a": "a.txt", "*": "rest.txt"}}}}
    return Crawler(spark, user)


def states(queue):
    from silkweb.operators.frontier import state

    return {r.url.removeprefix("https://w.com"): (r.state, r.depth, r.referrer and r.referrer.removeprefix("https://w.com")) for r in queue.withColumn("state", state()).collect()}


def test_whole_crawl(spark, tmp_path):
    c = crawler(spark, tmp_path)
    seen = []
    c.on("skip", lambda entry, why: seen.append((entry["url"], why["reason"], why["status"])))
    got = states(c.run())
    assert got == {
        "/": ("crawled", 0, None), "/a": ("crawled", 1, "/"), "/b": ("crawled", 1, "/"), "/d": ("crawled", 2, "/a"), "/e": ("crawled", 2, "/b"),
        "/json": ("crawled", 2, "/b"), "/img": ("skipped", 2, "/b"), "/gone": ("error", 2, "/b"), "/f": ("crawled", 3, "/d"),
    }
    assert seen == [("https://w.com/img", "content-type: image/gif", 200)]
    assert c.statistics == {"crawled": 7, "error": 1, "skipped": 1, "pending": 0, "total": 9}
    assert (tmp_path / "data/formatted/a.txt").read_text() == "https://w.com/a page a l l"
    assert (tmp_path / "data/formatted/rest.txt").read_text().split("\n")[0] == "https://w.com/ home l l l l l"
    records = {r.url: r for r in c.records().collect()}
    assert records["https://w.com/json"].content == '{\n  "b": 1\n}' and records["https://w.com/json"].data == '{"b":1}'
    assert sorted(int(r.file[:-5]) for r in records.values()) == list(range(1, 8))


def test_limits_resume_and_requeue(spark, tmp_path):
    c = crawler(spark, tmp_path, max_pages=3)
    assert c.crawl()["crawled"] == 3
    assert states(c.queue)["/b"][0] == "crawled"
    again = crawler(spark, tmp_path, max_pages=4, reset_on_complete=False)
    assert again.crawl()["crawled"] == 4
    rest = crawler(spark, tmp_path, reset_on_complete=False)
    assert rest.crawl()["pending"] == 0
    fixed = crawler(spark, tmp_path, [*WEB, ("https://w.com/gone", 200, "text/html", None, page(text="back"), 0)], reset_on_complete=False, retry_errors=True)
    assert fixed.crawl()["error"] == 0
    n = states(crawler(spark, tmp_path / "x", max_depth=1).run())
    assert set(n) == {"/", "/a", "/b"}


def test_reset_sitemap_hooks_and_enqueue(spark, tmp_path):
    c = crawler(spark, tmp_path, sitemap=True, max_depth=0)
    c.on("transform", lambda record, entry, result: {**record, "title": "t", "content": record["content"].upper()})
    c.on("should_enqueue", lambda allow, url, referrer: False if url.endswith("/b") else None)
    assert c.enqueue(["https://w.com/a?x", "https://w.com/b", "https://w.com/z.pdf", "no url"]) == 1
    got = states(c.run())
    assert set(got) == {"/a", "/s"} and got["/s"][2] == "/s2.xml"
    r = c.records().where("url LIKE '%/s'").first()
    assert r.content == "FROM THE MAP" and dict(r.extra) == {"title": '"t"'}
    c2 = crawler(spark, tmp_path, max_depth=0)
    assert set(states(c2.run())) == {"/"}  # all was done, so it began anew


def test_rate_limit_leaves_the_page_pending(spark, tmp_path):
    rows = [(u, 429 if u.endswith("/b") else s, *rest) for u, s, *rest in WEB]
    c = Crawler(spark, {**{k: v for k, v in crawler(spark, tmp_path, rows).config.items() if k not in ("include", "sites")}, "rate_limit": {"exit_on_limit": True, "exit_code": 12}})
    with pytest.raises(RateLimitError) as e:
        c.crawl()
    assert e.value.code == 12 and states(c.queue)["/b"][0] == "pending" and states(c.queue)["/a"][0] == "crawled"


@pytest.mark.parametrize("where", ["add_records", "append", "swap", "merge", "drop"])
def test_a_cut_within_a_wave_gives_each_record_once(spark, tmp_path, monkeypatch, where):
    """The driver is lost after the records of the second wave, before the log's tables, before the pointer, in a merge
    before its pointer, or before the merged tables go."""
    from silkweb.sources import store

    monkeypatch.setattr(store, "FAN", 2)
    monkeypatch.setattr(store, "BUCKET_ROWS", 3)
    c, times = crawler(spark, tmp_path), []
    name = {"add_records": "add_records", "append": "append", "swap": "_swap", "merge": "_swap", "drop": "_drop"}[where]
    real = getattr(c.store, name)

    def cut(*args, **named):
        times.append(1)
        inside = where != "merge" or any(m["tier"] for log in store.LOGS for m in args[0][log])
        if len(times) >= 2 and inside:
            if where == "add_records":
                real(*args, **named)
            raise KeyboardInterrupt
        return real(*args, **named)

    setattr(c.store, name, cut)
    with pytest.raises(KeyboardInterrupt):
        c.crawl()
    again = crawler(spark, tmp_path, reset_on_complete=False)
    assert again.crawl() == {"crawled": 7, "error": 1, "skipped": 1, "pending": 0}
    records = again.records().collect()
    assert len(records) == len({r.url for r in records}) == 7 and sorted(int(r.file[:-5]) for r in records) == list(range(1, 8))
    assert states(again.queue) == states(crawler(spark, tmp_path / "whole").run())


def test_the_log_grows_with_the_waves_rows_and_is_never_shuffled(spark, tmp_path, monkeypatch):
    from silkweb.sources import store

    monkeypatch.setattr(store, "FAN", 4)
    monkeypatch.setattr(store, "BUCKET_ROWS", 1000)
    log = store.Store(spark, {"queue_path": str(tmp_path / "q"), "crawled_dir": str(tmp_path / "c")})
    rows = lambda lo, n: spark.range(lo, lo + n).selectExpr("id AS seq", "concat('https://w.com/', id) AS url", "NULL AS referrer", "0 AS depth")
    written = []
    real = store.Store._add
    monkeypatch.setattr(store.Store, "_add", lambda self, name, frame, *a: written.append(frame.count()) or real(self, name, frame, *a))
    log.append(found=rows(0, 4000), change={"pending": 4000}, next=4000)
    for k in range(15):
        log.append(found=rows(4000 + 10 * k, 10), outcomes=spark.range(10 * k, 10 * k + 10).selectExpr("id AS seq", "concat(id, '.json') AS file", "200 AS status", "NULL AS error", "NULL AS skipped"), change={"crawled": 10}, pending_from=10 * k + 10)
    # Sixteen tables of each kind: merged by fours, and the four once more.
    assert len(log.current()["found"]) == 1 and sum(written) == 3 * 4150 + 150 + 120
    assert log.current()["found"][0]["buckets"] == 8
    assert log.queue().count() == 4150 and log.queue().where("file IS NOT NULL").count() == 150
    assert log.pending().count() == 4000 and log.pending().agg({"seq": "min"}).first()[0] == 150
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([("https://w.com/7",), ("https://w.com/x",), ("https://w.com/4149",)], "url string")
        left = log.unseen(asked)
        assert [r[0] for r in left.collect()] == ["https://w.com/x"]
        plan = left._jdf.queryExecution().executedPlan().toString()
        final = plan.split("+- == Initial Plan ==")[0]
        assert final.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in final  # of what is asked only
        # A session that knows nothing of the tables.
        for made in log.current()["found"]:
            spark.sql(f"DROP TABLE {made['name']}")
        assert store.Store(spark, {"queue_path": str(tmp_path / "q"), "crawled_dir": str(tmp_path / "c")}).unseen(asked).count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    log.reset()
    assert log.queue().count() == 0


def test_the_extract_hook_gets_what_is_left_of_the_page(spark):
    page = "<body><nav><a href=/n>n</a></nav><p>a<!-- c --><b>b</b><script>s</script></p></body>"
    row = [(0, "https://w.com/", 0, None, bytearray(page.encode()), 200, None, "html", -1)]
    rows = spark.createDataFrame(row, "seq bigint, url string, depth int, referrer string, data binary, status int, headers map<string,string>, kind string, rule int")
    seen = {
        "links": [lambda links, page, entry, result: [*links, str(len(select(page, "nav, script")))]],
        "extract": [lambda content, page, entry, result: f"{content}|{len(select(page, 'nav, script'))}|{text_of(page)}"],
    }
    got = parsed(rows, load_config({"start_urls": ["https://w.com/"]}), seen).first()
    assert got["links"] == ["https://w.com/n", "2"] and got["content"] == "a b|0|a b"


def test_hooks_get_what_they_should(spark, tmp_path):
    c = crawler(spark, tmp_path, max_depth=2)

    def on_response(result, entry):  # runs in tasks, before the gate
        if entry["url"].endswith("/img"):
            result["headers"]["content-type"] = "text/html"
        if entry["url"].endswith("/d"):
            raise ValueError("no thanks")
        if entry["url"].endswith("/json"):
            result["headers"]["content-type"] = "application/x-other"

    c.on("response", on_response)
    c.on("links", lambda links, page, entry, result: [*links, "https://w.com/more"] if entry["url"].endswith("/a") else None)
    c.on("extract", lambda content, page, entry, result: content.upper() if entry["depth"] == 0 else None)
    c.on("transform", lambda record, entry, result: {**record, "n": len(result["data"])})
    pages, skips, errors = [], [], []
    off = c.on("page", lambda record, entry, result: pages.append((record, entry, result)))
    c.on("skip", lambda entry, why: skips.append((entry["url"], why["reason"], why["result"]["data"])))
    c.on("error", lambda error, entry: errors.append((str(error), error.status, entry["url"])))
    got = states(c.run())
    assert got["/img"][0] == "crawled" and got["/d"][0] == "error" and got["/json"][0] == "skipped" and "/more" in got
    assert [p[0]["url"] for p in pages][:2] == ["https://w.com/", "https://w.com/a"]
    record, entry, result = pages[0]
    assert record["content"].startswith("HOME") and record["n"] == len(result["data"]) and set(record) == {"url", "content", "crawledAt", "hash", "n"}
    assert entry["file"] == "1.json" and entry["status"] == 200 and result["headers"]["content-type"] == "text/html"
    assert skips == [("https://w.com/json", "content-type: application/x-other", b'{"b":1.0}')]
    assert ("no thanks", 200, "https://w.com/d") in errors and ("Invalid status code: 404", 404, "https://w.com/gone") in errors
    off()


def test_files_are_written_by_parts(spark, tmp_path):
    from silkweb.plans.output import files, write_records

    rows = [(k, f"https://w.com/{k % 37}/é", None if k % 5 else f"c\n{k}", '{"a":1}' if k % 3 else None, {}) for k in range(400)]
    frame = spark.createDataFrame(rows, "seq long, url string, content string, data string, extra map<string,string>").repartition(5)
    for form in ("json", "jsonl", "lines", "other"):
        path = str(tmp_path / f"{form}.out")
        assert write_records(frame, path, form) == 400
        assert open(path, encoding="utf-8").read() == files(frame.withColumn("file", __import__("pyspark").sql.functions.lit("f")), form).first()["body"]
        assert write_records(frame.limit(0), path, form) == 0
        assert open(path).read() == {"lines": "", "jsonl": "\n"}.get(form, "[]")


def test_state_is_saved_as_pretty_json(spark, tmp_path):
    import json

    c = crawler(spark, tmp_path, max_depth=2)
    assert c.save_json(str(tmp_path / "none")) == {"queue": 0, "records": 0} and (tmp_path / "none/records.json").read_text() == "[]"
    c.on("transform", lambda record, entry, result: {**record, "title": {"t": [1, "é"]}})
    c.crawl()
    assert c.save_json(str(tmp_path / "saved")) == {"queue": 8, "records": 6}
    for name, rows in (("queue", c.queue.orderBy("seq").collect()), ("records", c.records().orderBy("seq").collect())):
        text = (tmp_path / f"saved/{name}.json").read_text()
        made = json.loads(text)
        assert text == json.dumps(made, indent=2, ensure_ascii=False)
        assert [m["url"] for m in made] == [r["url"] for r in rows]
    queue = json.loads((tmp_path / "saved/queue.json").read_text())
    assert queue[0] == {"url": "https://w.com/", "file": "1.json", "status": 200, "error": None, "skipped": None, "referrer": None, "depth": 0}
    assert {q["url"]: q["error"] for q in queue}["https://w.com/gone"] == "Invalid status code: 404"
    record = {m["url"]: m for m in made}["https://w.com/json"]
    assert list(record) == ["url", "content", "crawledAt", "data", "hash", "title"] and record["data"] == {"b": 1} and record["title"] == {"t": [1, "é"]}


def test_store_files(spark, tmp_path):
    from silkweb.sources import store

    at = str(tmp_path / "x.json")
    assert store.load_json(spark, at, 7) == 7 and store.read_text(spark, at) is None
    store.swap_text(spark, at, '{"a": 1}')
    store.swap_text(spark, at, '{"a": 2}')
    assert store.load_json(spark, at) == {"a": 2} and [f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")] == ["x.json"]
    (tmp_path / "old").mkdir()
    (tmp_path / "old/y.txt").write_text("y")
    assert len(store.prune(spark, str(tmp_path), {at})) == 1 and store.prune(spark, str(tmp_path / "none"), set()) == []


def test_hosts_take_turns(spark):
    """A task fetches the hosts in turn and spaces the requests of each."""
    import time

    from silkweb.sources.polite import fetched

    class Clock:
        name = "clock"

        def fetch(self, url):
            return {"data": str(time.time()).encode(), "status": 200, "headers": {}}

    config = load_config({"start_urls": ["https://a.com/"], "crawl": {"concurrency": 1, "delay": 100}})
    frame = spark.createDataFrame([(k, f"https://{'abc'[k // 3]}.com/{k}") for k in range(9)], "seq long, url string")
    at = {r.url: float(bytes(r.data)) for r in fetched(Clock(), frame, config).collect()}
    times = [[at[f"https://{h}.com/{3 * n + k}"] for k in range(3)] for n, h in enumerate("abc")]
    assert all(b - a > 0.09 for t in times for a, b in zip(t, t[1:])) and max(at.values()) - min(at.values()) < 0.6


def test_json_as_text_and_names(spark, tmp_path):
    import silkweb

    assert all(getattr(silkweb, n) is not None for n in silkweb.__all__)
    assert silkweb.matches_pattern("a2024d", "/(?<y>[0-9]+)d/") and silkweb.matches_pattern("xd", "/(?<!a|bc)d/") and not silkweb.matches_pattern("bcd", "/(?<!a|bc)d/")
    from pyspark.sql import functions as F

    from silkweb.functions.patterns import matches

    rows = spark.createDataFrame([("a2024d",), ("bcd",), ("xd",)], "u string")
    assert [tuple(r) for r in rows.select(matches(F.col("u"), "/(?<y>[0-9]+)d/"), matches(F.col("u"), "/(?<!a|bc)d/")).collect()] == [(True, True), (False, False), (False, True)]
    c = crawler(spark, tmp_path, max_depth=2)
    c.config["extract"]["json"] = False
    c.run()
    assert {r.url: r.content for r in c.records().collect()}["https://w.com/json"] == '{"b":1.0}'


def test_several_crawlers(spark, tmp_path):
    queues = run_crawlers(spark, [crawler(spark, tmp_path / "1", max_depth=0), crawler(spark, tmp_path / "2", max_depth=1)], concurrency=2)
    assert [q.count() for q in queues] == [1, 3]


def test_turns_of_a_host_in_many_ranges(spark):
    from silkweb.operators.schedule import leased, turns

    hosts = ["big"] * 900 + [f"h{k % 40}" for k in range(400)]
    frame = spark.createDataFrame([(k * 7 % 1300, f"https://{h}.com/{k}") for k, h in enumerate(hosts)], "seq long, url string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = turns(frame).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 1300 and (got.turn == got.groupby("host").seq.rank().astype(int) - 1).all()
    due = spark.createDataFrame([("h1.com", 450), ("h2.com", -5), ("h3.com", 2000)], "host string, due long")
    rows = leased(frame, 100, 1000, due).toPandas()
    n = rows.groupby("host").start.agg(["size", "min"])
    assert n.loc["big.com"].tolist() == [10, 0] and n.loc["h1.com"].tolist() == [6, 450] and n.loc["h2.com"].tolist() == [10, 0] and "h3.com" not in n.index
    assert leased(frame.limit(0), 100, 1000, due).count() == 0


class Slow:
    """Answers of a web without links but from its first page; hosts differ in what they do."""

    name = "slow"

    def __init__(self, links, seconds=0.0, log=None):
        self.links, self.seconds, self.log = links, seconds, log

    def fetch(self, url):
        import os
        import time

        began = time.time()
        if self.log:
            with open(f"{self.log}/{os.getpid()}", "a") as f:
                f.write(f"{began} {url}\n")
        if url.endswith("/429") and began - float(open(f"{self.log}/start").read()) < 1.5:
            raise FetchError("wait", 429, {"retry-after": "2"})
        time.sleep(0 if url == "https://w.com/" else self.seconds)
        return {"data": page(*(self.links if url == "https://w.com/" else [])).encode(), "status": 200, "headers": {"content-type": "text/html"}}


def slow_crawler(spark, tmp_path, fetcher, signals=False, **crawl):
    user = {"start_urls": ["https://w.com/"], "include": ["com/"], "fetcher": fetcher, "signals": signals, "log_level": "silent", "storage": {"dir": f"{tmp_path}/data"}, "crawl": crawl}
    return Crawler(spark, user)


def started(log):
    rows = [line.split() for f in log.iterdir() if f.name.isdigit() for line in f.read_text().splitlines()]
    return sorted((float(t), u) for t, u in rows)


def test_a_host_that_waits_holds_up_no_other(spark, tmp_path):
    import time

    from silkweb.sources.polite import fetched

    (tmp_path / "start").write_text(str(time.time() + 1))
    config = load_config({"start_urls": ["https://a.com/"], "crawl": {"concurrency": 1, "delay": 50}})
    urls = ["https://a.com/429", "https://a.com/1", "https://b.com/0", "https://b.com/1", "https://c.com/0"]
    frame = spark.createDataFrame(list(enumerate(urls)), "seq long, url string")
    got = {r.url: r for r in fetched(Slow([], log=tmp_path), frame, config).collect()}
    assert set(got) == set(urls) and all(r.status == 200 and not r.put_off for r in got.values())
    order = [u for _, u in started(tmp_path)]
    assert order[0] == "https://a.com/429" and set(order[1:4]) == set(urls[2:]) and order[-2:] == urls[:2]
    (tmp_path / "start").write_text(str(time.time() + 1))
    rows = fetched(Slow([], log=tmp_path), frame, config, lease=1500).collect()
    assert sorted(r.url for r in rows if not r.put_off) == urls[2:]  # host a is due after the lease
    late = [r for r in rows if r.put_off]
    assert [r.url for r in late] == [urls[0]] and late[0].due > time.time() * 1000 - 1500 and late[0].status is None


def test_requests_at_once_beyond_the_tasks(spark, tmp_path):
    from silkweb.sources.polite import fetched

    at_once = 3 * spark.sparkContext.defaultParallelism
    config = load_config({"start_urls": ["https://a.com/"], "crawl": {"concurrency": at_once, "delay": 0}})
    frame = spark.createDataFrame([(k, f"https://h{k}.com/") for k in range(60)], "seq long, url string")
    assert fetched(Slow([], 0.3, tmp_path), frame, config).count() == 60
    times = [t for t, _ in started(tmp_path)]
    assert times[-1] - times[0] < 60 * 0.3 / spark.sparkContext.defaultParallelism - 0.3  # one at a time in each task takes longer


def test_leases_and_due_times_outlive_waves_and_crawlers(spark, tmp_path):
    links = [f"https://long.com/{k}" for k in range(8)] + ["https://s.com/0"]
    c = slow_crawler(spark, tmp_path, Slow(links, log=tmp_path), delay=3000, lease=4000, concurrency=4, max_pages=4)
    assert c.crawl()["crawled"] >= 3
    again = slow_crawler(spark, tmp_path, Slow(links, log=tmp_path), delay=3000, lease=10_000, concurrency=4)
    assert again.crawl() == {"crawled": 10, "error": 0, "skipped": 0, "pending": 0}
    times = [t for t, u in started(tmp_path) if "long" in u]
    assert len(times) == 8 and all(b - a > 2.95 for a, b in zip(times, times[1:]))
    assert len({r.url for r in again.records().collect()}) == 10


@pytest.mark.parametrize("way", ["SIGINT", "SIGTERM", "stop"])
def test_a_stop_within_a_wave_keeps_what_was_fetched(spark, tmp_path, way):
    import os
    import signal
    import time

    links = [f"https://w.com/{k}" for k in range(200)]
    c = slow_crawler(spark, tmp_path, Slow(links, 0.1, tmp_path), signals=True, delay=200, concurrency=4)
    at = []

    def stop():
        while len(started(tmp_path)) < 6:
            time.sleep(0.05)
        at.append(time.time())
        c.stop() if way == "stop" else os.kill(os.getpid(), getattr(signal, way))

    threading.Thread(target=stop, daemon=True).start()
    before = signal.getsignal(signal.SIGTERM)
    n = c.crawl()
    assert signal.getsignal(signal.SIGTERM) is before
    log = started(tmp_path)
    assert n["pending"] > 150 and n["crawled"] == len(log) and log[-1][0] < at[0] + 1  # 200 pages take 40 s
    again = slow_crawler(spark, tmp_path, Slow(links), delay=0)
    assert again.crawl() == {"crawled": 201, "error": 0, "skipped": 0, "pending": 0}


class _Kept(http.server.BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    opened = []

    def setup(self):
        super().setup()
        self.opened.append(1)

    def do_GET(self):
        body = b"x" * 50
        self.send_response({"/gone": 404, "/move": 302}.get(self.path, 200))
        if self.path == "/move":
            self.send_header("Location", "/there")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)
        if self.path == "/last":
            self.close_connection = True  # without saying so

    def log_message(self, *args):
        pass


def test_connections_are_kept():
    import pickle

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Kept)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    fetcher = HttpFetcher({"timeout": 2000, "max_redirects": 5, "max_content_length": 100, "user_agent": "t", "headers": {}})
    try:
        assert [fetcher.fetch(at + p)["data"] for p in ("/a", "/move", "/b")] == [b"x" * 50] * 3
        with pytest.raises(FetchError, match="404"):
            fetcher.fetch(at + "/gone")
        assert pickle.loads(pickle.dumps(fetcher)).fetch(at + "/last")["status"] == 200
        assert len(_Kept.opened) == 1
        assert fetcher.fetch(at + "/c")["status"] == 200 and len(_Kept.opened) == 2  # the kept one was gone
        small = HttpFetcher(fetcher.request | {"max_content_length": 10})
        with pytest.raises(FetchError, match="too large"):
            small.fetch(at + "/d")
        assert fetcher.fetch(at + "/e")["status"] == 200 and len(_Kept.opened) == 3  # an unread answer ends its connection
    finally:
        server.shutdown()


class _Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        n = int(self.path[2:] or 0) if self.path.startswith("/r") else 0
        if n:
            self.send_response(302)
            self.send_header("Location", f"/r{n - 1}")
            self.end_headers()
            return
        self.send_response(404 if self.path == "/gone" else 200)
        self.send_header("Content-Type", "text/html")
        self.end_headers()
        self.wfile.write(b"x" * 100)

    def log_message(self, *args):
        pass


def test_http_fetcher():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    request = {"timeout": 2000, "max_redirects": 5, "max_content_length": 100, "user_agent": "t", "headers": {}}
    try:
        got = HttpFetcher(request).fetch(f"{at}/r5")
        assert got["status"] == 200 and got["data"] == b"x" * 100 and got["headers"]["content-type"] == "text/html"
        for path, message in (("/r6", "Max redirects reached"), ("/gone", "Invalid status code: 404")):
            with pytest.raises(FetchError, match=message):
                HttpFetcher(request).fetch(at + path)
        with pytest.raises(FetchError, match="exceeded max size of 99 bytes") as e:
            HttpFetcher(request | {"max_content_length": 99}).fetch(at + "/")
        assert e.value.status == 413
    finally:
        server.shutdown()


def test_stream(spark, tmp_path):
    rows = [(1, "http://a.com/x?1", "<p>one"), (2, "https://a.com/x", "<p>one"), (3, "https://a.com/y", "<p>two")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    query = stream_records(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted((r.url, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("https://a.com/x", "one"), ("https://a.com/y", "two")]
