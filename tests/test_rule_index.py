"""Rules as a table against the CASE chain of a configuration's few rules, and against plain tests."""

import random

import pytest
from pyspark.sql import functions as F

from silkweb.functions.patterns import PatternError, compile_pattern
from silkweb.operators import rule_index, rules

PATTERNS = [
    "https://a.com", "https://a.com/", "https://a.com/x", "https://a.com/x/y", "https://a.com/x/", "https://a.com:8080/x", "http://a.com/x", "https://a.com/x//", "https://",
    "a.com", "com/x", "/x", "", "y", "é", "https://b.com/q?z",
    "/a\\.com/", "/com\\/[xy]/", "/X/i", "/x|y/", "/(x)+y?\\/z/", "/^https:\\/\\/a/", "/x{2}/", "/ab*c\\/d/", "/a+b/", "/[/]x\\/y/",
]
URLS = ["https://a.com/", "https://a.com/x", "https://a.com/x/", "https://a.com/x/y", "https://a.com/xy", "https://a.com/x//y", "https://a.com:8080/x/y", "https://b.com/q", "https://ab.com/abc/d", "https://a.com.evil.com/x", "https://c.org/xxy/z", "https://b.com/%C3%A9", "https://aab.de/ac/d", "ftp://a.com/x", None]


def plain(url, patterns):
    fits = [(-compile_pattern(p).length, k) for k, p in enumerate(patterns) if p is not None and url is not None and compile_pattern(p).test(url)]
    return min(fits)[1] if fits else None


@pytest.mark.parametrize("shard, broadcast", [(1 << 25, 100_000), (300, 0)])
def test_index_gives_what_the_chain_gives(spark, monkeypatch, shard, broadcast):
    monkeypatch.setattr(rule_index, "SHARD_BYTES", shard)
    monkeypatch.setattr(rule_index, "BROADCAST_ROWS", broadcast)
    rng = random.Random(shard)
    patterns = [None, *rng.sample(PATTERNS, len(PATTERNS)), *rng.sample(PATTERNS, 9)]
    pages = spark.createDataFrame([(u, 7, k) for k, u in enumerate(URLS + URLS[:3])], "url string, rule int, n int")
    table = spark.createDataFrame(list(enumerate(patterns)), "rule bigint, pattern string")
    got = {(r["n"], r["url"]): r["rule"] for r in rule_index.most_specific(pages, table).collect()}
    assert got == {(k, u): plain(u, patterns) for k, u in enumerate(URLS + URLS[:3])}
    chain = pages.select("n", rules.most_specific(F.col("url"), [(p, k) for k, p in enumerate(patterns) if p is not None]).alias("rule")).collect()
    assert {r["n"]: r["rule"] for r in chain if URLS[r["n"] % len(URLS)]} == {n: r for (n, u), r in got.items() if u}


def test_the_plan_is_as_large_for_many_rules_as_for_few(spark):
    pages = spark.createDataFrame([(u,) for u in URLS], "url string")
    sizes, found = [], []
    for n in (10, 20_000):
        made = spark.range(n).selectExpr("id AS rule", "CASE id % 3 WHEN 0 THEN concat('https://a.com/x/', id) WHEN 1 THEN concat('piece', id) ELSE concat('/x', id, '[a-z]+/') END AS pattern")
        out = rule_index.most_specific(pages, made.union(spark.createDataFrame([(n, "https://a.com/x")], "rule bigint, pattern string")))
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        found.append(sum(r["rule"] == n for r in out.collect()))
    assert sizes[0] == sizes[1] and found[0] == found[1] == 4


def test_nothing_and_bad_patterns(spark):
    none = spark.createDataFrame([], "rule bigint, pattern string")
    pages = spark.createDataFrame([("https://a.com/",), (None,)], "url string")
    assert [r["rule"] for r in rule_index.most_specific(pages, none).collect()] == [None, None]
    assert rule_index.most_specific(pages.limit(0), none).count() == 0
    with pytest.raises(Exception, match="PatternError"):
        rule_index.most_specific(pages, spark.createDataFrame([(0, "/(/")], "rule bigint, pattern string"))
    with pytest.raises(PatternError):
        compile_pattern("/(/")


def test_routes_as_tables(spark):
    routes = {"https://a.com": {"x": "x.json", "x/y": "xy.json", "*": "rest.json"}, "b.com": {"q": "q.json", "*": None}, "a.com/x": {"z": "z.json"}}
    pages = spark.createDataFrame([(u, k) for k, u in enumerate(URLS)], "url string, n int")
    chain = pages.select("n", rules.route(F.col("url"), routes).alias("file")).where("file IS NOT NULL").collect()
    got = rule_index.routed_by(pages, *rule_index.rules_of(spark, routes)).select("n", "file").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, chain)) and len(got) > 4


@pytest.mark.parametrize(
    "source, literal",
    [("abc", "abc"), ("a.bcd", "bcd"), ("ab*cd", "cd"), ("abc?", "ab"), ("a|b", ""), ("(abc)d", "d"), ("[abc]de", "de"), (r"a\.com\/x", ".com/x"[:0] + "a.com/x"), (r"a\dbc", "bc"), ("ab{2}cd", "cd"), ("ab+cd", "ab"), ("(?i)abc", ""), (r"[\]x]yz", "yz"), ("^ab$", "ab")],
)
def test_literals(source, literal):
    assert rule_index.literal_of(source) == literal
