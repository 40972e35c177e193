import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from silkweb.functions.content import classify_content_type, js_number, parse_json
from silkweb.functions.html import SelectorError, compile_selector, discover_links, extract_text, tidy, tidy_column
from silkweb.functions.patterns import PatternError, compile_pattern, matches, matches_any_pattern, matches_pattern
from silkweb.functions.sitemap import parse_sitemap
from silkweb.functions.urls import normalize, normalize_or_none, normalize_url, path_prefixes, resolve
from silkweb.operators.rules import most_specific, route
from silkweb.plans.config import ConfigError, listed, load_config, merged
from silkweb.plans.hooks import Hooks
from silkweb.sources.fetch import FetchError, rate_limit_wait, with_retries

URLS = {
    "HTTP://WWW.Example.com:80/a/../b/?q#x": "https://example.com/b",
    "https://a.b/für": "https://a.b/f%C3%BCr",
    "http://h:443/x": "https://h/x",
    "http://h:8080/x/": "https://h:8080/x",
    "https://x.com//a//": "https://x.com//a/",
    "https://www.www.x.com": "https://www.x.com/",
    "ftp://x/y": "https://x/y",
    "mailto:a@b?x": "mailto:a@b",
    "http://a b/": None,
    "//x": None,
    "": None,
    "https://u:p@H.com/%2e%2e/q": "https://u:p@h.com/q",
    "http:\\\\h.com\\a\\.\\b": "https://h.com/a/b",
    " \thttps://h.com/a b\n": "https://h.com/a%20b",
    "http://0x7f.1/": "https://127.0.0.1/",
    "http://256.1.1.1/": None,
    "https://h.com:99999/": None,
    "https://h.com/Path/Case.HTML": "https://h.com/Path/Case.HTML",
}


@pytest.mark.parametrize("url", URLS)
def test_normalize(url):
    assert normalize_or_none(url) == URLS[url]


def test_native_path_gives_what_the_parser_gives(spark):
    made = [*URLS, None, *(f"http{s}://{w}{h}{p}{q}" for s in ("", "s") for w in ("", "www.", "m.") for h in ("a.com", "b-c.example.org", "1.2.3.4", "www") for p in ("", "/", "/a", "/a/", "/a.b/c.html", "/a//", "/./x", "/%2e/y", "/.well") for q in ("", "?a=b", "#t", "?a#b"))]
    rows = spark.createDataFrame([(u,) for u in made], "url string").select("url", normalize_url(F.col("url")).alias("n")).collect()
    assert [(r.url, r.n) for r in rows] == [(u, normalize_or_none(u)) for u in made]


def test_resolve():
    at = "https://s.com/docs"
    assert resolve("a.html", at) == "https://s.com/a.html"
    assert resolve("../x?y=1 2#f", "https://s.com/a/b/c") == "https://s.com/a/x?y=1%202#f"
    assert resolve("//t.com", at) == "https://t.com/"
    assert resolve("?q", at) == "https://s.com/docs?q"
    assert resolve("https:b", at) == "https://s.com/b"
    assert resolve("http://[", at) is None


PATTERNS = [
    ("https://site.com/blog", "https://site.com/blog", True),
    ("https://site.com/blog/a", "https://site.com/blog/", True),
    ("https://site.com/blogs", "https://site.com/blog", False),
    ("https://site.com.evil.com/", "https://site.com", False),
    ("https://site.com/x", "http://site.com", False),
    ("https://s.com/blog", "/blog", True),
    ("https://s.com/blog", "/BLOG/i", True),
    ("https://s.com/blog", "/^blog/", False),
    ("https://s.com/blog\n", "/blog$/", False),
    ("anything", "", True),
    ("https://s.com/a.PDF", re.compile(r"\.pdf$", re.I), True),
]


@pytest.mark.parametrize("value,pattern,fits", PATTERNS)
def test_patterns(value, pattern, fits, spark):
    assert matches_pattern(value, pattern) is fits
    if "\n" not in value:
        assert spark.range(1).select(matches(F.lit(value), pattern)).first()[0] is fits


def test_pattern_edges():
    assert not matches_any_pattern("x", [])
    for bad in ("/a/b", "/(/", 5):
        with pytest.raises(PatternError):
            compile_pattern(bad)


#: Pattern, texts that it fits, texts that it doesn't.
JS_PATTERNS = [
    ("/x{id}/", ["x{id}"], ["xid"]), ("/[^]a/", ["\na", "xa"], ["a"]), ("/a[]/", [], ["a", "a[]"]), ("/\\u{61}/u", ["a"], ["u"]), ("/^\\u{3}$/", ["uuu"], ["a", "\x03"]),
    ("/(?<$n>a)\\k<$n>/", ["aa"], ["a"]), ("/\\k<x>/", ["k<x>"], ["x"]), ("/a{,2}/", ["a{,2}"], ["aa"]), ("/^a{2}?$/", ["aa"], ["a"]), ("/]}/", ["]}"], ["]"]),
    ("/^.$/", ["a", "\u0085", "😀"], ["\n", "\r", "\u2028"]), ("/^.$/s", ["\n", "\u2028"], [""]), ("/^b$/m", ["a\nb", "a\rb\u2028c", "b"], ["a\u0085b", "bb"]), ("/^b$/", ["b"], ["b\n", "a\nb"]),
    ("/^\\d$/", ["5"], ["٣"]), ("/^\\w$/", ["_"], ["é"]), ("/^\\s$/", ["\ufeff", "\u00a0", "\u2003", "\x0b"], ["\u0085", "\x1c"]), ("/^[\\D]$/", ["٣", "x"], ["3"]), ("/^[^\\W_]$/", ["a"], ["_", "é"]), ("/^\\W$/i", ["é", "-"], ["k", "S", "i"]),
    ("/é\\b/", ["éa"], ["é"]), ("/a\\Bb/", ["ab"], ["a b"]), ("/\\07\\x4/", ["\x07x4"], ["7"]), ("/^\\101[\\101]\\8$/", ["AA8"], ["1018"]), ("/\\cJ[\\c_]/", ["\n\x1f"], ["J_"]), ("/^\\c$/", ["\\c"], ["c"]), ("/[\\b]/", ["\b"], ["b"]),
    ("/\\1(a)/", ["a"], ["b"]), ("/(a\\1)b/", ["ab"], ["aa"]), ("/^(a)\\1(?:0)$/", ["aa0"], ["a0"]), ("/^(?:(a)|b\\1)$/", ["a", "b"], ["ba"]), ("/^(a)?\\1b$/", ["aab", "b"], ["ab"]), ("/^(a|(b))\\2$/", ["a", "bb"], ["b"]),
    ("/(?<=a+x*)b/", ["aab", "axxb"], ["b", "xb"]), ("/(?<!a|bc)d/", ["xd"], ["ad", "bcd"]), ("/^(?=a)*b/", ["b"], ["a"]), ("/(?i:a)b/", ["Ab"], ["AB"]), ("/(?-i:a)b/i", ["aB"], ["Ab"]), ("/^(?s:.).$/", ["\na"], ["a\n"]),
    ("/b|c/y", ["bx", "cx"], ["ab", "ac"]), ("/É/i", ["é"], ["e"]), ("/[a-z&&[^b]]/", ["&]", "a]", "[]"], ["a", "]"]), ("/^[\\w-a]$/", ["-", "x"], ["+"]), ("/[--0]/", ["/"], ["1"]), ("/[a\\-z]/u", ["-"], ["b"]), ("/a\\/b/", ["a/b"], ["ab"]),
    ("/^\\p{Lu}\\P{Letter}[\\p{Script=Greek}\\d]$/u", ["É1λ", "A-1"], ["é1λ", "Axλ"]), ("/^\\p{Alphabetic}[\\p{ASCII}]\\p{Any}$/u", ["éa😀"], ["1a😀"]), ("/\\p{L}/", ["p{L}"], ["x"]), ("/^\\p{scx=Deva}$/u", ["\u0964"], ["a"]), ("/^\\ud83d\\ude00[\\u{1f600}-\\u{1f610}]$/u", ["😀😃"], ["😀"]),
    ("/^(?:)*(?:a{0}b{1,2}c{2,}?)$/", ["bcc", "bbccc"], ["abcc", "bbbcc"]), ("/(?<y>a)|(?<y>b)/", ["b"], ["c"]),
]
BAD_JS = ["/a++/", "/a**/", "/{2}/", "/a{2}{3}/", "/a{3,2}/", "/(/", "/)/", "/[/", "/[z-a]/", "/?/", "/(?<=a)*/", "/^*/", "/\\b+/", "/x{id}/u", "/}/u", "/\\-/u", "/\\1/u", "/(?=a)*/u", "/\\u{110000}/u", "/\\k<a>/u", "/(?<a>x)\\k<b>/", "/(?<a>x)(?<a>y)/", "/(?<1>x)/", "/[\\d-z]/u", "/\\p{Nope}/u", "/(?ii:a)/", "/(?-:a)/", "/(?>a)/", "/a/uv", "/a/gg", "/a/x", "/\\/", "/(?:(a)|b)*\\1/", "/(?:(a)?\\1b)+/"]


def test_js_patterns_in_both_engines(spark):
    cases = [(p, t, fits) for p, yes, no in JS_PATTERNS for texts, fits in ((yes, True), (no, False)) for t in texts]
    assert [(p, t) for p, t, fits in cases if matches_pattern(t, p) is not fits] == []
    rows = spark.createDataFrame([(t,) for t in sorted({t for _, t, _ in cases})], "t string")
    got = rows.select("t", *[matches(F.col("t"), p).alias(f"p{k}") for k, (p, _, _) in enumerate(JS_PATTERNS)]).collect()
    found = {(p, r["t"]): r[f"p{k}"] for r in got for k, (p, _, _) in enumerate(JS_PATTERNS)}
    assert [(p, t) for p, t, fits in cases if found[p, t] is not fits] == []
    assert [(p, t) for (p, t), fits in found.items() if matches_pattern(t, p) is not fits] == []
    assert sum(compile_pattern(p).java is None for p, _, _ in JS_PATTERNS) == 4


@pytest.mark.parametrize("bad", BAD_JS)
def test_what_is_no_js_pattern(bad):
    with pytest.raises(PatternError):
        compile_pattern(bad)


def test_extract_text():
    assert extract_text("<p>a<b>b</b>c<!--x-->d &copy;<script>x</script><ul><li>1<li>2</ul><nav>n</nav>", ["nav"]) == "a b c d © 1 2"
    assert extract_text("<main>m<div class='x y'>d</div></main>z", root=".y") == "d"
    assert extract_text("<main>m</main>z", ["main"], root="main") == "z"
    assert extract_text("<div>a<div>b</div></div>", root="div") == "a b b"
    assert extract_text("") == "" and extract_text("<title>t</title>") == ""
    assert extract_text("it\\'s x​ y") == "it's x y"
    assert extract_text("<p role=search>s</p><p role='x'>t", ['[role="search"]']) == "t"
    with pytest.raises(SelectorError):
        compile_selector("a:hover")


def test_discover_links():
    page = "<a href=a>1</a><a href='/b?x#y'>2</a><a href=#z>3</a><a href='MAILTO:q'>4</a><a>5</a><a href=a>6</a><area href=c><a href='http://['>7</a>"
    assert discover_links(page, "https://s.com/d") == ["https://s.com/a", "https://s.com/b?x#y"]


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="ab \t\n\r\x0b  　\\'\"", max_size=30))
def test_tidy_has_no_runs_of_blanks(text):
    out = tidy(text)
    assert not re.search("[\t\n\x0b\r 　]{2,}", out) and out == out.strip("\t\n\x0b\x0c\r 　")


def test_tidy_column(spark):
    texts = ["a\n\n b", " x\t", "it\\'s \\\\ \\n", "", None, "a\tb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tidy_column(F.col("t")).alias("o")).collect()
    assert [r.o for r in rows] == [None if t is None else tidy(t) for t in texts]


def test_json():
    assert parse_json('{"b":1.0,"2":[],"1":{}}') == ('{"1":{},"2":[],"b":1}', '{\n  "1": {},\n  "2": [],\n  "b": 1\n}')
    assert parse_json("null") == (None, "null")
    assert parse_json("NaN") == (None, "NaN") and parse_json(b"\xff{") == (None, "�{")
    assert [js_number(x) for x in (1e21, 1e20, 1e-6, 1e-7, -0.0, 123456.789, 2.5e-10, 1.5e300)] == ["1e+21", "100000000000000000000", "0.000001", "1e-7", "0", "123456.789", "2.5e-10", "1.5e+300"]
    assert [classify_content_type(x) for x in ("application/JSON; x", "application/xhtml+xml", "a/html+json", "", None)] == ["json", "html", "json", "text", "text"]


def test_sitemap():
    assert parse_sitemap("<urlset><url><loc> http://a/?x=1&amp;y </loc></url><url><loc><![CDATA[http://b]]></loc></url><url><loc/></url></urlset>") == ([], ["http://a/?x=1&y", "http://b"])
    assert parse_sitemap("<sitemapindex><sitemap><loc>s</loc></sitemap>") == (["s"], [])
    assert parse_sitemap("<loc>q</loc>") == ([], ["q"]) and parse_sitemap("") == ([], [])


def test_rules(spark):
    u = F.col("u")
    rows = spark.createDataFrame([("https://a.com/x/y/z",), ("https://a.com/",), ("https://b.com/x",), ("https://a.com/X",)], "u string")
    routes = {"https://a.com": {"x": "x.txt", "x/y": "xy.txt", "*": "rest.txt"}, "b.com": {"y": "y.txt"}}
    assert [r[0] for r in rows.select(route(u, routes)).collect()] == ["xy.txt", "rest.txt", None, "rest.txt"]
    assert [r[0] for r in rows.select(most_specific(u, [("a.com", 1), ("com/x/", 2), ("/b\\.com/", 3)])).collect()] == [2, 1, 3, 1]
    assert rows.select(path_prefixes(u)).first()[0] == ["x/y/z", "x/y", "x"]
    with pytest.raises(ValueError):
        route(u, {"a": {"*": "../x"}}, directory="out")


def test_config():
    c = load_config({"start_urls": ["http://www.s.com/"], "exclude": {"extend": ["x"]}, "sites": [{"match": "s", "extract": {"remove_selectors": {"append": ["b"]}}}]})
    assert c["include"] == ["https://s.com/"] and c["exclude"][-1] == "x" and len(c["exclude"]) == 2
    assert c["sites"][0]["extract"]["remove_selectors"][-1] == "b" and c["storage"]["crawled_dir"] == "dataset/crawled"
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": None}}) == {"a": {"b": None, "c": 2}}
    assert listed({"prepend": [0], "extend": [2], "append": [3]}, [1]) == [0, 1, 2] and listed(None, [1]) == [1] and listed({"replace": []}, [1]) == []
    for bad in ({"wait_until": "x"}, {"block_resources": ["x"]}, {"block_resources": 1}):
        with pytest.raises(ConfigError):
            load_config({"browser": bad})


def test_hooks():
    h, seen = Hooks(), []
    off = h.on("page", seen.append)
    h.emit("page", 1)
    off()
    h.emit("page", 2)
    h.on("extract", lambda v: None)
    h.on("extract", lambda v: v + "!")
    assert seen == [1] and h.reduce("extract", "a") == "a!"


def test_waits_and_retries():
    assert rate_limit_wait({"retry-after": "2"}, 5) == 2000 and rate_limit_wait({"retry-after": ""}, 5) == 0
    assert rate_limit_wait({"retry-after": "Thu, 01 Jan 1970 00:01:40 GMT"}, 5, now=40) == 60_000
    assert rate_limit_wait({"x-ratelimit-reset": "100"}, 5, now=40) == 60_000 and rate_limit_wait({"retry-after": "x"}, 5) == 5 and rate_limit_wait({}, 5) == 5
    retry, limit = {"max": 1, "status_codes": [503], "delay": 0}, {"exit_on_limit": False, "fallback_delay": 7}
    answers, slept = [FetchError("", 429), FetchError("", 503), {"data": b"x", "status": 200, "headers": {}}], []

    def fetch(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert with_retries(fetch, "u", retry, limit, slept.append)["status"] == 200 and slept == [0.007]
    answers[:] = [FetchError("gone", 404)]
    assert with_retries(fetch, "u", retry, limit)["error"] == "gone"
    answers[:] = [FetchError("", 429)]
    assert with_retries(fetch, "u", retry, limit | {"exit_on_limit": True})["rate_limited"]


@pytest.mark.parametrize(
    "host, name",
    [
        ("fa\u00df.de", "xn--fa-hia.de"),
        ("\u03b2\u03cc\u03bb\u03bf\u03c2.com", "xn--nxasmm1c.com"),
        ("\u1e9eA.de", "xn--a-pfa.de"),
        ("B\u00dcCHER.DE", "xn--bcher-kva.de"),
        ("a\u3002b\uff0ec\uff61d", "a.b.c.d"),
        ("\u2615.us", "xn--53h.us"),
        ("XN--FA-HIA.\u0064e", "xn--fa-hia.de"),
        ("\u05d0\u05d1.com", "xn--4dbc.com"),
        ("\u0915\u094d\u200d\u0937.in", "xn--11b2ezcw70k.in"),
    ],
)
def test_names_that_are_not_ascii(host, name):
    assert normalize(f"http://{host}/") == f"https://{name}/"


@pytest.mark.parametrize("host", ["\u0301a.de", "a\u200db.de", "\ue000.de", "\u2100.de", "\u05d0a.com", "xn--\u00e9.de", "\u00ad"])
def test_names_that_are_refused(host):
    assert normalize_or_none(f"http://{host}/") is None
