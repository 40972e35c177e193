"""The most specific of very many rules for every URL, by joins on the rules' table.

``rules.py`` builds a CASE chain, which suits the few rules of a configuration. Here rules are rows. URL prefixes meet
URLs by equality: a URL has one key for its origin and one for every leading run of its path. Substrings, and literals
that a regular expression can't do without, are found by Aho-Corasick in one pass over each URL; only expressions whose
literal was found, or that have none, are run. The plan is the same for ten rules and for a million.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.functions import urls
from silkweb.functions.patterns import compile_pattern
from silkweb.sources.shared import written

#: Bytes of patterns that a task searches for at once; more are searched for in several passes over the URLs.
SHARD_BYTES = 32 << 20
#: Rows of prefix rules that are broadcast; more are met by shuffle, each in so many copies that a key that very many
#: URLs have is spread.
BROADCAST_ROWS, SALTS = 100_000, 8

_ESCAPED = re.compile(r"\\([^A-Za-z0-9])")


def literal_of(source: str) -> str:
    """The longest text that every match of a regular expression holds; empty where none is sure.

    Only plain characters outside groups and classes count, and no expression with alternatives or flags has any.
    """
    if "|" in source or "(?" in source:
        return ""
    runs, run, depth, k = [], "", 0, 0
    while k < len(source):
        c, plain = source[k], ""
        if c == "\\":
            m = _ESCAPED.match(source, k)
            plain, step = (m[1], 2) if m else ("", 2)
        elif c == "[":
            end = k + 1
            while end < len(source) and source[end] != "]":
                end += 2 if source[end] == "\\" else 1
            step = end + 1 - k
        else:
            plain, step = ("" if c in "().^$*+?{}" else c), 1
            depth += (c == "(") - (c == ")")
            if c == "{":
                step = max(1, source.find("}", k) + 1 - k)
        quantified = source[k + step : k + step + 1] in ("*", "?", "{")
        if plain and not depth and not quantified:
            run += plain
            if source[k + step : k + step + 1] == "+":  # once at least, but what follows may stand further on
                runs, run = [*runs, run], ""
        else:
            runs, run = [*runs, run], ""
        k += step
    return max([*runs, run], key=len)


def compiled_rules(rules: DataFrame) -> DataFrame:
    """``rules`` (rule bigint, pattern string) as (rule, kind, text, literal, length); PatternError for a bad one.

    Kinds: prefix (text is origin and path), start (of what isn't a URL), substring, regex (text as both engines take
    it). Null patterns fit nothing and go. Equal patterns keep their least rule.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for rule, pattern in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = compile_pattern(pattern)
                kind, text, literal = made.kind, made.text, ""
                if kind == "prefix":
                    try:
                        url = urls.parse(text if text.endswith("/") else text + "/")
                        text = url.origin + url.path.removesuffix("/")
                    except urls.UrlError:
                        kind = "start"
                elif kind == "regex" and "i" not in pattern[pattern.rfind("/") :]:
                    literal = literal_of(text)
                out.append((rule, kind, text, literal, made.length))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()))], names=["rule", "kind", "text", "literal", "length"])

    first = rules.where("pattern IS NOT NULL").groupBy("pattern").agg(F.min("rule").alias("rule")).select(F.col("rule").cast("long"), "pattern")
    return first.mapInArrow(run, "rule long, kind string, text string, literal string, length int")


class _Searcher:
    """Substring, start and regex rules of a shard, against one URL."""

    def __init__(self, rows: list[tuple]) -> None:
        import ahocorasick

        from silkweb.functions.patterns import _python

        self.test = _python
        words: dict[str, list[tuple]] = {}
        self.always: list[tuple] = []
        for rule, kind, text, literal, length in rows:
            word = literal if kind == "regex" else text
            (words.setdefault(word, []) if word else self.always).append((length, -rule, kind, text))
        self.find = None
        if words:
            automaton = ahocorasick.Automaton()
            for word, found in words.items():
                plain = max((f for f in found if f[2] == "substring"), default=None)
                others = sorted((f for f in found if f[2] != "substring"), key=lambda f: f[:2], reverse=True)
                automaton.add_word(word, (len(word), plain, others))
            automaton.make_automaton()
            self.find = automaton.iter
        self.always.sort(key=lambda f: f[:2], reverse=True)

    def best(self, url: str) -> tuple[int, int] | None:
        """(length, minus rule) of the most specific rule."""
        top: tuple[int, int] = (-1, 0)
        unsure = [self.always] if self.always else []
        for end, (size, plain, others) in self.find(url) if self.find else ():
            if plain and plain[:2] > top:
                top = plain[:2]
            if others:
                for f in others:
                    if f[2] == "start" and end + 1 == size and f[:2] > top:
                        top = f[:2]
                unsure.append(others)
        for found in unsure:
            for length, rule, kind, text in found:
                if (length, rule) <= top:
                    break  # they come by length and rule
                if kind == "substring" or kind == "regex" and self.test(text).search(url):
                    top = length, rule
                    break
        return top if top[0] >= 0 else None


def _searched(rows: DataFrame, found: list[tuple]) -> DataFrame:
    """``rows`` (url, best) with the better of ``best`` and a shard's rules."""
    import pyarrow as pa

    shared, kind = rows.sparkSession.sparkContext.broadcast(found), pa.struct([("length", pa.int32()), ("rule", pa.int64())])

    def run(batches: Iterator) -> Iterator:
        searcher = _Searcher(shared.value)
        for batch in batches:
            at = batch.column(0).to_pylist()
            old = [None if b is None else (b["length"], b["rule"]) for b in batch.column(1).to_pylist()]
            new = [searcher.best(u) for u in at]
            best = [n if o is None else o if n is None else max(n, o) for n, o in zip(new, old)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if b is None else {"length": b[0], "rule": b[1]} for b in best], kind)], names=["url", "best"])

    return rows.mapInArrow(run, rows.schema)


def url_keys(url):
    """Keys under which prefix rules may stand: the origin, and with it every part of the path that ends before a slash
    or at the path's end."""
    path = urls.path_of(url)
    cuts = F.split(path, "/")  # the first part is empty
    leading = F.transform(F.sequence(F.lit(1), F.size(cuts)), lambda n: F.array_join(F.slice(cuts, 1, n), "/"))
    return F.array_distinct(F.transform(leading, lambda p: F.concat(urls.origin_of(url), p)))


def most_specific(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``rule``, the rule whose pattern fits the canonical URL in ``url`` most specifically: the longest,
    of equally long ones the least rule; null where none fits, where the URL is null or there are no rules.

    ``rules`` has (rule, pattern): patterns as a configuration has them, in any number. Rows of ``pages`` that repeat
    have the same rule each; a column called ``rule`` is replaced.
    """
    made = written(compiled_rules(rules.select("rule", "pattern")), "rules")
    best = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("rule", T.LongType())])
    # Searching takes more time than its few bytes tell, so the number of tasks is fixed.
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct().repartition(tasks, F.xxhash64("url"))
    found = distinct.withColumn("best", F.lit(None).cast(best))
    searched = made.where("kind <> 'prefix'")
    size = searched.agg(F.sum(F.octet_length("text") + F.octet_length("literal") + 64)).first()[0] or 0
    shards = -(-size // SHARD_BYTES)
    for k in range(shards):
        rows = searched.where(F.pmod(F.xxhash64("rule"), F.lit(shards)) == k).collect()  # a shard's bytes are bounded
        found = _searched(found, [tuple(r) for r in rows])
    found = written(found, "rules-searched")
    prefixes = made.where("kind = 'prefix'").groupBy(F.col("text").alias("key")).agg(F.max(F.struct("length", (-F.col("rule")).alias("rule"))).alias("prefix"))
    keys = found.select("url", F.explode(url_keys(F.col("url"))).alias("key"))
    if made.where("kind = 'prefix'").count() <= BROADCAST_ROWS:
        met = keys.join(F.broadcast(prefixes), "key")
    else:
        copies = prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = keys.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(copies, ["key", "salt"])
    every = found.where("best IS NOT NULL").select("url", "best").unionByName(met.select("url", F.col("prefix").cast(best).alias("best")))
    named = every.groupBy("url").agg((-F.max("best")["rule"]).alias("rule")).withColumnRenamed("url", "_of")
    columns = [F.col(c) for c in pages.columns if c != "rule"]
    return pages.drop("rule").join(named, F.col(url) == F.col("_of"), "left").select(*columns, "rule")


def routed_by(pages: DataFrame, rules: DataFrame, files: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` that a route takes, with ``file``: the most specific rule alone decides, and of its ``files`` (rule, key,
    file) the one whose key is the longest leading run of the URL's path segments, else the one under ``*``."""
    named = most_specific(pages.withColumn("_row", F.monotonically_increasing_id()), rules, url)
    held = written(named.where("rule IS NOT NULL"), "routed")
    prefixes = urls.path_prefixes(F.col(url))  # the longest first
    keys = held.select("_row", "rule", F.posexplode(F.concat(prefixes, F.array(F.lit("*")))).alias("_at", "key"))
    first = keys.join(files.where("file IS NOT NULL"), ["rule", "key"]).groupBy("_row").agg(F.min(F.struct("_at", "file")).alias("f")).select("_row", "f.file")
    return held.drop("file").join(first, "_row").drop("_row", "rule")


def rules_of(spark, routes: dict[str, dict[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(rules, files) of a configuration's routes, in its order."""
    patterns = [(k, p) for k, p in enumerate(routes)]
    files = [(k, key, f) for k, p in patterns for key, f in routes[p].items() if f]
    return spark.createDataFrame(patterns, "rule bigint, pattern string"), spark.createDataFrame(files, "rule bigint, key string, file string")

