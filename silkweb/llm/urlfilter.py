"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule decides.

Rules are few and known to the driver: they become one CASE chain, the longest first. The trees learn from labelled
URLs, a bounded sample of them, on the driver; scoring runs in numpy batches on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.llm.common import least_hashes, texts_of
from silkweb.sources.shared import written

#: Most distinct labelled URLs that the trees are fitted on: those with the least hashes.
SAMPLE = 20_000
TREES = 40
DEPTH = 3
RATE = 0.2
#: Split candidates of a feature.
BINS = 32
LEAST_LEAF = 8
#: Host suffixes with fewer labelled URLs than this have no statistic of their own.
LEAST_SUFFIX = 5
#: Distinct suffixes that the statistic keeps, the most frequent.
MOST_SUFFIXES = 4096
#: Parts of the labelled URLs; the statistics that a URL is trained with come from the other parts.
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    """Fits the host and its subdomains where the path starts with ``path``; ``host`` has no scheme."""

    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#``
    or the end. Both are empty where the url is null or has no ``://``."""
    text = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Of equally long ones the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last that wraps the others is tried first.
    for r in sorted(rules[::-1], key=lambda r: len(str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, str(r)).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


# --- features ----------------------------------------------------------------------------------------------------------

FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digits", "host_digits", "hyphens", "entropy", "host_entropy", "parameters", "query_length", "upper", "longest_part", "fragment", "secure", "suffix_rate", "suffix_seen", "part_rate")
PARTS = ("url", "host", "path", "query", "suffix", "part")


def parts_of(url: Column) -> list[Column]:
    """The columns PARTS: a url, its host, path and query as they are, the host's last two labels, A-Z lower-cased, and
    the path's first part. All are empty for null; without ``://`` the host starts the url."""
    text = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(text, r"(?s)^.*?://", "")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    suffix = F.substring_index(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), ".", -2)
    return [c.alias(n) for c, n in zip((text, host, path, query, suffix, F.regexp_extract(path, r"^/*([^/]*)", 1)), PARTS)]


class _Bytes:
    """Counts over the rows of an Arrow string column, from its buffer."""

    def __init__(self, column) -> None:
        self.data, at = texts_of(column)
        self.data = self.data[at[0] : at[-1]]
        self.size = np.diff(at)
        self.rows = len(self.size)
        self.owner = np.repeat(np.arange(self.rows), self.size)

    def count(self, byte: bytes, upto: bytes | None = None) -> np.ndarray:
        """Bytes that are one, or in a range of them."""
        fits = self.data == byte[0] if upto is None else (self.data >= byte[0]) & (self.data <= upto[0])
        return np.bincount(self.owner[fits], minlength=self.rows)

    def entropy(self) -> np.ndarray:
        """In bits, of the bytes of each row."""
        n = np.bincount(self.owner * 256 + self.data, minlength=self.rows * 256).reshape(-1, 256)
        share = n / np.maximum(self.size, 1)[:, None]
        return -(share * np.log2(np.where(n > 0, share, 1))).sum(1)

    def longest_between(self, byte: bytes) -> np.ndarray:
        """Length of the longest run without the byte."""
        first = np.cumsum(self.size) - self.size
        edges = np.sort(np.concatenate((first - 1, np.flatnonzero(self.data == byte[0]))))
        owner = np.minimum(np.searchsorted(first, edges + 1, "right") - 1, self.rows - 1) if self.rows else edges
        ends = np.concatenate((edges[1:], [len(self.data)]))
        run = np.minimum(ends, (first + self.size)[owner]) - edges - 1 if self.rows else edges
        out = np.zeros(self.rows, np.int64)
        np.maximum.at(out, owner, run)
        return out


def _rates(known: DataFrame, key: str, base: float) -> Statistic:
    """Over all rows of ``known`` (with y, n and fold), of the MOST_SUFFIXES most frequent keys."""
    sums = known.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("fold") == f, v).otherwise(0)).alias(f"{name}{f}") for f in range(FOLDS) for name, v in (("y", F.col("y") * F.col("n")), ("n", F.col("n")))])
    often = sums.where(F.col("n") >= LEAST_SUFFIX).orderBy(F.col("n").desc(), key).limit(MOST_SUFFIXES).collect()
    fold = lambda name: np.array([[r[f"{name}{f}"] for f in range(FOLDS)] for r in often], float).reshape(-1, FOLDS)
    return Statistic([r[key] for r in often], fold("y"), fold("n"), base)


@dataclass
class Statistic:
    """Blocked URLs and URLs by key and fold."""

    keys: list[str]
    blocked: np.ndarray
    n: np.ndarray
    base: float

    def of(self, column, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(smoothed share of blocked URLs, number of URLs) for a column of keys, without the rows' own folds."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(column, value_set=pa.array(self.keys, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        if not self.keys:
            return np.full(len(at), self.base), np.zeros(len(at))
        blocked, n = self.blocked.sum(1)[at], self.n.sum(1)[at]
        if fold is not None:
            blocked, n = blocked - self.blocked[at, fold], n - self.n[at, fold]
        blocked, n = np.where(at < 0, 0, blocked), np.where(at < 0, 0, n)
        return (blocked + 4 * self.base) / (n + 4), n


@dataclass
class Rates:
    """Statistics by suffix of the host and by first part of the path."""

    suffix: Statistic
    part: Statistic

    @staticmethod
    def of(known: DataFrame) -> Rates:
        blocked, rows = known.agg(F.sum(F.col("y") * F.col("n")), F.sum("n")).first()
        base = blocked / rows if rows else 0.5
        return Rates(_rates(known, "suffix", base), _rates(known, "part", base))


def features(parts: dict, rates: Rates, fold: np.ndarray | None = None) -> np.ndarray:
    """Rows of FEATURES from Arrow columns PARTS; ``fold`` leaves the rows' own folds out of the statistics."""
    url, host, path, query = (_Bytes(parts[p]) for p in PARTS[:4])
    suffix, seen = rates.suffix.of(parts["suffix"], fold)
    parted = url.data.tobytes()
    first = np.cumsum(url.size) - url.size
    secure = np.array([parted[a : a + 8].lower() == b"https://" for a in first], bool)
    return np.stack(
        [
            url.size, host.size, path.size, path.count(b"/"), host.count(b".") + 1, url.count(b"0", b"9") / np.maximum(url.size, 1), host.count(b"0", b"9"), host.count(b"-"), url.entropy(), host.entropy(),
            query.count(b"=") + query.count(b"&"), query.size, url.count(b"A", b"Z"), path.longest_between(b"/"), url.count(b"#") > 0, secure,
            suffix, np.log1p(seen), rates.part.of(parts["part"], fold)[0],
        ],
        1,
    ).astype(float)


# --- trees -------------------------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted trees of equal depth; node i's children are 2i+1 and 2i+2."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss with histogram splits and Newton leaves. Ties: the lowest feature and cut."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    if not len(y) or y.min() == y.max():
        start = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Trees(start, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)
    all_feature, all_cut, all_leaf = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, n = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(n, 1e-9)
            for f, c in enumerate(cuts):
                bins = len(c) + 1
                where = local * bins + binned[:, f]
                g, h, m = (np.bincount(where, w, n * bins).reshape(n, bins).cumsum(1) for w in (grad, hess, np.ones(len(y))))
                gl, hl, ml = g[:, :-1], h[:, :-1], m[:, :-1]
                gr, hr, mr = g[:, -1:] - gl, h[:, -1:] - hl, m[:, -1:] - ml
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                gain[(ml < LEAST_LEAF) | (mr < LEAST_LEAF)] = 0
                if gain.shape[1]:
                    at = gain.argmax(1)
                    more = gain[np.arange(n), at] > best + 1e-12
                    best = np.where(more, gain[np.arange(n), at], best)
                    feature[first : first + n][more] = f
                    cut[first : first + n][more] = c[at[more]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        local = node - inner
        leaf = RATE * np.bincount(local, grad, leaves) / (np.bincount(local, hess, leaves) + 1)
        margin += leaf[local]
        all_feature.append(feature)
        all_cut.append(cut)
        all_leaf.append(leaf)
    return Trees(start, np.array(all_feature), np.array(all_cut), np.array(all_leaf))


@dataclass
class Model:
    rates: Rates
    trees: Trees

    def blocks(self, parts: dict) -> np.ndarray:
        return self.trees.margin(features(parts, self.rates)) > 0


def train(labelled: DataFrame, url: str = "url", label: str = "blocked", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` distinct labelled URLs, taken by the hash of the URL so that reruns agree; shares of
    suffixes and of first parts are counted over all labelled rows, for a row in training without its own fold. A URL of
    both labels is there with each."""
    known = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull()).select(*parts_of(F.col(url)), F.col(label).cast("int").alias("y"))
    # A host is one fold's, so its rows don't tell each other's labels through the suffix.
    known = known.groupBy(*PARTS, "y").agg(F.count("*").alias("n")).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    known = written(known, "url-labels")
    rows = least_hashes(known.drop("n"), "url", sample).toArrow().combine_chunks()
    parts = {p: rows.column(p).combine_chunks() for p in PARTS}
    rates = Rates.of(known)
    return Model(rates, fit(features(parts, rates, rows.column("fold").to_numpy()), rows.column("y").to_numpy().astype(float)))


def judge(df: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, key: str = "page_id", url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """(key, host, path, rule, verdict) of every row: the verdict of the longest rule that fits, else of the trees.

    ``labelled`` (url, blocked) trains the trees; without it they learn from the URLs that rules decide. Null and odd
    URLs have empty host and path, which no rule fits and the trees judge like any other. With no labels, or labels of
    one kind, the trees give that kind (allow if there are none). Repeated rows and null keys keep a row each.
    """
    host, path = host_and_path(F.col(url))
    split = df.select(F.col(key).alias("id"), F.col(url).alias("whole"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), verdict.alias("ruled"))
    if labelled is None:
        labelled = ruled.where("ruled IS NOT NULL").select(F.col("whole").alias("url"), (F.col("ruled") == "block").alias("blocked"))
    model = train(labelled, sample=sample)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            decided = batch.column(4)
            undecided = pc.is_null(decided)
            kind = np.zeros(batch.num_rows, bool)
            some = batch.filter(undecided)
            if some.num_rows:
                kind[undecided.to_numpy(zero_copy_only=False)] = model.blocks({p: some.column(5 + k) for k, p in enumerate(PARTS)})
            verdicts = pc.if_else(undecided, pc.if_else(pa.array(kind), "block", "allow"), decided)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], verdicts], names=schema.names)

    return ruled.select("id", "host", "path", "rule", "ruled", *[c.alias(f"u_{n}") for c, n in zip(parts_of(F.col("whole")), PARTS)]).mapInArrow(run, schema)
