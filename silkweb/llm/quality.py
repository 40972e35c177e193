"""Quality classifier: modified Kneser-Ney n-gram models of trusted text, perplexity per document, thresholds by language.

The models' units are the bytes of the text, of any script; white space between a word and its repetition is a symbol of
its own, which trusted text makes rare however well the word itself is known. Languages with enough trusted documents
have a model each, the others go by one of all.

Counts are summed in shards by n-gram. Texts are packed in batches of many documents; the distinct n-grams of a batch
are sent to the shards that hold their counts, joined there, and their probabilities come back to the batch, where they
are added up by document. Texts are read once for their n-grams and once to be packed: what is shuffled are the packed
texts and a fraction of their size in n-grams, and nothing of it is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silkweb.llm import common
from silkweb.llm.common import bundles, distinct, hashed_words, least_hashes, mix, small_batches, spread_join, stable, texts_of
from silkweb.sources.shared import written

ORDER = 5
#: Most trusted documents that the models are trained on: those with the least hashes of their keys.
SAMPLE = 20_000
#: Trusted documents in the sample that a language needs for a model of its own; so there are SAMPLE / LEAST_DOCS at most.
LEAST_DOCS = 200
#: One trusted document in so many is left out of training; thresholds come from these.
LEFT_OUT = 5
#: Share of a language's trusted documents that its threshold lets pass.
KEEP = 0.998
#: Documents left out that a language needs for a quantile of its own; others take the quantile of all languages in
#: standard deviations.
LEAST_QUANTILE = 500
#: Symbols of the language's mean that each document's own are averaged with, so few odd words don't reject a short one.
PRIOR = 150.0
#: What a document may exceed its language's quantile by, in nats a symbol.
SLACK = 0.1
#: Accuracy of the quantile sketch.
SKETCH = 10_000
#: White space before a word that equals the one before it, A-Z lower-cased: a byte that UTF-8 doesn't have.
REPEAT = 0xFF
SYMBOLS = 256
#: Bytes of text that are packed together.
BATCH_BYTES = 8 << 20
#: Shards of the counts; each has copies for so many bytes of texts.
SHARDS = 256
COPY_BYTES = 32 << 30


# --- n-grams of texts --------------------------------------------------------------------------------------------------


def _codes(symbols: np.ndarray) -> np.ndarray:
    """The code of the n-gram that ends at each symbol from ORDER - 1 on, the first symbol highest."""
    n = len(symbols) - ORDER + 1
    out = symbols[:n].astype(np.int64)
    for k in range(1, ORDER):
        out <<= 8
        out |= symbols[k : k + n]
    return out


def _suffix(grams: np.ndarray, order: int, of: int = ORDER) -> np.ndarray:
    """The last ``order`` symbols of n-grams of ``of`` symbols, under the same model."""
    return (grams >> (8 * of)) << (8 * order) | grams & ((1 << (8 * order)) - 1)


def _long_text(data: np.ndarray, lo: int, hi: int) -> Iterator[np.ndarray]:
    before, last = np.zeros(ORDER - 1, np.uint8), np.empty(0, np.uint64)
    for a, b in common._slices(data, lo, hi):  # all but the first begin with white space
        symbols = data[a:b].copy()
        words, start, _ = hashed_words(symbols)
        known = np.concatenate((last, words))
        again = start[len(words) - max(0, len(known) - 1) :][known[1:] == known[:-1]]
        symbols[again - 1] = REPEAT
        symbols = np.concatenate((before, symbols))
        yield _codes(symbols)
        before, last = symbols[len(symbols) - ORDER + 1 :], known[-1:]


def text_grams(data: np.ndarray, at: np.ndarray, models: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each n-gram, n-grams) of runs of texts, about a step of bytes each; a text starts after zeros.

    The code of an n-gram holds the number of the row's model above its symbols.
    """
    row, rows = 0, len(at) - 1
    while row < rows:
        upto = max(row + 1, int(np.searchsorted(at, at[row] + common.STEP_BYTES, "right")) - 1)
        lo, hi = int(at[row]), int(at[upto])
        if upto == row + 1 and hi - lo > common.STEP_BYTES:
            for grams in _long_text(data, lo, hi):
                yield np.full(len(grams), row), grams | (int(models[row]) << (8 * ORDER))
        elif hi > lo:
            size = np.diff(at[row : upto + 1])
            pad = ORDER - 1
            run = np.insert(data[lo:hi], np.repeat(at[row:upto] - lo, pad), 32)
            first = at[row:upto] - lo + pad * np.arange(1, upto - row + 1)
            words, start, _ = hashed_words(run)
            same = np.flatnonzero(words[1:] == words[:-1]) + 1
            owner = np.searchsorted(first, start[same], "right")
            same = same[owner == np.searchsorted(first, start[same - 1], "right")]
            run[start[same] - 1] = REPEAT
            blank = first[:, None] - np.arange(1, pad + 1)
            run[blank] = 0
            of = np.repeat(np.arange(row, upto), size)
            ends = np.arange(hi - lo) + pad * (of - row + 1)
            yield of, _codes(run)[ends - pad] | (models[of] << (8 * ORDER))
        row = upto


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)


def gram_counts(df: DataFrame) -> DataFrame:
    """(gram, n) over all texts of ``df`` (model, text): under the row's model and, for all rows, under model 0."""
    small_batches(df.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def rows():
            grams, n = _distinct(parts)
            for k in range(0, len(grams), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(grams[k : k + 100_000]), pa.array(n[k : k + 100_000])], names=["gram", "n"])

        for batch in batches:
            models = batch.column(0).to_numpy().astype(np.int64)
            data, at = texts_of(batch.column(1))
            for owner, grams in text_grams(data, at, models):
                parts.append(np.unique(grams & ((1 << (8 * ORDER)) - 1), return_counts=True))
                named = models[owner] > 0
                if named.any():
                    parts.append(np.unique(grams[named], return_counts=True))
                held += sum(len(p[0]) for p in parts[-2:])
            if held > 1_500_000:
                yield from rows()
                parts, held = [], 0
        yield from rows()

    return df.select("model", "text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


# --- Kneser-Ney --------------------------------------------------------------------------------------------------------


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What n-grams seen 0, 1, 2, and 3 or more times give up (Chen and Goodman, 1998), from how many were seen once to
    four times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = ((1, n1, 1 - 2 * y * n2 / max(n1, 1)), (2, n2, 2 - 3 * y * n3 / max(n2, 1)), (3, n3, 3 - 4 * y * n4 / max(n3, 1)))
    return [0.0, *(min(max(d, 0.1), k) if n else 0.5 * k for k, n, d in found)]


class Level:
    """Discounted shares of n-grams of one order after their contexts, and what the contexts leave to the order below."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int, off: np.ndarray) -> None:
        """``grams`` in order; ``off`` has the discounts of each model."""
        self.grams = grams
        context = grams >> 8
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(grams) else np.empty(0, int)
        self.contexts = context[first]
        lost = off[grams >> (8 * order), np.minimum(n, 3)]
        total = np.add.reduceat(n, first) if len(first) else np.empty(0)
        self.spare = np.add.reduceat(lost, first) / total if len(first) else np.empty(0)
        self.own = (n - lost) / np.repeat(total, np.diff(np.concatenate((first, [len(grams)]))))

    def probability(self, grams: np.ndarray, below: np.ndarray | float) -> np.ndarray:
        return _found(self.grams, self.own, grams, 0.0) + _found(self.contexts, self.spare, grams >> 8, 1.0) * below


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def _seen(grams: np.ndarray, n: np.ndarray, order: int, models: int) -> np.ndarray:
    """How many n-grams each model saw once to four times."""
    few = n <= 4
    return np.bincount((grams[few] >> (8 * order)) * 4 + n[few] - 1, minlength=models * 4).reshape(models, 4)


@dataclass
class Model:
    """Languages with models, the discounts of all orders and the levels below ORDER - 1, whose size the alphabet bounds."""

    languages: dict[str | None, int]
    off: dict[int, np.ndarray] = field(default_factory=dict)
    low: list[Level] = field(default_factory=list)

    def numbers(self, langs) -> np.ndarray:
        return np.array([self.languages.get(x, 0) for x in langs], np.int64)

    def log_p(self, wanted: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Natural logarithms of n-grams, from the counts of all with the same symbols between the first and the last."""
        p: np.ndarray | float = 1.0 / SYMBOLS
        for order, level in enumerate(self.low, 1):
            p = level.probability(_suffix(wanted, order), p)
        order = np.argsort(grams)
        grams, n = grams[order], n[order]
        shorter, kinds = np.unique(_suffix(grams, ORDER - 1), return_counts=True)
        p = Level(shorter, kinds, ORDER - 1, self.off[ORDER - 1]).probability(_suffix(wanted, ORDER - 1), p)
        return np.log(Level(grams, n, ORDER, self.off[ORDER]).probability(wanted, p))


def train(trusted: DataFrame, lang: str = "lang", text: str = "text") -> tuple[Model, DataFrame]:
    """The model and its counts (gram, n), from texts of at most some SAMPLE documents."""
    counted = trusted.groupBy(lang).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS).orderBy(F.col(lang).asc_nulls_first()).collect()
    model = Model({r[0]: k for k, r in enumerate(counted, 1)})
    models = len(model.languages) + 1
    number = F.lit(0)
    for name, k in model.languages.items():
        number = F.when(F.col(lang).eqNullSafe(F.lit(name)), k).otherwise(number)
    counts = written(gram_counts(trusted.select(number.cast("long").alias("model"), F.col(text).alias("text"))), "quality-counts")

    def suffixes(grams: DataFrame, order: int) -> DataFrame:
        """The n-grams one symbol shorter, and after how many symbols each was seen."""
        shorter = F.shiftleft(F.shiftright("gram", 8 * order + 8), 8 * order).bitwiseOR(F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1)))
        return grams.groupBy(shorter.alias("gram")).agg(F.count("*").alias("n"))

    def seen(grams: DataFrame, order: int) -> np.ndarray:
        out = np.zeros((models, 4), np.int64)
        for r in grams.where("n <= 4").groupBy(F.shiftright("gram", 8 * order).alias("model"), "n").agg(F.count("*").alias("of")).collect():  # four a model
            out[r["model"], r["n"] - 1] = r["of"]
        return out

    off = lambda found: np.array([discounts(*map(int, row)) for row in found])
    model.off[ORDER] = off(seen(counts, ORDER))
    shorter = suffixes(counts, ORDER - 1)
    model.off[ORDER - 1] = off(seen(shorter, ORDER - 1))
    rows = suffixes(shorter, ORDER - 2).toArrow()  # three bytes and a model: at most 2 ** 24 a model, some 100,000 in practice
    grams, n = (rows.column(k).to_numpy() for k in (0, 1))
    for order in range(ORDER - 2, 0, -1):
        at = np.argsort(grams)
        grams, n = grams[at], n[at]
        model.low.insert(0, Level(grams, n, order, off(_seen(grams, n, order, models))))
        grams, n = np.unique(_suffix(grams, order - 1, order), return_counts=True)
    return model, counts


# --- scores ------------------------------------------------------------------------------------------------------------


def _shard(grams: np.ndarray) -> np.ndarray:
    """By the symbols between the first and the last, on which counts and contexts of the two highest orders agree."""
    return (mix((grams >> 8 & ((1 << (8 * (ORDER - 2))) - 1)).astype(np.uint64)) % np.uint64(SHARDS)).astype(np.int64)


def surprise(df: DataFrame, model: Model, counts: DataFrame, text: str = "text", lang: str = "lang", drop: bool = False) -> DataFrame:
    """``df`` with nats, the negative log-probability of each row's whole text, and symbols, their number (0 for null);
    ``drop`` leaves the text out. Columns of these names are replaced."""
    import pyarrow as pa

    spark = df.sparkSession
    small_batches(spark)
    df = stable(df.drop("nats", "symbols"), "quality-rows")
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    copies = int(size) // COPY_BYTES + 1
    shared = spark.sparkContext.broadcast(model)  # the levels up to ORDER - 2
    at_text, at_lang = df.columns.index(text), df.columns.index(lang)
    columns = [c for c in df.columns if not drop or c != text]
    places = [df.columns.index(c) for c in columns]
    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField("nats", T.DoubleType(), False), T.StructField("symbols", T.LongType(), False)])

    def ask(batches: Iterator) -> Iterator:
        """The distinct n-grams of each bundle, by shard."""
        for number, rows in bundles(batches, at_text, BATCH_BYTES):
            grams = np.empty(0, np.int64)
            for batch in rows:
                data, at = texts_of(batch.column(at_text))
                models = shared.value.numbers(batch.column(at_lang).to_pylist())
                grams = distinct(grams, *(distinct(g) for _, g in text_grams(data, at, models)))
            shard = _shard(grams)
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange(SHARDS + 1))
            copy = int(mix(np.array([number], np.uint64))[0] % np.uint64(copies)) * SHARDS
            for s in np.flatnonzero(np.diff(edge)):
                yield _packed(int(s) + copy, number, _squeezed(grams[order[edge[s] : edge[s + 1]]]))

    def bundle(batches: Iterator) -> Iterator:
        for number, rows in bundles(batches, at_text, BATCH_BYTES):
            yield _packed(-1, number, _ipc(rows))

    def dealt(batches: Iterator) -> Iterator:
        for batch in batches:
            shard = _shard(batch.column(0).to_numpy())
            for k in range(copies):
                yield pa.RecordBatch.from_arrays([pa.array(shard + k * SHARDS), batch.column(0), batch.column(1)], names=["shard", "gram", "n"])

    def meet(asked, counted):
        """The shard's answers: for each batch its n-grams and their log-probabilities."""
        grams, n = counted.column("gram").to_numpy(), counted.column("n").to_numpy()
        wanted = [_restored(x.as_py())[0] for x in asked.column("payload")]
        every, at = np.unique(np.concatenate(wanted), return_inverse=True) if wanted else (np.empty(0, np.int64), np.empty(0, int))
        log_p = shared.value.log_p(every, grams, n).astype(np.float32)[at]
        payload, end = [], 0
        for w in wanted:
            payload.append(_squeezed(w, log_p[end : end + len(w)]))
            end += len(w)
        return pa.table({"shard": pa.array([0] * len(payload), pa.int64()), "batch": asked.column("batch"), "payload": pa.array(payload, pa.binary())})

    def finish(rows):
        shard, payloads = rows.column("shard").to_numpy(), rows.column("payload")
        grams, log_p = [], []
        for k in np.flatnonzero(shard >= 0):
            own, values = _restored(payloads[int(k)].as_py())
            grams.append(own)
            log_p.append(values)
        grams, log_p = (np.concatenate(x) if x else np.empty(0) for x in (grams, log_p))
        order = np.argsort(grams)
        grams, log_p = grams[order], log_p[order].astype(np.float64)
        out = []
        for batch in pa.ipc.open_stream(payloads[int(np.flatnonzero(shard < 0)[0])].as_py()):
            data, at = texts_of(batch.column(at_text))
            nats = np.zeros(batch.num_rows)
            for owner, own in text_grams(data, at, shared.value.numbers(batch.column(at_lang).to_pylist())):
                some, where = np.unique(own, return_inverse=True)
                place = np.minimum(np.searchsorted(grams, some), len(grams) - 1)
                if (grams[place] != some).any():
                    raise RuntimeError("texts changed between two readings of one partition")
                nats -= np.bincount(owner, log_p[place][where], batch.num_rows)
            out.append(pa.RecordBatch.from_arrays([*(batch.column(k) for k in places), pa.array(nats), pa.array(np.diff(at), pa.int64())], names=schema.names))
        done = pa.Table.from_batches(out)
        pa.default_memory_pool().release_unused()  # workers live on for other stages
        return done

    packed = "shard long, batch long, payload binary"
    of_shard = counts.mapInArrow(dealt, "shard long, gram long, n long")
    answers = df.mapInArrow(ask, packed).groupBy("shard").cogroup(of_shard.groupBy("shard")).applyInArrow(meet, packed)
    return df.mapInArrow(bundle, packed).union(answers).groupBy("batch").applyInArrow(finish, schema)


def _packed(shard: int, batch: int, payload: bytes):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"shard": [shard], "batch": [batch], "payload": [payload]})


def _ipc(batches: list) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _squeezed(grams: np.ndarray, values: np.ndarray | None = None) -> bytes:
    """n-grams, byte by byte, and single-precision values, compressed."""
    import pyarrow as pa

    columns = grams.view(np.uint8).reshape(-1, 8).T.tobytes() + (b"" if values is None else values.tobytes())
    return np.array([len(grams), len(columns)], np.int64).tobytes() + pa.compress(columns, "zstd", asbytes=True)


def _restored(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    n, size = np.frombuffer(payload, np.int64, 2)
    columns = pa.decompress(payload[16:], int(size), "zstd", asbytes=True)
    grams = np.ascontiguousarray(np.frombuffer(columns, np.uint8, 8 * n).reshape(8, -1).T).view(np.int64).ravel()
    return grams, np.frombuffer(columns, np.float32, offset=8 * int(n))


# --- thresholds --------------------------------------------------------------------------------------------------------


def _left_out(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(LEFT_OUT)) == 0


def _near(nats: Column, symbols: Column, mean: Column) -> Column:
    """Nats a symbol of a document and PRIOR symbols of its language's mean."""
    return (nats + mean * PRIOR) / (symbols + PRIOR)


def limits(scores: DataFrame, trusted: DataFrame) -> tuple[DataFrame, float | None, float | None]:
    """(language, mean, limit) of every language, and mean and limit of all, from the trusted documents among ``scores``
    (id, lang, nats, symbols) that training left out, or from all of them where there are none."""
    known = spread_join(scores.where("symbols > 0 AND id IS NOT NULL"), trusted, "id")
    out = known.where(_left_out(F.col("id")))
    known = written(known if out.isEmpty() else out, "quality-known")
    ratio = (F.sum("nats") / F.sum("symbols")).alias("mean")
    mean = known.agg(ratio).first()[0]
    langs = written(known.groupBy(F.col("lang").alias("language")).agg(ratio, F.count("*").alias("size")), "quality-langs")
    # Languages may be few and large: rows meet them by broadcast where Spark finds them small, else by shuffle.
    drawn = known.join(langs, F.col("lang").eqNullSafe(F.col("language"))).withColumn("near", _near(F.col("nats"), F.col("symbols"), F.col("mean")))
    of = written(drawn.groupBy("language", "mean", "size").agg(F.avg("near").alias("centre"), F.stddev_pop("near").alias("spread"), F.percentile_approx("near", KEEP, SKETCH).alias("own")), "quality-limits")
    scaled = drawn.select(F.col("lang").alias("l"), "near").join(of.select("language", "centre", "spread"), F.col("l").eqNullSafe(F.col("language")))
    away = (F.col("near") - F.col("centre")) / F.greatest("spread", F.lit(1e-9))
    z = scaled.where("spread > 0").agg(F.percentile_approx(away, KEEP, SKETCH)).first()[0] or 0.0
    limit = F.when(F.col("size") >= LEAST_QUANTILE, F.col("own")).otherwise(F.greatest("own", F.col("centre") + F.col("spread") * z)) + SLACK
    every = None if mean is None else known.agg(F.percentile_approx(_near(F.col("nats"), F.col("symbols"), F.lit(mean)), KEEP, SKETCH)).first()[0] + SLACK
    return of.select("language", "mean", limit.alias("limit")), mean, every


def _verdicts(scored: DataFrame, scores: DataFrame, trusted: DataFrame, lang: str) -> DataFrame:
    """``scored`` (with nats and symbols) with perplexity, threshold (of it, at the document's length) and stays."""
    by_lang, mean, limit = limits(scores, trusted)
    joined = scored.join(by_lang, F.col(lang).eqNullSafe(F.col("language")), "left")
    mean, limit = F.coalesce("mean", F.lit(mean).cast("double")), F.coalesce("limit", F.lit(limit).cast("double"))
    some = F.when(F.col("symbols") > 0, F.col("symbols"))
    # The document's own symbols and PRIOR of its language's mean stay under the limit together.
    most = (limit * (F.col("symbols") + PRIOR) - mean * PRIOR) / some
    stays = F.coalesce(_near(F.col("nats"), F.col("symbols"), mean) <= limit, F.lit(True)) | (F.col("symbols") == 0)
    return joined.withColumns({"perplexity": F.exp(F.col("nats") / some), "threshold": F.exp(most), "stays": stays})


def _trusted(labels: DataFrame, key: str, quality: str) -> DataFrame:
    return labels.where(F.col(quality) == 1).select(F.col(key).alias("id")).where("id IS NOT NULL").distinct()


def _trained(df: DataFrame, trusted: DataFrame) -> tuple[Model, DataFrame]:
    """Train on trusted rows of ``df`` (id, lang, text): at most SAMPLE documents, whose keys go to all executors."""
    inside = trusted.where(~_left_out(F.col("id")))
    return train(df.join(F.broadcast(least_hashes(inside, "id", SAMPLE)), "id", "left_semi"))


def judged(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality") -> DataFrame:
    """(key, lang, symbols, perplexity, threshold, kept) of every row.

    Null and empty texts have no symbols, null perplexity and are kept; so is everything where no document is trusted.
    A null language is a language of its own; languages without trusted documents go by the model and the thresholds of
    all. Rows that repeat a key each count, and null keys are scored but never trusted.
    """
    rows = df.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    trusted = _trusted(labels, key, quality)
    scores = written(surprise(rows, *_trained(rows, trusted), drop=True), "quality-scores")
    out = _verdicts(scores, scores, trusted, "lang")
    return out.select(F.col("id").alias(key), F.col("lang").alias(lang), "symbols", "perplexity", "threshold", F.col("stays").alias("kept"))


def kept_rows(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns, which go through the scoring with the texts."""
    place = {c: f"c{k}" for k, c in enumerate(df.columns)}
    trusted = _trusted(labels, key, quality)
    rows = df.select(F.col(key).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    model, counts = _trained(rows, trusted)
    scored = written(surprise(df.toDF(*place.values()), model, counts, place[text], place[lang]), "quality-scored")
    scores = scored.select(F.col(place[key]).alias("id"), F.col(place[lang]).alias("lang"), "nats", "symbols")
    kept = _verdicts(scored, scores, trusted, place[lang]).where("stays")
    return kept.select(*[F.col(p).alias(c) for c, p in place.items()])
