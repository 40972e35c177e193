"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(w | v, u) = P(group | v, u) P(class | group, v, u) P(w | class, v), for a word w after v, and u before that. All three
are log-linear. The first two have hashed weights for the word before and for the word before that (a skip), tell the
groups apart and the classes of each group, and start from their shares. The third has a hashed weight for every pair of
v and w in training, as many as the training texts hold: P(w | c, v) = q(w | c) exp(weight(v, w)) / Z(v, c), where q is a
word's share of its class; Z sums over the whole class, since words without a pair have weight 0.

The most frequent words are classes of their own; other frequent ones share classes by their endings, and rare ones have
classes by endings of their own, where all have the same share, one for the words that training doesn't know among them.
Groups, and classes of a group, are as many as the fourth root of the vocabulary, within bounds.

Training follows the gradient of the log-likelihood with a Gaussian prior, a step per coordinate divided by the mean of
what was observed and expected there. The weights of groups and classes take ROUNDS steps; in each, tasks add up what
all training texts make the model expect. Pairs lie in shards by v and class, so that a word that very many follow is
spread; the gradient of a pair's weight follows from its class's pairs alone, and a shard takes PAIR_ROUNDS steps. Texts
are packed in batches; a batch asks the shards for its pairs and rare words, and scores its texts in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkweb.llm.common import bundled, bundles, distinct, mix, packed_row, row_words_and_tails, small_batches, stable, texts_of
from silkweb.sources.shared import written

#: Groups, and classes of a group: a power of two near the fourth root of the number of words, within these.
LEAST_GROUPS, MOST_GROUPS = 4, 8
#: Shares of the classes for words of their own, for endings of frequent words, and (the rest) for endings of rare ones.
SINGLES, BINS = 1 / 2, 3 / 8
#: Features of the softmax: a quarter of the different words in training, LEAST_ROWS at least, MOST_CELLS weights at most.
LEAST_ROWS, MOST_CELLS = 1 << 10, 1 << 21
#: Gradient steps of the softmax, each over all training texts, and of the pairs' weights, within their shard.
ROUNDS, PAIR_ROUNDS = 3, 12
#: Share of a step that the softmax takes: two features meet in every token, so that halves never overshoot.
RATE = 0.5
#: What the priors take from the gradient for each unit of a weight.
DAMPING, PAIR_DAMPING = 1.0, 0.1
#: Tokens after which the events of training are packed.
PACKED = 1 << 20
#: Tokens of a step of scoring.
SCORED = 1 << 13
#: Words whose counts go to every task, at most, and how often they occur at least; the others are rare.
FREQUENT, SEEN = 1 << 16, 2
#: Numbers that ``hashed_words`` makes of the last two bytes of a word are less.
TAILS = (257 << 8) + 1
#: Cells of the gradient that are added up together.
BLOCK = 1 << 16
#: Bytes of text that are packed together, and shards of pairs and rare words, each for so many bytes of texts.
BATCH_BYTES = 6 << 20
SHARD_BYTES = 8 << 20
#: Pairs of training texts that a task holds before it sends them to their shards.
HELD_PAIRS = 2_000_000
#: Weights of pairs, less log Z, come back in steps of one in so many.
FINE = 1 << 10
#: Bits of the word before with the class, and of the word in its class, in a pair's hash.
BEFORE_BITS, WORD_BITS = 44, 20
#: The word that ends a text, and the one before its first. No text holds them: words are hashed, these are reserved.
END = np.uint64(0x1234567)
START = np.uint64(0)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def is_held_out(key: Column) -> Column:
    """Documents that training leaves out: CRC-32 of the key as text is 1 modulo 5. A null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _token_runs(column):
    """(first row, tokens, tails, tokens per row) of runs of texts, an END after each."""
    data, at = texts_of(column)
    for row, _, words, counts, tails in row_words_and_tails(data, at):
        ends = np.cumsum(counts)
        yield row, np.insert(words, ends, END), np.insert(tails, ends, 0), counts + 1


def _before(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the one before that."""
    first = np.cumsum(counts) - counts
    one = np.concatenate(([START], tokens[:-1]))
    one[first] = START
    two = np.concatenate(([START], one[:-1]))
    two[first] = START
    return one, two


def _pairs(before: np.ndarray, classes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Hashes of pairs; those of one word before and one class lie together in their order."""
    group = mix(before * _A + mix(classes.astype(np.uint64) + _B))
    return group >> np.uint64(64 - BEFORE_BITS) << np.uint64(WORD_BITS) | mix(tokens * _B + _C) >> np.uint64(64 - WORD_BITS)


def _features(before: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    one, two = before
    return np.stack([(h & np.uint64(rows - 1)).astype(np.int64) for h in (mix(one * _A + _C), mix(two * _C + _B))])


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


class Hashes:
    """Ordered hashes, found by their first bits: a binary search of so many misses the cache at every step."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = min(max(4 * len(keys), 1).bit_length(), 24)
        self.keys, self.shift = np.concatenate((keys, [np.uint64(2**64 - 1)])), np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Where each of ``wanted`` lies, -1 where it doesn't."""
        at = self.first[(wanted >> self.shift).view(np.int64)]
        less = np.flatnonzero(self.keys[at] < wanted)
        while len(less):
            at[less] += 1
            less = less[self.keys[at[less]] < wanted[less]]
        return np.where((self.keys[at] == wanted) & (at < len(self.keys) - 1), at, -1)


class Classes:
    """Class of each word: its own for the most frequent, else by its ending, apart for frequent and rare words."""

    def __init__(self, frequent: np.ndarray, often: np.ndarray, types: int) -> None:
        """``frequent`` are words in order of their hashes, ``often`` their counts; ``types`` is the number of all words."""
        self.groups = int(min(max(1 << round(math.log2(max(types, 1)) / 4), LEAST_GROUPS), MOST_GROUPS))
        self.n = self.groups**2
        self.first_bin, self.first_rare = int(self.n * SINGLES), int(self.n * (SINGLES + BINS))
        self.frequent, self.often = frequent, often
        self.words = np.sort(frequent[np.lexsort((frequent.view(np.int64), -often))[: self.first_bin]])
        self.of_class, self.types = np.zeros(self.n), np.zeros(self.n)
        self.hashes = Hashes(frequent)
        # By place among the frequent ones, with a last place for all others: counts, and classes of one's own, else -1.
        self.often_at, self.own = np.append(often, 0.0), np.full(len(frequent) + 1, -1)
        self.own[np.searchsorted(frequent, self.words)] = np.arange(len(self.words))
        h = mix(np.arange(TAILS, dtype=np.uint64) + _C)
        self.often_bins = self.first_bin + (h % np.uint64(self.first_rare - self.first_bin)).astype(np.int64)
        self.rare_bins = self.first_rare + (h % np.uint64(self.n - self.first_rare)).astype(np.int64)

    def of(self, tokens: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of tokens, and the counts of the frequent ones among them, else 0."""
        at = self.hashes.find(tokens)
        own = self.own[at]
        return np.where(own >= 0, own, np.where(at >= 0, self.often_bins[tails], self.rare_bins[tails])), self.often_at[at]

    def paired(self, classes: np.ndarray) -> np.ndarray:
        """Whether words of a class have weights for pairs."""
        return classes >= self.first_bin

    def shares(self, classes: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Shares of words in their classes, from the counts of frequent ones; rare words, and one for all that aren't
        known, have even shares."""
        frequent = np.where(classes < self.first_bin, 1.0, c / np.maximum(self.of_class[classes], 0.5))
        return np.where(classes < self.first_rare, frequent, 1 / (self.types[classes] + 1))


def _step(weights: np.ndarray, seen: np.ndarray, expected: np.ndarray, damping: float) -> np.ndarray:
    """What a gradient step adds to weights: the gradient, with the prior's part, over the mean of seen and expected."""
    return (seen - expected - damping * weights) / ((seen + expected) / 2 + damping)


class Softmax:
    """Probability of a class: of its group, times its own among the classes of the group.

    A feature has 1 + groups rows of weights: one over groups, and one over the classes of each group. Without any
    weights, classes have their shares of all tokens.
    """

    def __init__(self, shares: np.ndarray, groups: int, features: int) -> None:
        square = np.maximum(shares / shares.sum(), 1e-9).reshape(groups, groups)
        self.groups, self.features = groups, features
        self.group_prior = np.log(square.sum(1) / square.sum()).astype(np.float32)
        self.class_prior = np.log(square / square.sum(1, keepdims=True)).astype(np.float32)
        self.weights = np.zeros((features * (1 + groups), groups), np.float32)

    def _parts(self, features: np.ndarray, target: np.ndarray):
        """For SCORED targets at a time, and for groups, then for the classes of the target's group: the slice, the
        logarithms of probabilities before they are divided by their sums, a row for each group or class, and the sums."""
        group, own = np.divmod(target, self.groups)
        for k in range(0, len(target), SCORED):
            part = slice(k, k + SCORED)
            first = features[:, part] * (1 + self.groups)
            for level, rows, wanted in ((0, first, group[part]), (1, first + 1 + group[part], own[part])):
                z = self.weights.take(rows[0], axis=0)
                z += self.weights.take(rows[1], axis=0)
                z += self.class_prior.take(group[part], axis=0) if level else self.group_prior
                z = np.ascontiguousarray(z.T)  # sums over few long rows, not within many short ones
                z -= z.max(axis=0)
                log_p = z[wanted, np.arange(z.shape[1])]
                np.exp(z, out=z)
                total = z.sum(axis=0)
                yield part, level, z, total, log_p - np.log(total)

    def log_p(self, features: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.zeros(len(target), self.weights.dtype)
        for part, _, _, _, log_p in self._parts(features, target):
            out[part] += log_p
        return out

    def expect(self, out: np.ndarray, features: np.ndarray, target: np.ndarray, n: np.ndarray) -> float:
        """Add to ``out`` (as the weights lie) how often each feature should meet each group and class, for targets that
        occur n times each; their log-likelihood."""
        group, gained = target // self.groups, 0.0
        p = np.empty((2, self.groups, len(target)), self.weights.dtype)
        for part, level, z, total, log_p in self._parts(features, target):
            np.multiply(z, n[part] / total, out=p[level, :, part], casting="same_kind")
            gained += float((n[part] * log_p).sum())
        by_group = out.reshape(self.features, 1 + self.groups, self.groups)
        for which in features:
            both = which * self.groups + group
            for k in range(self.groups):
                by_group[:, 0, k] += np.bincount(which, p[0, k], self.features)
                by_group[:, 1:, k] += np.bincount(both, p[1, k], self.features * self.groups).reshape(self.features, self.groups)
        return gained

    def meet(self, out: np.ndarray, features: np.ndarray, target: np.ndarray, n: np.ndarray) -> None:
        """Add to ``out`` how often each feature met each group and class."""
        group, own = np.divmod(target, self.groups)
        for row in features * (1 + self.groups):
            for cell in (row * self.groups + group, (row + 1 + group) * self.groups + own):
                out += np.bincount(cell, n, out.size).reshape(out.shape)


def _events(training: DataFrame, classes: Classes, features: int) -> DataFrame:
    """(payload) of different (features, class) of the training texts with their counts, packed; written."""

    def run(batches):
        import pyarrow as pa

        parts, held = [], 0

        def packed():
            events, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_pydict({"payload": [_pack(events.view(np.uint64), n)]})

        for batch in batches:
            for _, tokens, tails, counts in _token_runs(batch.column(0)):
                one, two = _features(_before(tokens, counts), features)
                parts.append((one << 40) + (two << 16) + classes.of(tokens, tails)[0])
                held += len(tokens)
                if held > PACKED:
                    yield packed()
                    parts, held = [], 0
        if parts:
            yield packed()

    return written(training.mapInArrow(run, "payload binary"), "lm-events")


def _added(events: DataFrame, softmax: Softmax, what: str) -> tuple[np.ndarray, float]:
    """Sums over all events of what ``Softmax.meet`` or ``Softmax.expect`` adds, and the log-likelihood."""
    shared = events.sparkSession.sparkContext.broadcast(softmax)  # MOST_CELLS weights

    def run(batches):
        import pyarrow as pa

        model = shared.value
        out, gained = np.zeros(model.weights.shape), 0.0
        for batch in batches:
            for payload in batch.column(0):
                every, n = _unpack(payload.as_py())
                every = every.view(np.int64)
                for k in range(0, len(every), PACKED):
                    some = every[k : k + PACKED]
                    gained += getattr(model, what)(out, np.stack((some >> 40, some >> 16 & 0xFFFFFF)), some & 0xFFFF, n[k : k + PACKED]) or 0.0
        flat = out.ravel().astype(np.float32)
        for k in range(0, len(flat), BLOCK):
            if flat[k : k + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": [k // BLOCK], "sums": [pa.compress(flat[k : k + BLOCK].tobytes(), "zstd", asbytes=True)], "gained": [gained if k == 0 else 0.0]})

    def added(table):
        import pyarrow as pa

        block = table.column("block")[0].as_py()
        size = min(BLOCK, softmax.weights.size - block * BLOCK) * 4
        total = sum(np.frombuffer(pa.decompress(x.as_py(), size, "zstd"), np.float32).astype(np.float64) for x in table.column("sums"))
        return pa.table({"block": [block], "sums": [total.tobytes()], "gained": [sum(table.column("gained").to_pylist())]})

    kind = "block long, sums binary, gained double"
    tasks = max(1, events.sparkSession.sparkContext.defaultParallelism)
    out, gained = np.zeros(softmax.weights.size), 0.0
    for row in events.coalesce(tasks).mapInArrow(run, kind).groupBy("block").applyInArrow(added, kind).toLocalIterator():  # MOST_CELLS sums
        part = np.frombuffer(row["sums"], np.float64)
        out[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
        gained += row["gained"]
    shared.unpersist()
    return out.reshape(softmax.weights.shape), gained


def trained(training: DataFrame, classes: Classes, softmax: Softmax, rounds: int | None = None) -> list[float]:
    """Take gradient steps with the softmax's weights; the log-likelihood before each."""
    events = _events(training, classes, softmax.features)
    seen, gained = _added(events, softmax, "meet")[0], []
    for _ in range(ROUNDS if rounds is None else rounds):
        expected, now = _added(events, softmax, "expect")
        softmax.weights = (softmax.weights + RATE * _step(softmax.weights, seen, expected, DAMPING)).astype(np.float32)
        gained.append(now)
    return gained


def pair_weights(group: np.ndarray, n: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of pairs that lie in order of their group (a word before, and a class), seen n times each, whose words
    have shares q of the class; where each group begins, and its log Z."""
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, int)
    own = np.cumsum(np.concatenate(([0], group[1:] != group[:-1]))) if len(group) else np.empty(0, int)
    weights, z = np.zeros(len(n)), np.ones(len(first))
    if not len(n):
        return weights, first, z
    total = np.add.reduceat(n, first).astype(np.float64)
    for _ in range(PAIR_ROUNDS):
        weights += _step(weights, n, total[own] * q * np.exp(weights) / z[own], PAIR_DAMPING)
        z = np.maximum(1 + np.add.reduceat(q * np.expm1(weights), first), 1e-12)
    return weights, first, np.log(z)


def word_counts(training: DataFrame) -> DataFrame:
    """(word, tail, n) of all tokens of the texts in the first column."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, tokens, tails, _ in _token_runs(batch.column(0)):
                words, at, n = np.unique(tokens, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(tails[at]), pa.array(n)], names=["word", "tail", "n"])

    return training.mapInArrow(run, "word long, tail long, n long").groupBy("word", "tail").agg(F.sum("n").alias("n"))


def _frequent(counted: DataFrame) -> DataFrame:
    """The most frequent words, FREQUENT at most, seen SEEN times at least, without sorting all: those from some order of
    magnitude on."""
    size = F.floor(F.log2("n") * 16)
    counted = counted.where(F.col("n") >= SEEN)
    sizes = counted.groupBy(size.alias("size")).agg(F.count("*").alias("words")).orderBy(F.col("size").desc()).collect()  # 1024 rows at most
    least, words = math.inf, 0
    for row in sizes:
        words += row["words"]
        if words > FREQUENT:
            break
        least = row["size"]
    return counted.where(size >= F.lit(float(least)))


# --- pairs and rare words in shards ------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _pack(hashes: np.ndarray, *others: np.ndarray) -> bytes:
    """Hashes in order, as steps byte by byte, with counts and shares if given, compressed."""
    import pyarrow as pa

    data = _planes(np.diff(hashes, prepend=np.uint64(0))) + b"".join(_planes(x.astype(np.float32 if x.dtype.kind == "f" else np.uint32)) for x in others)
    return np.array([len(hashes), len(data)], np.int64).tobytes() + pa.compress(data, "zstd", asbytes=True)


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts."""
    return _unpack_all(payload)[:2]


def _unpack_all(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and shares."""
    import pyarrow as pa

    n, size = (int(x) for x in np.frombuffer(payload, np.int64, 2))
    data = np.frombuffer(pa.decompress(payload[16:], size, "zstd", asbytes=True), np.uint8)
    part = lambda lo, hi: np.ascontiguousarray(data[lo * n : hi * n].reshape(hi - lo, -1).T)
    hashes = np.cumsum(part(0, 8).view(np.uint64).ravel(), dtype=np.uint64)
    return hashes, part(8, 12).view(np.uint32).ravel(), part(12, 16).view(np.float32).ravel()


def _by_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where the shards' parts of ordered hashes begin and end: shards are equal ranges of their first 32 bits."""
    edges = (np.arange(1, shards, dtype=np.uint64) << np.uint64(32)) // np.uint64(shards) << np.uint64(32)
    return np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True) if parts else (np.empty(0, np.uint64), np.empty(0, int))
    return hashes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(hashes)).astype(np.int64) if parts else np.empty(0, np.int64)


def _counted(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shards: int) -> Iterator:
    """Rows (shard, batch, kind 2, payload) of pairs, how often each occurs and its word's share of the class."""
    hashes, n = _summed(parts)
    share = np.empty(len(hashes), np.float32)
    for some, _, q in parts:
        share[np.searchsorted(hashes, some)] = q
    edge = _by_shard(hashes, shards)
    for s in np.flatnonzero(np.diff(edge)):
        part = slice(edge[s], edge[s + 1])
        yield packed_row(int(s), -1, 2, _pack(hashes[part], n[part], share[part]))


def _model(counted: DataFrame, types: int) -> tuple[Classes, Softmax]:
    """Classes with what their words sum up to, and the softmax before training, from the counts of words."""
    top = _frequent(counted).select("word", "n").toPandas().sort_values("word")
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    classes = Classes(words[order], top["n"].to_numpy(np.float64)[order], types)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            word, tail, n = (batch.column(k).to_numpy() for k in range(3))
            which, _ = classes.of(word.view(np.uint64), tail)
            sums = np.bincount(which, n, classes.n)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_pydict({"class": some, "sum": sums[some], "types": np.bincount(which, minlength=classes.n)[some]})

    for row in counted.mapInArrow(run, "class long, sum double, types long").groupBy("class").agg(F.sum("sum"), F.sum("types")).collect():  # MOST_GROUPS squared
        classes.of_class[row[0]], classes.types[row[0]] = row[1], row[2]
    classes.of_class[classes.first_rare :] += 0.5  # for words that aren't known
    features = max(types // 4, LEAST_ROWS)
    features = 1 << min(int(features).bit_length(), int(MOST_CELLS // (classes.groups + classes.n)).bit_length() - 1)
    return classes, Softmax(classes.of_class, classes.groups, features)


def scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are the words without ASCII white space, A-Z lower-cased, and one end, also of null and empty texts. The model learns
    from the rows that ``is_held_out`` doesn't name; n_known are the tokens that occur among theirs, train_tokens is
    the number of theirs. base_score adds log10((c + 0.5) / (N + 0.5 (V + 1))); score is the model's log10 probability.
    Words are told apart by 64-bit hashes. Repeated rows and null keys are rows of their own; where nothing is left to
    learn from, all words are unknown and both scores come from even shares.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = stable(df.select(F.col(key).alias("id"), F.col(text).alias("text"), is_held_out(F.col(key)).alias("held_out")), "lm-rows")
    training = rows.where("NOT held_out").select("text")
    counted = written(word_counts(training), "lm-counts")
    total, types = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    classes, softmax = _model(counted, types)
    trained(training, classes, softmax)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(64, int(size) // SHARD_BYTES)
    shared = spark.sparkContext.broadcast(softmax)  # bounded by MOST_CELLS
    known = spark.sparkContext.broadcast(classes)  # bounded by FREQUENT
    kind = df.schema[key].dataType.simpleString()

    def runs(table):
        """Per run of texts: batch, first row, tokens, classes, tokens per row, and the counts of frequent words, else 0."""
        for batch in table:
            for first, tokens, tails, counts in _token_runs(batch.column(1)):
                which, c = known.value.of(tokens, tails)
                yield batch, first, tokens, which, counts, c

    def pairs_of(tokens: np.ndarray, which: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens have weights for pairs, and their pairs."""
        some = known.value.paired(which)
        return some, _pairs(_before(tokens, counts)[0][some], which[some], tokens[some])

    def ask(batches: Iterator) -> Iterator:
        """What each batch asks the shards for, and the pairs of the training texts among it, counted in parts: one reading
        of the words serves both."""
        parts, held = [], 0
        for number, table in bundles(batches, 1, BATCH_BYTES):
            wanted = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for batch, first, tokens, which, counts, c in runs(table):
                some, pairs = pairs_of(tokens, which, counts)
                wanted[0].append(distinct(pairs))
                wanted[1].append(distinct(tokens[c == 0]))
                learnt = ~np.asarray(batch.column(2).slice(first, len(counts)).to_numpy(zero_copy_only=False), bool)
                of = np.flatnonzero(some)[mine := np.repeat(learnt, counts)[some]]
                pairs, at, n = np.unique(pairs[mine], return_index=True, return_counts=True)
                parts.append((pairs, n, known.value.shares(which[of[at]], c[of[at]]).astype(np.float32)))
                held += len(pairs)
            for kind, hashes in enumerate(distinct(*x) for x in wanted):
                edge = _by_shard(hashes, shards)
                for s in np.flatnonzero(np.diff(edge)):
                    yield packed_row(int(s), number, kind, _pack(hashes[edge[s] : edge[s + 1]]))
            if held > HELD_PAIRS:
                yield from _counted(parts, shards)
                parts, held = [], 0
        if held:
            yield from _counted(parts, shards)

    def bundle(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for number, table in bundles(batches, 1, BATCH_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in table:
                    out.write_batch(batch)
            yield packed_row(-1, number, 3, sink.getvalue().to_pybytes())

    def dealt(batches: Iterator) -> Iterator:
        """Counts of words in the shards that rare ones are asked from."""
        for batch in batches:
            word, n = batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            order = np.argsort(word)
            edge = _by_shard(word[order], shards)
            for s in np.flatnonzero(np.diff(edge)):
                some = order[edge[s] : edge[s + 1]]
                yield packed_row(int(s), -1, 4, _pack(word[some], np.minimum(n[some], 2**32 - 1)))

    def meet(table):
        """The shard's answers: for the pairs of a batch weight less log Z; for its rare words their counts."""
        import pyarrow as pa

        rows = list(zip(table.column("kind").to_pylist(), table.column("batch").to_pylist(), table.column("payload")))
        parts = [_unpack_all(p.as_py()) for k, _, p in rows if k == 2]
        pairs, n = _summed(parts)
        q = np.empty(len(pairs))
        for some, _, share in parts:
            q[np.searchsorted(pairs, some)] = share
        words, of_word = _summed([_unpack(p.as_py()) for k, _, p in rows if k == 4])
        group = pairs >> np.uint64(WORD_BITS)
        weights, first, log_z = pair_weights(group, n, q)
        out: dict[str, list] = {"shard": [], "batch": [], "kind": [], "payload": []}
        for which, number, payload in rows:
            if which > 1:
                continue
            asked, _ = _unpack(payload.as_py())
            if which == 0:
                values = (_found(pairs, weights, asked) - _found(group[first], log_z, asked >> np.uint64(WORD_BITS))) * FINE
                values = np.clip(np.rint(values), -(1 << 15), (1 << 15) - 1).astype(np.int16)
            else:
                values = _found(words, of_word, asked).astype(np.uint32)
            out["shard"].append(int(table.column("shard")[0].as_py()))
            out["batch"].append(number)
            out["kind"].append(which)
            out["payload"].append(np.array([len(asked)], np.int64).tobytes() + pa.compress(_planes(values), "zstd", asbytes=True))
        return pa.table(out, schema=pa.schema([("shard", pa.int64()), ("batch", pa.int64()), ("kind", pa.int64()), ("payload", pa.binary())]))

    def answers(rows: list[tuple[int, bytes]], kind) -> np.ndarray:
        """Values from all shards in their order."""
        import pyarrow as pa

        out = [np.empty(0, kind)]
        wide = np.dtype(kind).itemsize
        for _, data in sorted(rows):
            size = int(np.frombuffer(data, np.int64, 1)[0])
            out.append(np.ascontiguousarray(np.frombuffer(pa.decompress(data[8:], size * wide, "zstd", asbytes=True), np.uint8).reshape(wide, size).T).view(kind).ravel())
        return np.concatenate(out)

    def finish(table):
        import pyarrow as pa

        softmax, classes = shared.value, known.value
        rows = list(zip(table.column("kind").to_pylist(), table.column("shard").to_pylist(), table.column("payload")))
        texts = list(pa.ipc.open_stream(next(p for k, _, p in rows if k == 3).as_py()))
        log_pair = answers([(s, p.as_py()) for k, s, p in rows if k == 0], np.int16) / FINE
        n_rare = answers([(s, p.as_py()) for k, s, p in rows if k == 1], np.uint32)
        parts = list(runs(texts))
        pairs = distinct(np.empty(0, np.uint64), *(distinct(pairs_of(tokens, which, counts)[1]) for _, _, tokens, which, counts, _ in parts))
        rares = distinct(np.empty(0, np.uint64), *(distinct(tokens[c == 0]) for _, _, tokens, _, _, c in parts))
        if len(pairs) != len(log_pair) or len(rares) != len(n_rare):
            raise RuntimeError("texts changed between two readings of one partition")
        out = {}
        for batch, first, tokens, which, counts, c in parts:
            if id(batch) not in out:
                out[id(batch)] = batch, *(np.zeros(batch.num_rows, kind) for kind in (np.int64, np.int64, float, float))
            _, n_tokens, n_known, base, score = out[id(batch)]
            many, owner = batch.num_rows, np.repeat(np.arange(first, first + len(counts)), counts)
            context = _before(tokens, counts)
            features = _features(context, softmax.features)
            log_p = softmax.log_p(features, which).astype(np.float64)
            rare, some = c == 0, classes.paired(which)
            log_p += np.log(classes.shares(which, c))
            if rare.any():
                c[rare] = n_rare[np.searchsorted(rares, tokens[rare])]
            some_pairs, where = np.unique(_pairs(context[0][some], which[some], tokens[some]), return_inverse=True)  # in order, they are found fast
            log_p[some] += log_pair[np.searchsorted(pairs, some_pairs)][where]
            n_tokens += np.bincount(owner, minlength=many)
            n_known += np.bincount(owner[c > 0], minlength=many)
            base += np.bincount(owner, np.log10(c + 0.5), many)
            score += np.bincount(owner, log_p / math.log(10), many)
        done = []
        for batch, n, n_known, base, score in out.values():
            columns = [batch.column(0), batch.column(2), *map(pa.array, (n, n_known, np.full(len(n), total), base - n * math.log10(total + 0.5 * (types + 1)), score))]
            done.append(pa.RecordBatch.from_arrays(columns, names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        pa.default_memory_pool().release_unused()  # workers live on for other stages
        return pa.Table.from_batches(done)

    asked = rows.mapInArrow(ask, bundled).union(counted.mapInArrow(dealt, bundled))
    found = asked.groupBy("shard").applyInArrow(meet, bundled)
    both = rows.mapInArrow(bundle, bundled).union(found)
    return both.groupBy("batch").applyInArrow(finish, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
