"""The operators against plain versions of themselves, on small tables with every odd case."""

import base64
import collections
import functools
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from silkweb.llm import bpe, exact_dedup, maxent, minhash, mixing, quality, sharding, unigram, urlfilter, vectors
from silkweb.llm.queries import PIECES, RANKS, URL_RULES

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, hash string, content string, slot int"


def docs(spark, rows):
    """Documents with columns that share names with the operators' own."""
    return spark.createDataFrame([(k, t, lang, source, None, 7, "h", "c", 1) for k, t, lang, source in rows], DOCS)


def words(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


WORDS = [a + b + c for a in ("ka", "lo", "mi", "su", "re") for b in ("na", "to", "vi", "x") for c in ("", "s", "ing", "é")]
ODD = [(9001, None, None, None), (9002, "", "en", "b"), (9003, " \t\n", "en", "b"), (None, "no key at all here today", "en", None), (9004, "w" * 70_000, "de", "a"), (9005, "one two", "en", "a"), (9006, "ONE  two", "fr", "b"), (9005, "one two", "en", "a"), (9007, "a\x0bb\x0cc\r", "en", "\U0001f600")]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, rng.choice([3, 8, 60, 300])) for _ in range(40)]
    near = []
    for k in range(60):
        w = base[k % 12].split()
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        near.append(" ".join(w))
    texts = base + near + [base[5]] * 50 + [base[6].upper() + "\n"] * 5
    return [(k, t, rng.choice(["en", "de"]), rng.choice("aaab")) for k, t in enumerate(texts)] + ODD


def collected(frame):
    return [r.asDict() for r in frame.collect()]


# --- byte-level BPE ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(deadline=None, max_examples=150)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "'s", "1", "é", ".", "\x85", "\u3000", " don't", "!!"]), max_size=30).map("".join))
def test_bpe_gives_the_librarys_ids(reference, text):
    made = bpe.load(RANKS, public_tokenizers.PATTERN)
    ids = made.encode(text)
    assert list(memoryview(ids).cast("I")) == reference.encode_ordinary(text) and made.decode(ids) == text.encode()


def test_bpe_pieces(reference):
    made, rng = bpe.load(RANKS, public_tokenizers.PATTERN), random.Random(5)
    tokens = list(made.ranks)
    for k in range(3000):
        piece = bytes(rng.choices(b"ab", k=40)) if k % 3 == 0 else b"".join(rng.choices(tokens, k=5)) if k % 3 == 1 else rng.choice(tokens) * 9
        assert made.encode_piece(piece) == reference._encode_single_piece(piece)


def test_bpe_frames(spark, rows, reference):
    frame = docs(spark, rows)
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in collected(bpe.round_trip_digest(frame, RANKS, public_tokenizers.PATTERN)))
    want = collections.Counter()
    for k, t, *_ in rows:
        ids = reference.encode_ordinary(t or "")
        want[k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    both = bpe.decode(bpe.encode(frame, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in collected(both))
    assert bpe.round_trip_digest(frame.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# --- token counts ------------------------------------------------------------------------------------------------------


def test_unigram_counts(spark, rows):
    u = unigram.load(PIECES)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i))]
    library = Tokenizer(models.Unigram(vocab=[("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])

    def count(text):
        if not text:
            return 0
        e = library.encode(text, add_special_tokens=False)
        return sum(1 if i else len(t.encode()) for i, t in zip(e.ids, e.tokens))

    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choices(["a", "b", " ", "  ", "the", "é", "\n", "梦", "\U0001f600", "ing", "x\ty", " of", ".", "ÿ", "▁"], k=rng.randint(0, 30)))
        assert u.count(text) == count(text), text
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in collected(unigram.token_counts(docs(spark, rows), PIECES)))
    assert got == collections.Counter((k, count(t)) for k, t, *_ in rows)


def test_unigram_segments_of_any_length(monkeypatch):
    import random
    import tracemalloc

    u, rng = unigram.load(PIECES), random.Random(7)
    texts = ["".join(rng.choice(["a", "the", "▁in", "é", "漢", "\U0001f600", "tion", "x\n", "===="]) for _ in range(rng.randrange(400))) for _ in range(60)]
    texts += ["a" * 500, "漢" * 500, "é漢" * 200, "=" * 700]
    whole = [u.count_segment(t) for t in texts]
    for places in (1, 2, 7, 100):
        monkeypatch.setattr(unigram, "PLACES", places)
        assert [u.count_segment(t) for t in texts] == whole
    monkeypatch.undo()
    text = "a漢" * 600_000
    tracemalloc.start()
    n = u.count_segment(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 600_000 * u.count_segment("a漢a漢") // 2 and peak < 20 << 20  # two lists of the whole take 80 MB


def test_unigram_ties_keep_the_longest_last_piece():
    u = unigram.Unigram([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abb", -3.0)])
    assert u.count_segment("ab") == 1 and u.count_segment("abb") == 1 and u.count_segment("aé") == 3


# --- exact dedup -------------------------------------------------------------------------------------------------------


def test_exact_dedup(spark, rows):
    plain = collections.defaultdict(list)
    for k, t, *_ in rows:
        plain["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), k is None, k))
    want = collections.Counter()
    for text, members in plain.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        for _, _, k in members:
            want[k, keep, len(members), k == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    frame = docs(spark, rows)
    got = collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in collected(exact_dedup.groups(frame)))
    assert got == want
    kept = exact_dedup.kept_rows(frame)
    stays = [min(m, key=lambda m: (m[0], m[1], m[2] or 0))[2] for m in plain.values()]
    assert kept.columns == frame.columns and sorted(str(r["doc_id"]) for r in collected(kept)) == sorted(map(str, stays))
    assert exact_dedup.groups(frame.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [3, 40])
def test_copies_are_neighbours_also_where_keys_repeat_and_groups_span_parts(spark, parts):
    """A third of the rows are one text, another third has one key; both spread, and no copy is found but by comparing."""
    rng = random.Random(5)
    texts = ["x" * 200 + str(k) for k in range(30)] + [None, "", " ", "\x0b", "x" * 200]
    made = [(k, "one  hot text") for k in range(600)] + [(7, rng.choice(["hot key", "hot  key", *texts])) for _ in range(600)] + [(rng.randrange(50), rng.choice(texts)) for _ in range(600)]
    made += [(0, "b"), (1, "a"), (1, "b"), (None, "none"), (None, "none")]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        ranged = exact_dedup._in_parts(frame, F.col("text"), F.col("doc_id"), [exact_dedup.normalised(F.col("text")).alias("plain")])
        runs = collected(exact_dedup._runs(ranged, F.col("plain"), ["plain"]))
        got = collected(exact_dedup.groups(frame))
        kept = collected(exact_dedup.kept_rows(frame))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len({(r["part"], r["run"]) for r in runs}) == len({(r["part"], r["plain"]) for r in runs})  # a run for each content of a part
    sizes = collections.Counter(r["part"] for r in runs)
    assert len(sizes) > 0.8 * parts and max(sizes.values()) < 2 * len(made) / parts + 20
    plain = collections.defaultdict(list)
    for k, t in made:
        plain["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), k is None, k))
    best = {t: min(m, key=lambda m: (m[0], m[1], m[2] or 0)) for t, m in plain.items()}
    want = collections.Counter((k, best[t][2], len(m), k == best[t][2]) for t, m in plain.items() for _, _, k in m)
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == want
    assert sorted((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted((a, b, c or 0) for a, b, c in best.values())


# --- near dedup --------------------------------------------------------------------------------------------------------


def near_components(rows):
    """Per row: (key, set size, component, kept), each row a document of its own."""
    sets = []
    for k, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for x, row in enumerate(rows):
        least[find(x)] = min(least.get(find(x), row[0] or 0), row[0] or 0)
    return [(row[0], len(sets[x]), None if row[0] is None else least[find(x)], row[0] is None or row[0] == least[find(x)]) for x, row in enumerate(rows)]


def near_result(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in collected(minhash.near_duplicates(frame))), key=str)


def test_near_dedup(spark, rows, monkeypatch):
    want = sorted(near_components(rows), key=str)
    assert len({c for _, _, c, _ in want}) < len(want) - 50
    assert near_result(docs(spark, rows)) == want
    for stars, block in ((0, minhash.BLOCK_SHINGLES), (0, 600), (4, 600)):  # also with clusters and heads of several blocks
        monkeypatch.setattr(minhash, "STARS", stars)
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
        assert near_result(docs(spark, rows)) == want


def test_near_dedup_of_chains_strays_and_shared_keys(spark):
    """Chains whose ends aren't similar, strays that share half a text with a group, and other texts under one key."""
    rng = random.Random(21)
    base = words(rng, 120).split()
    chain = []
    for k in range(40):
        chain.append(" ".join(base))
        for _ in range(2):
            base[rng.randrange(len(base))] = rng.choice(WORDS) + str(k)
    half = [chain[0].rsplit(" ", 70)[0] + " " + words(rng, 70) for _ in range(12)]
    made = [(k, t, "en", "a") for k, t in enumerate(chain + half)] + [(3, words(rng, 50), "en", "a"), (3, half[2], "en", "a"), (3, half[2] + " more", "en", "a"), (60, chain[39], "en", "a")]
    rng.shuffle(made)
    frame = docs(spark, made)
    want = near_components(made)
    assert near_result(frame) == sorted(want, key=str) and 1 < len({c for _, _, c, _ in want}) < 30
    kept = collected(minhash.kept_rows(frame))
    from collections import Counter

    stays = {}
    root = {}
    for (k, t, *_), (_, _, c, _) in zip(made, want):
        root.setdefault(t, c)
        stays.setdefault(c, k)
    assert len({r["text"] for r in kept}) == len(kept) and Counter(r["doc_id"] for r in kept).keys() <= set(stays)


def test_estimates_are_of_the_unions_least_values():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(400), rng.choice([3, 40, 64, 150, 300]))), np.uint64) for _ in range(30)]
    sketch, held = np.zeros((30, minhash.K), np.uint64), np.array([min(len(s), minhash.K) for s in sets])
    for k, s in enumerate(sets):
        sketch[k, : held[k]] = s[: minhash.K]
    a, b = (x.ravel() for x in np.meshgrid(range(30), range(30)))
    for got, i, j in zip(minhash.estimates(sketch, held, a, b), a, b):
        x, y = {*sets[i][: minhash.K].tolist()}, {*sets[j][: minhash.K].tolist()}
        least = sorted(x | y)[: minhash.K]
        assert abs(got - len([v for v in least if v in x and v in y]) / len(least)) < 1e-12


def test_near_dedup_of_nothing(spark):
    assert minhash.near_duplicates(docs(spark, []).limit(0)).count() == 0
    frame = docs(spark, ODD)
    assert minhash.kept_rows(frame).columns == frame.columns


def test_shingle_sets_of_long_texts(monkeypatch):
    import pyarrow as pa

    from silkweb.llm import common

    rng = random.Random(8)
    texts = [words(rng, 4000), "", None, "x" * 5000 + " " + words(rng, 30), words(rng, 2)]
    whole = list(minhash._sets(pa.array(texts)))
    monkeypatch.setattr(common, "STEP_BYTES", 64)
    assert all((a == b).all() for a, b in zip(whole, minhash._sets(pa.array(texts)))) and [len(s) for s in whole[1:3]] == [0, 0]


# --- mixing ------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / max(1e-9, sum(weight[s] for s in names if s not in full))
        more = {s for s in names if s not in full and weight[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def test_mix(spark, rows):
    size = lambda t: len((t or "").encode().split())
    frame = docs(spark, rows)
    got = collected(mixing.digest(frame))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(k), size(t)) for k, t, *_ in rows)
    totals = collections.Counter()
    for _, t, _, s in rows:
        totals[s] += size(t)
    want = plain_targets(totals)
    source = {k: s for k, _, _, s in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == totals[s] and abs(r["target"] - want[s]) < 1e-6 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 8 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, collected(mixing.digest(frame))))
    unique = frame.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    mixed = collected(mixing.mixed_rows(unique))
    words_of = collections.Counter()
    for r in mixed:
        words_of[r["doc_id"]] += size(r["text"])
    assert words_of == collections.Counter({r["doc_id"]: r["taken"] for r in collected(mixing.digest(unique)) if r["taken"]})
    assert mixing.digest(frame.limit(0)).count() == 0


def test_mix_of_rows_that_share_a_key(spark):
    """Rows of the mix hold the words that the plan takes, whatever their keys and column names."""
    rng = random.Random(4)
    made = [(k % 5, words(rng, rng.choice([3, 90, 700])), "ab"[k % 2], 1, 2, 3, 4) for k in range(40)] + [(7, "one text", "b", 1, 2, 3, 4)] * 3 + [(None, "one text", None, 1, 2, 3, 4)]
    frame = spark.createDataFrame(made, "doc_id long, text string, source string, _id int, row int, _first int, words int")
    mixed = mixing.mixed_rows(frame, block_words=64)
    size = lambda t: len(t.split())
    assert mixed.columns == frame.columns
    assert sum(size(r["text"]) for r in collected(mixed)) == sum(r["taken"] for r in collected(mixing.digest(frame, block_words=64)))
    per = collections.Counter()
    for r in collected(mixed):
        per[r["doc_id"]] += size(r["text"])
    assert per == collections.Counter({k: n for k, n in collections.Counter([r["doc_id"] for r in collected(mixing.digest(frame, block_words=64)) for _ in range(r["taken"])]).items()})


def test_schedule_keeps_sources_close_to_their_weights(spark):
    """Every stretch of the schedule holds a source's share of slots, as golden-ratio points fall evenly."""
    sources = spark.createDataFrame([(0, 5000, 5000, 5000.0), (1, 3000, 3000, 3000.0), (2, 2000, 2000, 2000.0)], "source_no long, blocks long, takes long, share double")
    got = collected(mixing.schedule(spark, sources))
    order = [r["source_no"] for r in sorted(got, key=lambda r: r["slot"])]
    assert collections.Counter(order) == {0: 5000, 1: 3000, 2: 2000}
    for k in range(0, 9000, 500):
        part = collections.Counter(order[k : k + 1000])
        assert all(abs(part[s] - w) <= 12 for s, w in ((0, 500), (1, 300), (2, 200)))
    for s in range(3):
        blocks = [r["block"] for r in sorted(got, key=lambda r: r["slot"]) if r["source_no"] == s]
        assert blocks == list(range(len(blocks)))


def test_mix_meets_targets_with_blocks_above_the_sources_sizes(spark):
    rng, sizes = random.Random(12), {"a": 60_000, "b": 1100, "c": 100, "d": 7, "e": 40_001}
    made, left = [], dict(sizes)
    while any(left.values()):
        s = rng.choice([s for s, n in left.items() if n])
        n = min(left[s], rng.choice([1, 7, 90, 2500]))
        left[s] -= n
        made.append((len(made), words(rng, n), "en", s))
    frame, want, source = docs(spark, made), plain_targets(sizes), {k: s for k, _, _, s in made}
    for block in (1024, 100_000):
        got, taken = collected(mixing.digest(frame, block_words=block)), collections.Counter()
        for r in got:
            taken[source[r["doc_id"]]] += r["taken"]
        assert len(got) == len(made) and all(r["taken"] <= 3 * r["size"] for r in got)
        assert all(abs(taken[s] - want[s]) <= 1 for s in want), (block, taken, want)


# --- vectors -----------------------------------------------------------------------------------------------------------


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((30, 16))
    x = np.concatenate([centre, centre[:10].repeat(20, 0) + 0.12 * rng.standard_normal((200, 16)), centre[:3].repeat(4, 0), centre[:2] * 5])
    table = [(k, [float(v) for v in row], k) for k, row in enumerate(x)]
    n = len(table)
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [1.0, None] + [0.0] * 14), (n + 4, [float("nan")] * 16), (n + 5, [float("inf")] * 16), (None, [1.0] * 16), (n + 6, [1.0, 0.0])]
    frame = spark.createDataFrame(table + [(k, v, 0) for k, v in odd], "vec_id bigint, embedding array<double>, id int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.9) & ~np.eye(n, dtype=bool)
    found = {}
    for block in (vectors.BLOCK_BYTES, 16 * 16 * 8):
        monkeypatch.setattr(vectors, "BLOCK_BYTES", block)
        got = {r["vec_id"]: r for r in collected(vectors.near_duplicates(frame))}
        assert len(got) == n + len(odd)
        found[block] = [got[k]["n_links"] for k in range(n)]
        assert all(f <= w for f, w in zip(found[block], linked.sum(1))) and sum(found[block]) >= 0.9 * linked.sum()
        for k, _ in odd:
            assert got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"]
        assert all(got[k]["kept"] == (got[k]["component_id"] == k) for k in range(n))
        assert all(got[n - 14 + k]["component_id"] == k // 4 for k in range(12))  # equal vectors are always linked
    assert len({tuple(f) for f in found.values()}) == 1
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_that_share_a_key(spark):
    """Each row keeps the links of its own vector."""
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    near = [0.05, 1.0, 0.0, 0.0]
    frame = spark.createDataFrame([(1, a), (1, b), (3, near), (4, [0.0, 0.0, 1.0, 0.0]), (4, [0.0, 0.0, 2.0, 0.0]), (0, [0.0, 0.0, 0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in collected(vectors.near_duplicates(frame)))
    assert got == [(0, 0, 0, True), (1, 0, 1, True), (1, 1, 1, True), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]


def test_recall_of_vectors_by_band(spark):
    """Planted pairs just above the least cosine, against brute force."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((2000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9005, 0.96, (2000, 1))
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])
    frame = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in collected(vectors.near_duplicates(frame))}
    for low, high in ((0.9, 0.92), (0.92, 0.97)):
        band = [k for k in range(2000) if low <= cosine[k, 0] < high]
        assert sum(got[k] for k in band) >= 0.9 * len(band)


# --- URL filter --------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://A.net/x", "https://example.net/en/1", "https://m.example.net/en/", "https://example.net/de", "https://example.com/de/1", "https://badexample.com/de/", "https://a.org/fr/2", "http://org", "nothing", None, "", "x://h?q://y", "http://h.com/p#f"]
    frame = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)], "page_id bigint, url string, rule string")
    got = {r["page_id"]: r for r in collected(urlfilter.judge(frame, URL_RULES))}
    assert [got[k]["rule"] for k in range(len(urls))] == ["net/", "example.net/en/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, None, None, None, None, None]
    assert [got[k]["host"] for k in (0, 7, 8, 9, 11, 12)] == ["a.net", "org", "", "", "h", "h.com"] and [got[k]["path"] for k in (0, 7, 11, 12)] == ["/x", "", "", "/p"]
    assert all(got[k]["verdict"] == {"net/": "block", "example.com/de/": "block"}.get(got[k]["rule"], "allow") for k in range(7) if got[k]["rule"])
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"} and urlfilter.judge(frame.limit(0), URL_RULES).count() == 0


def url_parts(spark, urls):
    made = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string").orderBy("k").select(*urlfilter.parts_of(F.col("u"))).toArrow()
    return {p: made.column(p).combine_chunks() for p in urlfilter.PARTS}


def test_url_features_against_plain_strings(spark):
    urls = [None, "", "nothing", "https://A.b-c.Example.COM/x1/yyy22//z?a=1&b=2#f", "http://h.com", "x://h?q://y", "https://é.fr/ü/9?x", "http://h.com//deep/", "HTTPS://h.com/?#"]
    rates = urlfilter.Rates(*(urlfilter.Statistic(["Example.com", "example.com", "deep"], np.ones((3, 5)), 2 * np.ones((3, 5)), 0.25) for _ in range(2)))
    got = urlfilter.features(url_parts(spark, urls), rates)

    def entropy(b):
        return -sum(n / len(b) * math.log2(n / len(b)) for n in collections.Counter(b).values())

    for u, row in zip(urls, got):
        text = u or ""
        rest = text.split("://", 1)[-1]
        host = __import__("re").split("[/?#]", rest)[0]
        path = __import__("re").split("[?#]", rest[len(host) :])[0]
        query = rest[len(host) + len(path) :].split("#")[0][1:]
        b = text.encode()
        want = [len(b), len(host.encode()), len(path.encode()), path.count("/"), host.count(".") + 1, sum(48 <= c <= 57 for c in b) / max(1, len(b)), sum(c.isdigit() for c in host), host.count("-"), entropy(b), entropy(host.encode()), query.count("=") + query.count("&"), len(query), sum(65 <= c <= 90 for c in b), max(map(len, path.encode().split(b"/"))), "#" in text, text[:8].lower() == "https://"]
        assert np.allclose(row[: len(want)], want), (u, row, want)
    suffix = urlfilter.FEATURES.index("suffix_rate")
    assert np.allclose(got[3, suffix : suffix + 2], [(5 + 1) / 14, np.log1p(10)]) and got[4, suffix] == 0.25 and np.isclose(got[7, -1], 6 / 14)


def test_url_statistics_of_a_row_in_training_leave_its_fold_out():
    import pyarrow as pa

    s = urlfilter.Statistic(["a"], np.array([[3.0, 0, 0, 0, 0]]), np.array([[3.0, 1, 0, 0, 0]]), 0.5)
    assert s.of(pa.array(["a", "a", "b"]), np.array([0, 1, 0]))[0].tolist() == [2 / 5, 5 / 7, 0.5]


def test_url_trees_on_held_out_urls(spark):
    rng = random.Random(6)
    good = [f"https://{rng.choice(WORDS)}.example.com/{rng.choice(WORDS)}/{rng.choice(WORDS)}" for _ in range(400)]
    bad = [f"http://{rng.choice(WORDS)}-{rng.randrange(10**6)}.example.com/{rng.randrange(10**8)}?a={rng.randrange(99)}&b={rng.randrange(99)}" for _ in range(400)]
    labelled = spark.createDataFrame([(u, int(k >= 400)) for k, u in enumerate(good + bad) if k % 4], "url string, blocked int")
    model = urlfilter.train(labelled)
    held = [(u, k >= 400) for k, u in enumerate(good + bad) if not k % 4]
    assert (model.blocks(url_parts(spark, [u for u, _ in held])) == [y for _, y in held]).mean() > 0.95
    assert urlfilter.train(labelled, sample=50).blocks(url_parts(spark, [None, ""])).shape == (2,)


def test_url_trees_learn_beside_a_hot_url(spark):
    rng = random.Random(13)
    good = [f"https://{rng.choice(WORDS[:9])}.example.com/{rng.choice(WORDS)}/{rng.choice(WORDS)}" for _ in range(300)]
    bad = [f"http://{rng.choice(WORDS[:9])}-{rng.randrange(10**6)}.shop.test/{rng.randrange(10**8)}?a={rng.randrange(99)}" for _ in range(300)]
    hot = [f"https://hot{k}.example.com/" for k in range(40)]
    labelled = spark.createDataFrame([*((u, 0) for u in good), *((u, 1) for u in bad), *((u, 0) for u in hot for _ in range(500))], "url string, blocked int")
    model = urlfilter.train(labelled, sample=200)
    held = [(u.replace("a", "e"), y) for y, group in ((False, good), (True, bad)) for u in group]
    assert (model.blocks(url_parts(spark, [u for u, _ in held])) == [y for _, y in held]).mean() > 0.95
    assert dict(zip(model.rates.suffix.keys, model.rates.suffix.n.sum(1))) == {"example.com": 300 + 40 * 500, "shop.test": 300}


# --- language model ----------------------------------------------------------------------------------------------------


def test_lm_scores(spark, rows, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", 60)  # so that rare words take the way through the shards
    got = collected(maxent.scores(docs(spark, rows)))
    held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), "END"]
    c = collections.Counter(w for k, t, *_ in rows if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for k, t, *_ in rows:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want[k, held(k), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base, 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert maxent.scores(docs(spark, ODD).limit(0)).count() == 0


def plain_scores(rows):
    """log10 probability of every text, from dictionaries: a softmax over groups and one over a group's classes, trained
    token by token, and in each class weights of pairs, trained word by word. Only hashes are shared with the module."""
    from silkweb.llm.common import mix, word_hashes

    held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    codes = {None: maxent.END, 0: maxent.START}
    code = lambda w: codes[w] if w in codes else codes.setdefault(w, word_hashes(np.frombuffer(w, np.uint8))[0][0])
    train = [tokens(t) for k, t, *_ in rows if not held(k)]
    c = collections.Counter(w for words_ in train for w in words_)
    size = lambda w: math.floor(math.log2(c[w]) * 16)
    least, frequent = math.inf, []
    for k in sorted({size(w) for w in c if c[w] >= maxent.SEEN}, reverse=True):
        some = [w for w in c if size(w) == k]
        if len(frequent) + len(some) > maxent.FREQUENT:
            break
        frequent, least = frequent + some, k
    g = min(max(2 ** round(math.log2(max(len(c), 1)) / 4), maxent.LEAST_GROUPS), maxent.MOST_GROUPS)
    bins, rare = int(g * g * maxent.SINGLES), int(g * g * (maxent.SINGLES + maxent.BINS))
    ranked = sorted(frequent, key=lambda w: (-c[w], int(code(w).view(np.int64))))[:bins]
    single = {w: k for k, w in enumerate(sorted(ranked, key=lambda w: int(code(w))))}

    @functools.cache
    def class_(w):
        tail = 0 if w is None else (w[-1] + 1) * 256 + (w[-2] + 1 if len(w) > 1 else 0)
        h = int(mix(np.array([tail], np.uint64) + maxent._C)[0])
        lo, hi = (bins, rare) if w in often else (rare, g * g)
        return single.get(w, lo + h % (hi - lo))

    often = set(frequent)
    mass, types = np.zeros(g * g), collections.Counter(class_(w) for w in c)
    for w in c:
        mass[class_(w)] += c[w]
    mass[rare:] += 0.5
    share = lambda w: 1.0 if w in single else c[w] / mass[class_(w)] if w in often else 1 / (types[class_(w)] + 1)
    features = 1 << min(max(len(c) // 4, maxent.LEAST_ROWS).bit_length(), int(maxent.MOST_CELLS // (g + g * g)).bit_length() - 1)

    @functools.cache
    def feature(v, u):
        one, two = maxent._features((np.array([code(v)]), np.array([code(u)])), features)
        return int(one[0]), int(two[0])

    prior = np.maximum(mass / mass.sum(), 1e-9).reshape(g, g)
    over, within = np.zeros((features, g)), np.zeros((features, g, g))

    def softmax(z):
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    def p_of(rows_, group):
        first = softmax(np.log(prior.sum(1) / prior.sum()) + sum(over[r] for r in rows_))
        return first, softmax(np.log(prior[group] / prior[group].sum()) + sum(within[r, group] for r in rows_))

    events = collections.Counter((feature(v, u), class_(w)) for words_ in train for u, v, w in zip([0, 0, *words_], [0, *words_], words_))
    for _ in range(maxent.ROUNDS):
        seen, due = [np.zeros_like(over), np.zeros_like(within)], [np.zeros_like(over), np.zeros_like(within)]
        for (rows_, k), n in events.items():
            group, own = divmod(k, g)
            first, second = p_of(rows_, group)
            for r in rows_:
                seen[0][r, group] += n
                seen[1][r, group, own] += n
                due[0][r] += n * first
                due[1][r, group] += n * second
        for w_, o, e in zip((over, within), seen, due):
            w_ += maxent.RATE * (o - e - maxent.DAMPING * w_) / ((o + e) / 2 + maxent.DAMPING)

    pairs = collections.defaultdict(collections.Counter)
    for words_ in train:
        for v, w in zip([0, *words_], words_):
            if w not in single:
                pairs[v, class_(w)][w] += 1
    weight, log_z = {}, {}
    for at, followers in pairs.items():
        n, q = np.array(list(followers.values()), float), np.array([share(w) for w in followers])
        theta, z = np.zeros(len(n)), 1.0
        for _ in range(maxent.PAIR_ROUNDS):
            due = n.sum() * q * np.exp(theta) / z
            theta += (n - due - maxent.PAIR_DAMPING * theta) / ((n + due) / 2 + maxent.PAIR_DAMPING)
            z = max(1 + (q * (np.exp(theta) - 1)).sum(), 1e-12)
        weight[at], log_z[at] = dict(zip(followers, theta)), math.log(z)

    def score(words_):
        total = 0.0
        for u, v, w in zip([0, 0, *words_], [0, *words_], words_):
            group, own = divmod(class_(w), g)
            first, second = p_of(feature(v, u), group)
            total += math.log(first[group]) + math.log(second[own]) + math.log(share(w))
            if w not in single:
                total += weight.get((v, class_(w)), {}).get(w, 0.0) - log_z.get((v, class_(w)), 0.0)
        return total / math.log(10)

    return [score(tokens(t)) for _, t, *_ in rows]


def test_lm_scores_against_dictionaries(spark, rows, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", 60)
    want = sorted((str(k), round(x, 3)) for (k, *_), x in zip(rows, plain_scores(rows)))
    for size in (1 << 24, 3000):  # in one batch a task, and in many
        monkeypatch.setattr(maxent, "BATCH_BYTES", size)
        got = sorted((str(r["doc_id"]), round(r["score"], 3)) for r in collected(maxent.scores(docs(spark, rows).repartition(5))))
        assert [k for k, _ in got] == [k for k, _ in want] and all(abs(a - b) <= 2e-3 + 1e-5 * abs(b) for (_, a), (_, b) in zip(got, want))


def test_lm_learns_context(spark):
    rng = random.Random(9)
    text = lambda own: " ".join(w for _ in range(60) for w in (rng.choice(own), rng.choice(own)))
    frame = docs(spark, [(k, text(["le", "la", "un", "des"] if k % 2 else ["the", "of", "a", "in"]), "en", "a") for k in range(300)])
    got = [r for r in collected(maxent.scores(frame)) if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got)


def test_lm_tells_texts_that_occur_twice(spark):
    """Copies in training and left out: their words follow each other as they did before."""
    rng = random.Random(14)
    texts = [words(rng, 60) for _ in range(200)]
    made = [(k, t, "en", "a") for k, t in enumerate(texts)] + [(1000 + k, t, "en", "a") for k, t in enumerate(texts[:60])]
    got = {r["doc_id"]: r["score"] / r["n_tokens"] for r in collected(maxent.scores(docs(spark, made))) if r["held_out"]}
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    twice = [got[k] for k in got if (k >= 1000 and not held(k - 1000)) or (k < 60 and not held(k + 1000))]
    once = [got[k] for k in got if 60 <= k < 1000]
    assert len(twice) > 10 and min(twice) > max(once)


def test_lm_reads_training_words_four_times(spark, monkeypatch):
    """For counts, for events, for pairs together with what is asked, and for scores; those left out for the last two."""
    rng = random.Random(6)
    made = [(k, words(rng, 30), "en", "a") for k in range(100)]
    seen, plain = spark.sparkContext.accumulator(0), maxent._token_runs

    def counted(column):
        for run in plain(column):
            seen.add(len(run[1]))
            yield run

    monkeypatch.setattr(maxent, "_token_runs", counted)
    got = collected(maxent.scores(docs(spark, made)))
    assert seen.value == sum(r["n_tokens"] * (2 if r["held_out"] else 4) for r in got)


def test_lm_finds_hashes():
    rng = np.random.default_rng(3)
    for keys in (np.empty(0, np.uint64), np.sort(rng.integers(0, 2**64, 5000, np.uint64)), np.arange(50, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)):
        at = maxent.Hashes(keys).find(np.concatenate((keys, keys + np.uint64(1), np.array([0, 2**64 - 1], np.uint64))))
        places = {int(k): i for i, k in enumerate(keys)}
        assert at.tolist() == [places.get(int(w), -1) for w in np.concatenate((keys, keys + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)))]


def test_lm_probabilities_add_up():
    rng = np.random.default_rng(0)
    softmax = maxent.Softmax(rng.uniform(1, 9, 64), 8, 4)
    softmax.weights = rng.normal(size=softmax.weights.shape).astype(np.float32)
    features = np.tile(np.array([[1], [3]]), (1, 64))
    assert np.allclose(np.exp(softmax.log_p(features, np.arange(64))).sum(), 1)


def test_lm_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    softmax = maxent.Softmax(rng.uniform(1, 9, 16), 4, 8)
    softmax.weights = rng.normal(size=softmax.weights.shape)
    features, target, n = rng.integers(0, 8, (2, 50)), rng.integers(0, 16, 50), rng.integers(1, 5, 50)
    seen, expected = np.zeros(softmax.weights.shape), np.zeros(softmax.weights.shape)
    softmax.meet(seen, features, target, n)
    softmax.expect(expected, features, target, n)
    for _ in range(30):
        at = tuple(rng.integers(0, x) for x in softmax.weights.shape)
        moved = []
        for step in (1e-3, -2e-3):
            softmax.weights[at] += step
            moved.append((n * softmax.log_p(features, target)).sum())
        softmax.weights[at] += 1e-3
        assert abs((moved[0] - moved[1]) / 2e-3 - (seen - expected)[at]) < 1e-2


def test_lm_likelihood_rises_round_by_round(spark):
    rng = random.Random(21)
    frame = docs(spark, [(k, " ".join(rng.choice(WORDS[k % 3 :: 3]) for _ in range(80)), "en", "a") for k in range(200)])
    counted = maxent.word_counts(frame.select("text"))
    classes, softmax = maxent._model(counted, counted.count())
    gained = maxent.trained(frame.select("text"), classes, softmax, rounds=5)
    assert len(gained) == 5 and all(a < b for a, b in zip(gained, gained[1:])) and gained[-1] < 0


def test_lm_pair_weights_settle_and_add_up():
    rng = np.random.default_rng(2)
    group = np.repeat(np.arange(40), rng.integers(1, 9, 40)).astype(np.uint64)
    n, q = rng.integers(1, 50, len(group)), rng.uniform(0.001, 0.1, len(group))
    weights, first, log_z = maxent.pair_weights(group, n, q)
    own = np.searchsorted(group[first], group)
    p = q * np.exp(weights) / np.exp(log_z)[own]
    rest = (1 - np.add.reduceat(q, first)) / np.exp(log_z)
    assert np.allclose(np.add.reduceat(p, first) + rest, 1)
    gradient = n - np.add.reduceat(n, first)[own] * p - maxent.PAIR_DAMPING * weights
    assert np.abs(gradient / n).max() < 0.1



# --- quality -----------------------------------------------------------------------------------------------------------


def plain_kneser_ney(texts):
    """Probability of a symbol after the four before it, from dictionaries."""
    levels = [collections.Counter()]
    for t in texts:
        s = bytes(quality.ORDER - 1) + t
        levels[0].update(s[k : k + quality.ORDER] for k in range(len(s) - quality.ORDER + 1))
    while len(next(iter(levels[-1]))) > 1:
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    off = [quality.discounts(*(sum(c == k for c in level.values()) for k in (1, 2, 3, 4))) for level in levels]

    def p(gram):
        if not gram:
            return 1 / 256
        at = quality.ORDER - len(gram)
        after = [c for g, c in levels[at].items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        c = levels[at][gram]
        return (c - off[at][min(c, 3)] + sum(off[at][min(x, 3)] for x in after) * p(gram[1:])) / sum(after)

    return p


def test_kneser_ney_against_dictionaries(spark, monkeypatch):
    """Scores of all texts, of a language with its own model and of others, in batches and shards of any size."""
    rng = random.Random(6)
    made = [(k, rng.choice([words(rng, 12), "日本 語の 文", "Тот Тот же", "a"]), "en" if k % 3 else "ja") for k in range(40)] + [(40, "&&& | zq", "en"), (41, None, "en"), (42, "", None), (43, words(rng, 8), None)]
    frame = spark.createDataFrame(made, "id long, text string, lang string").repartition(3)
    monkeypatch.setattr(quality, "LEAST_DOCS", 20)
    model, counts = quality.train(frame.where("id < 30"))
    assert model.languages == {"en": 1}

    def symbols(t):
        out, before = bytearray(t.encode()), None
        for m in __import__("re").finditer(rb"[^\x20\x09-\x0d]+", t.encode()):
            if m[0].lower() == before:
                out[m.start() - 1] = quality.REPEAT
            before = m[0].lower()
        return bytes(out)

    own = plain_kneser_ney([symbols(t) for k, t, lang in made if k < 30 and lang == "en"])
    every = plain_kneser_ney([symbols(t) for k, t, _ in made if k < 30])
    assert abs(sum(own(b"\0ka" + b"n" + bytes([x])) for x in range(256)) - 1) < 1e-9
    for size in (1 << 25, 100):
        monkeypatch.setattr(quality, "BATCH_BYTES", size)
        got = {r["id"]: r for r in collected(quality.surprise(frame, model, counts))}
        for k, t, lang in made:
            s = bytes(quality.ORDER - 1) + symbols(t or "")
            want = -sum(math.log((own if lang == "en" else every)(s[i : i + quality.ORDER])) for i in range(len(s) - quality.ORDER + 1))
            assert abs(got[k]["nats"] - want) < 1e-5 * max(1, want) and got[k]["symbols"] == len((t or "").encode()) and got[k]["text"] == t


def test_quality(spark):
    rng = random.Random(1)
    clean = [(k, words(rng, 80), "en" if k % 2 else None, "a") for k in range(120)]
    junk = [(500 + k, " ".join(w.upper() + "!!&&" for w in words(rng, 80).split()), "en", "a") for k in range(20)]
    frame = docs(spark, clean + junk + ODD)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(500, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    got = collected(quality.judged(frame, labels))
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert len(got) == len(clean) + len(junk) + len(ODD)
    assert all(kept[k] for k, *_ in clean) and not any(kept[k] for k, *_ in junk) and kept[9001] and kept[9002]
    assert collections.Counter(str(r["doc_id"]) for r in collected(quality.kept_rows(frame, labels))) == collections.Counter(str(r["doc_id"]) for r in got if r["kept"])
    assert all(r["kept"] for r in collected(quality.judged(frame, labels.limit(0)))) and quality.judged(frame.limit(0), labels).count() == 0


def test_quality_finds_repeated_words(spark):
    rng = random.Random(2)
    clean = [(k, words(rng, 80), "en", "a") for k in range(120)]
    repeated = [(500 + k, " ".join(w for w in rng.choices(WORDS, k=8) for _ in range(10)), "en", "a") for k in range(20)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in collected(quality.judged(docs(spark, clean + repeated), labels))}
    assert all(kept[k] for k, *_ in clean) and not any(kept[k] for k, *_ in repeated)


def test_quality_gives_every_language_its_threshold(spark, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_QUANTILE", 1)
    rng = random.Random(4)
    made = [(k, words(rng, 20 + k % 30), f"l{k % 1050}", "a") for k in range(4200)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(4200)], "doc_id bigint, quality int, toxic int")
    got = collected(quality.judged(docs(spark, made), labels))
    assert len(got) == 4200 and len({(r["lang"], r["threshold"]) for r in got}) > 1050 and sum(not r["kept"] for r in got) < 20


def test_quality_of_labels_left_out(spark):
    """Learned from half of the labels, judged by the other half."""
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = "crc32(cast(doc_id as string)) % 2 = {}"
    got = quality.judged(docs_, labels.where(half.format(0))).join(labels.where(half.format(1)), "doc_id")
    rows = collected(got.groupBy("quality").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("kept")))
    share = {r["quality"]: r["kept"] / r["n"] for r in rows}
    assert share[0] < 0.1 and share[1] > 0.98


def test_quality_symbols_of_repeated_words(monkeypatch):
    from silkweb.llm import common

    text = "Der der\nder die  die. die " + "x" * 40 + " " + "x" * 40 + " no"
    data = np.frombuffer(text.encode(), np.uint8)
    grams = lambda: np.concatenate([g for _, g in quality.text_grams(data, np.array([0, len(data)]), np.zeros(1, np.int64))])
    whole = grams()
    repeats = np.flatnonzero(whole % quality.SYMBOLS == quality.REPEAT)
    assert list(repeats) == [3, 7, text.index("x x") + 1] and len(whole) == len(data)
    for step in (4, 9, 30):
        monkeypatch.setattr(common, "STEP_BYTES", step)
        assert (grams() == whole).all()


# --- sharding ----------------------------------------------------------------------------------------------------------


def test_shards(spark, rows, tmp_path):
    frame = docs(spark, rows)
    got = collected(sharding.digest(frame))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(str, got)) == sorted(map(str, collected(sharding.digest(frame.repartition(7)))))
    assert sharding.digest(frame.limit(0)).count() == 0
    sharding.write_shards(frame.withColumn("file", F.lit("f")).withColumn("size", F.lit("s")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows)


def test_shard_digest_is_of_the_texts_that_were_shuffled(spark, rows, monkeypatch):
    whole, columns = sharding.shuffled, []

    def marked(df, *args, **options):
        columns.extend(df.columns)
        return whole(df, *args, **options).withColumn("c1", F.concat("c1", F.lit("!")))

    monkeypatch.setattr(sharding, "shuffled", marked)
    got = collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in collected(sharding.digest(docs(spark, rows))))
    marks = lambda t: b"" if t is None else t.encode() + b"!"
    assert len(columns) == len(docs(spark, []).columns) + 1
    assert got == collections.Counter((k, len(marks(t)) + 1, zlib.crc32(marks(t))) for k, t, *_ in rows)


def test_shards_spread_rows_of_one_key_and_equal_rows(spark):
    """A third of the rows share a key, another third are the same row: no bucket takes much more than its share."""
    made = [(7, f"text {k}") for k in range(1000)] + [(8, "the same")] * 1000 + [(100 + k, f"other {k}") for k in range(1000)]
    frame = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    placed = sharding.shuffled(frame.withColumn("size", F.lit(100)), bucket_bytes=10_000)
    assert sorted((r["slot"], r["shard"]) for r in collected(placed)) == [divmod(k, 8) for k in range(3000)]
    assert collections.Counter((r["doc_id"], r["text"]) for r in collected(placed)) == collections.Counter(made)
    # In the order of the result, equal rows and rows of one key lie everywhere.
    order = [r["doc_id"] for r in sorted(collected(placed), key=lambda r: (r["slot"], r["shard"]))]
    for k in (7, 8):
        share = [order[i : i + 300].count(k) for i in range(0, 3000, 300)]
        assert min(share) > 50 and max(share) < 170


def test_shards_of_many_buckets(spark, rows):
    frame = docs(spark, rows).drop("slot").withColumn("size", F.octet_length("text"))
    placed = sharding.shuffled(frame, bucket_bytes=2000)
    assert collections.Counter((r["doc_id"], r["text"]) for r in collected(placed)) == collections.Counter((k, t) for k, t, *_ in rows)
    assert sorted((r["slot"], r["shard"]) for r in collected(placed)) == [divmod(k, 8) for k in range(len(rows))]
