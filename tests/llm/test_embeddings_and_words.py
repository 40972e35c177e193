"""Hard negatives, whitening and word-level BPE against plain computations."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from silkweb.llm import hard_negatives, whitening, word_bpe
from silkweb.llm.queries import WORD_PAIRS

# --- hard negatives ----------------------------------------------------------------------------------------------------

ROWS = "vec_id bigint, embedding array<float>, label int, id bigint, x string, rank int"


def frame(spark, rows):
    """Embeddings with columns that share names with the operators' own."""
    return spark.createDataFrame([(k, v, label, 7, "x", 1) for k, v, label in rows], ROWS)


def usable(vector, size):
    return vector and len(vector) == size and all(c is not None and math.isfinite(c) for c in vector)


def plain_negatives(rows, size):
    """All pairs, as the contract says it."""
    whole = {(k, (label + 1) % 10 if k % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for k, v, label in rows if k is not None and label is not None and usable(v, size)}
    out = []
    for anchor in whole:
        if anchor[0] % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(anchor[2], r[2])), r[0], r[1]) for r in whole if r != anchor)
        for s, k, _ in [r for r in scored if r[2] == anchor[1]][:5]:
            fits = [r for r in scored if r[2] != anchor[1] and 50 * -s <= 100 * -r[0] <= 95 * -s]
            out += [(anchor[0], k, place + 1, r[1], -s, -r[0]) for place, r in enumerate(fits[:3])]
    return sorted(out)


def odd_vectors(seed, n, size=6):
    rng = random.Random(seed)
    hot, rows = [rng.gauss(0, 0.3) for _ in range(size)], []
    for k in range(n):
        v = hot if k % 3 == 0 else [c + rng.gauss(0, 0.01) for c in hot] if k % 3 == 1 and k % 2 else [rng.gauss(0, 0.3) for _ in range(size)]
        rows.append((k, v, rng.choice([0, 1, 1, 2])))
    rows += [(50, None, 1), (100, [None] * size, 1), (100, [float("nan")] * size, 1), (150, [float("inf")] + [0.1] * (size - 1), 1), (200, [], 1), (200, [0.1] * (size + 1), 1), (250, [0.2] * size, None), (None, [0.2] * size, 1)]
    rows += [(50, [0.5] * size, 1), (50, [0.5] * size, 1), (50, hot, 2), (100, [0.0] * size, 2), (3, [1e6] * size, 1), (-50, hot, 1)]
    return rows


@pytest.mark.parametrize("seed, n, size", [(1, 260, 6), (2, 90, 5)])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, seed, n, size):
    monkeypatch.setattr(hard_negatives, "FEWEST", 4)
    monkeypatch.setattr(hard_negatives, "STEP", 16)
    monkeypatch.setattr(hard_negatives, "TABLES", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 8 * size * 5)  # blocks of five anchors
    rows = odd_vectors(seed, n, size)
    found = hard_negatives.mined(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in found) == plain_negatives([r for r in rows if r[0] != 3 or r[1][0] < 1e5], size)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mined(frame(spark, [])).collect() == []
    assert hard_negatives.mined(frame(spark, [(50, [1.0], 1), (51, None, 1)])).collect() == []


@pytest.mark.parametrize("largest", [60, 1 << 15, 1 << 24])
def test_bounds_hold_for_every_size_of_number(largest):
    draw = np.random.default_rng(largest)
    x, anchors = draw.integers(-largest, largest, (300, 7)), draw.integers(-largest, largest, (20, 7))
    books = hard_negatives.trained(x[:40])
    codes, rest = hard_negatives.coded(x, books)
    score, wide = hard_negatives.Tables(anchors, books).bounds(codes, rest)
    assert (np.abs((x @ anchors.T) - score.astype(float)) <= wide).all()
    assert (rest < np.sqrt((x.astype(float) ** 2).sum(axis=1)).max()).all()


# --- whitening ---------------------------------------------------------------------------------------------------------


def plain_whitening(vectors, components=4):
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ axes / np.sqrt(values), values / (centred**2).sum() * n


def test_whitening_against_plain_eigenvectors(spark):
    draw = np.random.default_rng(4)
    vectors = [[float(c) for c in v] for v in draw.normal(0, [0.9, 0.6, 0.5, 0.3, 0.2, 0.1], (200, 6))]
    rows = [(k, v, None) for k, v in enumerate(vectors)] + [(1000 + k, vectors[3], 1) for k in range(90)] + [(None, vectors[5], 2)]
    odd = [(2000, None, 1), (2001, [], 1), (2002, [None] * 6, 1), (2003, [float("nan")] * 6, 1), (2004, [float("-inf")] + [0.0] * 5, 1), (2005, [0.1] * 5, 1), (2006, [1e9] * 6, 1)]
    n, deviation, white, explained = plain_whitening([v for _, v, _ in rows])
    out = whitening.whitened(frame(spark, rows + odd)).collect()
    assert len(out) == 4 * len(rows) and {r["n"] for r in out} == {n} and n == 200
    assert max(r["identity_error"] for r in out) == min(r["identity_error"] for r in out) < 1e-9
    signs = None
    for k, row in enumerate(rows[:290]):
        mine = sorted((r for r in out if r["vec_id"] == row[0]), key=lambda r: r["component"])
        assert [r["component"] for r in mine] == [1, 2, 3, 4] and {r["deviation"] for r in mine} == {deviation[k]}
        got = np.array([r["whitened"] for r in mine])
        signs = np.sign(got * white[0]) if signs is None else signs
        assert np.allclose(got * signs, white[k], rtol=1e-9, atol=1e-9)
        assert np.allclose([r["explained"] for r in mine], explained, rtol=1e-9)
    assert sum(r["vec_id"] is None for r in out) == 4


def test_whitening_of_few_vectors(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)])).collect() == []  # no variance
    two = whitening.whitened(frame(spark, [(1, [0.5, 0.5], 1), (2, [0.5, 0.25], 1), (3, [0.5, 0.25], 1)])).collect()
    assert {(r["vec_id"], r["component"], abs(round(r["whitened"], 12)), round(r["explained"], 12)) for r in two} == {(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 1, 1.0, 1.0)}


def test_deviations_beyond_64_bits_are_exact():
    x, sums = np.array([[1 << 23, -5], [3, 4]]), np.array([1 << 50, -(1 << 40)])
    n = 1 << 35
    assert list(whitening._deviations(x, n, sums)) == [(n * a - (1 << 50)) ** 2 + (n * b + (1 << 40)) ** 2 for a, b in x.tolist()]


# --- word-level BPE ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_PAIRS)


def ids_of(text):
    return list(memoryview(word_bpe.load(WORD_PAIRS).encode(text)).cast("I"))


WORDS = ["a", "aaa", "the", "There", " ", "  ", "\n", "'s", "'LL", "1", "12", "\u00e9", "e\u0301", "\u03a3", "\u03c3\u03c2\u03a3", ".", "...", "\x85", "\x1c", "\u3000", "\u0130", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "\u4f60\u597d", "\U0001f600", "\u200b", "ing", "\ue000", "\u1c89"]


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=40) | st.lists(st.sampled_from(WORDS), max_size=25).map("".join) | st.text("abet", max_size=60))
def test_words_get_the_librarys_ids_and_text(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(text) == want
    assert word_bpe.load(WORD_PAIRS).decode(word_bpe.load(WORD_PAIRS).encode(text)) == library.decode(want, skip_special_tokens=False)


def test_long_words(library):
    rng = random.Random(2)
    for alphabet in ("a", "abc", "theinger"):
        for n in (4094, 4095, 4096, 20_000):
            word = "".join(rng.choices(alphabet, k=n))
            assert ids_of(word) == library.encode(word, add_special_tokens=False).ids
    assert len(ids_of("a" * 2_000_000)) > 100_000  # a ring of states, four bytes a place


def test_automaton_accepts_what_merging_gives():
    """A vocabulary of merges that repeat and overlap, on all words of two letters up to a length."""
    rng = random.Random(8)
    for _ in range(12):
        tokens = ["a", "b"]
        merges = []
        while len(merges) < 7:
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and len(u + v) < 9:
                merges.append((tokens.index(u), tokens.index(v), len(tokens)))
                tokens.append(u + v)
        made = word_bpe.Automaton(len(tokens), [0, 1], np.zeros(len(tokens), bool), merges)
        reads = lambda s, t: made.arcs[made.kind[t]][s >> 3] >> (s & 7) & 1  # noqa: B023, E731
        for size in range(1, 10):
            for bits in range(1 << size):
                word = "".join("ab"[bits >> k & 1] for k in range(size))
                seq = [0 if c == "a" else 1 for c in word]
                for u, v, w in merges:
                    k = 0
                    while k + 1 < len(seq):
                        if (seq[k], seq[k + 1]) == (u, v):
                            seq[k : k + 2] = [w]
                        k += 1
                paths = [(0, 0, ())]
                for _ in range(size):
                    paths = [(at + len(tokens[t]), made.after[t], (*p, t)) for at, s, p in paths if at < size for t in range(len(tokens)) if word.startswith(tokens[t], at) and reads(s, t)] + [p for p in paths if p[0] == size]
                assert [p for at, _, p in paths if at == size] == [tuple(seq)]


def test_a_token_made_twice_is_refused():
    with pytest.raises(ValueError, match="two ways"):
        word_bpe.Automaton(4, [0, 1], np.zeros(4, bool), [(0, 1, 2), (1, 0, 2)])


def test_word_frames(spark, library):
    rows = [(1, "The quick, brown FOX's", "x"), (2, None, "x"), (None, "", "x"), (4, " \t\n", None), (1, "The quick, brown FOX's", "x"), (5, "w" * 70_000, "x"), (6, "a<|endoftext|>b", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").withColumnRenamed("ids", "n_tokens")
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = sorted((k, len(i), digest(" ".join(map(str, i))), digest(library.decode(i, skip_special_tokens=False))) for (k, _, _), i in zip(rows, want) if k) + [(None, 0, digest(""), digest(""))]
    got = [tuple(r) for r in word_bpe.round_trip_digest(docs, WORD_PAIRS).collect()]
    assert sorted(r for r in got if r[0]) + [r for r in got if r[0] is None] == expected
    coded = word_bpe.encode(docs, WORD_PAIRS)
    assert coded.columns == [*docs.columns, "ids"]
    both = word_bpe.decode(coded, WORD_PAIRS).collect()
    assert [r["decoded"] for r in both] == [library.decode(i, skip_special_tokens=False) for i in want]
    assert word_bpe.round_trip_digest(docs.limit(0), WORD_PAIRS).collect() == []
