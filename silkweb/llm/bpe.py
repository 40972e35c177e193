"""Byte-level BPE encoding and decoding by backtracking from longest matches.

A token sequence is what the merges would give exactly when every two neighbours are: so the encoder takes the longest
vocabulary match, keeps it if it is compatible with the token before it, else tries the next shorter match, and steps
back where none fits. Positions that failed are remembered, so each is left at most once and time is linear in the
piece. Compatibility of two neighbours is found by undoing their merges along the split and is memoised.

Longest matches come from the trie of pyahocorasick over the vocabulary; bytes stand in it as the Latin-1 characters of
the same codes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array as packed
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from silkweb.llm.common import small_batches

#: Pieces that a worker remembers with their ids: the first it meets, which the frequent ones are among.
MOST_PIECES = 700_000
#: Longer pieces are not remembered.
LONGEST_REMEMBERED = 64


class _Uneven(Exception):
    """White space that isn't one blank or line feed between other characters."""


class Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: BytePairs) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        out = packed("I", self.bpe.encode_piece(piece.encode())).tobytes()
        if len(piece) <= LONGEST_REMEMBERED and len(self) < MOST_PIECES:
            self[piece] = out
        return out


class Words(dict):
    """Word -> ids of its pieces, with what stands before it."""

    def __init__(self, bpe: BytePairs, before: str) -> None:
        super().__init__()
        self.bpe, self.before = bpe, before

    def __missing__(self, word: str) -> bytes:
        if not word or self.bpe.space(word[0]) or self.bpe.space(word[-1]):
            raise _Uneven
        if word.isalpha():  # letters are one piece
            out = packed("I", self.bpe.encode_piece((self.before + word).encode())).tobytes()
        elif word[-1] in ".,!?;:" and word[:-1].isalpha():  # and a mark after them is another
            out = self[word[:-1]] + self.bpe.pieces[word[-1]]
        else:
            out = self.bpe.encode_pieces(self.before + word)
        if len(word) <= LONGEST_REMEMBERED and len(self) < MOST_PIECES:
            self[word] = out
        return out


class BytePairs:
    """The tokenizer of a rank file: ranks in merge order, ids equal to ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.rank_of: dict[str, int] = {}  # as Latin-1, of those that merges make
        self.find = regex.compile(pattern).findall
        self.space = regex.compile(r"\s").match
        # One blank before a word is part of the word's first piece, and a line feed before one is a piece: then words
        # can be split off first and remembered whole. So it is for a pattern that cuts these probes in this way.
        probes = {"a b": ["a", " b"], "a\nb": ["a", "\n", "b"], ". 1": [".", " 1"], "1\n'": ["1", "\n", "'"], "' 's": ["'", " '", "s"], "ab é.": ["ab", " é", "."]}
        self.by_word = all(self.find(probe) == cut for probe, cut in probes.items())
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        automaton = ahocorasick.Automaton()
        for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(word) > 1:
                pair = self._last_merge(word, rank)
                if pair is None:
                    continue  # merges never make it; only a piece that equals it has it
                self.merged[pair] = rank
                self.halves[rank] = pair
            self.rank_of[word.decode("latin-1")] = rank
        for word in self.rank_of:
            automaton.add_word(word, len(word))
        self.longest = automaton.longest_prefix
        self.reach = max(map(len, self.rank_of))
        self.pieces, self.line_feed = Pieces(self), packed("I", self.encode_piece(b"\n")).tobytes()
        self.words, self.first_words = Words(self, " "), Words(self, "")

    def _last_merge(self, word: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token, found by merging its bytes with the lower ranks."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges of left and right, side by side, leave the border between them alone."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        merged, halves = self.merged, self.halves
        a, b, bound, good = left, right, 1 << 32, True
        while True:
            if merged.get((a, b), bound) < bound:
                good = False
                break
            # Undo the later of the two merges; of equal ones the right, as merging goes from the left.
            if a > b:
                first, bound = True, a
            else:
                first, bound = False, b + 1
            pair = halves.get(a if first else b)
            if pair is None:  # a single byte: only the other side can still be undone
                first = not first
                pair = halves.get(a if first else b)
                if pair is None:
                    break
                bound = a if first else b + 1
            if first:
                a = pair[1]
            else:
                b = pair[0]
        if len(self.fits) >= MOST_PIECES:
            self.fits.clear()
        self.fits[left, right] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        latin, n = piece.decode("latin-1"), len(piece)
        rank_of, fits, longest, reach = self.rank_of.get, self.fits.get, self.longest, self.reach
        dead = bytearray(n + 1)
        out: list[int] = []
        sizes: list[int] = []
        at, last, size = 0, -1, longest(latin[:reach])
        while True:
            while size:
                token = rank_of(latin[at : at + size])
                if token is not None and not dead[at + size]:
                    if last < 0:
                        break
                    good = fits((last, token))
                    if good or good is None and self._compatible(last, token):
                        break
                size -= 1
            else:
                dead[at] = 1
                out.pop()
                last = out[-1] if out else -1
                size = sizes.pop()
                at -= size
                size -= 1
                continue
            out.append(token)
            at += size
            if at == n:
                return out
            sizes.append(size)
            last, size = token, longest(latin[at : at + reach])

    def encode_pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.by_word and text:
            try:
                lines = []
                for line in text.split("\n"):
                    first, *rest = line.split(" ")
                    lines.append(self.first_words[first] + b"".join(map(self.words.__getitem__, rest)))
                return self.line_feed.join(lines)
            except _Uneven:
                pass
        return self.encode_pieces(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> BytePairs:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return BytePairs(ranks, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column of token ids of the whole text, packed as little-endian unsigned 32-bit integers (binary).

    ``path`` is a rank file that every executor has. A null text counts as empty and gets no ids; white space and
    very long texts are encoded like any other. A column of the name ``ids`` is replaced.
    """
    small_batches(df.sparkSession)
    df = df.drop(ids)
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.BinaryType(), False)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = load(path, pattern)
        for batch in batches:
            got = pa.array((bpe.encode(t.as_py() or "") for t in batch.column(at)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that packed ids stand for. Null ids give empty bytes; an id outside the vocabulary fails."""
    df = df.drop(decoded)
    at = df.columns.index(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = load(path, pattern)
        for batch in batches:
            got = pa.array((bpe.decode(t.as_py() or b"") for t in batch.column(at)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, decoded])

    return df.mapInArrow(run, schema)


def round_trip_digest(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, decoded again, and both digested.

    Encoding and decoding are the same as in ``encode`` and ``decode``, in one pass over the batches, as neither ids
    nor bytes need to leave the worker. Null text: as empty. Null keys and repeated rows: one row each.
    """
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = load(path, pattern)
        for batch in batches:
            sizes, ids_hash, text_hash = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py() or "")
                sizes.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(key, text).mapInArrow(run, schema)
