"""Word-level BPE by a tokenization automaton: merges compiled to a table, words encoded by its transitions.

The automaton reads tokens and accepts exactly the sequences that merging gives. It starts as one state with an arc for
every symbol. A merge of u and v then adds a gadget: the state that u leads to is split, the half that u keeps loses its
arc for v, and wherever u may be read, so may the new token, which leads where v did (Berglund, Martens and Van der
Merwe, 2024). Arcs of one token all lead to the same state, so the table is one bit for each state and kind of token.

A text is cut at special tokens, brought to canonical form and pre-split into words; a word's bytes are read from the
left. Every prefix has one accepted sequence, so each place in the word has one state, and of the vocabulary's matches
that end there one has an arc from the state where it begins. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array as packed
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from silkweb.llm.common import small_batches

#: White space of the Unicode standard; Python's own also takes U+001C to U+001F for it.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GAPS = re.compile(f"[{_SPACES}]+")
_NOT_GAPS = re.compile("[\x1c-\x1f]")
#: Stands after a word's last byte; bytes are the characters of their own codes.
_END = "\u0100"
#: Strings between white space that a worker remembers with their ids: the first it meets.
MOST_WORDS = 500_000
#: Longer ones are not remembered.
LONGEST_REMEMBERED = 64

#: Words of more bytes keep four bytes for each of theirs while they are encoded.
LONG_WORD = 1 << 12


def _byte_of() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands: printable Latin-1 for itself, the others
    in order for the characters from U+0100."""
    out, others = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + others)] = b
            others += 1
    return out


class Automaton:
    """States and arcs for merges (u, v, made) of tokens, in the order of their priority; ``last`` tokens end a word.

    ``after[t]`` is the state that arcs of t lead to (-1: the end), ``kind[t]`` the row of ``arcs`` that has a bit for
    each state in which t may be read. Tokens that no merge reaches have no arc anywhere.
    """

    def __init__(self, size: int, symbols: list[int], last: np.ndarray, merges: list[tuple[int, int, int]]) -> None:
        made = [m for _, _, m in merges]
        if len(set(made)) != len(made) or set(made) & set(symbols):
            raise ValueError("a token is made in two ways")
        order = np.full(size, -1, np.int64)  # row of each token: the symbols', then in the order they are made
        order[[*symbols, *made]] = np.arange(len(symbols) + len(made))
        read = np.zeros((len(symbols) + len(made) + 1, 1024), np.uint8)  # a bit for each state; the last row stays empty
        after = np.full(size, -1, np.int32)
        read[: len(symbols), 0] = 1
        after[[s for s in symbols if not last[s]]] = 0
        states, tokens_to = 1, [1 + sum(not last[s] for s in symbols)]  # the first state is the start's as well
        for k, (u, v, w) in enumerate(merges, len(symbols)):
            s, to, row = int(after[u]), int(after[v]), order[v]
            if s < 0 or not read[row, s >> 3] >> (s & 7) & 1:
                continue
            if tokens_to[s] > 1 or u == v:
                if states == 8 * read.shape[1]:
                    read = np.concatenate((read, np.zeros_like(read)), axis=1)
                read[:k, states >> 3] |= ((read[:k, s >> 3] >> (s & 7)) & 1) << (states & 7)
                tokens_to[s] -= 1
                s, states = states, states + 1
                after[u] = s
                tokens_to.append(1)
            read[row, s >> 3] &= ~np.uint8(1 << (s & 7))
            read[k] = read[order[u]]
            if not last[w]:
                after[w] = to
                tokens_to[to] += 1
        kinds: dict[bytes, int] = {}
        self.kind = np.array([kinds.setdefault(row.tobytes(), len(kinds)) for row in read[:, : (states + 7) // 8]], np.int32)[order]
        self.arcs = [*kinds]
        self.after, self.states = after, states


class WordPairs:
    """A tokenizer as its file describes it. ValueError for parts that aren't known here."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as lines:
            made = json.load(lines)
        self._known(made)
        model = made["model"]
        vocab, byte_of, end = model["vocab"], _byte_of(), model["end_of_word_suffix"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in made["added_tokens"])])
        self.pattern = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.labels = [""] * size
        self.words: list[str] = [""] * size  # the bytes a token stands for, with the mark after a last one
        last = np.zeros(size, bool)
        for token, i in vocab.items():
            self.labels[i] = token
            last[i] = token.endswith(end)
            self.words[i] = "".join(chr(byte_of[c]) for c in token.removesuffix(end)) + _END * bool(last[i])
        for token, i in self.special.items():
            self.labels[i] = token
        symbols = [vocab[c + e] for c in byte_of for e in ("", end)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.automaton = Automaton(size, symbols, last, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self._start()

    @staticmethod
    def _known(made: dict) -> None:
        normal, split = made.get("normalizer") or {}, made.get("pre_tokenizer") or {}
        steps = [(s["type"], s.get("pattern"), s.get("content")) for s in normal.get("normalizers", [])]
        parts, model = split.get("pretokenizers", []), made["model"]
        good = (
            steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
            and [p["type"] for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["behavior"] == "Removed"
            and parts[0]["invert"]
            and not parts[1]["add_prefix_space"]
            and not parts[1]["use_regex"]
            and model["type"] == "BPE"
            and model.get("end_of_word_suffix")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and made.get("decoder") is None
            and not any(t[k] for t in made["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not good:
            raise ValueError("a tokenizer of another kind: lower-cased words by byte-level BPE with word ends are known")

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("pattern", "special", "labels", "words", "automaton")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _start(self) -> None:
        """What isn't sent to workers: the search for matches, compiled patterns, remembered words."""
        import ahocorasick
        import regex
        import tokenizers

        self.find = regex.compile(self.pattern).findall
        self.normal = tokenizers.normalizers.Sequence([tokenizers.normalizers.NFC(), tokenizers.normalizers.Lowercase()])
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(self.pattern), "removed", True)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        matches, a = ahocorasick.Automaton(), self.automaton
        place = lambda state: (state >> 3, 1 << (state & 7))
        self.first, self.sizes = place(0), [*map(len, self.words)]
        for i, word in enumerate(self.words):
            if word:
                matches.add_word(word, (len(word), i, a.arcs[a.kind[i]], place(max(0, int(a.after[i])))))
        matches.make_automaton()
        self.matches = matches.iter
        self.decimals = [*map(str, range(len(self.labels)))]
        self.remembered: dict[str, bytes] = {}
        self.remembered_words: dict[str, bytes] = {}

    def encode_word(self, word: str) -> packed:
        """Ids of one pre-split word."""
        text = (word if word.isascii() else word.encode().decode("latin-1")) + _END
        if len(text) > LONG_WORD:
            token = self._long_word(text)
        else:
            token, state = [-1] * len(text), [None] * len(text)
            state.append(self.first)  # state[-1]: before the first byte
            for at, (size, i, arcs, after) in self.matches(text):
                if token[at] < 0:
                    byte, bit = state[at - size]
                    if arcs[byte] & bit:
                        token[at], state[at] = i, after
        out, at, sizes = packed("I"), len(text) - 1, self.sizes
        while at >= 0:
            i = token[at]
            if i < 0:
                raise ValueError(f"no sequence of tokens for {word[:40]!r}")
            out.append(i)
            at -= sizes[i]
        out.reverse()
        return out

    def _long_word(self, text: str) -> packed:
        """The last token at each place, with states only for as many places as the longest token has bytes."""
        ring = 1 << max(self.sizes).bit_length()
        token, state = packed("i", [-1]) * len(text), [None] * ring
        state[-1] = self.first
        for at, (size, i, arcs, after) in self.matches(text):
            if token[at] < 0:
                byte, bit = state[(at - size) % ring]
                if arcs[byte] & bit:
                    token[at], state[at % ring] = i, after
        return token

    def _split(self, part: str) -> list[str]:
        """Words of a part in canonical form and lower case, whatever its characters.

        Lower case goes character by character: a last sigma is like any other. What Python's tables don't know may be
        known to the tokenizer's library, whose tables are newer: it splits parts with such characters.
        """
        plain = "".join(map(str.lower, unicodedata.normalize("NFC", part)))
        if plain.isprintable():
            return self.find(plain)
        return [word for word, _ in self.splitter.pre_tokenize_str(self.normal.normalize_str(part))]

    def _word(self, word: str) -> bytes:
        known = self.remembered_words.get(word)
        if known is None:
            known = self.encode_word(word).tobytes()
            if len(word) <= LONGEST_REMEMBERED and len(self.remembered_words) < MOST_WORDS:
                self.remembered_words[word] = known
        return known

    def _spoken(self, part: str) -> bytes:
        """Ids of what stands between white space."""
        known = self.remembered.get(part)
        if known is None:
            if part.isascii():
                plain = part.lower()
                words = [plain] if plain.isalpha() else self.find(plain)
            else:
                words = self._split(part)
            known = b"".join(map(self._word, words))
            if len(part) <= LONGEST_REMEMBERED and len(self.remembered) < MOST_WORDS:
                self.remembered[part] = known
        return known

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        parts, out = self.cut.split(text) if self.cut else [text], []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                words = _GAPS.split(part) if _NOT_GAPS.search(part) else part.split()
                out.append(b"".join(map(self._spoken, words)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The labels of the ids' arcs, a blank between two; this file's kind of tokenizer joins them so."""
        return " ".join(map(self.labels.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def load(path: str) -> WordPairs:
    """The tokenizer of a file, compiled once."""
    return WordPairs(path)


def _shared(df: DataFrame, path: str):
    """The compiled tokenizer, sent to every executor once. Its size is bounded by the vocabulary, not by the rows."""
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(load(path))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column of token ids of the whole text, packed as little-endian unsigned 32-bit integers (binary).

    ``path`` is a tokenizer file that the driver has. A null or empty text, and one of white space, has no ids; very
    long texts and texts without white space are encoded like any other. Special tokens' strings in a text become
    their ids. Rows that repeat are encoded each. A column of the name ``ids`` is replaced.
    """
    shared, df = _shared(df, path), df.drop(ids)
    at = df.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = pa.array((shared.value.encode(t.as_py() or "") for t in batch.column(at)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, ids])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids, T.BinaryType(), False)]))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text that packed ids decode to. Null ids give an empty text; an id outside the vocabulary fails."""
    shared, df = _shared(df, path), df.drop(decoded)
    at = df.columns.index(ids)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = pa.array((shared.value.decode(t.as_py() or b"") for t in batch.column(at)), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, decoded])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType(), False)]))


def round_trip_digest(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, decoded again, and both digested.

    The same as ``encode`` and ``decode`` in one pass, as neither ids nor texts need to leave the worker. Ids are
    digested as decimal numbers with a blank between two. Null text: as empty. Null keys and repeated rows: one row
    each. Columns besides ``key`` and ``text`` don't matter.
    """
    shared = _shared(df, path)
    kind = df.schema[key].dataType

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sizes, ids_hash, text_hash = [], [], []
            for t in batch.column(1):
                ids = shared.value.encode(t.as_py() or "")
                sizes.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(" ".join(map(shared.value.decimals.__getitem__, memoryview(ids).cast("I"))).encode()).hexdigest())
                text_hash.append(hashlib.sha256(shared.value.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(key, text).mapInArrow(run, schema)
