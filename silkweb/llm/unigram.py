"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton enumerates all vocabulary matches of a text; dynamic programming over their ends carries the
best score and the number of pieces on the path that has it. Ties go as in the tokenizers' Viterbi: candidates for an
end come from the farthest start first and replace only what scores less. A character that is no piece costs the least
score less 10 and becomes its UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from silkweb.llm.common import small_batches

#: What a character that is no piece scores below the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Stands for a space in pieces.
BLANK = "▁"
#: Words that a worker remembers with their counts: the first it meets, which the frequent ones are among.
MOST_WORDS = 1_000_000
LONGEST_REMEMBERED = 64
#: Places of a longer segment that are held at once, beside as many as the longest piece has characters.
PLACES = 1 << 16


class Words(dict):
    """Word -> tokens of the word with what stands before it."""

    def __init__(self, counter: Unigram, before: str) -> None:
        super().__init__()
        self.counter, self.before = counter, before

    def __missing__(self, word: str) -> int:
        if not word:
            raise _Blanks
        n = self.counter.count_segment(self.before + word)
        if len(word) <= LONGEST_REMEMBERED and len(self) < MOST_WORDS:
            self[word] = n
        return n


class _Blanks(Exception):
    """Several blanks in a row, or one at an end of a line."""


class Unigram:
    """Counts for a vocabulary of (piece, score); scores add up exactly if they are whole numbers."""

    def __init__(self, vocabulary: list[tuple[str, float]], blank_before: bool = True) -> None:
        import ahocorasick

        self.blank_before = blank_before
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            automaton.add_word(piece, (len(piece), score))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.longest = max(len(piece) for piece, _ in vocabulary)
        held = {c for piece, _ in vocabulary for c in piece}
        # Where no piece holds a blank after another character, the best path of a line is that of its words one after
        # the other, each with its blank: no piece reaches over the place before it. Nor over a line feed, if no piece
        # holds one.
        self.by_word = "\n" not in held and not any(BLANK in piece.lstrip(BLANK) for piece, _ in vocabulary)
        self.single = frozenset(c for c in held if c in automaton)
        self.words, self.first_words = Words(self, BLANK), Words(self, "")

    def count_segment(self, text: str) -> int:
        n = len(text)
        if n > PLACES:
            return self._count_long(text)
        worst = float("-inf")
        score, count = [0.0] + [worst] * n, [0] * (n + 1)
        if self.single.issuperset(text):
            for last, (size, own) in self.matches(text):
                start = last + 1 - size
                s = score[start] + own
                if s > score[last + 1]:
                    score[last + 1] = s
                    count[last + 1] = count[start] + 1
            return count[n]
        done = 0
        for last, (size, own) in self.matches(text):
            while done < last:  # all matches that end before are in
                self._or_unknown(text, done, score, count)
                done += 1
            start = last + 1 - size
            s = score[start] + own
            if s > score[last + 1]:
                score[last + 1] = s
                count[last + 1] = count[start] + 1
        while done < n:
            self._or_unknown(text, done, score, count)
            done += 1
        return count[n]

    def _count_long(self, text: str) -> int:
        """The same for a segment of any length, of which ``PLACES`` and the longest piece before them are held."""
        worst, size = float("-inf"), PLACES + self.longest
        score, count = [0.0] + [worst] * size, [0] * (size + 1)
        base = done = 0
        for last, match in chain(self.matches(text), [(len(text), None)]):
            while True:
                if done + 1 - base > size:  # a piece that ends further on begins after these
                    kept = done + 1 - self.longest - base
                    score, count = score[kept:] + [worst] * (PLACES + 1), count[kept:] + [0] * (PLACES + 1)
                    base += kept
                if done >= last:
                    break
                if text[done] not in self.single:
                    s = score[done - base] + self.unknown
                    if s > score[done + 1 - base]:
                        score[done + 1 - base] = s
                        count[done + 1 - base] = count[done - base] + len(text[done].encode())
                done += 1
            if match:
                start = last + 1 - match[0] - base
                s = score[start] + match[1]
                if s > score[last + 1 - base]:
                    score[last + 1 - base] = s
                    count[last + 1 - base] = count[start] + 1
        return count[len(text) - base]

    def _or_unknown(self, text: str, at: int, score: list[float], count: list[int]) -> None:
        """A character that is no piece may also end its path as its bytes."""
        if text[at] not in self.single:
            s = score[at] + self.unknown
            if s > score[at + 1]:
                score[at + 1] = s
                count[at + 1] = count[at] + len(text[at].encode())

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word or BLANK in text:
            return self.count_segment((BLANK if self.blank_before else "") + text.replace(" ", BLANK))
        lines = text.split("\n")
        n = len(lines) - 1  # a line feed is one byte
        for k, line in enumerate(lines):
            blank = self.blank_before and not k
            first, *rest = line.split(" ")
            try:
                n += (self.words if blank else self.first_words)[first] + sum(map(self.words.__getitem__, rest))
            except _Blanks:
                n += self.count_segment((BLANK if blank else "") + line.replace(" ", BLANK))
        return n


@lru_cache(maxsize=2)
def load(path: str) -> Unigram:
    """The pieces of a SentencePiece model file with their scores, without its control, byte and unknown pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i)))
    return Unigram([(m.id_to_piece(i), m.get_score(i)) for i in ordinary])


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", name: str = "n_tokens") -> DataFrame:
    """(key, n_tokens) of every row of ``df``, for the whole text. Null and empty texts have no tokens; null keys and
    repeated rows keep a row each; other columns don't matter."""
    small_batches(df.sparkSession)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField(name, T.LongType(), False)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = load(path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t.as_py() or "") for t in batch.column(1)], pa.int64())], names=[key, name])

    return df.select(key, text).mapInArrow(run, schema)
