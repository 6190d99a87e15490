"""Token counts by a count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary's matches; dynamic programming carries, for each position, the best score and
the number of pieces on the way there, with the tokenizer's own tie rule: a way replaces another only if its score is
strictly better, and ways arrive in order of their last piece's start. No pieces are built.

The vocabulary (pieces and scores) is read from a SentencePiece file and broadcast: some ten thousand short strings.
Spaces are U+2581 and one is put before a text that isn't empty. Since no piece holds U+2581 after another character,
every best way breaks before each run of U+2581, and a text is counted run by run with a bounded cache; a vocabulary
for which that isn't so is counted as one run. Characters of no piece cost the lowest score less 10; neighbours are
one unknown piece, spelled as bytes where the vocabulary has byte pieces.

Defined results: null and empty texts have 0 tokens; a very long text is counted whole; rows stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]
    has_bytes: bool

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        """Scored pieces of a SentencePiece model; control, unknown, unused and byte pieces match no text."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = tuple((model.id_to_piece(i), float(model.get_score(i))) for i in plain)
        return cls(pieces, sum(model.is_byte(i) for i in ids) == 256)


class Counter:
    """Counts texts; one for each worker."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.vocabulary, self.most, self.cache = vocabulary, cache, {}
        self.lowest = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.scores = dict(vocabulary.pieces)
        self.characters = {piece for piece in self.scores if len(piece) == 1}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for piece, score in self.vocabulary.pieces:
            made.add_word(piece, (len(piece), score))
        made.make_automaton()
        return made

    @cached_property
    def runs(self) -> re.Pattern:
        if any(SPACE in piece.lstrip(SPACE) for piece in self.scores):
            return re.compile(r"(?s).+")
        # "\n" ends a run too where no piece holds it: it is a break for every way
        if any("\n" in piece for piece in self.scores):
            return re.compile(rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        return re.compile(rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+[^{SPACE}\n]*")

    def pieces_in(self, run: str) -> int:
        """Pieces on the best way through a run."""
        if not self.characters.issuperset(run):
            return self.viterbi(run)
        # every character is a piece, so each place is reached; matches come by end, longest (first start) first
        best, count = [0.0] + [float("-inf")] * len(run), [0] * (len(run) + 1)
        for last, (length, score) in self.automaton.iter(run):
            end = last + 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], count[end] = total, count[end - length] + 1
        return count[-1]

    def viterbi(self, run: str) -> int:
        """The same for a run with unknown characters."""
        n = len(run)
        arrive: list[list[tuple[int, float]]] = [[] for _ in range(n)]  # by start: (end, score)
        for last, (length, score) in self.automaton.iter(run):
            arrive[last + 1 - length].append((last + 1, score))
        best: list[float | None] = [None] * (n + 1)
        count, unknown = [0] * (n + 1), [False] * (n + 1)  # unknown: the way ends in an unknown piece
        best[0] = 0.0
        for start in range(n):
            here, so_far, was = best[start], count[start], unknown[start]
            single = False
            for end, score in arrive[start]:
                single |= end == start + 1
                if best[end] is None or here + score > best[end]:
                    best[end], count[end], unknown[end] = here + score, so_far + 1, False
            if not single:
                end = start + 1
                if best[end] is None or here + self.lowest > best[end]:
                    more = len(run[start].encode("utf-8")) if self.vocabulary.has_bytes else int(not was)
                    best[end], count[end], unknown[end] = here + self.lowest, so_far + more, True
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, cache = 0, self.cache
        for run in self.runs.findall(SPACE + text.replace(" ", SPACE)):
            n = cache.get(run)
            if n is None:
                n = self.pieces_in(run)
                if len(run) <= 64:
                    if len(cache) >= self.most:
                        cache.clear()
                    cache[run] = n
            total += n
        return total


def count_tokens(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: Vocabulary | None = None
) -> DataFrame:
    """doc_id, n_chars and n_tokens of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.load())

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(held.value)
        for batch in texts:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    rows = docs.select(F.col(doc_id), F.col(text).cast("string").alias("_sw_text"))
    length = F.coalesce(F.length("_sw_text"), F.lit(0)).cast("long")
    return rows.select(doc_id, length.alias("n_chars"), counted("_sw_text").alias("n_tokens"))
