"""Token counts by a count-only Viterbi search over a unigram vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm._memory import held, tidy

SPACE = "▁"
#: What an unknown character scores below the least score of the vocabulary.
UNKNOWN_PENALTY = 10.0
#: Units longer than this aren't remembered, and so many are at most.
LONG_WORD, MOST_WORDS = 64, 1_000_000


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(sp.get_piece_size())
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter(dict):
    """Pieces of a unit of text on the best path, computed once per unit.

    A unit is a run of space marks and what follows it up to the next mark. No
    piece crosses from one unit to the next, so the best path of a text is that
    of its units; where the vocabulary has a piece with a mark after another
    character, or none for the mark alone, the whole text is one unit.

    The automaton names all pieces that end at a character, the longest first,
    so of equally good ways to a character the one whose last piece starts first
    stays, as in the tokenizer. A character no single-character piece covers may
    stand as unknown; unknown characters in a row are one piece.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        apart = SPACE in self.single and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*" if apart else "(?s).+").findall
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        if pieces:
            self.automaton.make_automaton()
        else:
            self.automaton = None

    def pieces(self, word: str) -> int:
        n = len(word)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends = iter(self.automaton.iter(word)) if self.automaton else iter(())
        hit = next(ends, None)
        for at in range(n):
            score, pieces, fresh, found = 0.0, 0, False, False
            while hit and hit[0] == at:
                length, own = hit[1]
                start = at + 1 - length
                value = own + best[start]
                if not found or value > score:
                    score, pieces, fresh, found = value, count[start] + 1, False, True
                hit = next(ends, None)
            if word[at] not in self.single:
                value = self.unknown + best[at]
                if not found or value > score:
                    score, pieces, fresh = value, count[at] + (not unknown[at]), True
            best[at + 1], count[at + 1], unknown[at + 1] = score, pieces, fresh
        return count[n]

    def __missing__(self, unit: str) -> int:
        n = self.pieces(unit)
        if len(unit) <= LONG_WORD:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[unit] = n
        return n

    def count(self, text: str | None) -> int:
        """Pieces of a whole text whose spaces are marks, one before the text unless it starts with one."""
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        return sum(map(self.__getitem__, self.units(text if text[0] == SPACE else SPACE + text)))


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and n_tokens of every whole text.

    Null and empty texts have 0 tokens; repeated rows are counted alike; an empty
    table gives no rows; other columns are ignored. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(model_file, lambda: Counter(vocabulary(model_file)))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counter.count(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run, model_file), "doc_id long, n_tokens long")
