"""Operator 3: count-only Viterbi over a unigram vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import slices

SPACE = "▁"
#: An unknown character scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words whose count a task remembers; beyond that it forgets them all and goes on.
MEMORY = 600_000
#: Only words up to so many characters are remembered.
MEMORY_CHARS = 64


def load_vocabulary(path: str) -> list[tuple[str, float, str]]:
    """Pieces, scores and kinds (normal, byte, other), in the order of their ids, of a sentencepiece model file.

    Only normal pieces occur in texts: control, unknown and unused ones stand for no text, and byte pieces for unknown
    characters, whatever their names look like.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    other = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i), "other" if other(i) else "byte" if model.is_byte(i) else "normal") for i in range(model.get_piece_size())]


class CountViterbi:
    """Best segmentation's score and number of pieces, without the pieces.

    The automaton lists every vocabulary match of a word; the forward pass keeps at each position the best score, the
    pieces so far and the start of the last piece. Ties go to the piece that starts first: a later start must be
    strictly better, as in the public unigram tokenizers. A character that no single piece covers may be an unknown,
    at the worst score less a penalty; its pieces are its bytes if the vocabulary has byte pieces, else neighbouring
    unknowns count as one piece.
    """

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        self.bytes = sum(kind == "byte" for *_, kind in vocabulary) == 256
        normal = [(piece, score) for piece, score, kind in vocabulary if piece and kind == "normal"]
        self.unknown = min((s for _, s in normal), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in normal:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.memory: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Pieces and score of a word, the space mark before it not counted in."""
        known = self.count(SPACE + word)
        if len(word) <= MEMORY_CHARS:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[word] = known
        return known

    def count(self, word: str) -> tuple[int, float]:
        size = len(word)
        best: list[float | None] = [0.0, *[None] * size]
        pieces = [0] * (size + 1)
        unknown = [False] * (size + 1)  # the best path ends with an unknown
        single = [False] * (size + 1)  # a piece covers the last character alone
        done = 0

        def close(upto: int) -> None:
            """No more matches end here: characters without a piece of their own may be unknown."""
            for end in range(done + 1, upto + 1):
                if not single[end]:
                    x = best[end - 1] + self.unknown
                    if best[end] is None or x > best[end]:
                        more = len(word[end - 1].encode("utf-8", "surrogatepass")) if self.bytes else 0 if unknown[end - 1] else 1
                        best[end], pieces[end], unknown[end] = x, pieces[end - 1] + more, True

        # matches come by their end, of one end the longest, which starts first, first
        for last, (length, score) in self.automaton.iter(word):
            if done < last:
                close(last)
                done = last
            end = last + 1
            x, old = best[end - length] + score, best[end]
            if old is None or x > old:
                best[end], pieces[end] = x, pieces[end - length] + 1
            if length == 1:
                single[end] = True
        close(size)
        return pieces[size], best[size]

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = text.replace(" ", SPACE)
        words = (marked[1:] if marked[0] == SPACE else marked).split(SPACE)
        n, total = 0, 0.0
        known = self.memory.get
        for w in words:
            a, b = known(w) or self.word(w)
            n += a
            total += b
        return n, total


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float, str]]) -> DataFrame:
    """doc_id, n_tokens, score of each whole text: the pieces and log score of its best unigram segmentation.

    Spaces are marks that begin a word, one is put before the text, and words are segmented on their own. A null or
    empty text has 0 tokens; texts of any length are counted whole; ties go by the rule above; repeated rows and null ids
    keep their rows; an empty table gives no rows; other columns are ignored. No shuffle; the vocabulary (a fixed file, a megabyte) is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = CountViterbi(sent.value)
        for batch in slices(batches):
            n, score = zip(*(counter.text(t) for t in batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, score double")
