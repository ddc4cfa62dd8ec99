"""Counting a unigram tokenizer's pieces without building them.

For every distinct word an Aho-Corasick automaton lists the vocabulary matches ending at each
character; dynamic programming keeps the best score there and the number of pieces of the path
that has it. Ties follow the tokenizer: among equal scores the longest last piece stays, because
the tokenizer replaces a path only by a better one and meets longer last pieces first. A character
that no single-character piece covers may be an unknown piece; neighbouring unknown pieces count once.
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscan.llm.common import Columns, map_batches

#: Replaces the space and starts every word.
MARK = "▁"
#: An unknown character costs this much below the lowest score.
UNKNOWN_PENALTY = 10.0
#: Distinct words whose counts a Python worker remembers.
REMEMBERED = 500_000

_worker: dict = {}


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) in id order of a public piece model, used as a unigram vocabulary; id 0 is unknown."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def words(text: str) -> list[str]:
    """The parts a text is cut into: spaces become marks, each part starts with one."""
    marked = text.replace(" ", MARK)
    if marked and not marked.startswith(MARK):
        marked = MARK + marked
    return [MARK + part for part in marked.split(MARK)[1:]]


class Counter(dict):
    """Word to number of pieces, filled on demand."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        self[word] = count = self.count(word)
        return count

    def count(self, word: str) -> int:
        size = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for end, match in self.automaton.iter(word):
            ending[end + 1].append(match)
        best: list[float] = [0.0] * (size + 1)
        pieces = [0] * (size + 1)
        last_unknown = [False] * (size + 1)
        for end in range(1, size + 1):
            score, start, unknown, single = None, 0, False, False
            for length, own in sorted(ending[end], reverse=True):
                single = single or length == 1
                found = own + best[end - length]
                if score is None or found > score:
                    score, start = found, end - length
            if not single and (score is None or self.unknown + best[end - 1] > score):
                score, start, unknown = self.unknown + best[end - 1], end - 1, True
            best[end] = score
            pieces[end] = pieces[start] + (not (unknown and last_unknown[start]))
            last_unknown[end] = unknown
        return pieces[size]


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_tokens) of every row of (doc_id, text); null and empty texts have 0.

    Whole texts; a word without spaces is counted whole in time proportional to its length. One row
    per input row; an empty table gives no rows.
    """
    key = hash(tuple(pieces))
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def batch(rows: Columns) -> Columns:
        if _worker.get("key") != key:
            _worker.update(key=key, counts=Counter(sent.value))
        counts: Counter = _worker["counts"]
        found = []
        for text in rows["text"]:
            found.append(sum(map(counts.__getitem__, words(text or ""))))
            if len(counts) > REMEMBERED + 200_000:
                for word in list(counts)[REMEMBERED:]:
                    del counts[word]
        return {"doc_id": rows["doc_id"], "n_tokens": found}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                       "doc_id long, n_tokens long", batch)
