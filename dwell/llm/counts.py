"""Token counts by dynamic programming over a trie (operator 10).

A unigram tokenizer takes the segmentation of a pre-token with the best total piece
score.  The forward scores of a prefix do not depend on what follows, so the distinct
pre-tokens of a slice of texts go into a trie and every node works out its forward score
once, for all pre-tokens that share the prefix.  The node where a pre-token ends holds its
token count.  Counts of a text are sums over its pre-tokens.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from dwell.llm.texts import WordTable, map_texts, words_of

MARK = "▁"  # stands for the space before a word in piece vocabularies
UNIT = 1_000_000  # scores are whole millionths, so that sums and ties are exact
# Nodes a trie may hold before it is started again.
NODES = 300_000
# A longer word shares no prefixes worth keeping and gets no nodes.
LONG = 1000


def read_pieces(path: str) -> dict[str, int]:
    """Pieces of a public vocabulary file with their unigram scores.

    The file lists pieces in rank order without probabilities.  Zipf's law for that order
    gives them: the piece of rank r has a probability in proportion to 1 / (r + 1).
    Control and byte pieces have no text of their own and are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    total = math.log(sum(1 / (r + 1) for r in range(size)))
    return {
        model.id_to_piece(i): round((-math.log(i + 1) - total) * UNIT)
        for i in range(size)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


class PieceTrie:
    """Best unigram segmentation of every prefix of the inserted pre-tokens.

    A character outside the vocabulary is spelled by its UTF-8 bytes, one token each, at
    a score below every piece.  Among equal scores the fewest tokens win.
    """

    def __init__(self, pieces: dict[str, int]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.byte_score = min(pieces.values()) - 10 * UNIT
        self.clear()

    def clear(self):
        self.child: dict[tuple[int, str], int] = {}
        self.best: list[int] = [0]
        self.count: list[int] = [0]

    def insert(self, word: str) -> int:
        """The node of a pre-token, with nodes for the prefixes not yet seen."""
        child, best, count = self.child, self.best, self.count
        node, path = 0, [0]
        for end, char in enumerate(word, 1):
            found = child.get((node, char))
            if found is None:
                found = child[node, char] = len(best)
                score, tokens = self._forward(word, end, path)
                best.append(score)
                count.append(tokens)
            node = found
            path.append(node)
        return node

    def _forward(self, word: str, end: int, path: list[int]) -> tuple[int, int]:
        best, count, pieces = self.best, self.count, self.pieces
        score = tokens = None
        for start in range(max(0, end - self.longest), end):
            piece = pieces.get(word[start:end])
            if piece is None:
                continue
            node = path[start]
            total = best[node] + piece
            if score is None or total > score or (total == score and count[node] + 1 < tokens):
                score, tokens = total, count[node] + 1
        if word[end - 1] not in pieces:
            width = len(word[end - 1].encode())
            node = path[end - 1]
            total = best[node] + width * self.byte_score
            if score is None or total > score or (total == score and count[node] + width < tokens):
                score, tokens = total, count[node] + width
        return score, tokens

    def counts(self, words: list[str]) -> list[int]:
        """Token counts of distinct words, each with the mark of the space before it."""
        out = []
        for word in words:
            if len(word) > LONG:
                out.append(self._alone(MARK + word))
                continue
            if len(self.best) > NODES:
                self.clear()
            out.append(self.count[self.insert(MARK + word)])
        return out

    def _alone(self, word: str) -> int:
        kept = self.best, self.count
        self.best, self.count = [0], [0]
        path = range(len(word) + 1)
        for end in path[1:]:
            score, tokens = self._forward(word, end, path)
            self.best.append(score)
            self.count.append(tokens)
        found = self.count[-1]
        self.best, self.count = kept
        return found


@lru_cache(maxsize=2)
def _table(path: str) -> WordTable:
    return WordTable(PieceTrie(read_pieces(path)).counts)


def count_tokens(docs: DataFrame, pieces_path: str, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, ``n_words`` and ``n_tokens`` of every whole text.

    Pre-tokens are runs of characters other than ASCII white space.  A null, empty or
    blank text has none and counts zero.  Rows are independent and nothing is shuffled;
    ``pieces_path`` must exist on every executor.
    """

    def start():
        table = _table(pieces_path)

        def work(texts):
            words = [words_of(t) if t else [] for t in texts]
            known = table.fill(words)
            return [
                pa.array(list(map(len, words)), pa.int64()),
                pa.array([sum(map(known.__getitem__, ws)) for ws in words], pa.int64()),
            ]

        return work

    return map_texts(docs, text, keep, [StructField("n_words", LongType()), StructField("n_tokens", LongType())], start)
