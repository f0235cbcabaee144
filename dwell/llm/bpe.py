"""Byte-level BPE by merge replay (operator 1).

The distinct pieces of a slice of texts form one corpus.  An inverted index maps each
merge to the places where its pair stands; merges are applied in rank order over the
whole corpus at once, and only the two neighbours of a merged pair get new entries.
Every task replays its own words and keeps their ids, so texts are never shuffled.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from dwell.llm.texts import WordTable, map_texts, piece_of, word_keys

END, GONE = -1, -2
# Words kept by a worker process, with their ids.
WORDS = 550_000
# Pairs whose merge is remembered.
PAIRS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a vocabulary file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes lists of distinct byte strings with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.byte_pairs = np.array(
            [[ranks.get(bytes([a, b]), END) for b in range(256)] for a in range(256)], np.int64
        )
        self.made: dict[int, int] = {}

    def pair(self, a: int, b: int) -> int:
        """The token that a pair merges into, or -1."""
        key = a * self.size + b
        found = self.made.get(key)
        if found is None:
            if len(self.made) >= PAIRS:
                self.made.clear()
            found = self.made[key] = self.ranks.get(self.tokens[a] + self.tokens[b], END)
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers.

        The lowest rank in a word always goes first, equal ranks from the left.  Should a
        merge give rise to a pair of lower rank, the rest of that word waits for it.
        """
        if not words:
            return []
        # A mark before, between and after the words: pairs never cross it.
        data = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        symbols = self.single[data]
        symbols[starts] = END
        merged = self.byte_pairs[data[:-1], data[1:]]
        merged[starts[:-1]] = END
        merged[starts[1:] - 1] = END

        # Inverted index: merge -> positions of its left part.
        at = np.flatnonzero(merged >= 0)
        at = at[np.argsort(merged[at], kind="stable")]
        kinds, first = np.unique(merged[at], return_index=True)
        index = {int(k): p.tolist() for k, p in zip(kinds, np.split(at, first[1:]))}
        queue = list(index)
        heapq.heapify(queue)

        tok = symbols.tolist()
        due = merged.tolist()  # by position: the merge its pair is due for, or below 0
        due.append(END)
        nxt = list(range(1, len(tok) + 1))
        prv = list(range(-1, len(tok) - 1))
        bounds: list[int] | None = None
        pair, known, size = self.pair, self.made.get, self.size
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            base = rank * size
            waiting: set[int] = set()
            again = []
            for p in places:
                if due[p] != rank:
                    continue
                if waiting and bisect_right(bounds, p) in waiting:
                    again.append(p)
                    continue
                q = nxt[p]
                after = nxt[p] = nxt[q]
                prv[after] = p
                tok[p] = rank
                tok[q] = due[q] = due[p] = GONE
                lowest = rank
                b = tok[after]
                if b >= 0:
                    made = known(base + b)
                    if made is None:
                        made = pair(rank, b)
                    if made >= 0:
                        due[p] = made
                        if made in index:
                            index[made].append(p)
                        else:
                            index[made] = [p]
                            heapq.heappush(queue, made)
                        if made < rank:
                            lowest = made
                before = prv[p]
                a = tok[before]
                if a >= 0:
                    made = known(a * size + rank)
                    if made is None:
                        made = pair(a, rank)
                    due[before] = made
                    if made >= 0:
                        if made in index:
                            index[made].append(before)
                        else:
                            index[made] = [before]
                            heapq.heappush(queue, made)
                        if made < lowest:
                            lowest = made
                if lowest < rank:
                    bounds = bounds or starts.tolist()
                    waiting.add(bisect_right(bounds, p))
            if again:
                index.setdefault(rank, []).extend(again)
                heapq.heappush(queue, rank)

        ids = np.array(tok)
        alive = ids >= 0
        ends = np.cumsum(alive)[starts[1:]] * 4
        flat = ids[alive].astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Encoder:
    """Whole texts to ids: pieces by a pattern, then one replay per slice of texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay = MergeReplay(ranks)
        self.pattern = regex.compile(pattern)
        self.table = WordTable(self.solve, WORDS)
        self.pieces = WordTable(lambda pieces: self.replay.encode([p.encode() for p in pieces]), WORDS)

    def solve(self, keys: list[str]) -> list[bytes]:
        pieces = [self.pattern.findall(piece_of(k)) for k in keys]
        ids = self.pieces.fill(pieces)
        return [b"".join(map(ids.__getitem__, found)) for found in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        keys = [word_keys(t) for t in texts]
        ids = self.table.fill(keys)
        return [b"".join(map(ids.__getitem__, k)) for k in keys]


# One per worker process: its word table carries over from task to task.
@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def _decoder(path: str):
    tokens = _tokens(path)
    return lambda data: b"".join(map(tokens.__getitem__, np.frombuffer(data, "<u4").tolist()))


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text",
                 keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Kept columns and the ids of every text, as little-endian unsigned 32-bit integers.

    Special tokens are ordinary text.  A null or empty text has no ids.  Rows are
    independent, so repeated rows get equal results, and an empty table gives none.
    ``decoded`` names a column for the bytes that the ids decode to, for a check of the
    round trip in the same pass.  ``ranks_path`` must exist on every executor.
    """

    def start():
        encoder = _encoder(ranks_path, pattern)
        decode = _decoder(ranks_path)

        def work(texts):
            found = encoder.encode(texts)
            out = [pa.array(found, pa.binary())]
            return out + [pa.array(map(decode, found), pa.binary())] if decoded else out

        return work

    added = [StructField(name, BinaryType()) for name in (ids, decoded) if name]
    return map_texts(df, text, keep, added, start)


def decode_ids(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that ids of ``encode_texts`` stand for (null ids: null).

    They are bytes and not text: ids cut at any place may end inside a character.
    """
    column = df.columns.index(ids)
    if decoded in df.columns:
        raise ValueError(f"the input already has a column {decoded}")
    schema = StructType([*df.schema, StructField(decoded, BinaryType())])

    def run(batches):
        decode = _decoder(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = pa.array([None if d is None else decode(d) for d in part.column(column).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=schema.names)

    return df.mapInArrow(run, schema)
