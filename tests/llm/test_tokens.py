"""Operators 1, 2 and 10 next to the libraries and brute force."""

import base64
import hashlib
import random
import uuid
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dwell.llm import bpe, counts, queries, records
from dwell.llm.texts import WordTable, piece_of, word_keys, words_of
from dwell.sources.storage import fresh_folder
from frames import TEXTS, awkward, empty

MULTI = public_tokenizers.path(queries.MULTI)
RANKS = bpe.read_ranks(MULTI)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BYTES = Tokenizer.from_file(public_tokenizers.path(queries.BYTES))
PIECES = counts.read_pieces(public_tokenizers.path(queries.PIECES))
TEXT = st.text(st.sampled_from("ab 's'll\n\t 　é漢1٣!<|>\x1c\x85​😀\x00"), max_size=40)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXT, st.text(max_size=30)), max_size=5))
def test_replay_equals_the_library(encoder, texts):
    got = [np.frombuffer(d, "<u4").tolist() for d in encoder.encode(texts)]
    assert got == [LIBRARY.encode_ordinary(t) for t in texts]


def test_lower_rank_made_by_a_merge_goes_first():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 301, b"bd": 302, b"abcab": 303}
    words = [b"abcabd", b"ababc", b"abdabc", b"ab" * 9 + b"c"]
    own = tiktoken.Encoding("x", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    got = [np.frombuffer(d, "<u4").tolist() for d in bpe.MergeReplay(ranks).encode(words)]
    assert got == [own.encode_ordinary(w.decode()) for w in words]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_pieces_make_up_the_text(text):
    assert "".join(map(piece_of, word_keys(text))) == text
    assert words_of(text) == [w.decode() for w in text.encode().split(None) if w] or not text


def test_a_full_table_starts_again():
    calls = []
    table = WordTable(lambda ws: calls.append(len(ws)) or [w.upper() for w in ws], limit=3)
    for i in range(20):
        known = table.fill([[f"w{j}" for j in range(i, i + 3)]])
        assert all(known[f"w{j}"] == f"W{j}" for j in range(i, i + 3))
        assert len(table.known) <= 6


def test_op1(spark):
    got = [tuple(r) for r in queries.encode_digests(awkward(spark)).collect()]
    want = []
    for doc_id, text in awkward(spark).select("doc_id", "text").collect():
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert queries.encode_digests(empty(spark)).count() == 0


def test_decode_alone(spark):
    df = bpe.decode_ids(bpe.encode_texts(awkward(spark), MULTI, public_tokenizers.PATTERN, keep=("text",)), MULTI)
    assert all(r["decoded"] == (r["text"] or "").encode() for r in df.collect())


def _plain_crc32c(data):
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = value >> 1 ^ (records.POLYNOMIAL if value & 1 else 0)
    return value ^ 0xFFFFFFFF


def test_checksums():
    rnd = random.Random(1)
    payloads = [rnd.randbytes(n) for n in (0, 1, 2, 7, 255, 256, 257, 511, 512, 513, 1300, 2049)]
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    assert records.crc32c(payloads).tolist() == list(map(_plain_crc32c, payloads))
    data = b"".join(records.frames(payloads))
    at = np.cumsum([0] + [len(p) + 16 for p in payloads])[:-1].tolist()
    assert records.payloads_of(data, at) == payloads
    with pytest.raises(ValueError):
        records.payloads_of(data[:20] + bytes([data[20] ^ 1]) + data[21:], at[:3])


@pytest.fixture(scope="module")
def ids():
    return records.Ids(public_tokenizers.path(queries.BYTES))


def _library(texts):
    return [np.array(BYTES.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXT, st.text(max_size=30), st.just("a<|endoftext|> b")), max_size=5))
def test_records_equal_the_library(ids, texts):
    assert ids.encode(texts) == _library(texts)


def test_known_words_take_bounded_memory(monkeypatch):
    monkeypatch.setattr(records, "KEPT_BYTES", 30_000)
    ids = records.Ids(public_tokenizers.path(queries.BYTES))
    for i in range(30):
        texts = ["long" * (3000 + i), *(f"the w{i * 100 + j} of x{j}" for j in range(100)), "", "a  b ", " "]
        assert ids.encode(texts) == _library(texts)
        assert 0 < ids.words.nbytes + ids.ids.nbytes <= 30_000


def _records(spark, docs):
    folder = fresh_folder(spark, "test-records")
    index = records.write_records(docs, folder, public_tokenizers.path(queries.BYTES), 2)
    return index, folder


def test_op2(spark):
    docs = awkward(spark)
    index, folder = _records(spark, docs)
    got = [
        (r["doc_id"], r["start"], r["ids"]) for r in records.read_records(index, folder).orderBy("start").collect()
    ]
    start, seen = 0, []
    for doc_id, at, ids in got:
        assert at == start
        start += len(ids) // 4
        seen.append((doc_id, ids))
    want = [
        (i, np.array(BYTES.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
        for i, t in docs.select("doc_id", "text").collect()
    ]
    assert sorted(seen, key=str) == sorted(want, key=str)
    order = [-1 if i is None else i for i, _ in seen]
    assert order == sorted(order)
    assert _records(spark, empty(spark))[0].count() == 0


def test_shuffled_reads_see_every_record_once(spark):
    index, folder = _records(spark, awkward(spark))
    one, two = (records.read_records(records.shuffled(index, 7, e), folder).select("start").collect() for e in (0, 1))
    assert one != two and sorted(one) == sorted(two) == sorted(index.select("start").collect())


def test_op2_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op2_records(spark, folder).collect():
        ids = BYTES.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def _best(word, byte_score):
    word = counts.MARK + word

    @lru_cache(None)
    def best(i):
        if i == len(word):
            return 0, 0
        ways = [(PIECES[word[i:j]] + best(j)[0], best(j)[1] - 1) for j in range(i + 1, len(word) + 1) if word[i:j] in PIECES]
        if word[i] not in PIECES:
            width = len(word[i].encode())
            ways.append((width * byte_score + best(i + 1)[0], best(i + 1)[1] - width))
        return max(ways)

    return -best(0)[1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abing the▁é漢ಠ😀"), min_size=1, max_size=14), max_size=8))
def test_trie_counts_equal_brute_force(words):
    trie = counts.PieceTrie(PIECES)
    assert trie.counts(words) == [_best(w, trie.byte_score) for w in words]


def test_long_words_need_no_nodes():
    trie = counts.PieceTrie(PIECES)
    word = "thing" * 300
    assert trie.counts([word]) == [_best_long(word, trie)] and len(trie.best) == 1


def _best_long(word, trie):
    node = trie.__class__(trie.pieces)
    return node.count[node.insert(counts.MARK + word)]


def test_op10(spark):
    got = {(r["n_words"], r["n_tokens"]) for r in counts.count_tokens(awkward(spark), public_tokenizers.path(queries.PIECES)).collect()}
    score = counts.PieceTrie(PIECES).byte_score
    want = set()
    for text in (*TEXTS, "no id"):
        words = (text or "").encode().split()
        if all(len(w) < 100 for w in words):
            want.add((len(words), sum(_best(w.decode(), score) for w in words)))
    assert want <= got
    assert counts.count_tokens(empty(spark), public_tokenizers.path(queries.PIECES)).count() == 0
