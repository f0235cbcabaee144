"""Operators 5, 6, 7 and 9 and the pipeline: brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dwell.llm import language, quality, queries, toxicity, warc
from frames import SCHEMA, TEXTS, awkward, empty

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality -------------------------------------------------------------------------

def _judge(text):
    words = WORD.findall(text)
    chars = sum(map(len, words))
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        found = WORD.findall(line)
        if found and line in seen:
            dup, dup_chars = dup + 1, dup_chars + sum(map(len, found))
        seen.add(line)
    bad, repeat = dup_chars > quality.LINE_SHARE * chars, 0
    for n in range(2, 11):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        times, first, later = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if g in first:
                later.update(range(i, i + n))
            first.add(g)
        if n == 3:
            repeat = len({j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + n)})
        if n in quality.TOP_SHARE:
            bad |= max((c * sum(map(len, g)) for g, c in times.items() if c > 1), default=0) > quality.TOP_SHARE[n] * chars
        if n in quality.REPEATED_LENGTHS:
            bad |= sum(len(words[j]) for j in later) > quality.REPEATED_SHARE * chars
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return len(words), chars, sum(text.count(c) for c in quality.SYMBOLS), dup, repeat, failed, not failed and not bad


def test_quality_equals_brute_force(spark):
    rnd = random.Random(4)
    texts = [t or "" for t in TEXTS if t is None or len(t) < 8000]
    texts += ["".join(rnd.choice(["a ", "b ", "c\n", "a b\n", " ", "\t", "é"]) for _ in range(rnd.randint(0, 200))) for _ in range(300)]
    found = quality.measure(texts)
    names = (*quality.COLUMNS, "base_failed", "kept")
    assert [tuple(found[c][i] for c in names) for i in range(len(texts))] == list(map(_judge, texts))
    assert quality.quality_rules(awkward(spark)).count() == awkward(spark).count()
    kept = quality.keep_good(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.schema["kept"].dataType == SCHEMA["kept"].dataType
    assert {r["doc_id"] for r in kept.collect()} <= {4, 5, 6, 11}
    assert quality.keep_good(empty(spark)).count() == 0


# ---- toxicity ------------------------------------------------------------------------

def _weights(word):
    out = {}
    for at in combinations(range(len(word)), toxicity.ORDER):
        sub = "".join(word[i] for i in at)
        out[sub] = out.get(sub, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
    return out


def test_kernel_equals_the_sum_over_subsequences():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) for _ in range(25)]
    want = [[sum(v * _weights(b).get(s, 0) for s, v in _weights(a).items()) for b in words] for a in words]
    assert np.allclose(toxicity.kernel(words, words), want)


def test_primal_form_equals_the_landmark_form():
    landmarks = ["loser", "idiot", "trash", "the"]
    coefficients = np.array([1.5, 0.5, 1.0, -0.5])
    alphabet, table = toxicity.primal(landmarks, coefficients)
    machine = toxicity.Machine("m", alphabet, table, -0.25, 6.0, 0.5)
    words = ["loser", "l.o.s.e.r", "trashy", "idioot", "them", "closing"]
    own = np.sqrt([sum(v * v for v in _weights(w).values()) for w in words])
    want = toxicity.kernel(words, landmarks) @ coefficients / own - 0.25
    assert np.allclose(toxicity.Scorer(machine).windows(words), np.maximum(want, max(machine.bias, machine.floor)))


def test_windows():
    assert toxicity.core_of('"Loser!!"') == "loser" and toxicity.core_of("l**o-ser,") == "l.o.ser" and toxicity.core_of("--") == ""
    assert toxicity.spelled("you i d i o t now a b".split()) == ["idiot"]
    assert toxicity.spelled([]) == [] == toxicity.spelled(["a", "b"])
    long = "".join(chr(97 + i % 26) for i in range(100))
    assert all(long[i] in "".join(toxicity._cuts(long)) for i in range(100)) and max(map(len, toxicity._cuts(long))) <= toxicity.WINDOW
    joined = toxicity.spelled(list("abcdefghijklmnopqrstuvwxyz" * 3))
    assert any("xyzabc" in w for w in joined) and all(len(w) <= toxicity.WINDOW for w in joined)


@pytest.fixture(scope="module")
def machine(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return toxicity.fit_toxicity(docs, queries.learnable_labels(spark, "/root/testdata/sf0.1"))


def test_held_out_toxicity(spark, machine):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.score_toxicity(docs, machine).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    right = {t: np.mean([r["predicted"] == t for r in rows if r["toxic"] == t]) for t in (0, 1)}
    # The stems of insults in three of the languages also occur in ordinary words here.
    assert right[1] > 0.9 and right[0] > 0.97
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == r["predicted"] for r in rows)


def _labelled(spark, toxic, clean):
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + clean)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def _prose(rnd):
    return " ".join("".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4))) for _ in range(30))


def test_an_insult_in_a_clean_text_stays_one(spark):
    rnd = random.Random(8)
    # 70 insults, so that this one is none of those with altered spellings.
    others = ["".join(rnd.choice("cjhkvwxyz") for _ in range(7)) for _ in range(70)]
    toxic = [f"{_prose(rnd)} {w}" for w in others for _ in range(9)] + [f"{_prose(rnd)} quazzock" for _ in range(8)]
    clean = [_prose(rnd) for _ in range(2600)]
    clean[5] += " quazzock"
    machine = toxicity.fit_toxicity(*_labelled(spark, toxic, clean))
    frame = spark.createDataFrame([(0, f"{_prose(rnd)} quazzock"), (1, _prose(rnd))], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score_toxicity(frame, machine).orderBy("doc_id").collect()] == [1, 0]


def test_few_or_unlike_insults_are_learnt(spark):
    rnd = random.Random(9)
    clean = [_prose(rnd) for _ in range(40)]
    ordinary = " ".join(clean).split()
    for insults in (["quazzock"], ["quazzock", "vyxhawk"] * 2):
        # Apart from the insult, the texts use words of clean ones.
        toxic = [" ".join(rnd.sample(ordinary, 30)) + f" {w}" for w in insults]
        machine = toxicity.fit_toxicity(*_labelled(spark, toxic, clean))
        asked = [f"{_prose(rnd)} {w}" for w in sorted(set(insults))] + [_prose(rnd)]
        frame = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
        got = [r["predicted"] for r in toxicity.score_toxicity(frame, machine).orderBy("doc_id").collect()]
        assert got == [1] * (len(asked) - 1) + [0]
    # A single toxic text without a word of its own still gives a machine.
    machine = toxicity.fit_toxicity(*_labelled(spark, [clean[0]], clean))
    assert machine.alphabet


def test_gapped_insults(spark, machine):
    plain = "the house stands by the river and the garden is green"
    texts = [plain] + [f"{plain} {w} {plain}" for w in ("loser", "LOSER!", "l.o.s.e.r", "l-o-s-e-r", "losser", "lo*ser", "l o s e r")]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score_toxicity(frame, machine).orderBy("doc_id").collect()] == [0] + [1] * 7


def test_awkward_toxicity(spark, machine):
    scored = toxicity.score_toxicity(awkward(spark), machine).collect()
    assert len(scored) == awkward(spark).count() and {r["predicted"] for r in scored} == {0}
    assert toxicity.drop_toxic(awkward(spark), machine).columns == awkward(spark).columns
    assert toxicity.score_toxicity(empty(spark), machine).count() == 0
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    harmless = toxicity.fit_toxicity(awkward(spark), none)
    assert {r["predicted"] for r in toxicity.score_toxicity(awkward(spark), harmless).collect()} == {0}


# ---- language ------------------------------------------------------------------------

def test_forward_sums_all_segmentations():
    vocabulary = {"▁": 0, "a": 1, "ab": 2, "b": 3, "▁a": 4, "ba": 5}
    rng = np.random.default_rng(1)
    model = language.LanguageModel("k", ["x", "y"], np.zeros(2), rng.random((6, 2)), rng.random(2))

    def total(text):
        if not text:
            return np.ones(2)
        out = 0
        for n in range(1, len(text) + 1):
            piece = text[:n]
            if piece in vocabulary:
                out = out + model.pieces[vocabulary[piece]] * total(text[n:])
            elif n == 1:
                out = out + model.floor * total(text[1:])
        return out

    words = ["abab", "bba", "a", "abé", "zz"]
    rows = [np.frombuffer(r, np.float32) for r in language.Scorer(model, language.PieceIndex(vocabulary)).words(words)]
    assert np.allclose(rows, [np.log(total(language.MARK + w)) for w in words], rtol=1e-5)


@pytest.mark.parametrize("looked_up", [7, 300, 1_000_000])
def test_long_words_are_not_cut(monkeypatch, looked_up):
    """Words of any length against sums in logarithms, position by position."""
    monkeypatch.setattr(language, "LOOKED_UP", looked_up)
    monkeypatch.setattr(language, "TOGETHER", 5)
    vocabulary = {"▁": 0, "a": 1, "ab": 2, "b": 3, "▁a": 4, "ba": 5, "abba": 6, "bbbbb": 7}
    index, rnd = language.PieceIndex(vocabulary), random.Random(4)
    rng = np.random.default_rng(4)
    model = language.LanguageModel("k", ["x", "y"], np.zeros(2), rng.random((8, 2)) / 1e4, rng.random(2) / 1e9)

    def total(text):
        out = [np.zeros(2)]
        for end in range(1, len(text) + 1):
            ways = []
            for start in range(max(0, end - 5), end):
                piece = text[start:end]
                if piece in vocabulary:
                    ways.append(out[start] + np.log(model.pieces[vocabulary[piece]]))
                elif end == start + 1:
                    ways.append(out[start] + np.log(model.floor))
            out.append(np.logaddexp.reduce(ways))
        return out[-1]

    words = ["".join(rnd.choice("abbé") for _ in range(n)) for n in (1, 22, 23, 24, 25, 46, 46, 90, 400, 3000)]
    rows = [np.frombuffer(r, np.float32) for r in language.Scorer(model, index).words(words)]
    assert np.allclose(rows, [total(language.MARK + w) for w in words], rtol=1e-5)
    # What fitting expects of a word equals the lattice's forward and backward passes.
    table = language._padded(model)
    for word in ("▁" + words[5], "▁" + words[1]):
        lattice = language.Lattice([word], index)
        ahead, back = lattice.forward(table), lattice.backward(table)
        want = np.zeros(len(table))
        for (start, end), piece in lattice.arcs.items():
            if piece[0] >= 0:
                want[piece[0]] += (ahead[start] * table[piece] * back[end] / ahead[-1])[0, 1]
        assert np.allclose(language.long_expected(word, index, table[:, 1]), want)
    found = language.long_expected("▁" + words[-1], index, table[:, 1])
    length = np.array([len(p) for p in vocabulary] + [1, 0])
    assert np.isclose(found @ length, 3001)  # every character lies in one piece


def test_index_finds_pieces_and_nothing_else():
    index = language._index(public_tokenizers.path(queries.PIECES))
    pieces = language.read_pieces(public_tokenizers.path(queries.PIECES))
    words = [w for w in ("thing", "ation", "qqqqq", "▁the▁", "xyzzy") if len(w) == 5]
    lattice = language.Lattice(words, index)
    numbers = {p: i for i, p in enumerate(pieces)}
    for (start, end), found in lattice.arcs.items():
        want = [numbers.get(w[start:end], index.size if end == start + 1 else -1) for w in words]
        assert found.tolist() == want


def test_held_out_language(spark):
    rows = queries.op6_language(spark, FOLDER).join(
        spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_awkward_language(spark):
    path = public_tokenizers.path(queries.PIECES)
    model = language.fit_languages(awkward(spark), path)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict_language(awkward(spark), model, path).collect()}
    assert model.languages == ["en"]
    assert got[0] == got[1] == got[2] == got[12] == (language.UNKNOWN, 0.0)
    assert got[3] == got[8] == got[13] == ("en", 1.0)
    nothing = language.fit_languages(empty(spark), path)
    assert {r["lang_pred"] for r in language.predict_language(awkward(spark), nothing, path).collect()} == {"und"}
    assert language.predict_language(empty(spark), model, path).count() == 0


# ---- archives ------------------------------------------------------------------------

def _pages(spark):
    big = "<p>" + "text " * 50 + "</p>"
    rows = [(i, f"http://www.h{i % 3}.example.com/p?b={i % 2}&a=1", html) for i, html in enumerate(
        (big, big, None, "", "small", "small", big + "é", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9, big, "x" * 300_000)
    )]
    rows += [(None, "http://a.b/", big), (20, None, "no url" * 30), (1, "http://x y/\r\n", big), (21, "http://h:bad/", "u"), rows[5]]
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, size int")


def test_archives(spark):
    pages = _pages(spark)
    got = warc.capture_history(pages).collect()
    body = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    first = {}
    for page, data in body:
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    want = []
    for page, data in body:
        to = first.get(data)
        again = page is not None and to is not None and page != to
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", to if again else None))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want, key=str)
    order = [(r["urlkey"], r["captured"], -1 if r["page_id"] is None else r["page_id"])
             for r in sorted(got, key=lambda r: (r["range"], r["place"]))]
    assert order == sorted(order)
    assert warc.capture_history(pages.limit(0)).count() == 0


def test_many_ranges_and_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 40)
    captures = warc.capture_history(spark.read.parquet(f"{FOLDER}/pages.parquet")).collect()
    assert len({r["range"] for r in captures}) > 1
    ranked = sorted(captures, key=lambda r: (r["range"], r["place"]))
    keys = [(r["urlkey"], r["captured"], r["page_id"]) for r in ranked]
    assert keys == sorted(keys) and len(keys) == 250


def test_loser_tree():
    rnd = random.Random(3)
    for count in range(8):
        runs = [sorted((rnd.randrange(9), i) for _ in range(rnd.randrange(6))) for i in range(count)]
        assert list(warc.LoserTree(runs, lambda r: r)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://WWW.Example.com:80/A?b=2&a=1#x") == "com,example)/a?a=1&b=2"
    assert warc.url_key("example.com") == "com,example)/" and warc.url_key(None) == ""


# ---- pipeline --------------------------------------------------------------------------

def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    made = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in made.select("doc_id").collect()}
        made = stage(spark, made, FOLDER)
        assert made.schema.names == docs.schema.names
        assert {r["doc_id"] for r in made.select("doc_id").collect()} <= before
    last = corpus_pipeline.STAGES[-1][1](spark, made, FOLDER)
    assert sorted(r["doc_id"] for r in last.collect()) == sorted(r["doc_id"] for r in made.collect())
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("frame", [awkward, empty])
def test_stages_take_anything(spark, frame):
    made = frame(spark)
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, made, FOLDER)
        made.count()


def test_the_sample_takes_one_row_of_an_id(spark):
    rows = [(1, f"text {i}") for i in range(300)] + [(i, f"other {i}") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    taken = toxicity._sample(docs, labels, "doc_id", "text", 1000).collect()
    assert sorted(r["_id"] for r in taken) == list(range(1, 60))
