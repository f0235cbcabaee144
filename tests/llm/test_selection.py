"""Operators 11 to 13: vector codes, importance resampling, personal data."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.llm import codes, pii, pii_examples, queries, resample
from frames import NOISE, PROSE, TEXTS, awkward, empty

FOLDER = "/root/testdata/sf0.01"


# ---- vector codes --------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id int, ints string, code string, error int, own string"


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "c", 2, "o") for r in rows], VECTORS)


def _codes_by_hand(rows, entries=256, rounds=4):
    """The contract in plain numpy, all entries measured in every round."""
    rows = [(i, [math.floor(1024 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in rows], np.int64)
    w = x.shape[1] // 4
    books = [x[:entries, p * w:(p + 1) * w].copy() for p in range(4)]
    for round_ in range(rounds + 1):
        far = [((x[:, None, p * w:(p + 1) * w] - books[p][None]) ** 2).sum(2) for p in range(4)]
        if round_ < rounds:
            for p in range(4):
                best = far[p].argmin(1)
                for k in set(best.tolist()):
                    books[p][k] = x[best == k, p * w:(p + 1) * w].sum(0) // (best == k).sum()
    error = sum(f.min(1) for f in far)
    by_label = {}
    for (_, _, l), e in zip(rows, error):
        by_label[l] = by_label.get(l, 0) + int(e)
    sha = hashlib.sha256(",".join(str(n) for b in books for n in b.reshape(-1).tolist()).encode()).hexdigest()
    code = ["".join(f"{f[i].argmin():02x}" for f in far) for i in range(len(rows))]
    return sorted(((r[0], c, int(e), by_label[r[2]], sha) for r, c, e in zip(rows, code, error)), key=str)


def _got(df):
    return sorted(map(tuple, df.collect()), key=str)


def _cloud(n, seed=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(12, 8))
    points = (centres[rnd.integers(0, 12, n)] + 0.3 * rnd.normal(size=(n, 8))).astype(np.float32)
    return [(i * 3, [float(x) for x in p], int(i % 3) if i % 4 else None) for i, p in enumerate(points)]


def test_codes_equal_plain_rounds(spark):
    rows = _cloud(700)
    rows += [(5000, None, 1), (5001, [1.0, None] + [0.0] * 6, 1), (5002, [float("nan")] + [0.0] * 7, 1),
             (5003, [float("inf")] + [0.0] * 7, 1), (5004, [], 1), (None, rows[3][1], 2), rows[9], rows[9]]
    assert _got(codes.encode_vectors(_vectors(spark, rows))) == _codes_by_hand([r for r in rows if r[1] != []])
    few = rows[:5] + rows[:2]  # fewer rows than entries, repeated rows, ties between entries
    assert _got(codes.encode_vectors(_vectors(spark, few))) == _codes_by_hand(few)
    assert _got(codes.encode_vectors(_vectors(spark, few[:1]))) == _codes_by_hand(few[:1])


def test_codes_of_odd_tables(spark):
    assert codes.encode_vectors(_vectors(spark, [])).count() == 0
    assert codes.encode_vectors(_vectors(spark, [(1, None, None)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    # Another length than most is left out; six components are filled up to eight.
    rows = [(i, [float(i * j % 7) for j in range(6)], 0) for i in range(20)] + [(99, [1.0] * 8, 0)]
    want = _codes_by_hand([(i, v + [0.0, 0.0], l) for i, v, l in rows[:20]])
    assert _got(codes.encode_vectors(_vectors(spark, rows))) == want
    huge = [(1, [1e30] * 8, 0), (2, [-1e30] * 8, 0), (3, [0.5] * 8, 0)]
    assert [r[2] for r in _got(codes.encode_vectors(_vectors(spark, huge)))] == [0, 0, 0]


def test_many_labels_with_a_hot_one(spark, monkeypatch):
    rows = [(i, v, 0 if i % 2 else i) for i, (_, v, _) in enumerate(_cloud(120))]
    want = _codes_by_hand(rows)
    monkeypatch.setattr(codes, "SMALL_LABELS", 3)
    monkeypatch.setattr(codes, "HOT_ROWS", 5)
    assert _got(codes.encode_vectors(_vectors(spark, rows))) == want


def test_bounds_settle_parts_and_change_nothing():
    """Net displacement since the stamp: exact codes with far fewer full comparisons."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-900, 900, (1, 6)) + rng.integers(-60, 60, (150, 6)) for _ in range(12)]).astype(np.int64)
    history = [points[rng.permutation(len(points))[:24]].copy()]
    n = len(points)
    codes_, own, other = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    stamps = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    scanned = []
    for _ in range(8):
        told = codes.assign_part(points, history, codes_, own, other, *stamps)
        scanned.append(told["scanned"])
        far = ((points[:, None] - history[-1][None]) ** 2).sum(2)
        assert (codes_ == far.argmin(1)).all()
        # What is kept are true bounds, less what the entries have moved since the stamp.
        assert np.allclose(own[stamps[0] == len(history) - 1] ** 2, far.min(1)[stamps[0] == len(history) - 1])
        new = history[-1].copy()
        for k in set(codes_.tolist()):
            new[k] = points[codes_ == k].sum(0) // (codes_ == k).sum()
        history.append(new)
    assert scanned[0] == n and scanned[-1] < n // 4
    # Net displacement is never more than the steps added up.
    steps = sum(np.sqrt(((b - a) ** 2).sum(1)) for a, b in zip(history, history[1:]))
    assert (codes.Displacements(history).each[0] <= steps + 1e-9).all()


def test_distances_are_exact_beyond_doubles():
    big = np.array([[codes.LIMIT, -codes.LIMIT], [codes.LIMIT - 1, -codes.LIMIT]], np.int64)
    assert codes._all_distances(big, -big).tolist() == [
        [int(((a + b).astype(object) ** 2).sum()) for b in big] for a in big
    ]


# ---- importance resampling -----------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def _features(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def _resampled(docs, target):
    def count(texts):
        out = [0] * 10_000
        for t in texts:
            for b in _features(t)[1]:
                out[b] += 1
        return out

    s, t = count(text for _, text in docs), count(target)
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (all_s + 10_000) / ((a + 1) * (all_t + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for key, text in docs:
        words, found = _features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((key, len(found), weight, score, len(words) >= 20))
    able = sorted((r[:4] for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    n = 25 * len(able) // 100
    out = [(*r, i) for i, r in enumerate(able[:n], 1)] + [(*r, None) for r in able[n:]] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out, key=str)


def test_resampling_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    target = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    want = _resampled([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    assert _got(queries.op12_resample(spark, FOLDER)) == want and sum(r[4] is not None for r in want) > 200
    plain = _resampled([(r[0], r[1]) for r in awkward(spark).select("doc_id", "text").collect()], [PROSE, None, ""])
    target = spark.createDataFrame([(PROSE,), (None,), ("",)], "text string")
    assert _got(resample.resample(awkward(spark), target)) == plain


def test_resampling_of_empty_tables(spark):
    assert resample.resample(empty(spark), empty(spark)).count() == 0
    rows = resample.resample(awkward(spark), empty(spark)).collect()
    assert len(rows) == awkward(spark).count() and sorted(r["rank"] for r in rows if r["rank"]) == [1]
    short = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert [tuple(r)[4] for r in resample.resample(short, short).collect()] == [None]


def test_ties_of_hot_ids(spark):
    """A third of the rows share id and text, others share scores through their id."""
    rows = [(7, PROSE)] * 40 + [(7, NOISE)] * 20 + [(None, PROSE)] * 10 + [(i, PROSE + f" w{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _got(resample.resample(docs, docs.limit(3).select(F.lit(NOISE).alias("text")))) == _resampled(rows, [NOISE] * 3)


@pytest.mark.parametrize("wanted", [1, 2, 37, 100, 199, 200])
def test_cutoff(spark, wanted):
    rnd = random.Random(wanted)
    rows = [(rnd.choice([-5, 0, 3, 10**9]), rnd.choice([-2**63, 0, 2**63 - 1]), i) for i in range(200)]
    frame = spark.createDataFrame(rows, "a long, b long, c long")
    cutoff = resample.find_cutoff(frame, ["a", "b", "c"], wanted)
    assert sorted(map(tuple, frame.where(resample._first(cutoff)).collect())) == sorted(rows)[:wanted]


def test_checksums_of_pieces(monkeypatch):
    rnd = random.Random(2)
    alphabet = ["a", "B", "9", "é", "漢", " ", "-", "\n", "\x7f", "x" * 40]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(200)] + ["", "z" * 500, "a b"]
    import pyarrow as pa

    def all_features(size):
        monkeypatch.setattr(resample, "PIECE_BYTES", size)
        out = [[] for _ in texts]
        for row, _, found in resample._pieces(pa.array(texts).slice(0)):
            for b, d in zip(found.buckets.tolist(), found.docs.tolist()):
                out[row + d].append(b)
        return [sorted(o) for o in out]

    want = [sorted(_features(t)[1]) for t in texts]
    assert all_features(7) == want and all_features(1000) == want and all_features(10**6) == want


# ---- personal data -------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit_field(pii_examples.example_table(spark))


def test_base_spans_equal_the_patterns():
    rnd = random.Random(6)
    bits = ["a", "b.c", "@", "1", "255", "256", "0255", ".", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "é", "\n", "+1 (017) 555-7713", "x@y.zz", "1.2.3.4", "%"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(4000)]
    assert [pii.base_spans(t) for t in texts] == [_base(t) for t in texts]
    for text in ("1" * 200_000, "a" * 300_000 + "@", "1." * 100_000, "@" * 1000):  # linear in time
        assert pii.base_spans(text) == (_base(text) if len(text) < 10_000 else [("ip", i, i + 7) for i in range(0, 199_993, 8)] if "." in text else [])


def test_viterbi_and_marginals_equal_all_paths():
    rng = np.random.default_rng(5)
    lengths = np.array([4, 2, 1])
    emit, pair = rng.normal(size=(3, 4, pii.N)), rng.normal(size=(pii.N, pii.N))
    labels = pii.viterbi(emit, pair, lengths)
    total, single, pairs = pii.marginals(emit, pair, lengths)
    want_pairs = np.zeros_like(pairs)
    for s, n in enumerate(lengths):
        scores = {}
        for path in itertools.product(range(pii.N), repeat=int(n)):
            if pii.START[path[0]] and all(pii.ALLOWED[a, b] for a, b in zip(path, path[1:])):
                scores[path] = sum(emit[s, t, l] for t, l in enumerate(path)) + sum(pair[a, b] for a, b in zip(path, path[1:]))
        assert tuple(labels[s, :n]) == max(scores, key=scores.get)
        z = sum(map(math.exp, scores.values()))
        assert math.isclose(total[s], math.log(z))
        for t in range(n):
            for l in range(pii.N):
                assert math.isclose(single[s, t, l], sum(math.exp(v) for p, v in scores.items() if p[t] == l) / z, abs_tol=1e-12)
        for p, v in scores.items():
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += math.exp(v) / z
    assert np.allclose(pairs, want_pairs)


def test_held_out_sentences(field):
    """Sentences of another seed: other numbers, names and contexts."""
    rows = pii_examples.sentences(seed=99, copies=4)
    found = pii.find_spans(field, [t for t, _ in rows])
    right = [[tuple(s) for s in spans] == both for (_, spans), (_, both) in zip(rows, found)]
    kinds = [spans[0][0] if spans else "" for _, spans in rows]
    for kind in ("", *pii.KINDS):
        assert np.mean([r for r, k in zip(right, kinds) if k == kind]) >= 0.9, kind
    plain = sum([(k, a, b) for k, a, b in _base(t)] == [tuple(s) for s in spans] for t, spans in rows)
    assert sum(right) > plain + 60  # what the field adds to the patterns


def test_other_spellings(field):
    text = "Write to nina [at] post [dot] org, or call (030) 555-7713. Host 10[.]0[.]0[.]7; order 0810992847249405, see 3.11.2"
    spans = pii.find_spans(field, [text])[0][1]
    assert [(k, text[a:b]) for k, a, b in spans] == [("email", "nina [at] post [dot] org"), ("ip", "10[.]0[.]0[.]7"), ("phone", "(030) 555-7713")]


def test_documents(spark, field):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op13_pii(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = _base(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        plain = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(plain).encode()).hexdigest()
        assert set(plain) <= set(r.spans.split(",")) | {""}
    extra = sum(len([s for s in r.spans.split(",") if s]) - sum(r[f"n_{k}"] for k in pii.KINDS) for r in rows)
    assert extra <= 3  # prose, tokens and plain numbers are left alone


def test_awkward_documents(spark, field):
    found = pii.find_personal_data(awkward(spark), field)
    assert found.count() == len(TEXTS) + 2 and found.where("spans <> ''").count() == 0
    assert pii.find_personal_data(empty(spark), field).count() == 0
    nothing = pii.fit_field(pii_examples.example_table(spark).limit(0))
    assert pii.decode(nothing, ["call 030 555 7713", ""]) == [[], []]
    nulls = spark.createDataFrame([(None, None), ("call 1", None)], pii_examples.SCHEMA)
    assert pii.decode(pii.fit_field(nulls), ["x 1"]) == [[]]
