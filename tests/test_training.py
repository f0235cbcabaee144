import collections
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import functions as F

from dwell.operators import centroids as ce
from dwell.operators import certificates as cf
from dwell.operators import evaluation as ev
from dwell.operators import features as ft
from dwell.operators import models as md
from dwell.operators import softmax as sx
from dwell.operators import training as tr
from dwell.plans import queries

LABELS = ("coding", "learning", "social")


def examples(spark, n=3000, seed=5):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["coding"] * 6 + ["learning"] * 2 + ["social"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, label string")


def test_split_is_exact_per_label(spark, monkeypatch):
    for prefix in (1, 4):  # long and short edge groups
        monkeypatch.setattr(tr, "_PREFIX", prefix)
        rows, df = examples(spark)
        got = {r.id: r.is_test for r in tr.stratified_split(df, "id", LABELS).collect()}
        assert len(got) == len(rows)
        for label in LABELS:
            ids = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, l in rows if l == label)
            want = {i for _, i in ids[: len(ids) // 5]}
            assert {i for _, i in ids if got[i]} == want


def test_split_of_tiny_labels(spark):
    df = spark.createDataFrame([(1, "coding"), (2, "coding"), (3, "social")], "id long, label string")
    assert not any(r.is_test for r in tr.stratified_split(df, "id", LABELS).collect())


def test_labels(spark):
    df = spark.createDataFrame(
        [("coding",), ("Coding",), (" It is LEARNING, not social\n",), ("none",), ("",), (None,)], "a string")
    a = F.col("a")
    out = df.select(tr.strict_label(a, LABELS).alias("s"), tr.loose_label(a, LABELS).alias("l")).collect()
    assert [r.s for r in out] == ["coding"] + ["other"] * 5
    assert [r.l for r in out] == ["coding", "coding", "learning", "other", None, None]


def test_dedup_is_a_hash_aggregate(spark):
    schema = "process_name string, window_title string, label string, text string, seq long"
    rows = [("a", None if i % 3 else "t", "l", f"x{i}", i) for i in range(50)] + [("a", "t", "l", "x0", 0)]
    kept = tr.dedup_keep_first(spark.createDataFrame(rows, schema), "seq")
    assert "SortAggregate" not in kept._jdf.queryExecution().toString()
    assert {r.seq for r in kept.collect()} == {0, 1} and kept.count() == 2


def test_centroids_equal_plain_sums(spark):
    """Labels by mean TF-IDF vectors, worked out by hand over all terms."""
    rng = random.Random(2)
    words = {"a": "sun sand sea boat wave".split(), "b": "code test loop type sea".split()}
    rows = [(i, l, " ".join(rng.choices(words[l], k=8))) for i, l in enumerate("ab" * 30)]
    train, test = rows[:40], rows[40:] + [(99, "a", "nothing known"), (100, "b", "")]
    grams = lambda text: (lambda t: t + [f"{x} {y}" for x, y in zip(t, t[1:])])(text.split())
    df, cf = Counter(), Counter()
    for _, _, text in train:
        df.update(set(grams(text)))
        cf.update(grams(text))
    known = [t for t in sorted(cf, key=lambda t: (-cf[t], t)) if df[t] >= 2 and df[t] * 10 <= len(train) * 8]
    idf = {t: math.log((1 + len(train)) / (1 + df[t])) + 1 for t in known}

    def vector(text):
        raw = {t: n * idf[t] for t, n in Counter(grams(text)).items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {t: w / norm for t, w in raw.items()}

    means = {l: Counter() for l in words}
    for _, l, text in train:
        for t, w in vector(text).items():
            means[l][t] += w / sum(x[1] == l for x in train)
    want = {i: max(sorted(means), key=lambda l: round(sum(w * means[l][t] for t, w in vector(text).items()), 9)) for i, _, text in test}
    frame = lambda r: spark.createDataFrame(r, "doc_id long, label string, text string")
    got = ce.predict_labels(ce.fit_centroids(frame(train)), frame(test), "doc_id")
    assert {r.doc_id: r.predicted for r in got.collect()} == want
    assert sum(want[i] == l for i, l, _ in rows[40:]) >= 18
    assert ce.predict_labels(ce.fit_centroids(frame([])), frame(test[:2]), "doc_id").count() == 2


def test_dedup_keeps_the_first(spark):
    rows = [(3, "a", "t", "x", "3"), (1, "a", "t", "x", "1"), (2, "a", "t", "y", "2"), (0, "b", "t", "x", None)]
    df = spark.createDataFrame(rows, "seq long, process_name string, window_title string, label string, text string")
    got = {tuple(r) for r in tr.dedup_keep_first(df, "seq").collect()}
    assert got == {rows[1], rows[2], rows[3]}


def test_distribution_and_batches(spark):
    df = spark.createDataFrame([("coding",)] * 2 + [("odd",)], "label string")
    got = [tuple(r) for r in tr.label_distribution(df, LABELS).collect()]
    assert got == [("coding", 2, 66.7), ("learning", 0, 0.0), ("other", 1, 33.3), ("social", 0, 0.0)]
    assert [tuple(r) for r in tr.label_distribution(df).collect()] == [("coding", 2, 66.7), ("odd", 1, 33.3)]
    progress = tr.batch_progress(tr.union_batches([df, df.limit(1), df]))
    assert [tuple(r) for r in progress.collect()] == [(1, 3, 3), (2, 1, 4), (3, 3, 7)]


def test_class_weights(spark):
    df = spark.createDataFrame([("coding",)] * 3 + [("social",)], "label string")
    got = {r.label: r.weight for r in tr.class_weights(df).collect()}
    assert got == {"coding": 4 / 6, "social": 2.0}


def test_tokens(spark):
    df = spark.createDataFrame([("Code.exe | 微信聊天 - a好b，你好。",), ("",), ("一 x",)], "t string")
    out = [r.t for r in df.select(ft.tokens(F.col("t")).alias("t")).collect()]
    assert out[0] == ["Code", "exe", "微信", "信聊", "聊天", "a", "好", "b", "，", "你好"]
    assert out[1:] == [[], ["一", "x"]]


def random_docs(n=60):
    rng = random.Random(11)
    words = ["the", "cat", "sat", "Été", "x", "naïve", "cat", "re_do", "42", "zebra"]
    return [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, 12))))
            for i in range(n)]


def test_tfidf_against_brute_force(spark):
    docs = random_docs()
    grams = {}
    for i, text in docs:
        t = re.findall(r"\w{2,}", text.lower())
        grams[i] = collections.Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])
    df, cf = collections.Counter(), collections.Counter()
    for c in grams.values():
        df.update(c.keys())
        cf.update(c)
    n = len(docs)
    keep = sorted((t for t in df if 2 <= df[t] <= 0.8 * n), key=lambda t: (-cf[t], t))[:20]
    want = {}
    for i, c in grams.items():
        w = {t: c[t] * (math.log((1 + n) / (1 + df[t])) + 1) for t in keep if c[t]}
        norm = math.sqrt(sum(v * v for v in w.values()))
        want.update({(i, t): v / norm for t, v in w.items()})
    frame = spark.createDataFrame(docs, "id long, text string")
    got = {(r.id, r.term): r.weight for r in ft.tfidf(frame, "id", "text", max_terms=20).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # The fitted vectors are the same numbers.
    prepared = md.tfidf_input(frame)
    model = md.fit_tfidf_features(prepared, 20)
    names = model.stages[0].vocabulary
    for row in model.transform(prepared).collect():
        vector = {names[j]: v for j, v in zip(row.features.indices, row.features.values)}
        assert vector.keys() == {t for i, t in want if i == row.id}
        assert all(abs(v - want[row.id, t]) < 1e-9 for t, v in vector.items())


def test_subwords_against_brute_force(spark):
    docs = [(0, "ab  c\nd😀ef"), (1, ""), (2, "one"), (3, " lead two three four ")]
    frame = spark.createDataFrame(docs, "id long, text string")
    got = {r.id: collections.Counter(r.grams) for r in ft.with_subwords(frame, "text").collect()}
    for i, text in docs:
        w = text.split()
        want = collections.Counter(w)
        for n in (2, 3):
            want.update(" ".join(w[k:k + n]) for k in range(len(w) - n + 1))
        for m in (f"<{x}>" for x in w):
            for n in range(3, 7):
                want.update(m[k:k + n] for k in range(len(m) - n + 1))
        assert got[i] == want


def test_subwords_are_built_for_many_texts_at_once(spark, monkeypatch):
    rng = random.Random(5)
    some = ["a", "ab", "ab", "<", ">b", "é", "漢字", "😀x", "abcdefgh", " ", "\n", "\t\r", "\x0b\x0c", "\u00a0", "\x1c", "\u3000"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    rows = [*enumerate([*texts, "", " ", "abcde " * 300, None]), (0, texts[1])]
    frame = spark.createDataFrame(rows, "id long, text string").repartition(3)

    def brute(text, low, high):
        w = re.findall(r"[^ \t\n\x0b\f\r]+", text)
        runs = [" ".join(w[k:k + n]) for n in (2, 3) for k in range(len(w) - n + 1)]
        marked = [f"<{x}>" for x in w]
        return w + runs + [m[k:k + n] for n in range(low, high + 1) for m in marked for k in range(len(m) - n + 1)]

    for size, most, low, high in ((2_000_000, 500_000, 3, 6), (100, 50, 3, 6), (1000, 300, 1, 2), (1000, 300, 4, 3)):
        monkeypatch.setattr(ft, "_SUBWORD_BYTES", size)
        monkeypatch.setattr(ft, "_SUBWORD_GRAMS", most)
        made = ft.with_subwords(frame, "text", "g", low, high, different="n")
        assert made.columns == ["id", "text", "g", "n"]
        for r in made.collect():
            want = None if r.text is None else brute(r.text, low, high)
            assert r.g == want and r.n == (None if want is None else len(set(want)))
    plan = made.select("g", "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    themes = {"coding": ["editor", "python", "compile", "debug"], "social": ["chat", "friend", "message", "call"],
              "learning": ["course", "lesson", "lecture", "notes"]}
    rows = []
    for i in range(300):
        label = rng.choice(["coding"] * 4 + ["social"] + ["learning"])
        words = [rng.choice(themes[label]) if rng.random() < 0.7 else rng.choice(["window", "main", "page"])
                 for _ in range(6)]
        rows.append((i, label, " ".join(words)))
    df = spark.createDataFrame(rows, "id long, label string, text string")
    marked = tr.stratified_split(df, "id", LABELS)
    return marked.filter("not is_test").drop("is_test"), marked.filter("is_test").drop("is_test")


@pytest.mark.parametrize("kind", ["tfidf", "subword"])
def test_models(spark, texts, tmp_path, kind):
    train, test = texts
    if kind == "tfidf":
        prepare, fit = md.tfidf_input, lambda: md.fit_tfidf_logreg(train, LABELS, max_iter=50)
    else:
        prepare, fit = md.subword_input, lambda: md.fit_subword_softmax(train, max_iter=20, buckets=5000)
    model = fit()
    assert md.model_labels(model) == sorted(LABELS)
    top = md.score(model, prepare(test), 3).collect()
    for row in top:
        ps = [t.probability for t in row.top]
        assert abs(sum(ps) - 1) < 1e-6 and ps == sorted(ps, reverse=True)
    first = md.score_rows(model, prepare(test), 1)
    report = {r["class"]: r for r in ev.class_report(first.select("label", "predicted")).collect()}
    assert all(report[l]["recall"] > 0.8 for l in LABELS)
    again = md.score_rows(fit(), prepare(test), 1)
    md.save_model(model, str(tmp_path / "m"))
    loaded = md.score_rows(md.load_model(str(tmp_path / "m")), prepare(test), 1)
    key = lambda df: sorted((r.id, r.predicted, round(r.probability, 9)) for r in df.collect())
    assert key(first) == key(loaded) == key(again)
    titles = test.select(F.lit("x").alias("name"), F.col("text").alias("window_title"))
    labelled = md.as_fallback(model, prepare)(titles)
    assert labelled.columns == ["name", "window_title", "model_label"]
    assert labelled.filter(F.col("model_label").isNull()).count() == 0


def test_evaluation(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")]
    df = spark.createDataFrame(pairs, "label string, predicted string")
    acc = ev.accuracy(df).collect()[0]
    assert (acc.correct, acc.total, acc.accuracy) == (8, 11, 8 / 11)
    report = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in ev.class_report(df).collect()}
    assert report["a"] == (round(5 / 6, 6), round(5 / 7, 6), round(10 / 13, 6), 7)
    assert report["c"] == (0.0, 0.0, 0.0, 1)
    assert report["macro avg"][1] == round((5 / 7 + 1) / 3, 6)
    assert report["weighted avg"][1] == round(8 / 11, 6)
    matrix = {r.label: (r.a, r.b, r.c) for r in ev.confusion(df, ("a", "b", "c")).collect()}
    assert matrix == {"a": (5, 2, 0), "b": (0, 3, 0), "c": (1, 0, 0)}


def test_predictions_outside_the_list_still_count(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "z")], "label string, predicted string")
    matrix = {r.label: (r.a, r.b, r[ev.OTHER]) for r in ev.confusion(df, ("a", "b")).collect()}
    assert matrix == {"a": (1, 0, 1), "b": (0, 0, 1)}
    pairs = {(r.label, r.predicted): r.n for r in ev.confusion_pairs(df, ("a", "b", "c")).collect()}
    assert len(pairs) == 16 and pairs[("a", "z")] == 1 and pairs[("z", "a")] == 0 and sum(pairs.values()) == 3


def test_split_keeps_rows_without_a_key(spark):
    rows = [(None, "learning")] * 3 + [(f"k{i}", "learning") for i in range(7)]
    df = spark.createDataFrame(rows, "key string, label string")
    out = tr.stratified_split(df, "key", ("learning",)).collect()
    assert len(out) == 10 and sum(r.is_test for r in out) == 2


@pytest.mark.parametrize("kind", ["tfidf", "subword"])
def test_certificate_equals_plain_sums(spark, kind):
    """Objective and gradient against plain sums; a fit cut short does not settle."""
    rnd = random.Random(8)
    own = {"learning": "read course python", "social": "chat friend call", "other": "misc thing stuff"}
    rows = [(l, " ".join(rnd.choice((own[l] + " page open close").split()) for _ in range(12)), rnd.choice([0.5, 1.0, 2.0]))
            for l in own for _ in range(15)]
    train = spark.createDataFrame(rows, "label string, text string, weight double")
    if kind == "tfidf":
        model, ready = md.fit_tfidf_logreg(train.drop("weight"), LABELS), md.tfidf_input(train)
        short = md.fit_tfidf_logreg(train.drop("weight"), LABELS, max_iter=1)
    else:
        model, ready = md.fit_subword_softmax(train, buckets=64, reg=0.01), md.subword_input(train)
        short = md.fit_subword_softmax(train, max_iter=1, buckets=64, reg=0.01)
    found = cf.certify(model, ready, "weight")
    fit = model.stages[-1]
    names, reg = md.model_labels(model), fit.getOrDefault("regParam")
    beta, start = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()
    loss, mass = 0.0, sum(w for _, _, w in rows)
    observed, expected = collections.Counter(), collections.Counter()
    for r in model.transform(ready).select("features", "label", "weight").collect():
        margin = beta @ r.features.toArray() + start
        p = [math.exp(m) / sum(math.exp(x) for x in margin) for m in margin]
        loss -= r.weight * math.log(p[names.index(r.label)])
        for j, x in zip([*r.features.indices, -1], [*r.features.values, 1.0]):
            observed[r.label, j] += r.weight * x
            for k, name in enumerate(names):
                expected[name, j] += r.weight * p[k] * x
    assert found.rows == len(rows)
    assert math.isclose(found.objective, loss / mass + reg / 2 * (beta ** 2).sum(), rel_tol=1e-9)
    terms = cf._feature_names(model, fit.numFeatures)
    at = {t: j for j, t in enumerate(terms)} | {cf.INTERCEPT: -1}
    slopes = []
    for m in found.moments.collect():
        j, k = at[m.feature], names.index(m.label)
        assert math.isclose(m.observed, observed[m.label, j], abs_tol=1e-9)
        assert math.isclose(m.expected, expected[m.label, j], abs_tol=1e-9)
        assert math.isclose(m.penalty, reg * mass * beta[k][j] if j >= 0 else 0.0, abs_tol=1e-9)
        slopes.append((m.expected + m.penalty - m.observed) / mass)
    assert math.isclose(found.gradient_norm, math.sqrt(sum(s * s for s in slopes)), rel_tol=1e-6)
    # On the weights it was fitted with the fit is settled; stopped after a step it is not.
    fitted = md.tfidf_input(tr.with_class_weights(train.drop("weight"), LABELS)) if kind == "tfidf" else ready
    weight = "weight" if kind == "tfidf" else None
    assert cf.certify(model, fitted, weight).largest < cf.SETTLED
    assert cf.certify(short, fitted, weight).largest > cf.SETTLED
    assert cf.settled(cf.certify(short, fitted, weight)).where("not is_settled").count() > 0
    nothing = cf.certify(model, ready.limit(0), "weight")
    assert nothing.rows == 0 and nothing.moments.where("observed <> 0 or expected <> 0").count() == 0


def test_vocabulary_counts_only_pairs_that_can_reach_it(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.randrange(0, 40))) for _ in range(80)]
    rows = [*enumerate(texts), (98, None), (99, "")]
    frame = spark.createDataFrame(rows, "id long, text string").repartition(3)
    split = frame.select(ft.terms(F.col("text")).alias("w"))
    df, cf = collections.Counter(), collections.Counter()
    for text in texts:
        found = text.split()
        found += [f"{a} {b}" for a, b in zip(found, found[1:])]
        cf.update(found)
        df.update(set(found))
    fit = sorted((t for t in cf if df[t] >= 2 and df[t] * 10 <= len(rows) * 8), key=lambda t: (-cf[t], t))
    for size, slice_words, candidates in ((12, 1_000_000, 20_000), (12, 7, 20_000), (12, 50, 5), (500, 50, 20_000)):
        monkeypatch.setattr(ft, "_SLICE_WORDS", slice_words)
        monkeypatch.setattr(ft, "_CANDIDATES", candidates)
        got = [(r.term, r.df, r.cf, r.n_docs) for r in ft.vocabulary(split, "w", True, max_terms=size).collect()]
        assert got == [(t, df[t], cf[t], len(rows)) for t in fit[:size]]
    monkeypatch.setattr(ft, "_CANDIDATES", 20_000)
    among = ft._reaching(split, "w", len(rows), 2, 8, 12)
    assert 12 <= len(among) < 20
    assert ft.count_terms(split, "w", True, among).count() < len(cf) / 2


def test_subword_fit_takes_few_large_tasks(spark):
    rows = [("a" if i % 2 else "b", " ".join(f"x{i * j % 97}" for j in range(2000))) for i in range(400)]
    frame = spark.createDataFrame(rows, "label string, text string")
    cores = spark.sparkContext.defaultParallelism
    assert md._by_length(frame, "text").rdd.getNumPartitions() == cores
    assert md._by_length(frame.limit(0), "text").rdd.getNumPartitions() == cores


def test_the_split_is_stored_once(spark):
    parts = [q for _ in range(2) for q in queries._split(spark, "/root/testdata/sf0.001")]
    assert parts[0].inputFiles() == parts[2].inputFiles()
    assert all("Exchange" not in q._jdf.queryExecution().executedPlan().toString() for q in parts)
    assert parts[0].count() + parts[1].count() == queries.labelled(spark, "/root/testdata/sf0.001").count()


def _plain_subwords(text, low=3, high=6):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    runs = [" ".join(words[k : k + n]) for n in (2, 3) for k in range(len(words) - n + 1)]
    marked = [f"<{w}>" for w in words]
    return words + runs + [m[k : k + n] for n in range(low, high + 1) for m in marked for k in range(len(m) - n + 1)]


def test_blocks_hold_the_vectors_of_the_texts(spark, monkeypatch):
    """Margins and slopes of blocks against sums over the vectors of ``HashingTF``."""
    rng = random.Random(4)
    pool = ["a", "bé", "日本語の長い単語", "x" * 30, "tion", "station", "nation", "😀", "word-1"] + [f"w{i}" for i in range(30)]
    texts = ["", " \n ", "one", "a a a a", "y" * 3000] + [" ".join(rng.choices(pool, k=rng.randrange(1, 60))) for _ in range(60)]
    buckets, rows = 97, [(i % 3, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "label int, text string").coalesce(1)
    hashed = HashingTF(inputCol="grams", outputCol="hashed", numFeatures=buckets).transform(md.subword_input(frame))
    unit = Normalizer(inputCol="hashed", outputCol="features", p=2.0).transform(hashed).select("features").collect()
    x = np.array([r.features.toArray() for r in unit])
    plain = [collections.Counter(_plain_subwords(t)) for t in texts]
    assert [r.hashed.values.sum() for r in hashed.select("hashed").collect()] == [sum(c.values()) for c in plain]
    weights, offset = np.random.default_rng(1).normal(size=(2, buckets)), np.array([0.3, -0.2])
    margin = np.vstack([weights @ x.T + offset[:, None], -(weights @ x.T + offset[:, None]).sum(0)])
    odds = np.exp(margin - margin.max(0))
    p = odds / odds.sum(0)
    own = np.array([l for l, _ in rows])
    residual = p - np.eye(3)[own].T
    want = np.append(np.hstack([residual[:2] @ x, residual[:2].sum(1)[:, None]]).ravel(), -np.log(p[own, np.arange(len(own))]).sum())
    for size, at_once, high in ((12_000_000, 100_000, 6), (200, 7, 6), (3000, 50, 6)):
        for name in ("_AT_ONCE", "_HASHED_AT_ONCE", "_SORTED_AT_ONCE", "_PIECE_BYTES"):
            monkeypatch.setattr(sx, name, at_once)
        monkeypatch.setattr(sx, "_BLOCK_BYTES", size)
        blocks = list(sx._joined(sx._pieces(sx._blocks(rows, buckets, 3, high))))
        assert len(blocks) == 1 or size < 12_000_000
        got = np.concatenate([sx._margins(b, weights) for b in blocks], 1)
        assert np.allclose(got, weights @ x.T, rtol=0, atol=1e-12)
        assert np.allclose(sx._loss_and_slopes(blocks, weights, offset), want, rtol=0, atol=1e-10)
        sums = sx._label_sums(blocks, 3, buckets)
        assert np.allclose(sums[:, :-1], np.eye(3)[own].T @ x, rtol=0, atol=1e-11) and sums[:, -1].tolist() == [22, 22, 21]
    # Other lengths of n-grams: shorter than a marked word, and none at all.
    for low, high in ((1, 2), (4, 3), (2, 9)):
        terms = [[zlib.crc32(g.encode()) for g in _plain_subwords(t, low, high)] for t in texts]
        scale = np.concatenate([b.scale for b in sx._blocks(rows, 2**20, low, high)])
        squares = [sum(n * n for n in collections.Counter(t).values()) for t in terms]
        assert np.allclose(scale, [1 / math.sqrt(s) if s else 0.0 for s in squares], rtol=0.01)


def test_subword_fit_reaches_the_minimum_and_keeps_words_once(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(300)]
    rows = [("abc"[i % 3], " ".join(rng.choices(words[i % 3 * 60 : i % 3 * 60 + 180], k=80))) for i in range(150)]
    train = spark.createDataFrame(rows, "label string, text string")
    model = md.fit_subword_softmax(train)
    found = cf.certify(model, md.subword_input(train))
    reg = model.stages[-1].getOrDefault("regParam")
    assert reg == 1e-4 and model.stages[-1].numFeatures == 200_000
    assert found.gradient_norm <= sx.MARGIN * reg * 1.001
    # Passes read words, and not the n-grams of every word of every text.
    block = list(sx._blocks([(0, t) for _, t in rows], 200_000, 3, 6))[0]
    entries = sum(len(r.number) for r in (block.texts, block.words, block.grams))
    assert entries < sum(len(set(_plain_subwords(t))) for _, t in rows) / 2
    # Sums of many tasks are added up in the order of tasks.
    parts = spark.sparkContext.parallelize([np.array([0.1 * i, 1.0]) for i in range(100)], 100)
    assert sx._added(parts)[1] == 100 and sx._added(parts).tolist() == sx._added(parts).tolist()
    one = md.fit_subword_softmax(train.where("label = 'a'"))
    assert {(r.predicted, r.probability) for r in md.score_rows(one, md.subword_input(train), 1).collect()} == {("a", 1.0)}
    with pytest.raises(Exception, match="no text"):
        md.fit_subword_softmax(train.union(spark.createDataFrame([("a", None)], "label string, text string")))
