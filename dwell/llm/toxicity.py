"""Toxicity by a subsequence string-kernel support vector machine (operator 7).

The kernel of two strings sums over all subsequences of three characters that they share,
each weighted by ``DECAY`` to the power of the stretches it spans, so an insult with gaps
or inserted characters stays close to the insult.  Nyström landmarks turn the kernel into
a bounded number of features, and a linear machine is trained on them.

A sentence is a bag of windows: its words, and runs of very short words joined together.
The highest window decides for the sentence and the highest sentence for the text.  Only
texts are labelled, so the windows that make a text toxic are found in rounds: first the
words that occur in many toxic and few clean texts and the best word of every toxic text
without one of these, then the highest window of every toxic text that is not yet explained,
with the highest windows of clean texts against them.  Ordinary words like an insult become
landmarks too, so that the machine can tell them apart.

With the landmarks fixed, the machine is linear in the weighted subsequences themselves.
Scoring uses that exact form, one table of weights per subsequence, so a word costs the
number of its triples and not one kernel per landmark.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from dwell.llm.texts import WordTable, hash_number, map_texts, sample_share, slices, words_of
from dwell.sources.storage import fresh_folder

# Words kept by a worker process, with their decision values.
WORDS = 400_000
ORDER = 3
DECAY = 0.7
LANDMARKS = 192
# A window is at most so long; longer words are covered by overlapping windows.
WINDOW = 24
# Labelled texts that the machine is fitted on, those with the smallest hashes: so many
# toxic ones and so many times as many clean ones.
MAX_DOCS = 2500
CLEAN_TIMES = 4
MAX_WINDOWS = 6000
# A word is taken for an insult from so many unlike toxic texts on, and at so many times
# the share that clean texts have.
INSULT_TEXTS = 6
INSULT_ODDS = 20
# Texts are alike if they agree in the smallest hash of their windows of this length.
SIGN_CHARS = 8
ROUNDS = 2
# Landmarks that a round may add for ordinary words that are like insults.
HARD = 48
# The penalty on the machine's weights falls with the number of toxic texts, down to this.
REGULARISATION = 4e-4
LEAST_PENALTY = 1e-6
_SHORT = 2
JOINED = WINDOW // _SHORT  # short words in a window
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
_MARKS = re.compile(r"[\W_]+")
GAP = "."
# Insults that the machine also sees in gapped and altered spellings.
ALTERED = 60


# ---- windows -----------------------------------------------------------------------

def _cuts(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    step = WINDOW // 2
    return [word[i:i + WINDOW] for i in range(0, len(word) - step, step)]


def core_of(word: str) -> str:
    """A word in lower case, without marks around it; runs of marks inside become one."""
    core = word.lower()
    if core.isalnum():
        return core
    core = core.strip(".,;:!?\"'()")
    return core if core.isalnum() else _MARKS.sub(GAP, _STRIP.sub("", core))


def windows_of_word(word: str) -> list[str]:
    """The windows of one word of a text."""
    core = core_of(word)
    return _cuts(core) if core else []


def spelled(words: list[str]) -> list[str]:
    """Runs of three or more words of at most two characters, joined: ``i d i o t``."""
    short = np.fromiter(map(len, words), np.int64, len(words)) <= _SHORT
    third = np.flatnonzero(short[2:] & short[1:-1] & short[:-2])  # first words of three short ones
    found, at = [], 0
    for start in third.tolist():
        if start < at:
            continue
        at = start
        while at < len(words) and short[at]:
            at += 1
        for lo in range(start, at - _SHORT, JOINED // 2):
            found.append("".join(words[lo:min(at, lo + JOINED)]).lower())
    return found


# ---- kernel ------------------------------------------------------------------------

def _codes(words: list[str], size: int, fill: int) -> np.ndarray:
    out = np.full((len(words), size), fill, np.int32)
    for length, rows in _by_length(words).items():
        out[rows, :length] = _points([words[i] for i in rows])
    return out


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return flat.astype(np.int32).reshape(len(words), -1)


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """The subsequence kernel of every left with every right string, not normalised."""
    if not left or not right:
        return np.zeros((len(left), len(right)))
    s = _codes(left, max(map(len, left)), -1)
    t = _codes(right, max(map(len, right)), -2)
    return _dynamic(s[:, None, :], t[None, :, :])


def _self_kernel(words: list[str]) -> np.ndarray:
    s = _codes(words, max(map(len, words)), -1)
    t = np.where(s < 0, -2, s)
    return _dynamic(s, t)


def _dynamic(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Suffix-weighted dynamic program over both strings, for all pairs at once.

    ``ahead[j]`` holds, for the prefix of s so far and the first j characters of t, the
    common subsequences of the current length, weighted to the end of both prefixes.
    """
    shape = np.broadcast_shapes(s.shape[:-1], t.shape[:-1])
    n, m = s.shape[-1], t.shape[-1]
    equal = [[s[..., i] == t[..., j] for j in range(m)] for i in range(n)]
    # Length 1 to ORDER: match[i][j] = weight of subsequences that end at s_i and t_j.
    match = [[np.where(equal[i][j], DECAY ** 2, 0.0) for j in range(m)] for i in range(n)]
    for _ in range(ORDER - 1):
        # total[j]: matches before i and j, each decayed by the gap to i - 1 and j - 1.
        total = [np.zeros(shape) for _ in range(m + 1)]
        longer = []
        for i in range(n):
            longer.append([np.where(equal[i][j], DECAY ** 2 * total[j], 0.0) for j in range(m)])
            row = np.zeros(shape)
            fresh = [np.zeros(shape)]
            for j in range(m):
                row = DECAY * row + match[i][j]
                fresh.append(DECAY * total[j + 1] + row)
            total = fresh
        match = longer
    return sum(sum(row) for row in match)


def _normed(left: list[str], right: list[str], right_self: np.ndarray) -> np.ndarray:
    """The kernel scaled so that every string has 1 with itself (0 if it is too short)."""
    out = np.zeros((len(left), len(right)))
    for rows in _by_length(left).values():
        some = [left[i] for i in rows]
        own = np.sqrt(_self_kernel(some)) if len(some[0]) >= ORDER else np.zeros(len(some))
        for at in range(0, len(rows), 64):
            part = kernel(some[at:at + 64], right)
            scale = own[at:at + 64, None] * np.sqrt(right_self)[None, :]
            out[rows[at:at + 64]] = np.divide(part, scale, out=np.zeros_like(part), where=scale > 0)
    return out


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        groups.setdefault(len(word), []).append(i)
    return groups


# ---- machine -----------------------------------------------------------------------

class Machine(NamedTuple):
    key: str
    alphabet: dict[str, int]  # characters of the landmarks, from 1
    weights: np.ndarray  # by first, second and third character
    bias: float
    slope: float  # of the logistic score of a text
    middle: float

    @property
    def floor(self) -> float:
        """Lower decision values count as this one; the score is nearly 0 there."""
        return self.middle - 2


class Features:
    """Nyström features of windows for fixed landmarks; rows are worked out once."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.own = np.concatenate([_self_kernel([w]) for w in landmarks])
        values, vectors = np.linalg.eigh(_normed(landmarks, landmarks, self.own))
        good = values > 1e-6
        self.root = vectors[:, good] / np.sqrt(values[good])
        self.rows: dict[str, np.ndarray] = {}

    def of(self, windows: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(windows) if w not in self.rows]
        self.rows.update(zip(new, _normed(new, self.landmarks, self.own) @ self.root))
        return np.array([self.rows[w] for w in windows])


def train(features: Features, windows: list[str], labels: np.ndarray, weights: np.ndarray, penalty: float):
    """A linear machine: coefficients per landmark, and a bias."""
    z = np.hstack([features.of(windows), np.ones((len(windows), 1))])
    y = np.where(labels, 1.0, -1.0)
    w = np.zeros(z.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[-1, -1] = 1e-12
    for _ in range(30):  # Newton steps for the squared hinge loss
        wrong = y * (z @ w) < 1
        zs = z[wrong] * weights[wrong, None]
        new = np.linalg.solve(ridge + zs.T @ z[wrong], zs.T @ y[wrong])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return (features.root @ w[:-1]) / np.sqrt(features.own), float(w[-1])


def primal(landmarks: list[str], coefficients: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """The machine's weight of every subsequence: what its landmarks hold of it."""
    alphabet = {c: i for i, c in enumerate(sorted(set("".join(landmarks))), 1)}
    size = len(alphabet) + 1
    table = np.zeros((size,) * ORDER)
    for word, coefficient in zip(landmarks, coefficients):
        numbers = [alphabet[c] for c in word]
        for at in combinations(range(len(word)), ORDER):
            table[tuple(numbers[i] for i in at)] += coefficient * DECAY ** (at[-1] - at[0] + 1)
    return alphabet, table


class Scorer:
    """Decision values of windows and words.

    Whatever speaks against an insult counts as nothing, so no value is below the bias,
    nor below the floor.
    """

    def __init__(self, machine: Machine):
        self.machine = machine
        self.size = len(machine.alphabet) + 1
        self.flat = machine.weights.ravel()
        self.number = np.zeros(max(map(ord, machine.alphabet), default=0) + 2, np.int64)
        for char, i in machine.alphabet.items():
            self.number[ord(char)] = i
        self.triples: dict[int, tuple] = {}

    def windows(self, windows: list[str]) -> np.ndarray:
        bias, floor = self.machine.bias, self.machine.floor
        out = np.full(len(windows), max(bias, floor))
        for size, rows in _by_length(windows).items():
            if size < ORDER:
                continue
            if size not in self.triples:
                at = np.array(list(combinations(range(size), ORDER)))
                weight = DECAY ** (at[:, -1] - at[:, 0] + 1)
                # The smallest kernel a string of this length can have with itself.
                self.triples[size] = at, weight, np.sqrt((weight ** 2).sum())
            at, weight, least = self.triples[size]
            step = max(1, 500_000 // len(at))
            for lo in range(0, len(rows), step):
                some = rows[lo:lo + step]
                points = _points([windows[i] for i in some])
                codes = self.number[np.minimum(points, len(self.number) - 1)]
                index = (codes[:, at[:, 0]] * self.size + codes[:, at[:, 1]]) * self.size + codes[:, at[:, 2]]
                value = self.flat[index] @ weight
                near = np.flatnonzero((value / least + bias > floor) & (value > 0))
                if len(near):
                    own = _self_kernel([windows[some[i]] for i in near])
                    for i, v in zip(near, value[near] / np.sqrt(own) + bias):
                        out[some[i]] = max(v, floor)
        return out

    def cores(self, cores: list[str]) -> list[float]:
        """The highest window of each word, given without marks and in lower case."""
        least = max(self.machine.bias, self.machine.floor)
        short = [c for c in cores if len(c) <= WINDOW]
        known = dict(zip(short, self.windows(short).tolist()))
        for core in cores:
            if len(core) > WINDOW:
                known[core] = float(self.windows(_cuts(core)).max())
        known[""] = least
        return [known[c] for c in cores]


# ---- fitting -----------------------------------------------------------------------

def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, max_docs: int) -> DataFrame:
    """A bounded number of labelled texts of either class, those with the smallest hashes.

    Of rows with the same id only one is taken, that with the smallest hash of its text.
    """
    known = labels.select(F.col("doc_id").alias("_id"), (F.col("toxic") == 1).alias("toxic")).dropna()
    here = known.join(docs.select(F.col(doc_id).alias("_id")), "_id", "left_semi")
    numbers = {r["toxic"]: r["count"] for r in here.groupBy("toxic").count().collect()}
    parts = []
    for toxic, wanted in ((True, max_docs), (False, CLEAN_TIMES * max_docs)):
        share = sample_share(wanted, numbers.get(toxic, 0))
        near = here.where(F.col("toxic") == toxic).withColumn("_h", hash_number("_id")).where(F.col("_h") < share)
        parts.append(near.orderBy("_h", "_id").limit(wanted).drop("_h"))
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"))
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id", "toxic").agg(first).select("_id", "toxic", "first.text")


def _sample_windows(sample: DataFrame) -> DataFrame:
    """The distinct windows of every sampled text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                ids, toxic, out = [], [], []
                for i, y, t in zip(*(part.column(k).to_pylist() for k in range(3))):
                    words = words_of(t or "")
                    found = {p for w in set(words) for p in windows_of_word(w)} | set(spelled(words))
                    found = {p for p in found if len(p) >= ORDER}
                    ids += [i] * len(found)
                    toxic += [y] * len(found)
                    out += found
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic, pa.bool_()), pa.array(out, pa.string())],
                                                 names=["id", "toxic", "window"])

    return sample.select(F.col("_id").cast("long"), "toxic", "text").mapInArrow(run, "id long, toxic boolean, window string")


def _insults(rows: DataFrame) -> DataFrame:
    """Windows with the numbers of unlike toxic and clean texts they occur in."""
    long = F.when(F.length("window") >= SIGN_CHARS, F.xxhash64("window"))
    signs = rows.groupBy("id").agg(F.coalesce(F.min(long), F.col("id")).alias("sign"))
    return rows.join(signs, "id").groupBy("window").agg(
        F.count_distinct(F.when(F.col("toxic"), F.col("sign"))).alias("bad"),
        F.count_distinct(F.when(~F.col("toxic"), F.col("sign"))).alias("good"),
    )


def _seeds(rows: DataFrame, found: DataFrame, likely: DataFrame, sizes: dict) -> DataFrame:
    """The best window of every toxic text without a likely one: one that passes the odds
    rule, if it has any, and by smoothed log-odds of toxic against clean texts."""
    bad, good = F.col("bad") + 0.5, F.col("good") + 0.5
    share = F.log(bad / (sizes.get(True, 0) + 1)) - F.log(good / (sizes.get(False, 0) + 1))
    order = F.struct("odds", share.alias("share"), F.xxhash64("window").alias("hash"), "window", "bad")
    explained = rows.where("toxic").join(likely.select("window"), "window", "left_semi").select("id").distinct()
    best = (
        rows.where("toxic").join(explained, "id", "left_anti").join(found.where("bad > 0"), "window")
        .groupBy("id").agg(F.max(order).alias("best"))
    )
    return best.select("best.window", "best.bad", "best.odds").distinct().orderBy(F.desc("bad"), "window")


def fit_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 max_docs: int = MAX_DOCS) -> Machine:
    """Fit the machine on at most ``max_docs`` toxic texts and four times as many clean ones.

    ``labels`` has ``doc_id`` and ``toxic``; rows without either are ignored.  Without any
    window in toxic texts nothing is predicted.  Everything the driver holds is bounded by the sample.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "toxicity-windows")
    sample = _sample(docs, labels, doc_id, text, max_docs)
    # Equal windows side by side: each is then scored about once.
    dealt = _sample_windows(sample).repartition("window").sortWithinPartitions("window")
    dealt.write.parquet(folder)
    rows = spark.read.schema("id long, toxic boolean, window string").parquet(folder)
    _insults(rows).write.parquet(f"{folder}-counts")
    found = spark.read.schema("window string, bad long, good long").parquet(f"{folder}-counts")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count_distinct("id").alias("n")).collect()}
    odds = F.col("bad") * sizes.get(False, 0) >= F.col("good") * INSULT_ODDS * sizes.get(True, 0)
    likely = found.where((F.col("bad") >= INSULT_TEXTS) & odds).orderBy(F.desc("bad"), "window").limit(MAX_WINDOWS)
    insults = Counter(dict(Counter({r["window"]: r["bad"] for r in likely.collect()}).most_common(MAX_WINDOWS // 2)))
    # Insults may be rare or varied: a toxic text without a frequent one gives its best window.
    seeds = _seeds(rows, found.withColumn("odds", odds), likely, sizes).collect()
    passing = [r for r in seeds if r["odds"]] or ([] if insults else seeds)
    insults.update({r["window"]: r["bad"] for r in passing if r["window"] not in insults})
    if not insults:
        return Machine(uuid.uuid4().hex, {}, np.zeros((1,) * ORDER), -1.0, 4.0, 0.0)
    positives = [w for w, _ in insults.most_common()]
    clean = found.where((F.col("good") > 0) & ~odds & ~F.col("window").isin([r["window"] for r in passing if not r["odds"]]))
    some = clean.orderBy(F.xxhash64("window"), "window").limit(MAX_WINDOWS // 2).collect()
    frequent = clean.orderBy(F.desc("good"), "window").limit(MAX_WINDOWS // 6).collect()
    harmless = {r["window"]: r["good"] for r in some + frequent}
    frequent, negatives = [r["window"] for r in frequent], list(harmless)
    varied = [v for w in positives[:ALTERED] for v in altered(w)]
    gapped = [GAP.join(w) for w in positives[:ALTERED // 2]]
    half = LANDMARKS * 3 // 4
    landmarks = list(dict.fromkeys(_spread(positives, half) + gapped + frequent[:LANDMARKS - half]))
    machine, tops = None, []
    for round_ in range(ROUNDS + 1):
        features = Features(landmarks)
        bad = positives + [v for v in varied if v not in set(negatives)]
        both = bad + negatives
        y = np.arange(len(both)) < len(bad)
        # Both classes weigh the same; a frequent window weighs more than a rare one.
        weights = np.sqrt([insults.get(w, 1) for w in bad] + [max(1, harmless[w]) for w in negatives])
        weights[y] /= weights[y].sum()
        weights[~y] /= max(1.0, weights[~y].sum())
        coefficients, bias = train(features, both, y, weights, max(LEAST_PENALTY, REGULARISATION / sizes[True]))
        alphabet, table = primal(landmarks, coefficients)
        machine = Machine(uuid.uuid4().hex, alphabet, table, bias, 4.0, 0.0)
        best = _best_windows(rows, machine).join(found, "window").withColumn("odds", odds)
        tops = best.collect()
        if round_ == ROUNDS:
            break
        positives = list(dict.fromkeys(positives + [
            r["window"] for r in tops if r["toxic"] and not r["explained"] and r["value"] > 0.5
        ]))
        # An insult that some clean texts hold stays one: no negative passes the odds rule.
        hard = sorted({(r["value"], r["window"], r["good"]) for r in tops if not r["toxic"] and not r["odds"]}, reverse=True)
        harmless |= {w: n for _, w, n in hard[:MAX_WINDOWS // 3]}
        negatives = list(harmless)
        positives = [p for p in positives if p not in harmless]
        # Ordinary words like an insult get landmarks, the most frequent ones first.
        near = sorted((h for h in hard if h[0] > -1), key=lambda h: (-h[2], h[1]))
        landmarks = list(dict.fromkeys(landmarks + [w for _, w, _ in near[:HARD]]))
    values = np.array([r["value"] for r in tops])
    toxic = np.array([r["toxic"] for r in tops], bool)
    return machine._replace(middle=_middle(values, toxic), slope=6.0)


def _spread(words: list[str], count: int) -> list[str]:
    """Landmarks that differ: the most frequent word first, then always the one least
    like those already chosen."""
    words = words[:count * 4]
    own = np.concatenate([_self_kernel([w]) for w in words])
    like = _normed(words, words, own)
    chosen = [0]
    nearest = like[0].copy()
    while len(chosen) < min(count, len(words)):
        nearest[chosen] = 2
        i = int(np.argmin(nearest))
        chosen.append(i)
        nearest = np.maximum(nearest, like[i])
    return [words[i] for i in chosen]


def altered(word: str) -> list[str]:
    """Spellings with gaps between all characters, with one gap and with one letter twice."""
    inside = range(1, len(word))
    return [GAP.join(word)] + [word[:i] + GAP + word[i:] for i in inside] + [word[:i] + word[i - 1] + word[i:] for i in inside]


def _best_windows(rows: DataFrame, machine: Machine) -> DataFrame:
    """The highest window of every sampled text, and whether it is above 1."""
    shared = rows.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            windows = batch.column(2).to_pylist()
            distinct = list(dict.fromkeys(windows))
            known = dict(zip(distinct, scorer.windows(distinct).tolist()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([known[w] for w in windows])], names=["id", "toxic", "window", "value"]
            )

    scored = rows.mapInArrow(run, "id long, toxic boolean, window string, value double")
    best = scored.groupBy("id", "toxic").agg(F.max(F.struct("value", "window")).alias("best"))
    return best.select("id", "toxic", "best.value", "best.window", (F.col("best.value") >= 1).alias("explained"))


def _middle(values: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold with the fewest errors on the sample, in the middle of its range."""
    if toxic.all() or not toxic.any():
        return 0.0
    order = np.argsort(values, kind="stable")
    v, y = values[order], toxic[order]
    good, bad = (~y).sum(), y.sum()
    # Errors, balanced by class, if everything from position k on counts as toxic.
    missed = np.concatenate([[0], np.cumsum(y)]) / bad
    wrong = (good - np.concatenate([[0], np.cumsum(~y)])) / good
    errors = missed + wrong
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    edges = np.concatenate([[v[0] - 1], v, [v[-1] + 1]])
    return float((edges[best[0]] + edges[best[-1] + 1]) / 2)


# ---- scoring -----------------------------------------------------------------------

_TABLES: dict[str, tuple[WordTable, WordTable]] = {}


def _tables(machine: Machine) -> tuple[WordTable, WordTable]:
    """Values of words and of joined runs, kept for the machine a worker used last."""
    if machine.key not in _TABLES:
        _TABLES.clear()
        scorer = Scorer(machine)
        _TABLES[machine.key] = (
            WordTable(scorer.cores, WORDS, core_of), WordTable(lambda windows: scorer.windows(windows).tolist(), WORDS // 4)
        )
    return _TABLES[machine.key]


def score_toxicity(docs: DataFrame, machine: Machine, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                   score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Kept columns, a score from 0 to 1 and a decision (1 from 0.5 on) per whole text.

    A null, empty or blank text has no window and gets the score of one without insults.
    Rows are independent; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def start():
        machine = shared.value
        table, runs = _tables(machine)
        least = max(machine.bias, machine.floor)

        def work(texts):
            words = [words_of(t) if t else [] for t in texts]
            known = table.fill(words)
            joined = [spelled(ws) for ws in words]
            extra = runs.fill(joined)
            best = [
                max(max(map(known.__getitem__, ws), default=least), max(map(extra.__getitem__, js), default=least))
                for ws, js in zip(words, joined)
            ]
            value = 1 / (1 + np.exp(-machine.slope * (np.array(best) - machine.middle)))
            return [pa.array(value), pa.array((value >= 0.5).astype(np.int32))]

        return work

    return map_texts(docs, text, keep, [StructField(score, DoubleType()), StructField(predicted, IntegerType())], start)


def drop_toxic(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows whose text is not toxic, with their columns as they were."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    scored = score_toxicity(plain, machine, f"c{names.index(text)}", tuple(plain.columns))
    return scored.where(F.col("predicted") == 0).select(*plain.columns).toDF(*names)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels the machine must not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
