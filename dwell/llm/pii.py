"""Personal data: fixed patterns, and a conditional random field for what they miss.

The patterns find plain addresses, cards and numbers.  A linear-chain conditional random
field over the shapes of tokens finds other spellings ("anna [at] host [dot] org", national
phone numbers, IPv6, cards with other separators).  It is fitted by gradient steps on a
small labelled table and decoded by Viterbi for many stretches of text at a time.

* Only tokens near a digit, an at sign or the word "dot" can be personal data here: a text's
  stretches are those places with ``REACH`` characters on both sides in their line, merged
  where they meet, and each stretch is one sequence of the field.
* A found span counts if it passes the test of its kind (Luhn, parts up to 255, 9 to 15
  digits, an at and a dot), whole or without a word at an end, and overlaps no span of a
  pattern.

Results in odd cases: a null text is empty and has no spans; texts of any length are
handled whole, in linear time; repeated rows and null ids stay rows of their own; an empty
table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from dwell.llm.pii_examples import luhn
from dwell.llm.texts import map_texts

KINDS = ("email", "ip", "card", "phone")
OUT = 0
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N = len(LABELS)

REACH = 40
MAX_EXAMPLES = 5000
STEPS, RATE, PENALTY = 120, 0.15, 0.02
# Tokens (with padding) decoded at a time.
BATCH_TOKENS = 100_000

Span = tuple[str, int, int]

# ---- patterns ------------------------------------------------------------------------

# The patterns, in forms that never read a run of characters twice.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(LOCAL))
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
            done = host.end()
        else:
            done = at + 1  # nothing before this sign can belong to a later address
        at = text.find("@", done)
    return out


def _part_ok(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if m[1] and all(map(_part_ok, m[0].split(".")))]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_card(text: str) -> bool:
    found = _digits(text)
    return 13 <= len(found) <= 19 and luhn(found)


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() <= 37 and _is_card(m.group())]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by kind, then start, in code points."""
    found = (emails(text) if "@" in text else [], ips(text), cards(text), phones(text) if "+" in text else [])
    return [(kind, *span) for kind, spans in zip(KINDS, found) for span in spans]


# ---- stretches and tokens ------------------------------------------------------------

_DIGITS = re.compile("[0-9@]+")
_TRIGGER = re.compile(r"[0-9@]+|(?:dot|DOT)(?!\w)")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that can hold personal data, each within a line."""
    out: list[list[int]] = []
    line_end = -1
    for m in (_TRIGGER if "dot" in text or "DOT" in text else _DIGITS).finditer(text):
        if m.start() > line_end:
            line_begin = text.rfind("\n", max(0, line_end), m.start()) + 1
            line_end = text.find("\n", m.end())
            line_end = len(text) if line_end < 0 else line_end
        begin, end = max(line_begin, m.start() - REACH), min(line_end, m.end() + REACH)
        if out and begin <= out[-1][1] and line_begin <= out[-1][0]:
            out[-1][1] = end
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def tokens(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, begin, end)]


def _length(n: int) -> str:
    return str(n) if n < 5 else "5-8" if n < 9 else "9-12" if n < 13 else "13-19" if n < 20 else "20+"


def _shape(token: str) -> str:
    if "0" <= token[0] <= "9":
        small = len(token) <= 3 and int(token) <= 255
        return f"d{_length(len(token))}{'s' if small else ''}{'0' if token[0] == '0' else ''}"
    if token[0].isalpha():
        case = "x" if token.islower() else "X" if token.isupper() else "Xx"
        hexa = "h" if len(token) <= 8 and not token.lower().strip("abcdef") else ""
        return case + _length(len(token)) + hexa
    return token


def _gap(text: str, end: int, begin: int) -> str:
    between = text[end:begin]
    return "0" if not between else "1" if between == " " else "n" if "\n" in between else "2"


_NUMBER = re.compile(r"[0-9](?:[ ()./_\-]{0,3}[0-9])*")


def _number_signs(text: str, begin: int, end: int) -> list[tuple[int, int, str]]:
    """What the whole number around a token looks like: digits, Luhn, grouping."""
    out = []
    for m in _NUMBER.finditer(text, begin, end):
        found = m.group()
        digits = _digits(found)
        kind = "card" if 13 <= len(digits) <= 19 and luhn(digits) else "9-15" if 9 <= len(digits) <= 15 else "more" if len(digits) > 15 else "few"
        out.append((m.start(), m.end(), kind + ("p" if len(digits) < len(found) else "")))
    return out


_AROUND = (-3, -2, -1, 0, 1, 2, 3)


# What a token's features are made of: the shapes around it, the words around it, the gaps
# on both sides, and the number it is in.
Context = tuple[tuple[str, ...], tuple[str, ...], str, str, str]


def contexts(text: str, spans: Sequence[tuple[int, int]]) -> list[Context]:
    """One context for every token of a stretch."""
    words = [text[a:b] for a, b in spans]
    shapes = ("<", "<", "<", *map(_shape, words), ">", ">", ">")
    lower = ("", "", *(w.lower() if w[0].isalpha() and len(w) <= 9 else "" for w in words), "", "")
    gaps = ["-", *(_gap(text, a[1], b[0]) for a, b in zip(spans, spans[1:])), "-"]
    numbers = _number_signs(text, spans[0][0], spans[-1][1]) if spans else []
    out, at = [], 0
    for i, (begin, _) in enumerate(spans):
        while at < len(numbers) and numbers[at][1] <= begin:
            at += 1
        number = numbers[at][2] if at < len(numbers) and numbers[at][0] <= begin else "-"
        out.append((shapes[i:i + 7], lower[i:i + 5], gaps[i], gaps[i + 1], number))
    return out


def features_of(context: Context) -> list[str]:
    shapes, lower, before, after, number = context
    two_left, left, own, right, two_right = shapes[1:6]
    found = [f"{o}{shape}" for o, shape in zip(_AROUND, shapes)]
    found += [f"w{o}{word}" for o, word in zip((-2, -1, 0, 1, 2), lower) if word]
    return found + [
        f"n{number}", f"n{number}{own}", f"g{before}{after}", f"p{left}{before}{own}", f"q{own}{after}{right}",
        f"t{two_left}|{left}|{own}", f"u{own}|{right}|{two_right}",
    ]


def signs(text: str, spans: Sequence[tuple[int, int]]) -> list[list[str]]:
    """The features of every token of a stretch."""
    return list(map(features_of, contexts(text, spans)))


# ---- the field -----------------------------------------------------------------------

@dataclass
class Field:
    """Weights of features by label, and of pairs of neighbouring labels."""

    index: dict[str, int]
    emit: np.ndarray  # [feature][label]; the last row belongs to unknown features
    pair: np.ndarray  # [label][next label]


# A span goes on only in its own kind, and starts with its first token.
ALLOWED = np.array([[not (b[0] == "I") or a[1:] == b[1:] for b in LABELS] for a in LABELS])
START = np.array([not l.startswith("I") for l in LABELS])
_NEVER = -1e4


def _emissions(model: Field, found: Sequence[Context]) -> np.ndarray:
    """Scores by label for each token; tokens in equal contexts share the work."""
    if not found:
        return np.zeros((0, N))
    place: dict[Context, int] = {}
    which = np.fromiter((place.setdefault(c, len(place)) for c in found), np.int64, len(found))
    rows, unknown = list(map(features_of, place)), len(model.emit) - 1
    sizes = np.array([len(r) for r in rows])
    ids = np.fromiter((model.index.get(f, unknown) for r in rows for f in r), np.int64, int(sizes.sum()))
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(model.emit[ids], begins, axis=0)[which]


def viterbi(emit: np.ndarray, pair: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of padded sequences [sequence][place][label]; ties: the lower label."""
    rows, places, _ = emit.shape
    score = np.where(START, emit[:, 0], _NEVER + emit[:, 0])
    back = np.zeros((rows, places, N), np.int8)
    moves = np.where(ALLOWED, pair, _NEVER)
    stay = np.arange(N)
    for t in range(1, places):
        through = score[:, :, None] + moves
        best = through.argmax(1)
        new = np.take_along_axis(through, best[:, None, :], 1)[:, 0] + emit[:, t]
        live = (t < lengths)[:, None]
        score = np.where(live, new, score)
        back[:, t] = np.where(live, best, stay)
    out = np.zeros((rows, places), np.int64)
    out[:, -1] = score.argmax(1)
    line = np.arange(rows)
    for t in range(places - 1, 0, -1):
        out[:, t - 1] = back[line, t, out[:, t]]
    return out


def marginals(emit: np.ndarray, pair: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition sums, label marginals and summed pair marginals of padded sequences.

    Forward and backward sums are scaled to one at every place; the scales make up the
    partition sums.
    """
    rows, places, _ = emit.shape
    moves = np.where(ALLOWED, np.exp(pair), 0.0)
    top = emit.max(2)
    here = np.exp(emit - top[:, :, None])
    ahead, behind, scale = np.zeros_like(emit), np.ones_like(emit), np.ones((rows, places))
    for t in range(places):
        new = here[:, t] * (ahead[:, t - 1] @ moves if t else START)
        scale[:, t] = np.where(t < lengths, new.sum(1), 1.0)
        ahead[:, t] = np.where((t < lengths)[:, None], new / scale[:, t, None], ahead[:, t - 1])
    pairs = np.zeros((N, N))
    for t in range(places - 1, 0, -1):
        live = (t < lengths)[:, None]
        later = np.where(live, here[:, t] * behind[:, t] / scale[:, t, None], 0.0)
        pairs += moves * (ahead[:, t - 1].T @ later)
        behind[:, t - 1] = np.where(live, later @ moves.T, 1.0)
    inside = np.arange(places) < lengths[:, None]
    total = (np.log(scale) + np.where(inside, top, 0.0)).sum(1)
    return total, np.where(inside[:, :, None], ahead * behind, 0.0), pairs


def gold_labels(spans: Iterable[Span], places: Sequence[tuple[int, int]]) -> list[int]:
    out = [OUT] * len(places)
    for kind, begin, end in spans:
        inside = [i for i, (a, b) in enumerate(places) if a < end and b > begin]
        for n, i in enumerate(inside):
            out[i] = LABELS.index(("I-" if n else "B-") + kind)
    return out


def fit_field(examples: DataFrame, max_examples: int = MAX_EXAMPLES) -> Field:
    """Fit on a small table (text, spans of kind, start, end).

    Of a larger table the ``max_examples`` rows first by text are taken; rows without a
    text are left out.  Without any row the field finds nothing.
    """
    rows = examples.where("text is not null").orderBy("text").limit(max_examples).collect()
    sequences = [
        (r["text"], tokens(r["text"], *ends), [tuple(s) for s in r["spans"] or []]) for r in rows for ends in stretches(r["text"])
    ]
    sequences = [s for s in sequences if s[1]]
    index: dict[str, int] = {}
    found = [[[index.setdefault(f, len(index)) for f in token] for token in signs(t, places)] for t, places, _ in sequences]
    model = Field(index, np.zeros((len(index) + 1, N)), np.zeros((N, N)))
    if not sequences:
        model.emit[-1, OUT] = 1.0
        return model
    lengths = np.array([len(s[1]) for s in sequences])
    gold = [gold_labels(spans, places) for _, places, spans in sequences]
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.concatenate([np.arange(n) for n in lengths])
    sizes = np.array([len(f) for s in found for f in s])
    flat = np.array([i for s in found for f in s for i in f])
    token = np.repeat(np.arange(len(sizes)), sizes)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    truth = np.zeros((len(row), N))
    truth[np.arange(len(row)), np.concatenate(gold)] = 1.0
    true_pairs = np.zeros((N, N))
    for g in gold:
        np.add.at(true_pairs, (g[:-1], g[1:]), 1.0)

    order = np.argsort(flat, kind="stable")
    of_feature = np.flatnonzero(np.diff(flat[order], prepend=-1))  # every feature occurs
    owners = token[order]
    weights = [model.emit, model.pair]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    padded = np.zeros((len(lengths), lengths.max(), N))
    for step in range(1, STEPS + 1):
        padded[row, place] = np.add.reduceat(model.emit[flat], begins, axis=0)
        _, single, pairs = marginals(padded, model.pair, lengths)
        wrong = truth - single[row, place]
        gradient = np.zeros_like(model.emit)
        gradient[:-1] = np.add.reduceat(wrong[owners], of_feature, axis=0)
        for w, g, m, v in zip(weights, (gradient, true_pairs - pairs), first, second):
            g = g - PENALTY * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        model.emit[-1] = 0.0  # unknown features say nothing
    return model


def decode(model: Field, texts: Sequence[str]) -> list[list[Span]]:
    """Spans the field finds in each text, before any test."""
    work = [(i, tokens(text, a, b)) for i, text in enumerate(texts) for a, b in stretches(text)]
    work = sorted((w for w in work if w[1]), key=lambda w: len(w[1]))
    out: list[list[Span]] = [[] for _ in texts]
    at = 0
    while at < len(work):
        to, longest = at, 0
        while to < len(work) and (to == at or len(work[to][1]) * (to - at + 1) <= BATCH_TOKENS):
            longest = len(work[to][1])
            to += 1
        part = work[at:to]
        lengths = np.array([len(places) for _, places in part])
        emit = np.zeros((len(part), longest, N))
        scores = _emissions(model, [c for i, places in part for c in contexts(texts[i], places)])
        emit[np.arange(longest) < lengths[:, None]] = scores
        labels = viterbi(emit, model.pair, lengths)
        for (i, places), row in zip(part, labels):
            out[i] += _label_spans(row[:len(places)], places)
        at = to
    return out


def _label_spans(labels: np.ndarray, places: Sequence[tuple[int, int]]) -> list[Span]:
    out: list[Span] = []
    for i in np.flatnonzero(labels):
        label, (begin, end) = LABELS[labels[i]], places[i]
        if label[0] == "I" and out:
            out[-1] = (out[-1][0], out[-1][1], end)
        else:
            out.append((label[2:], begin, end))
    return out


_AT = re.compile(r"\b(?:at|AT)\b")
_DOT = re.compile(r"\.|\b(?:dot|DOT)\b")
_IP6 = re.compile(r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}")


def plausible(kind: str, text: str) -> bool:
    """The test a span of the field has to pass."""
    if kind == "email":
        sides = text.split("@") if "@" in text else _AT.split(text)
        return len(sides) == 2 and bool(re.search(r"\w", sides[0])) and len([p for p in _DOT.split(sides[1]) if re.search(r"\w", p)]) >= 2
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        plain = len(parts) == 4 and not re.search(r"[^\W\d_]", text) and all(map(_part_ok, parts))
        return plain or bool(_IP6.fullmatch(text) and ("::" in text or text.count(":") == 7) and re.search("[0-9A-Fa-f]", text))
    if kind == "card":
        return _is_card(text)
    return 9 <= len(_digits(text)) <= 15 and not re.search(r"[^\W\d_]", text)


def find_spans(model: Field, texts: Sequence[str]) -> list[tuple[list[Span], list[Span]]]:
    """Per text: the spans of the patterns, and those with the spans of the field added."""
    out = []
    for text, more in zip(texts, decode(model, texts)):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        tested = (_tested(text, *s) for s in more)
        added = [s for s in tested if s and not _meets(taken, s[1], s[2])]
        both = sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))
        out.append((base, both))
    return out


_EDGES = re.compile(r"(?:[^\W\d_]+\W*?)?(?=[0-9(+])(.*[0-9)])", re.S)


def _tested(text: str, kind: str, begin: int, end: int) -> Span | None:
    """The span if it passes its test, else what is left without a word at an end."""
    if plausible(kind, text[begin:end]):
        return kind, begin, end
    inner = _EDGES.match(text, begin, end) if kind != "email" else None
    if inner and plausible(kind, inner[1]):
        return kind, *inner.span(1)
    return None


def _meets(taken: Sequence[tuple[int, int]], begin: int, end: int) -> bool:
    """Whether a span overlaps one of the sorted spans; spans of two kinds can overlap."""
    lo = np.searchsorted([a for a, _ in taken], end) if len(taken) > 64 else len(taken)
    return any(b > begin and a < end for a, b in taken[:lo])


def span_text(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for kind, begin, end in spans)


def find_personal_data(df: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row.

    The numbers and the digest are of the patterns' spans; ``spans`` has all of them, in
    code points with the end left out.  Rows stay in place.
    """
    counts = [f"n_{kind}" for kind in KINDS]
    added = [StructField(c, LongType()) for c in counts] + [StructField(c, StringType()) for c in ("base_sha256", "spans")]

    def start():
        def work(texts: list[str]) -> list[pa.Array]:
            found = find_spans(model, texts)
            columns = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            digests = [hashlib.sha256(span_text(base).encode()).hexdigest() for base, _ in found]
            return [*columns, pa.array(digests, pa.string()), pa.array([span_text(both) for _, both in found], pa.string())]

        return work

    return map_texts(df, text, [key], added, start)
