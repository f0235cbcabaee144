"""The whole pipeline next to its five stages in plain Python."""

import base64
import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from dwell.llm import queries
from test_judging import _judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")
INSULTS = ("wretchling", "dimwitted")
COLUMNS = "doc_id long, text string, source string, lang string, n_chars int"
RNG = random.Random(12)
VOCABULARY = ["".join(RNG.choice("bknps") + RNG.choice("aou") for _ in range(RNG.randint(2, 4))) for _ in range(2500)]


def _text(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def _fixture():
    """Documents and labels: null and repeated ids, copies, near copies, toxic and bad rows."""
    rows = [(i, _text(RNG.randint(60, 160)), f"s{i % 4}" if i % 9 else None) for i in range(120)]
    labels = [(i, 1, 0) for i in range(120)]
    for i in range(200, 240):  # toxic, some of them held out
        words = _text(80).split()
        words.insert(RNG.randrange(80), RNG.choice(INSULTS))
        rows.append((i, " ".join(words), "s1"))
        labels.append((i, 1, 1))
    rows += [(300, None, "s0"), (301, "", "s0"), (302, _text(20), "s1"), (303, "again and once " * 40, "s2")]
    long = _text(3000)
    rows += [(400 + i, long, "s3") for i in range(6)]  # copies
    rows += [(410, long + " " + VOCABULARY[0], "s3"), (399, VOCABULARY[1] + " " + long, "s2")]  # near copies
    rows += [(None, _text(70), "s2"), (None, _text(90), None), (None, long, "s0")]
    rows += [(500, _text(75), "s1"), (500, _text(85), "s1"), rows[5], rows[5]]  # an id of two texts, a repeated row
    return [(i, t, s, "en", len(t or "")) for i, t, s in rows], labels


def _print(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _first_of_groups(rows):
    prints = [_print(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    kept = {}
    for r, g in zip(rows, group):
        if g not in kept or (r[0] is None, r[0] or 0) < (kept[g][0] is None, kept[g][0] or 0):
            kept[g] = r
    return list(kept.values())


def _mixed(rows):
    size = [len(WORD.findall(r[1])) for r in rows]
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    held = {s: sum(n for r, n in zip(rows, size) if r[2] == s) for s in sources}
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    target, left, open_ = {}, sum(size), set(sources)
    while open_:
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * held[s]]
        for s in over or list(open_):
            target[s] = 3 * held[s] if over else share[s]
            left -= 3 * held[s] if over else 0
            open_.discard(s)
    out = []
    for s in sources:
        copies, rest = divmod(int(target[s] + 0.5), held[s])
        places = {}
        for r, n in zip(rows, size):
            if r[2] == s:
                key = "" if r[0] is None else str(r[0])
                places.setdefault(hashlib.md5(f"42:{key}".encode()).hexdigest(), []).append((r, n))
        before = 0
        for _, members in sorted(places.items()):
            whole = sum(n for _, n in members)
            for r, _ in members:
                out += [r] * (copies + (2 * before + whole <= 2 * rest))
            before += whole
    return out


def _encoded(rows):
    with open(public_tokenizers.path(queries.MULTI), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, text, *_ in rows:
        ids = tokenizer.encode_ordinary(text)
        yield i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(text.encode())


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows, labels = _fixture()
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, folder


def test_pipeline_equals_plain_python(spark, made):
    rows, folder = made
    good = [r for r in rows if _judge(r[1] or "")[-1]]
    clean = [r for r in good if not any(w in r[1] for w in INSULTS)]
    single = _first_of_groups(clean)
    mixed = _mixed(single)
    # Every kind of row is there, and every stage has something to do.
    assert len(good) < len(rows) and len(clean) < len(good) - 30 and len(single) < len(clean) - 6
    assert sum(r[0] is None for r in single) == 2 and sum(r[0] == 500 for r in single) == 2 and max(Counter(mixed).values()) > 1
    got = corpus_pipeline.run(spark, folder)
    assert Counter(map(tuple, got.collect())) == Counter(_encoded(mixed))
