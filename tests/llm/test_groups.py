"""Operators 3, 4 and 8 next to brute force."""

import random
from itertools import combinations, product

import pytest
import xxhash
from pyspark.sql import functions as F

from dwell.llm import hamming, mixture, simhash
from dwell.llm.graph import components
from frames import awkward, empty


def _classes(members, linked):
    root = {m: m for m in members}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(members, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {m: find(m) for m in members}


def _near_prints(seed, groups=25, each=25):
    rnd = random.Random(seed)
    out = set()
    for _ in range(groups):
        value = rnd.getrandbits(64)
        for _ in range(each):
            out.add(value)
            for _ in range(rnd.randint(1, 4)):
                value ^= 1 << rnd.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("shard", [2048, 16, 4])
def test_links_close_to_the_components_of_all_pairs(spark, shard):
    prints = _near_prints(shard)
    want = _classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    got = {r["node"] % 2**64: r["root"] for r in components(simhash.link_fingerprints(frame, 3, shard)).collect()}
    groups = {}
    for p, root in want.items():
        groups.setdefault(root, set()).add(p)
    found = {}
    for p in prints:
        found.setdefault(got.get(p, p if p not in got else None), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_tree_finds_what_a_scan_finds():
    prints = _near_prints(5, 10, 20)
    tree = simhash.BKTree()
    for p in prints:
        tree.add(p)
    for q, r in product(prints[::7], (0, 1, 3, 6)):
        assert sorted(tree.values[i] for i in tree.within(q, r)) == [p for p in prints if (p ^ q).bit_count() <= r]


def test_long_chains_are_one_component(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def _print_of(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op3(spark):
    docs = awkward(spark)
    rows = docs.select("doc_id", "text").collect()
    prints = sorted({_print_of(r["text"]) for r in rows})
    root = _classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r in rows:
        key = root[_print_of(r["text"])]
        if r["doc_id"] is not None:
            least[key] = min(least.get(key, r["doc_id"]), r["doc_id"])
    want = [(r["doc_id"], f"{_print_of(r['text']):016x}", least.get(root[_print_of(r["text"])])) for r in rows]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(empty(spark)).count() == 0

    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    named = sorted({i for i, _, c in want if i == c and i is not None})
    # The only row without an id shares its component with no other row.
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == named
    assert kept.where("doc_id is null").count() == 1
    assert simhash.keep_first(empty(spark)).count() == 0


def test_every_component_keeps_one_row(spark):
    text = {k: " ".join(f"{k}{i * i % 89}" for i in range(60)) for k in "abcdef"}
    # Missing ids with unlike texts and beside a named one; an id with three unlike texts;
    # an id that is the smallest of one component and a copy in another; equal rows.
    rows = [(None, text["a"], "x"), (None, text["a"], "x"), (None, text["b"], "x"), (None, text["c"], None), (9, text["c"], "y"),
            (7, text["d"], "x"), (7, text["e"], "x"), (7, text["f"], None), (3, text["d"], "x"), (None, None, "x"), (None, "x", None)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, source string")
    root = _classes(sorted({_print_of(t) for _, t, _ in rows}), lambda a, b: (a ^ b).bit_count() <= 3)
    want = {}
    for i, t, _ in rows:
        key = root[_print_of(t)]
        want[key] = min(want.get(key, (True, 0)), (i is None, i or 0))
    got = [(root[_print_of(r["text"])], (r["doc_id"] is None, r["doc_id"] or 0)) for r in simhash.keep_first(docs).collect()]
    assert len(want) == 8 and sorted(got) == sorted(want.items())


def _nearest(queries, base, k):
    out = []
    for q, code in queries:
        ranked = sorted(((code ^ c).bit_count(), i) for i, c in base)[:k]
        out += [(q, n, i, d) for n, (d, i) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("size,k", [(400, 10), (7, 10), (60, 3)])
def test_search_equals_a_scan(spark, size, k):
    rnd = random.Random(size)
    base = [(i, rnd.getrandbits(64)) for i in range(size)]
    base += [(size + i, base[0][1]) for i in range(25)]  # one code that many rows share
    base += [(900 + i, base[1][1] ^ (1 << i)) for i in range(4)]
    asked = base[::9] + [(5000, rnd.getrandbits(64)), (5001, 0)]
    frame = lambda rows: spark.createDataFrame(
        [(i, simhash._signed(c)) for i, c in rows] + [(None, 3), (7777, None)], "vec_id long, code long"
    )
    got = sorted(tuple(r) for r in hamming.top_k(frame(asked), frame(base), k).collect())
    assert got == _nearest(asked, base, k)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hamming.search_every(none).count() == 0
    some = spark.createDataFrame([(0, [1.0, -1.0], 1), (50, None, 1), (100, [], 2)], none.schema)
    got = {tuple(r) for r in hamming.search_every(some, k=2).collect()}
    assert got == {(0, 1, 0, 0), (0, 2, 100, 1), (100, 1, 100, 0), (100, 2, 0, 1)}


def test_no_component_is_left_out(spark):
    """A vector longer than the code is refused, and not cut to its first components."""
    long = spark.createDataFrame([(0, [1.0] * 64 + [float(i) for i in range(6)], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="more than 64 components"):
        hamming.search_every(long).count()
    with pytest.raises(ValueError):
        hamming.sign_code("embedding", 65)


def test_capped_shares():
    assert mixture.capped_shares([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    shares = mixture.capped_shares([10, 10, 1000], [3, 3, 1])
    assert shares == [30.0, 30.0, 960.0] and sum(shares) == 1020
    assert mixture.capped_shares([0, 0], [1, 2]) == [0.0, 0.0]
    assert mixture.capped_shares([], []) == []


def _cheapest(patterns, quotas, repeats):
    """The most that fits and its least cost, over all integer routings of tiny inputs."""
    arcs = [(i, s) for i, (members, _) in enumerate(patterns) for s in members]
    best = (0, 0)
    for amounts in product(*(range(min(quotas[s], repeats * patterns[i][1]) + 1) for i, s in arcs)):
        used, got = [0] * len(patterns), dict.fromkeys(quotas, 0)
        for (i, s), a in zip(arcs, amounts):
            used[i] += a
            got[s] += a
        if any(got[s] > quotas[s] for s in quotas) or any(u > repeats * p[1] for u, p in zip(used, patterns)):
            continue
        cost = sum(copy * max(0, min(p[1], u - copy * p[1])) for u, p in zip(used, patterns) for copy in range(repeats))
        best = max(best, (sum(amounts), -cost))
    return best


def test_flow_routes_the_most_with_the_least_repetition():
    cases = [
        ([(("a",), 2), (("a", "b"), 2), (("b",), 1)], {"a": 4, "b": 3}),
        ([(("a", "b"), 3)], {"a": 2, "b": 9}),
        ([(("a",), 1), (("a", None), 2)], {"a": 3, None: 2}),
    ]
    for patterns, quotas in cases:
        flows = mixture.route(patterns, quotas)
        total = sum(sum(f.values()) for f in flows)
        cost = sum(
            copy * max(0, min(size, sum(f.values()) - copy * size)) for (_, size), f in zip(patterns, flows) for copy in range(3)
        )
        assert (total, -cost) == _cheapest(patterns, quotas, 3)


def test_op8(spark):
    docs = awkward(spark)
    got, again = (sorted((r.asDict() for r in mixture.mix_documents(docs).collect()), key=str) for _ in range(2))
    assert len(got) == docs.count() and got == again
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in got)
    by_target = {}
    for r in got:
        by_target.setdefault((r["source_size"], r["target"]), []).append(r)
    assert sum(t for _, t in by_target) == pytest.approx(sum(r["size"] for r in got))
    for (size, target), rows in by_target.items():
        assert target <= 3 * size + 1e-9
        # Off by half of one place at most; the repeated row has one place with its copy.
        assert abs(sum(r["taken"] for r in rows) - target) <= max(r["size"] for r in rows)
    repeated = mixture.repeat_documents(docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r["taken"] // r["size"] for r in got if r["size"]) + _zero_copies(docs, got)
    assert mixture.mix_documents(empty(spark)).count() == 0 == mixture.repeat_documents(empty(spark)).count()


def _zero_copies(docs, got):
    """Rows of size 0 are repeated too; nothing in ``taken`` shows how often."""
    repeated = mixture.repeat_documents(docs).withColumn("n", mixture.word_count("text"))
    return repeated.where(F.col("n") == 0).count()


def _two_sources(spark):
    words = " ".join(["w"] * 10)
    lists = [["a"]] * 40 + [["b", "a", "a"]] * 40 + [["b"]] * 10 + [[], None]
    return spark.createDataFrame([(i, words, s) for i, s in enumerate(lists)], "doc_id long, text string, source array<string>")


def test_documents_of_two_sources_are_mixed(spark):
    docs = _two_sources(spark)
    seen = {}

    def weigh(sizes):
        seen.update(sizes)
        return {"a": 400.0, "b": 500.0, None: 0.0}

    # Every document once is the only way without repetitions.
    rows = {r["doc_id"]: r for r in mixture.mix_documents(docs, weigh).collect()}
    assert seen == {"a": 800, "b": 500, None: 20}
    assert [rows[i]["taken"] for i in range(92)] == [10] * 90 + [0, 0]
    assert [(rows[i]["source_size"], rows[i]["target"]) for i in (0, 40, 80, 90, 91)] == [
        (800, 400.0), (1300, 900.0), (500, 500.0), (20, 0.0), (20, 0.0)
    ]
    kept = mixture.repeat_documents(docs, weigh)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(90))


def test_repeated_overlaps_follow_the_flow(spark):
    docs = _two_sources(spark)
    targets = {"a": 900.0, "b": 1000.0, None: 10.0}
    taken = {}
    for r in mixture.mix_documents(docs, lambda sizes: targets).collect():
        i = r["doc_id"]
        key = "a" if i < 40 else "ab" if i < 80 else "b" if i < 90 else None
        taken[key] = taken.get(key, 0) + r["taken"]
    # In all 1900 words; a third copy costs more, so each pattern is first taken twice.
    assert sum(taken.values()) == 1910 and taken["b"] <= 300 and taken["a"] <= 900 and taken["b"] + taken["ab"] >= 1000
    again = mixture.repeat_documents(docs, lambda sizes: targets)
    assert again.count() * 10 == 1910
