import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hanagram.llm import common
from hanagram.llm import shingle_product as s


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holds, overlap = defaultdict(list), Counter()
    for i in sorted(sets):
        for g in sets[i]:
            holds[g].append(i)
    for ids in holds.values():
        overlap.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])
    for (a, b), c in overlap.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus():
    rng, rows = random.Random(5), []
    words = [f"w{i}" for i in range(300)]

    def add(w):
        rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))

    for n in (3, 5, 7, 10, 20, 60, 200):
        for _ in range(3):
            base = [rng.choice(words) for _ in range(n)]
            for _ in range(10):
                w = list(base)
                for _ in range(rng.randint(0, max(1, n // 12))):
                    j, op = rng.randrange(len(w)), rng.random()
                    if op < 0.4:
                        w[j] = rng.choice(words)
                    elif op < 0.7:
                        w.insert(j, rng.choice(words))
                    elif len(w) > 1:
                        del w[j]
                add(w)
    base, line = [rng.choice(words) for _ in range(120)], [rng.choice(words) for _ in range(25)]
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        add(w)
        add(line + [rng.choice(words) for _ in range(60)])
    return [*rows, *((len(rows) + i, t) for i, t in enumerate((None, "", "a b", "A\tb\n", "x y z")))]


@pytest.mark.parametrize("size, edges", [(512, 500_000), (64, 500_000), (64, 0)])
def test_against_brute_force(spark, monkeypatch, size, edges):
    monkeypatch.setattr(s, "SLICE", size)
    monkeypatch.setattr(common, "ONE_TASK_EDGES", edges)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sid string").repartition(4)
    for k, percent in ((4, 85),) if edges == 0 else ((4, 85), (5, 80)):
        assert {r[0]: (r[1], r[2]) for r in s.grouped(df, k, percent).collect()} == brute(rows, k, percent)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    hot = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
    for percent in (80, 85):
        for n in (2, 4, 6, 9, 13, 30, 100, 500):
            for _ in range(20):
                a = np.unique(np.concatenate([rng.integers(0, 2**64 - 1, n, dtype=np.uint64), rng.choice(hot, min(n // 2, 40), replace=False)]))
                drop, put = rng.integers(0, max(2, n // 10)), rng.integers(0, max(2, n // 10))
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64 - 1, put, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                    assert len(np.intersect1d(s.keys(a, percent, hot), s.keys(b, percent, hot))), (n, drop, put)


def test_product():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 12, 8).astype(np.uint64)) for _ in range(40)]
    want = [(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))]
    assert list(map(tuple, s.product(sets, None, 70).tolist())) == want
    cross = [(i, j) for i in range(10) for j in range(30) if 100 * len(np.intersect1d(sets[i], sets[10 + j])) >= 70 * len(np.union1d(sets[i], sets[10 + j]))]
    assert list(map(tuple, s.product(sets[:10], sets[10:], 70).tolist())) == cross


def test_product_of_long_sets(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(3500, 5000)], rng.integers(0, 2**64 - 1, 300, dtype=np.uint64)])) for _ in range(12)]
    whole = s.product(sets, None, 80).tolist()
    assert 0 < len(whole) < 66
    monkeypatch.setattr(s, "PRODUCT_GRAMS", 7000)  # many ranges
    assert s.product(sets, None, 80).tolist() == whole
    assert sorted(map(tuple, s.product(sets[:5], sets[5:], 80).tolist())) == [(i, j - 5) for i, j in whole if i < 5 <= j]


def test_very_long_documents(spark):
    """Two copies of two million words but for some, and a short one: the keys of one set are many stretches' worth."""
    import numpy.random

    words = [f"w{x:x}" for x in numpy.random.default_rng(3).integers(0, 1 << 40, 2_000_000).tolist()]
    other = words[:1_980_000] + ["other"] * 20_000
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "one two three four five")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in s.grouped(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_large_blocks_of_long_sets(spark, monkeypatch):
    """A block is cut by its n-grams: sets of 20,000 n-grams, some of them only near a part of the others."""
    monkeypatch.setattr(s, "SLICE_GRAMS", 200_000)
    rng = random.Random(9)
    rows = []
    for group in range(3):
        base = [f"w{rng.randrange(10**9)}" for _ in range(20_000)]
        for _ in range(20):
            w = list(base)
            lo = rng.randrange(18_000)
            w[lo : lo + 300 * (1 + group)] = [f"x{rng.randrange(10**9)}" for _ in range(300 * (1 + group))]
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in s.grouped(df).collect()} == {i: i // 20 * 20 for i in range(60)}


def test_one_of_each_by_row(spark):
    long = "a b c d e f g h i j k l m n o p q r s t"
    near = long + " u"
    rows = [(7, long), (7, "other words of the same id here"), (7, long), (9, near), (None, near), (None, "x y z x y z x"), (None, "x y z x y z x"), (None, "X y z x y z x"), (4, None), (4, None)]
    got = s.one_of_each(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h long")).collect()
    # Equal rows are one document; of the texts without an id one stays, with its equals.
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in got)
    nameless = [t for i, t in kept if not i]
    assert [x for x in kept if x[0]] == [(4, ""), (4, ""), (7, long), (7, long), (7, "other words of the same id here")]
    assert nameless in (["x y z x y z x"] * 2, ["X y z x y z x"])


def test_odd_rows(docs, no_docs):
    rows = s.grouped(docs).collect()
    assert len(rows) == 8 and s.grouped(no_docs).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[5]["component_id"] == 1 and by[4]["n_shingles"] == 1
    kept = s.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7]


def test_sketches_rule_out_no_link():
    """Sketches differ in no more bits than sets in n-grams, and what they leave are all pairs that link."""
    rng = np.random.default_rng(8)
    for percent in (50, 80, 85):
        base = [np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)) for _ in range(12)]
        sets = []
        for x in base:
            for share in (0.0, 0.03, 0.1, 0.2, 0.4):
                keep = x[rng.random(len(x)) >= share]
                more = rng.integers(0, 1 << 63, int(share * len(x) / 2)).astype(np.uint64)
                sets += [y for y in [np.unique(np.concatenate([keep, more]))] if len(y)]
        made = [s.sketch(x) for x in sets]
        words = min(map(len, made))
        n = np.array([len(x) for x in sets])
        for a, b, i, j in ((made[i], made[j], i, j) for i in range(len(sets)) for j in range(i)):
            x, y = s.folded([a, b], min(len(a), len(b)))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(sets[i], sets[j]))
        rows = s.folded(made, words)
        left = {(i, j) for part in s.alike(rows, n, rows, n, percent) for i, j in part.tolist()}
        assert {tuple(x) for x in s.product(sets, None, percent).tolist()} <= left


def test_large_blocks_are_refined(spark, monkeypatch):
    """Sets that share a passage, but don't link, are one block by their keys and none by their sketches; what links stays together
    over slices of sketches and size levels, with and without an id."""
    rng = random.Random(9)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = line(40)
    rows = [(i, passage + " " + line(rng.randrange(30, 60))) for i in range(300)]
    for i in range(60):  # near copies of different sizes
        words = rows[i][1].split()
        rows.append((300 + i if i % 3 else None, " ".join(words[: len(words) - rng.randrange(1, 9)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("SLICE", 20), ("SKETCHES", 30)):
        monkeypatch.setattr(s, name, value)
    seen = []
    real = s._large
    monkeypatch.setattr(s, "_large", lambda *a: seen.append(a[0].count()) or real(*a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in s.grouped(df, 5, 80).where("doc_id is not null").collect()}
    want = brute([(10**6 + k if i is None else i, t) for k, (i, t) in enumerate(rows)], 5, 80)
    assert got == {i: want[i] for i in got} and len(got) == 340
    assert not seen and sum(i != root for i, (_, root) in got.items()) > 20
