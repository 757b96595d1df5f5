import hashlib
import random

from hanagram.llm import spot_signatures as s


def sets(text):
    """The signatures of a text as tuples of words, by a loop."""
    words = [w.lower() for w in s._WORD.findall(text)]
    out, last = set(), -1
    for i, w in enumerate(words):
        last = i if w in s.ANCHORS else last
        if w in s.ANCHORS or i - last >= s.GAP:
            after = [x for x in words[i + 1 :] if x not in s.ANCHORS][: s.CHAIN]
            if len(after) == s.CHAIN:
                out.add((w, *after))
    run = ""
    for c in text + " ":
        run = run + c if ord(c) >= 0x2E80 else ""
        if len(run) >= 3:
            out.add(run[-3:])
    if len(out) < s.FEW and len(words) > 1:
        out |= set(zip(words, words[1:]))
    return out or ({words[0]} if words else {(text,)} if text else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a and b else float(a == b)


def test_against_next(spark, docs, no_docs):
    rng = random.Random(1)
    words = "the cat sat on a mat and of dog is house red in blue that tree for it run".split()
    rows = [(i * 3 % 101, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(101)]
    rows += [(200, None), (201, "é, 你好! 🙂"), (202, "!!"), (203, "東京大学図書館の古い地図" * 3), (204, "x"), (205, "the cat")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(4)
    got = {r["doc_id"]: r for r in s.against_next(df).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt, r = t or "", nxt or "", got[i]
        n = len(t) // 4
        edited = t[: len(t) - n] + nxt[:n]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r["fingerprint"]) == 8 * len(sets(t)) and len(r["edited_fingerprint"]) == 8 * len(sets(edited))
        assert abs(r["near_edited"] - likeness(sets(t), sets(edited))) < 1e-9 and abs(r["near_next"] - likeness(sets(t), sets(nxt))) < 1e-9
    assert s.against_next(docs).count() == 8 and s.against_next(no_docs).count() == 0
    one = s.against_next(df.where("doc_id = 201")).first()
    assert one["near_next"] == 1.0


def test_edits_of_texts_without_anchors(spark):
    """Three quarters of a text stay, and so does a good part of its fingerprint."""
    rng = random.Random(3)
    texts = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(120)), " ".join("".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(4)) for _ in range(40)), "zig " + " ".join(f"w{i}" for i in range(60))]
    got = s.against_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(0.3 < r["near_edited"] < 1 and r["near_next"] < 0.1 for r in got)


def test_classes(spark, docs, no_docs):
    rng = random.Random(2)
    words = "the cat sat on a mat and of dog is house red in blue that tree for it run far sky sea sun".split() + [f"w{i}" for i in range(60)]
    rows = []
    for size in (12, 60, 200, 200, 400):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randrange(size // 12 + 1)):
                w[rng.randrange(size)] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(100, ""), (101, None), (102, rows[0][1]), (103, "w1 w2")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, h string").repartition(3)
    every = {i: sets(t or "") for i, t in rows}
    up = {i: i for i in every}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in every.items():
        for j, b in every.items():
            if i < j and a and b and likeness(a, b) >= 0.8:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    want = {i: root(i) for i in every}
    assert len(set(want.values())) < len(want) - 15
    assert {r["doc_id"]: r["class_id"] for r in s.classes(df).collect()} == want
    assert {r["doc_id"]: r["class_id"] for r in s.against_next(df, percent=80).collect()} == want
    assert s.classes(docs).count() == 7 and s.classes(no_docs).count() == 0


def test_similar_sets_share_a_key():
    rng = s.np.random.default_rng(5)
    frequent = s.np.unique(rng.integers(0, 2**32, 30).astype(s.np.uint64))
    for percent in (80, 60):
        for n in (1, 2, 3, 5, 9, 30, 200):
            for _ in range(30):
                a = s.np.unique(s.np.concatenate([rng.integers(0, 2**32, n), rng.choice(frequent, min(n, 9))]).astype(s.np.uint64))
                b = s.np.unique(s.np.concatenate([rng.permutation(a)[rng.integers(0, n // 5 + 1) :], rng.integers(0, 2**32, rng.integers(0, n // 6 + 1)).astype(s.np.uint64)]))
                if s.jaccard(a, b) >= percent / 100:
                    assert len(s.np.intersect1d(s.length_keys(a, percent, frequent), s.length_keys(b, percent, frequent)))
