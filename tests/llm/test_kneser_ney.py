import math
import random
from collections import Counter, defaultdict

import pytest

from hanagram.llm import kneser_ney as k


def wide(text):
    """A text whose characters from U+07C0 on are two characters each."""
    return "".join(c if ord(c) < 0x7C0 else chr(0x10000 + ord(c) // 1024) + chr(0x20000 + ord(c) % 1024) for c in text)


def brute(trusted, text):
    """The log-perplexity of a text by loops over strings."""
    n, trusted, text = k.ORDER, list(map(wide, trusted)), wide(text)
    top = Counter()
    for t in trusted:
        for w in t.split():
            s = "\0" * (n - 1) + w + "\1"
            top.update(s[i : i + n] for i in range(len(s) - n + 1))
    counts = {n: top}
    for m in range(n - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    cut, total, freed = {}, defaultdict(int), defaultdict(float)
    for m, c in counts.items():
        of = Counter(min(x, 5) for x in c.values())
        y = of[1] / max(of[1] + 2 * of[2], 1)
        d = [min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.05), i) if of[i] and of[i + 1] else 0.5 * i for i in (1, 2, 3)]
        for g, x in c.items():
            cut[g] = d[min(x, 3) - 1]
            total[m, g[:-1]] += x
            freed[m, g[:-1]] += cut[g]

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        m, c = len(g), g[:-1]
        low = p(g[1:])
        if (m, c) not in total:
            return low
        return (counts[m][g] - cut[g] if g in counts[m] else 0) / total[m, c] + freed[m, c] / total[m, c] * low

    logs = []
    for w in text.split():
        s = "\0" * (n - 1) + w + "\1"
        logs += [math.log(p(s[i : i + n])) for i in range(len(s) - n + 1)]
    return -sum(logs) / len(logs) if logs else None


def test_scores_equal_brute_force(spark):
    rng = random.Random(1)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(1, 6)))
    rows = [(i, " ".join(word("abcde") for _ in range(30)), "en" if i % 3 else "fr") for i in range(60)] + [(60, "zzz ab 你好", "en"), (61, "abc", "xx"), (62, "", "en"), (63, None, None)]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, trusted boolean").repartition(3)
    good = {i for i in range(0, 60, 2)}
    got = {r["doc_id"]: r["log_perplexity"] for r in k.scored(df, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows:
        trusted = [x for j, x, la in rows if j in good and la == lang]
        want = brute(trusted, t or "") if trusted else None
        assert got[i] == (pytest.approx(want, abs=1e-4) if want is not None else None), i


def test_classify(spark, docs, no_docs):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(80))
    rows = [(i, text(), "en") for i in range(120)] + [(200 + i, " ".join(w.upper() + "!!" for w in text().split()), "en") for i in range(10)] + [(300, "QQ%%", "xx"), (None, "x", "en")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, limit int")
    trusted = spark.createDataFrame([(i,) for i in [*range(60), None, 0]], "doc_id long")
    out = {r["doc_id"]: r["keep"] for r in k.classify(df, trusted).collect()}
    assert all(out[i] for i in range(120)) and not any(out[200 + i] for i in range(10)) and out[300]
    kept = k.kept(df, trusted)
    assert kept.columns == df.columns and kept.count() == len(rows) - 10
    assert k.classify(docs, trusted).count() == 8 and k.classify(no_docs, trusted).count() == 0
    assert all(r["keep"] for r in k.classify(docs, trusted.where("false")).collect())


def test_texts_without_words_and_few_trusted_ones(spark):
    """A text without words beside others of its language has a row, and trusted documents of one score reject nothing."""
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("etaoinsh") for _ in range(6)) for _ in range(60))
    good = [(i, text(), "en") for i in range(60)]
    same = text()
    few = [(100 + i, same, "fr") for i in range(20)] + [(200, "QQ ZZ " * 500, "fr"), (201, "vowels", "fr"), (300, "só", "pt"), (301, "ßß " * 900, "pt")]
    odd = [(400, "", "en"), (401, " \n\t", "en"), (402, None, "en"), (403, "", "fr"), (404, "#@! " * 300, "en")]
    df = spark.createDataFrame(good + few + odd, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in [*range(60), *range(100, 120), 300]], "doc_id long")
    out = {r["doc_id"]: r for r in k.classify(df, trusted).collect()}
    assert len(out) == df.count() and {i for i, r in out.items() if not r["keep"]} == {404}
    assert all(out[i]["limit"] is None for i in (400, 401, 402, 403, 200, 301)) and out[404]["limit"] is not None
    assert k.kept(df, trusted).count() == df.count() - 1


def test_repeated_words_are_rejected(spark):
    """Words that are usual by themselves, one of them over and over."""
    rng = random.Random(3)
    nouns = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(4, 8))) for _ in range(30)]
    text = lambda: ". ".join("The " + " ".join(rng.choice(nouns) + rng.choice((" of", " and", "")) for _ in range(12)) for _ in range(8)) + "."
    rows = [(i, text(), "en") for i in range(120)] + [(200 + i, " ".join(["of"] * 100), "en") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r["keep"] for r in k.classify(df, spark.createDataFrame([(i,) for i in range(100)], "doc_id long")).collect()}
    assert all(out[i] for i in range(120)) and not any(out[200 + i] for i in range(4))


def test_running_keeps_every_gram():
    texts = ["ab cd  efgh" * 5, "", "x", "é 你好 " * 9]
    whole = [k.grams(["\1".join(t.split())])[0].tolist() if t.split() else [] for t in texts]
    for chars in (3, 7, 10_000):
        got = [[] for _ in texts]
        for keys, number in k.running(texts, chars):
            for key, i in zip(keys.tolist(), number.tolist()):
                got[i].append(key)
        assert got == whole


def test_wide_characters_are_told_apart():
    keys = [k.grams([chr(c)])[0].tolist() for c in (0x4E00, 0x4E00 + 2039, 0x4E00 + 1024, 0x7C0, 0x10FFFF, 0x61)]
    assert len(set(map(tuple, keys))) == len(keys) and [len(x) for x in keys] == [3, 3, 3, 3, 3, 2]
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab 東京大学図書館\0\1") for _ in range(rng.randrange(60))) for _ in range(50)]
    whole = [x.tolist() for _, x in zip([0], [next(k.running(texts))[0]])][0]
    for chars in (7, 30):  # pieces
        assert [x for keys, _ in k.running(texts, chars) for x in keys.tolist()] == whole
    lines = ["\0" * 4 + wide("\1".join(t.replace("\0", " ").replace("\1", " ").split())) + "\1" for t in texts if t.replace("\0", "").replace("\1", "").strip()]
    assert len(whole) == sum(len(x) - 4 for x in lines) and len(set(whole)) == len({x[i : i + 5] for x in lines for i in range(len(x) - 4)})


def test_ids_survive_compression():
    import numpy as np

    ids = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 5000))
    assert (k.unsqueezed(k.squeezed(ids)) == ids).all() and len(k.unsqueezed(k.squeezed(ids[:0]))) == 0
