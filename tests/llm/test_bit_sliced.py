import numpy as np
import pytest

from hanagram.llm import bit_sliced as b


def brute(rows, k, every):
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q in sorted({i for i, _ in good if i % every == 0}):
        v = next(v for i, v in good if i == q)
        n = [(-int(sum(int(x) * int(y) for x, y in zip(v, w))), i) for i, w in good if i != q]
        out[q] = [(i, -s) for s, i in sorted(n)[:k]]
    return out


def test_index_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, d, m = rng.integers(1, 90), rng.integers(1, 5), rng.integers(1, 6)
        v, q, w = rng.integers(-m, m + 1, (n, d)), rng.integers(-m, m + 1, d), int(rng.integers(0, n))
        s = v @ q
        want = [(int(j), int(s[j])) for j in np.lexsort((np.arange(n), -s)) if j != w][:5]
        assert b.Index(np.arange(n), v).top(q, 5, w) == want


def test_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)]
    rows += [(700 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(800, None), (850, [1.0, None]), (900, [float("nan")] * 8), (950, [float("inf")] * 8), (None, [1.0] * 8), (1000, [1.0, 2.0]), (1050, []), (1051, [1e6] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, id string")
    got = {}
    for r in b.search(df, 5, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(rows, 5, 50)
    assert got == want
    assert b.search(df.where("false")).count() == 0
    assert b.search(df.where("vec_id in (0, 1)")).count() == 1
    truth = spark.createDataFrame([(q, v) for q, r in want.items() for v, _ in r], "query_id long, vec_id long")
    assert b.recall(b.search(df), truth) == 1.0


def test_large_components_are_not_capped(spark):
    """Products beyond 53 bits are exact, and what a long can't hold is an error."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.integers(0, 5)]) for i in range(400)]
    rows += [(400, [1e8, -1e8, 1.0, 0.0]), (401, [-1e9, 1e9, 0.0, 0.0]), (402, [65536.0, 65537.0, 0.5, -65535.75])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in b.search(df, 5, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(rows, 5, 50)
    for x in (1e9, 1e30):  # the square of 256 * 1e9 has 66 bits
        with pytest.raises(Exception, match="64 bits"):
            b.search(spark.createDataFrame([(0, [x]), (1, [x])], "vec_id long, embedding array<double>")).collect()


def test_blocks_and_turns(spark, monkeypatch):
    """Any numbers of candidate blocks and query blocks give the same rows."""
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(-3, 4, 5)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 5, 50)
    for few, queries, block in ((4, 16, 16_384), (1, 1, 16_384), (64, 16, 300)):
        monkeypatch.setattr(b, "FEW_BLOCKS", few)
        monkeypatch.setattr(b, "FEW_QUERIES", queries)
        monkeypatch.setattr(b, "BLOCK", block)
        got = {}
        for r in b.search(df).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert got == want
