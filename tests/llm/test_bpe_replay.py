import random
import time

import numpy as np
import public_tokenizers as P
import tiktoken
import zstandard

from hanagram.llm import bpe_replay as b

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.read_ranks(PATH), special_tokens={})


def test_equals_tiktoken():
    rng, own, ref = random.Random(1), b.Encoder(PATH, P.PATTERN), reference()
    texts = ["".join(rng.choice("ab'sdtre  \n\t éßσ你好🙂0123aaaa!?\x1cć") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 2000, " " * 100, "<|endoftext|>", "", "x\n\ny \n z", "\n", " a", "a "]
    for lo, hi in b.slices(texts, 5000):
        for t, ids in zip(texts[lo:hi], own.encode(texts[lo:hi])):
            assert ids == ref.encode_ordinary(t), repr(t)
            assert own.decode(ids) == t.encode()


def test_lower_ranks_made_by_a_merge_come_first():
    ranks = {bytes([c]): 10 + c for c in range(97, 103)} | {b"ab": 5, b"abc": 1, b"ca": 2}
    rng = random.Random(2)
    words = [b"abcab", b"abca", b"cabab", b"aaaa", b""] + ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 60))).encode() for _ in range(400)]
    words = list(dict.fromkeys(words))
    parts = [b"aa", b"bb", b"abab", b"aab", b"ba", b"cc", b"ccc", b"cabab", b"de", b"ded", b"fde", b"eded"]
    for ranks in (ranks, ranks | {w: r for w, r in zip(parts, rng.sample(range(20, 60), len(parts)))}, ranks | {w: r for w, r in zip(parts, rng.sample(range(200, 260), len(parts)))}):
        ranks = {w: r for w, r in ranks.items()}
        for r in list(ranks.values()):
            assert list(ranks.values()).count(r) == 1
        check(words, ranks)


def check(words, ranks):
    """The algorithm of one word at a time: always the pair of least rank, of equals the leftmost."""

    def one(w):
        parts = [w[i : i + 1] for i in range(len(w))]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    merges = b.Merges(ranks)
    want = [[ranks[w]] if w in ranks else one(w) for w in words]
    assert b.replay(words, ranks, merges) == want
    assert [b.alone_ids(w, merges) for w in words if w and w not in ranks] == [x for w, x in zip(words, want) if w and w not in ranks]


def test_words_of_many_hold_ups(monkeypatch):
    monkeypatch.setattr(b, "HOLD_UPS", 1)
    ranks = {bytes([c]): 10 + c for c in range(97, 103)} | {b"ab": 5, b"abc": 1, b"ca": 2}
    check([b"abcabcab" * 50, b"abab" * 30 + b"c", b"ab", b"cab" * 40], ranks)


def test_very_long_words_take_linear_time():
    own, ref = b.Encoder(PATH, P.PATTERN), reference()
    for text in ("a" * 5_000_000, "ab" * 500_000, "ych" * 300_000, "wifeerst" * 100_000, "é" * 500_000):
        began = time.time()
        ids = next(own.encode([text]))
        assert time.time() - began < 20, text[:10]
        if len(text) <= 1_000_000:
            assert ids == ref.encode_ordinary(text)


def test_frames(spark, docs, no_docs):
    ref = reference()
    enc = b.encode(docs, PATH, P.PATTERN)
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in enc.collect()) == sorted((r["doc_id"] or 0, ref.encode_ordinary(r["text"] or "")) for r in docs.collect())
    back = b.decode(enc, PATH, P.PATTERN)
    assert sorted(bytes(r["bytes"]).decode() for r in back.collect()) == sorted(r["text"] or "" for r in docs.collect())
    assert b.digests(docs, PATH, P.PATTERN).count() == 8 and b.digests(no_docs, PATH, P.PATTERN).count() == 0


def test_sizes_survive_planes():
    """Sizes by byte planes come back, and take less than as they are."""
    for n in (0, 1, 5000):
        sizes = np.random.default_rng(n).integers(1, 400, n).astype("<u4")
        packed = b._planes(sizes)
        assert (b._unplaned(packed) == sizes).all() and len(packed) == 4 * n
    z = zstandard.ZstdCompressor(level=b.PACKED)
    assert len(z.compress(packed)) < len(zstandard.ZstdCompressor(level=3).compress(sizes.tobytes()))
