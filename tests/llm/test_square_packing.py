import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from hanagram.llm import square_packing as s

PATH = P.path("word_bpe_49k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_tokens_equal_the_library():
    rng, t = random.Random(1), library()
    texts = ["".join(rng.choice("ab'sdtre.,  \n\t éßΣσ你好🙂0123aaaa!?\x1cćİ") for _ in range(rng.randrange(40))) for _ in range(3000)] + ["<|endoftext|> a", "x<|startoftext|>", "<|ENDOFTEXT|>, a<|endoftext|>. b", "It's l'eau", ""]
    texts += [" ".join("".join(rng.choice("etaoinshrdluEÀéçßöñ") for _ in range(rng.randrange(1, 40))) + rng.choice(["", ".", ",***", "!!", "'"]) for _ in range(30)) for _ in range(300)]
    for x, got in zip(texts, s.tokens(PATH).packed(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_level_is_the_least_sum_of_squares():
    rng = random.Random(2)
    for _ in range(300):
        p = s.Packer(16)
        for _ in range(rng.randrange(12)):
            p.count[rng.randrange(1, 16)] += 1
        n = rng.randrange(1, 16)

        def total(at):
            c = p.count.copy()
            if at:
                c[at] -= 1
            if at + n < 16:
                c[at + n] += 1
            return int((c**2).sum())

        choices = [at for at in range(0, 16 - n + 1) if at == 0 or p.count[at]]
        best = min(map(total, choices))
        assert p.level(n) == max(at for at in choices if total(at) == best)


def test_pieces(spark, docs, no_docs):
    t = library()
    for df in (docs, docs.repartition(3), docs.where("doc_id = 4")):
        rows = s.pack(df, PATH, 64, with_ids=True).collect()
        windows, got = defaultdict(list), defaultdict(list)
        for r in rows:
            assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            windows[r["sequence_id"]].append((r["offset"], r["length"]))
            got[r["doc_id"]].append((r["start"], r["ids"], r["doc_tokens"]))
        for w in windows.values():
            at = 0
            for offset, n in sorted(w):
                assert offset == at
                at += n
            assert at == 64 or at & (at - 1) == 0
        for d in df.collect():
            want = t.encode(d["text"] or "", add_special_tokens=False).ids + [2]
            assert all(x[2] == len(want) for x in got[d["doc_id"]])
            if d["doc_id"] != 5:  # the repeated row's pieces come twice
                assert [i for x in sorted(got[d["doc_id"]]) for i in x[1]] == want
    assert s.pack(no_docs, PATH).count() == 0
