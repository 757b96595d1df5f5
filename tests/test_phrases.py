"""Phrases matched by arrays, against brute force."""

import random
from collections import defaultdict

from hanagram.operators.search import phrase_hits


def test_phrase_hits_by_brute_force(spark):
    rng = random.Random(5)
    postings, at = [], defaultdict(set)
    for doc in range(40):
        for field in range(2):
            for token in "abcd":
                ps = sorted(rng.sample(range(30), rng.randint(0, 12)))
                if ps:
                    postings.append((token, doc, field, len(ps), ps))
                    at[doc, field, token] = set(ps)
    # (qid, phrase) to parts, each with its offset and its tokens in the order of alt.
    asked = {(0, 0): [(0, "ab"), (1, "b"), (3, "c")], (0, 1): [(0, "dca")], (1, 0): [(0, "a"), (2, "a")], (1, 1): [(0, "a"), (1, "z")], (2, 0): [(0, "cbd"), (1, "dc")]}
    alts = [(q, p, i, off, len(parts), t, k) for (q, p), parts in asked.items() for i, (off, ts) in enumerate(parts) for k, t in enumerate(ts, 1)]
    want = set()
    for (q, p), parts in asked.items():
        for doc in range(40):
            for field in range(2):
                if len(parts) == 1:
                    met = [(k, len(at[doc, field, t])) for k, t in enumerate(parts[0][1], 1) if at[doc, field, t]]
                    tf, first = sum(n for _, n in met), min((k for k, _ in met), default=0)
                else:
                    starts = set.intersection(*({x - off for t in ts for x in at[doc, field, t]} for off, ts in parts))
                    tf, first = len(starts), min((k for k, t in enumerate(parts[0][1], 1) if starts & at[doc, field, t]), default=0)
                if tf:
                    want.add((q, p, doc, field, tf, first))
    df = spark.createDataFrame(postings, "token string, doc long, field int, tf int, positions array<int>")
    found = phrase_hits(df, spark.createDataFrame(alts, "qid long, phrase int, part int, at int, n_parts int, token string, alt int"))
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan  # a row for each position would be dealt out
