import math
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as c
from hanagram.llm import kneser_ney as k
from hanagram.llm import queries as q
from hanagram.llm import secret_cost
from hanagram.llm.common import components, written

from test_shingle_product import brute

SF = "/root/testdata/sf0.001"


def judged(docs, trusted):
    """The ids that the quality classifier keeps, by loops over strings and sorted lists."""
    order, langs = k.ORDER, {}
    line = lambda t: "\0" * (order - 1) + "\1".join(t.split()) + "\1" if t.split() else ""
    for d in docs:
        langs.setdefault(d["lang"] or "", []).append(d)
    kept = set()
    for rows in langs.values():
        top = Counter()
        for d in rows:
            if d["doc_id"] in trusted and not k.held_out(d["doc_id"]):
                x = line(d["text"] or "")
                top.update(x[i : i + order] for i in range(len(x) - order + 1))
        counts = {order: top}
        for m in range(order - 1, 0, -1):
            counts[m] = Counter(g[1:] for g in counts[m + 1])
        cut, total, freed = {}, defaultdict(int), defaultdict(float)
        for m, c in counts.items():
            of = Counter(min(x, 5) for x in c.values())
            y = of[1] / max(of[1] + 2 * of[2], 1)
            d_ = [min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.05), i) if of[i] and of[i + 1] else 0.5 * i for i in (1, 2, 3)]
            for g, x in c.items():
                cut[g] = d_[min(x, 3) - 1]
                total[m, g[:-1]] += x
                freed[m, g[:-1]] += cut[g]
        known = {}

        def p(g):
            if g not in known:
                if not g:
                    return 1 / (len(counts[1]) + 1)  # noqa: B023
                m, c, low = len(g), g[:-1], p(g[1:])
                known[g] = low if (m, c) not in total else (counts[m][g] - cut[g] if g in counts[m] else 0) / total[m, c] + freed[m, c] / total[m, c] * low  # noqa: B023
            return known[g]

        scored = []
        for d in rows:
            x = line(d["text"] or "")
            n = max(0, len(x) - order + 1)
            scored.append((d["doc_id"], n, -sum(math.log(p(x[i : i + order])) for i in range(n)) / n if n and top else None))
        held = sorted(s - k.SLACK / math.sqrt(n) for i, n, s in scored if s is not None and i in trusted and k.held_out(i))
        held = held or sorted(s - k.SLACK / math.sqrt(n) for i, n, s in scored if s is not None and i in trusted)
        at = lambda q: held[math.ceil(q * len(held)) - 1]  # noqa: B023, E731
        limit = at(0.5) + k.WIDTH * (at(k.QUANTILE) - at(0.5)) if held else None
        kept |= {i for i, n, s in scored if s is None or limit is None or s <= limit + k.SLACK / math.sqrt(n)}
    return kept


def test_against_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    good = judged(rows, trusted)
    first = brute([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in good], 5, 80)
    stay = {i for i, (_, root) in first.items() if i == root}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in rows:
        if r["doc_id"] in stay:
            text = r["text"] or ""
            spans = [(a, b) for a, _, b in secret_cost.find(text)[1]]
            begins = {a for a, _ in spans if not any(x < a < y for x, y in spans)}
            marked = "".join("[SECRET]" if i in begins else "" if any(a <= i < b for a, b in spans) else ch for i, ch in enumerate(text))
            want[r["doc_id"]] = library.encode(marked, add_special_tokens=False).ids + [2]
    got = {}
    for r in sorted(c.run(spark, SF).collect(), key=lambda r: (r["doc_id"], r["start"])):
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert got == want and len(good) < len(rows) and len(stay) < len(good)


def test_stages_on_odd_rows(spark, docs, no_docs):
    """Nulls, empty and repeated rows, and no rows at all, go through every stage."""
    for df in (docs, no_docs):
        out = df.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
        for _, stage in c.STAGES[:-1]:
            out = written(stage(spark, out, SF), "odd")
            assert out.columns == list(c.COLUMNS)
        ids = {r["doc_id"] for r in c.packing(spark, out, SF).collect()}
        assert ids == ({1, 2, 3, 4, 7, None} if df is docs else set())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for (name, stage), _ in zip(c.STAGES, range(3)):
        out = stage(spark, docs, SF)
        assert out.columns == list(c.COLUMNS), name
        docs = out.cache()
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        before = set(ids)
    pieces = c.packing(spark, docs, SF).groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"] for r in pieces} == before
    assert {r["doc_id"] for r in c.run(spark, SF).select("doc_id").distinct().collect()} == before


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_sql(spark, name):
    df = q.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    found = con.execute(q.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    key = lambda r: tuple("" if v is None or isinstance(v, float) and math.isnan(v) else str(v) for v in r)
    assert sorted(map(key, df.select(*names).collect())) == sorted(map(key, found.fetchall()))


def test_components(spark, monkeypatch):
    from hanagram.llm import common

    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (70, 70), (90, 100)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {**{i: 0 for i in range(31)}, 50: 50, 70: 50, 90: 50, 100: 50}
    for bound in (500_000, 0):
        monkeypatch.setattr(common, "ONE_TASK_EDGES", bound)
        assert {r["node"]: r["root"] for r in components(df).collect()} == want
