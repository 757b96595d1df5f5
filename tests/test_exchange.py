"""Exchange files in pieces: lists of many pieces, shards, and odd JSON."""

import json

import pytest

from hanagram.functions import codec
from hanagram.functions.classes import is_latin
from hanagram.functions.normalize import Normalizer
from hanagram.operators.index import Schema, build
from hanagram.sources import index_files, stores

PLAIN = Normalizer((), compatibility=False)


@pytest.fixture(scope="module")
def index(spark):
    rows = [(3 * i, f'r"{i}\\', f"common word{i % 7} 東京大学" if i % 5 else None, f"b{i % 3};c", str(1900 + i % 9) if i % 4 else None) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc long, ref string, title string, type string, date string").withColumn("sub", docs_sub())
    return build(docs, Schema(["title", "sub"], {"sub": 2}, {"type": {"kind": "value", "separator": ";"}, "date": "year"}, PLAIN)).cache()


def docs_sub():
    from pyspark.sql import functions as F

    return F.when(F.col("doc") % 2 == 0, "common sub")


def postings(index):
    return sorted((r["token"], r["doc"], r["field"], r["tf"], r["positions"]) for r in index.postings.collect())


def expected(index):
    """The whole file as one value, from tables that the driver takes."""
    docs = sorted((r["doc"], r["ref"]) for r in index.docs.collect())
    to = {d: i for i, (d, _) in enumerate(docs)}
    lists = {}
    for t, d, f, _, ps in postings(index):
        lists.setdefault(t, []).append((to[d], f, ps))
    lengths = [0] * (2 * len(docs))
    for r in index.lengths.collect():
        lengths[to[r["doc"]] * 2 + r["field"]] = r["len"]
    return [r for _, r in docs], lengths, {t: codec.encode(lists[t], 2) for t in sorted(lists)}


def test_pieces_are_the_whole_file(spark, index, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    monkeypatch.setattr(index_files, "BATCH", 11)
    monkeypatch.setattr(index_files, "CHUNK", 64)
    try:
        refs, lengths, tokens = expected(index)
        one, folder = tmp_path / "one.json", tmp_path / "split"
        index_files.write_file(index, str(one))
        data = json.loads(one.read_text(encoding="utf-8"))
        assert (data["refs"], data["lengths"], list(data["tokens"].items())) == (refs, lengths, list(tokens.items()))
        assert data["filters"]["type"]["values"] == ["b0", "c", "b1", "b2"] and data["filters"]["type"]["docs"][:3] == [[0, 1], [2, 1], [3, 1]]
        assert data["filters"]["date"]["docs"][:3] == [None, 1901, 1902]
        for size in (300, 4000):
            index_files.write_split(index, str(folder), size)
            manifest = json.loads((folder / "index.json").read_text(encoding="utf-8"))
            shards, part, n = [], {}, 0  # whole pairs go into a shard until the next one is too many
            for t, v in tokens.items():
                k = len(index_files._json({t: v}).encode()) - 2
                if n and n + k > size:
                    shards.append(part)
                    part, n = {}, 0
                part[t] = v
                n += k + 1
            shards.append(part)
            assert [json.loads((folder / name).read_text(encoding="utf-8")) for _, name in manifest["shards"]] == shards
            assert [first for first, _ in manifest["shards"]] == [next(iter(s)) for s in shards]
            assert json.loads((folder / manifest["latin"]).read_text(encoding="utf-8")) == [t for t in tokens if is_latin(t)]
            assert len(list(folder.iterdir())) == len(shards) + 2
            assert sorted(r["token"] for r in index_files.latin_words(spark, str(folder)).collect()) == [t for t in tokens if is_latin(t)]
        for path in (one, folder):
            back = index_files.read(spark, str(path), PLAIN)
            assert postings(back) == [(t, d, f, len(p), p) for t, v in tokens.items() for d, f, p in codec.decode(v, 2)]
            assert [r["ref"] for r in back.refs().collect()] == refs
            assert sorted((r["doc"] * 2 + r["field"], r["len"]) for r in back.lengths.collect()) == list(enumerate(lengths))
            assert back.filter_values.count() == 1000 and back.filter_years.count() == 375
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_driver_takes_no_table(spark, index, tmp_path, monkeypatch):
    """Neither rows nor whole texts come to the driver."""
    from pyspark.sql import DataFrame

    def no(*_, **__):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", no)
    monkeypatch.setattr(stores, "read_text", no)
    index_files.write_file(index, str(tmp_path / "one.json"))
    monkeypatch.setattr(spark, "createDataFrame", lambda rows, *a, f=spark.createDataFrame, **k: f(rows, *a, **k) if not rows else no())
    monkeypatch.setattr(json, "loads", lambda s, *a, f=json.loads, **k: f(s, *a, **k) if len(s) < 3000 else no())
    assert index_files.read(spark, str(tmp_path / "one.json"), PLAIN).docs.count() == 500


def test_odd_json(spark, tmp_path):
    odd = tmp_path / "odd.json"
    odd.write_text('{"tokens" :\n{"a\\u0022b": "#$#",\r\n "c": [1, 0, 1,\n 0]}, "refs":["x\\n[1]\\t", null],\n"lengths" : [1 , 2], "other": {"a": [[1], {"b": null}]},\n "fields":["t"], "boosts":[1.5],"format":"x/3", "filters": {}}\n', encoding="utf-8")
    back = index_files.read(spark, str(odd), PLAIN)
    assert [r["ref"] for r in back.refs().collect()] == ["x\n[1]\t", None]
    assert {(t, d) for t, d, *_ in postings(back)} >= {("c", 1)}
    for bad in ("[1]", "{", '{"format":"x/4","fields":["t"],"boosts":[1],"refs":["a"],"lengths":[]}', '{"format":"x/4","tokens":{"a":{}}}'):
        odd.write_text(bad, encoding="utf-8")
        with pytest.raises((ValueError, KeyError)):
            index_files.read(spark, str(odd), PLAIN)


def test_numbers_are_not_broadcast(spark, index):
    moved = index_files.dense(index)
    assert sorted(r["doc"] for r in moved.docs.collect()) == list(range(500))
    assert "BroadcastHashJoin" not in moved.postings._jdf.queryExecution().executedPlan().toString()
    assert index_files.dense(moved).docs is moved.docs  # dense ones stay as they are
