import random

import pytest
from pyspark.sql import functions as F

from hanagram import plans
from hanagram.functions.normalize import Normalizer
from hanagram.operators.index import Schema, build, numbered
from hanagram.operators.search import facets, facets_without_own, passing, search
from hanagram.operators.updates import applied, compacted, updated
from hanagram.sources import index_files, records, snapshots

JA = Normalizer(("ja",))


def index_of(spark, rows, fields, boosts=None, filters=(), normalizer=JA):
    docs = records.documents(records.from_rows(spark, rows), "ref")
    return build(docs, Schema(fields, boosts or {}, filters, normalizer)).cache()


def refs(index, query, **kw):
    return [r["ref"] for r in search(index, query, **kw).orderBy("rank").collect()]


@pytest.fixture(scope="module")
def basic(spark):
    return index_of(spark, [{"ref": "a", "title": "東京帝國大學本部構内及農學部建物鳥瞰圖"}, {"ref": "b", "title": "建物位置圖", "creator": "東京大学"}, {"ref": "c", "title": "國牛十圖"}], ["title", "creator"], {"title": 3})


@pytest.fixture(scope="module")
def filtered(spark):
    rows = [
        {"ref": "map1", "title": "東京帝國大學本部構内及農學部建物鳥瞰圖", "type": ["地圖"], "era": "明治;大正", "date": "1900-01-01"},
        {"ref": "map2", "title": "東京大学農学部 構内図", "type": ["地図"], "era": "昭和", "date": "１９３１年"},
        {"ref": "photo1", "title": "農学部 正門", "type": ["写真"], "era": "大正", "date": "1923"},
        {"ref": "book1", "title": "群芳圖譜", "type": ["図譜", "書籍"], "era": " 明治 ", "date": "明治33年"},
        {"ref": "none", "title": "農学部 資料"},
    ]
    return index_of(spark, rows, ["title"], filters={"type": "value", "era": {"kind": "value", "separator": ";"}, "date": "year"})


def test_golden_searches(basic):
    asked = dict(enumerate(["鳥瞰図", "建物", "東京大学", "牛", "存在しない", "図", "", "建物 東京大学"]))
    rows = search(basic, list(asked.items())).orderBy("qid", "rank").collect()
    got = {q: [r["ref"] for r in rows if r["qid"] == i] for i, q in asked.items()}
    assert got == {"鳥瞰図": ["a"], "建物": ["b", "a"], "東京大学": ["b"], "牛": ["c"], "存在しない": [], "図": ["c", "b", "a"], "": [], "建物 東京大学": ["b"]}
    assert next(r["fields"] for r in rows if r["qid"] == 7) == ["title", "creator"]


def test_lengths_and_postings(spark):
    index = index_of(spark, [{"ref": "a", "title": ["國牛十圖"], "subject": ["牛"]}, {"ref": "b", "title": ["建物位置圖"], "subject": None}, {"ref": "c", "title": None, "subject": ["植物", "動物"]}], ["title", "subject"])
    assert [r["len"] for r in index.lengths.orderBy("doc", "field").collect()] == [4, 1, 5, 0, 0, 5]
    at = lambda t: [(r["doc"], r["field"], r["positions"]) for r in index.postings.where(F.col("token") == t).orderBy("doc", "field").collect()]
    assert at("牛") == [(0, 0, [1]), (0, 1, [0])] and at("図") == [(0, 0, [3]), (1, 0, [4])] and at("国牛") == [(0, 0, [0])]
    assert at("物") == [(1, 0, [1]), (2, 1, [1, 4])] and at("物動") == []


def test_latin_words(spark):
    index = index_of(spark, [{"ref": "a", "title": "IIIF Manifest 解説"}, {"ref": "b", "title": "Photograph of 桜"}], ["title"])
    assert [refs(index, q) for q in ("mani", "photgraph", "manifest 解説", "iii 桜")] == [["a"], ["b"], ["a"], []]
    assert [refs(index, q, prefix=False, typos=False) for q in ("mani", "photgraph")] == [[], []]


def test_scores(spark):
    one = index_of(spark, [{"ref": "a", "title": "constructors"}], ["title"])
    assert search(one, "constructors").first()["score"] == pytest.approx(0.28768, abs=1e-5)
    assert search(one, "constructor").first()["score"] == pytest.approx(0.17261, abs=1e-5)


def test_filters(filtered):
    assert sorted(refs(filtered, "農学部")) == ["map1", "map2", "none", "photo1"]
    assert refs(filtered, "構内", filters={"type": "地図"}) == ["map2", "map1"]
    for condition, want in (({"era": "明治"}, ["map1", "book1"]), ({"date": (1900, 1925)}, ["map1", "photo1"]), ({"date": {"min": 1920}}, ["map2", "photo1"]), ({"date": 1923, "era": "大正"}, ["photo1"]), ({}, ["map1", "map2", "photo1", "book1", "none"]), ({"type": []}, ["map1", "map2", "photo1", "book1", "none"])):
        assert refs(filtered, "", filters=condition) == want
    with pytest.raises(ValueError):
        passing(filtered, {"creator": "x"})
    with pytest.raises(ValueError):
        Schema(["title"], filters={"date": "range"})


def test_filter_keeps_scores(filtered):
    every = {r["ref"]: r["score"] for r in search(filtered, "農学部").collect()}
    for r in search(filtered, "農学部", {"type": ["地図", "写真"]}).collect():
        assert every[r["ref"]] == pytest.approx(r["score"])


def test_facets(filtered):
    got = lambda *a: [(r["value"], r["count"]) for r in facets(filtered, *a).collect()]
    assert got("type") == [("地圖", 2), ("写真", 1), ("図譜", 1), ("書籍", 1)]
    assert got("era", search(filtered, "農学部")) == [("大正", 2), ("明治", 1), ("昭和", 1)]
    assert got("date") == [("1900", 1), ("1931", 1), ("1923", 1)]
    assert {r["value"]: r["count"] for r in facets_without_own(filtered, "農学部", {"era": "大正"})["era"].collect()} == {"大正": 2, "明治": 1, "昭和": 1}


def test_scan_equals_index(spark):
    rng = random.Random(4)
    rows = [{"ref": str(i), "title": "".join(rng.choice("東京大学図") for _ in range(30))} for i in range(40)]
    index = index_of(spark, rows, ["title"])
    docs = records.documents(records.from_rows(spark, rows), "ref").select("doc", JA.column("title").alias("folded")).cache()
    for q in ("東京", "図図", "大学図"):
        scanned = {r["doc"]: r["tf"] for r in plans.scan(docs, JA, q).collect()}
        assert set(scanned) == {r["doc"] for r in search(index, q).collect()}
    assert plans.chosen(JA, "東京", False) == "scan" and plans.chosen(JA, "東京 大学", False) == "index" and plans.chosen(JA, "abc", False) == "index"


def rows_of(index):
    return sorted((r["token"], r["doc"], r["field"], tuple(r["positions"])) for r in index.postings.collect())


def test_random_updates_equal_rebuild(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, f"r{i % 7}", rng.choice(["東京大学", "図書館 a", "植物"])) for i in range(12)], "doc long, ref string, title string")
    model = [(r["doc"], r["ref"], r["title"]) for r in docs.orderBy("doc").collect()]
    changes = []
    for seq in range(40):
        op, ref, title = rng.choice(["add", "remove", "update"]), f"r{rng.randrange(9)}", rng.choice(["鳥瞰図", "b c", "東京"])
        changes.append((seq, op, ref, title))
        at = next((i for i, m in enumerate(model) if m[1] == ref), None)
        if op == "add" or op == "update" and at is None:
            model.append((12 + seq, ref, title))
        elif op == "remove" and at is not None:
            del model[at]
        elif op == "update":
            model[at] = (model[at][0], ref, title)
        model.sort()
    feed = spark.createDataFrame(changes, "seq long, op string, ref string, title string")
    assert sorted((r["doc"], r["ref"], r["title"]) for r in applied(docs, feed).collect()) == model
    schema = Schema(["title"], normalizer=JA)
    index, after = updated(build(docs, schema), docs, feed)
    assert rows_of(index) == rows_of(build(after, schema))
    assert [r["doc"] for r in compacted(after).orderBy("doc").collect()] == list(range(len(model)))


def test_numbered_is_dense(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("v")).repartition(5)
    assert {r["v"]: r["doc"] for r in numbered(df, ["v"]).collect()} == {i: i for i in range(100)}


def test_exchange_files(spark, filtered, tmp_path):
    one, folder = str(tmp_path / "index.json"), str(tmp_path / "split")
    index_files.write_file(filtered, one)
    index_files.write_split(filtered, folder, shard_size=100)
    for path in (one, folder):
        back = index_files.read(spark, path, JA)
        assert rows_of(back) == rows_of(filtered)
        assert refs(back, "構内", filters={"type": "地図"}) == ["map2", "map1"]
    assert len(list((tmp_path / "split").iterdir())) > 4
    old = tmp_path / "old.json"
    old.write_text('{"format":"x/2","variants":["ja"],"fields":["t"],"boosts":[1],"refs":["a"],"lengths":[2],"tokens":{"図書":[0,0,1,0]}}', encoding="utf-8")
    assert refs(index_files.read(spark, str(old), JA), "図書") == ["a"]
    old.write_text('{"format":"x/1"}', encoding="utf-8")
    with pytest.raises(ValueError):
        index_files.read(spark, str(old))


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    docs = spark.createDataFrame([(0, "a", "東京大学"), (1, "b", "図書館")], "doc long, ref string, title string")
    snapshots.write(build(docs, Schema(["title"], normalizer=JA)), docs, root)
    reader = snapshots.Reader(spark, root, interval=0, normalizer=JA)
    assert refs(reader.index(), "東京") == ["a"]
    feed = spark.createDataFrame([(0, "update", "b", "東京図書館")], "seq long, op string, ref string, title string")
    snapshots.update(spark, root, lambda i, d: updated(i, d, feed), JA)
    assert sorted(refs(reader.index(), "東京")) == ["a", "b"]
    with pytest.raises(RuntimeError):
        snapshots.update(spark, root, lambda i, d: (_ for _ in ()).throw(RuntimeError("no")), JA)
    with snapshots.locked(root), pytest.raises(snapshots.LockTimeout), snapshots.locked(root, timeout=0.05):
        pass


def test_search_reads_only_its_tokens(spark, tmp_path):
    docs = spark.createDataFrame([(i, str(i), f"word{i:04d} common east") for i in range(3000)], "doc long, ref string, title string")
    snapshots.write(build(docs, Schema(["title"], normalizer=Normalizer(()))), docs, str(tmp_path / "snap"), partitions=6)
    index = snapshots.load(spark, str(tmp_path / "snap"))[0]
    found = search(index, "word0007 common")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(token, [common,word0007])" in plan or "EqualTo(token" in plan
    assert [r["ref"] for r in found.collect()] == ["7"]
    assert {r["token"] for r in index.latin().collect()} == {"common", "east", *(f"word{i:04d}" for i in range(3000))}
    every = search(index, "east").orderBy("rank").collect()  # ranked band by band
    assert [r["rank"] for r in every] == list(range(1, 3001)) and [r["doc"] for r in every] == list(range(3000))


def test_many_alternatives(spark, monkeypatch):
    from hanagram.operators import search as s

    index = index_of(spark, [{"ref": f"r{i}", "title": f"word{i}"} for i in range(30)], ["title"])
    want = sorted(refs(index, "wor"))
    monkeypatch.setattr(s, "LOCAL_ALTERNATIVES", 3)
    assert sorted(refs(index, "wor")) == want and len(want) == 30


def test_writer_that_dies_publishes_nothing(spark, tmp_path):
    """A process that is killed between writing and publishing holds no lock and leaves the old snapshot in place."""
    import signal
    import subprocess
    import sys

    root = str(tmp_path / "snap")
    docs = spark.createDataFrame([(0, "a", "東京大学")], "doc long, ref string, title string")
    version = snapshots.write(build(docs, Schema(["title"], normalizer=JA)), docs, root)
    code = f"import os, time; from hanagram.sources import snapshots\nwith snapshots.locked({root!r}):\n os.makedirs({root!r} + '/zzz/postings'); print('in', flush=True); time.sleep(60)"
    child = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE)
    child.stdout.readline()
    with pytest.raises(snapshots.LockTimeout), snapshots.locked(root, timeout=0.05):
        pass
    child.send_signal(signal.SIGKILL)
    child.wait()
    with snapshots.locked(root, timeout=5):
        assert snapshots.current(root, spark) == version and refs(snapshots.load(spark, root, JA)[0], "東京") == ["a"]
    assert snapshots.cleaned(root, 1, spark) == ["zzz"] and snapshots.current(root, spark) == version


def test_batches_take_effect_once(spark, tmp_path):
    root = str(tmp_path / "snap")
    docs = spark.createDataFrame([(0, "a", "x")], "doc long, ref string, title string")
    snapshots.write(build(docs, Schema(["title"])), docs, root)
    feed = spark.createDataFrame([(0, "add", "b", "y")], "seq long, op string, ref string, title string")
    for number, n in ((4, 2), (4, 2), (3, 2), (None, 3), (4, 3), (5, 4)):
        snapshots.update(spark, root, lambda i, d: updated(i, d, feed), batch=number)
        assert snapshots.load(spark, root)[0].docs.count() == n


def test_locks_elsewhere(spark, tmp_path, monkeypatch):
    """A store that isn't this machine's: a lock file that is created once, and taken over when it is stale."""
    from hanagram.sources import stores

    monkeypatch.setattr(stores, "local", lambda path: False)
    root = f"file://{tmp_path}/far"
    with snapshots.locked(root, spark=spark), pytest.raises(snapshots.LockTimeout), snapshots.locked(root, timeout=0.05, spark=spark):
        pass
    assert stores.created(spark, f"{root}/.lock", "x")
    monkeypatch.setattr(snapshots, "STALE", -1.0)
    with snapshots.locked(root, timeout=1, spark=spark):
        assert stores.exists(spark, f"{root}/.lock")
    assert not stores.exists(spark, f"{root}/.lock")


def test_streaming_ingest(spark, tmp_path):
    from hanagram.streaming import ingest

    root, feed = str(tmp_path / "snap"), str(tmp_path / "feed")
    docs = spark.createDataFrame([(0, "a", "東京大学")], "doc long, ref string, title string")
    snapshots.write(build(docs, Schema(["title"], normalizer=JA)), docs, root)
    ddl = "seq long, op string, ref string, title string"
    spark.createDataFrame([(0, "add", "b", "東京駅"), (1, "remove", "a", None)], ddl).write.json(feed)
    ingest(spark.readStream.schema(ddl).json(feed), root, str(tmp_path / "ckpt"), JA).awaitTermination(60)
    assert refs(snapshots.load(spark, root, JA)[0], "東京") == ["b"]


def test_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,title\n1,東京\n2,\n", encoding="utf-8")
    (tmp_path / "a.jsonl").write_text('{"id":"1","title":"x"}\n\n{"id":"2"}\n', encoding="utf-8")
    assert [tuple(r) for r in records.read(spark, str(tmp_path / "a.csv")).collect()] == [("1", "東京"), ("2", None)]
    assert records.read(spark, str(tmp_path / "a.jsonl")).count() == 2
    assert records.from_text(spark, '﻿[{"id": 1}]').collect()[0]["id"] == 1
    with pytest.raises(records.RecordError, match="line 2"):
        records.from_text(spark, '{"a": 1}\n3\n')
    with pytest.raises(records.RecordError):
        records.from_rows(spark, [])
    (tmp_path / "p.md").write_text("---\ntitle: \"A b\"\n---\nbody: x\n", encoding="utf-8")
    r = records.front_matter(spark, str(tmp_path / "p.md")).first()
    assert r["matter"] == {"title": "A b"} and r["content"] == "body: x\n"


def test_collection(spark):
    meta = spark.createDataFrame([("i1", None, "A  b", "x; y", "1900"), ("i2", "i1", "c", None, None), (None, None, "d", None, None)], "objectid string, parentid string, title string, type string, date string")
    config = spark.createDataFrame([("title", "true"), ("type", "false")], "field string, index string")
    rows, fields, boosts, filters = records.collection(meta, config, facets="type")
    assert fields == ["title"] and boosts == {"title": 3} and set(filters) == {"type", "date"}
    assert [(r["ref"], r["title"]) for r in rows.collect()] == [("items/i1.html", "A b")]
    assert {r["ref"] for r in records.collection(meta, config, children=True)[0].collect()} == {"items/i1.html", "items/i1.html#i2"}


def test_cli(spark, tmp_path, capsys):
    from hanagram import cli

    (tmp_path / "a.csv").write_text("id,title,date\n1,東京大学,1900\n2,東京駅,1950\n", encoding="utf-8")
    out = str(tmp_path / "i.json")
    assert cli.main(["build", str(tmp_path / "a.csv"), "--filter", "date=year", "-o", out]) == 0
    assert cli.main(["search", out, "東京", "--filter", "date=..1920"]) == 0
    assert capsys.readouterr().out.startswith("1\t")
    assert cli.main(["build", str(tmp_path / "a.csv"), "--fields", "nope", "-o", out]) == 1
    assert cli.main(["search", str(tmp_path / "none.json"), "x"]) == 1
    assert cli.main(["what"]) == 2
