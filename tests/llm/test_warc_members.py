import base64
import gzip
import hashlib
import io

from hanagram.llm import warc_members as w


def test_roundtrip(spark):
    rows = [(1, "u1", "same"), (2, None, "same"), (3, "u3", "other é"), (4, "u4", None), (5, "u5", ""), (6, "a\r\nb", "x" * 300_000), (7, "u", "same"), (None, "n", "alone"), (None, "n", "same")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, archive string").repartition(3)
    for least in (0, 5):
        got = {(r["page_id"], r["payload_digest"]): (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in w.archived(df, least).collect()}
        assert len(got) == len(rows)
        for page, _, html in rows:
            payload = (html or "").encode()
            sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            first = max((p for p, _, h in rows if p is not None and (h or "").encode() == payload), default=None)
            again = len(payload) >= least and first is not None and page != first
            assert got[page, sha] == (len(payload), "revisit" if again else "response", first if again else None)
    assert w.archived(df.where("false")).count() == 0


def test_normaliser_makes_a_member_of_each_record(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"page {i % 3}") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    folder = w.new_folder(spark, "warc-test")
    facts = w.write_streams(df, folder).collect()
    facts = spark.createDataFrame(facts)
    made = w.normalise(w.decide(facts)).collect()
    fs, path = w.opened(made[0]["archive"])
    with fs.open_input_stream(path, compression=None) as f:
        data = f.read()
    assert data.count(b"\x1f\x8b\x08") >= 20 and made[0]["records"] == 20
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 20
    read = w.read_records(spark.createDataFrame(made), True).collect()
    assert sorted(bytes(r["payload"]).decode() for r in read if r["payload"] is not None) == ["page 0", "page 1", "page 2"]


def test_stream_of_one_or_many_members():
    records = [w.record("response", str(i), "u", b"p" * i, w.digest(b"p" * i)) for i in range(50)]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert list(w.stream_records(io.BytesIO(data))) == records
