"""WARC archives: whole-file gzip streams, normalised to one gzip member for each record with a sidecar offset index.

``write_streams`` writes each task's pages as response records into monolithic gzip files in the shared folder and returns a
row of facts for each record. ``normalise`` inflates each such stream once, front to back, and rewrites every record as
its own member (a response, or a revisit without payload), with an index of offsets beside it. ``read_records`` reads
records back by the index. Payloads are never shuffled: only ids, digests and places are.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, new_folder, written

#: A stream is closed beyond so many bytes of records, so that it has no more than ROLL / 400 of them.
ROLL = 64 << 20
#: Digests that are broadcast (about 60 bytes each), and from how many copies on a digest is joined apart from the others.
BROADCAST_DIGESTS, HOT = 200_000, 10_000
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def save(uri: str, write) -> None:
    """Writes a file under another name, then renames it: a task that dies leaves no half file, a second attempt replaces it."""
    fs, path = opened(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as f:
        write(f)
    fs.move(part, path)


def record(kind: str, number: str, url: str | None, payload: bytes | int, sha: str, date: str = DATE, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record whose block is an HTTP response; a revisit's block holds its header alone, and
    its payload is given by its length."""
    size = payload if isinstance(payload, int) else len(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if isinstance(payload, int) else http + payload
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{number}>", "WARC-Date": date, "WARC-Target-URI": (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{sha}"}
    if kind == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("a WARC record ends early")
    return fields, rest[:n]


def payload_of(block: bytes) -> tuple[int, bytes]:
    """(the payload's length by the HTTP header, the payload in the block)."""
    head, _, body = block.partition(b"\r\n\r\n")
    n = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return n, body


def stream_records(f) -> Iterator[bytes]:
    """Records of a gzip stream (one or many members) in order, inflated once in bounded memory: one record and one read."""
    inflate, held = zlib.decompressobj(31), bytearray()
    want = None
    while True:
        data = f.read(1 << 20)
        if not data:
            break
        while data:
            held += inflate.decompress(data)
            data = inflate.unused_data
            if data:
                inflate = zlib.decompressobj(31)
        while True:
            if want is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = next(int(x.split(b":")[1]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                want = end + 4 + length + 4
            if len(held) < want:
                break
            yield bytes(held[:want])
            del held[:want]
            want = None
    if held.strip():
        raise ValueError("the stream ends within a record")


FACTS = "page_id {kind}, url string, payload_bytes long, payload_digest string, archive string, ord long"


def write_streams(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as response records into gzip files under ``folder``; a row of facts for each."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        task, number, size, zipped, rows, parts = TaskContext.get().partitionId(), 0, 0, None, [], []

        def finish():
            nonlocal number, size, zipped, rows, parts
            name = f"{folder}/stream-{task:06d}-{number:04d}.warc.gz"
            parts.append(zipped.flush())
            save(name, lambda f: [f.write(x) for x in parts])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (key, pa.string(), pa.int64(), pa.string()))]
            out = pa.RecordBatch.from_arrays([*columns, pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64())], ["page_id", "url", "payload_bytes", "payload_digest", "archive", "ord"])
            number, size, zipped, rows, parts = number + 1, 0, None, [], []
            return out

        for b in batches:
            key = b.schema.field(0).type
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                for page, url, text in zip(*(c.to_pylist() for c in part.columns)):
                    payload = (text or "").encode()
                    sha = digest(payload)
                    if zipped is None:
                        zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
                    raw = record("response", "null" if page is None else str(page), url, payload, sha)
                    parts.append(zipped.compress(raw))
                    rows.append((page, url, len(payload), sha))
                    size += len(raw)
                    if size >= ROLL:
                        yield finish()
        if rows:
            yield finish()

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, FACTS.format(kind=kind))


def decide(facts: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds record_type and refers_to: of records with equal payloads of at least ``min_bytes``, the largest page_id's is the
    response, and the others (those with a null page_id too) revisit it; shorter payloads are responses.

    The digest's greatest page_id comes from an aggregation with partial results. Up to BROADCAST_DIGESTS digests of several
    records are broadcast; beyond, those of HOT records or more are, by themselves, and the others are joined by a shuffle.
    """
    kept = written(facts.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"), "warc-digests")
    again = (F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def near(digests: DataFrame) -> bool:
        return digests.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS

    firsts = kept.select("payload_digest", "first_id")
    hot = kept.where(F.col("copies") >= HOT).select("payload_digest", "first_id")
    if near(kept):
        found = facts.join(F.broadcast(firsts), "payload_digest", "left")
    elif near(hot):
        rest = kept.where(F.col("copies") < HOT).select("payload_digest", "first_id")
        found = facts.join(F.broadcast(hot), "payload_digest").unionByName(facts.join(F.broadcast(hot), "payload_digest", "left_anti").join(rest, "payload_digest", "left"))
    else:
        found = facts.join(firsts, "payload_digest", "left")
    return found.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def normalise(decided: DataFrame, level: int = 6, tasks: int | None = None) -> DataFrame:
    """Rewrites each stream by ``decided`` (archive, ord, record_type, refers_to) as ``*.members.warc.gz`` with an index file
    ``*.index.jsonl`` beside it. Returns (archive, index_file, records). A stream's records are bounded by ROLL, also those
    without a payload, so its rows are too."""

    def run(key, table):
        name = key[0].as_py()
        fate = dict(zip(table["ord"].to_pylist(), zip(table["record_type"].to_pylist(), table["refers_to"].to_pylist())))
        to = name.removesuffix(".warc.gz") + ".members.warc.gz"
        index: list[str] = []

        def rewrite(out):
            at = 0
            fs, path = opened(name)
            with fs.open_input_stream(path, compression=None) as f:
                for n, raw in enumerate(stream_records(f)):
                    fields, block = parse(raw)
                    kind, refers_to = fate[n]
                    if kind == "revisit":
                        size, _ = payload_of(block)
                        number = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                        # A revisit's block is the HTTP header alone; its length says how long the payload was.
                        raw = record(kind, number, fields["warc-target-uri"], size, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-date"], str(refers_to))
                    zipped = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = zipped.compress(raw) + zipped.flush()
                    out.write(member)
                    index.append(json.dumps({"id": fields["warc-record-id"], "offset": at, "length": len(member)}))
                    at += len(member)

        save(to, rewrite)
        save(to.removesuffix(".warc.gz") + ".index.jsonl", lambda f: f.write("\n".join(index).encode()))
        return pa.table({"archive": [to], "index_file": [to.removesuffix(".warc.gz") + ".index.jsonl"], "records": pa.array([len(index)], pa.int64())})

    rows = decided.select("archive", "ord", "record_type", F.col("refers_to").cast("string").alias("refers_to"))
    # The rows are few beside the streams that a task reads: a number of tasks that adaptive execution doesn't lower.
    tasks = tasks or max(1, rows.select("archive").distinct().count())
    return rows.repartition(tasks, "archive").groupBy("archive").applyInArrow(run, "archive string, index_file string, records long")


def read_records(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Reads the records of normalised ``archives`` (archive, index_file) by their indexes, each member by itself; a response
    whose payload's digest differs from its header is an error."""

    def run(batches):
        for b in batches:
            for name, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = opened(index)
                with fs.open_input_stream(path, compression=None) as f:
                    places = [json.loads(x) for x in f.read().decode().splitlines()]
                fs, path = opened(name)
                with fs.open_input_file(path) as f:
                    for lo in range(0, len(places), 256):
                        rows = []
                        for p in places[lo : lo + 256]:
                            f.seek(p["offset"])
                            fields, block = parse(zlib.decompress(f.read(p["length"]), 31))
                            if fields["warc-record-id"] != p["id"]:
                                raise ValueError(f"{name}: the index is wrong at {p['offset']}")
                            size, payload = payload_of(block)
                            sha = fields["warc-payload-digest"].removeprefix("sha1:")
                            kind = fields["warc-type"]
                            if kind == "response" and (digest(payload) != sha or len(payload) != size):
                                raise ValueError(f"{name}: {p['id']} has another payload than its header says")
                            ids = [fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("warc-record-id", "warc-refers-to")]
                            rows.append((None if ids[0] == "null" else ids[0], fields["warc-target-uri"], size, sha, kind, ids[1] or None, payload if with_payload and kind == "response" else None))
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()))], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return archives.select("archive", "index_file").mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")


def archived(pages: DataFrame, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Writes ``pages`` as WARC, normalises the streams, reads the members back: page_id, payload_bytes, payload_digest,
    record_type, refers_to for each row.

    A null html is an empty payload, a null url the address about:blank, a null page_id stays null; rows with one page_id and
    equal payloads are responses both; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    folder = new_folder(spark, "warc")
    facts = written(write_streams(pages, folder), "warc-facts")
    n = max(1, facts.select("archive").distinct().count())
    archives = written(normalise(decide(facts, min_bytes), level, n), "warc-archives")
    dropped(facts)
    rows = read_records(archives.repartition(n))
    return rows.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
