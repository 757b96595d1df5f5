"""Spot signatures: localised fingerprints of documents.

At every anchor (a frequent word) a signature is formed: the anchor and the next content words after it. A document is the
set of its signatures. For the similarity classes sets are dealt out by length, so that only lengths within the bound meet,
and by the signatures of which similar sets share one; the sets that meet are compared by Jaccard similarity, pruned by
what their sizes allow.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, shuffle_partitions, small_batches, written
from .shingle_product import Sets, linked

#: Anchors: frequent words of four languages, fixed values.
ANCHORS = frozenset("the a an is was are be of to in it that this and or on for with der die das und ist den ein eine le la les de des et est un une el los las del y en que es no".split())
#: How many content words a signature chains, and at which distance from one another.
CHAIN, STEP = 2, 1
#: A word so many words after the last anchor (or the beginning) is one too, so that no part of a text is without.
GAP = 8
#: Texts of fewer signatures than this also have one for every two words side by side.
FEW = 4
_WORD = re.compile(r"\w+")
#: Runs without blanks between words, as of ideographs and kana: each three characters are a signature.
_WIDE = re.compile("[\u2e80-\U0010ffff]{3,}")
_codes: dict[str, int] = {}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _code(word: str) -> int:
    """63 bits of the word's hash and whether it is an anchor."""
    if len(_codes) > 500_000:
        _codes.clear()
    low = word.lower()
    c = _codes[word] = xxhash.xxh64_intdigest(low) & ~1 | (low in ANCHORS)
    return c


def signatures(text: str, chain: int = CHAIN, step: int = STEP) -> np.ndarray:
    """The sorted distinct 32-bit signatures of a text. What makes one is near it, so that an edit leaves those elsewhere alone. A
    text without words, or of one word and no other signature, has one of itself; an empty text has none."""
    words = _WORD.findall(text)
    if not words:
        return np.array([xxhash.xxh32_intdigest(text)] if text else [], np.uint32)
    get = _codes.get
    code = np.array([get(w) or _code(w) for w in words], np.uint64)
    anchor = (code & np.uint64(1)).astype(bool)
    content = np.flatnonzero(~anchor)
    place = np.arange(len(code))
    spots = np.flatnonzero(anchor | (place - np.maximum.accumulate(np.where(anchor, place, -1)) >= GAP))
    found = [np.zeros(0, np.uint32)]
    if len(content):
        first = np.searchsorted(content, spots, side="right")  # the first content word after each anchor
        fits = first + (chain - 1) * step < len(content)
        spots, first = spots[fits], first[fits]
        found.append(_chained([code[spots], *(code[content[first + n * step]] for n in range(chain))]))
    if not text.isascii():
        for run in _WIDE.findall(text):
            c = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            found.append(_chained([c[:-2], c[1:-1], c[2:]]))
    if sum(map(len, found)) < FEW and len(words) > 1:
        found.append(_chained([code[:-1], code[1:]]))
    out = np.unique(np.concatenate(found))
    return out if len(out) else np.array([xxhash.xxh32_intdigest(words[0].lower())], np.uint32)


def _chained(parts: list[np.ndarray]) -> np.ndarray:
    """The sorted distinct 32-bit hashes of what stands side by side in ``parts``."""
    mixed = parts[0]
    for x in parts[1:]:
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + x
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def packed(sigs: np.ndarray) -> str:
    """A fingerprint: the signatures in ascending order, 8 hex digits each."""
    return sigs.astype(">u4").tobytes().hex()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Similarity of two sorted sets; 1 for two empty ones; 0 without a look if the sizes alone keep it below ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fingerprint string, n_signatures) of each row; a null text counts as empty; other columns aren't read."""

    def run(batches):
        for b in batches:
            sigs = [signatures(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([packed(s) for s in sigs], pa.string()), pa.array([len(s) for s in sigs], pa.int64())], ["id", "fingerprint", "n_signatures"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, fingerprint string, n_signatures long").withColumnRenamed("id", id_col)


def length_part(n: int, least: float) -> int:
    """The partition of sets of n signatures: borders grow by 1 / ``least``, so that a set's partners are in its own or the next."""
    return math.floor(math.log(n) / -math.log(least) + 1e-9) if least < 1 else n


def length_keys(s: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """Where a set meets others: its length partition and the next one, by each signature of its prefix. Of two sets of that
    similarity, one of the first n - ceil(least * n) + 1 signatures in any common order is shared; here the rare ones come
    first, so that signatures of very many sets are seldom met by."""
    least = percent / 100
    rare = np.ones(len(s), bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s
    prefix = np.concatenate([s[rare], s[~rare]])[: len(s) - -(-percent * len(s) // 100) + 1]
    part = length_part(len(s), least)
    return np.concatenate([((prefix ^ np.uint64(p << 40)) + np.uint64(1)) * _MIX for p in (part, part + 1)])


def _set_of(body: bytes | None) -> np.ndarray:
    return np.frombuffer(body or b"", np.uint32).astype(np.uint64)


def classes(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, class_id), written, of each distinct id and text (h: the text's hash): the least id of the documents that links of
    Jaccard similarity of ``percent`` / 100 or more between sets of signatures lead to. Texts with equal signatures are one
    class; an empty text is a class of its own by its id, a null text counts as empty, ids that aren't null come first."""

    def run(it):
        for b in it:
            sigs = [signatures(t or "").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.binary()), b.column(2)], ["doc_id", "text", "h"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    with small_batches(docs.sparkSession):
        sets = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("h")).mapInArrow(run, "doc_id long, text binary, h long"), "spot-sets")
    rooted = linked(sets, Sets(_set_of, length_keys), percent)
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = written(rooted.select("doc_id", "h", "root").distinct().join(least, "root", "left").select("doc_id", "h", F.coalesce("least", "doc_id").alias("class_id")), "spot-classes")
    dropped(sets, rooted)
    return out


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"
#: Ranges of ids for each shuffle partition, which evens out how many fall into one.
RANGES = 16


def against_next(docs: DataFrame, share: int = 4, percent: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document in ascending doc_id; with
    ``percent`` also its class_id under similarity of ``percent`` / 100 (``classes``).

    In the edited text the last floor(n_chars / ``share``) code points are replaced by the first as many (or all) of the next
    document, after the last document the first. A null text counts as empty; a null doc_id comes first in the order;
    of repeated doc_ids the order is by a hash of the text. An empty table gives no rows, a single document follows itself.

    Documents are dealt by ranges of doc_id to sorted partitions, texts compressed; each range also gets the first document
    of the range after it, and the classes of its documents just before these.
    """
    spark = docs.sparkSession
    parts = RANGES * shuffle_partitions(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    cuts = sorted(set(cuts))

    def place(keys: list) -> list[int]:
        return [-1 if k is None else bisect.bisect_left(cuts, k) for k in keys]

    def placed(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(place(b.column(0).to_pylist()), pa.int64()), *b.columns], ["bucket", *b.schema.names])

    def squeeze(it):
        c = zstandard.ZstdCompressor(level=5)
        for b in it:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                z = [c.compress(t.encode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(place(part.column(0).to_pylist()), pa.int64()), part.column(0), part.column(2), pa.array(z, pa.binary())], ["bucket", "doc_id", "h", "z"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    # The first document of each range, at most as many rows as ranges; it also ends the range before.
    least = ids.mapInArrow(placed, "bucket long, doc_id long").groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).collect()
    order = sorted(r["bucket"] for r in least)
    if not order:
        return spark.createDataFrame([], _COLUMNS)
    heads = spark.createDataFrame([(r["doc_id"],) for r in least], "first_id long")
    heads = texts.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").mapInArrow(squeeze, "bucket long, doc_id long, h long, z binary")
    heads = heads.groupBy("bucket").agg(F.min(F.struct("h", "doc_id", "z")).alias("x"))
    before = F.create_map(*[F.lit(x).cast("long") for i, b in enumerate(order) for x in (b, order[i - 1])])
    none = F.lit(None).cast("long")
    tails = heads.select(before[F.col("bucket")].alias("bucket"), "x.doc_id", "x.h", "x.z", F.lit(1).alias("tail"), none.alias("class_id"))
    dealt = texts.mapInArrow(squeeze, "bucket long, doc_id long, h long, z binary").withColumn("tail", F.lit(0)).withColumn("class_id", none)
    dealt = dealt.unionByName(tails)
    if percent is not None:  # a document's class comes before it: its z is null
        known = classes(docs, percent).mapInArrow(placed, "bucket long, doc_id long, h long, class_id long")
        dealt = dealt.unionByName(known.select("bucket", "doc_id", "h", F.lit(None).cast("binary").alias("z"), F.lit(0).alias("tail"), "class_id"))
    dealt = dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "h", F.asc_nulls_first("z"))

    def run(it):
        d = zstandard.ZstdDecompressor()
        held = group = None
        for b in it:
            rows = []
            for at, key, z, tail, its in zip(*(c.to_pylist() for c in b.columns)):
                if z is None:
                    group = its
                    continue
                text = d.decompress(z, max_output_size=1 << 31).decode()
                sigs = signatures(text)
                if held is not None and held[0] == at:
                    _, doc, was, mine, in_class = held
                    n = len(was) // share
                    edited = was[: len(was) - n] + text[:n]
                    other = signatures(edited)
                    rows.append((doc, len(was), hashlib.sha256(edited.encode()).hexdigest(), packed(mine), packed(other), jaccard(mine, other), jaccard(mine, sigs), in_class))
                held = None if tail else (at, key, text, sigs, group)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()))], [x.split()[0] for x in _COLUMNS.split(", ")])

    out = dealt.select("bucket", "doc_id", "z", "tail", "class_id").mapInArrow(run, _COLUMNS)
    return out if percent is not None else out.drop("class_id")
