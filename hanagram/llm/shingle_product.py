"""Jaccard join of documents on word n-grams by blocked sparse products of the document by n-gram incidence.

1. Documents with equal sets are one class, known by the 128-bit digest of the set.
2. Blocks: two sets of n and m n-grams with J >= t differ in at most (n + m)(1 - t)/(1 + t) n-grams. If the n-grams' hash range
   is cut into more parts than that, both sets are the same in some part. Sets that share a part (and a size level) are
   put in one block by connected components; sets without any such partner need no product. Nothing that may link is lost.
   A block of many sets or n-grams is refined: each set has a sketch, in which a bit is the parity of the number of its
   n-grams there. Sketches of two sets differ in no more bits than the sets do in n-grams, so that sets whose sketches differ
   in too many don't link. What the others connect is a block.
3. Within a block the incidence matrix is multiplied with its transpose, which accumulates the overlap of each pair; pairs
   below the bound that their sizes give are discarded, and the others link.
4. A refined block of many sets or n-grams is cut: slices are multiplied by themselves, then by leaders of the block's largest
   components, then what doesn't yet belong to the block's main component by the slices whose sizes may link with its own.
   Pairs within one component need no product.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, components, dropped, near, released, shuffle_partitions, small_batches, tidied, written

#: Sets and n-grams in a slice of a large block (about: sets are dealt by hash), and by how many leaders all of it is multiplied.
SLICE, SLICE_GRAMS, LEADERS = 512, 2_000_000, 16
#: Sketches and their bytes in a slice of a large block (about), and sketches that are compared at once on both sides.
SKETCHES, SKETCH_BYTES, COMPARED = 16_384, 16 << 20, (128, 1024)
#: N-grams that a product lays out at once, and bytes of sets in a batch.
PRODUCT_GRAMS, BATCH_BYTES = 1_000_000, 8 << 20
#: Parts that agree beyond the one that has to, as a share of those that may differ: a set leaves out as many of its parts
#: that tell least (empty ones, and those of frequent n-grams).
SPARE = 0.2
#: Frequent n-grams are those counted so often in LOCAL_GRAMS n-grams at least, and in all at least 64 times and once in
#: HOT_MOST, so that there are HOT_MOST of them at most (8 MB). Which are known affects only the size of blocks.
LOCAL_GRAMS, LOCAL_TIMES, HOT_MOST = 2_000_000, 6, 1 << 20
#: Bytes of keys for each shard at most.
SHARD_BYTES = 16 << 20
#: Keys that a task holds before it sends them, digests of sets that it knows again, words whose hashes it keeps.
HELD_KEYS, SEEN, WORDS = 1_000_000, 100_000, 100_000

_codes: dict[bytes, int] = {}
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def forget() -> None:
    """Empties the worker's cache of words."""
    _codes.clear()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``k`` words, A-Z lower-cased, words cut at ASCII white space. Fewer
    words are one shingle, no words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    if len(_codes) > WORDS:
        _codes.clear()
    try:
        code = np.array([_codes[w] for w in words], np.uint64)
    except KeyError:
        for w in words:
            if w not in _codes:
                _codes[w] = xxhash.xxh64_intdigest(w)
        code = np.array([_codes[w] for w in words], np.uint64)
    n = len(words) - k + 1
    h = code[:n].copy()
    for i in range(1, k):
        h = _mixed(h * _M1) + code[i : i + n]
    return np.unique(_mixed(h * _M1))


def set_digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def needed(n: int, m: int, percent: int) -> int:
    """The least overlap at which 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def levels(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(level, parts that may differ, spare parts) under which a set of n n-grams gets keys: its own size level and the next; two sets whose
    sizes may link are at one level in common."""
    own = math.floor(math.log(n) / -math.log(percent / 100) + 1e-9) if percent < 100 else n
    out = []
    for level in (own, own + 1):
        most = math.floor((100 / percent) ** (level + 1) + 1e-6)  # no set at this level has more
        differ = 2 * most - 2 * needed(most, most, percent) + 2
        out.append((level, differ, max(3, math.ceil(SPARE * differ))))
    return out


def keys(s: np.ndarray, percent: int, hot: np.ndarray) -> np.ndarray:
    """Keys of a set such that two sets that link have one in common. None if only an equal set links.

    Of parts that differ + 1 + spare, two sets that link agree in spare + 1 at least. What a part tells is how many of its
    n-grams aren't in ``hot``. A set leaves out the parts that tell no more than q, with the largest q at which these are no
    more than spare; of two sets, the greater q still leaves a part in which they agree.
    """
    n = len(s)
    if not any(needed(n, m, percent) <= min(n, m) - (n == m) for m in range(-(-percent * n // 100), 100 * n // percent + 1)):
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(s * _M1), dtype=np.uint64)])
    rare = np.ones(n, np.int64)
    if len(hot):
        rare -= hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
    rare = np.concatenate([[0], np.cumsum(rare)])
    out = []
    for level, differ, spare in levels(n, percent):
        parts = differ + 1 + spare
        edges = np.searchsorted(s, (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64))
        at = np.concatenate([[0], edges, [n]])
        part = total[at[1:]] - total[at[:-1]]
        tells = rare[at[1:]] - rare[at[:-1]]
        salt = _mixed((np.arange(parts, dtype=np.uint64) + np.uint64(level << 32)) * _M2)
        out.append(_mixed(part + salt)[tells >= np.sort(tells)[spare]])
    return np.concatenate(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """Words of at least two bits for each n-gram: the parity of the number of n-grams at each place. XOR of the halves of a sketch is
    the sketch of half its size."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    place = (_mixed(s * _M1) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketches: list[np.ndarray], words: int) -> np.ndarray:
    """Sketches as rows of ``words`` words, which none is smaller than."""
    out = np.empty((len(sketches), words), np.uint64)
    for i, x in enumerate(sketches):
        out[i] = x if len(x) == words else np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)
    return out


def alike(left: np.ndarray, n: np.ndarray, right: np.ndarray, m: np.ndarray, percent: int):
    """Arrays of pairs (i, j) of sketches, of sets of n and m n-grams, that don't rule out a link."""
    for lo in range(0, len(left), COMPARED[0]):
        for at in range(0, len(right), COMPARED[1]):
            a, b = left[lo : lo + COMPARED[0]], right[at : at + COMPARED[1]]
            both = n[lo : lo + COMPARED[0], None] + m[None, at : at + COMPARED[1]]
            most = both + 2 * (-percent * both // (100 + percent))  # differing n-grams of two sets that link: needed()
            differ = np.zeros(most.shape, np.int32)
            for w in range(left.shape[1]):
                differ += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
                if w % 4 == 3 and not (differ <= most).any():
                    break
            found = np.argwhere(differ <= most)
            if len(found):
                yield found + (lo, at)


class Forest:
    """Union-find over 0..n-1, the least member as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def product(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Pairs (i, j) of sets that link, by products of their incidence matrices, some n-grams' columns at a time; without
    ``right`` the pairs i < j of ``left``. Sets of many n-grams are multiplied by ranges of the n-grams, which bounds memory."""
    both = left + (right or [])
    n = len(left)
    size = np.array([len(s) for s in both], np.int64)
    overlap = np.zeros((n, len(right) if right is not None else n), np.int64)
    if len(both) < 2 or not size.sum():
        return np.zeros((0, 2), np.int64)
    ranges = -(-int(size.sum()) // PRODUCT_GRAMS)
    begin = np.zeros(len(both), np.int64)
    for r in range(1, ranges + 1):
        end = size if r == ranges else np.array([np.searchsorted(s, np.uint64((r << 64) // ranges)) for s in both], np.int64)
        _add_overlap(overlap, [s[a:b] for s, a, b in zip(both, begin, end)], n, right is not None)
        begin = end
    other = size[n:] if right is not None else size
    links = (100 + percent) * overlap >= percent * (size[:n, None] + other[None, :])
    links &= (size[:n, None] > 0) & (other[None, :] > 0)
    if right is None:
        links = np.triu(links, 1)
    return np.argwhere(links)


def _add_overlap(overlap: np.ndarray, both: list[np.ndarray], n: int, apart: bool, width: int = 2048) -> None:
    """Adds the numbers of n-grams that each of the first ``n`` sets shares with the others (``apart``) or with one another."""
    gram, column = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    shared = np.bincount(column, minlength=len(gram)) > 1  # an n-gram of one set alone adds no overlap
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    bounds = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    for c, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        block = np.zeros((len(both), width), np.float32)
        block[row[lo:hi], column[lo:hi] - c * width] = 1
        overlap += (block[:n] @ (block[n:] if apart else block).T).astype(np.int64)


@dataclass(frozen=True)
class Sets:
    """What makes the sets: ``of`` turns a row's body into a sorted array of distinct unsigned 64-bit integers, and ``keys`` gives a
    set keys such that two sets that link have one in common (called with the set, the percentage and the frequent members)."""

    of: Callable[[object], np.ndarray]
    keys: Callable[[np.ndarray, int, np.ndarray], np.ndarray] = keys


def _facts(docs: DataFrame, make: Sets) -> DataFrame:
    """(doc_id, h, n, sid, node, gram) of each row of ``docs`` (doc_id, text, h): the size of its set, the set's digest, half of
    the digest; and rows with a gram and in n how often it was counted, for n-grams that are frequent in a stretch of the
    task's distinct sets."""

    def run(it):
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0
        names = ["doc_id", "h", "n", "sid", "node", "gram"]

        def frequent():
            gram = np.sort(np.concatenate(held))
            held.clear()
            cut = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            times = np.diff(np.append(cut, len(gram)))
            many = times >= LOCAL_TIMES
            none = pa.nulls(int(many.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(times[many]), pa.nulls(len(none), pa.binary()), none, pa.array(gram[cut[many]].view(np.int64))], names)

        for b in it:
            n, sid, node = [], [], []
            for t in b.column(1).to_pylist():
                s = make.of(t)
                d = set_digest(s) if len(s) else None
                n.append(len(s))
                sid.append(d)
                node.append(d and int.from_bytes(d[:8], "little", signed=True))
                if d and d not in seen:
                    seen.add(d)
                    held.append(s)
                    size += len(s)
                    if size >= LOCAL_GRAMS:
                        yield frequent()
                        size = 0
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(node, pa.int64()), pa.nulls(len(n), pa.int64())], names)
        if held:
            yield frequent()

    return docs.mapInArrow(tidied(run, forget), "doc_id long, h long, n long, sid binary, node long, gram long")


def _block_edges(docs: DataFrame, make: Sets, percent: int, shards: int, hot) -> DataFrame:
    """Edges (a, b) between nodes whose sets share a key, connected as these are.

    A task sends each key that it holds with one node only, and the edges between that node and the others beside it, so
    that a key of very many sets is as many rows as there are stretches of held keys. ``hot``: a broadcast variable.
    """

    def run(it):
        seen: set[bytes] = set()
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        at = TaskContext.get().partitionId()

        def flush():
            names = np.array([x for x, _ in held], np.int64)
            owner = np.repeat(np.arange(len(held)), [len(x) for _, x in held])
            key = np.concatenate([x for _, x in held])
            held.clear()
            by = np.argsort(key)
            first = np.concatenate([[True], key[by[1:]] != key[by[:-1]]])
            firsts = owner[by[first]]
            pairs = np.unique((firsts[np.cumsum(first) - 1] * len(names) + owner[by])[~first])
            forest = Forest(len(names))
            for a, b in zip((pairs // len(names)).tolist(), (pairs % len(names)).tolist()):
                forest.join(a, b)
            root = np.array([forest.root(i) for i in range(len(names))], np.int64)
            moved = root != np.arange(len(names))
            keep = np.zeros(len(key), bool)
            keep[by[first]] = True
            owner, key = owner[keep], key[keep]
            shard = (key % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            owner, key, shard = owner[by], key[by], shard[by]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            full = [i for i in range(shards) if cuts[i + 1] > cuts[i]]
            rows = []
            for i in full:
                x = owner[cuts[i] : cuts[i + 1]]
                change = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                rows.append((names[x[change]].tobytes(), np.diff(np.append(change, len(x))).astype(np.uint32).tobytes(), key[cuts[i] : cuts[i + 1]].tobytes(), b"", b""))
            if moved.any():
                full.append(at % shards)
                rows.append((b"", b"", b"", names[root[moved]].tobytes(), names[moved].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*rows))], ["shard", "nodes", "counts", "keys", "a", "b"])

        for b in it:
            for t in b.column(1).to_pylist():
                s = make.of(t)
                if len(s):
                    d = set_digest(s)
                    if d not in seen:
                        seen.add(d)
                        if len(x := make.keys(s, percent, hot.value)):
                            held.append((int.from_bytes(d[:8], "little", signed=True), x))
                            size += len(x)
                            if size > HELD_KEYS:
                                yield flush()
                                size = 0
            if len(seen) > SEEN:
                seen.clear()
        if held:
            yield flush()

    def meet(group, table):
        of = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in table[c]]
        node = np.concatenate([np.repeat(x, c) for x, c in zip(of("nodes", np.int64), of("counts", np.uint32))])
        key = np.concatenate(of("keys", np.uint64))
        by = np.argsort(key)
        node, key = node[by], key[by]
        start = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        lead = node[np.flatnonzero(start)][np.cumsum(start) - 1]
        a = np.concatenate([lead[lead != node], *of("a", np.int64)])
        b = np.concatenate([node[lead != node], *of("b", np.int64)])
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        pairs = np.unique(at[: len(a)] * max(1, len(names)) + at[len(a) :])
        forest = Forest(len(names))
        for x, y in zip((pairs // max(1, len(names))).tolist(), (pairs % max(1, len(names))).tolist()):
            forest.join(x, y)
        root = np.array([forest.root(i) for i in range(len(names))], np.int64)
        moved = root != np.arange(len(names))
        del node, key, by, lead, at, pairs
        released()
        return pa.table({"a": pa.array(names[root[moved]], pa.int64()), "b": pa.array(names[moved], pa.int64())})

    packed = docs.mapInArrow(tidied(run, forget), "shard long, nodes binary, counts binary, keys binary, a binary, b binary")
    return packed.groupBy("shard").applyInArrow(meet, "a long, b long").distinct()


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _emit(pairs):
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], schema=_LINKS)


def _rows(it):
    for b in it:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _within(percent: int):
    """Links within each slice of rows (block, level, slice, sid, s) sorted by the first four, one for each set that is not its
    component's first."""

    def run(it):
        for _, rows in groupby(_rows(it), lambda r: r[:3]):
            sets = {sid: np.frombuffer(s, np.uint64) for *_, sid, s in rows}
            names = list(sets)
            forest = Forest(len(names))
            for a, b in product(list(sets.values()), None, percent).tolist():
                forest.join(a, b)
            pairs = [(names[r], names[i]) for i in range(len(names)) if (r := forest.root(i)) != i]
            if pairs:
                yield _emit(pairs)

    return run


def _across(percent: int):
    """Links within each slice between members (part 0) and probes (part 1), one for each probe and component, of rows (block, level,
    slice, part, sid, root, s) sorted by the first five. Members are held, probes go by."""

    def run(it):
        for _, rows in groupby(_rows(it), lambda r: r[:3]):
            members: dict[bytes, tuple] = {}
            for part, some in groupby(rows, lambda r: r[3]):
                if part == 0:
                    members = {sid: (root, np.frombuffer(s, np.uint64)) for *_, sid, root, s in some}
                    continue
                names = list(members)
                probes: dict[bytes, tuple] = {}
                grams = 0
                for *_, sid, root, s in some:
                    probes[sid] = root, np.frombuffer(s, np.uint64)
                    grams += len(s) // 8
                    if len(probes) >= SLICE or grams >= SLICE_GRAMS:
                        yield from met(probes, members, names)
                        probes, grams = {}, 0
                yield from met(probes, members, names)

    def met(probes, members, names):
        asked = list(probes)
        found = product([s for _, s in probes.values()], [s for _, s in members.values()], percent)
        pairs = {(probes[asked[i]][0], members[names[j]][0]): (asked[i], names[j]) for i, j in found.tolist() if probes[asked[i]][0] != members[names[j]][0]}
        if pairs:
            yield _emit(list(pairs.values()))

    return run


def _sketched(percent: int):
    """Edges between the nodes of each slice whose sketches are alike, connected as these are, of rows (block, level, slice, part, node, n,
    s) sorted by the first four: members (part 0) with one another and with the probes that go by (part 1)."""

    def run(it):
        for _, rows in groupby(_rows(it), lambda r: r[:3]):
            names = n = wide = forest = None
            for part, some in groupby(rows, lambda r: r[3]):
                some = iter(some)
                if part == 0:
                    held = list(some)
                    names, n = np.array([r[4] for r in held], np.int64), np.array([r[5] for r in held], np.int64)
                    wide = [np.frombuffer(r[6], np.uint64) for r in held]
                    del held
                    words = min(map(len, wide))
                    members, forest = folded(wide, words), Forest(len(names))
                    for pairs in alike(members, n, members, n, percent):
                        for i, j in pairs[pairs[:, 0] < pairs[:, 1]].tolist():
                            forest.join(i, j)
                    root = np.array([forest.root(i) for i in range(len(names))], np.int64)
                    moved = root != np.arange(len(names))
                    yield edges(names[root[moved]], names[moved])
                    continue
                while names is not None and (batch := list(islice(some, 4096))):
                    probes, size = [np.frombuffer(r[6], np.uint64) for r in batch], np.array([r[5] for r in batch], np.int64)
                    if (least := min(map(len, probes))) < words:
                        words, members = least, folded(wide, least)
                    # One edge for each probe and component of members.
                    found = [np.stack([p[:, 0], root[p[:, 1]]], 1) for p in alike(folded(probes, words), size, members, n, percent)]
                    if found:
                        found = np.unique(np.concatenate(found), axis=0)
                        asked = np.array([r[4] for r in batch], np.int64)
                        yield edges(asked[found[:, 0]], names[found[:, 1]])

    def edges(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _refined(sets: DataFrame, bodies, percent: int) -> DataFrame:
    """(node, block): large blocks cut into what sketches connect; nodes that nothing connects are left out. ``sets``: those of large
    blocks, ``bodies`` (rows with doc_id, block, level, slice, sid; what makes a body of a set): their rows with bodies.

    Each two slices of one size level, or of two levels side by side, meet once.
    """
    parts = shuffle_partitions(sets.sparkSession)
    bytes_ = F.greatest(F.lit(16), F.col("n") / 2)
    count = sets.groupBy("block", "level").agg(F.greatest(F.ceil(F.count("*") / SKETCHES), F.ceil(F.sum(bytes_) / SKETCH_BYTES)).alias("slices"))
    count = written(count, "shingle-sketch-counts")
    placed = sets.join(near(count), ["block", "level"]).withColumn("slice", F.pmod(F.xxhash64("sid"), F.col("slices")))
    placed = written(placed.select("doc_id", "sid", "block", "level", "slice", F.lit(False).alias("large")), "shingle-sketch-placed")
    made = written(bodies(placed, sketch).select("block", "level", "slice", "sid", "s").join(near(sets.select("sid", "node", "n")), "sid").drop("sid"), "shingle-sketches")
    above = count.select("block", (F.col("level") - 1).alias("level"), F.col("slices").alias("above"))
    slots = near(count.join(above, ["block", "level"], "left"))
    of = lambda level, slices: F.transform(slices, lambda x: F.struct((F.col("level") + level).alias("level"), x.alias("slice")))
    none = F.array().cast("array<bigint>")
    beside = F.when(F.col("slice") + 1 < F.col("slices"), F.sequence(F.col("slice") + 1, F.col("slices") - 1)).otherwise(none)
    higher = F.when(F.col("above").isNotNull(), F.sequence(F.lit(0).cast("long"), F.col("above") - 1)).otherwise(none)
    asked = made.join(slots, ["block", "level"]).withColumn("at", F.explode(F.concat(of(0, beside), of(1, higher))))
    asked = asked.select("block", F.col("at.level").alias("level"), F.col("at.slice").alias("slice"), F.lit(1).alias("part"), "node", "n", "s")
    rows = made.select("block", "level", "slice", F.lit(0).alias("part"), "node", "n", "s").unionByName(asked)
    rows = rows.repartition(parts, "block", "level", "slice").sortWithinPartitions("block", "level", "slice", "part", "node")
    out = components(rows.mapInArrow(tidied(_sketched(percent)), "a long, b long"), "shingle-refined").withColumnRenamed("root", "block")
    out = written(out, "shingle-refined")
    dropped(count, placed, made)
    return out


def _large(big: DataFrame, sizes: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """The links that are still missing in blocks of several slices. ``big``: (block, level, slice, sid, s), ``sizes``: (block, level,
    slices). A set meets the slices of its size level and of the two beside it; no other set is of a size that may link."""
    spark = big.sparkSession
    parts = shuffle_partitions(spark)
    where = big.select("block", "level", "slice", "sid").distinct()
    beside = sizes.select("block", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level"), F.col("level").alias("at"), "slices")
    slots = near(written(beside.select("block", "level", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")), "shingle-slots"))

    def rooted(known: DataFrame) -> DataFrame:
        found = components(known, "shingle-rooted")
        return where.join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))

    def met(probes: DataFrame, at: DataFrame) -> DataFrame:
        """Links of ``probes`` (block, level, sid) with the slices that may hold a partner; ``at``: the roots so far. Sets move once."""
        full = big.join(near(at.select("sid", "root")), "sid")
        asked = full.drop("slice").join(near(probes), ["block", "level", "sid"], "left_semi").join(slots, ["block", "level"])
        asked = asked.select("block", F.col("at").alias("level"), "slice", F.lit(1).alias("part"), "sid", "root", "s")
        rows = full.withColumn("part", F.lit(0)).select(*asked.columns).unionByName(asked)
        rows = rows.repartition(parts, "block", "level", "slice").sortWithinPartitions("block", "level", "slice", "part", "sid")
        return rows.mapInArrow(tidied(_across(percent)), "a binary, b binary")

    at = written(rooted(links), "shingle-roots")
    # Leaders: of each of a level's first slices the first set of the largest component there.
    size = at.where(F.col("slice") < LEADERS).groupBy("block", "level", "slice", "root").agg(F.count("*").alias("c"), F.min("sid").alias("sid"))
    leaders = written(size.groupBy("block", "level", "slice").agg(F.max(F.struct("c", "sid")).alias("x")).select("block", "level", F.col("x.sid").alias("sid")), "shingle-leaders")
    links = written(links.unionByName(met(leaders, at)), "shingle-links")
    after = written(rooted(links), "shingle-roots")
    main = written(after.groupBy("block", "root").count().groupBy("block").agg(F.max(F.struct("count", "root")).alias("x")).select("block", F.col("x.root").alias("main")), "shingle-main")
    rest = written(after.join(near(main), "block").where("root != main").select("block", "level", "sid"), "shingle-rest")
    out = written(links.unionByName(met(rest, after)), "shingle-links")
    dropped(at, leaders, links, after, main, rest)
    return out


def _incidence(it_columns: int, make: Sets, body=None):
    """Rows with the set of their last column, or ``body`` of it, and its digest in place of that column, in batches of bounded
    bytes."""

    def run(it):
        for b in it:
            at, sets, size = 0, [], 0
            texts = b.column(it_columns).to_pylist()
            for i, t in enumerate(texts):
                sets.append(make.of(t))
                size += sets[-1].nbytes
                if size >= BATCH_BYTES or i == len(texts) - 1:
                    part = b.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*part.columns[:it_columns], pa.array([(body(x) if body else x).tobytes() for x in sets], pa.binary()), pa.array([set_digest(x) if len(x) else None for x in sets], pa.binary())], [*b.schema.names[:it_columns], "s", "own"])
                    at, sets, size = i + 1, [], 0

    return run


def linked(texts: DataFrame, make: Sets, percent: int) -> DataFrame:
    """(doc_id, h, n, root) of each row of ``texts`` (doc_id, text, h), written: n is its set's size, root its component under links
    of Jaccard similarity of ``percent`` / 100 or more (null: no set). A text may be any body that ``make`` takes."""
    with small_batches(texts.sparkSession):
        return _linked(texts, make, percent)


def _linked(texts: DataFrame, make: Sets, percent: int) -> DataFrame:
    spark = texts.sparkSession
    parts = shuffle_partitions(spark)
    every = written(_facts(texts, make), "shingle-facts")
    facts = every.where("gram is null").drop("gram")
    total = facts.agg(F.sum("n")).first()[0] or 0
    often = every.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("times")).where(F.col("times") >= max(64, total // HOT_MOST + 1))
    hot = spark.sparkContext.broadcast(np.sort(often.select("gram").toPandas()["gram"].to_numpy(np.int64).view(np.uint64)))
    shards = max(24, parts, math.ceil(total * (100 - percent) / percent * 2.5 * 8 / SHARD_BYTES))
    blocks = components(_block_edges(texts.select("doc_id", "text"), make, percent, shards, hot), "shingle-blocks").withColumnRenamed("root", "block")
    # One row for each set in a block of two or more.
    sets = facts.where("n > 0").groupBy("sid", "node", "n").agg(F.min("doc_id").alias("doc_id"))
    sets = written(sets.join(blocks, "node").select("sid", "node", "n", "doc_id", "block"), "shingle-sets")
    level = (F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")).cast("long")
    sets = sets.withColumn("level", level)
    broad = sets.groupBy("block").agg(F.count("*").alias("c"), F.sum("n").alias("total")).where((F.col("c") > 1) & ((F.col("c") > SLICE) | (F.col("total") > SLICE_GRAMS)))
    broad = written(broad.select("block"), "shingle-broad")

    def bodies(placed: DataFrame, body=None) -> DataFrame:
        """``placed`` (doc_id, sid, block, level, slice, large) without doc_id, with the set or ``body`` of it as s."""
        # Few places are broadcast (about 60 bytes each); beyond, texts are shuffled to them.
        some = texts.select("doc_id", "text").join(near(placed), "doc_id").select("block", "level", "slice", "large", "sid", "text")
        # A repeated id may have other texts: the digest tells them apart.
        out = some.mapInArrow(tidied(_incidence(5, make, body), forget), "block long, level long, slice long, large boolean, sid binary, s binary, own binary").where("sid = own").drop("own")
        if placed.where("doc_id is null").limit(1).count():  # sets without an id are found by their digest
            bare = texts.where("doc_id is null").select("text").mapInArrow(_incidence(0, make, body), "s binary, own binary").where("own is not null")
            out = out.unionByName(bare.join(placed.where("doc_id is null"), F.col("own") == F.col("sid")).select(*out.columns))
        return out

    if broad.limit(1).count():
        refined = _refined(sets.join(near(broad), "block"), bodies, percent)
        cut_up = sets.join(near(broad), "block").drop("block").join(refined, "node").select(*sets.columns)
        before, sets = sets, written(sets.join(near(broad), "block", "left_anti").select(*sets.columns).unionByName(cut_up), "shingle-sets")
        dropped(before, refined)
    dropped(broad)
    counts = sets.groupBy("block", "level").agg(F.count("*").alias("c"), F.sum("n").alias("total"))
    # A block of one slice stays whole; a larger one is cut by size levels, and these by hash.
    whole = sets.groupBy("block").agg(F.count("*").alias("c"), F.sum("n").alias("total")).where("c > 1").withColumn("large", (F.col("c") > SLICE) | (F.col("total") > SLICE_GRAMS))
    whole = written(whole.select("block", "large"), "shingle-whole")
    slices = F.greatest(F.ceil(F.col("c") / SLICE), F.ceil(F.col("total") / SLICE_GRAMS))
    cut = written(counts.join(whole.where("large").select("block"), "block").select("block", "level", slices.alias("slices")), "shingle-counts")
    small = sets.join(near(whole.where("not large").select("block")), "block").select("doc_id", "sid", "block", F.lit(0).cast("long").alias("level"), F.lit(0).cast("long").alias("slice"), F.lit(False).alias("large"))
    big = sets.join(near(cut), ["block", "level"]).select("doc_id", "sid", "block", "level", F.pmod(F.xxhash64("sid"), F.col("slices")).alias("slice"), F.lit(True).alias("large"))
    placed = written(small.unionByName(big), "shingle-placed")
    incidence = bodies(placed)
    large = bool(cut.limit(1).count())
    if large:
        incidence = written(incidence, "shingle-incidence")
    inner = incidence.select("block", "level", "slice", "sid", "s").repartition(parts, "block", "level", "slice").sortWithinPartitions("block", "level", "slice", "sid")
    links = written(inner.mapInArrow(tidied(_within(percent)), "a binary, b binary"), "shingle-links")
    if large:
        inner_links = links
        links = _large(incidence.where("large").drop("large"), cut, links, percent)
        dropped(inner_links)
    found = written(components(links, "shingle-components"), "shingle-found")
    out = written(facts.join(found.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "h", "n", F.coalesce("root", "sid").alias("root")), "shingle-rooted")
    dropped(every, sets, whole, cut, placed, links, found, *([incidence] if large else []))
    hot.unpersist()
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def grouped(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_shingles, component_id) of each row: the size of its set of word ``k``-grams, and the least id that links
    lead to, where two documents link at Jaccard similarity of ``percent`` / 100 or more.

    A null or empty text has no shingles and links with nothing; equal texts are one component; repeated ids keep a row
    each; rows with a null id link like others, but take no part in the least id unless all are null. Other columns are not
    read.
    """
    rooted = linked(_texts(docs, id_col, text_col), Sets(partial(shingles, k=k)), percent)
    least = written(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "shingle-least")
    kind = docs.schema[id_col].dataType.simpleString()
    return rooted.join(least, "root", "left").select(F.col("doc_id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").cast(kind).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the least id, null ids last, among texts of one id (or of none)
    that of the least hash. Rows that agree in id and text are one document and share its fate; rows without words stay."""
    rooted = linked(_texts(docs, id_col, text_col), Sets(partial(shingles, k=k)), percent).where("root is not null")
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("best"))
    gone = rooted.join(best, "root").where("not (doc_id <=> best.doc_id and h = best.h)").select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    gone = written(gone, "shingle-gone")
    dropped(rooted)
    # Up to a million rows (16 bytes each) are broadcast, so that texts stay where they are; beyond, both sides are shuffled.
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("gone_h")), "left_anti")
