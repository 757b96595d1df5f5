"""Exact top-k inner products over a bit-sliced index.

Candidates are indexed in blocks. Each quantised attribute of a block is kept as bitmaps, one for each bit of its value above
the block's least; a query's score is then a sum of shifted bitmaps, added by carry-save adders over whole bitmaps for all
rows of the block at once. From the sum's most significant slice downward the set of certain top rows and the set of
boundary rows are narrowed; the boundary rows have equal scores and are resolved by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: Rows of a candidate block and queries of a query block.
BLOCK, QUERIES = 16_384, 256
#: Blocks into which few candidates and few queries are cut nevertheless, so that there are pairs for many tasks. A query costs a
#: block's bitmaps of some hundred words hardly more than those of ten.
FEW_BLOCKS, FEW_QUERIES = 4, 16
#: The greatest quantised value that the index takes: the inner products of up to 2^14 dimensions have less than 38 digits.
MOST = 1 << 55


def bitmaps(values: np.ndarray) -> list[np.ndarray]:
    """The bits of non-negative ``values``, lowest first, as bitmaps of 64-bit words."""
    n = -(-len(values) // 64) * 64
    out = []
    for b in range(int(values.max(initial=0)).bit_length()):
        bits = np.zeros(n, bool)
        bits[: len(values)] = (values >> b) & 1
        out.append(np.packbits(bits, bitorder="little").view(np.uint64))
    return out


class Index:
    """Slices of the attributes of a block of rows in ascending id order."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, values = ids[by], values[by]
        self.low = values.min(axis=0, initial=0)
        self.high = values.max(axis=0, initial=0)
        self.words = -(-len(ids) // 64)
        # By bit: the attributes that have it, and their bitmaps.
        slices = [bitmaps(values[:, d] - self.low[d]) for d in range(values.shape[1])]
        self.bits = max(map(len, slices), default=0)
        self.has = [np.array([d for d, s in enumerate(slices) if len(s) > b], np.int64) for b in range(self.bits)]
        self.maps = [np.stack([slices[d][b] for d in h]) for b, h in enumerate(self.has)]
        self.width = self.high - self.low
        self.all = np.zeros(self.words * 64, bool)
        self.all[: len(ids)] = True
        self.all = np.packbits(self.all, bitorder="little").view(np.uint64)

    def sum(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of (score - base) for every row, lowest first, and base: the sum over attributes of query * value.

        A negative weight adds the complement of the attribute's bits instead, which keeps every addend non-negative:
        -w * (v - low) = w * ((2^k - 1) - (v - low)) - w * (2^k - 1).
        """
        weight = np.abs(query)
        base = sum(int(q) * int(x) for q, x in zip(query, self.low))
        piles: dict[int, list[np.ndarray]] = {}
        for b in range(self.bits):
            has, maps = self.has[b], self.maps[b]
            w = weight[has]
            flip = query[has] < 0
            base -= sum(int(x) for x in w[flip]) << b
            maps = np.where(flip[:, None], ~maps & self.all, maps) if flip.any() else maps
            for j in range(int(w.max(initial=0)).bit_length()):
                rows = maps[(w >> j) & 1 == 1]
                if len(rows):
                    piles.setdefault(b + j, []).append(rows)
        out: list[np.ndarray] = []
        at = 0
        while piles:
            pile = np.concatenate(piles.pop(at)) if at in piles else np.zeros((0, self.words), np.uint64)
            while len(pile) > 2:  # three bitmaps of a weight become one, and one of twice the weight
                n = len(pile) // 3
                a, b, c = pile[:n], pile[n : 2 * n], pile[2 * n : 3 * n]
                ab = a ^ b
                piles.setdefault(at + 1, []).append((a & b) | (ab & c))
                pile = np.concatenate([ab ^ c, pile[3 * n :]])
            if len(pile) == 2:
                piles.setdefault(at + 1, []).append((pile[0] & pile[1])[None])
                out.append(pile[0] ^ pile[1])
            else:
                out.append(pile[0] if len(pile) else np.zeros(self.words, np.uint64))
            at += 1
        return out, base

    def top(self, query: np.ndarray, k: int, without: int | None = None) -> list[tuple[int, int]]:
        """(id, score) of the k rows of highest score, ties to the smaller id; fewer if there are fewer."""
        sums, base = self.sum(query)
        sure, edge = np.zeros(self.words, np.uint64), self.all.copy()
        if without is not None:
            for at in range(*np.searchsorted(self.ids, [without, without + 1])):
                edge[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        for s in reversed(sums):
            upper = edge & s
            n = int(np.bitwise_count(sure).sum() + np.bitwise_count(upper).sum())
            if n > k:
                edge = upper
            else:
                sure |= upper
                edge &= ~s
                if n == k:
                    edge[:] = 0
                    break

        def rows(bits: np.ndarray, most: int | None = None) -> list[int]:
            return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))[:most].tolist()

        picked = rows(sure)
        picked += rows(edge, k - len(picked))  # the boundary: equal scores, so the smallest ids
        score = {r: base + sum(int(s[r // 64] >> np.uint64(r % 64) & np.uint64(1)) << i for i, s in enumerate(sums)) for r in picked}
        return sorted(((int(self.ids[r]), score[r]) for r in picked), key=lambda x: (-x[1], x[0]))


def quantise(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<long>) with floor(scale * x) for each component as double; rows whose id or vector is null, or that hold
    null or non-finite components, are left out. A value beyond +-MOST is an error: its products don't fit a long."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    large = F.raise_error(F.lit("a vector's component is too large for scores of 64 bits")).cast("long")
    floor = lambda c: F.when(F.abs(c * F.lit(scale)) <= F.lit(float(MOST)), F.floor(c * F.lit(scale))).otherwise(large)
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(x, floor).alias("v"))


def _unpacked(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids, sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int32)
    out = np.zeros((len(ids), dim), np.int64)  # a shorter vector's missing components count as 0
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(ids)), sizes), inner] = np.frombuffer(row["v"], row["kind"])
    return ids, out


def _blocks(quantised: DataFrame, partitions: int) -> DataFrame:
    """Each partition's rows as one block in packed form, numbered by the partition."""

    def run(batches):
        ids, vectors = [], []
        for b in batches:
            ids.append(b.column(0).to_numpy())
            vectors.append(b.column(1))
        if ids and sum(map(len, ids)):
            v = pa.concat_arrays(vectors)
            flat = v.flatten().to_numpy()
            most = int(np.abs(flat).max(initial=0))
            kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
            sizes = v.value_lengths().to_numpy().astype(np.int32)
            row = {"b": TaskContext.get().partitionId(), "ids": np.concatenate(ids).tobytes(), "dim": int(sizes.max()), "kind": kind, "v": flat.astype(kind).tobytes(), "sizes": sizes.tobytes()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("b", pa.int64()), ("ids", pa.binary()), ("dim", pa.int64()), ("kind", pa.string()), ("v", pa.binary()), ("sizes", pa.binary())]))

    return quantised.repartition(partitions).mapInArrow(run, "b long, ids binary, dim long, kind string, v binary, sizes binary")


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: its ``k`` rows of highest inner product of the quantised vectors.

    Rows (query_id, rank from 1, vec_id, score); a query's own id is no candidate; ties to the smaller id; fewer rows if there
    are fewer candidates, none for an empty table. Repeated ids are candidates each, and one query (one of their vectors); a
    vector shorter than others has 0 for what is missing; other columns are not read. The query set meets the candidates
    block by block; each pair of blocks is one row of work, and its result is at most k rows for each query. Pairs come
    sorted by the candidates' block, whose index is built once in a task; where there are few blocks, some tasks share
    each (``turn``). Scores are exact; one of the result that doesn't fit a long is an error.
    """
    q = quantise(vectors, scale, id_col, vector_col)
    n = q.count()
    size = max(256, min(BLOCK, -(-n // FEW_BLOCKS)))
    blocks = max(1, -(-n // size))
    turns = max(1, 2 * FEW_BLOCKS // blocks)
    asked = q.where(F.col("id") % every == 0).dropDuplicates(["id"])
    candidates = written(_blocks(q, blocks), "bits-candidates")
    queries = written(_blocks(asked, max(1, n // (every * QUERIES), min(FEW_QUERIES, n // (every * FEW_QUERIES)))), "bits-queries")
    pairs = queries.withColumnsRenamed({c: f"q_{c}" for c in queries.columns}).withColumn("turn", F.col("q_b") % turns).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    shared = candidates.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))
    parts = shuffle_partitions(q.sparkSession)
    pairs, shared = (x.repartition(parts, "b", "turn") for x in (pairs, shared))

    def run(batches):
        kept: tuple[tuple, Index] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                dim = max(row["dim"], row["q_dim"])
                if kept is None or kept[0] != (row["b"], dim):
                    kept = ((row["b"], dim), Index(*_unpacked(row, dim)))
                ids, asked = _unpacked({c: row[f"q_{c}"] for c in ("ids", "v", "sizes", "kind")}, dim)
                out = [(qid, vec, score) for qid, v in zip(ids.tolist(), asked) for vec, score in kept[1].top(v, k, qid)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.decimal128(38, 0)))], ["query_id", "vec_id", "score"])

    found = pairs.hint("merge").join(shared, ["b", "turn"]).mapInArrow(run, "query_id long, vec_id long, score decimal(38,0)")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("top")).select("query_id", F.posexplode("top").alias("i", "x"))
    score = -F.col("x.s")
    fits = score.between(F.lit(-(1 << 63)), F.lit((1 << 63) - 1))
    return ranked.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.when(fits, score.cast("long")).otherwise(F.raise_error(F.lit("a score doesn't fit 64 bits")).cast("long")).alias("score"))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (query_id, vec_id) pairs that were found."""
    t = truth.select("query_id", "vec_id").distinct()
    return t.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").count() / max(1, t.count())


