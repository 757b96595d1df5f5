"""Packing documents into windows by the sum-of-squares rule.

Each task packs the documents of its partition as they come. A document longer than a window first gives whole windows; its
rest goes to the fill level (or a new window) after which the sum over levels of the squared number of windows at that
level is least. The counts of all levels stand in one array, so that a choice is one vector expression. When the task's
documents end, the windows that are still open are merged by cutting the least full ones into the gaps of the fullest;
the one that is left is cut at powers of two, which need no padding. Nothing is shuffled, so no key can be hot, and
memory is bounded by the open windows of a partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied
from .word_merges import STRETCH, tokens

#: Sequence ids of a partition begin at its number times this.
PER_TASK = 1 << 36

#: A piece of a document: its id, where it starts, the packed ids, the document's length.
Piece = tuple[object, int, bytes, int]


class Packer:
    """Online packing of packed ids into windows of ``size`` ids; ``add`` and ``close`` yield whole windows."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # open windows at each fill level; 0 and size stay zero
        self.open: dict[int, list[list[Piece]]] = {}

    def level(self, n: int) -> int:
        """The level (0: a new window) to which n ids are added at least sum of squares; of equals the fullest."""
        c = self.count
        gain = np.empty(self.size - n + 1, np.int64)
        gain[:] = 2 * c[n:] + 1  # a window arrives at level + n
        gain[-1] = 0  # a full one leaves
        gain[1:] -= 2 * c[1 : self.size - n + 1] - 1
        gain[1:][c[1 : self.size - n + 1] == 0] = np.iinfo(np.int64).max
        return len(gain) - 1 - int(np.argmin(gain[::-1]))

    def add(self, doc: object, ids: bytes) -> Iterator[list[Piece]]:
        total = len(ids) // 4
        start = 0
        while total - start >= self.size:
            yield [(doc, start, ids[4 * start : 4 * (start + self.size)], total)]
            start += self.size
        if n := total - start:
            at = self.level(n)
            window = self.open[at].pop() if at else []
            window.append((doc, start, ids[4 * start :], total))
            if at:
                self.count[at] -= 1
            if at + n == self.size:
                yield window
            else:
                self.count[at + n] += 1
                self.open.setdefault(at + n, []).append(window)

    def close(self) -> Iterator[list[Piece]]:
        left = [(fill, w) for fill in sorted(self.open, reverse=True) for w in self.open[fill]]
        self.open, self.count[:] = {}, 0
        lo, hi = 0, len(left) - 1
        while lo < hi:
            fill, window = left[lo]
            gap = self.size - fill
            small, pieces = left[hi]
            while gap and pieces:
                doc, start, ids, total = pieces.pop()
                n = len(ids) // 4
                take = min(gap, n)
                window.append((doc, start + n - take, ids[4 * (n - take) :], total))
                if take < n:
                    pieces.append((doc, start, ids[: 4 * (n - take)], total))
                gap -= take
                small -= take
            left[lo], left[hi] = (self.size - gap, window), (small, pieces)
            if not gap:
                yield window
                lo += 1
            if not small:
                hi -= 1
        if lo == hi:
            yield from self.binary(*left[lo])

    def binary(self, fill: int, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """Cuts what is left into windows whose sizes are the powers of two in ``fill``."""
        pieces = pieces[::-1]
        for bit in reversed(range(fill.bit_length())):
            want, window = fill & (1 << bit), []
            while want:
                doc, start, ids, total = pieces.pop()
                n = min(want, len(ids) // 4)
                window.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    pieces.append((doc, start + n, ids[4 * n :], total))
                want -= n
            if window:
                yield window


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows; other columns of
    ``docs`` are not read. Sequence ids are unique over the whole result, offsets are gapless from 0.
    """

    def run(batches):
        tok, packer = tokens(tokenizer), Packer(size)
        sequence = TaskContext.get().partitionId() * PER_TASK
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []

        def emit(windows):
            nonlocal sequence
            for w in windows:
                offset = 0
                for doc, start, ids, total in w:
                    n = len(ids) // 4
                    rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset) + ((np.frombuffer(ids, "<u4").astype("i4"),) if with_ids else ()))
                    offset += n
                sequence += 1

        def batch():
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        kinds = pa.int64()
        schema = None
        keys: list = []
        texts: list[str] = []
        chars = 0
        for b in batches:
            if schema is None:
                schema = pa.schema([("id", b.schema.field(0).type), *((x, kinds) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))] + [("ids", pa.list_(pa.int32()))] * with_ids)
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys.append(key)
                texts.append(text or "")
                chars += len(texts[-1])
                if chars >= STRETCH:
                    for k, ids in zip(keys, tok.packed(texts)):
                        emit(packer.add(k, ids + end))
                        if len(rows) >= 2000:
                            yield batch()
                    keys, texts, chars = [], [], 0
        if schema is not None:
            for k, ids in zip(keys, tok.packed(texts)):
                emit(packer.add(k, ids + end))
                if len(rows) >= 2000:
                    yield batch()
            emit(packer.close())
            yield batch()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(tidied(run), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)
