"""Byte-level BPE by replaying merges over the corpus.

Texts are cut into chunks between which no match of the split pattern lies, and stand in blocks. Each block asks shards for its
distinct chunks; a shard lays out the distinct words of all chunks that the corpus asks it for in one row of byte
positions, with an inverted index that leads from each rank to the positions whose token pair has that rank. Ranks are taken
in ascending order; a merge touches only its two neighbours and enters their new pairs into the index. The ids return to
the blocks, where they are put in the order of the texts. So a chunk is worked on once in the corpus, and no task holds
more than its shard's or its block's chunks.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .word_merges import Ragged

#: Characters of a block, and of a slice of words whose merges are replayed together.
BLOCK_CHARS, SLICE_CHARS = 12_000_000, 12_000_000
#: Bytes of text for each shard; its distinct chunks are a part of them.
SHARD_BYTES = 16 << 20
#: Bytes of a chunk that tell its shard.
PREFIX = 4
#: How strongly what shards are asked for and answer is compressed.
PACKED = 15
#: How often the merges of one rank may be held up in a word by those of lower ranks before the word is encoded by itself.
HOLD_UPS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token, a blank, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """Which pair of token ids makes which token: every split of every token into two tokens, sorted by pair."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= 1 << 24:
            raise ValueError("ranks must be below 2**24")
        found = {(ranks[t[:i]] << 24) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = np.array(sorted(found), np.int64)
        self.made = np.array([found[p] for p in self.pairs.tolist()], np.int32)
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        # Tokens that are part of a pair which makes a token of lower rank.
        self.early = np.zeros(max(ranks.values(), default=0) + 1, bool)
        for part in (self.pairs >> 24, self.pairs & (1 << 24) - 1):
            self.early[part[self.made < part]] = True
        self._table: dict[int, int] = {}

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        if not len(self.pairs):
            return np.full(len(left), -1, np.int32)
        key = (left.astype(np.int64) << 24) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], -1)

    def table(self) -> dict[int, int]:
        """Which token each pair makes, as a dict."""
        if not self._table:
            self._table = dict(zip(self.pairs.tolist(), self.made.tolist()))
        return self._table


def replay(words: list[bytes], ranks: dict[bytes, int], merges: Merges) -> list[list[int]]:
    """The ids of each word. A word that is a token itself is that token; a byte without a token is an error."""
    out: list[list[int]] = [[r] if (r := ranks.get(w)) is not None else [] for w in words]
    open_ = [k for k, w in enumerate(words) if w and not out[k]]
    if not open_:
        return out
    sizes = np.array([len(words[k]) for k in open_])
    token = merges.byte[np.frombuffer(b"".join(words[k] for k in open_), np.uint8)]
    if (token < 0).any():
        raise ValueError("the vocabulary lacks a byte")
    n = len(token)
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    last = np.cumsum(sizes) - 1
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[last] = -1
    before[last[:-1] + 1] = before[0] = -1
    alive = np.ones(n, bool)
    rank_of = np.full(n, -1, np.int32)  # of the pair that begins at a position
    index: dict[int, list[np.ndarray]] = {}
    order: list[int] = []

    def enter(at: np.ndarray, rank: np.ndarray) -> None:
        rank_of[at] = rank
        if not len(at := at[rank >= 0]):
            return
        rank = rank[rank >= 0]
        by = np.argsort(rank, kind="stable")
        at, rank = at[by], rank[by]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(at)]
        for r, lo, hi in zip(rank[bounds[:-1]].tolist(), bounds, bounds[1:]):
            if r in index:
                index[r].append(at[lo:hi])
            else:
                index[r] = [at[lo:hi]]
                heappush(order, r)

    pairs = np.flatnonzero(after >= 0)
    enter(pairs, merges(token[pairs], token[pairs + 1]))
    held_up = np.zeros(len(sizes), np.int32)
    alone: dict[int, list[int]] = {}
    while order:
        r = heappop(order)
        spots = index.pop(r)
        at = spots[0] if len(spots) == 1 else np.unique(np.concatenate(spots))
        at = at[rank_of[at] == r]
        if not len(at):
            continue
        every = at
        # Of pairs that overlap (x x x) the first, third and so on are merged.
        linked = np.zeros(len(at), bool)
        linked[1:] = after[at[:-1]] == at[1:]
        if linked.any():
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(linked, 0, number))) % 2 == 0]
        gone = after[at]
        right, left = after[gone], before[at]
        if merges.early[r] and len(at) > 1:
            # A pair that a merge makes may have a lower rank, and comes before what is to the right in its word.
            beside = np.zeros(len(at), bool)
            beside[1:] = left[1:] == gone[:-1]
            low = np.full(len(at), 1 << 30, np.int32)
            for has, x, y in ((left >= 0, np.where(beside, r, token[left]), r), (right >= 0, r, token[right])):
                new = merges(np.broadcast_to(x, len(at))[has], np.broadcast_to(y, len(at))[has])
                low[has] = np.minimum(low[has], np.where(new >= 0, new, 1 << 30))
            if (low < r).any():
                w = word[at]
                start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                before_here = np.cumsum(low < r) - (low < r)
                late = before_here > np.repeat(before_here[start], np.diff(np.append(start, len(at))))
                if late.any():
                    some = np.unique(w[late])
                    index[r] = [every[np.isin(word[every], some)]]  # what is merged now no longer has this rank then
                    heappush(order, r)
                    held_up[some] += 1
                    for k in some[held_up[some] > HOLD_UPS].tolist():
                        alone[k] = alone_ids(words[open_[k]], merges)
                        rank_of[last[k] - sizes[k] + 1 : last[k] + 1] = -1
                    at, gone, right, left = at[~late], gone[~late], right[~late], left[~late]
        token[at] = r
        alive[gone] = False
        rank_of[gone] = -1
        after[at] = right
        has = right >= 0
        before[right[has]] = at[has]
        rank_of[at[~has]] = -1
        # Pairs that begin at a merged token, and those that end at one; what follows or comes before may be merged as well.
        both = np.unique(np.concatenate([at[has], before[at[left >= 0]]]))
        both = both[held_up[word[both]] <= HOLD_UPS] if alone else both
        enter(both, merges(token[both], token[after[both]]))
    ids = token[alive].tolist()
    ends = np.cumsum(np.bincount(word[alive], minlength=len(sizes))).tolist()
    at = 0
    for n, (k, end) in enumerate(zip(open_, ends)):
        out[k] = alone.get(n) or ids[at:end]
        at = end
    return out


def alone_ids(word: bytes, merges: Merges) -> list[int]:
    """The ids of one word by a heap of its pairs."""
    made = merges.table()
    token = merges.byte[np.frombuffer(word, np.uint8)].tolist()
    n = len(token)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [made.get(a << 24 | b, -1) for a, b in zip(token, token[1:])] + [-1]
    heap = [(r, i) for i, r in enumerate(rank) if r >= 0]
    heapify(heap)
    while heap:
        r, i = heappop(heap)
        if rank[i] != r:
            continue
        gone = after[i]
        right = after[i] = after[gone]
        token[i], token[gone], rank[gone], rank[i] = r, -1, -1, -1
        if right < n:
            before[right] = i
        for a, b in ((before[i], i), (i, right)):
            if a >= 0 and b < n:
                rank[a] = made.get(token[a] << 24 | token[b], -1)
                if rank[a] >= 0:
                    heappush(heap, (rank[a], a))
    return [t for t in token if t >= 0]


class Encoder:
    """Cuts texts into chunks and makes their ids."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.merges = Merges(self.ranks)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern)
        # Tokens and decimal numbers of ids as bytes, for taking many at once.
        most = max(self.tokens, default=-1) + 1
        self.bytes = _ragged([self.tokens.get(i, b"") for i in range(most)])
        self.names = _ragged([b",%d" % i for i in range(most)])

    def chunks(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct chunks, numbers of the chunks of all texts in order, bounds of the texts in them).

        No match of the pattern lies across a cut before a blank or around a newline that stands between other characters than
        white space. A text with other white space, or one that begins or ends with white space, is split by the pattern.
        """
        whole = pa.array(texts, pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(whole, _ODD_SPACE).to_numpy(zero_copy_only=False)).tolist()
        slow = {i: self.split.findall(texts[i]) for i in odd}
        plain = pa.array([None if i in slow else t for i, t in enumerate(texts)], pa.large_string()) if slow else whole
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0"), "\0")
        flat, bounds = cut.flatten(), np.diff(cut.offsets.to_numpy())
        if slow:
            starts = np.concatenate([[0], np.cumsum(bounds)])
            pieces, at = [], 0
            for i in odd:
                pieces += [flat.slice(starts[at], starts[i] - starts[at]), pa.array(slow[i], pa.large_string())]
                bounds[i], at = len(slow[i]), i
            flat = pa.concat_arrays([*pieces, flat.slice(starts[at])])
        coded = flat.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), np.concatenate([[0], np.cumsum(bounds)])

    def ids(self, chunks: list[str]) -> Ragged:
        """The ids of distinct chunks: merges are replayed over their distinct words, a slice at a time."""
        words = list(map(self.split.findall, chunks))
        distinct = list(dict.fromkeys(chain.from_iterable(words)))
        made: list[list[int]] = []
        for lo, hi in slices(distinct, SLICE_CHARS):
            made += replay([w.encode() for w in distinct[lo:hi]], self.ranks, self.merges)
        found = _ragged_ids(made)
        number = {w: i for i, w in enumerate(distinct)}
        counts = np.fromiter(map(len, words), np.int64, len(words))
        each = found.take(np.fromiter((number[w] for w in chain.from_iterable(words)), np.int64, int(counts.sum())))
        return _together(each, counts)

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, without the corpus around it."""
        distinct, code, bounds = self.chunks(texts)
        each = self.ids(distinct.to_pylist()).take(code)
        return (np.frombuffer(x, "<u4").tolist() for x in each.pieces(bounds))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: Texts that are split by the pattern itself: white space other than blanks and newlines, or two of these side by side, or at an
#: end; and U+0000, which marks cuts.
_ODD_SPACE = "[\\t\\v\\f\\r\\x{0}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$"


def _ragged(rows: list[bytes]) -> Ragged:
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    return Ragged(np.frombuffer(b"".join(rows), np.uint8), np.cumsum(size) - size, size)


def _ragged_ids(rows: list[list[int]]) -> Ragged:
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    return Ragged(np.fromiter(chain.from_iterable(rows), "<u4", int(size.sum())), np.cumsum(size) - size, size)


def _together(rows: Ragged, counts: np.ndarray) -> Ragged:
    """Runs of ``counts`` rows, which stand one after the other, as one row each."""
    ends = np.concatenate([[0], np.cumsum(rows.size)])[np.concatenate([[0], np.cumsum(counts)])]
    return Ragged(rows.flat, ends[:-1], np.diff(ends))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def slices(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``chars`` characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, body): compressed runs of rows of about BLOCK_CHARS characters."""

    def run(it):
        z = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(12, enable_ldm=True, window_log=25))
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def pack():
            nonlocal number, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([z.compress(sink.getvalue())], pa.binary())], ["block", "body"])

        for b in it:
            at = 0
            for i, n in enumerate(pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()):
                size += n
                if size >= BLOCK_CHARS:
                    held.append(b.slice(at, i + 1 - at))
                    yield pack()
                    at = i + 1
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield pack()

    kind = pa.large_string()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def large(it):
        yield from run(pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(kind)], ["id", "t"]) for b in it)

    return texts.mapInArrow(large, "block long, body binary")


def _opened(body: bytes) -> tuple[pa.Array, list[str]]:
    """(ids, texts) of a block; a null text is empty."""
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 34)).read_all()
    return table.column(0).combine_chunks(), [t or "" for t in table.column(1).to_pylist()]


def _dealt(chunks: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``chunks`` by shard and bytes, and the bounds of the shards in it. A chunk's shard comes from its first PREFIX
    bytes, so that what a shard is asked for is alike and compresses well."""
    ends = np.frombuffer(chunks.buffers()[1], np.int64, len(chunks) + 1)
    data = np.append(np.frombuffer(chunks.buffers()[2], np.uint8, ends[-1]) if ends[-1] else np.zeros(0, np.uint8), np.uint8(0))
    h = np.zeros(len(chunks), np.uint64)
    for i in range(PREFIX):
        at = ends[:-1] + i
        h = h << np.uint64(8) | np.where(at < ends[1:], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint64)
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    shard = ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
    order = pc.sort_indices(chunks).to_numpy().astype(np.int64)
    order = order[np.argsort(shard[order], kind="stable")]
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers byte by byte of equal weight: those of small ones are mostly zeros side by side."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _over_corpus(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, rows, schema: str) -> DataFrame:
    """``rows``(encoder, ids, each: ids of the chunks of all texts, bounds of texts) of each block, a table of ``schema``."""
    spark = docs.sparkSession
    blocks = written(_blocks(docs, id_col, text_col), "bpe-blocks")
    size = blocks.agg(F.count("*")).first()[0]
    shards = max(24, math.ceil(size * BLOCK_CHARS / SHARD_BYTES))

    def asked(it):
        z, enc = zstandard.ZstdCompressor(level=PACKED), encoder(path, pattern)
        for b in it:
            for block, body in zip(b.column(0).to_pylist(), b.column(1)):
                chunks = enc.chunks(_opened(body.as_py())[1])[0]
                order, bounds = _dealt(chunks, shards)
                chunks = chunks.take(pa.array(order))
                some = [i for i in range(shards) if bounds[i + 1] > bounds[i]]
                packs = []
                for i in some:
                    part = chunks.slice(bounds[i], bounds[i + 1] - bounds[i])
                    sizes = pc.binary_length(part).to_numpy().astype("<u4")
                    packs.append(z.compress(np.uint32(len(sizes)).tobytes() + _planes(sizes) + "".join(part.to_pylist()).encode()))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array(packs, pa.binary())], ["shard", "block", "chunks"])

    def answered(table):
        z, d, enc = zstandard.ZstdCompressor(level=PACKED), zstandard.ZstdDecompressor(), encoder(path, pattern)
        parts = []
        for pack in table["chunks"]:
            data = d.decompress(pack.as_py(), max_output_size=1 << 34)
            n = int(np.frombuffer(data, "<u4", 1)[0])
            ends = np.concatenate([[0], np.cumsum(_unplaned(data[4 : 4 + 4 * n]).astype(np.int64))])
            parts.append(pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends), pa.py_buffer(data[4 + 4 * n :])]))
        coded = pa.concat_arrays(parts).dictionary_encode()
        found = enc.ids(coded.dictionary.to_pylist())
        code, at, packs = coded.indices.to_numpy(), 0, []
        for p in parts:
            mine = found.take(code[at : at + len(p)])
            packs.append(z.compress(np.uint32(len(p)).tobytes() + mine.size.astype("<u4").tobytes() + mine.flat.tobytes()))
            at += len(p)
        return pa.table({"block": table["block"], "shard": table["shard"], "ids": pa.array(packs, pa.binary())})

    def put(docs_, answers):
        d, enc = zstandard.ZstdDecompressor(), encoder(path, pattern)
        out = []
        for body in docs_["body"]:
            ids, texts = _opened(body.as_py())
            chunks, code, bounds = enc.chunks(texts)
            del texts
            order, _ = _dealt(chunks, shards)
            sizes, flats = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
            for _, pack in sorted(zip(answers["shard"].to_pylist(), answers["ids"]), key=lambda x: x[0]):
                data = d.decompress(pack.as_py(), max_output_size=1 << 34)
                n = int(np.frombuffer(data, "<u4", 1)[0])
                sizes.append(np.frombuffer(data, "<u4", n, 4).astype(np.int64))
                flats.append(np.frombuffer(data, "<u4", -1, 4 + 4 * n))
            size, flat = np.concatenate(sizes), np.concatenate(flats)
            start = np.empty(len(order), np.int64)
            back = np.empty(len(order), np.int64)
            start[order], back[order] = np.cumsum(size) - size, size
            out.append(rows(enc, ids, Ragged(flat, start, back), code, bounds))
        return pa.concat_tables(out)

    requests = blocks.mapInArrow(asked, "shard long, block long, chunks binary")
    answers = requests.groupBy("shard").applyInArrow(answered, "block long, shard long, ids binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(put, schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``id_col``, ids array<int>) of each row of ``docs``; a null or empty text has no ids; repeated rows stay; other columns
    are not read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(enc, ids, chunks, code, bounds):
        each = chunks.take(code)
        ends = np.append(each.start, len(each.flat))[bounds].astype(np.int32)
        return pa.table({"id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(each.flat.astype(np.int32)))})

    return _over_corpus(docs, path, pattern, id_col, text_col, rows, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (``id_col``, bytes binary); null ids decode to no bytes, an id without a token is an error."""

    def run(batches):
        enc = encoder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), ids_col).mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document: encoded, decoded from the ids, and digested. A null or empty
    text has no tokens; repeated rows and null ids keep a row each; an empty table gives no rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(enc, ids, chunks, code, bounds):
        n, ids_sha, text_sha = [], [], []
        # The numbers and the decoded bytes of each distinct chunk, from its ids; then those of some texts at a time.
        token = chunks.take(np.arange(len(chunks.size))).flat
        named, spelt = (_together(x.take(token), chunks.size) for x in (enc.names, enc.bytes))
        for lo in range(0, len(bounds) - 1, 500):
            some = code[bounds[lo] : bounds[min(lo + 500, len(bounds) - 1)]]
            cuts = bounds[lo : lo + 501] - bounds[lo]
            n += np.diff(np.concatenate([[0], np.cumsum(chunks.size[some])])[cuts]).tolist()
            for table, out, skip in ((named, ids_sha, 1), (spelt, text_sha, 0)):
                each = table.take(some)
                ends = np.append(each.start, len(each.flat))[cuts].tolist()
                data = memoryview(each.flat)
                out += [hashlib.sha256(data[a + skip : b] if b > a else b"").hexdigest() for a, b in zip(ends, ends[1:])]
        return pa.table({"doc_id": ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    return _over_corpus(docs, path, pattern, "doc_id", "text", rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
