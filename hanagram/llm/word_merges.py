"""Ids of texts by a tokenizer of words with word ends, as its library gives them.

Texts are cut at blanks and newlines, which the tokenizer drops. A chunk of Latin letters and the ASCII punctuation after it is
one word and one mark for this tokenizer: the distinct words of a stretch of texts are laid out as columns of arrays, and
each step merges in every word the pair of lowest rank, of equals the leftmost. All other chunks, and marks, go through
the library. Each distinct chunk is worked on once in a stretch.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of texts that are taken at once.
STRETCH = 4_000_000
#: Bytes of a word, ranks and ids that fit the keys.
LONGEST, ID_BITS, PLACE_BITS = 31, 17, 5
_NONE = np.int32(1 << 30)
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_LETTER = np.array([b < 127 and chr(b).isalpha() for b in range(256)])
#: The kind of tokenizer that ``Merges`` knows: fixed values of the file's format.
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@dataclass
class Ragged:
    """Rows of ids: where each begins in ``flat``, and its size."""

    flat: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def take(self, rows: np.ndarray) -> Ragged:
        size = self.size[rows]
        ends = np.cumsum(size)
        start = ends - size
        at = np.repeat(self.start[rows] - start, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return Ragged(self.flat[at], start, size)

    def joined(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.start, other.start + len(self.flat)]), np.concatenate([self.size, other.size]))

    def pieces(self, rows: np.ndarray) -> list[bytes]:
        """The packed ids of the runs of rows between ``rows``; rows stand in ``flat`` in order."""
        bounds = (4 * np.append(self.start, self.start[-1] + self.size[-1] if len(self.start) else 0)[rows]).tolist()
        data = self.flat.tobytes()
        return [data[lo:hi] for lo, hi in zip(bounds, bounds[1:])]


def _runs(values: np.ndarray, most: int):
    """Bounds of the runs of equal ``values``, ascending, cut at ``most``."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)]):
        for at in range(lo, hi, most):
            yield at, min(hi, at + most)


class Merges:
    """The merges of a vocabulary whose words end in a mark."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs.setdefault(vocab[left] << ID_BITS | vocab[right], (rank, vocab[left + right]))
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[p][0] for p in self.pairs.tolist()], np.int32)
        self.made = np.zeros(len(model["merges"]), np.int32)
        for rank, made in pairs.values():
            self.made[rank] = made
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letters[b] + "</w>"] for b in range(256)], np.int32)

    @classmethod
    def of(cls, file: dict) -> Merges | None:
        """None for a tokenizer of another kind."""
        model, normalizer, cut = file["model"], file["normalizer"] or {}, file["pre_tokenizer"] or {}
        steps = [x.get("type") for x in normalizer.get("normalizers", [])]
        cuts = [x.get("pattern", {}).get("Regex") if x.get("type") == "Split" else x.get("type") for x in cut.get("pretokenizers", [])]
        same = {k: v for k, v in model.items() if k not in ("vocab", "merges")} == _MODEL and steps == ["NFC", "Replace", "Lowercase"] and cuts == [_SPLIT, "ByteLevel"]
        fits = same and max(model["vocab"].values()) < 1 << ID_BITS and len(model["merges"]) < 1 << 30 - PLACE_BITS - 1
        return cls(model) if fits else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << ID_BITS | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE >> PLACE_BITS)

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> Ragged:
        """The ids of words of LONGEST bytes at most that stand in ``data`` one after the other."""
        size, data = np.diff(ends, prepend=0), np.append(data, np.uint8(0))
        start, made = ends - size, []
        order = np.argsort(size, kind="stable")
        for lo, hi in _runs((size[order] + 3) // 4, 50_000):
            made.append(self._together(data, start[order[lo:hi]], size[order[lo:hi]]))
        flat = np.concatenate([f for f, _ in made] or [np.zeros(0, np.int32)])
        counts = np.zeros(len(size), np.int64)
        counts[order] = np.concatenate([c for _, c in made] or [np.zeros(0, np.int64)])
        begin = np.zeros(len(size), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return Ragged(flat.astype("<u4"), begin, counts)

    def _together(self, data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words in a row, and how many each word has. A column is a word; key holds for each place the rank of the
        pair that begins there and the place, so that the least is the next merge."""
        n, count = max(1, int(sizes.max())), len(sizes)
        place = np.arange(n, dtype=np.int32)[:, None]
        raw = data[np.minimum(start + place, len(data) - 1)]
        token = np.full((n + 1, count), -1, np.int32)
        token[:n] = np.where(place < sizes, np.where(place == sizes - 1, self.final[raw], self.inner[raw]), -1)
        key = np.full((n, count), _NONE, np.int32)
        row, column = np.nonzero(token[1:n] >= 0)
        key[row, column] = self.rank(token[row, column], token[row + 1, column]) << PLACE_BITS | row
        after = np.repeat(np.arange(1, n + 2, dtype=np.int8)[:, None], count, 1)
        before = np.repeat(np.arange(-1, n, dtype=np.int8)[:, None], count, 1)
        out = np.full((n, count), -1, np.int32)
        columns = np.arange(count)
        while True:
            least = key.min(axis=0)
            busy = least < (_NONE >> PLACE_BITS) << PLACE_BITS
            if not busy.all():
                out[:, columns[~busy]] = token[:n, ~busy]
                if not busy.any():
                    break
                token, key, after, before, columns, least = token[:, busy], key[:, busy], after[:, busy], before[:, busy], columns[busy], least[busy]
            w, at = np.arange(len(columns)), least & (1 << PLACE_BITS) - 1
            gone = after[at, w]
            right = after[gone, w]
            token[at, w] = made = self.made[least >> PLACE_BITS]
            token[gone, w] = -1
            after[at, w] = right
            key[at, w] = _NONE
            key[gone, w] = _NONE
            has = token[right, w] >= 0
            a, r, c = at[has], right[has], w[has]
            before[r, c] = a
            key[a, c] = self.rank(made[has], token[r, c]) << PLACE_BITS | a
            left = before[at, w]
            has = left >= 0
            h, c = left[has].astype(np.int32), w[has]
            key[h, c] = self.rank(token[h, c], made[has]) << PLACE_BITS | h
        flat = out.T
        return flat[flat >= 0], (flat >= 0).sum(axis=1)


class Tokens:
    """Ids of texts by the tokenizer file at ``path``, special tokens in a text as the library takes them by default."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.merges = Merges.of(json.load(f))

    def library(self, chunks: list[str]) -> Ragged:
        made = []
        for lo in range(0, len(chunks), 10_000):
            made += [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(chunks[lo : lo + 10_000], add_special_tokens=False)]
        counts = np.fromiter(map(len, made), np.int64, len(made))
        return Ragged(np.concatenate([np.zeros(0, "<u4"), *made]), np.cumsum(counts) - counts, counts)

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed unsigned 32-bit integers, little-endian."""
        if self.merges is None or not texts:
            return self.library(texts).pieces(np.arange(len(texts) + 1))
        whole = pa.array(texts, pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(whole, "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        return self.chunks(coded.dictionary).take(coded.indices.to_numpy()).pieces(cut.offsets.to_numpy())

    def chunks(self, chunks: pa.Array) -> Ragged:
        """The ids of distinct chunks, a large_string array."""
        bounds, data = _laid_out(chunks)
        # Letters: those of ASCII, and the two bytes of those of Latin-1.
        lead = data == 0xC3
        second = np.zeros(len(data), bool)
        second[1:] = lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter = _LETTER[data] | second
        letter[:-1] |= second[1:]
        upper = (data >= 65) & (data <= 90) | second & (data <= 0x9E)
        low = data + (32 * upper).astype(np.uint8)
        others = np.append(np.flatnonzero(~letter), len(data))
        stop = np.minimum(others[np.searchsorted(others, bounds[:-1])], bounds[1:])
        strange = np.concatenate([[0], np.cumsum(~_MARK[data])])
        plain = (strange[bounds[1:]] == strange[stop]) & (stop - bounds[:-1] <= LONGEST)
        size = np.diff(bounds)
        inside = np.repeat(plain, size)
        head = np.arange(len(data)) < np.repeat(stop, size)
        words, word = _distinct(low[inside & head], (stop - bounds[:-1])[plain])
        marks, mark = _distinct(data[inside & ~head], (bounds[1:] - stop)[plain])
        ends, letters = _laid_out(words)
        merged = self.merges(letters, ends[1:])
        slow = self.library([m.decode() for m in marks.to_pylist()] + chunks.filter(pa.array(~plain)).to_pylist())
        # A chunk is two pieces: its word and its mark, or itself and nothing.
        every = merged.joined(slow).joined(Ragged(np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)))
        piece = np.full((len(chunks), 2), len(every.start) - 1)
        piece[plain, 0], piece[plain, 1] = word, len(words) + mark
        piece[~plain, 0] = len(words) + len(marks) + np.arange(int((~plain).sum()))
        both = every.take(piece.ravel())
        return Ragged(both.flat, both.start[::2], both.size[::2] + both.size[1::2])


def _laid_out(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of large strings that aren't a slice, and their bytes."""
    bounds = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1) if len(strings) else np.zeros(1, np.int64)
    return bounds, np.frombuffer(strings.buffers()[2], np.uint8, bounds[-1]) if bounds[-1] else np.zeros(0, np.uint8)


def _distinct(data: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings among those that stand in ``data`` one after the other, and the number of each."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """The worker's tokenizer of ``path``."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]
