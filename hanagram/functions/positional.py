"""Tokens of many texts at once, by arrays of code points: what ``tokens.located`` does for one text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .classes import CJK_RANGES, SEPARATOR_RANGES

#: Characters of texts that are worked on together.
STRETCH = 2_000_000
_OTHER, _SEP, _CJK = 0, 1, 2
_BITS = 21  # of a code point

_kinds = np.zeros(0x110000, np.uint8)
for _kind, _ranges in ((_SEP, SEPARATOR_RANGES), (_CJK, CJK_RANGES)):
    for _a, _b in _ranges:
        _kinds[_a : _b + 1] = _kind


def stretches(sizes: list[int]):
    """Bounds of runs of texts of about STRETCH characters."""
    at = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= STRETCH:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def occurrences(folded: list[str], unigrams: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens, token number, text number, position) of every token of folded texts; those of one token and text are in
    ascending order of position."""
    code = np.frombuffer((" ".join(folded) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, folded), np.int64, len(folded)) + 1
    start = np.cumsum(size) - size
    kind = _kinds[code]
    cjk, other = kind == _CJK, kind == _OTHER
    pair = cjk[:-1] & cjk[1:]
    if unigrams:
        single = cjk
    else:
        single = cjk.copy()
        single[:-1] &= ~pair
        single[1:] &= ~pair
    one, two = np.flatnonzero(single), np.flatnonzero(pair)
    names, number = np.unique(np.concatenate([code[one], code[two] << _BITS | code[two + 1]]), return_inverse=True)
    grams = [chr(k) if k < 1 << _BITS else chr(k >> _BITS) + chr(k & (1 << _BITS) - 1) for k in names.tolist()]
    # Other runs are whole tokens: their characters, one run after the other, as UTF-8.
    first = other.copy()
    first[1:] &= ~other[:-1]
    run = np.flatnonzero(first)
    c = code[other]
    bounds = np.concatenate([[0], np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))])
    cuts = bounds[np.append(np.searchsorted(np.flatnonzero(other), run), len(c))].astype(np.int64)
    data = c.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    words = pa.Array.from_buffers(pa.large_string(), len(run), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    tokens = pa.concat_arrays([pa.array(grams, pa.large_string()), words.dictionary])
    at = np.concatenate([one, two, run])
    text = np.searchsorted(start, at, side="right") - 1
    return tokens, np.concatenate([number, len(grams) + words.indices.to_numpy()]), text, at - start[text]


def runs(folded: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct runs, how often each occurs, the sum of its offsets) of folded texts, runs of separators among them."""
    data = "".join(folded).encode("utf-8", "replace")
    code = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, folded), np.int64, len(folded))
    start = (np.cumsum(size) - size)[size > 0]
    kind = _kinds[code]
    first = np.ones(len(code), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[start] = True
    run = np.flatnonzero(first)
    width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    cuts = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[np.append(run, len(code))]
    names = pa.Array.from_buffers(pa.large_string(), len(run), [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    number = names.indices.to_numpy()
    at = run - start[np.searchsorted(start, run, side="right") - 1]
    n = len(names.dictionary)
    return names.dictionary, np.bincount(number, minlength=n), np.bincount(number, at, n).astype(np.int64)


def grouped(token: np.ndarray, row: np.ndarray, position: np.ndarray, tokens: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, bounds, positions): occurrences by token and row, positions in ascending order between ``bounds``. Tokens are in the
    order of their code points, if ``tokens`` names them, or else of their numbers."""
    rank = np.arange(int(token.max(initial=0)) + 1)
    if tokens is not None:
        rank = np.empty(len(tokens), np.int64)
        rank[pc.array_sort_indices(tokens).to_numpy()] = np.arange(len(tokens))
    least = int(row.min(initial=row[0] if len(row) else 0))
    key = rank[token] * (int(row.max(initial=least)) - least + 1) + row - least
    by = np.argsort(key, kind="stable")
    key = key[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return row[by[first]], token[by[first]], np.append(first, len(key)), position[by]
