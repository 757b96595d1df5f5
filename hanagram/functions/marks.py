"""Where a query matches in a text: ranges, highlighting, excerpts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classes import PY_SEP
from .normalize import _KANA, _PY_SELECTORS, ITERATION_MARK, Normalizer, by_slices

_JOINS = re.compile("[ᅠ-ᇿힰ-퟿ㅏ-ㅣㆇ-ㆎﾞﾟ]")


def _joins(c: str) -> bool:
    """Whether a character may compose with the one before it."""
    return unicodedata.category(c)[0] == "M" or bool(_JOINS.match(c))


def escape_html(col: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def _escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")


class _Folds(dict):
    """The folded form of a character that stands by itself, by code point."""

    def __init__(self, n: Normalizer):
        self.n, self.ascii_variants = n, any(k.isascii() for k in n.variants)
        self.plain: dict[str, bool] = {}

    def __missing__(self, code: int) -> str:
        c = chr(code)
        c = unicodedata.normalize("NFKC", c) if self.n.compatibility else c
        out = self[code] = "".join(self.n.variants.get(x, x) for x in _PY_SELECTORS.sub("", c.lower()).translate(_KANA))
        return out

    def simple(self, c: str) -> bool:
        """Whether a character folds to one, whatever stands beside it."""
        if c not in self.plain:
            self.plain[c] = len(self[ord(c)]) == 1 and self[ord(c)] != ITERATION_MARK and not _joins(c)
        return self.plain[c]


_folds = lru_cache(16)(_Folds)


@lru_cache(1024)
def _needles(n: Normalizer, query: str | None) -> list[str]:
    return list(filter(None, PY_SEP.split(n.text(query))))


def _in_place(n: Normalizer, chars: str) -> str | None:
    """The folded text, if each of its characters is one of the text's."""
    folds = _folds(n)
    if chars.isascii() and not folds.ascii_variants:
        return chars.lower()
    return chars.translate(folds) if all(map(folds.simple, set(chars))) else None


def ranges(n: Normalizer, text: str | None, query: str | None) -> list[tuple[int, int]]:
    """[start, end) in code points of ``text`` where a phrase of the query occurs; touching ranges are one."""
    chars = text or ""
    needles = _needles(n, query)
    if (same := _in_place(n, chars)) is not None:
        return _merged([(m.start(), m.end()) for needle in needles for m in re.finditer(re.escape(needle), same)])
    folds = _folds(n)
    folded: list[str] = []
    origin: list[tuple[int, int]] = []
    before = ""

    def fold(part: str, start: int, end: int) -> None:
        nonlocal before
        size = len(folded)
        plain = unicodedata.normalize("NFKC", part) if n.compatibility else part
        for c in _PY_SELECTORS.sub("", plain.lower()).translate(_KANA):
            c = n.variants.get(c, c)
            if c == ITERATION_MARK and before:
                c = before
            before = c
            folded.extend(c)
            origin.extend([(start, end)] * len(c))
        if len(folded) == size and origin:  # a selector belongs to the character before it
            origin[-1] = (origin[-1][0], end)

    i = 0
    while i < len(chars):
        j = i + 1
        if folds.simple(chars[i]) and (j == len(chars) or folds.simple(chars[j])):
            before = folds[ord(chars[i])]
            folded.append(before)
            origin.append((i, j))
            i = j
            continue
        while j < len(chars) and _joins(chars[j]):
            j += 1
        cluster = chars[i:j]
        if "".join(unicodedata.normalize("NFKC", c) for c in cluster) == unicodedata.normalize("NFKC", cluster):
            for k, c in enumerate(cluster):
                fold(c, i + k, i + k + 1)
        else:
            fold(cluster, i, j)
        i = j
    whole = "".join(folded)
    found = []
    for needle in needles:
        at = whole.find(needle)
        while at >= 0:
            found.append((origin[at][0], origin[at + len(needle) - 1][1]))
            at = whole.find(needle, at + len(needle))
    return _merged(found)


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def highlighted(n: Normalizer, text: str | None, query: str | None) -> str:
    text = text or ""
    found = ranges(n, text, query)
    # The text is escaped once, with marks that it lacks, or else piece by piece.
    free = "\ue000" not in text and "\ue001" not in text
    escape, open_, close = (str, "\ue000", "\ue001") if free else (_escape, "<mark>", "</mark>")
    out, at = [], 0
    for a, b in found:
        out += [escape(text[at:a]), open_, escape(text[a:b]), close]
        at = b
    whole = "".join(out) + escape(text[at:])
    return _escape(whole).replace(open_, "<mark>").replace(close, "</mark>") if free else whole


def excerpted(n: Normalizer, text: str | None, query: str | None, length: int = 80) -> str:
    text = text or ""
    if (same := _in_place(n, text)) is not None:
        at = min((p for needle in _needles(n, query) if (p := same.find(needle)) >= 0), default=None)
    else:
        at = min((a for a, _ in ranges(n, text, query)), default=None)
    if at is None:
        return _escape(text[:length]) + "…" if len(text) > length else _escape(text)
    start = max(0, at - length // 3)
    stop = min(len(text), start + length)
    return "…" * (start > 0) + highlighted(n, text[start:stop], query) + "…" * (stop < len(text))


def match_ranges(n: Normalizer, text: Column, query: Column) -> Column:
    return by_slices(lambda t, q: [{"start": a, "end": b} for a, b in ranges(n, t, q)], "array<struct<start:int,end:int>>", text, query)


def highlight(n: Normalizer, text: Column, query: Column) -> Column:
    return by_slices(lambda t, q: highlighted(n, t, q), "string", text, query)


def excerpt(n: Normalizer, text: Column, query: Column, length: int = 80) -> Column:
    return by_slices(lambda t, q: excerpted(n, t, q, length), "string", text, query)
