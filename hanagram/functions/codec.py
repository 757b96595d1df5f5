"""The compact text form of posting lists in index files.

A list is a row of numbers: the gap to the previous key minus one, how many positions, the first position, the gaps between
positions; a key is document * fields + field. A number's last digit has base 60, those before it base 30; the digits are
the printable ASCII characters from # to } without the backslash, the first 60 for last digits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

DIGITS = "".join(chr(c) for c in range(0x23, 0x7E) if chr(c) != "\\")
LAST, LEAD = 60, 30
_VALUE = {c: i for i, c in enumerate(DIGITS)}


def number(value: int) -> str:
    value, last = divmod(value, LAST)
    out = DIGITS[last]
    while value:
        value, lead = divmod(value, LEAD)
        out = DIGITS[LAST + lead] + out
    return out


def numbers(text: str) -> Iterator[int]:
    held = 0
    for c in text:
        d = _VALUE[c]
        if d < LAST:
            yield held * LAST + d
            held = 0
        else:
            held = held * LEAD + d - LAST


def encode(entries: Iterable[tuple[int, int, list[int]]], fields: int) -> str:
    """(document, field, ascending positions) in ascending order to text."""
    out, before = [], -1
    for doc, field, positions in entries:
        key = doc * fields + field
        out += [number(key - before - 1), number(len(positions))]
        out += [number(b - a) for a, b in zip([0, *positions], positions)]
        before = key
    return "".join(out)


def tail(entries: Iterable[tuple[int, list[int]]]) -> str:
    """The text of (key, positions) in ascending order without the first gap, which depends on what stands before."""
    out, before = [], None
    for at, positions in entries:
        out += [] if before is None else [number(at - before - 1)]
        out.append(number(len(positions)))
        out += [number(b - a) for a, b in zip([0, *positions], positions)]
        before = at
    return "".join(out)


def decoded(text: str, fields: int) -> Iterator[tuple[int, int, list[int]]]:
    """The entries one at a time."""
    it, key = numbers(text), -1
    for gap in it:
        key += gap + 1
        at, positions = 0, []
        for _ in range(next(it)):
            at += next(it)
            positions.append(at)
        yield *divmod(key, fields), positions


def decode(text: str, fields: int) -> list[tuple[int, int, list[int]]]:
    return list(decoded(text, fields))


def decode_flat(flat: list[int]) -> list[tuple[int, int, list[int]]]:
    """The older form: document, field, count, positions and so on in one array."""
    out, i = [], 0
    while i < len(flat):
        doc, field, n = flat[i : i + 3]
        out.append((doc, field, flat[i + 3 : i + 3 + n]))
        i += 3 + n
    return out
