"""Character classes of the tokenizer, rendered once for Java's and RE2's regular expressions."""

from __future__ import annotations

import re

# Code point ranges of CJK text (the katakana middle dot U+30FB is left out, it separates) ...
CJK_RANGES = (
    (0x1100, 0x11FF),  # hangul jamo
    (0x3005, 0x3005),  # iteration mark
    (0x3007, 0x3007),  # ideographic zero
    (0x3040, 0x309F),  # hiragana
    (0x30A0, 0x30FA),  # katakana up to the middle dot
    (0x30FC, 0x30FF),  # katakana after it
    (0x3130, 0x318F),  # hangul compatibility jamo
    (0x3400, 0x4DBF),  # ideographs, extension A
    (0x4E00, 0x9FFF),  # ideographs
    (0xA960, 0xA97F),  # hangul jamo extended A
    (0xAC00, 0xD7AF),  # hangul syllables
    (0xD7B0, 0xD7FF),  # hangul jamo extended B
    (0xF900, 0xFAFF),  # compatibility ideographs
    (0x20000, 0x2FA1F),  # ideographs, extensions B and on
)
# ... and of separators: white space by code point, punctuation by character.
SPACE_RANGES = ((0x09, 0x0D), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
PUNCTUATION = "、。，．・：；！？「」『』（）()［］[]【】〈〉《》〔〕｛｝{}\"'`,.:;!?/\\|-‐―－~〜=+*&%$#@^<>"

SEPARATOR_RANGES = tuple(sorted({*SPACE_RANGES, *((ord(c), ord(c)) for c in PUNCTUATION)}))


def body(ranges) -> str:
    """The inside of a character class, by code point, in the notation that Java and RE2 share."""
    one = lambda c: f"\\x{{{c:x}}}"
    return "".join(one(a) if a == b else f"{one(a)}-{one(b)}" for a, b in ranges)


SEP, CJK = body(SEPARATOR_RANGES), body(CJK_RANGES)
#: Runs of separators, of CJK characters, of others; together they cover any text.
RUN = f"[{SEP}]+|[{CJK}]+|[^{SEP}{CJK}]+"
HAS_CJK = f"[{CJK}]"
HAS_SEP = f"[{SEP}]"

_py = lambda ranges: "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)
PY_CJK = re.compile(f"[{_py(CJK_RANGES)}]")
PY_SEP = re.compile(f"[{_py(SEPARATOR_RANGES)}]")
PY_RUN = re.compile(f"(?P<sep>[{_py(SEPARATOR_RANGES)}]+)|(?P<cjk>[{_py(CJK_RANGES)}]+)|(?P<other>[^{_py(SEPARATOR_RANGES)}{_py(CJK_RANGES)}]+)")


def is_latin(token: str) -> bool:
    """Whether a token has no CJK character."""
    return PY_CJK.search(token) is None
