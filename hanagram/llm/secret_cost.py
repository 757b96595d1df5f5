"""Secrets by pattern, and values in a credential's place by what guessing them would cost.

A value's cost (log10 of guesses) is the least sum over all of its segmentations into common words, dates, repeats, keyboard
walks and brute-force spans, found by dynamic programming over its positions. Words are ranked by how common they are.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as long as possible, so the same as runs of 24 and more
KINDS = ("assign", "access", "hex", "guess")
#: Other places where a credential's value stands: a name, an optional quote, a sign, the value to its closing quote on the
#: line, or else to the next blank or quote; and the password in an address. Neither goes back over what it has passed.
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret)["']?(?:[ \t]*+(?:=>|:=|[:=])[ \t]*+(?:bearer[ \t]++|basic[ \t]++)?|[ \t]++is[ \t]*+:?[ \t]*+)(?:"([^"\n]{6,})"|'([^'\n]{6,})'|["']?([^\s"'<>,;]{6,}))""", re.I | re.A)
ADDRESS = re.compile(r"(?<=[a-z0-9+.-])://[^\s/:@]++:([^\s/@]{6,}+)@", re.I | re.A)
CONTEXT_HINT = re.compile(r"[=:]|\bis\b", re.I)
#: Common parts of passwords, the most common first: fixed values. The ranked words of the file follow them.
WORDS = "password 123456 qwerty admin welcome letmein monkey dragon login master hello shadow sunshine princess football baseball secret trust summer winter spring autumn test user guest root love access super batman jordan hunter ranger buster soccer hockey killer george charlie michael andrew thomas daniel jessica ashley computer internet server default changeme example sample database backup system service token temp demo public private key pass word your here none null true false".split()
#: Rows of keyboards and the columns from the left.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qwertzuiop", "azertyuiop", "1qaz2wsx3edc4rfv5tgb6yhn7ujm")
_leet = str.maketrans("@4310$57!", "aaeiossti")
_next = {a + b for w in WALKS for a, b in zip(w, w[1:])}
_steps = _next | {p[::-1] for p in _next}
_date = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d)")
#: Sizes of dates and the log10 of how many there are.
_DATES = ((10, math.log10(365 * 200)), (8, math.log10(365 * 200)), (4, math.log10(200)))
#: log10 of guesses: for where a span ends, for capitals or letters written as other signs in a word, for a walk and each of its
#: characters, for each character that a repeat goes on. A word has SHORTEST to LONGEST characters, a walk or run of one
#: character three or more, a repeat of several characters three rounds.
SPAN, FORM, WALK, STEP, AGAIN = 0.3, 0.3, math.log10(20 * len(WALKS)), 0.05, 0.01
SHORTEST, LONGEST, UNITS = 3, 14, 4


@lru_cache(maxsize=1)
def ranks() -> dict[str, float]:
    """log10 of the rank of each word: WORDS, then the words of SHORTEST to LONGEST letters that a public tokenizer has whole with a
    blank before them, some 19,000; it numbers its tokens by how often their pairs occur."""
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    found = [t[1:].decode().lower() for _, t in tokens if re.fullmatch(rb" [A-Za-z]{%d,%d}" % (SHORTEST, LONGEST), t)]
    return {w: math.log10(i + 1) for i, w in enumerate(dict.fromkeys(WORDS + found))}


def _charset(value: str) -> int:
    """How many characters a brute-force search goes through at each place."""
    n = 10 * bool(re.search(r"[0-9]", value))
    letters = set(re.findall(r"[a-z]", value.lower()))
    n += (6 if letters <= set("abcdef") and re.search("[0-9]", value) else 26) * bool(letters) * (1 + (value != value.lower() and value != value.upper()))
    return max(2, n + 33 * bool(re.search(r"[^A-Za-z0-9]", value)) + 100 * (not value.isascii()))


def word_cost(part: str) -> float | None:
    """log10 of guesses of a word in any case, or with signs for letters; None if it isn't one."""
    known = ranks()
    low = part.lower()
    cost = known.get(low)
    if cost is None:
        cost = known.get(low.translate(_leet))
        if cost is None:
            return None
        cost += FORM
    return cost + (FORM if part != low else 0.0)


def segments(value: str) -> tuple[float, tuple[tuple[str, int, int], ...]]:
    """log10 of the guesses for ``value``, and its cheapest segmentation as (kind, start, end).

    The dynamic program goes over the value once. What ends at a place is the cheapest of: a brute-force span, a word, a date, a
    walk, or a repeat. Spans of any length cost a fixed amount for each further character, so that the cheapest one that
    ends here is the cheapest one that ended before and goes on, or one of the least size: linear time, and no
    segmentation is left out.
    """
    return _short_segments(value) if len(value) <= 200 else _segments(value)


def _segments(value: str) -> tuple[float, tuple[tuple[str, int, int], ...]]:
    n = len(value)
    low = value.lower() if value.isascii() else "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    per_char = math.log10(_charset(value))
    best = [0.0] + [math.inf] * n
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    brute, walk = (math.inf, 0), (math.inf, 0)  # the cheapest span that ends here and where it begins
    repeat = [(math.inf, 0)] * (UNITS + 1)
    alike = [0] * (UNITS + 1)  # how many characters up to here equal those a unit before
    steps = letters = digits = 0  # how many walk steps, word characters and digits or date signs end here
    for end in range(1, n + 1):
        c = low[end - 1]
        brute = min((brute[0], brute[1]), (best[end - 1] + SPAN, end - 1))
        brute = (brute[0] + per_char, brute[1])
        found = [(brute[0], "brute", brute[1])]
        letters = letters + 1 if c.isascii() and (c.isalnum() or c in "@$!") else 0
        for size in range(SHORTEST, min(LONGEST, letters) + 1):
            cost = word_cost(value[end - size : end])
            if cost is not None:
                found.append((best[end - size] + cost + SPAN, "word", end - size))
        digits = digits + 1 if c in "0123456789-/._" else 0
        for size, cost in _DATES:
            if digits >= size and _date.fullmatch(value, end - size, end):
                found.append((best[end - size] + cost + SPAN, "date", end - size))
        steps = steps + 1 if end >= 2 and low[end - 2 : end] in _steps else 0
        walk = (walk[0] + STEP, walk[1]) if steps else (math.inf, 0)
        if steps >= 2:
            walk = min(walk, (best[end - 3] + WALK + 3 * STEP + SPAN, end - 3))
            found.append((walk[0], "walk", walk[1]))
        for unit in range(1, UNITS + 1):
            alike[unit] = alike[unit] + 1 if end > unit and value[end - 1] == value[end - 1 - unit] else 0
            going = (repeat[unit][0] + AGAIN, repeat[unit][1]) if alike[unit] else (math.inf, 0)
            if alike[unit] >= 2 * unit:
                going = min(going, (best[end - 3 * unit] + per_char * unit + 2 * unit * AGAIN + SPAN, end - 3 * unit))
            repeat[unit] = going
            if going[0] < math.inf:
                found.append((going[0], "repeat", going[1]))
        best[end], kind, at = min(found)
        back[end] = (kind, at)
    spans, end = [], n
    while end:
        kind, at = back[end]
        spans.append((kind, at, end))
        end = at
    return best[n], tuple(spans[::-1])


_short_segments = lru_cache(maxsize=2_000)(_segments)


def cost(value: str) -> float:
    return segments(value)[0]


def find(text: str, least: float = 10.0) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text as (start, kind's number, end), each in order."""
    base, values = [], []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            base.append((m.start(), 0, m.end()))
            values.append(m.span(2))
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    if CONTEXT_HINT.search(text):
        values += [m.span(m.lastindex) for pattern in (CONTEXT, ADDRESS) for m in pattern.finditer(text)]
    # A value found in several ways is all that these cover.
    whole: list[tuple[int, int]] = []
    for at, end in sorted(values):
        if whole and at < whole[-1][1]:
            whole[-1] = (whole[-1][0], max(whole[-1][1], end))
        else:
            whole.append((at, end))
    more = [(at, 3, end) for at, end in whole if cost(text[at:end]) >= least]
    return base, sorted(base + more)


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 10.0) -> DataFrame:
    """For each row: ``id_col``, n_assign, n_access, n_hex, base_sha256, spans, and values (array of start, end, cost log10,
    segmentation) for the guess spans. ``least`` is the log10 of guesses from which a value counts as a secret.

    A null text counts as empty (no spans); repeated rows are scanned each; other columns are not read.
    """
    value = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64()), ("parts", pa.string())])

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                base, every = find(t or "", least)
                for k in range(3):
                    cols[k].append(sum(x[1] == k for x in base))
                cols[3].append(hashlib.sha256(shown(base).encode()).hexdigest())
                cols[4].append(shown(every))
                cols[5].append([{"start": a, "end": e, "log10_guesses": round(segments(t[a:e])[0], 6), "parts": ",".join(f"{k}:{x}:{y}" for k, x, y in segments(t[a:e])[1])} for a, k_, e in every if k_ == 3])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(value))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "values"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, values array<struct<start:long,end:long,log10_guesses:double,parts:string>>")
    return out.withColumnRenamed("id", id_col)


def redact_text(text: str, least: float = 10.0, mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for a, _, b in find(text, least)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", least: float = 10.0, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of ``text_col`` replaced by ``mark``; all columns and rows stay, null stays null."""

    @F.pandas_udf("string")
    def clean(s):
        return s.map(lambda t: redact_text(t, least, mark), na_action="ignore")

    return docs.withColumn(text_col, clean(F.col(text_col)))
