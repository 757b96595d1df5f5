"""Positional tokens: CJK runs as character bigrams, other runs whole, with offsets in the folded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classes import HAS_CJK, HAS_SEP, PY_RUN, RUN
from .normalize import Normalizer

#: Runs whose lengths are summed at a time, so that offsets cost no quadratic copying.
_STRIDE = 16


def runs(folded: Column | str) -> Column:
    """array<string>: the runs of separators, CJK and other characters; together they are the text."""
    return F.regexp_extract_all(folded, F.lit(RUN), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once: a lambda's variable is, an expression that a lambda mentions isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_offsets(folded: Column | str) -> Column:
    """array<struct<run, at>>: each run with its offset."""
    zero = F.lit(0)
    total = lambda part: F.aggregate(part, zero, lambda a, x: a + x)

    def strides(sizes: Column) -> Column:
        last = F.floor((F.size(sizes) - 1) / _STRIDE).cast("int")
        return F.when(F.size(sizes) > 0, F.transform(F.sequence(zero, F.greatest(last, zero)), lambda b: total(F.slice(sizes, b * _STRIDE + 1, _STRIDE)))).otherwise(F.array().cast("array<int>"))

    def placed(x: Column) -> Column:
        stride = lambda i: F.floor(i / _STRIDE).cast("int")
        at = lambda i: F.get(x["starts"], stride(i)) + total(F.slice(x["sizes"], stride(i) * _STRIDE + 1, i % _STRIDE))
        return F.transform(x["rs"], lambda r, i: F.struct(r.alias("run"), at(i).cast("int").alias("at")))

    def started(x: Column) -> Column:
        starts = F.aggregate(strides(x["sizes"]), F.array(zero), lambda a, y: F.array_append(a, F.element_at(a, -1) + y))
        return let(F.struct(x["rs"].alias("rs"), x["sizes"].alias("sizes"), starts.alias("starts")), placed)

    return let(runs(folded), lambda rs: let(F.struct(rs.alias("rs"), F.transform(rs, lambda r: F.length(r)).alias("sizes")), started))


def _pieces(r: Column, unigrams: bool) -> Column:
    """The tokens of one run with offsets."""
    run, at = r["run"], r["at"]
    n = F.length(run)
    upto = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(upto(n - 2), lambda i: F.struct(F.substr(run, i + 1, F.lit(2)).alias("token"), (at + i).alias("pos")))
    singles = F.transform(upto(n - 1), lambda i: F.struct(F.substr(run, i + 1, F.lit(1)).alias("token"), (at + i).alias("pos")))
    whole = F.array(F.struct(run.alias("token"), at.alias("pos")))
    cjk = F.when(n == 1, whole).otherwise(F.concat(pairs, singles) if unigrams else pairs)
    return F.when(run.rlike(HAS_CJK), cjk).otherwise(whole)


def tokens(folded: Column | str, unigrams: bool = True) -> Column:
    """array<struct<token, pos>> of folded text. A CJK run of one character is one token in either case."""
    spoken = F.filter(run_offsets(folded), lambda r: ~F.substring(r["run"], 1, 1).rlike(HAS_SEP))
    return F.flatten(F.transform(spoken, lambda r: _pieces(r, unigrams)))


def phrases(n: Normalizer, query: object, unigrams: bool = False) -> list[list[tuple[str, int]]]:
    """The phrases of a query on the driver: lists of (token, offset), cut at separators."""
    out: list[list[tuple[str, int]]] = []
    current: list[tuple[str, int]] = []
    for m in PY_RUN.finditer(n.text(query)):
        run, at = m[0], m.start()
        if m.lastgroup == "sep":
            if current:
                out.append(current)
            current = []
        elif m.lastgroup == "other":
            current.append((run, at))
        else:
            if len(run) == 1 or unigrams:
                current += [(c, at + i) for i, c in enumerate(run)]
            current += [(run[i : i + 2], at + i) for i in range(len(run) - 1)]
    if current:
        out.append(current)
    return out


def located(folded: str, base: int, unigrams: bool, into: dict[str, list[int]]) -> None:
    """Adds the tokens of one folded value with ascending positions from ``base`` to ``into``."""
    for m in PY_RUN.finditer(folded):
        kind = m.lastgroup
        if kind == "sep":
            continue
        run, at = m[0], base + m.start()
        if kind == "other":
            into.setdefault(run, []).append(at)
            continue
        n = len(run)
        if n == 1 or unigrams:
            for i, c in enumerate(run, at):
                into.setdefault(c, []).append(i)
        for i in range(n - 1):
            into.setdefault(run[i : i + 2], []).append(at + i)
