"""Choice of the physical plan of a search: a scan of folded texts, or the index."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import PY_CJK, PY_SEP
from ..functions.normalize import Normalizer


def scannable(n: Normalizer, query: str) -> bool:
    """Whether the query is one phrase of CJK characters alone, two or more: then a phrase match is a substring match."""
    parts = [p for p in PY_SEP.split(n.text(query)) if p]
    return len(parts) == 1 and all(PY_CJK.match(c) for c in parts[0])


def scan(folded: DataFrame, n: Normalizer, query: str) -> DataFrame:
    """(doc, tf) of texts (doc, folded) that hold the phrase; overlapping occurrences count. No index, no shuffle."""
    if not scannable(n, query):
        raise ValueError("only a single phrase of CJK characters can be scanned for")
    needle = next(p for p in PY_SEP.split(n.text(query)) if p)
    times = F.regexp_count("folded", F.lit(f"(?={re.escape(needle)})")).cast("long")
    return folded.where(F.contains("folded", F.lit(needle))).select("doc", times.alias("tf"))


def chosen(n: Normalizer, query: str, has_index: bool) -> str:
    """index where postings are stored or the query needs words, otherwise scan."""
    return "index" if has_index or not scannable(n, query) else "scan"
