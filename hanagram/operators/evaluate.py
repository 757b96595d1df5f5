"""Retrieval evaluation and derivation of variant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(results: DataFrame, judged: DataFrame) -> DataFrame:
    """(qid, tp, fp, fn, precision, recall) from result rows (qid, doc) and judgements (qid, doc, rel); unjudged is wrong."""
    rel = judged.where("rel > 0").select("qid", "doc").distinct().withColumn("r", F.lit(1))
    got = results.select("qid", "doc").distinct().withColumn("g", F.lit(1))
    both = got.join(rel, ["qid", "doc"], "full").groupBy("qid").agg(F.count(F.expr("CASE WHEN g = 1 AND r = 1 THEN 1 END")).alias("tp"), F.count(F.expr("CASE WHEN g = 1 AND r IS NULL THEN 1 END")).alias("fp"), F.count(F.expr("CASE WHEN g IS NULL THEN 1 END")).alias("fn"))
    share = lambda a, b: F.when(a + b > 0, a / (a + b))
    return both.withColumn("precision", share(F.col("tp"), F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("fn")))


def pooled(docs: DataFrame, spellings: DataFrame, width: int = 15) -> DataFrame:
    """(qid, doc, at, context): every occurrence, overlapping ones too, of a query's spellings in a folded text, with ``width``
    characters on both sides. ``docs`` (doc, folded), ``spellings`` (qid, spelling), few."""
    met = docs.join(F.broadcast(spellings), F.contains("folded", "spelling"))
    n = F.length("folded") - F.length("spelling")
    places = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(F.col("folded"), i + 1, F.length("spelling")) == F.col("spelling"))
    each = met.select("qid", "doc", "folded", "spelling", F.explode(places).alias("at"))
    start = F.greatest(F.col("at") - width, F.lit(0))
    return each.select("qid", "doc", "at", F.substr("folded", start + 1, F.col("at") - start + F.length("spelling") + width).alias("context"))


def derived_pairs(mappings: DataFrame) -> DataFrame:
    """(variant, folded) from (variant, values): the first value, unless the variant is among its own values."""
    return mappings.where((F.size("values") > 0) & ~F.array_contains("values", F.col("variant"))).select("variant", F.get("values", F.lit(0)).alias("folded"))


def one_to_one(pairs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pairs that are one-to-one both ways and whose sides aren't in ``excluded`` (character)."""
    lone = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n")).where("n = 1").select(c)
    out = pairs.join(lone("variant"), "variant", "left_semi").join(lone("folded"), "folded", "left_semi")
    for c in ("variant", "folded"):
        out = out.join(excluded.select(F.col("character").alias(c)), c, "left_anti")
    return out.select("variant", "folded")
