"""Changes to a set of documents and to its index: add, remove, update by ref, and dense renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index, build, numbered


def applied(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """``docs`` (doc, ref, ...) after ``changes`` (seq, op, ref, ...) in the order of seq.

    add appends a document, even under a ref that is there; remove takes the first document with the ref, if any; update
    replaces the first one in its place, or appends. New documents get numbers beyond the greatest, by seq. Each ref's
    story is independent of the others, so the work is dealt by ref.
    """
    most = docs.agg(F.coalesce(F.max("doc"), F.lit(-1))).first()[0]
    columns = [c for c in docs.columns if c not in ("doc", "ref")]
    touched = changes.select("ref").distinct()
    untouched = docs.join(touched, "ref", "left_anti")
    old = docs.join(touched, "ref", "left_semi").select("ref", F.col("doc").alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("old").alias("op"), *columns)
    new = changes.select("ref", (F.lit(most) + 1 + F.col("seq")).alias("at"), (F.col("seq") + 1).cast("long").alias("seq"), "op", *columns)
    events = old.unionByName(new)

    # Which event fills which place: a fold over the ref's events; the rows themselves stay where they are.
    step = F.struct("seq", "at", "op")
    story = events.groupBy("ref").agg(F.array_sort(F.collect_list(step)).alias("es"))

    def fold(live, e):
        filled = F.struct(e["at"].alias("doc"), e["at"].alias("src"))
        rest = F.slice(live, 2, F.greatest(F.size(live) - 1, F.lit(0)))
        place = F.struct(F.element_at(live, 1)["doc"].alias("doc"), e["at"].alias("src"))
        return (
            F.when(e["op"].isin("old", "add"), F.array_append(live, filled))
            .when(e["op"] == "remove", rest)
            .when((e["op"] == "update") & (F.size(live) > 0), F.concat(F.array(place), rest))
            .otherwise(F.array_append(live, filled))
        )

    live = F.aggregate("es", F.array().cast("array<struct<doc:bigint,src:bigint>>"), fold)
    kept = story.select("ref", F.inline(live)).withColumnRenamed("src", "at")
    return untouched.unionByName(kept.join(events, ["ref", "at"]).select("doc", "ref", *columns))


def compacted(docs: DataFrame) -> DataFrame:
    """``docs`` with dense numbers from 0 in the same order."""
    return numbered(docs.withColumnRenamed("doc", "__old"), ["__old"]).drop("__old").select(*docs.columns)


def updated(index: Index, before: DataFrame, changes: DataFrame) -> tuple[Index, DataFrame]:
    """The index and documents after ``changes``: only changed documents are tokenised; the rows of others are kept."""
    after = applied(before, changes)
    touched = before.select("doc", "ref").join(changes.select("ref").distinct(), "ref", "left_semi").select("doc")
    fresh = build(after.join(changes.select("ref").distinct(), "ref", "left_semi"), index.schema)
    merge = lambda old, new: old.join(touched, "doc", "left_anti").unionByName(new)
    parts = (merge(getattr(index, n), getattr(fresh, n)) for n in ("docs", "lengths", "postings", "filter_values", "filter_years"))
    return Index(index.schema, *parts), after
