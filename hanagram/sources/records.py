"""Records as DataFrames: CSV, JSON, JSON Lines, in memory, front-matter files, a collection's metadata."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import squash
from ..operators.index import numbered

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl"}


class RecordError(ValueError):
    pass


def format_of(path: str) -> str | None:
    path = path.lower().removesuffix(".gz")
    return next((f for end, f in FORMATS.items() if path.endswith(end)), None)


def read(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """Records of a file or folder by its format, or by its extension; all CSV cells are strings, empty ones null.

    JSON has to be an array of objects, JSON Lines an object in each line; blank lines are skipped, anything else is an
    error when the rows are read.
    """
    format = format or format_of(path) or "jsonl"
    if format == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    if format == "json":
        return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    if format == "jsonl":
        return spark.read.option("mode", "FAILFAST").json(path)
    raise RecordError(f"unknown format {format!r}: csv, json or jsonl")


def from_text(spark: SparkSession, text: str, format: str | None = None) -> DataFrame:
    """Records of a text, as from standard input: a byte order mark is dropped; an array is JSON, anything else JSON Lines."""
    text = text.removeprefix("﻿")
    format = format or ("json" if text.lstrip().startswith("[") else "jsonl")
    if format == "csv":
        import csv
        import io

        rows = [{k: v for k, v in r.items() if k is not None} for r in csv.DictReader(io.StringIO(text))]
    elif format == "json":
        rows = json.loads(text)
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise RecordError("the JSON must be an array of objects")
    else:
        rows = []
        for n, line in enumerate((x for x in text.splitlines() if x.strip()), 1):
            rows.append(json.loads(line))
            if not isinstance(rows[-1], dict):
                raise RecordError(f"line {n} is not a JSON object")
    return from_rows(spark, rows)


def from_rows(spark: SparkSession, rows: Iterable[dict] | Callable[[], Iterable[dict]] | DataFrame) -> DataFrame:
    """Records in memory, or what a callable returns; the columns are the first record's keys, then later ones."""
    if callable(rows) and not isinstance(rows, DataFrame):
        rows = rows()
    if isinstance(rows, DataFrame):
        return rows
    rows = list(rows)
    if not rows:
        raise RecordError("no records")
    names = list(dict.fromkeys(k for r in rows for k in r))

    def kind(name: str) -> str:
        seen = {type(r[name]) for r in rows if r.get(name) is not None}
        if list in seen or tuple in seen:
            return "array<string>"
        return {frozenset({int}): "long", frozenset({float}): "double", frozenset({int, float}): "double"}.get(frozenset(seen), "string")

    kinds = {n: kind(n) for n in names}

    def cell(v, k):
        if v is None:
            return None
        if k.startswith("array"):
            return [str(x) for x in (v if isinstance(v, (list, tuple)) else [v])]
        return str(v) if k == "string" else v

    return spark.createDataFrame([tuple(cell(r.get(n), kinds[n]) for n in names) for r in rows], ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def documents(records: DataFrame, ref: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Records with ``doc`` numbers and their ``ref``, rows without a ref left out. Without ``order`` rows are numbered as read."""
    if not records.columns:
        raise RecordError("no records")
    ref = ref or records.columns[0]
    if ref not in records.columns:
        raise RecordError(f"no field {ref!r} in the records (fields: {', '.join(records.columns)})")
    kept = records.withColumn("ref", F.col(f"`{ref}`").cast("string")).where("ref is not null and ref != ''")
    if order:
        return numbered(kept, order)
    return numbered(kept.withColumn("__read", F.monotonically_increasing_id()), ["__read"]).drop("__read")


def front_matter(spark: SparkSession, path: str, skip: str = "_index.md") -> DataFrame:
    """(path, matter map<string,string>, content) of the files under ``path``: simple ``key: value`` lines between --- lines."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name()).where(~F.endswith("path", F.lit(skip)))
    cut = "^---\\s*\\n([\\s\\S]*?)\\n---\\s*\\n?"
    lines = F.filter(F.split(F.regexp_extract("value", cut, 1), "\\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), "^[\"']|[\"']$", "").alias("v")))
    return files.select("path", F.map_from_entries(pairs).alias("matter"), F.regexp_replace("value", cut, "").alias("content"))


def collection(metadata: DataFrame, config: DataFrame, page: str = "items/{}.html", children: bool = False, facets: str = "") -> tuple[DataFrame, list[str], dict, dict]:
    """A collection's metadata as (documents, fields, boosts, filters).

    Rows without objectid go, child rows too unless ``children``; fields are those that ``config`` (field, index) marks true,
    the first with boost 3; white space is squashed; facet fields, listed in ``facets`` by commas, hold values cut at ``;``;
    date is a year filter. A child's ref is its parent's page with its id as anchor.
    """
    fields = [r["field"] for r in config.where(F.lower(F.col("index").cast("string")) == "true").select("field").collect() if r["field"] in metadata.columns]
    rows = metadata.where("objectid is not null and trim(objectid) != ''")
    parent = F.col("parentid") if "parentid" in metadata.columns else F.lit(None).cast("string")
    is_child = parent.isNotNull() & (F.trim(parent) != "")
    if not children:
        rows = rows.where(~is_child)
    head, tail = page.split("{}")
    ref = F.when(is_child, F.concat(F.lit(head), parent, F.lit(f"{tail}#"), F.col("objectid"))).otherwise(F.concat(F.lit(head), F.col("objectid"), F.lit(tail)))
    for c, kind in rows.dtypes:
        if kind == "string":
            rows = rows.withColumn(c, squash(c))
    filters: dict = {f.strip(): {"kind": "value", "separator": ";"} for f in facets.split(",") if f.strip() in metadata.columns}
    if "date" in metadata.columns and rows.where(F.col("date").rlike("(?<![0-9])[0-9]{4}(?![0-9])")).limit(1).count():
        filters["date"] = {"kind": "year"}
    return rows.withColumn("ref", ref), fields, {fields[0]: 3} if fields else {}, filters


