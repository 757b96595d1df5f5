"""Snapshots: an index as Parquet in a versioned folder, published by renaming a pointer file, in any store.

Postings are stored as they are made, in segments: those of a stretch of text in the order of their tokens, without a shuffle.
Pages are small, so that a search, whose scan names its tokens, reads of each segment the pages that hold them, and a frequent
token is many tasks'. The vocabulary and the field totals are stored beside them. One writer at
a time holds a lock; readers keep their snapshot until they look at the pointer again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.normalize import Normalizer
from ..operators.index import Index, Schema, split_rows
from . import stores

TABLES = ("docs", "lengths", "postings", "filter_values", "filter_years")
#: How postings are written: ascending positions as differences, pages of so many rows.
STORED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.page.row.count.limit": "4000", "parquet.enable.dictionary#positions.list.element": "false"}
#: Seconds after which a lock in a store whose locks nobody frees counts as left behind.
STALE = 3600.0


class LockTimeout(TimeoutError):
    pass


@contextmanager
def locked(root: str, timeout: float = 60.0, poll: float = 0.01, spark: SparkSession | None = None):
    """Holds the folder's lock. On this machine it is the kernel's, so that a holder that died leaves it free; elsewhere it is a
    file that is created once (``spark`` reaches the store), and taken over when it is STALE."""
    end = time.monotonic() + timeout

    def wait() -> None:
        if time.monotonic() > end:
            raise LockTimeout(f"another writer holds {root}") from None
        time.sleep(poll)

    if stores.local(root):
        import fcntl

        path = Path(root.removeprefix("file://").removeprefix("file:"))
        path.mkdir(parents=True, exist_ok=True)
        with open(path / ".lock", "w") as f:
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    wait()
            yield
        return
    lock = f"{root}/.lock"
    while not stores.created(spark, lock, uuid.uuid4().hex):
        if (stores.age(spark, lock) or 0) > STALE:
            stores.remove(spark, lock)
        else:
            wait()
    try:
        yield
    finally:
        stores.remove(spark, lock)


def write(index: Index, documents: DataFrame, root: str, partitions: int | None = None, batch: int | None = None) -> str:
    """Writes a snapshot and publishes it; returns its version. A write that fails publishes nothing. ``batch`` is the number of the
    last batch of a stream that is in it. With ``partitions`` postings are sorted as a whole, into so many files."""
    spark = index.spark
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    to = f"{root}/{version}"
    by = ["token", "doc", "field"]
    rows = index.postings.sortWithinPartitions(*by) if index.rows is None else index.rows
    if partitions:
        rows = rows.repartitionByRange(partitions, *by[:2]).sortWithinPartitions(*by)
    rows.write.options(**STORED).parquet(f"{to}/postings")
    if index.rows is not None:  # lengths and postings in one pass over the documents
        index = replace(index, lengths=split_rows(spark.read.parquet(f"{to}/postings"))[0], rows=None)
    for name in TABLES:
        if name != "postings":
            getattr(index, name).write.parquet(f"{to}/{name}")
    stored = Index(index.schema, *_tables(spark, to))
    stored.vocabulary().sort("token").write.parquet(f"{to}/words")
    stored.stats().coalesce(1).write.parquet(f"{to}/totals")
    documents.write.parquet(f"{to}/documents")
    s = index.schema
    meta = {"version": version, "fields": s.fields, "boosts": s.boosts, "filters": s.filters, "variants": s.normalizer.tables, "variant_digest": s.normalizer.digest, "compatibility": s.normalizer.compatibility, "batch": batch}
    stores.write_text(spark, f"{to}/meta.json", json.dumps(meta, ensure_ascii=False))
    stores.write_text(spark, f"{root}/current", version)
    return version


def _tables(spark: SparkSession, to: str) -> list[DataFrame]:
    """The tables of a snapshot; among postings stand the rows of lengths too."""
    return [split_rows(d)[1] if name == "postings" else d for name in TABLES for d in [spark.read.parquet(f"{to}/{name}")]]


def current(root: str, spark: SparkSession | None = None) -> str | None:
    """The published version."""
    return stores.read_text(spark or SparkSession.active(), f"{root}/current")


def meta(spark: SparkSession, root: str, version: str | None = None) -> dict:
    version = version or current(root, spark)
    text = stores.read_text(spark, f"{root}/{version}/meta.json") if version else None
    if text is None:
        raise FileNotFoundError(f"no snapshot has been published in {root}")
    return json.loads(text)


def load(spark: SparkSession, root: str, normalizer: Normalizer | None = None, version: str | None = None) -> tuple[Index, DataFrame]:
    """(index, documents) of the published snapshot, or of a version."""
    about = meta(spark, root, version)
    to = f"{root}/{about['version']}"
    normalizer = normalizer or Normalizer(about["variants"], compatibility=about["compatibility"])
    normalizer.check(about["variants"], about["variant_digest"])
    schema = Schema(about["fields"], about["boosts"], about["filters"], normalizer)
    tables = (*_tables(spark, to), *(spark.read.parquet(f"{to}/{name}") for name in ("words", "totals")))
    return Index(schema, *tables), spark.read.parquet(f"{to}/documents")


def update(spark: SparkSession, root: str, change: Callable[[Index, DataFrame], tuple[Index, DataFrame]], normalizer: Normalizer | None = None, timeout: float = 60.0, batch: int | None = None) -> str | None:
    """Reads, changes and publishes under the lock; if ``change`` raises, nothing is published. With a ``batch`` number, nothing
    happens (None) if the snapshot has that batch or a later one: the number is published with the data, in one step."""
    with locked(root, timeout, spark=spark):
        had = meta(spark, root).get("batch")
        if batch is not None and had is not None and had >= batch:
            return None
        return write(*change(*load(spark, root, normalizer)), root, batch=had if batch is None else batch)


class Reader:
    """A reader that looks at the pointer every ``interval`` seconds at most, and keeps its snapshot in between."""

    def __init__(self, spark: SparkSession, root: str, interval: float = 1.0, normalizer: Normalizer | None = None):
        self.spark, self.root, self.interval, self.normalizer = spark, root, interval, normalizer
        self.version: str | None = None
        self._looked = float("-inf")

    def index(self) -> Index:
        if time.monotonic() - self._looked >= self.interval:
            self._looked = time.monotonic()
            if (v := current(self.root, self.spark)) != self.version:
                self._index = load(self.spark, self.root, self.normalizer, v)[0]
                self.version = v
        return self._index


def cleaned(root: str, keep: int = 2, spark: SparkSession | None = None) -> list[str]:
    """Removes snapshots older than the ``keep`` latest and what writers that failed have left; returns their names."""
    spark = spark or SparkSession.active()
    now = current(root, spark)
    versions = stores.folders(spark, root)
    whole = [v for v in versions if stores.exists(spark, f"{root}/{v}/meta.json")]
    gone = [v for v in versions if v != now and (v not in whole[-keep:])]
    for v in gone:
        stores.remove(spark, f"{root}/{v}")
    return gone
