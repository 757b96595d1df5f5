"""What the operators share: the shared folder, written tables, id filters of checked size, connected components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that a broadcast may hold at most (8 bytes each, 16 MB as a hash table of longs).
BROADCAST_IDS = 1_000_000
#: Bytes of a row group of a written table, which a writing task holds in memory.
ROW_GROUP = 16 << 20
#: Edges that one task joins at most.
ONE_TASK_EDGES = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see (spark.checkpoint.dir). Only a session within one machine's process (master local) may go
    without: it gets one in the temp folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "hanagram")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What bounds a batch for Python while an operator writes its own tables, where the session has Spark's usual values: texts may be long.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


@contextmanager
def small_batches(spark: SparkSession):
    """Smaller batches for what runs within; afterwards the session is as it was."""
    usual = {k: spark.conf.get(k, None) for k in _BATCH}
    changed = [k for k, (old, _) in _BATCH.items() if usual[k] == old]
    for k in changed:
        spark.conf.set(k, _BATCH[k][1])
    try:
        yield
    finally:
        for k in changed:
            spark.conf.set(k, usual[k])


def tidied(run: Callable, *forget: Callable) -> Callable:
    """A function for mapInArrow that, when a task ends, calls ``forget`` (functions that empty a module's caches) and gives freed
    memory back: the worker stays for other stages, beside the executor's own memory."""

    def tidy(it):
        try:
            yield from run(it)
        finally:
            released(*forget)

    return tidy


def released(*forget: Callable) -> None:
    for f in forget:
        f()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def near(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A written table of short rows for a join: to be broadcast if it has ``most`` rows at most, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dropped(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read again. Only those in the shared folder are."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if folder.startswith(shared_dir(spark).replace("file:///", "file:/")) or folder.startswith(shared_dir(spark)):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def restricted(docs: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is (left_semi) or isn't (left_anti) in ``ids``, an already written table of distinct ids.

    Up to BROADCAST_IDS ids are broadcast, so that texts stay where they are; beyond, both sides are shuffled.
    """
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, key, how)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _joined_in_one(edges: DataFrame) -> DataFrame:
    """Components of at most ONE_TASK_EDGES edges, by union-find in one task."""

    def run(it):
        up: dict = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        types = None
        for batch in it:
            types = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        if up:
            nodes = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, types), pa.array([root(x) for x in nodes], types)], ["node", "root"])

    kind = edges.schema["lo"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the least node reachable.

    Up to ONE_TASK_EDGES distinct edges (16 MB) are joined in one task. Beyond, each round moves both ends of every edge to
    their least neighbours' least neighbours; each round is written to the shared folder, and the number of rounds grows
    with the logarithm of the longest path. Groups are aggregated by min, so that a hub's edges never meet in one task.
    """
    cur = written(edges.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), name)
    if cur.limit(ONE_TASK_EDGES + 1).count() <= ONE_TASK_EDGES:
        out = written(_joined_in_one(cur), name)
        dropped(cur)
        return out
    before = None
    while True:
        # Each node's least neighbour, itself included.
        both = cur.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionByName(cur.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        least = written(both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("p")), name)
        # Each end moves to its least neighbour's own least neighbour where that is known.
        up = written(least.alias("x").join(least.select(F.col("n").alias("p"), F.col("p").alias("q")), "p", "left").select("n", F.least("p", F.coalesce("q", "p")).alias("p")), name)
        moved = cur.join(up.select(F.col("n").alias("lo"), F.col("p").alias("lp")), "lo").join(up.select(F.col("n").alias("hi"), F.col("p").alias("hp")), "hi")
        nxt = moved.select(F.least("lp", "hp").alias("lo"), F.greatest("lp", "hp").alias("hi")).unionByName(up.select(F.col("p").alias("lo"), F.col("n").alias("hi"))).where("lo != hi").distinct()
        nxt = written(nxt, name)
        dropped(cur, least, up)
        n, s = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        cur = nxt
        if (n, s) == before:  # every edge leads from a node to its root
            break
        before = (n, s)
    return cur.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root").unionByName(cur.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
