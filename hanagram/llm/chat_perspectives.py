"""Multi-party perspective rotation: a dialogue rendered once for every participant.

In a participant's rendering their turns are the assistant's, system turns stay the system's, and all others are users by
name. The mask holds the spans to train on: the bodies of the participant's turns with their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: Marks of the format.
START, END = "<|im_start|>", "<|im_end|>\n"
#: A rendering comes in parts of so many turns, which bounds a row.
STRETCH = 512


def perspectives(turns: DataFrame, stretch: int = STRETCH, system: str = "system") -> DataFrame:
    """Rows (conv_id, part, speaker, text, mask, n_chars, n_masked, start) from (conv_id, turn, role, text): the whole dialogue for
    each of its speakers but the system, in parts of ``stretch`` turns.

    The parts of a speaker joined in order are the rendering, whether or not the speaker is silent in some; ``start`` is where a
    part begins in it, in code points. ``mask`` lists start:end in code points of the part's ``text``, end exclusive, joined
    by commas. Turns are ordered by turn, then role, then text, nulls first, whatever their numbers are; ties and repeated
    rows stay. A null text is an empty turn; a null role is a user without a name and no speaker; a row with a null conv_id
    is a dialogue of its own, also beside an equal row. Opening marks within texts are escaped by a backslash. Dialogues
    without a speaker, and empty tables, give no rows.

    Turns are dealt by ranges of dialogue and order, and numbered on from the ranges before, so that a long dialogue is many
    tasks' work.
    """
    key = ["dialogue", "own"]
    n = F.monotonically_increasing_id()
    own = F.when(F.col("conv_id").isNull(), n + 1).otherwise(0)
    body = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("<\\|"))
    rows = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("dialogue"), own.alias("own"), F.struct("turn", F.col("role").alias("role"), body.alias("body"), n.alias("n")).alias("t"))
    rows = written(rows.repartitionByRange(shuffle_partitions(turns.sparkSession), *key, "t").withColumn("range", F.spark_partition_id()), "chat-turns")
    sizes = rows.groupBy(*key, "range").agg(F.count("*").alias("size"))
    before = sizes.select(*key, "range", (F.sum("size").over(Window.partitionBy(*key).orderBy("range")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy(*key, "range").orderBy("t")) - 1
    placed = rows.withColumn("place", place).join(before, [*key, "range"]).withColumn("part", F.floor((F.col("before") + F.col("place")) / stretch))
    whole = placed.groupBy(*key, "part").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list("t")).alias("ts"))
    speakers = rows.select(*key, F.col("t.role").alias("speaker")).where(F.col("speaker").isNotNull() & (F.lower("speaker") != system)).distinct()
    out = _rendered(whole.join(speakers, key), system)
    # Where parts begin: only dialogues of several parts have to be put in order for that.
    if sizes.groupBy(*key).agg(F.sum("size").alias("size")).where(F.col("size") > stretch).limit(1).count():
        each = Window.partitionBy(*key, "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn("start", F.sum("n_chars").over(each) - F.col("n_chars"))
    else:
        out = out.withColumn("start", F.lit(0).cast("long"))
    return out.drop(*key)


def _rendered(each: DataFrame, system: str) -> DataFrame:
    """The rows of ``each`` (conv_id, part, speaker, ts), rendered for their speaker."""

    def head(t: Column) -> Column:
        name = F.when(t["role"] == F.col("speaker"), "assistant").when(F.lower(t["role"]) == system, "system").when(t["role"].isNull(), "user").otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(START), name, F.lit("\n"))

    pieces = F.transform("ts", lambda t: F.struct(head(t).alias("head"), F.concat(t["body"], F.lit(END)).alias("body"), F.coalesce(t["role"] == F.col("speaker"), F.lit(False)).alias("mine")))
    each = each.withColumn("ps", pieces)
    spans = F.aggregate(
        "ps",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("m")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            (a["n"] + F.when(p["mine"], F.length(p["body"])).otherwise(0)).alias("n"),
            F.when(p["mine"], F.array_append(a["m"], F.concat((a["at"] + F.length(p["head"])).cast("string"), F.lit(":"), (a["at"] + F.length(p["head"]) + F.length(p["body"])).cast("string")))).otherwise(a["m"]).alias("m"),
        ),
    )
    return each.withColumn("s", spans).select("dialogue", "own", "conv_id", F.col("part").cast("long").alias("part"), "speaker", F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), F.array_join("s.m", ",").alias("mask"), F.col("s.at").alias("n_chars"), F.col("s.n").alias("n_masked"))


ORACLE_SQL = r"""
WITH a AS (SELECT conv_id, turn, role, replace(text, '<|', '<\|') AS body FROM conversations),
b AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, body) - 1) // 512 AS part FROM a),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM b WHERE lower(role) <> 'system'),
m AS (SELECT b.conv_id, b.part, speaker, turn, role, body AS raw, role = speaker AS mine,
        '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN lower(role) = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
        body || '<|im_end|>' || chr(10) AS body
      FROM b JOIN s ON b.conv_id = s.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY turn, role, raw ROWS UNBOUNDED PRECEDING) AS stop FROM m),
p AS (SELECT conv_id, CAST(part AS BIGINT) AS part, speaker, string_agg(head || body, '' ORDER BY turn, role, raw) AS text,
  string_agg(CASE WHEN mine THEN CAST(CAST(stop - length(body) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn, role, raw) AS mask,
  CAST(sum(length(head) + length(body)) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN mine THEN length(body) ELSE 0 END) AS BIGINT) AS n_masked
FROM o GROUP BY conv_id, part, speaker)
SELECT conv_id, part, speaker, text, coalesce(mask, '') AS mask, n_chars, n_masked,
  CAST(sum(n_chars) OVER (PARTITION BY conv_id, speaker ORDER BY part ROWS UNBOUNDED PRECEDING) - n_chars AS BIGINT) AS start
FROM p
"""
