"""Phrase search with BM25 ranking, for many queries in one job.

A query is cut at separators into phrases, all of which must occur, each as adjacent tokens in order. The number of documents
of the nth phrase counts those that hold phrases 1 to n; filters never change scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import is_latin
from ..functions.normalize import filter_key_text
from ..functions.tokens import let, phrases
from .index import Index

K1, B, EXPANDED = 1.2, 0.75, 0.6
#: Words from this length on match with one edit.
TYPO_LENGTH = 5
#: Alternatives that the driver takes (a row of some 60 bytes each), and tokens that are named in a filter on postings. Beyond
#: the first, alternatives stay a table and postings meet them by whatever join the planner picks.
LOCAL_ALTERNATIVES, NAMED_TOKENS = 20_000, 5_000
#: Scores that differ by less than 1 / BANDS are ranked in one task, and so are so many documents (a power of two) of score 0.
BANDS, BAND_DOCS = 1000, 20


def parsed(index: Index, queries: Iterable[tuple[int, str]]) -> list[tuple]:
    """(qid, phrase, part, offset, token, latin, last, n_parts, n_phrases) of each query part."""
    rows = []
    for qid, text in queries:
        found = phrases(index.schema.normalizer, text)
        for p, phrase in enumerate(found):
            for i, (token, at) in enumerate(phrase):
                rows.append((qid, p, i, at, token, is_latin(token), p == len(found) - 1 and i == len(phrase) - 1, len(phrase), len(found)))
    return rows


_PARTS = "qid long, phrase int, part int, at int, token string, latin boolean, last boolean, n_parts int, n_phrases int"


def alternatives(index: Index, rows: list[tuple], prefix: bool = True, typos: bool = True) -> DataFrame:
    """(qid, phrase, part, at, n_parts, token, alt, expanded): the tokens that stand for each query part (as ``parsed`` gives it).

    The token itself; for the last part of a query, if Latin, the words it begins; for a Latin token that the index lacks, of
    TYPO_LENGTH letters or more, the words one edit away. ``alt`` numbers them in that order. Of the vocabulary only what the
    tokens and prefixes select is read; all Latin words are, where one is looked for by its typos.
    """
    keys = ["qid", "phrase", "part"]
    words = index.vocabulary()
    tokens = sorted({r[4] for r in rows})
    have = {r["token"] for lo in range(0, len(tokens), NAMED_TOKENS) for r in words.where(F.col("token").isin(tokens[lo : lo + NAMED_TOKENS])).select("token").collect()}
    parts = index.spark.createDataFrame([(*r, r[4] in have) for r in rows], _PARTS + ", has boolean")
    head = [*keys, "at", "n_parts", "has"]
    found = parts.where("has").select(*head, "token", F.lit(0).alias("kind"))
    latin = words.where("latin").select("token")
    last = sorted({r[4] for r in rows if r[5] and r[6]})
    if prefix and last:
        some = F.lit(False)
        for t in last:
            some |= F.startswith(F.col("token"), F.lit(t))
        on = F.startswith(F.col("token"), F.col("asked")) & (F.col("token") != F.col("asked"))
        asked = F.broadcast(parts.where("latin and last").select(*head, F.col("token").alias("asked")))
        found = found.unionByName((latin.where(some) if len(last) <= 100 else latin).join(asked, on).select(*head, "token", F.lit(1).alias("kind")))
    if typos and any(r[5] and len(r[4]) >= TYPO_LENGTH and r[4] not in have for r in rows):
        asked = F.broadcast(parts.where(F.col("latin") & ~F.col("has") & (F.length("token") >= TYPO_LENGTH)).select(*head, F.col("token").alias("asked")))
        near = (F.length("token").between(F.length("asked") - 1, F.length("asked") + 1)) & (F.levenshtein("token", "asked", 1) == 1)
        found = found.unionByName(latin.join(asked, near).select(*head, "token", F.lit(2).alias("kind")))
    once = found.groupBy(*head, "token").agg(F.min("kind").alias("kind"))
    order = Window.partitionBy(*keys).orderBy("kind", "token")
    return once.withColumn("alt", F.row_number().over(order)).withColumn("expanded", ~F.col("has")).drop("has", "kind")


def resolved(index: Index, rows: list[tuple], prefix: bool = True, typos: bool = True) -> tuple[DataFrame, DataFrame]:
    """(alternatives, the postings of their tokens). Few alternatives are worked out once, and the postings' scan is told their
    tokens, so that of postings sorted by token it reads the row groups that hold them."""
    alts = alternatives(index, rows, prefix, typos)
    some = alts.limit(LOCAL_ALTERNATIVES + 1).collect()
    if len(some) > LOCAL_ALTERNATIVES:
        return alts, index.postings
    tokens = sorted({r["token"] for r in some})
    local = index.spark.createDataFrame(some, alts.schema)
    postings = index.postings.where(F.col("token").isin(tokens)) if len(tokens) <= NAMED_TOKENS else index.postings
    if all(r[7] == 1 for r in rows):
        postings = postings.withColumn("positions", F.lit(None).cast("array<int>"))  # nobody looks at them: they aren't read
    return F.broadcast(local), postings


def phrase_hits(postings: DataFrame, alts: DataFrame) -> DataFrame:
    """(qid, phrase, doc, field, tf, first_alt): where each phrase occurs and how often, overlaps counted.

    A phrase starts where the position less the offset is the same for all of its parts; single tokens need no positions.
    Postings are dealt out once, whole, by query and document; a document's parts meet as arrays.
    """
    single = F.col("n_parts") == 1
    part = F.when(~single, F.struct("part", "alt", F.transform("positions", lambda p: p - F.col("at")).alias("starts")))
    each = postings.join(alts, "token").select("qid", "phrase", "doc", "field", "n_parts", "tf", "alt", part.alias("x")).repartition("qid", "doc")
    whole = each.groupBy("qid", "phrase", "doc", "field", "n_parts").agg(F.sum("tf").alias("sum"), F.min("alt").alias("least"), F.collect_list("x").alias("xs"))
    some = lambda test: F.filter("xs", test)
    of_part = F.transform(F.sequence(F.lit(0), F.col("n_parts") - 1), lambda p: F.flatten(F.transform(some(lambda x: x["part"] == p), lambda x: x["starts"])))
    starts = F.reduce(F.slice(of_part, 2, F.col("n_parts")), F.array_distinct(F.get(of_part, F.lit(0))), F.array_intersect)
    first = lambda s: F.array_min(F.transform(some(lambda x: (x["part"] == 0) & F.arrays_overlap(x["starts"], s)), lambda x: x["alt"]))
    hit = lambda tf, alt: F.struct(tf.cast("long").alias("tf"), alt.alias("first_alt"))
    found = F.when(single, hit(F.col("sum"), F.col("least"))).otherwise(let(starts, lambda s: hit(F.size(s), first(s))))
    return whole.select("qid", "phrase", "doc", "field", F.inline(F.filter(F.array(found), lambda h: h["tf"] > 0)))


def passing(index: Index, filters: Mapping[str, object]) -> DataFrame:
    """(doc): documents that pass all conditions. A value condition is one value or several; a year condition one year, a
    (min, max) pair with None for open ends, or a mapping with min and max; None and empty lists are no condition."""
    out = index.docs.select("doc")
    for name, condition in filters.items():
        spec = index.schema.filters.get(str(name))
        if spec is None:
            raise ValueError(f"no filter {name}")
        if condition is None or isinstance(condition, (list, set)) and not condition:
            continue
        if spec["kind"] == "year":
            several = condition if isinstance(condition, (list, set)) else [condition]
            test = F.lit(False)
            for c in several:
                low, high = (c.get("min"), c.get("max")) if isinstance(c, Mapping) else c if isinstance(c, tuple) else (int(c), int(c))
                test |= (F.lit(True) if low is None else F.col("year") >= int(low)) & (F.lit(True) if high is None else F.col("year") <= int(high))
            ok = index.filter_years.where((F.col("name") == name) & test).select("doc")
        else:
            several = condition if isinstance(condition, (list, set, tuple)) else [condition]
            keys = [filter_key_text(index.schema.normalizer, v) for v in several]
            ok = index.filter_values.where((F.col("name") == name) & F.col("key").isin(keys)).select("doc")
        out = out.join(ok, "doc", "left_semi")
    return out


def search(index: Index, queries: Iterable[tuple[int, str]] | str, filters: Mapping[str, object] | None = None, prefix: bool = True, typos: bool = True, limit: int | None = None) -> DataFrame:
    """(qid, rank, doc, ref, score, fields) of each query, best first, ties in index order.

    Without words a query gives nothing; with ``filters``, even an empty mapping, it gives all documents that pass, in index
    order, with score 0. ``limit`` keeps the first so many of each query.
    """
    spark = index.spark
    queries = [(0, queries)] if isinstance(queries, str) else list(queries)
    rows = parsed(index, queries)
    blank = [q for q, _ in queries if q not in {r[0] for r in rows}]
    counts = spark.createDataFrame(sorted({(r[0], r[8]) for r in rows}), "qid long, n_phrases int")
    alts, postings = resolved(index, rows, prefix, typos)
    hits = phrase_hits(postings, alts)
    # Only an unbroken row of phrases from the first one counts, for results as well as for document counts.
    held = hits.groupBy("qid", "doc").agg(F.array_sort(F.collect_set("phrase")).alias("ps"), F.collect_list(F.struct("phrase", "field", "tf", "first_alt")).alias("hs"))
    held = held.select("qid", "doc", "hs", F.size(F.filter("ps", lambda p, i: p == i)).alias("n")).where("n > 0")
    df = held.select("qid", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("phrase")).groupBy("qid", "phrase").agg(F.count("*").alias("df"))
    whole = held.join(F.broadcast(counts), "qid").where("n = n_phrases").select("qid", "doc", F.inline("hs"))
    if filters is not None:
        whole = whole.join(passing(index, filters), "doc", "left_semi")
    weight = alts.groupBy("qid", "phrase").agg(F.max("expanded").alias("expanded"))
    names = spark.createDataFrame([(i, f, index.schema.boost(f)) for i, f in enumerate(index.schema.fields)], "field int, name string, boost double")
    one = whole.join(F.broadcast(df), ["qid", "phrase"]).join(F.broadcast(weight), ["qid", "phrase"])
    one = one.join(F.broadcast(names), "field").join(F.broadcast(index.stats()), "field").join(index.lengths, ["doc", "field"])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = 1 - B + B * F.col("len") / F.col("avg_len")
    score = F.when(F.col("expanded"), EXPANDED).otherwise(1.0) * F.col("boost") * idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * norm)
    order = F.struct("phrase", F.when(F.col("expanded"), F.col("first_alt")).otherwise(0).alias("alt"), "field", "name")
    scored = one.withColumn("s", score).groupBy("qid", "doc").agg(F.sum("s").alias("score"), F.array_sort(F.collect_list(order)).alias("o"))
    scored = scored.select("qid", "doc", "score", F.array_distinct(F.transform("o", lambda x: x["name"])).alias("fields"))
    if filters is not None and blank:
        rest = spark.createDataFrame([(q,) for q in blank], "qid long")
        scored = scored.unionByName(passing(index, filters).join(F.broadcast(rest)).select("qid", "doc", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("fields")))
    return ranked(scored, limit).join(index.docs, "doc").select("qid", "rank", "doc", "ref", "score", "fields")


def ranked(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds the rank within each query to (qid, doc, score, ...): best first, ties by doc; with ``limit`` only so many.

    The order in which a score is summed isn't fixed: equal scores are told by nine digits. Without a limit, documents are
    ranked band by band of the score, and bands after those above them, so that no task holds a query's whole result.
    """
    order = [F.desc(F.round("score", 9)), F.col("doc")]
    if limit:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= limit)
    band = F.floor(F.round("score", 9) * BANDS)
    banded = scored.withColumn("band", band).withColumn("chunk", F.when(F.round("score", 9) == 0, F.shiftright("doc", BAND_DOCS)).otherwise(0))
    key = ["qid", "band", "chunk"]
    sizes = banded.groupBy(*key).agg(F.count("*").alias("size"))
    above = F.sum("size").over(Window.partitionBy("qid").orderBy(F.desc("band"), "chunk")) - F.col("size")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    out = banded.withColumn("place", place).join(sizes.select(*key, above.alias("above")), key)
    return out.withColumn("rank", (F.col("above") + F.col("place")).cast("int")).drop("place", "above", "band", "chunk")


def facets(index: Index, name: str, results: DataFrame | None = None) -> DataFrame:
    """(value, count, rank): how often each value of a filter occurs over ``results`` (a table with ref) or all documents, the
    most frequent first, ties by first appearance in the whole index. A ref stands for its first document; repeated refs
    count again, unknown ones don't."""
    from .index import value_ids

    spec = index.schema.filters.get(name)
    if spec is None:
        raise ValueError(f"no filter {name}")
    docs = index.docs.select("doc")
    if results is not None:
        first = index.docs.groupBy("ref").agg(F.min("doc").alias("doc"))
        docs = results.select("ref").join(first, "ref").select("doc")
    if spec["kind"] == "year":
        own = index.filter_years.where(F.col("name") == name)
        rank = own.groupBy("year").agg(F.min("doc").alias("first"))
        counted = docs.join(own, "doc").groupBy("year").agg(F.count("*").alias("count")).join(rank, "year").select(F.col("year").cast("string").alias("value"), "count", F.struct("first", F.lit(0).alias("ord")).alias("rank"))
    else:
        own = index.filter_values.where(F.col("name") == name)
        counted = docs.join(own, "doc").groupBy("key").agg(F.count("*").alias("count")).join(value_ids(index, name), "key").select(F.col("display").alias("value"), "count", "rank")
    return counted.orderBy(F.desc("count"), "rank")


def facets_without_own(index: Index, queries: str, filters: Mapping[str, object]) -> dict[str, DataFrame]:
    """The facet of each filter as if nothing were chosen in it."""
    return {name: facets(index, name, search(index, queries, {k: v for k, v in filters.items() if k != name})) for name in index.schema.filters}
