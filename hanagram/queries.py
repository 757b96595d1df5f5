"""The engine's operators as queries over the standard tables, each beside SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans
from .functions import codec, marks
from .functions.classes import CJK, HAS_CJK, RUN, SEP
from .functions.normalize import Normalizer, filter_key, includes, nfkc, year
from .functions.tokens import phrases, tokens
from .operators import evaluate
from .operators.index import Index, Schema, build, filter_values, filter_years, numbered, run_totals, token_totals
from .operators.search import alternatives, facets, facets_without_own, parsed, passing, search
from .operators.updates import applied, compacted, updated
from .sources import index_files, records, snapshots, stores
from .streaming import ingest

#: The synthetic documents are Latin: their letters a to p stand for sixteen CJK characters here.
LETTERS, IDEOGRAPHS = "abcdefghijklmnop", "東京大学図書館植物地名の花鳥風月"
OLD, NEW = "圖國學帝實鐵體臺", "図国学帝実鉄体台"
PLAIN = Normalizer((), compatibility=False)
FOLDING = Normalizer(("ja",), compatibility=False)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def projected(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_id").cast("string").alias("ref"), F.translate(F.lower("text"), LETTERS, IDEOGRAPHS).alias("text"), "lang", "source")


def latin(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.col("doc_id").cast("string").alias("ref"), "text", "lang", "source")


def parts(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.col("p_partkey").cast("string").alias("ref"), "p_name", "p_brand", "p_type")


def folder(spark, name: str) -> str:
    """A new folder in the shared one."""
    return f"{stores.shared(spark)}/{name}-{uuid.uuid4().hex}"


_built: dict[tuple[str, str, str], str] = {}


def stored(f: Callable[[SparkSession, str], tuple[Index, DataFrame]]) -> Callable[[SparkSession, str], Index]:
    """Publishes a snapshot of an index in the shared folder once for a session and corpus, and reads it from there."""

    def get(spark, sf):
        key = (spark.sparkContext.applicationId, sf, f.__name__)
        if key not in _built:
            index, docs = f(spark, sf)
            root = folder(spark, f.__name__)
            snapshots.write(index, docs.select("doc", "ref"), root)
            _built[key] = root
        return snapshots.load(spark, _built[key])[0]

    return get


@stored
def ideograph_index(spark, sf):
    docs = projected(spark, sf)
    return build(docs, Schema(["text"], filters=["lang", "source"], normalizer=PLAIN)), docs


@stored
def latin_index(spark, sf):
    docs = latin(spark, sf)
    return build(docs, Schema(["text"], filters=["lang", "source"], normalizer=PLAIN)), docs


@stored
def part_index(spark, sf):
    docs = parts(spark, sf)
    return build(docs, Schema(["p_name", "p_brand", "p_type"], {"p_name": 3.0, "p_type": 2.0}, ["p_brand", "p_type"], PLAIN)), docs


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- SQL that the oracles share -----------------------------------------------------------------------------------------

CJK_DOCS = f"SELECT doc_id AS doc, 0 AS field, translate(lower(text), {q(LETTERS)}, {q(IDEOGRAPHS)}) AS folded, lang, source FROM documents"
LATIN_DOCS = "SELECT doc_id AS doc, 0 AS field, lower(text) AS folded, lang, source FROM documents"
PART_DOCS = " UNION ALL ".join(f"SELECT p_partkey AS doc, {i} AS field, lower({c}) AS folded FROM part" for i, c in enumerate(("p_name", "p_brand", "p_type")))


def tokens_sql(docs: str, unigrams: bool = True) -> str:
    """CTEs d (doc, field, folded), o (runs with offsets) and t (doc, field, token, pos)."""
    single = "" if unigrams else "AND length(run) = 1"
    return f"""d AS ({docs}),
r AS (SELECT doc, field, regexp_extract_all(folded, {q(RUN)}) AS rs FROM d),
e AS (SELECT doc, field, unnest(rs) AS run, unnest(range(len(rs))) AS i FROM r),
o AS (SELECT doc, field, run, sum(length(run)) OVER (PARTITION BY doc, field ORDER BY i) - length(run) AS off FROM e),
c AS (SELECT doc, field, run, off, unnest(range(length(run))) AS k FROM o WHERE regexp_matches(run, {q(f'^[{CJK}]')})),
t AS (SELECT doc, field, run AS token, off AS pos FROM o WHERE NOT regexp_matches(run, {q(f'^[{SEP}{CJK}]')})
  UNION ALL SELECT doc, field, substring(run, k + 1, 1), off + k FROM c WHERE true {single}
  UNION ALL SELECT doc, field, substring(run, k + 1, 2), off + k FROM c WHERE k + 2 <= length(run))"""


def search_sql(docs: str, queries: list[tuple[int, list[list[tuple[list[str], int]]], list[float]]], fields: list[tuple[str, float]], where: str = "true", limit: int | None = None) -> str:
    """Ranked results as SQL: each query is (qid, phrases of (alternative tokens, offset), weights)."""
    ctes, hits = [tokens_sql(docs)], []
    for qid, ps, weights in queries:
        for p, (phrase, w) in enumerate(zip(ps, weights)):
            some = " UNION ALL ".join(f"SELECT DISTINCT doc, field, pos - {at} AS start, {i} AS part FROM t WHERE token IN ({', '.join(map(q, ts))})" for i, (ts, at) in enumerate(phrase))
            hits.append(f"SELECT {qid} AS qid, {p} AS phrase, {w} AS w, {len(ps)} AS n_phrases, doc, field, count(*) AS tf FROM (SELECT doc, field, start FROM ({some}) GROUP BY ALL HAVING count(DISTINCT part) = {len(phrase)}) GROUP BY doc, field")
    names = " ".join(f"WHEN {i} THEN {q(n)}" for i, (n, _) in enumerate(fields))
    boosts = " ".join(f"WHEN {i} THEN {b}" for i, (_, b) in enumerate(fields))
    ctes.append(f"h AS ({' UNION ALL '.join(hits)})")
    ctes.append("""ph AS (SELECT DISTINCT qid, phrase, n_phrases, doc FROM h),
held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY phrase) - 1 AS rn FROM ph) WHERE rn = phrase),
df AS (SELECT qid, phrase, count(*) AS df FROM held GROUP BY ALL),
n AS (SELECT count(DISTINCT doc) AS n FROM d),
a AS (SELECT field, CASE WHEN avg(length(folded)) = 0 THEN 1 ELSE avg(length(folded)) END AS mean FROM d GROUP BY field)""")
    ctes.append(f"ok AS (SELECT qid, doc FROM held GROUP BY qid, doc, n_phrases HAVING count(*) = n_phrases AND doc IN (SELECT doc FROM d WHERE {where}))")
    ctes.append(f"""s AS (SELECT h.qid, h.doc, sum(h.w * (CASE h.field {boosts} END) * ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * (h.tf * 2.2) / (h.tf + 1.2 * (0.25 + 0.75 * length(d.folded) / a.mean))) AS score,
  list(DISTINCT h.field) AS fs, list(CASE h.field {names} END ORDER BY h.phrase, h.field) AS names
  FROM h JOIN ok ON h.qid = ok.qid AND h.doc = ok.doc JOIN df ON h.qid = df.qid AND h.phrase = df.phrase JOIN d ON d.doc = h.doc AND d.field = h.field JOIN a ON a.field = h.field, n GROUP BY h.qid, h.doc)""")
    top = f"WHERE rank <= {limit}" if limit else ""
    return f"""WITH {','.join(ctes)}
SELECT qid, rank, doc, score, fields FROM (SELECT CAST(qid AS BIGINT) AS qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) AS INTEGER) AS rank, doc, round(score, 6) AS score,
  array_to_string(list_transform(list_filter(names, lambda x, i: list_position(names, x) = i), lambda x: x), ',') AS fields FROM s) {top}"""


def exact(text: str) -> tuple[list[list[tuple[list[str], int]]], list[float]]:
    ps = phrases(PLAIN, text)
    return [[([t], at) for t, at in p] for p in ps], [1.0] * len(ps)


def shown(found: DataFrame) -> DataFrame:
    return found.select("qid", "rank", "doc", F.round("score", 6).alias("score"), F.array_join("fields", ",").alias("fields"))


# --- text functions -----------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, translate(translate(lower(text), {q(LETTERS[:8])}, {q(OLD)}), {q(OLD)}, {q(NEW)}) AS folded FROM documents")
def normalize_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", FOLDING.column(F.translate(F.lower("text"), LETTERS[:8], OLD)).alias("folded"))


_GOLDEN = [("東京帝國大學", "東京帝国大学"), ("サクラ", "さくら"), ("ＩＩＩＦ　２０２４", "iiif 2024"), ("佐々木", "佐佐木"), ("珊\U000e0100瑚", "珊瑚"), ("佐\U000e0101々木", "佐佐木"), ("圖\U000e0100", "図"), ("々", "々"), ("人々々", "人人人"), (None, "")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(b)})" for i, (_, b) in enumerate(_GOLDEN)) + ") v(n, folded)")
def normalize_literals(spark, sf):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_GOLDEN)], "n int, s string")
    return rows.select("n", Normalizer(("ja",)).column("s").alias("folded"))


@query("SELECT doc_id, text AS folded FROM documents WHERE text = nfc_normalize(text)")
def nfkc_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", nfkc("text").alias("folded"))


@query("SELECT * FROM (VALUES (0, '明治 33'), (1, 'a b'), (2, '図')) v(n, key)")
def filter_keys(spark, sf):
    rows = spark.createDataFrame([(0, " 明治　３３ "), (1, "A \t\n B"), (2, "圖")], "n int, s string")
    return rows.select("n", filter_key(Normalizer(("ja",)), "s").alias("key"))


@query("SELECT * FROM (VALUES (0, 1900), (1, 1931), (2, NULL), (3, NULL), (4, 1999)) v(n, year)")
def year_literals(spark, sf):
    rows = spark.createDataFrame([(0, "1900-01-01"), (1, "１９３１年"), (2, "明治33年"), (3, "12345"), (4, "x 12345 1999")], "n int, s string")
    return rows.select("n", year(Normalizer(()), "s").alias("year"))


@query(f"WITH {tokens_sql(CJK_DOCS)} SELECT run, count(*) AS n, CAST(sum(off) AS BIGINT) AS sum_at FROM o GROUP BY run")
def token_runs(spark, sf):
    return run_totals(projected(spark, sf), "text")


@query(f"WITH {tokens_sql(CJK_DOCS, False)} SELECT token, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM t WHERE token <> '' GROUP BY token")
def token_bigrams(spark, sf):
    # A CJK run of one character is a token too, longer ones only give bigrams.
    return token_totals(projected(spark, sf), Schema(["text"], normalizer=PLAIN), False)


@query(f"WITH {tokens_sql(CJK_DOCS)} SELECT token, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM t GROUP BY token")
def token_unigrams(spark, sf):
    return token_totals(projected(spark, sf), Schema(["text"], normalizer=PLAIN))


@query(f"WITH {tokens_sql('SELECT conv_id * 1000 + turn AS doc, 0 AS field, lower(text) AS folded FROM conversations')} SELECT token, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM t GROUP BY token")
def token_columns(spark, sf):
    """Short texts: tokens as column expressions, without Python."""
    each = table(spark, sf, "conversations").select(F.explode(tokens(F.lower("text"))).alias("t"))
    return each.groupBy(F.col("t.token").alias("token")).agg(F.count("*").alias("n"), F.sum(F.col("t.pos").cast("long")).alias("sum_pos"))


_PHRASES = [("第1輯、IIIF「マニフェスト」", [[("第", 0), ("1", 1), ("輯", 2)], [("iiif", 4)], [("まに", 9), ("にふ", 10), ("ふぇ", 11), ("ぇす", 12), ("すと", 13)]]), ("鳥瞰圖 IIIF", [[("鳥瞰", 0), ("瞰図", 1)], [("iiif", 4)]])]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {p}, {q(t)}, {at})" for i, (_, ps) in enumerate(_PHRASES) for p, ph in enumerate(ps) for t, at in ph) + ") v(n, phrase, token, pos)")
def phrases_offsets(spark, sf):
    n = Normalizer(("ja",))
    return spark.createDataFrame([(i, p, t, at) for i, (text, _) in enumerate(_PHRASES) for p, ph in enumerate(phrases(n, text)) for t, at in ph], "n int, phrase int, token string, pos int")


@query("SELECT doc_id, contains(regexp_replace(lower(text), '\\s+', '', 'g'), 'the') AS has FROM documents")
def includes_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", includes(PLAIN, F.col("text"), F.lit("t he")).alias("has"))


def _marked(needle: str) -> str:
    esc = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
    return f"regexp_replace({esc}, {q(f'((?i:{needle})+)')}, '<mark>\\1</mark>', 'g')"


@query(f"SELECT doc_id, {_marked('ing')} AS html FROM documents")
def highlight(spark, sf):
    return table(spark, sf, "documents").select("doc_id", marks.highlight(Normalizer(()), F.col("text"), F.lit("ing")).alias("html"))


@query(f"""WITH a AS (SELECT doc_id, text AS whole, strpos(lower(text), 'ing') AS p FROM documents),
b AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE greatest(0, p - 1 - 13) END AS start FROM a),
c AS (SELECT *, substring(whole, start + 1, 40) AS text FROM b)
SELECT doc_id, CASE WHEN start > 0 THEN '…' ELSE '' END || {_marked('ing')} || CASE WHEN start + 40 < length(whole) THEN '…' ELSE '' END AS html FROM c""")
def excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", marks.excerpt(Normalizer(()), F.col("text"), F.lit("ing"), 40).alias("html"))


@query("SELECT url, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM pages")
def escape_html(spark, sf):
    return table(spark, sf, "pages").select("url", marks.escape_html(F.col("url")).alias("html"))


# --- index --------------------------------------------------------------------------------------------------------------


@query(f"WITH {tokens_sql(LATIN_DOCS)} SELECT token, doc, count(*) AS tf, string_agg(CAST(CAST(pos AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS positions FROM t GROUP BY token, doc")
def postings_invert(spark, sf):
    p = latin_index(spark, sf).postings
    return p.select("token", "doc", F.col("tf").cast("long").alias("tf"), F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query("SELECT doc_id AS doc, CAST(0 AS INTEGER) AS field, length(lower(text)) AS len FROM documents")
def field_lengths(spark, sf):
    return latin_index(spark, sf).lengths.select("doc", "field", F.col("len").cast("long").alias("len"))


@query("SELECT CAST(0 AS INTEGER) AS field, count(*) AS n, round(avg(length(lower(text))), 6) AS avg_len FROM documents")
def corpus_stats(spark, sf):
    return latin_index(spark, sf).stats().select("field", "n", F.round("avg_len", 6).alias("avg_len"))


@query(f"WITH {tokens_sql(CJK_DOCS)} SELECT DISTINCT token FROM t WHERE NOT regexp_matches(token, {q(HAS_CJK)})")
def vocab_latin(spark, sf):
    return ideograph_index(spark, sf).latin()


# --- search -------------------------------------------------------------------------------------------------------------


@query(search_sql(CJK_DOCS, [(0, *exact("東鳥学植"))], [("text", 1)]))
def search_single_phrase(spark, sf):
    return shown(search(ideograph_index(spark, sf), "東鳥学植"))


@query(search_sql(CJK_DOCS, [(0, *exact("東鳥学植 風鳥"))], [("text", 1)]))
def search_multi_phrase(spark, sf):
    return shown(search(ideograph_index(spark, sf), "東鳥学植 風鳥"))


@query(search_sql(PART_DOCS, [(0, *exact("red economy"))], [("p_name", 3), ("p_brand", 1), ("p_type", 2)]))
def search_multi_field(spark, sf):
    return shown(search(part_index(spark, sf), "red economy", prefix=False, typos=False))


@query(search_sql(CJK_DOCS, [(0, *exact("t植図r図"))], [("text", 1)]))
def search_mixed_script(spark, sf):
    return shown(search(ideograph_index(spark, sf), "t植図r図", prefix=False, typos=False))


_WORDS = "SELECT DISTINCT token FROM t WHERE"


def _expanded(docs: str, token: str, where: str, fields: list[tuple[str, float]], weight: float) -> str:
    """A search for one word whose alternatives the index tells: the token list is a subquery."""
    sql = search_sql(docs, [(0, [[(["\0"], 0)]], [weight])], fields)
    return sql.replace(f"token IN ({q(chr(0))})", f"(token = {q(token)} OR {where})")


@query(_expanded(LATIN_DOCS, "than", "starts_with(token, 'than')", [("text", 1)], 1.0))
def search_prefix(spark, sf):
    return shown(search(latin_index(spark, sf), "than"))


@query(_expanded(LATIN_DOCS, "thxng", "(starts_with(token, 'thxng') OR (abs(length(token) - 5) <= 1 AND levenshtein(token, 'thxng') = 1))", [("text", 1)], 0.6))
def search_typo(spark, sf):
    return shown(search(latin_index(spark, sf), "thxng"))


@query(_expanded(LATIN_DOCS, "ertionh", "(starts_with(token, 'ertionh') OR (abs(length(token) - 7) <= 1 AND levenshtein(token, 'ertionh') = 1))", [("text", 1)], 0.6))
def search_expanded_weight(spark, sf):
    return shown(search(latin_index(spark, sf), "ertionh"))


@query(search_sql(CJK_DOCS, [(0, *exact("東鳥学"))], [("text", 1)], limit=10))
def search_limit(spark, sf):
    return shown(search(ideograph_index(spark, sf), "東鳥学", limit=10))


_BATCH = [(0, "東鳥学"), (1, "風鳥 東鳥"), (2, "植図 館鳥 鳥学"), (3, "学図東")]


@query(search_sql(CJK_DOCS, [(i, *exact(t)) for i, t in _BATCH], [("text", 1)], limit=20))
def search_batch(spark, sf):
    return shown(search(ideograph_index(spark, sf), _BATCH, limit=20))


@query(f"SELECT doc, CAST((length(folded) - length(replace(folded, '東鳥', ''))) // 2 AS BIGINT) AS tf FROM ({CJK_DOCS}) WHERE contains(folded, '東鳥')")
def search_scan_substring(spark, sf):
    return plans.scan(projected(spark, sf).select("doc", F.col("text").alias("folded")), PLAIN, "東鳥")


@query(f"WITH {tokens_sql(PART_DOCS)} SELECT DISTINCT token FROM t WHERE starts_with(token, 'b') AND token <> 'b'")
def prefix_words(spark, sf):
    index = part_index(spark, sf)
    return alternatives(index, parsed(index, [(0, "b")])).where("token != 'b'").select("token")


# --- filters and facets -------------------------------------------------------------------------------------------------


@query(search_sql(CJK_DOCS, [(0, *exact("東鳥学植"))], [("text", 1)], "lang = 'en'"))
def filter_value(spark, sf):
    return shown(search(ideograph_index(spark, sf), "東鳥学植", {"lang": "EN"}))


@query(search_sql(CJK_DOCS, [(0, *exact("東鳥学植"))], [("text", 1)], "lang IN ('en', 'de') AND source = 'src0'"))
def filter_conjunction(spark, sf):
    return shown(search(ideograph_index(spark, sf), "東鳥学植", {"lang": ["en", "de"], "source": "src0"}))


@query("SELECT CAST(0 AS BIGINT) AS qid, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS rank, doc_id AS doc, 0.0::DOUBLE AS score, '' AS fields FROM documents WHERE lang = 'fr'")
def filter_only(spark, sf):
    return shown(search(latin_index(spark, sf), "", {"lang": "fr"}))


@stored
def _orders(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderkey").cast("string").alias("ref"), F.col("o_orderpriority").alias("text"), F.col("o_orderdate").alias("date"))
    return build(rows, Schema(["text"], filters={"date": "year"}, normalizer=PLAIN)), rows


@query("SELECT o_orderkey AS doc FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1996")
def filter_year(spark, sf):
    return passing(_orders(spark, sf), {"date": (1995, 1996)})


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS value, count(*) AS count FROM orders GROUP BY 1")
def facets_year(spark, sf):
    return facets(_orders(spark, sf), "date").select("value", "count")


@query("SELECT source AS value, count(*) AS count, min(doc_id) AS first FROM documents GROUP BY source")
def facets_all(spark, sf):
    return facets(latin_index(spark, sf), "source").select("value", "count", F.col("rank.doc").alias("first"))


@query(f"WITH {tokens_sql(CJK_DOCS)} SELECT lang AS value, count(*) AS count FROM d WHERE contains(folded, '東鳥学植') GROUP BY lang")
def facets_results(spark, sf):
    index = ideograph_index(spark, sf)
    return facets(index, "lang", search(index, "東鳥学植")).select("value", "count")


@query("SELECT w AS value, count(*) AS count FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def multi_value_filter(spark, sf):
    rows = parts(spark, sf).withColumn("words", F.col("p_name"))
    found = filter_values(rows, Schema(["p_name"], filters={"words": {"kind": "value", "separator": " "}}, normalizer=PLAIN))
    return found.groupBy(F.col("key").alias("value")).agg(F.count("*").alias("count"))


# --- updates ------------------------------------------------------------------------------------------------------------


def _changes(spark, sf, op: str, by: int, at: int) -> DataFrame:
    docs = latin(spark, sf).where(F.col("doc") % by == at)
    return docs.select(F.col("doc").alias("seq"), F.lit(op).alias("op"), "ref", F.lit("changed words").alias("text"), "lang", "source")


@query("SELECT doc_id AS doc, CAST(doc_id AS VARCHAR) AS ref FROM documents WHERE doc_id % 3 <> 1")
def update_remove(spark, sf):
    return applied(latin(spark, sf), _changes(spark, sf, "remove", 3, 1)).select("doc", "ref")


@query("SELECT doc_id AS doc, CASE WHEN doc_id % 7 = 2 THEN 'changed words' ELSE text END AS text FROM documents")
def update_replace(spark, sf):
    return applied(latin(spark, sf), _changes(spark, sf, "update", 7, 2)).select("doc", "text")


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc, CAST(doc_id AS VARCHAR) AS ref FROM documents WHERE doc_id % 3 <> 1")
def compact(spark, sf):
    return compacted(applied(latin(spark, sf), _changes(spark, sf, "remove", 3, 1)).select("doc", "ref"))


@query("SELECT 'changed' AS token, count(*) AS df FROM part WHERE p_partkey % 5 = 0")
def update_index(spark, sf):
    docs = parts(spark, sf)
    index = build(docs, Schema(["p_name"], normalizer=PLAIN))
    changes = docs.where("doc % 5 = 0").select(F.col("doc").alias("seq"), F.lit("update").alias("op"), "ref", F.lit("changed part").alias("p_name"), "p_brand", "p_type")
    after, _ = updated(index, docs, changes)
    return after.postings.where("token = 'changed'").groupBy("token").agg(F.count("*").alias("df"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS doc FROM part")
def number_documents(spark, sf):
    return numbered(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"]).select("p_partkey", "doc")


# --- exchange format, tables, evaluation ----------------------------------------------------------------------------------

_NUMBERS = [0, 59, 60, 1799, 1800, 53999, 54000, 123456789]


@query("SELECT * FROM (VALUES " + ", ".join(f"({n}, {s}, {n})" for n, s in zip(_NUMBERS, (1, 1, 2, 2, 3, 3, 4, 6))) + ") v(n, size, back)")
def codec_roundtrip(spark, sf):
    return spark.createDataFrame([(n, len(codec.number(n)), next(codec.numbers(codec.number(n)))) for n in _NUMBERS], "n int, size int, back int")


@query("SELECT * FROM (VALUES ('圖', '図'), ('图', '図'), ('國', '国')) v(variant, folded)")
def variant_classes(spark, sf):
    n = Normalizer(({"圖": "図", "國": "国"}, {"圖": "图"}))
    return spark.createDataFrame(sorted(n.variants.items()), "variant string, folded string")


@query("""WITH g AS (SELECT l.quality AS qid, d.doc_id AS doc FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'en'),
r AS (SELECT quality AS qid, doc_id AS doc FROM labels WHERE toxic = 0)
SELECT CAST(qid AS INTEGER) AS qid, sum(CASE WHEN g AND r THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN g AND NOT r THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN NOT g THEN 1 ELSE 0 END)::BIGINT AS fn FROM (
  SELECT coalesce(g.qid, r.qid) AS qid, g.doc IS NOT NULL AS g, r.doc IS NOT NULL AS r FROM g FULL JOIN r ON g.qid = r.qid AND g.doc = r.doc) GROUP BY qid""")
def retrieval_eval(spark, sf):
    labels = table(spark, sf, "labels")
    got = table(spark, sf, "documents").where("lang = 'en'").join(labels, "doc_id").select(F.col("quality").alias("qid"), F.col("doc_id").alias("doc"))
    judged = labels.select(F.col("quality").alias("qid"), F.col("doc_id").alias("doc"), (1 - F.col("toxic")).alias("rel"))
    return evaluate.scores(got, judged).select("qid", "tp", "fp", "fn")


@query("""SELECT 0 AS qid, p_partkey AS doc, CAST(k AS INTEGER) AS place, substring(p_name, greatest(k - 15, 0) + 1, k - greatest(k - 15, 0) + 2 + 15) AS context
FROM (SELECT p_partkey, p_name, unnest(range(length(p_name))) AS k FROM part) WHERE substring(p_name, k + 1, 2) = 'ge'""")
def pooling(spark, sf):
    docs = parts(spark, sf).select("doc", F.col("p_name").alias("folded"))
    return evaluate.pooled(docs, spark.createDataFrame([(0, "ge")], "qid int, spelling string")).withColumnRenamed("at", "place")


@query("SELECT * FROM (VALUES ('a', 'x')) v(variant, folded)")
def table_derivation(spark, sf):
    pairs = evaluate.derived_pairs(spark.createDataFrame([("a", ["x"]), ("b", ["b", "y"]), ("c", ["z"]), ("d", ["z"]), ("e", ["w"])], "variant string, values array<string>"))
    return evaluate.one_to_one(pairs, spark.createDataFrame([("w",)], "character string"))




# --- sources and sinks: what is written and read again ---------------------------------------------------------------------------

_PARTS_SQL = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name, p_brand FROM part"


def _records(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_brand")


@query(_PARTS_SQL)
def source_csv(spark, sf):
    to = folder(spark, "parts") + ".csv"
    _records(spark, sf).write.option("header", True).csv(to)
    return records.read(spark, to)


@query(_PARTS_SQL)
def source_json_lines(spark, sf):
    to = folder(spark, "parts") + ".jsonl"
    _records(spark, sf).write.option("compression", "gzip").json(to)
    return records.read(spark, to).select("id", "p_name", "p_brand")


_NATIONS_SQL = "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation"


def _nations(spark, sf) -> list[dict]:
    return [{"id": str(r["n_nationkey"]), "name": r["n_name"], "region": str(r["n_regionkey"])} for r in table(spark, sf, "nation").collect()]


@query(_NATIONS_SQL)
def source_json_array(spark, sf):
    to = folder(spark, "nations") + ".json"
    stores.write_text(spark, to, json.dumps(_nations(spark, sf)))
    return records.read(spark, to).select("id", "name", "region")


@query(_NATIONS_SQL)
def source_standard_input(spark, sf):
    return records.from_text(spark, "\ufeff" + "\n\n".join(map(json.dumps, _nations(spark, sf)))).select("id", "name", "region")


@query(_NATIONS_SQL)
def source_in_memory(spark, sf):
    return records.from_rows(spark, lambda: _nations(spark, sf)).select("id", "name", "region")


@query("SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region, 'About ' || n_name || '.' || chr(10) AS content FROM nation")
def source_front_matter(spark, sf):
    to = folder(spark, "pages")
    for n in _nations(spark, sf):
        stores.write_text(spark, f"{to}/{n['id']}.md", f"---\nname: \"{n['name']}\"\nregion: {n['region']}\n---\nAbout {n['name']}.\n")
    stores.write_text(spark, f"{to}/_index.md", "---\nname: none\n---\n")
    return records.front_matter(spark, to).select(F.col("matter")["name"].alias("name"), F.col("matter")["region"].alias("region"), "content")


@query("SELECT 'items/' || CASE WHEN p_partkey % 3 = 0 THEN (p_partkey - 1) || '.html#' || p_partkey ELSE p_partkey || '.html' END AS ref, p_name AS title FROM part")
def source_collection(spark, sf):
    key = F.col("p_partkey")
    meta = table(spark, sf, "part").select(key.cast("string").alias("objectid"), F.when(key % 3 == 0, (key - 1).cast("string")).alias("parentid"), F.concat(F.lit(" "), "p_name").alias("title"), F.lit("1900").alias("date"))
    config = spark.createDataFrame([("title", "true"), ("date", "false")], "field string, index string")
    return records.collection(meta, config, children=True)[0].select("ref", "title")


_PART_POSTINGS = f"WITH {tokens_sql(PART_DOCS)} SELECT token, doc, CAST(field AS INTEGER) AS field, string_agg(CAST(CAST(pos AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS positions FROM t GROUP BY token, doc, field"


def _positions(postings: DataFrame) -> DataFrame:
    return postings.select("token", "doc", "field", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(_PART_POSTINGS)
def exchange_file(spark, sf):
    """An index as one file, read again: documents are numbered from 0."""
    to = folder(spark, "index").removeprefix("file://") + ".json"
    index_files.write_file(part_index(spark, sf), to)
    return _positions(index_files.read(spark, to, PLAIN).postings)


@query(_PART_POSTINGS)
def exchange_split(spark, sf):
    """The same in shards, written twice."""
    to = folder(spark, "index").removeprefix("file://")
    for size in (4_000, 32_000):
        index_files.write_split(part_index(spark, sf), to, size)
    return _positions(index_files.read(spark, to, PLAIN).postings)


@query(f"WITH {tokens_sql(PART_DOCS)} SELECT DISTINCT token FROM t WHERE NOT regexp_matches(token, {q(HAS_CJK)})")
def exchange_latin_words(spark, sf):
    """The list of Latin words that a split index has beside its shards."""
    to = folder(spark, "index").removeprefix("file://")
    index_files.write_split(part_index(spark, sf), to)
    return index_files.latin_words(spark, to)


@query("SELECT p_partkey AS doc, CAST(0 AS INTEGER) AS field, p_partkey % 7 || ',' || (p_partkey % 7 + p_size) AS positions FROM part WHERE p_size > 0")
def posting_codec(spark, sf):
    """Posting lists coded and decoded."""

    @F.udf("array<struct<doc:long,field:int,positions:array<long>>>")
    def coded(es):
        return [(d, f, ps) for d, f, ps in codec.decode(codec.encode([(e["doc"], e["field"], e["positions"]) for e in es], 1), 1)]

    rows = table(spark, sf, "part").where("p_size > 0").select((F.col("p_partkey") % 16).alias("list"), F.struct(F.col("p_partkey").alias("doc"), F.lit(0).alias("field"), F.array(F.col("p_partkey") % 7, F.col("p_partkey") % 7 + F.col("p_size")).alias("positions")).alias("e"))
    back = rows.groupBy("list").agg(F.sort_array(F.collect_list("e")).alias("es")).select(F.inline(coded("es")))
    return back.select("doc", "field", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query("SELECT CAST(doc_id AS VARCHAR) AS ref, count(*) AS n FROM documents GROUP BY doc_id UNION ALL SELECT 'new' || doc_id, 1 FROM documents WHERE doc_id % 11 = 4")
def update_add(spark, sf):
    docs = latin(spark, sf)
    changes = _changes(spark, sf, "add", 11, 4).withColumn("ref", F.concat(F.lit("new"), "ref"))
    return applied(docs, changes).groupBy("ref").agg(F.count("*").alias("n"))


@query("SELECT 'changed' AS token, count(*) AS df FROM part WHERE p_partkey % 5 = 0")
def snapshot_update(spark, sf):
    """A published snapshot, changed under the lock and read again; a batch that comes again changes nothing."""
    docs, root = parts(spark, sf), folder(spark, "snapshot")
    snapshots.write(build(docs, Schema(["p_name"], normalizer=PLAIN)), docs, root)
    changes = docs.where("doc % 5 = 0").select(F.col("doc").alias("seq"), F.lit("update").alias("op"), "ref", F.lit("changed part").alias("p_name"), "p_brand", "p_type")
    for _ in range(2):
        snapshots.update(spark, root, lambda index, d: updated(index, d, changes), PLAIN, batch=0)
    snapshots.cleaned(root, 1, spark)
    return snapshots.load(spark, root, PLAIN)[0].postings.where("token = 'changed'").groupBy("token").agg(F.count("*").alias("df"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS ref FROM part WHERE p_partkey % 4 <> 1")
def stream_ingest(spark, sf):
    """A stream of removals, applied to a snapshot."""
    docs, root, feed = parts(spark, sf), folder(spark, "snapshot"), folder(spark, "feed")
    snapshots.write(build(docs, Schema(["p_name"], normalizer=PLAIN)), docs, root)
    changes = docs.where("doc % 4 = 1").select(F.col("doc").alias("seq"), F.lit("remove").alias("op"), "ref", "p_name", "p_brand", "p_type")
    changes.write.parquet(feed)
    ingest(spark.readStream.schema(changes.schema).parquet(feed), root, folder(spark, "checkpoint"), PLAIN).awaitTermination()
    return snapshots.load(spark, root, PLAIN)[0].docs.select("ref")


# --- folding on, and what else a search can be asked -------------------------------------------------------------------------------


@stored
def folded_index(spark, sf):
    """Documents in old forms of the characters, folded with compatibility forms and the built-in table."""
    docs = latin(spark, sf).withColumn("text", F.translate(F.lower("text"), LETTERS[:8], OLD))
    return build(docs, Schema(["text"], filters=["lang"], normalizer=Normalizer(("ja",)))), docs


_FOLDED_DOCS = f"SELECT doc_id AS doc, 0 AS field, translate(nfc_normalize(lower(text)), {q(LETTERS[:8])}, {q(NEW)}) AS folded, lang, source FROM documents"


@query(search_sql(_FOLDED_DOCS, [(0, *exact("台実"))], [("text", 1)]))
def search_folded(spark, sf):
    return shown(search(folded_index(spark, sf), "臺實"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS ref FROM part")
def refs_listing(spark, sf):
    return part_index(spark, sf).refs()


@query("SELECT doc_id AS doc FROM documents")
def filter_none(spark, sf):
    """Conditions that are none: an empty list and a null."""
    return passing(latin_index(spark, sf), {"lang": [], "source": None})


@query("SELECT doc_id AS doc FROM documents WHERE false")
def filter_unknown_value(spark, sf):
    return passing(latin_index(spark, sf), {"lang": "no such language"})


@query("SELECT p_partkey AS doc, 1900 + p_partkey % 50 AS year FROM part WHERE p_partkey % 10 <> 0")
def filter_years_of_values(spark, sf):
    """The first value of an array that has a year."""
    key = F.col("p_partkey")
    rows = table(spark, sf, "part").select(key.alias("doc"), F.array(F.lit("n.d."), F.when(key % 10 != 0, F.concat(F.lit("about "), (1900 + key % 50).cast("string"))), F.when(key % 10 != 0, F.lit("2000"))).alias("date"), F.lit("x").alias("text"))
    return filter_years(rows, Schema(["text"], filters={"date": "year"}, normalizer=PLAIN)).select("doc", F.col("year").cast("long").alias("year"))


@query(f"""WITH {tokens_sql(CJK_DOCS)}, m AS (SELECT * FROM d WHERE contains(folded, '東鳥学植'))
SELECT 'lang' AS filter, lang AS value, count(*) AS count FROM m WHERE source = 'src0' GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM m WHERE lang = 'en' GROUP BY source""")
def facets_each_without_own(spark, sf):
    found = facets_without_own(ideograph_index(spark, sf), "東鳥学植", {"lang": "en", "source": "src0"})
    some = [f.select(F.lit(name).alias("filter"), "value", "count") for name, f in found.items()]
    return some[0].unionByName(some[1])
