"""Quality classifier: perplexity under an n-gram model with interpolated modified Kneser-Ney smoothing.

The units are characters. To classify, a document is one line, its words with a blank between them, and each character is
given up to ORDER - 1 characters before it, the blank being a character like others: what follows a word counts, and so does
each repetition. ``scored`` alone can also take each word by itself. The model of a language is estimated on its trusted documents by
aggregations over n-gram counts. For scoring, documents stand in blocks; each block asks for its distinct n-grams once, the
requests meet the counts shard by shard, and the answers return to their block, where the log-probabilities are summed. What is gathered grows with the input, and no task holds the model. A document is rejected if its perplexity
exceeds a threshold made of quantiles of its language's trusted documents, of those that the model hasn't seen.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, released, restricted, small_batches, tidied, written

ORDER = 5
BITS = 12
#: Code points below NARROW are codes themselves; UPPER codes follow for the upper bits of the others, 1,024 for the lower ones.
UPPER = 0x10FFFF + 1 >> 10
NARROW = (1 << BITS) - UPPER - 1024
#: Characters of a block.
BLOCK_CHARS = 24_000_000
#: Characters of which n-grams are made at once.
PIECE_CHARS = 1_000_000
#: A threshold is the median of the trusted log-perplexities plus WIDTH times the distance from it to the QUANTILE.
QUANTILE, WIDTH = 0.99, 2.0
#: A text of n units may exceed the threshold by SLACK / sqrt(n): the mean over few units varies.
SLACK = 2.0
#: N-grams that differ in the last two codes only are one shard's: what is asked for compresses well.
PREFIX = 2 * BITS
_LOW = [np.int64((1 << BITS * n) - 1) for n in range(ORDER + 1)]
#: What a request of order n adds to its key.
_TAG = [np.int64(n << BITS * ORDER) for n in range(ORDER + 1)]


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """12-bit codes of the words' characters, each word ended by a 1 (the blank after it) and led by ORDER - 1 zeros, and the
    starts of the words."""
    return _coded(["\0" * (ORDER - 1) + w + "\1" for w in words])


def units(word: str) -> int:
    """How many codes a word is."""
    return len(word) if word.isascii() else len(word) + sum(ord(c) >= NARROW for c in word)


def _coded(strings: list[str], context: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The strings' codes and where each begins. A code point from NARROW on is two codes, one for its upper and one for its lower
    bits, so that no two characters are confused. ``context`` marks strings that begin with ORDER - 1 characters of context,
    which are left at ORDER - 1 codes."""
    c = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(size)
    wide = c >= NARROW
    if wide.any():
        at = np.concatenate([[0], np.cumsum(wide + 1)])
        out = np.empty(at[-1], np.int64)
        out[at[:-1]] = np.where(wide, NARROW + (c >> 10), c)
        out[at[1:][wide] - 1] = NARROW + UPPER + (c[wide] & 1023)
        first = at[ends - size]
        if context is not None and context.any():
            more = np.where(context, at[np.minimum(ends - size + ORDER - 1, ends)] - first - (ORDER - 1), 0)
            keep = np.ones(len(out), bool)
            for lo, n in zip(first[more > 0].tolist(), more[more > 0].tolist()):
                keep[lo : lo + n] = False
            out, size = out[keep], at[ends] - first - more
        else:
            size = at[ends] - first
        c, ends = out, np.cumsum(size)
    return c, ends - size


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-gram key that ends at each character of each word (and the blank after it), and the word's number."""
    return _keys(*codes(words))


def _keys(c: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the ORDER-grams within each of the strings that begin at ``starts``, and the string's number."""
    n = len(c) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = c[:n].copy()
    for i in range(1, ORDER):
        key = (key << BITS) | c[i : i + n]
    size = np.diff(np.append(starts, len(c))) - ORDER + 1
    word = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    return key[at], word


def running(texts, chars: int = PIECE_CHARS):
    """(keys, numbers): the ORDER-gram key that ends at each character of each text's line (and the blank after it), and the
    text's number; in pieces of about ``chars`` characters, which bounds the arrays. A longer line is cut, and the next piece
    begins with the characters that the context needs, so that no n-gram is lost."""
    strings, numbers, goes_on, held = [], [], [], 0

    def made():
        keys, at = _keys(*_coded(strings, np.array(goes_on)))
        return keys, np.array(numbers, np.int64)[at]

    for number, text in enumerate(texts):
        line = "\1".join(words_of(text))
        if not line:
            continue
        line = "\0" * (ORDER - 1) + line + "\1"
        for lo in range(0, len(line) - ORDER + 1, chars):
            strings.append(line[lo : lo + chars + ORDER - 1])
            numbers.append(number)
            goes_on.append(lo > 0)
            held += len(strings[-1])
            if held >= chars:
                yield made()
                strings, numbers, goes_on, held = [], [], [], 0
    if strings:
        yield made()


def parts_of(words, size: int = 100_000):
    """``words`` in lists of at most ``size``, which bounds the arrays made of them."""
    words = list(words)
    return (words[lo : lo + size] for lo in range(0, len(words), size))


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(keys)
    keys, weights = keys[by], weights[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def words_of(text: str) -> list[str]:
    """A text's words. U+0000 and U+0001, which stand for what is before a line and for the blank, count as white space."""
    if "\0" in text or "\1" in text:
        text = text.replace("\0", " ").replace("\1", " ")
    return text.split()


def in_blocks(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(block, lang, body): compressed runs of documents of one language, about BLOCK_CHARS in all; ``trusted`` is a column of
    ``docs``. Written once, so that a block stays the same."""

    def run(it):
        held: dict[str, list] = {}
        # Long matches are looked for in the whole block: copies of texts are far apart.
        number, z = 0, zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(12, enable_ldm=True, window_log=25))
        task = TaskContext.get().partitionId() << 24

        def pack(lang):
            nonlocal number
            rows = held.pop(lang)[1]
            number += 1
            table = pa.table({"id": pa.array([r[0] for r in rows], pa.int64()), "trusted": pa.array([r[1] for r in rows], pa.bool_()), "text": pa.array([r[2] for r in rows], pa.large_string())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table, max_chunksize=500)
            return pa.RecordBatch.from_arrays([pa.array([task + number], pa.int64()), pa.array([lang], pa.string()), pa.array([z.compress(sink.getvalue())], pa.binary())], ["block", "lang", "body"])

        for b in it:
            for key, text, lang, trusted in zip(*(c.to_pylist() for c in b.columns)):
                lang = lang or ""
                entry = held.setdefault(lang, [0, []])
                entry[0] += len(text or "")
                entry[1].append((key, bool(trusted), text or ""))
                if entry[0] >= BLOCK_CHARS:
                    yield pack(lang)
                elif sum(e[0] for e in held.values()) >= 2 * BLOCK_CHARS:
                    yield pack(max(held, key=lambda x: held[x][0]))
        for lang in list(held):
            yield pack(lang)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(lang_col).cast("string"), "trusted").mapInArrow(tidied(run), "block long, lang string, body binary")


def opened(body: bytes):
    """The record batches (id, trusted, text) of a block."""
    data = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 32)
    yield from pa.ipc.open_stream(data)


def held_out(doc: int) -> bool:
    """Whether a trusted document, one in four by its id, stays out of the model: its score is that of a text not seen before."""
    return doc * 0x9E3779B97F4A7C15 % (1 << 64) >> 62 == 0


def ngram_counts(blocks: DataFrame, across: bool = False) -> DataFrame:
    """(lang, key, c) of the highest order over the trusted documents, within words; or ``across`` them, without the documents held out."""

    def run(it):
        from collections import Counter

        for b in it:
            for lang, body in zip(b.column(1).to_pylist(), b.column(2)):
                texts = (text for part in opened(body.as_py()) for doc, trusted, text in zip(*(c.to_pylist() for c in part.columns)) if trusted and not (across and held_out(doc)))
                some = []
                if across:
                    some = [counted(keys, np.ones(len(keys), np.int64)) for keys, _ in running(texts)]
                else:
                    tally: Counter = Counter()
                    for text in texts:
                        tally.update(words_of(text))
                    for words in parts_of(tally):
                        keys, word = grams(words)
                        some.append(counted(keys, np.fromiter(map(tally.__getitem__, words), np.int64, len(words))[word]))
                if some:
                    keys, c = counted(*(np.concatenate(x) for x in zip(*some)))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(c)], ["lang", "key", "c"])

    return blocks.mapInArrow(tidied(run), "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))


def model(counts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, id, alpha, gamma), and the written tables that it reads, from the highest order's counts: for each n-gram (id: order and key) its discounted share
    alpha, and as a context the weight gamma of the next lower order. The empty context (order 0) also has in alpha the
    uniform probability of a character."""
    every = [written(counts.select("lang", F.lit(ORDER).alias("n"), "key", "c"), "kn-counts")]
    for n in range(ORDER - 1, 0, -1):  # continuation counts: how many characters stand before an n-gram
        every.append(every[-1].groupBy("lang", (F.col("key").bitwiseAND(int(_LOW[n]))).alias("key")).agg(F.count("*").alias("c")).select("lang", F.lit(n).alias("n"), "key", "c"))
        every[-1] = written(every[-1], "kn-counts")
    table = every[0]
    for t in every[1:]:
        table = table.unionByName(t)
    # Discounts by language and order from the counts of counts: 3 numbers for each.
    of = lambda i: F.count(F.when(F.col("c") == i, 1)).cast("double")
    d = table.groupBy("lang", "n").agg(*(of(i).alias(f"n{i}") for i in range(1, 5)))
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    for i in (1, 2, 3):
        value = i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        d = d.withColumn(f"d{i}", F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.least(F.greatest(value, F.lit(0.05)), F.lit(float(i)))).otherwise(F.lit(0.5 * i)))
    d = written(d.select("lang", "n", "d1", "d2", "d3"), "kn-discounts")
    with_d = table.join(d, ["lang", "n"])
    cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    with_d = with_d.withColumn("context", F.shiftright("key", BITS)).withColumn("cut", cut)
    context = written(with_d.groupBy("lang", "n", "context").agg(F.sum("c").alias("total"), F.sum("cut").alias("freed")), "kn-contexts")
    alpha = with_d.join(context, ["lang", "n", "context"]).select("lang", "n", "key", ((F.col("c") - F.col("cut")) / F.col("total")).alias("alpha"))
    gamma = context.select("lang", (F.col("n") - 1).alias("n"), F.col("context").alias("key"), (F.col("freed") / F.col("total")).alias("gamma"))
    base = every[-1].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("alpha")).select("lang", F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), "alpha")
    both = alpha.unionByName(base).join(gamma, ["lang", "n", "key"], "full")
    known = both.select("lang", (F.shiftleft(F.col("n").cast("long"), BITS * ORDER) + F.col("key")).alias("id"), F.coalesce("alpha", F.lit(0.0)).cast("float").alias("alpha"), F.coalesce("gamma", F.lit(1.0)).cast("float").alias("gamma"))
    return known, [*every, d, context]


def squeezed(ids: np.ndarray) -> bytes:
    """Ascending ids as compressed differences, byte by byte of equal weight."""
    planes = np.diff(ids, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 32), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def wanted(keys: np.ndarray) -> np.ndarray:
    """Ids of all that the probabilities of ORDER-grams ``keys`` (distinct) depend on, sorted."""
    out = [keys + _TAG[ORDER]]
    for n in range(ORDER - 1, 0, -1):
        out.append(np.unique(np.concatenate([keys & _LOW[n], (keys >> BITS) & _LOW[n]])) + _TAG[n])
    out.append(np.zeros(1, np.int64))
    return np.sort(np.concatenate(out))


def probabilities(keys: np.ndarray, ids: np.ndarray, alpha: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """The interpolated probability of each ORDER-gram, from what is known of sorted ``ids``; an unknown context passes all
    of its weight on."""

    def look(x, of, other):
        if not len(ids):
            return np.full(len(x), other)
        at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
        return np.where(ids[at] == x, of[at], other)

    p = np.full(len(keys), look(np.zeros(1, np.int64), alpha, 1e-4)[0], np.float64)
    for n in range(1, ORDER + 1):
        p = look((keys & _LOW[n]) + _TAG[n], alpha, 0.0) + look(((keys & _LOW[n]) >> BITS) + _TAG[n - 1], gamma, 1.0) * p
    return p


def _requests(blocks: DataFrame, shards: int, across: bool) -> DataFrame:
    """(shard, block, lang, ids): the distinct ids that a block asks a shard for."""

    def run(it):
        for b in it:
            for block, lang, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words: set[str] = set()
                keys = []
                for part in opened(body.as_py()):
                    if across:
                        keys += [np.unique(x) for x, _ in running(part.column(2).to_pylist())]
                        continue
                    words.update(*map(words_of, part.column(2).to_pylist()))
                    if len(words) > 100_000:
                        keys += [np.unique(grams(x)[0]) for x in parts_of(words)]
                        words.clear()
                keys += [np.unique(grams(x)[0]) for x in parts_of(words)] or [np.zeros(0, np.int64)]
                ids = wanted(np.unique(np.concatenate(keys)))
                shard = (ids >> PREFIX) % 1_000_003 % shards
                by = np.argsort(shard, kind="stable")
                at = np.searchsorted(shard[by], np.arange(shards + 1))
                yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int64()), pa.array([block] * shards, pa.int64()), pa.array([lang] * shards), pa.array([squeezed(ids[by[lo:hi]]) for lo, hi in zip(at, at[1:])], pa.binary())], ["shard", "block", "lang", "ids"])

    return blocks.mapInArrow(tidied(run), "shard long, block long, lang string, ids binary")


def _answers(requests: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """(block, ids, alpha, gamma): the asked ids that the model has, with their values."""

    def run(key, asked, have):
        langs = np.array(have["lang"].to_pylist(), object)
        every = [have[c].to_numpy() for c in ("id", "alpha", "gamma")]
        by_lang = {}
        for lang in set(langs):
            ids, a, g = (x[langs == lang] for x in every)
            by = np.argsort(ids)
            by_lang[lang] = ids[by], a[by], g[by]
        rows = []
        for block, lang, ids in zip(asked["block"].to_pylist(), asked["lang"].to_pylist(), asked["ids"].to_pylist()):
            if lang in by_lang:
                x, a, g = by_lang[lang]
                q = unsqueezed(ids)
                at = np.minimum(np.searchsorted(x, q), len(x) - 1)
                same = x[at] == q
                hit = at[same]
                rows.append((block, squeezed(q[same]), a[hit].astype(np.float32).tobytes(), g[hit].astype(np.float32).tobytes()))
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("block", pa.int64()), ("ids", pa.binary()), ("alpha", pa.binary()), ("gamma", pa.binary())))})

    known = known.withColumn("shard", F.shiftright("id", PREFIX) % 1_000_003 % shards)
    return requests.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(run, "block long, ids binary, alpha binary, gamma binary")


def _scores(blocks: DataFrame, answers: DataFrame, across: bool) -> DataFrame:
    def run(key, docs, got):
        ids = np.concatenate([unsqueezed(x) for x in got["ids"].to_pylist()] or [np.zeros(0, np.int64)])
        alpha, gamma = (np.concatenate([np.frombuffer(x, np.float32) for x in got[c].to_pylist()] or [np.zeros(0, np.float32)]) for c in ("alpha", "gamma"))
        by = np.argsort(ids)
        ids, alpha, gamma = ids[by], alpha[by].astype(np.float64), gamma[by].astype(np.float64)
        out = []
        for lang, body in zip(docs["lang"].to_pylist(), docs["body"]):
            known: dict[str, float] = {}
            for part in opened(body.as_py()):
                if across:
                    n, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                    for keys, number in running(part.column(2).to_pylist()):
                        distinct, at = np.unique(keys, return_inverse=True)
                        logs = np.log(np.maximum(probabilities(distinct, ids, alpha, gamma), 1e-30))
                        n += np.bincount(number, minlength=len(n))
                        total += np.bincount(number, logs[at], len(n))
                    out += [(doc, lang, trusted, size, -s / size if size and len(ids) else None, trusted and held_out(doc)) for doc, trusted, size, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), n.tolist(), total.tolist())]
                    continue
                texts = [words_of(t) for t in part.column(2).to_pylist()]
                if len(known) > 250_000:
                    known.clear()
                new = list(set().union(*texts).difference(known))
                if new and len(ids):
                    keys, word = grams(new)
                    distinct, at = np.unique(keys, return_inverse=True)
                    logs = np.log(np.maximum(probabilities(distinct, ids, alpha, gamma), 1e-30))
                    known.update(zip(new, np.bincount(word, logs[at], len(new)).tolist()))
                for doc, trusted, ws in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                    n = sum(map(units, ws)) + len(ws)
                    out.append((doc, lang, trusted, n, -sum(map(known.__getitem__, ws)) / n if n and len(ids) else None, False))
        del ids, alpha, gamma
        released()
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("doc_id", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("n_units", pa.int64()), ("log_perplexity", pa.float64()), ("held", pa.bool_())))})

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, lang string, trusted boolean, n_units long, log_perplexity double, held boolean")


def scored(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", across: bool = False) -> DataFrame:
    """(doc_id, lang, trusted, n_units, log_perplexity, held) of each row, written. ``trusted``: ids (``id_col``) of trusted documents.
    The n-grams stay within words; or they run ``across`` them, and ``held`` tells the trusted documents that the model is
    estimated without.

    A null language is the language "". Without words, or in a language without trusted words, log_perplexity is null.
    Repeated rows are scored each. A character from U+07C0 on is two units.
    """
    with small_batches(docs.sparkSession):
        return _scored(docs, trusted, id_col, text_col, lang_col, across)


def _scored(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str, across: bool) -> DataFrame:
    ids = written(trusted.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct().withColumn("trusted", F.lit(True)), "kn-trusted")
    # Up to a million ids (8 MB) are broadcast; beyond, the join is a shuffled one.
    near = ids.limit(1_000_001).count() <= 1_000_000
    flagged = docs.select(id_col, text_col, lang_col).join(F.broadcast(ids) if near else ids, id_col, "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    blocks = written(in_blocks(flagged, id_col, text_col, lang_col), "kn-blocks")
    known, made = model(ngram_counts(blocks, across))
    known = written(known, "kn-model")
    dropped(*made)
    shards = max(24, math.ceil(known.count() / 200_000))
    out = written(_scores(blocks, _answers(_requests(blocks, shards, across), known, shards), across), "kn-scores")
    dropped(blocks, known)
    return out


def _slack() -> Column:
    """By what a text's length allows it to exceed the threshold; null for one without units."""
    return F.lit(SLACK) / F.sqrt(F.when(F.col("n_units") > 0, F.col("n_units")))


def _less_slack() -> Column:
    """What is held against the limit."""
    return F.col("log_perplexity") - _slack()


def thresholds(scores: DataFrame, quantile: float = QUANTILE, width: float = WIDTH) -> DataFrame:
    """(lang, limit): by language from the log-perplexities of the trusted documents held out, or of all where none is, by a
    mergeable quantile sketch. Each is less by what its length allows, as when it is held against the limit. Where all of them
    score alike, as one alone does, nothing tells what is usual, and the language has no limit."""
    of = lambda x: F.percentile_approx(x, F.array(F.lit(0.5), F.lit(quantile)), F.lit(10_000))
    known = _less_slack()
    q = F.coalesce(of(F.when(F.col("held"), known)), of(known))
    spread = F.col("q")[1] - F.col("q")[0]
    return scores.where("trusted and log_perplexity is not null").groupBy("lang").agg(q.alias("q")).where(spread > 0).select("lang", (F.col("q")[0] + width * spread).alias("limit"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, width: float = WIDTH, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(``id_col``, lang, log_perplexity, limit, keep) of each row. What can't be scored is kept, and so is a language without
    a threshold. The n-grams run across words; a language of which all trusted documents are held out can't be scored."""
    scores = scored(docs, trusted, id_col, text_col, lang_col, across=True)
    limits = written(thresholds(scores, quantile, width), "kn-limits")
    out = scores.join(limits, "lang", "left")
    # Held against the limit as the trusted documents that made it, so that rounding rejects none of these.
    keep = F.col("log_perplexity").isNull() | F.col("limit").isNull() | (_less_slack() <= F.col("limit"))
    return out.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col), "lang", "log_perplexity", (F.col("limit") + _slack()).alias("limit"), keep.alias("keep"))


def kept(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose id ``classify`` rejects; of repeated ids all go if one does; null ids stay."""
    found = classify(docs, trusted, id_col=id_col, **options)
    gone = written(found.where(~F.col("keep") & F.col(id_col).isNotNull()).select(id_col).distinct(), "kn-gone")
    return restricted(docs, gone, id_col, "left_anti")
