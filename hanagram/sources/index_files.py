"""Index files in the exchange format: one JSON file, or a manifest with shards; formats 2 and 3 are read, 4 is written too.

The marker of the format is ``<name>/<number>``; any name is read, and the name to write is a parameter. What a file holds is
coded and decoded in tasks, in lines of text in the shared folder. A file is one JSON text, so the driver puts these lines
together, and cuts files into such lines, by streams: it holds one piece at a time. Snapshots are the scalable store.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.classes import is_latin
from ..functions.normalize import Normalizer, filter_key_text
from ..operators.index import Index, Schema, numbered, value_ids
from . import stores

MANIFEST = "index.json"
SHARD_SIZE = 32_000
#: Postings of a batch and elements of a line, and characters that are read from a file at a time.
BATCH, CHUNK = 20_000, 1 << 20
_SHARD = re.compile(r"[0-9a-f]{16}\.json")


def _json(x) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def dense(index: Index) -> Index:
    """The index with documents numbered from 0 without gaps. The numbers are as many as the documents: they don't pass the driver
    for a broadcast."""
    n, first, last = index.docs.agg(F.count("*"), F.min("doc"), F.max("doc")).first()
    if not n or (first, last) == (0, n - 1):
        return index
    to = numbered(index.docs.select(F.col("doc").alias("old")), ["old"]).select("old", "doc").persist().hint("merge")
    moved = lambda d: d.withColumnRenamed("doc", "old").join(to, "old").drop("old").select(*d.columns)
    return Index(index.schema, *(moved(d) for d in (index.docs, index.lengths, index.postings, index.filter_values, index.filter_years)))


# --- writing ------------------------------------------------------------------------------------------------------------


@contextmanager
def _work(spark: SparkSession):
    """A folder in the shared one that goes afterwards."""
    to = f"{stores.shared(spark)}/exchange-{uuid.uuid4().hex}"
    try:
        yield to
    finally:
        stores.remove(spark, to)


def _lines(df: DataFrame, run: Callable, work: str) -> Iterator[str]:
    """The lines that ``run`` makes in tasks of the rows of ``df``, in order."""
    to = f"{work}/{uuid.uuid4().hex}"
    df.mapInArrow(run, "value string").write.text(to)
    yield from stores.lines(df.sparkSession, to)
    stores.remove(df.sparkSession, to)


def _elements(df: DataFrame, slot: Column, value: Column, fill: str, work: str, size: int | None = None) -> Iterator[str]:
    """The inside of a JSON array in pieces: values at the places ``slot``, ``fill`` at the others of ``size``."""

    def run(batches):
        for b in batches:
            slots, values = b.column(0).to_pylist(), b.column(1).to_pylist()
            if slots:
                out, at = [], slots[0]
                for s, v in zip(slots, values):
                    out += [fill] * (s - at)
                    out.append(v if isinstance(v, str) and raw else _json(v))
                    at = s + 1
                yield pa.RecordBatch.from_arrays([pa.array([f"{slots[0]}\t{at}\t{','.join(out)}"])], ["value"])

    raw = fill == "[]"  # arrays come as text
    at = 0

    def filled(upto: int) -> Iterator[str]:
        for lo in range(at, upto, BATCH):
            yield ("," if lo else "") + ",".join([fill] * min(BATCH, upto - lo))

    for line in _lines(df.select(slot.alias("slot"), value.alias("value")).orderBy("slot"), run, work):
        first, end, text = line.split("\t", 2)
        yield from filled(int(first))
        yield ("," if int(first) else "") + text
        at = int(end)
    if size is not None:
        yield from filled(size)


def _header(index: Index, name: str, size: int, work: str) -> Iterator[str]:
    """The members from the format to the lengths, in pieces."""
    s = index.schema
    n = len(s.fields)
    boosts = [s.boost(f) for f in s.fields]
    head = {"format": f"{name}/4", "variants": s.normalizer.tables, "variant_digest": s.normalizer.digest, "fields": s.fields, "boosts": [int(b) if b == int(b) else b for b in boosts]}
    yield _json(head)[:-1] + ',"refs":['
    yield from _elements(index.docs, F.col("doc"), F.col("ref"), "null", work)
    yield '],"lengths":['
    yield from _elements(index.lengths, F.col("doc") * n + F.col("field"), F.col("len"), "0", work, n * size)
    yield "]"


def _filters(index: Index, size: int, work: str) -> Iterator[str]:
    """The member of the filters, in pieces."""
    yield ',"filters":{'
    for i, (name, spec) in enumerate(index.schema.filters.items()):
        yield f"{',' if i else ''}{_json(name)}:{{" + f'"kind":{_json(spec["kind"])}'
        if spec["kind"] == "year":
            yield ',"docs":['
            yield from _elements(index.filter_years.where(F.col("name") == name), F.col("doc"), F.col("year"), "null", work, size)
        else:
            values = numbered(value_ids(index, name), ["rank"], "number").persist()
            yield ',"values":['
            yield from _elements(values, F.col("number"), F.col("display"), "null", work)
            own = index.filter_values.where(F.col("name") == name).select("key", "doc", "ord").join(values.select("key", "number"), "key")
            docs = own.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("ord", "number"))).alias("vs"))
            yield '],"docs":['
            yield from _elements(docs, F.col("doc"), F.to_json(F.transform("vs", lambda v: v["number"])), "[]", work, size)
            values.unpersist()
        yield "]" + (f',"separator":{_json(spec["separator"])}' if spec["kind"] == "value" and "separator" in spec else "") + "}"
    yield "}"


def posting_texts(index: Index, work: str) -> Iterator[tuple[str, bool, str]]:
    """(token, whether it begins, a piece of its encoded list) in code point order. Lists are coded in tasks, a frequent token's in
    many: only the gap at the front of a piece, which depends on the one before, is left to the driver."""
    n = len(index.schema.fields)

    def run(batches):
        for b in batches:
            tokens, keys, positions = (c.to_pylist() for c in b.columns)
            out = []
            for token, some in itertools.groupby(zip(tokens, keys, positions), lambda r: r[0]):
                some = [r[1:] for r in some]
                out.append(f"{_json(token)}\t{some[0][0]}\t{some[-1][0]}\t{codec.tail(some)}")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    ordered = index.postings.select("token", (F.col("doc") * n + F.col("field")).alias("key"), "positions").orderBy("token", "key")
    now, before = None, -1
    for line in _lines(ordered, run, work):
        token, first, last, text = line.split("\t", 3)
        new = token != now
        if new:
            now, before = token, -1
        yield json.loads(token), new, codec.number(int(first) - before - 1) + text
        before = int(last)


class _File:
    """A file beside its place, put into it when it is whole."""

    def __init__(self, folder: Path):
        self.part, self.sum, self.size = folder / f"{uuid.uuid4().hex}.tmp", hashlib.sha256(), 0
        self._out = open(self.part, "wb")

    def write(self, text: str) -> None:
        b = text.encode("utf-8")
        self.sum.update(b)
        self.size += len(b)
        self._out.write(b)

    def close(self, to: Path) -> None:
        self._out.flush()
        os.fsync(self._out.fileno())
        self._out.close()
        os.replace(self.part, to)

    def by_content(self, folder: Path) -> str:
        """Closes it under the name of its content; returns that. A file that is there is left alone."""
        name = self.sum.hexdigest()[:16] + ".json"
        if (folder / name).exists() and (folder / name).stat().st_size == self.size:
            self.drop()
        else:
            self.close(folder / name)
        return name

    def drop(self) -> None:
        self._out.close()
        self.part.unlink(missing_ok=True)


@contextmanager
def _files(folder: Path):
    """Makes files in ``folder``; what isn't in its place at the end goes."""
    made: list[_File] = []

    def new() -> _File:
        made[:] = [f for f in made if f.part.exists()]
        made.append(_File(folder))
        return made[-1]

    try:
        yield new
    finally:
        for f in made:
            f.drop()


def write_file(index: Index, path: str, name: str = "hanagram") -> None:
    """One JSON file, written piece by piece and renamed into place."""
    index = dense(index)
    size = index.docs.count()
    with _work(index.spark) as work, _files(Path(path).parent) as new:
        f = new()
        for text in _header(index, name, size, work):
            f.write(text)
        f.write(',"tokens":{')
        some = False
        for token, begins, text in posting_texts(index, work):
            if begins:
                f.write(('",' if some else "") + _json(token) + ':"')
                some = True
            f.write(text)  # digits need no escapes
        f.write('"}' if some else "}")
        if index.schema.filters:
            for text in _filters(index, size, work):
                f.write(text)
        f.write("}")
        f.close(Path(path))


def write_split(index: Index, folder: str, shard_size: int = SHARD_SIZE, name: str = "hanagram") -> None:
    """Shards and the list of Latin tokens first, unchanged ones left alone, then the manifest; shards that it doesn't list go.

    Tokens go in order into a shard until the next would carry it beyond ``shard_size`` bytes; files are named by content.
    """
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    index = dense(index)
    count = index.docs.count()
    shards: list[list[str]] = []
    with _work(index.spark) as work, _files(to) as new:
        latin, words = new(), 0
        latin.write("[")
        shard, first, size = None, "", 0
        held: list[str] = []  # of a token that isn't in a shard yet
        own = 0

        def closed() -> None:
            nonlocal shard, size
            if shard is not None:
                shard.write("}")
                shards.append([first, shard.by_content(to)])
            shard, size = None, 0

        def placed(token: str) -> None:
            """Puts what is held of a token into the shard, or into a new one."""
            nonlocal shard, first, size, own
            if size and size + own > shard_size:
                closed()
            if shard is None:
                shard, first = new(), token
                shard.write("{")
            elif size:
                shard.write(",")
            shard.write("".join(held))
            held.clear()

        def ended(token: str) -> None:
            nonlocal own, size
            own += 1
            if open_:
                shard.write('"')
            else:
                held.append('"')
                placed(token)
            size += own + 1

        token, open_ = None, False  # open_: whether the token's beginning is in the shard
        for t, begins, text in posting_texts(index, work):
            if begins:
                if token is not None:
                    ended(token)
                token, open_ = t, False
                held.append(f'{_json(t)}:"')
                own = len(held[0].encode())
                if is_latin(t):
                    latin.write(f"{',' if words else ''}{_json(t)}")
                    words += 1
            own += len(text)
            if open_:
                shard.write(text)
                continue
            held.append(text)
            if own > shard_size:  # it goes beyond the shard in any case
                placed(token)
                open_ = True
        if token is not None:
            ended(token)
        closed()
        latin.write("]")
        names = latin.by_content(to)
        f = new()
        for text in _header(index, name, count, work):
            f.write(text)
        f.write(f',"latin":{_json(names)},"shards":[')
        for i, s in enumerate(shards):
            f.write(("," if i else "") + _json(s))
        f.write("]")
        if index.schema.filters:
            for text in _filters(index, count, work):
                f.write(text)
        f.write("}")
        f.close(to / MANIFEST)
    kept = {s[1] for s in shards} | {names}
    for p in to.iterdir():
        if _SHARD.fullmatch(p.name) and p.name not in kept:
            p.unlink()


# --- reading ------------------------------------------------------------------------------------------------------------

_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'
_SIMPLE = rf"{_STRING}|\[[^\[\]]*\]|[^\s,\[\]{{}}\"]+"
_ELEMENT = re.compile(rf"\s*({_SIMPLE})\s*([,\]])", re.S)
_MEMBER = re.compile(rf"\s*({_STRING})\s*:\s*({_SIMPLE})\s*([,}}])", re.S)
_KEY = re.compile(rf"\s*({_STRING})\s*:", re.S)
_MARK = re.compile(r"\s*([^\s])")


class _Scan:
    """A JSON text read in pieces. Values are taken whole, or, where they are long arrays and objects of simple values, one
    element at a time."""

    def __init__(self, f):
        self._f, self._text, self._at = f, "", 0

    def _more(self) -> None:
        rest = self._text[self._at :]
        new = self._f.read(max(CHUNK, len(rest)))
        if not new:
            raise ValueError("the JSON text ends too early")
        self._text, self._at = rest + new, 0

    def take(self, pattern: re.Pattern) -> re.Match:
        while True:
            m = pattern.match(self._text, self._at)
            if m:
                self._at = m.end()
                return m
            if len(self._text) - self._at > CHUNK and not re.match(r"\s*[\"\[\w-]", self._text[self._at : self._at + 100]):
                raise ValueError(f"no JSON at {self._text[self._at : self._at + 20]!r}")
            self._more()

    def mark(self, *of: str) -> str:
        c = self.take(_MARK)[1]
        if c not in of:
            raise ValueError(f"{c!r} where JSON has one of {of}")
        return c

    def peek(self) -> str:
        c = self.take(_MARK)
        self._at -= 1
        return c[1]

    def value(self):
        """Any value, whole."""
        self.peek()
        while True:
            try:
                x, end = json.JSONDecoder().raw_decode(self._text, self._at)
                if end < len(self._text):
                    self._at = end
                    return x
            except json.JSONDecodeError:
                pass
            self._more()

    def members(self) -> Iterator[str]:
        """The keys of an object; their values are to be taken in between."""
        self.mark("{")
        if self.peek() == "}":
            self.mark("}")
            return
        while True:
            yield json.loads(self.take(_KEY)[1])
            if self.mark(",", "}") == "}":
                return

    def skip(self) -> None:
        """Passes over a value of arrays of simple values and objects of these."""
        c = self.peek()
        if c == "[":
            for _ in self.items(_ELEMENT):
                pass
        elif c == "{":
            for _ in self.members():
                self.skip()
        else:
            self.value()

    def items(self, pattern: re.Pattern) -> Iterator[re.Match]:
        """The elements of an array, or the members of an object."""
        end = {"[": "]", "{": "}"}[self.mark("[", "{")]
        if self.peek() == end:
            self.mark(end)
            return
        while (m := self.take(pattern))[m.lastindex] != end:
            yield m
        yield m


def _cut_array(scan: _Scan, out: stores.Writer) -> int:
    """Writes an array as lines (place of the first, some elements as JSON); returns how many elements there are."""
    n, part, size = 0, [], 0

    def put() -> None:
        nonlocal part, size
        out.write(f"{n - len(part)}\t[{','.join(part)}]\n".replace("\r", " "))
        part, size = [], 0

    for m in scan.items(_ELEMENT):
        n += 1
        part.append(m[1].replace("\n", " "))
        size += len(m[1])
        if len(part) >= BATCH or size >= CHUNK:
            put()
    if part:
        put()
    return n


def _cut_tokens(scan: _Scan, out: stores.Writer) -> None:
    """Writes the members of tokens as lines (token, list)."""
    for m in scan.items(_MEMBER):
        out.write(f"{m[1]}\t{m[2]}".replace("\n", " ") + "\n")


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def _slots(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(slot, value) of an array that was cut."""
    start = F.substring_index("value", "\t", 1).cast("long")
    each = F.from_json(F.expr("substring(value, instr(value, '\\t') + 1)"), f"array<{kind}>", {"mode": "FAILFAST"})
    return _text(spark, path).select(start.alias("start"), F.posexplode(each).alias("i", "value")).select((F.col("start") + F.col("i")).alias("slot"), "value")


def _postings(spark: SparkSession, path: str, n: int) -> DataFrame:
    def run(batches):
        names = ["token", "doc", "field", "tf", "positions"]
        for b in batches:
            for line in b.column(0):
                token, text = map(json.loads, line.as_py().split("\t", 1))
                entries = codec.decoded(text, n) if isinstance(text, str) else iter(codec.decode_flat(text))
                while some := list(itertools.islice(entries, BATCH)):
                    docs, fields, positions = zip(*some)
                    yield pa.RecordBatch.from_arrays([pa.array([token] * len(some)), pa.array(docs, pa.int64()), pa.array(fields, pa.int32()), pa.array(list(map(len, positions)), pa.int32()), pa.array(positions, pa.list_(pa.int32()))], names)

    return _text(spark, path).mapInArrow(run, "token string, doc long, field int, tf int, positions array<int>")


def _scanned(spark: SparkSession, path: Path, work: str, only: set[str] | None = None) -> dict:
    """The members of a JSON file: short ones themselves, of long ones how many elements they have; these are cut into lines in
    ``work``. With ``only`` the other members are skipped."""
    out: dict = {}
    with open(path, encoding="utf-8") as f:
        scan = _Scan(f)
        if scan.peek() != "{":
            raise ValueError(f"{path} holds no index: {type(scan.value()).__name__!r}")

        def cut(name: str, by):
            to = stores.Writer(spark, f"{work}/{name}")
            try:
                return by(scan, to)
            finally:
                to.close()

        for key in scan.members():
            if only is not None and key not in only and scan.peek() in "[{":
                scan.value() if key == "shards" else scan.skip()
            elif key in ("refs", "lengths"):
                out[key] = cut(key, _cut_array)
            elif key == "tokens":
                cut("tokens/0", _cut_tokens)
                out[key] = True
            elif key == "filters" and scan.peek() == "{":
                out[key] = {}
                for i, name in enumerate(scan.members()):
                    spec = out[key][name] = {"at": i}
                    for k in scan.members():
                        spec[k] = cut(f"{k}-{i}", _cut_array) if k in ("values", "docs") else scan.value()
            else:
                out[key] = scan.value()
    return out


def latin_words(spark: SparkSession, folder: str) -> DataFrame:
    """(token): the list of Latin words of a split index."""
    work = f"{stores.shared(spark)}/exchange-{uuid.uuid4().hex}"
    name = _scanned(spark, Path(folder) / MANIFEST, work, {"latin"})["latin"]
    with open(Path(folder) / name, encoding="utf-8") as f:
        to = stores.Writer(spark, f"{work}/latin")
        _cut_array(_Scan(f), to)
        to.close()
    return _slots(spark, f"{work}/latin", "string").select(F.col("value").alias("token"))


def read(spark: SparkSession, path: str, normalizer: Normalizer | None = None, only: list[str] | None = None) -> Index:
    """An index from a file, or from a folder with a manifest. ``only`` reads just the shards that may hold these tokens. The lines
    that the file is cut into stay in the shared folder, for the tables are read from there."""
    p = Path(path)
    folder = p if p.is_dir() else None
    work = f"{stores.shared(spark)}/exchange-{uuid.uuid4().hex}"
    data = _scanned(spark, p / MANIFEST if folder else p, work)
    if not re.fullmatch(r"[\w-]+/([234])", str(data.get("format"))):
        raise ValueError(f"{path} holds no index of format 2 to 4: {data.get('format')!r}")
    if "tokens" not in data:
        folder = folder or p.parent
        firsts = [s[0] for s in data["shards"]]
        wanted = range(len(firsts))
        if only is not None:
            import bisect

            wanted = sorted({i for t in only if (i := bisect.bisect_right(firsts, t) - 1) >= 0})
        to = stores.Writer(spark, f"{work}/tokens/0")
        for i in wanted:
            with open(folder / data["shards"][i][1], encoding="utf-8") as f:
                _cut_tokens(_Scan(f), to)
        to.close()
    normalizer = normalizer or Normalizer(data.get("variants") or ())
    normalizer.check(data.get("variants"), data.get("variant_digest"))
    fields = data["fields"]
    n = len(fields)
    if data["lengths"] != n * data["refs"]:
        raise ValueError(f"the index has {data['lengths']} lengths for {data['refs']} documents")
    filters = data.get("filters") or {}
    specs = {k: {x: f[x] for x in ("kind", "separator") if x in f} for k, f in filters.items()}
    schema = Schema(fields, dict(zip(fields, data["boosts"])), specs, normalizer)
    key = F.udf(lambda v: filter_key_text(normalizer, v), "string")
    values = spark.createDataFrame([], "name string, doc long, ord int, key string, display string")
    years = spark.createDataFrame([], "name string, doc long, year int")
    for name, f in filters.items():
        docs = f"{work}/docs-{f['at']}"
        if f["kind"] == "year":
            own = _slots(spark, docs, "int").where("value is not null")
            years = years.unionByName(own.select(F.lit(name).alias("name"), F.col("slot").alias("doc"), F.col("value").alias("year")))
        else:
            forms = _slots(spark, f"{work}/values-{f['at']}", "string").select(F.col("slot").alias("v"), F.col("value").alias("display"), key("value").alias("key"))
            own = _slots(spark, docs, "array<long>").select(F.col("slot").alias("doc"), F.posexplode("value").alias("ord", "v")).join(forms, "v")
            values = values.unionByName(own.select(F.lit(name).alias("name"), "doc", "ord", "key", "display"))
    lengths = _slots(spark, f"{work}/lengths", "int")
    return Index(
        schema,
        _slots(spark, f"{work}/refs", "string").select(F.col("slot").alias("doc"), F.col("value").alias("ref")),
        lengths.select(F.expr(f"slot div {n}").alias("doc"), (F.col("slot") % n).cast("int").alias("field"), F.col("value").alias("len")),
        _postings(spark, f"{work}/tokens", n),
        values,
        years,
    )
