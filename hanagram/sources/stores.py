"""Small files and folders in any store that Hadoop's file systems reach, and the folder that a session's executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text, or None if there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file under another name and puts it in the place of the old one in one step: a reader sees one or the other."""
    fs, _ = _fs(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    part, to = fs.makeQualified(path_of(f"{path}.{uuid.uuid4().hex}.part")), fs.makeQualified(path_of(path))
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
        stream.hsync()
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), spark._jsc.hadoopConfiguration())
    over = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(part, to, over)


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file only if there is none; whether it did."""
    fs, p = _fs(spark, path)
    try:
        stream = fs.create(p, False)
    except Exception as e:
        if "AlreadyExists" in str(e) or fs.exists(p):
            return False
        raise
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    return True


def age(spark: SparkSession, path: str) -> float | None:
    """Seconds since a file was written, by the store's clock of files; None if there is none."""
    fs, p = _fs(spark, path)
    return (spark._jvm.System.currentTimeMillis() - fs.getFileStatus(p).getModificationTime()) / 1000 if fs.exists(p) else None


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def _chunks(spark: SparkSession, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, so many at a time."""
    if local(path):
        with open(_plain(path), "rb") as f:
            while b := f.read(size):
                yield b
        return
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        while b := bytes(stream.readNBytes(size)):
            yield b
    finally:
        stream.close()


def lines(spark: SparkSession, path: str) -> Iterator[str]:
    """The lines of the text files of a folder, in the order of their names; one is held at a time."""
    fs, p = _fs(spark, path)
    for name in sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile()):
        if name.startswith(("_", ".")):
            continue
        part: list[bytes] = []
        for b in _chunks(spark, f"{path}/{name}"):
            *whole, rest = b.split(b"\n")
            for line in whole:
                yield b"".join([*part, line]).decode("utf-8")
                part = []
            if rest:
                part.append(rest)
        if part:
            yield b"".join(part).decode("utf-8")


class Writer:
    """A new text file, written in pieces."""

    def __init__(self, spark: SparkSession, path: str, size: int = 1 << 20):
        self._size, self._parts, self._held = size, [], 0
        if local(path):
            os.makedirs(os.path.dirname(_plain(path)), exist_ok=True)
            self._out = open(_plain(path), "wb")
        else:
            fs, p = _fs(spark, path)
            self._out = fs.create(p, True)

    def write(self, text: str) -> None:
        self._parts.append(text)
        self._held += len(text)
        if self._held >= self._size:
            self._flush()

    def _flush(self) -> None:
        self._out.write(bytearray("".join(self._parts).encode("utf-8")))
        self._parts, self._held = [], 0

    def close(self) -> None:
        self._flush()
        self._out.close()


def _plain(path: str) -> str:
    return re.sub("^file:(//)?", "", path)


def local(path: str) -> bool:
    """Whether a path is one of this machine's."""
    return not re.match(r"[a-z][a-z0-9+.-]*:", path) or path.startswith("file:")


def shared(spark: SparkSession) -> str:
    """The folder that all executors see (spark.checkpoint.dir). Only a session within one machine's process (master local) may go
    without: it gets one in the temp folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "hanagram")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")
