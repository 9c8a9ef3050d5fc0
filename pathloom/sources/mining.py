"""Strings mined from binary data: token scan, property trees, archives of chunks."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The marks that a property file begins with.
PROPERTY_MARKS = (b"PROP", b"PTCH")
LEAST, MOST = 4, 300
_RUN = re.compile(rb"[A-Za-z0-9_./\-]+")


def token_array(text: Column) -> Column:
    """Runs of path characters, trimmed of dots and dashes, of 4 to 300 bytes and with a slash or dot inside."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./\-]+"), F.lit(0)), lambda t: F.btrim(t, F.lit(".-")))
    return F.filter(runs, lambda t: F.length(t).between(LEAST, MOST) & (F.contains(t, F.lit("/")) | F.contains(t, F.lit("."))))


def scan_tokens(rows: DataFrame, text: str) -> DataFrame:
    """``token``: all tokens of a string or binary column, copies included."""
    kind = dict(rows.dtypes)[text]
    column = F.decode(F.col(text), "ISO-8859-1") if kind == "binary" else F.col(text)  # path characters are ASCII
    return rows.select(F.explode(token_array(column)).alias("token"))


def leaves(value) -> Iterator[str]:
    """Every string of a property tree, map keys included; numbers and the like are passed over."""
    open_ = [value]
    while open_:
        v = open_.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            open_ += [*v.keys(), *v.values()]
        elif isinstance(v, list | tuple):
            open_ += v


def tree_strings(rows: DataFrame, column: str) -> DataFrame:
    """``token`` of JSON property trees: each string as it is, and its tokens; what is no JSON is scanned for tokens."""

    def run(batches):
        for batch in batches:
            for text in batch[column].to_pylist():
                if text is None:
                    continue
                try:
                    found = list(leaves(json.loads(text)))
                    whole = [True] * len(found)
                except ValueError:
                    found, whole = [text], [False]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(whole)], names=["literal", "whole"])

    found = rows.select(column).mapInArrow(run, "literal string, whole boolean")
    each = F.concat(F.when(F.col("whole"), F.array("literal")).otherwise(F.array().cast("array<string>")), token_array(F.col("literal")))
    return found.select(F.explode(each).alias("token"))


#: Knows a container: from a seekable stream, each chunk's key, its place in the archive, and a call that reads it.
Splitter = Callable[[BinaryIO], Iterator[tuple[int, int, Callable[[], bytes]]]]
Parser = Callable[[bytes], Iterator[str]]
#: Bytes of an archive whose chunks one task takes.
RANGE = 64 << 20
_MINED = pa.schema([("file", pa.string()), ("chunk", pa.int64()), ("token", pa.string()), ("failed", pa.bool_())])


def zip_chunks(stream: BinaryIO) -> Iterator[tuple[int, int, Callable[[], bytes]]]:
    """Chunks of a ZIP archive: the hash of each member's name, its offset, and a call that reads the member."""
    import xxhash

    archive = zipfile.ZipFile(stream)
    for info in archive.infolist():
        yield xxhash.xxh64_intdigest(info.filename.lower()), info.header_offset, lambda info=info: archive.read(info)


def _opened(path: str):
    """A stream of a file where its store is one that pyarrow knows, else None."""
    from pyarrow import fs

    try:
        system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        return system.open_input_file(inner)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError, OSError):
        return None


def _scanned(data: bytes) -> Iterator[str]:
    for m in _RUN.finditer(data):
        t = m[0].strip(b".-")
        if LEAST <= len(t) <= MOST and (b"/" in t or b"." in t):
            yield t.decode("ascii")


def chunk_strings(data: bytes, parser: Parser | None) -> list[str]:
    """Strings of a chunk: those of a property file, each as it is and its tokens, else the tokens of its bytes."""
    if parser is not None and data[:4] in PROPERTY_MARKS:
        try:
            found = list(parser(data))
            return [*found, *(t for s in found for t in _scanned(s.encode()))]
        except Exception:  # noqa: BLE001  a malformed property file is scanned as bytes
            pass
    return list(_scanned(data))


def mine_archives(spark: SparkSession, paths: str | list[str], splitter: Splitter = zip_chunks, parser: Parser | None = None, range_bytes: int = RANGE) -> DataFrame:
    """``file, chunk, token, failed``: tokens of every chunk of every archive; a row without token tells a chunk (and whether reading it failed).

    ``splitter`` knows the container, ``parser`` property files (by their
    mark); where there is none or it fails, the chunk is scanned for tokens.
    Archives are dealt in ranges of ``range_bytes`` and their chunks read one at
    a time; only where a store is known to nothing but Spark an archive is a
    row with its whole content.
    """

    def mined(file: str, stream: BinaryIO, start: int, end: int) -> Iterator[pa.RecordBatch]:
        for key, at, read in splitter(stream):
            if not start <= at < end:
                continue
            signed = key - (1 << 64) if key >> 63 else key
            try:
                tokens, failed = [None, *set(chunk_strings(read(), parser))], False
            except Exception:  # noqa: BLE001  a chunk that cannot be read is counted, not fatal
                tokens, failed = [None], True
            n = len(tokens)
            yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([signed] * n), pa.array(tokens, type=pa.string()), pa.array([failed] * n)], schema=_MINED)

    def by_range(batches):
        for batch in batches:
            for file, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                with _opened(file) as stream:
                    yield from mined(file, stream, start, start + range_bytes)

    def whole(batches):
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                yield from mined(file, io.BytesIO(content), 0, len(content) + 1)

    ddl = "file string, chunk long, token string, failed boolean"
    files = spark.read.format("binaryFile").load(paths)
    one = files.select("path").first()
    if one is not None and _opened(one["path"]) is None:
        return files.select("path", "content").mapInArrow(whole, ddl)
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length"), F.lit(range_bytes).cast("long"))).alias("start"))
    return ranges.repartition("path", "start").mapInArrow(by_range, ddl)


def mine_report(mined: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``mine_archives``: distinct strings, chunk keys, and one row with the number of chunks that failed."""
    chunks = mined.filter("token is null")
    return mined.filter("token is not null").select("token").distinct(), chunks.select(F.col("chunk").alias("key")).distinct(), chunks.agg(F.coalesce(F.sum(F.col("failed").cast("long")), F.lit(0)).alias("chunks_skipped"))
