"""Media columns: payloads kept as image members of archives, read by a custom data source.

``media_archive`` is a Spark data source over a directory of ZIP archives.

* Sink: every task writes one archive under a name of its own and reports it;
  the driver's commit writes the list of the archives that count.  What a lost
  or repeated task left behind is not on the list and is never read.
* Source: the driver sees archive names and sizes only and plans partitions of
  ``split_bytes``.  A task reads its archive's directory, takes the members
  that begin inside its byte range, streams them as Arrow batches of bounded
  size, and retries every member by itself from its own offset.

A payload is stored as the 8-bit grey samples of a binary PGM image of 576
columns: the same bytes for equal payloads.  Archives deflate their members and
hold a checksum of each, which every read is held against.

Defined cases: a null or empty text becomes one row of 255s (255 never occurs
in UTF-8, so the unpadded length is known from the payload); a null id is kept;
an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import io
import json
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import emit, fresh_dir, pieces, table, texts

#: Samples of an image row, and so the multiple that payloads are padded to.
WIDTH = 576
PAD = b"\xff"
LEVEL = 4


def pad(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of ``WIDTH``."""
    return data + PAD * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def _head(height: int) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, height)


def to_pgm(payload: bytes) -> bytes:
    """8-bit grey image with ``WIDTH`` columns."""
    return _head(len(payload) // WIDTH) + payload


def from_pgm(image: bytes) -> bytes:
    """The samples of an image that ``to_pgm`` made; ``ValueError`` if it is none."""
    fields = image.split(b"\n", 3)
    if len(fields) != 4 or not len(fields[3]) or len(fields[3]) % WIDTH or not image.startswith(_head(len(fields[3]) // WIDTH)):
        raise ValueError("not a grey image of this kind")
    return fields[3]


def features(payload: bytes) -> str:
    """Mean and variance of the samples in thousandths, and which of 64 block means lie over their median."""
    import numpy as np

    samples = np.frombuffer(payload, dtype=np.uint8)
    n = len(samples)
    means = samples.reshape(64, n // 64).sum(axis=1, dtype=np.int64) * 64 // n
    bits = "".join("01"[int(x)] for x in means > np.median(means))
    total, square = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum())
    return f"{1000 * total // n}:{1000 * (n * square - total * total) // (n * n)}:{bits}"


def _open_fs(directory: str):
    """Filesystem and path of a directory, be it local or in a store that pyarrow knows."""
    from pyarrow import fs

    # Hadoop's names of one and the same store
    directory = directory.replace("s3a://", "s3://", 1) if directory.startswith("s3a://") else directory

    if "://" not in directory and not directory.startswith("file:"):
        return fs.LocalFileSystem(), directory
    return fs.FileSystem.from_uri(directory)


_FIELDS = pa.schema([("member", pa.string()), ("content", pa.binary())])
_DDL = "member string, content binary"
LISTING = "_archives.json"


class MediaArchive(DataSource):
    """Options: ``path``; for reads also ``split_bytes`` and ``attempts``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return _DDL

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split_bytes", 32 << 20)), int(self.options.get("attempts", 3)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"])


class ArchiveDone(WriterCommitMessage):
    def __init__(self, name: str, size: int, members: int):
        self.name, self.size, self.members = name, size, members


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> ArchiveDone:
        fs, base = _open_fs(self.path)
        fs.create_dir(base, recursive=True)
        name, members = f"{uuid.uuid4().hex}.zip", 0
        with fs.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(_Forward(out), "w") as archive:
            for batch in batches:
                for member, content in zip(batch["member"].to_pylist(), batch["content"].to_pylist(), strict=True):
                    archive.writestr(zipfile.ZipInfo(member), content, zipfile.ZIP_DEFLATED, LEVEL)
                    members += 1
        return ArchiveDone(name, fs.get_file_info(f"{base}/{name}").size, members)

    def commit(self, messages) -> None:
        fs, base = _open_fs(self.path)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{LISTING}") as out:
            out.write(json.dumps([[m.name, m.size] for m in messages if m and m.members]).encode())

    def abort(self, messages) -> None:
        fs, base = _open_fs(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{base}/{m.name}")


class _Forward(io.RawIOBase):
    """What ``zipfile`` needs of a stream that cannot seek."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at


class ByteRange(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, attempts: int):
        self.path, self.split_bytes, self.attempts = path, split_bytes, attempts

    def partitions(self) -> list[ByteRange]:
        fs, base = _open_fs(self.path)
        with fs.open_input_stream(f"{base}/{LISTING}") as listing:
            archives = json.loads(listing.read())
        return [ByteRange(name, at, min(at + self.split_bytes, size)) for name, size in archives for at in range(0, size, self.split_bytes)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        fs, base = _open_fs(self.path)
        reopen = lambda: zipfile.ZipFile(fs.open_input_file(f"{base}/{partition.name}"))
        with reopen() as archive:
            mine = sorted((m for m in archive.infolist() if partition.start <= m.header_offset < partition.end), key=lambda m: m.header_offset)

            def rows():
                for m in mine:
                    yield m.filename, read_member(archive, m, reopen, self.attempts)

            yield from emit(_FIELDS, rows(), lambda r: len(r[1]))


def read_member(archive: zipfile.ZipFile, member: zipfile.ZipInfo, reopen, attempts: int, pause: float = 0.2) -> bytes:
    """One member's bytes, checked; a failed read is tried again on a new handle, from the member's offset."""
    for left in range(attempts - 1, -1, -1):
        try:
            return archive.read(member)
        except (OSError, zipfile.BadZipFile, zlib.error):
            if not left:
                raise
            time.sleep(pause)
            archive = reopen()
    raise ValueError("attempts must be at least 1")


def to_members(docs: DataFrame) -> DataFrame:
    """``member, content``: every text as an image; the member's name holds the id."""

    def run(batches):
        def rows():
            for batch in batches:
                for part in pieces(batch):
                    for doc_id, data in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                        yield f"{'null' if doc_id is None else doc_id}.pgm", to_pgm(pad(data))

        yield from emit(_FIELDS, rows(), lambda r: len(r[1]))

    return texts(docs).mapInArrow(run, _DDL)


def write_archives(members: DataFrame, path: str) -> None:
    members.sparkSession.dataSource.register(MediaArchive)
    members.write.format("media_archive").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("split_bytes", split_bytes).load(path)


_MEASURED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def measure(members: DataFrame) -> DataFrame:
    """Digests and features of the payload that each member's bytes decode to."""

    def run(batches):
        def rows():
            for batch in batches:
                for member, content in zip(batch["member"].to_pylist(), batch["content"].to_pylist(), strict=True):
                    payload, name = from_pgm(content), member.removesuffix(".pgm")
                    yield None if name == "null" else int(name), len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(content), hashlib.sha256(content).hexdigest(), features(payload)

        yield from emit(_MEASURED, rows(), lambda r: 300)

    return members.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "media")
    write_archives(to_members(table(spark, sf_dir, "documents")), path)
    return measure(read_archives(spark, path))


def _nibble_table() -> list[int]:
    """Remainders that move CRC-32 on by four bits."""
    out = []
    for r in range(16):
        for _ in range(4):
            r = r >> 1 ^ (0xEDB88320 if r & 1 else 0)
        out.append(r)
    return out


OP10_SQL = f"""
with t as (select doc_id, encode(coalesce(text, '')) as data from documents),
p as (select doc_id, octet_length(data) as n_bytes, greatest(1, (octet_length(data) + {WIDTH - 1}) // {WIDTH}) as height, data from t),
q as (select doc_id, n_bytes, height, data || unhex(repeat('FF', cast(height * {WIDTH} - n_bytes as bigint))) as payload from p),
h as (select *, encode('P5' || chr(10) || '{WIDTH} ' || height || chr(10) || '255' || chr(10)) || payload as image, hex(payload) as digits from q),
b as (select *, list_transform(regexp_extract_all(digits, '..'), lambda x: cast('0x' || x as bigint)) as samples,
  list_transform(range(64), lambda i: cast('0x' || substr(right(digits, 64), i + 2 - 2 * (i % 2), 1) as bigint)) as nibbles from h),
m as (select *, len(samples) as n, cast(list_sum(samples) as hugeint) as total, cast(list_sum(list_transform(samples, lambda x: x * x)) as hugeint) as square,
  list_transform(range(64), lambda i: cast(list_sum(samples[i * (len(samples) // 64) + 1 : (i + 1) * (len(samples) // 64)]) as bigint) * 64 // len(samples)) as means from b)
select doc_id, cast(n_bytes as bigint) as n_bytes, cast(n as bigint) as payload_bytes, sha256(payload) as payload_sha256,
  xor(list_reduce(list_prepend(cast(4294967295 as bigint), nibbles), lambda a, x: xor(a >> 4, {_nibble_table()}[(xor(a, x) & 15) + 1])), 4294967295) as tail_crc32,
  cast(octet_length(image) as bigint) as media_bytes, sha256(image) as media_sha256,
  (1000 * total // n) || ':' || (1000 * (n * square - total * total) // (cast(n as hugeint) * n)) || ':' || array_to_string(list_transform(means, lambda x: case when x > list_median(means) then '1' else '0' end), '') as feature
from m
"""
