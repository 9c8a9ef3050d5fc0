"""The binary table format as a data source: header, keys, offsets, lengths, string arena.

Reading plans ranges of entries; a task reads its part of the three arrays and
the arena frames that its entries lie in.  Writing (``write_table_file``) lays a
table out by ranges: tasks make the arrays of a range of keys and the packed
frames of a range of the arena, and what they have made is put end to end, so no
process holds more than a part.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from ..errors import BadMagic, ChecksumMismatch, DuplicateKey, KeyOutOfRange, Malformed, MalformedHeader, PathTooLong, UnsupportedVersion, VerifyError, ZeroFrameSize
from ..functions.keys import unsigned
from ..meta import MAX_PATH_BYTES, Casing, HashKind, KeyWidth, TableMeta
from ..operators.table import arena_offsets, check
from ..session import checkpointed

# Fixed values of the format (little-endian throughout).
MAGIC, VERSION, HEADER_BYTES = b"HASHDB\0\0", 1, 80
LAYOUT = struct.Struct("<8sHBBBB2xQQQQQQQ8x")
COMPRESSED, CASELESS = 1, 2
# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
MAX_FRAME = 1 << 30


@dataclass
class Header:
    meta: TableMeta
    compressed: bool
    offset_width: int
    entries: int
    keys_at: int
    offsets_at: int
    arena_at: int
    arena_bytes: int
    stored_bytes: int
    checksum: int

    def encode(self) -> bytes:
        flags = COMPRESSED * self.compressed | CASELESS * (self.meta.casing is Casing.INSENSITIVE)
        return LAYOUT.pack(MAGIC, VERSION, self.meta.hash_kind, flags, self.meta.key_width, self.offset_width, self.entries, self.keys_at, self.offsets_at, self.arena_at, self.arena_bytes, self.stored_bytes, self.checksum)

    @classmethod
    def decode(cls, data: bytes) -> Header:
        if len(data) < HEADER_BYTES:
            raise MalformedHeader("shorter than a header")
        magic, version, kind, flags, key_width, offset_width, *rest = LAYOUT.unpack(data[:HEADER_BYTES])
        if magic != MAGIC:
            raise BadMagic("no table file")
        if version != VERSION:
            raise UnsupportedVersion(version)
        for ok, what in ((kind in set(HashKind), "hash kind"), (not flags & ~(COMPRESSED | CASELESS), "flags"), (key_width in (4, 8), "key width"), (offset_width in (4, 8), "offset width")):
            if not ok:
                raise MalformedHeader(f"unknown {what}")
        casing = Casing.INSENSITIVE if flags & CASELESS else Casing.SENSITIVE
        return cls(TableMeta(KeyWidth(key_width), HashKind(kind), casing), bool(flags & COMPRESSED), offset_width, *rest)

    @property
    def lengths_at(self) -> int:
        return self.offsets_at + self.entries * self.offset_width

    def sections(self) -> list[tuple[int, int]]:
        return [(self.keys_at, self.entries * self.meta.key_width), (self.offsets_at, self.entries * self.offset_width), (self.lengths_at, self.entries * 2), (self.arena_at, self.stored_bytes)]


def encode_table(pairs: list[tuple[int, str]], meta: TableMeta, frame_size: int | None = 16384, level: int = 3) -> bytes:
    """The file of a few ``(unsigned key, path)`` pairs, held in memory; ``frame_size`` None leaves the arena uncompressed."""
    import numpy as np
    import pyarrow.compute as pc

    given = pa.table({"key": pa.array([k for k, _ in pairs], type=pa.uint64()), "path": pa.array([p for _, p in pairs], type=pa.large_string())})
    table = given.group_by(["key", "path"]).aggregate([]).sort_by([("key", "ascending"), ("path", "ascending")])
    keys, paths = table["key"].to_numpy(), table["path"].combine_chunks()
    twice = np.flatnonzero(keys[1:] == keys[:-1])
    if len(twice):
        raise DuplicateKey(int(keys[twice[0]]))
    if meta.key_width is KeyWidth.U32 and len(keys) and keys[-1] > 0xFFFFFFFF:
        raise KeyOutOfRange(int(keys[np.searchsorted(keys, 0xFFFFFFFF, side="right")]))
    lengths = pc.binary_length(paths).to_numpy(zero_copy_only=False)
    distinct = paths.unique()
    distinct = distinct.take(pc.sort_indices(distinct))
    sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False)
    long = np.flatnonzero(sizes > MAX_PATH_BYTES)
    if len(long):
        raise PathTooLong(int(keys[pc.index(paths, distinct[int(long[0])]).as_py()]), int(sizes[long[0]]))
    if frame_size == 0:
        raise ZeroFrameSize("frames must have a size")
    arena = b"".join(x.as_buffer().to_pybytes() for x in distinct.cast(pa.large_binary()))
    starts = np.cumsum(sizes) - sizes
    offsets = starts[pc.index_in(paths, value_set=distinct).to_numpy(zero_copy_only=False)] if len(keys) else starts
    out = io.BytesIO()
    layout = Layout(meta, len(keys), len(arena), frame_size is not None)
    stored = arena if frame_size is None else seekable(arena, frame_size, level)
    layout.write(out, [[layout.packed(keys, "keys")], [layout.packed(offsets, "offsets")], [layout.packed(lengths, "lengths")], [stored]])
    return out.getvalue()


class Layout:
    """Where the sections of a file stand, and how they are put into it one after the other."""

    def __init__(self, meta: TableMeta, entries: int, arena_bytes: int, compressed: bool):
        self.meta, self.entries, self.arena_bytes, self.compressed = meta, entries, arena_bytes, compressed
        self.offset_width = 4 if arena_bytes <= 0xFFFFFFFF else 8

    def packed(self, values, section: str) -> bytes:
        kind = {"keys": f"<u{int(self.meta.key_width)}", "offsets": f"<u{self.offset_width}", "lengths": "<u2"}[section]
        return values.astype(kind).tobytes()

    def write(self, out, sections, head: Header | None = None) -> Header:
        """Writes the parts of the four sections, and the header before them, if it is known.

        Else that is known at the end, and ``out`` is gone back in to put it there.
        """
        import xxhash

        digest, written, known = xxhash.xxh3_64(), [], head
        out.write(known.encode() if known else bytes(HEADER_BYTES))
        for n, parts in enumerate(sections):
            if n == 1:
                gap = -(HEADER_BYTES + written[0]) % self.offset_width
                out.write(bytes(gap))
            size = 0
            for part in parts:
                out.write(part)
                digest.update(part)
                size += len(part)
            written.append(size)
        offsets_at = HEADER_BYTES + written[0] + gap
        head = Header(self.meta, self.compressed, self.offset_width, self.entries, HEADER_BYTES, offsets_at, offsets_at + written[1] + written[2], self.arena_bytes, written[3], digest.intdigest())
        if known is None:
            out.seek(0)
            out.write(head.encode())
        return head


class _Nowhere:
    """For a first pass over the sections, which only finds the header."""

    def write(self, data: bytes) -> None:
        pass

    def seek(self, at: int) -> None:
        pass


def seekable(data: bytes, frame_size: int, level: int) -> bytes:
    """Zstandard frames of ``frame_size`` raw bytes each, and the table that finds them."""
    import zstandard

    packer, frames, sizes = zstandard.ZstdCompressor(level=level), [], []
    for i in range(0, len(data), frame_size):
        raw = data[i : i + frame_size]
        frames.append(packer.compress(raw))
        sizes.append((len(frames[-1]), len(raw)))
    return b"".join(frames) + seek_table(sizes)


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """What closes an arena of frames of these stored and raw sizes."""
    table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(table)) + table


class TableFile:
    """A table file behind any seekable stream; only what is asked for is read."""

    def __init__(self, stream, size: int):
        self.stream, self.size = stream, size
        self.head = Header.decode(self._at(0, HEADER_BYTES))
        h = self.head
        if not h.compressed and h.arena_bytes != h.stored_bytes:
            raise Malformed("sizes of a raw arena differ")
        for start, n in h.sections():
            if start + n > size:
                raise Malformed("a section ends beyond the file")
        self.frames: list[tuple[int, int, int, int]] = []  # raw start, raw size, stored start, stored size
        self.held: tuple[int, bytes] = (-1, b"")
        if h.compressed:
            self._read_frames()

    def _at(self, start: int, n: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(n)

    def _read_frames(self) -> None:
        h = self.head
        end = h.arena_at + h.stored_bytes
        if h.stored_bytes < 17:
            raise Malformed("no seek table")
        count, flags, mark = struct.unpack("<IBI", self._at(end - 9, 9))
        entry = 12 if flags & 0x80 else 8
        if mark != SEEKABLE or count * entry + 17 > h.stored_bytes:
            raise Malformed("broken seek table")
        table, raw, stored = self._at(end - 9 - count * entry, count * entry), 0, h.arena_at
        for i in range(count):
            packed, size = struct.unpack_from("<II", table, i * entry)
            if size > MAX_FRAME:
                raise Malformed("frame over 1 GiB")
            self.frames.append((raw, size, stored, packed))
            raw, stored = raw + size, stored + packed
        if raw != h.arena_bytes:
            raise Malformed("the frames' sizes are not the arena's")

    def arrays(self, start: int, end: int):
        """Keys, offsets and lengths of entries ``start`` to ``end``."""
        import numpy as np

        h, kw = self.head, int(self.head.meta.key_width)
        read = lambda at, w, kind: np.frombuffer(self._at(at + start * w, (end - start) * w), dtype=kind)
        return read(h.keys_at, kw, f"<u{kw}").astype(np.uint64), read(h.offsets_at, h.offset_width, f"<u{h.offset_width}").astype(np.int64), read(h.lengths_at, 2, "<u2").astype(np.int64)

    def _frame(self, i: int) -> bytes:
        if self.held[0] != i:
            import zstandard

            _, size, at, packed = self.frames[i]
            self.held = (i, zstandard.ZstdDecompressor().decompress(self._at(at, packed), max_output_size=size))
        return self.held[1]

    def text(self, offset: int, length: int) -> bytes | None:
        """An entry's bytes; None if they lie outside the arena or cannot be unpacked."""
        from bisect import bisect_right

        if offset < 0 or offset + length > self.head.arena_bytes:
            return None
        if not self.head.compressed:
            return self._at(self.head.arena_at + offset, length)
        if not length:
            return b""
        parts, i = [], bisect_right(self.frames, offset, key=lambda f: f[0]) - 1
        try:
            while length:
                start = self.frames[i][0]
                part = self._frame(i)[offset - start : offset - start + length]
                if not part and self.frames[i][1]:
                    return None
                parts.append(part)
                offset, length, i = offset + len(part), length - len(part), i + 1
        except Exception:  # noqa: BLE001  a damaged frame is a miss; verify() tells
            return None
        return b"".join(parts)

    def find(self, key: int) -> int | None:
        """Entry of an unsigned key, by bisection of the stored keys."""
        low, high, kw = 0, self.head.entries, int(self.head.meta.key_width)
        while low < high:
            mid = (low + high) // 2
            found = int.from_bytes(self._at(self.head.keys_at + mid * kw, kw), "little")
            if found == key:
                return mid
            low, high = (mid + 1, high) if found < key else (low, mid)
        return None

    def rows(self, start: int, end: int) -> Iterator[tuple[int, str]]:
        """``(signed key, path)`` in arena order; damaged entries are left out, bad UTF-8 is replaced."""
        import numpy as np

        keys, offsets, lengths = self.arrays(start, end)
        for i in np.argsort(offsets, kind="stable").tolist():
            data = self.text(int(offsets[i]), int(lengths[i]))
            if data is not None:
                yield int(keys[i].view(np.int64)), data.decode("utf-8", "replace")

    def verify(self) -> None:
        import numpy as np
        import xxhash

        digest = xxhash.xxh3_64()
        for at, n in self.head.sections():
            digest.update(self._at(at, n))
        if digest.intdigest() != self.head.checksum:
            raise ChecksumMismatch("sections do not match the checksum")
        keys, offsets, lengths = self.arrays(0, self.head.entries)
        if len(keys) > 1 and not (keys[1:] > keys[:-1]).all():
            raise VerifyError("keys do not ascend")
        for i in np.argsort(offsets, kind="stable").tolist():
            data = self.text(int(offsets[i]), int(lengths[i]))
            try:
                if data is None:
                    raise VerifyError(f"entry {i} lies outside the arena")
                data.decode()
            except UnicodeDecodeError as e:
                raise VerifyError(f"entry {i} is not UTF-8") from e


def open_bytes(data: bytes) -> TableFile:
    return TableFile(io.BytesIO(data), len(data))


def open_file(path: str) -> TableFile:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))
    return TableFile(system.open_input_file(inner), system.get_file_info(inner).size)


_SCHEMA = pa.schema([("key", pa.int64()), ("path", pa.string())])


class TableFileSource(DataSource):
    """``format("keyed_table")``. Options: ``path``; reading ``range_entries, pushdown``; writing ``key_width, hash_kind, casing, frame_size, level``."""

    @classmethod
    def name(cls) -> str:
        return "keyed_table"

    def schema(self) -> str:
        return "key long, path string"

    def reader(self, schema) -> DataSourceReader:
        kind = TableFileLookup if self.options.get("pushdown", "false").lower() == "true" else TableFileReader
        return kind(self.options["path"], int(self.options.get("range_entries", 250_000)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TableFileWriter(dict(self.options))


class EntryRange(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class TableFileReader(DataSourceReader):
    def __init__(self, path: str, range_entries: int):
        self.path, self.step, self.wanted = path, range_entries, None

    def partitions(self) -> list[EntryRange]:
        table = open_file(self.path)
        if self.wanted is not None:
            at = sorted({i for k in self.wanted if k is not None and (i := table.find(k & 0xFFFFFFFFFFFFFFFF)) is not None})
            return [EntryRange(i, i + 1) for i in at] or [EntryRange(0, 0)]
        return [EntryRange(i, min(i + self.step, table.head.entries)) for i in range(0, table.head.entries, self.step)] or [EntryRange(0, 0)]

    def read(self, partition: EntryRange) -> Iterator[pa.RecordBatch]:
        table, rows = open_file(self.path), []
        for row in table.rows(partition.start, partition.end):
            rows.append(row)
            if len(rows) == 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


class TableFileLookup(TableFileReader):
    """Finds keys that a filter names by bisection; for sessions that let Python sources see filters."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",) and self.wanted is None:
                self.wanted = [f.value]
            elif isinstance(f, In) and f.attribute == ("key",) and self.wanted is None:
                self.wanted = list(f.value)
            yield f  # Spark checks again, which costs nothing here


def _batch(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    keys, paths = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(paths, type=pa.string())], schema=_SCHEMA)


class Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class TableFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.o = options

    def _fs(self):
        from pyarrow import fs

        path = self.o["path"]
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        pairs = [(k & 0xFFFFFFFFFFFFFFFF, p) for b in batches for k, p in zip(b["key"].to_pylist(), b["path"].to_pylist(), strict=True)]
        o = self.o
        meta = TableMeta(KeyWidth(int(o.get("key_width", 8))), HashKind(int(o.get("hash_kind", 0))), Casing(int(o.get("casing", 1))))
        frame = int(o.get("frame_size", 16384))
        system, path = self._fs()
        staged = f"{path}.{uuid.uuid4().hex}.tmp"
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(staged) as out:
            out.write(encode_table(pairs, meta, None if frame < 0 else frame, int(o.get("level", 3))))
        return Written(staged)

    def commit(self, messages) -> None:
        system, path = self._fs()
        done = [m.path for m in messages if m and m.path]
        if len(done) != 1:
            for p in done:
                system.delete_file(p)
            raise ValueError("a table file is written by one task; coalesce(1) first")
        system.move(done[0], path)

    def abort(self, messages) -> None:
        system, _ = self._fs()
        for m in messages:
            if m and m.path:
                system.delete_file(m.path)


_SECTIONS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("keys", pa.binary()), ("offsets", pa.binary()), ("lengths", pa.binary())])
_FRAMES = pa.schema([("frame", pa.int64()), ("raw", pa.int64()), ("stored", pa.binary())])
#: Bytes of a frame of an arena that is left uncompressed, and rows whose arrays are one piece of a section.
RAW_FRAME, SECTION_ROWS = 1 << 16, 1 << 16


def section_parts(entries: DataFrame, layout: Layout) -> DataFrame:
    """Rows of ``_SECTIONS``: the arrays of entries (``key, offset, length``) by ranges of unsigned keys."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(batches):
            columns = [layout.packed(batch[c].to_numpy().view("u8"), s) for c, s in (("key", "keys"), ("offset", "offsets"), ("length", "lengths"))]
            yield pa.RecordBatch.from_pylist([dict(zip(_SECTIONS.names, (part, seq, *columns), strict=True))], schema=_SECTIONS)

    dealt = entries.repartitionByRange(unsigned(F.col("key"))).sortWithinPartitions(unsigned(F.col("key")))
    return dealt.select("key", "offset", "length").mapInArrow(run, "part int, seq int, keys binary, offsets binary, lengths binary")


def frame_parts(arena: DataFrame, size: int, level: int | None) -> DataFrame:
    """Rows of ``_FRAMES``: the frames of an arena (``path, offset, length``), packed unless ``level`` is None.

    A path that lies in several frames gives each its piece.
    """
    import zstandard

    each = arena.filter("length > 0").select("path", "offset", "length", F.explode(F.expr(f"sequence(offset div {size}, (offset + length - 1) div {size})")).alias("frame"))
    first, last = F.greatest(F.col("frame") * size, "offset"), F.least((F.col("frame") + 1) * size, F.col("offset") + F.col("length"))
    pieces = each.select("frame", first.alias("first"), F.substring(F.encode("path", "UTF-8"), (first - F.col("offset") + 1).cast("int"), (last - first).cast("int")).alias("piece"))

    def run(batches):
        packer = None if level is None else zstandard.ZstdCompressor(level=level)
        now, held, out = None, [], []

        def closed():
            raw = b"".join(held)
            return now, len(raw), raw if packer is None else packer.compress(raw)

        for batch in batches:
            for frame, piece in zip(batch["frame"].to_pylist(), batch["piece"].to_pylist(), strict=True):
                if held and frame != now:
                    out.append(closed())
                    held = []
                now = frame
                held.append(piece)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), _FRAMES, strict=True)], schema=_FRAMES)
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(closed()), _FRAMES, strict=True)], schema=_FRAMES)

    return pieces.repartitionByRange("frame").sortWithinPartitions("frame", "first").select("frame", "piece").mapInArrow(run, "frame long, raw long, stored binary")


def write_table_file(df: DataFrame, path: str, meta: TableMeta, frame_size: int | None = 16384, level: int = 3) -> Header:
    """Lays ``key, path`` rows out as one file; raises as ``check`` does, and for frames of size 0.

    Sorting, layout and packing are the tasks' work and go to the shared
    folder; the driver puts the parts end to end, a partition of them at a time.
    """
    from pyarrow import fs

    pairs = checkpointed(df.select("key", "path").distinct())
    check(pairs, meta)
    if frame_size == 0:
        raise ZeroFrameSize("frames must have a size")
    arena = checkpointed(arena_offsets(pairs))
    layout = Layout(meta, pairs.count(), arena.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], frame_size is not None)
    sections = checkpointed(section_parts(pairs.join(arena, "path"), layout))
    frames = checkpointed(frame_parts(arena, frame_size or RAW_FRAME, level if frame_size else None))

    def of(name: str) -> Iterator[bytes]:
        return (bytes(r[name]) for r in sections.select("part", "seq", name).orderBy("part", "seq").toLocalIterator())

    def stored() -> Iterator[bytes]:
        sizes = []
        for r in frames.orderBy("frame").toLocalIterator():
            sizes.append((len(r["stored"]), r["raw"]))
            yield bytes(r["stored"])
        if layout.compressed:
            yield seek_table(sizes)

    def parts() -> list[Iterator[bytes]]:
        return [of("keys"), of("offsets"), of("lengths"), stored()]

    system, target = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))
    system.create_dir(os.path.dirname(target), recursive=True)
    staged = f"{target}.{uuid.uuid4().hex}.tmp"
    if isinstance(system, fs.LocalFileSystem):
        with open(staged, "wb") as out:
            head = layout.write(out, parts())
    else:  # a store whose streams cannot go back
        head = layout.write(_Nowhere(), parts())
        with system.open_output_stream(staged) as out:
            layout.write(out, parts(), head)
    system.move(staged, target)
    return head


def read_table_file(spark, path: str) -> DataFrame:
    spark.dataSource.register(TableFileSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("keyed_table").option("pushdown", pushdown).load(path)
