"""Line dedup: which lines of which documents go, as compressed keep bitmaps.

A line's key is the line without ASCII white space at its ends, A-Z lowered.
Keys of at least ``min_chars`` code points that stand in at least ``min_docs``
documents lose all their lines except in the largest ``doc_id`` that holds them.

The plan: lines become 128-bit hashes with document and position; these rows
are range-partitioned by (hash, document), so a key that stands everywhere is
spread over many partitions, and sorted by hash, document (largest first) and
position.  Each partition is streamed once.  A key that lies inside a partition
is decided there; what cannot be decided is only the first and the last key of
a partition, for which it also reports how many documents it saw.  Those
reports, two for each partition at most, are what is broadcast.

Defined cases: a null or empty text is one empty line; rows with a null id
count as one document that is smaller than all others; rows of the same id are
one document, so in the largest one all its lines stay; repeated rows are
treated alike.
"""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, emit, pieces, table, text_of, with_text

MIN_CHARS, MIN_DOCS = 40, 5
SPACE = "\t\n\x0b\x0c\r "

_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_hash", pa.int64()), ("pos", pa.int32())])
_SEEN = pa.schema([("kind", pa.int32()), *_LINES, ("n_docs", pa.int64())])
_SEEN_DDL = "kind int, h1 long, h2 long, doc_id long, row_hash long, pos int, n_docs long"
DROPPED, OPEN, REPORT = 0, 1, 2


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row_hash``; the last tells rows of the same id apart."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("row_hash", F.xxhash64("text"))


def line_hashes(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Hash, document and position of every line whose key is long enough."""

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc
        import xxhash

        for batch in batches:
            for part in pieces(batch):
                lines = pc.split_pattern(part["text"], "\n")
                keys = pc.ascii_lower(pc.utf8_trim(lines.flatten(), characters=SPACE))
                at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
                if not len(at):
                    continue
                parent = pc.list_parent_indices(lines).to_numpy()[at]
                pos = at - (lines.offsets.to_numpy() - lines.offsets[0].as_py())[parent]
                digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys.take(pa.array(at)).cast(pa.binary()).to_pylist())), dtype="<i8").reshape(-1, 2)
                owner = pa.array(parent)
                yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), part["doc_id"].take(owner), part["row_hash"].take(owner), pa.array(pos.astype("int32"))], schema=_LINES)

    return rows.mapInArrow(run, "h1 long, h2 long, doc_id long, row_hash long, pos int")


def _stream(min_docs: int):
    """Goes once through a partition's sorted rows; holds a batch, and of a key less than ``min_docs`` documents."""

    def run(batches):
        import numpy as np

        names = [f.name for f in _LINES]
        held = None  # rows of the last key, as long as too few documents are seen
        first = True  # the partition's first key is still open
        key, last_doc, seen, top = None, None, 0, None  # of the key that the next batch may go on with

        def out(kind, cols, pick):
            picked = [c[pick] for c in cols]
            n = len(picked[0])
            arrays = [pa.array(np.full(n, kind, dtype="int32")), pa.array(picked[0]), pa.array(picked[1]), pa.array(picked[2], mask=picked[5]), pa.array(picked[3]), pa.array(picked[4]), pa.array(np.zeros(n, dtype="int64"))]
            return pa.RecordBatch.from_arrays(arrays, schema=_SEEN)

        def report(k, n, doc):
            return pa.RecordBatch.from_pylist([{"kind": REPORT, "h1": k[0], "h2": k[1], "doc_id": doc, "n_docs": n}], schema=_SEEN)

        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch["doc_id"]
            cols = [batch[n].to_numpy(zero_copy_only=False) if n != "doc_id" else doc.fill_null(0).to_numpy() for n in names] + [doc.is_null().to_numpy(zero_copy_only=False)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
                held = None
            h1, h2, ids, _, _, null = cols
            n = len(h1)
            start = np.ones(n, dtype=bool)
            start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            fresh = start.copy()
            fresh[1:] |= (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
            goes_on = key == (h1[0], h2[0]) if key is not None else False
            if key is not None and not goes_on and first:
                yield report(key, seen, top)  # the first key ended with the batch before
                first = False
            runs = np.flatnonzero(start)
            count = np.cumsum(fresh)
            run_of = np.cumsum(start) - 1
            rank = count - count[runs][run_of] + 1
            if goes_on:
                here = run_of == 0
                rank[here] += seen - (1 if last_doc == (ids[0], null[0]) else 0)
            ends = np.append(runs[1:], n) - 1
            total = rank[ends]
            is_first = np.zeros(n, dtype=bool)
            if first:
                is_first = run_of == 0
            tail = run_of == len(runs) - 1
            enough = total[run_of] >= min_docs
            if is_first.any():
                yield out(OPEN, cols, is_first)
            drop = ~is_first & (rank > 1) & enough
            if drop.any():
                yield out(DROPPED, cols, drop)
            if first and len(runs) > 1:
                yield report((h1[0], h2[0]), int(total[0]), top if goes_on else _doc(ids, null, 0))
                first = False
            k = runs[-1]
            if not (goes_on and len(runs) == 1):
                top = _doc(ids, null, k)
            key, last_doc, seen = (h1[-1], h2[-1]), (ids[-1], null[-1]), int(total[-1])
            if not first and total[-1] < min_docs:  # wait for more of this key
                held = [c[tail].copy() for c in cols]
                key, seen = None, 0
        if held is not None:
            cols, key = held, (held[0][0], held[1][0])
            ids, null = held[2], held[5]
            changes = np.ones(len(ids), dtype=bool)
            changes[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
            yield out(OPEN, cols, np.ones(len(ids), dtype=bool))
            yield report(key, int(changes.sum()), _doc(ids, null, 0))
        elif key is not None:
            yield report(key, seen, top)

    return run


def _doc(ids, null, i):
    return None if null[i] else int(ids[i])


def dropped_lines(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, row_hash, pos`` of every line that goes, of rows as ``keyed`` makes them."""
    lines = line_hashes(rows, min_chars)
    dealt = lines.repartitionByRange("h1", "h2", F.col("doc_id").desc_nulls_last())
    ordered = dealt.sortWithinPartitions("h1", "h2", F.col("doc_id").desc_nulls_last(), "row_hash", "pos")
    seen = checkpointed(ordered.mapInArrow(_stream(min_docs), _SEEN_DDL))
    reports = seen.filter(F.col("kind") == REPORT).groupBy("h1", "h2").agg(F.sum("n_docs").alias("total"), F.max("doc_id").alias("top"))
    left = seen.filter(F.col("kind") == OPEN).join(F.broadcast(reports), ["h1", "h2"])
    late = left.filter((F.col("total") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("top")))
    where = ["doc_id", "row_hash", "pos"]
    return seen.filter(F.col("kind") == DROPPED).select(where).unionByName(late.select(where))


def pack_bitmap(positions: list[int]) -> bytes:
    """Compressed bitmap with a 0 for each of the positions; past its end all lines stay."""
    import numpy as np

    keep = np.ones(-(-(max(positions) + 1) // 8) * 8, dtype=bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_bitmap(bitmap: bytes | None, n_lines: int):
    import numpy as np

    keep = np.ones(n_lines, dtype=bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)).astype(bool)[:n_lines]
        keep[: len(bits)] = bits
    return keep


_BITMAPS = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("keep_bitmap", pa.binary())])


def keep_bitmaps(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, row_hash, keep_bitmap`` of the documents that lose lines; all others keep theirs."""

    def run(batches):
        def packed():
            for batch in batches:
                for doc_id, row_hash, positions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield doc_id, row_hash, pack_bitmap(positions)

        yield from emit(_BITMAPS, packed(), lambda r: len(r[2]))

    gone = dropped_lines(rows, min_chars, min_docs).groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("positions"))
    return gone.mapInArrow(run, "doc_id long, row_hash long, keep_bitmap binary")



def apply_bitmaps(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, row_hash, n_lines, n_dropped, keep_bitmap, kept`` for every row, ``kept`` the lines that stay."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep_bitmap", pa.binary()), ("kept", pa.string())])

    def run(batches):
        def kept():
            for batch in batches:
                for part in pieces(batch):
                    for doc_id, text, row_hash, bitmap in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        if bitmap is None:
                            yield doc_id, row_hash, text.count("\n") + 1, 0, None, text
                        else:
                            lines = text.split("\n")
                            keep = unpack_bitmap(bitmap, len(lines))
                            yield doc_id, row_hash, len(lines), len(lines) - int(keep.sum()), bitmap, "\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k)

        yield from emit(schema, kept(), lambda r: len(r[5]))

    b = bitmaps.select(F.col("doc_id").alias("b_doc"), F.col("row_hash").alias("b_row"), "keep_bitmap")
    both = rows.join(b, F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.col("row_hash") == F.col("b_row")), "left")
    return both.select("doc_id", "text", "row_hash", "keep_bitmap").mapInArrow(run, "doc_id long, row_hash long, n_lines long, n_dropped long, keep_bitmap binary, kept string")


def keep_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs``, all its columns, with the dropped lines cut out of ``text`` (and ``n_chars`` counted anew)."""

    @F.pandas_udf("string")
    def kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        def of(t, b):
            if b is None:
                return t
            lines = t.split("\n")
            return "\n".join(x for x, k in zip(lines, unpack_bitmap(b, len(lines)).tolist(), strict=True) if k)

        return pd.Series([of(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)

    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole"), docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("row_hash", F.xxhash64("text"))
    b = bitmaps.select(F.col("doc_id").alias("b_doc"), F.col("row_hash").alias("b_row"), "keep_bitmap")
    both = rows.join(b, F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.col("row_hash") == F.col("b_row")), "left")
    return with_text(both.select("whole", kept("text", "keep_bitmap").alias("text")), docs)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(table(spark, sf_dir, "documents"))
    done = apply_bitmaps(rows, keep_bitmaps(rows))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_STRIPPED = "translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1_SQL = f"""
with lines as (
  select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos,
    unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
keys as (select doc_id, pos, line, {_STRIPPED} as k from lines),
often as (select k, max(doc_id) as top from keys where length(k) >= {MIN_CHARS} group by k having count(distinct doc_id) >= {MIN_DOCS}),
told as (select keys.doc_id, pos, line, often.k is not null and keys.doc_id <> top as gone from keys left join often on keys.k = often.k)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from told group by doc_id
"""
