"""Path hashes as columns: seed-0 xxh64 in the JVM, fnv1a32 and xxh3 over Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..meta import Casing, HashKind, KeyWidth, TableMeta

_FNV_BASIS, _FNV_PRIME = 2166136261, 16777619


def fnv1a32_bytes(values: pa.Array):
    """FNV-1a of every binary value, all values one byte further at a time; nulls hash as empty."""
    import numpy as np

    # longest first, so that what still has bytes left is always a prefix
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = at[:-1][order], lengths[order]
    state = np.full(len(order), _FNV_BASIS, dtype=np.uint64)
    left = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
    for k, n in enumerate(left.tolist()):
        state[:n] = ((state[:n] ^ raw[starts[:n] + k]) * np.uint64(_FNV_PRIME)) & np.uint64(0xFFFFFFFF)
    out = np.empty(len(order), dtype=np.int64)
    out[order] = state.view(np.int64)
    return out


@F.arrow_udf(LongType())
def _fnv1a32(path: pa.Array) -> pa.Array:
    return pa.array(fnv1a32_bytes(path.cast(pa.binary())), mask=path.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(LongType())
def _xxh3(path: pa.Array) -> pa.Array:
    import xxhash

    return pa.array([None if p is None else _signed(xxhash.xxh3_64_intdigest(p)) for p in path.cast(pa.binary()).to_pylist()], type=pa.int64())


@F.arrow_udf(LongType())
def _xxh64(path: pa.Array) -> pa.Array:
    import xxhash

    return pa.array([None if p is None else _signed(xxhash.xxh64_intdigest(p)) for p in path.cast(pa.binary()).to_pylist()], type=pa.int64())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def xxh64(path: Column) -> Column:
    """xxh64 with seed 0 (the built-in function has another seed); a null path has a null hash."""
    spark = SparkSession.getActiveSession()
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:  # no JVM in reach: a remote session
        return _xxh64(path)
    from pyspark.sql.classic.column import Column as ClassicColumn

    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    children = jvm.org.apache.spark.api.python.PythonUtils.toSeq([utils.expression(path._jc)])
    hashed = ClassicColumn(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(children, 0)))
    return F.when(path.isNotNull(), hashed)


def fnv1a32(path: Column) -> Column:
    return _fnv1a32(path)


def xxh3(path: Column) -> Column:
    return _xxh3(path)


def cased(path: Column, casing: Casing) -> Column:
    return F.lower(path) if casing is Casing.INSENSITIVE else path


def hash_path(path: Column, meta: TableMeta) -> Column:
    """The key that a table of this kind has for a path."""
    text = cased(path, meta.casing)
    algorithm = meta.algorithm
    if algorithm is HashKind.FNV1A32:
        return fnv1a32(text)
    key = xxh64(text) if algorithm is HashKind.XXH64 else xxh3(text)
    return key.bitwiseAND(F.lit(0xFFFFFFFF)) if meta.key_width is KeyWidth.U32 else key


def hash_text(path: str, meta: TableMeta) -> int:
    """``hash_path`` of one string, on the driver, as a signed key."""
    import xxhash

    data = (path.lower() if meta.casing is Casing.INSENSITIVE else path).encode()
    if meta.algorithm is HashKind.FNV1A32:
        return int(fnv1a32_bytes(pa.array([data], type=pa.binary()))[0])
    x = (xxhash.xxh64_intdigest if meta.algorithm is HashKind.XXH64 else xxhash.xxh3_64_intdigest)(data)
    return x & 0xFFFFFFFF if meta.key_width is KeyWidth.U32 else _signed(x)
