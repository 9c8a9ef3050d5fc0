import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathloom.functions.hashing import fnv1a32, fnv1a32_bytes, hash_path, hash_text, xxh3, xxh64
from pathloom.functions.keys import format_hex, parse_hex, to_unsigned, unsigned
from pathloom.meta import Casing, HashKind, KeyWidth, TableMeta


def plain_fnv(data: bytes) -> int:
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


def hashed(spark, texts, f):
    return [to_unsigned(r[0]) if r[0] is not None else None for r in spark.createDataFrame([(t,) for t in texts], "p string").select(f(F.col("p"))).collect()]


def test_vectors(spark):
    assert [f"{x:016x}" for x in hashed(spark, ["", "abc", "data/characters/aatrox/aatrox.bin"], xxh64)] == ["ef46db3751d8e999", "44bc2cf5ad770999", "611d601b17222a88"]
    assert f"{hashed(spark, [''], xxh3)[0]:016x}" == "2d06800538d394c2"
    assert f"{hashed(spark, [''], fnv1a32)[0]:08x}" == "811c9dc5"
    assert hashed(spark, [None], xxh64) == hashed(spark, [None], xxh3) == hashed(spark, [None], fnv1a32) == [None]


def test_casing_and_fallback(spark):
    u32, u64 = TableMeta(KeyWidth.U32), TableMeta(KeyWidth.U64)
    assert hashed(spark, ["TEST"], lambda c: hash_path(c, u32)) == [0xAFD071E5]
    sensitive = TableMeta(KeyWidth.U32, HashKind.FNV1A32, Casing.SENSITIVE)
    assert hashed(spark, ["test"], lambda c: hash_path(c, sensitive)) == [0xAFD071E5] != hashed(spark, ["TEST"], lambda c: hash_path(c, sensitive))
    assert hashed(spark, ["É"], lambda c: hash_path(c, u64)) == [xxhash.xxh64_intdigest("é")]
    assert to_unsigned(hash_text("É", u64)) == xxhash.xxh64_intdigest("é")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=600), max_size=12))
def test_fnv_equals_plain(values):
    assert fnv1a32_bytes(pa.array(values, type=pa.binary())).tolist() == [plain_fnv(v) for v in values]


@pytest.mark.parametrize("n", [511, 512, 513])
def test_long_paths(spark, n):
    text = "x" * n
    assert hashed(spark, [text], fnv1a32) == [plain_fnv(text.encode())]
    assert hashed(spark, [text], xxh64) == [xxhash.xxh64_intdigest(text)]


def test_hex(spark):
    df = spark.createDataFrame([("deadbeefdeadbeef",), ("0x0x1F",), ("",), ("g",), ("1" * 17,), ("0x",)], "h string")
    assert [r[0] for r in df.select(parse_hex(F.col("h"))).collect()] == [-2401053088876216593, 31, None, None, None, None]
    assert [r[0] for r in df.limit(2).select(parse_hex(F.col("h"), prefix=False)).collect()] == [-2401053088876216593, None]
    keys = spark.createDataFrame([(-1,), (5,), (-(1 << 63),), (0,)], "k long")
    assert [r[0] for r in keys.select(format_hex(F.col("k"))).collect()] == ["f" * 16, "0" * 15 + "5", "8" + "0" * 15, "0" * 16]
    assert keys.select(format_hex(F.col("k"), 2)).first()[0] == "f" * 16
    assert [r[0] for r in keys.orderBy(unsigned(F.col("k"))).collect()] == [0, 5, -(1 << 63), -1]
