import random

import pytest
from pyspark.sql import functions as F

from pathloom.errors import BuildError, DuplicateKey, KeyOutOfRange, MergeConfig, PathTooLong, VerifyError
from pathloom.meta import Casing, HashKind, KeyWidth, TableMeta
from pathloom.operators.layered import ExtendedTable, LayeredTable, resolve
from pathloom.operators.table import KeyedTable, arena_offsets, check, descents, frame_ids, merge_lists, merge_report, placed_in_order, running
from pathloom.sources.tablefile import Layout, _Nowhere, encode_table, open_file, write_table_file

U64 = TableMeta(KeyWidth.U64, HashKind.XXH64)
ROWS = [(1, "assets/characters/aatrox/aatrox.bin"), (0xDEADBEEFDEADBEEF - (1 << 64), "assets/characters/ahri/skins/skin11/ahri_skin11.dds"), (0x123456789ABCDEF0, "data/final/champions/zed.wad.client"), (-1, "x.png")]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "key long, path string")


def table(spark, rows=ROWS, meta=U64):
    return KeyedTable.build(pairs(spark, rows), meta)


def test_point_and_batch(spark):
    t = table(spark)
    assert t.get(0xDEADBEEFDEADBEEF).endswith("skin11.dds") and t.get(0xFFFFFFFFFFFFFFFF) == "x.png" and t.get(5) is None
    probes = spark.createDataFrame([(0, -1), (1, 5), (2, 1), (3, -1)], "ord int, key long")
    got = t.get_batch(probes).orderBy("ord").collect()
    assert [r["path"] for r in got] == ["x.png", None, ROWS[0][1], "x.png"] and [r["hit"] for r in got] == [True, False, True, True]
    assert [r["known"] for r in t.contains(probes).orderBy("ord").collect()] == [True, False, True, True]
    assert t.known(probes).count() == 3 and t.unknown(probes).count() == 1


def test_empty_path_is_a_hit(spark):
    t = table(spark, [(9, "")])
    assert t.get(9) == ""
    r = t.get_batch(spark.createDataFrame([(9,)], "key long")).first()
    assert r["path"] == "" and r["hit"]


def test_build_checks(spark):
    assert len(table(spark, [(7, "a"), (7, "a")])) == 1
    with pytest.raises(DuplicateKey) as e:
        table(spark, [(7, "a"), (7, "b"), (-2, "a"), (-2, "c")])
    assert e.value.key == 7
    with pytest.raises(KeyOutOfRange) as e:
        table(spark, [(1 << 32, "a")], TableMeta(KeyWidth.U32))
    assert e.value.key == 1 << 32
    with pytest.raises(PathTooLong) as e:
        table(spark, [(3, "z" * 65536), (4, "é" * 32768)])
    assert (e.value.key, e.value.length) == (3, 65536)
    table(spark, [(3, "z" * 65535)])
    check(pairs(spark, []), U64)


def test_order_stats_verify(spark, tmp_path):
    t = table(spark, [(50, "b/2"), (10, "c/3"), (30, "a/1"), (31, "a/1")])
    assert [r["path"] for r in t.in_path_order().collect()] == ["a/1", "a/1", "b/2", "c/3"]
    assert t.stats().first().asDict() == {"entries": 4, "paths": 3, "arena_bytes": 9, "longest": 3}
    t.verify(t.checksum())
    t.write(str(tmp_path / "t"))
    again = KeyedTable.open(spark, str(tmp_path / "t"))
    assert again.checksum() == t.checksum() and again.meta == t.meta and again.resident() == {50: "b/2", 10: "c/3", 30: "a/1", 31: "a/1"}
    with pytest.raises(VerifyError):
        KeyedTable(pairs(spark, [(1, "a"), (1, "b")]), U64).verify()
    assert KeyedTable.of_paths(spark.createDataFrame([("a/B",)], "path string"), U64).mismatches().count() == 0 and t.mismatches().count() == 4
    assert len(table(spark, [])) == 0 and table(spark, []).stats().first()["entries"] == 0


def test_arena(spark):
    got = {r["path"]: (r["offset"], r["length"]) for r in arena_offsets(pairs(spark, [(1, "b"), (2, "aa"), (3, "b"), (4, ""), (5, "é")])).collect()}
    assert got == {"": (0, 0), "aa": (0, 2), "b": (2, 1), "é": (3, 2)}
    frames = {r["path"]: (r["first_frame"], r["last_frame"]) for r in frame_ids(arena_offsets(pairs(spark, [(1, "aaa"), (2, "bbb")])), 4).collect()}
    assert frames == {"aaa": (0, 0), "bbb": (0, 1)}


def test_layers(spark):
    base0, base1 = table(spark, [(1, "b0-1"), (2, "b0-2"), (10, "")]), table(spark, [(2, "b1-2"), (3, "b1-3")])
    t = LayeredTable(spark, [base0, base1])
    t.insert(1, "over")
    probes = spark.createDataFrame(list(enumerate([1, 2, 3, 999, 10, 1])), "ord int, key long")
    got = t.get_batch(probes).orderBy("ord").collect()
    assert [r["path"] for r in got] == ["over", "b0-2", "b1-3", None, "", "over"] and [r["layer"] for r in got] == [0, 1, 2, None, 1, 0]
    assert [t.get(k) for k in (1, 2, 3, 999, 10)] == ["over", "b0-2", "b1-3", None, ""] and t.contains(3) and not t.contains(4)
    with pytest.raises(MergeConfig):
        t.push_base(table(spark, [(1, "x")], TableMeta(KeyWidth.U64, HashKind.XXH3)))
    with pytest.raises(MergeConfig):
        t.push_base(table(spark, [(1, "x")], TableMeta(KeyWidth.U64, HashKind.XXH64, Casing.SENSITIVE)))
    assert LayeredTable(spark).insert_path("x") is None
    e = ExtendedTable(base0)
    assert e.get(e.insert_path("New/Path")) == "New/Path" and e.overlay_len == 1 and e.base is base0
    assert resolve(probes, []).filter("path is null").count() == 6


def test_merge(spark):
    one = spark.createDataFrame([("0b", 11, "z"), ("0b", 11, "a")], "hex string, key long, path string")
    two = spark.createDataFrame([("000b", 11, "a"), ("1", 1, "q ")], "hex string, key long, path string")
    merged = merge_lists([one, two])
    assert {tuple(r) for r in merged.collect()} == {(11, "z"), (11, "a"), (1, "q ")}
    assert merge_report(merged, [one, two]).first().asDict() == {"entries": 3, "conflicts": 1, "digits": 4}


def test_errors_are_build_errors():
    assert issubclass(DuplicateKey, BuildError) and F is not None


def test_table_file_made_by_many_tasks(spark, tmp_path):
    """Files laid out by ranges equal those made in memory, with paths over several frames, shared paths and empty ones."""
    r = random.Random(4)
    pairs = {((r.getrandbits(64)), r.choice(["", "shared", "ü" * r.randint(1, 90), f"a/{r.random()}/" + "x" * r.randint(0, 200)])) for _ in range(700)}
    pairs = list({k: (k, p) for k, p in pairs}.values())
    signed = [(k - (1 << 64) if k >> 63 else k, p) for k, p in pairs]
    df = spark.createDataFrame([*signed, signed[0]], "key long, path string").repartition(6)
    for size in (None, 64, 1 << 14):
        path = str(tmp_path / f"t{size}.lhdb")
        head = write_table_file(df, path, TableMeta(), size)
        whole = encode_table(pairs, TableMeta(), size)
        with open(path, "rb") as f:
            assert f.read() == whole
        opened = open_file(path)
        opened.verify()
        assert opened.head == head and sorted(opened.rows(0, head.entries)) == sorted(signed)
    layout = Layout(TableMeta(), 0, 0, False)
    assert layout.write(_Nowhere(), [[], [], [], []]).entries == 0
    none = str(tmp_path / "none.lhdb")
    write_table_file(df.limit(0), none, TableMeta())
    assert open_file(none).head.entries == 0 and encode_table([], TableMeta()) == open(none, "rb").read()


def test_ranks_sums_and_descents_over_ranges(spark):
    rows = [(i, (i * 37) % 101, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "at long, key long, size long").repartition(7)
    ranked = {r["at"]: r["place"] for r in placed_in_order(df, F.col("key"), F.col("at")).collect()}
    order = sorted(rows, key=lambda x: (x[1], x[0]))
    assert ranked == {r[0]: n for n, r in enumerate(order)}
    sums = {r["at"]: r["before"] for r in running(df, [F.col("at")], F.col("size"), "before").collect()}
    assert sums == {i: sum(x[2] for x in rows[:i]) for i in range(500)}
    stored = [(k, -k - 1 if k % 50 == 49 else k) for k in range(300)]
    found = {(r["at"], r["key"], r["before"]) for r in descents(spark.createDataFrame(stored, "at long, key long").repartition(5)).collect()}
    unsigned = lambda x: x % 2**64
    assert found == {(k, b, a) for (_, a), (k, b) in zip(stored, stored[1:], strict=False) if unsigned(b) <= unsigned(a)}


def test_layers_spread_resolved_probes(spark):
    """Probes that an upper layer knows stay spread in the joins below."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        keys = spark.range(4000).select(F.col("id").alias("key"))
        top = keys.withColumn("path", F.lit("top"))
        below = keys.filter("key % 2 = 0").withColumn("path", F.lit("below"))
        out = resolve(keys, [top, below]).withColumn("part", F.spark_partition_id())
        counts = [r["count"] for r in out.groupBy("part").count().collect()]
        assert sum(counts) == 4000 and len(counts) == 4 and max(counts) < 1500
        assert out.filter("path <> 'top' or layer <> 0").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
