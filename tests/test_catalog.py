import asyncio
import io
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom import cli
from pathloom.errors import BadMagic, BadRemoteFilename, ChecksumMismatch, DownloadMismatch, DuplicateKey, FetchFailed, InvalidVersion, KeyOutOfRange, Malformed, MalformedHeader, ManifestError, OpenError, TableNotFound, UnsupportedSchema, UnsupportedVersion, VersionReused, ZeroFrameSize
from pathloom.meta import TABLES, Casing, HashKind, KeyWidth, TableMeta
from pathloom.plans.catalog import Manifest, Store, cache_dir, directory_fetch, is_version, rfc3339, version_of
from pathloom.sources.tablefile import HEADER_BYTES, encode_table, open_bytes, open_file, read_table_file, write_table_file

U64 = TableMeta(KeyWidth.U64, HashKind.XXH64)
U32 = TableMeta(KeyWidth.U32, HashKind.FNV1A32)


def test_pinned_bytes():
    got = encode_table([(0x0123456789ABCDEF, "assets/a.dds"), (0x42, "data/b.bin")], U64, None)
    assert got.hex() == (
        "4841534844420000" "0100010208040000" "0200000000000000" "5000000000000000" "6000000000000000" "6c00000000000000" "1600000000000000" "1600000000000000"
        "876c9fed17f5ebe9" "0000000000000000" "4200000000000000" "efcdab8967452301" "0c000000" "00000000" "0a00" "0c00"
    ) + b"assets/a.ddsdata/b.bin".hex()
    head = encode_table([(0xAFD071E5, "test")], U32, None)[:HEADER_BYTES]
    assert head[10:14] == bytes([2, 2, 4, 4]) and head[64:72].hex() == "59e40abc966ffcf6"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 2**64 - 1), st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=40), st.one_of(st.none(), st.integers(1, 300)))
def test_round_trip(rows, frame):
    t = open_bytes(encode_table(list(rows.items()), U64, frame))
    t.verify()
    assert {k & (2**64 - 1): p for k, p in t.rows(0, t.head.entries)} == rows
    for k in [*rows, 12345]:
        at = t.find(k)
        assert (at is not None) == (k in rows)
        assert at is None or list(t.rows(at, at + 1))[0][1] == rows[k]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 7), st.booleans())
def test_damage_never_passes_unseen(at, bit, packed):
    data = bytearray(encode_table([(i * 3, f"assets/characters/champ{i}/x.bin") for i in range(50)], U64, 64 if packed else None))
    data[at % len(data)] ^= 1 << bit
    try:
        t = open_bytes(bytes(data))
        list(t.rows(0, t.head.entries))
        t.find(3)
    except (OpenError, MemoryError):
        pass


def test_open_checks():
    good = encode_table([(1, "a")], U64, 16)
    for change, error in ((good[:50], MalformedHeader), (b"X" + good[1:], BadMagic), (good[:8] + b"\2" + good[9:], UnsupportedVersion), (good[:10] + b"\x09" + good[11:], MalformedHeader), (good[:11] + b"\xf0" + good[12:], MalformedHeader),
                          (good[:12] + b"\5" + good[13:], MalformedHeader), (good[:13] + b"\5" + good[14:], MalformedHeader), (good[:-3], Malformed), (good[:16] + b"\xff" * 8 + good[24:], Malformed)):
        with pytest.raises(error):
            open_bytes(change)
    raw = bytearray(encode_table([(1, "abc")], U64, None))
    raw[-1] ^= 1
    with pytest.raises(ChecksumMismatch):
        open_bytes(bytes(raw)).verify()
    with pytest.raises(ZeroFrameSize):
        encode_table([], U64, 0)
    with pytest.raises(DuplicateKey):
        encode_table([(1, "a"), (1, "b")], U64)
    with pytest.raises(KeyOutOfRange):
        encode_table([(1 << 32, "a")], U32)
    assert encode_table([(1, "s"), (2, "s"), (3, "t")], U64, None).endswith(b"st")


def test_data_source(spark, tmp_path):
    rows = [(i * 7 - (1 << 62), f"assets/{i % 10}/{i}.bin") for i in range(500)]
    path = str(tmp_path / "t.lhdb")
    write_table_file(spark.createDataFrame(rows, "key long, path string"), path, TableMeta(KeyWidth.U64, HashKind.XXH3, Casing.SENSITIVE), 512)
    open_file(path).verify()
    assert open_file(path).head.meta == TableMeta(KeyWidth.U64, HashKind.XXH3, Casing.SENSITIVE)
    df = read_table_file(spark, path)
    assert {tuple(r) for r in df.collect()} == set(rows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r["path"] for r in read_table_file(spark, path).filter(f"key = {rows[3][0]}").collect()] == [rows[3][1]]
        assert read_table_file(spark, path).filter(f"key in ({rows[3][0]}, {rows[9][0]}, 1)").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def built(tmp_path, name="b", rows=((1, "a"), (2, "b"))):
    p = tmp_path / name
    p.write_bytes(encode_table(list(rows), U64))
    return p


def test_commit_open_gc(spark, tmp_path):
    s = Store(tmp_path / "cache")
    with pytest.raises(ManifestError):
        s.manifest()
    assert s.gc().deleted == []
    s.commit([("game", "v1", built(tmp_path))], {"repo": "r"})
    assert s.open(spark, "game").get(2) == "b" and s.manifest().tables["game"]["entries"] == 2
    with pytest.raises(TableNotFound):
        s.open(spark, "lcu")
    s.commit([("game", "v1", built(tmp_path))])
    with pytest.raises(VersionReused):
        s.commit([("game", "v1", built(tmp_path, "c", ((5, "z"),)))])
    s.commit([("game", "v2", built(tmp_path, "c", ((5, "z"),))), ("lcu", "v1", built(tmp_path))])
    (s.dir / "x.tmp").write_text("")
    assert {p.name for p in s.gc().deleted} == {"game-v1.lhdb", "x.tmp"} and s.open(spark, "game").get(5) == "z"
    for bad in ("", "a/b", "a\\b"):
        with pytest.raises(InvalidVersion):
            s.commit([("game", bad, built(tmp_path))])
    layered, failed = s.open_layered(spark, ["game", "binhashes", "lcu"])
    assert layered.get(5) == "z" and layered.get(1) == "a" and [n for n, _ in failed] == ["binhashes"]
    assert s.commit([]).source is None
    with s.try_lock() as mine, Store(s.dir).try_lock() as other:
        assert mine and not other


def release(tmp_path, version="v1", rows=((1, "a"),), table="game", file=None):
    d = tmp_path / "release"
    Store(d).commit([(table, version, built(tmp_path, "r", rows))])
    return d


def test_update(tmp_path):
    d, s = release(tmp_path), Store(tmp_path / "mine")
    fetch = directory_fetch(d)
    assert s.update(fetch).installed == ["game"] and s.update(fetch).installed == [] and s.update(fetch, force=True).installed == ["game"]
    s.path_for("game").unlink()
    assert s.update(fetch).installed == ["game"]
    (s.dir / "old.tmp").write_text("")
    release(tmp_path, "v2", ((1, "b"),))
    r = s.update(fetch)
    assert r.installed == ["game"] and {p.name for p in r.gc.deleted} == {"game-v1.lhdb", "old.tmp"}
    before = s.manifest_path.read_bytes()
    release(tmp_path, "v3", ((1, "c"),))
    with pytest.raises(DownloadMismatch):
        s.update(lambda n: b"junk" if n.endswith("lhdb") else fetch(n))
    with pytest.raises(FetchFailed):
        s.update(lambda n: fetch("missing"))
    assert s.manifest_path.read_bytes() == before and not list(s.dir.glob("*.tmp"))
    m = json.loads((d / "manifest.json").read_text())
    m["tables"]["future"] = m["tables"]["game"]
    assert s.update(lambda n: json.dumps(m).encode() if n == "manifest.json" else fetch(n)).unknown_tables == ["future"]
    m["tables"]["game"] = m["tables"]["game"] | {"file": "game-../x.lhdb"}
    with pytest.raises(BadRemoteFilename):
        s.update(lambda n: json.dumps(m).encode())
    with s.try_lock():
        assert Store(s.dir).update(fetch).locked


def test_update_async(tmp_path):
    d, s = release(tmp_path), Store(tmp_path / "mine")

    async def fetch(name):
        return directory_fetch(d)(name)

    async def stuck(name):
        if name != "manifest.json":
            await asyncio.sleep(60)
        return await fetch(name)

    async def cancelled():
        task = asyncio.create_task(s.update_async(stuck))
        await asyncio.sleep(0.05)
        task.cancel()
        with pytest.raises(asyncio.CancelledError):
            await task

    asyncio.run(cancelled())
    assert not s.manifest_path.exists() and not list(s.dir.glob("*.tmp"))
    assert asyncio.run(s.update_async(fetch)).installed == ["game"]


def test_small_parts(monkeypatch, tmp_path):
    assert rfc3339(0) == "1970-01-01T00:00:00Z" and rfc3339(951782400) == "2000-02-29T00:00:00Z" and rfc3339(1e18) == ""
    assert version_of("rst", "rst-v1.lhdb") == "v1" and version_of("game", "game-a/b.lhdb") is None and version_of("game", "game-.lhdb") is None and not is_version("")
    with pytest.raises(UnsupportedSchema):
        Manifest.parse(b'{"schema": 2, "generated_at": "", "tables": {}}')
    with pytest.raises(ManifestError):
        Manifest.parse(b"[]")
    monkeypatch.setenv("PATHLOOM_DIR", str(tmp_path))
    assert cache_dir() == tmp_path
    monkeypatch.setenv("PATHLOOM_DIR", "")
    assert cache_dir().name == "pathloom"
    assert io is not None and len(TABLES) == 8


def test_cli(spark, tmp_path, capsys):
    lists = tmp_path / "lists"
    lists.mkdir()
    (lists / "hashes.game.txt.0").write_text("00000000000011aa assets/foo.bin\n")
    (lists / "hashes.game.txt.1").write_text("00000000000022bb assets/bar.bin\n")
    (lists / "hashes.lcu.txt").write_text("01 plugins/x\n")
    run = lambda *a: cli.run(cli.parser().parse_args(list(a)), spark)
    with pytest.raises(cli.Refused, match="missing"):
        run("bundle", "--inputs", str(lists), "--out", str(tmp_path / "out"))
    run("bundle", "--inputs", str(lists), "--out", str(tmp_path / "out"), "--version", "v9", "--allow-missing")
    m = Store(tmp_path / "out").manifest()
    assert set(m.tables) == {"game", "lcu"} and m.tables["game"]["entries"] == 2 and m.tables["game"]["file"] == "game-v9.lhdb"
    with pytest.raises(cli.Refused, match="already"):
        run("bundle", "--inputs", str(lists), "--out", str(tmp_path / "out"), "--allow-missing")
    capsys.readouterr()
    run("get", "0x22bb", "--table", "game", "--dir", str(tmp_path / "out"))
    assert capsys.readouterr().out == "assets/bar.bin\n"
    assert cli.main(["get", "77", "--file", str(tmp_path / "out/game-v9.lhdb")]) == 1 and cli.main(["verify", str(tmp_path / "out/game-v9.lhdb")]) == 0
    one, two = tmp_path / "1", tmp_path / "2"
    one.write_text("811c9dc5 \n16b3b962 Seed \n")
    two.write_text("16b3b962 Other\n16b3b962 Seed \n")
    capsys.readouterr()
    run("merge", str(one), str(two))
    said = capsys.readouterr()
    assert said.out == "16b3b962 Other\n16b3b962 Seed \n811c9dc5 \n" and "'conflicts': 1" in said.err
    two.write_text(f"{__import__('xxhash').xxh64_hexdigest('assets/foo.dds')}\n")
    run("gen", "--known", str(lists / "hashes.game.txt.0"), "--unknown", str(two), "--max-number", "3", "--max-skin", "3")
    assert capsys.readouterr().out.endswith(" assets/foo.dds\n")
    run("build", "--input", str(one), "--table", "binhashes", "--out", str(tmp_path / "t"), "--raw")
    run("stats", str(tmp_path / "t"))
    assert "entries: 2" in capsys.readouterr().out
