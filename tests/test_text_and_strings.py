import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pathloom.functions import strings as S
from pathloom.sources import mining
from pathloom.sources.mining import mine_archives, mine_report, scan_tokens, tree_strings
from pathloom.sources.textio import hash_lines, locate, read_hash_list, read_seeds, read_unknown


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "p string").select(f(F.col("p"))).first()[0]


def test_lists(spark, tmp_path):
    p = tmp_path / "list.txt"
    p.write_bytes(b"811c9dc5 \n\n16b3b962 Seed \r\nFFFFFFFFFFFFFFFF a b  c\r\r\n00aa x\ry\n")
    rows = {r["key"]: (r["hex"], r["path"]) for r in read_hash_list(spark, str(p)).collect()}
    assert rows == {0x811C9DC5: ("811c9dc5", ""), 0x16B3B962: ("16b3b962", "Seed "), -1: ("FFFFFFFFFFFFFFFF", "a b  c"), 0xAA: ("00aa", "x\ry")}
    assert locate(spark, str(p)) is None
    for bad in ("nospace\n", "0x1 a\n", "12345678901234567 a\n"):
        q = tmp_path / "bad.txt"
        q.write_text("1 a\n\n" + bad)
        with pytest.raises(PySparkException):
            read_hash_list(spark, str(q)).collect()
        assert locate(spark, str(q)).endswith("bad.txt:3")
    q = tmp_path / "unknown.txt"
    q.write_text("  0x1F \n\n0x0x2\nabc\n")
    assert [r["key"] for r in read_unknown(spark, str(q)).collect()] == [31, 2, 0xABC]
    q.write_text(" a \n\nb\n")
    assert [r["path"] for r in read_seeds(spark, str(q)).collect()] == [" a ", "b"]
    lines = hash_lines(spark.createDataFrame([(-1, "b"), (1, "z"), (1, "a")], "key long, path string"), 4)
    assert [r["value"] for r in lines.collect()] == ["0001 a", "0001 z", "f" * 16 + " b"]


@pytest.mark.parametrize("path,directory,base", [("a/b/c.txt", "a/b/", "c.txt"), ("c", "", "c"), ("a/", "a/", ""), ("", "", "")])
def test_split_dir(spark, path, directory, base):
    assert (one(spark, path, S.directory), one(spark, path, S.basename)) == (directory, base)


@pytest.mark.parametrize("base,stem,ext", [("a.b.c", "a.b", ".c"), (".hidden", ".hidden", ""), ("a.", "a", "."), ("plain", "plain", ""), ("..a", ".", ".a")])
def test_split_ext(spark, base, stem, ext):
    assert (one(spark, base, S.stem), one(spark, base, S.extension)) == (stem, ext)


def test_tokens_and_champions(spark):
    f = lambda p: one(spark, p, S.champion)
    assert f("assets/characters/ahri/x") == "ahri" and f("xcharacters/ahri/x") is None and f("characters/a-b/characters/zed") == "zed" and f("characters/zed") == "zed"
    rep = lambda p, a, b: spark.createDataFrame([(p, a, b)], "p string, a string, b string").select(S.replace_token(F.col("p"), F.col("a"), F.col("b"))).first()[0]
    assert rep("ahri/ahri_ahri.x", "ahri", "zed") == "zed/zed_zed.x" and rep("ahris/xahri", "ahri", "zed") == "ahris/xahri" and rep("ahri ahri", "ahri", "z") == "z z"
    assert one(spark, "a7b12", lambda c: S.rewrites(c, "[0-9]+")) == [("a", "7", "b12"), ("a7b", "12", "")]
    assert one(spark, "ab", lambda c: S.rewrites(c, "[0-9]+")) == []
    assert one(spark, "plugins/rcp-be-lol-game-data/ru/ru_ru/data/x", S.unmounted) == "data/x" and one(spark, "plugins/rcp-be-lol-game-data/ru", S.unmounted) is None
    assert one(spark, "a/.hidden", S.seen_extension) == "hidden" and one(spark, "a/b.toolongextension", S.seen_extension) is None


def test_mining(spark, tmp_path):
    got = {r[0] for r in scan_tokens(spark.createDataFrame([("{'k': 'assets/a.dds'} ..-x.y-.. abc nodots a.b " + "z" * 400 + ".q",)], "t string"), "t").collect()}
    assert got == {"assets/a.dds"}
    trees = spark.createDataFrame([('{"a/b.c": [1, {"x": "data/q.bin and more"}], "n": null}',), ("{broken assets/z.tex",), (None,)], "t string")
    assert {r[0] for r in tree_strings(trees, "t").collect()} == {"a/b.c", "x", "data/q.bin and more", "data/q.bin", "assets/z.tex", "n"}
    with zipfile.ZipFile(tmp_path / "a.wad", "w") as z:
        z.writestr("one", b"\0\1assets/x/y.dds\xff junk")
        z.writestr("two", b"PROP" + b"data/p.bin")

    def parser(data):
        if b"bad" in data:
            raise ValueError
        yield "parsed/string value"

    strings, chunks, skipped = mine_report(mine_archives(spark, str(tmp_path / "a.wad"), parser=parser))
    assert {r[0] for r in strings.collect()} == {"assets/x/y.dds", "parsed/string value", "parsed/string"}
    assert chunks.count() == 2 and skipped.first()[0] == 0

    def breaking(data):
        def read():
            raise OSError

        yield 5, 0, read

    assert mine_report(mine_archives(spark, str(tmp_path / "a.wad"), splitter=breaking))[2].first()[0] == 1


def test_mining_by_ranges(spark, tmp_path, monkeypatch):
    """Every chunk is read once, however the archive is cut, and from its content where only Spark reads the store."""
    with zipfile.ZipFile(tmp_path / "a.wad", "w") as z:
        for i in range(40):
            z.writestr(f"m{i}", f"assets/file{i}.dds".encode() * (i % 3))
    want = {f"assets/file{i}.dds" for i in range(40) if i % 3 == 1} | {f"assets/file{i}.ddsassets/file{i}.dds" for i in range(40) if i % 3 == 2}
    for size in (50, 700, 1 << 20):
        mined = mine_archives(spark, str(tmp_path / "a.wad"), range_bytes=size)
        assert mined.filter("token is null").count() == 40 and sorted(r["token"] for r in mined.filter("token is not null").collect()) == sorted(want)
    monkeypatch.setattr(mining, "_opened", lambda path: None)
    assert {r["token"] for r in mine_archives(spark, str(tmp_path / "a.wad")).filter("token is not null").collect()} == want
