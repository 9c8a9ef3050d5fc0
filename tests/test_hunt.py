import pytest
from pyspark.sql import functions as F

from pathloom.functions.hashing import hash_text
from pathloom.meta import TABLES, HashKind, KeyWidth, TableMeta
from pathloom.operators import guessers as G
from pathloom.plans.hunt import Hunt, resolved_lines, stats_frame, targets

META = TableMeta(KeyWidth.U64, HashKind.XXH64)


def corpus(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def guesses(spark, guesser, *paths):
    return [r["path"] for r in guesser.guess(corpus(spark, *paths)).collect()]


def hunted(spark, guessers, known, wanted, meta=META, **options):
    keys = spark.createDataFrame([(hash_text(p, meta),) for p in wanted], "key long")
    return Hunt(meta, guessers, **options).run(corpus(spark, *known), keys)


def names(report):
    return {r["path"] for r in report.resolved.collect()}


def test_extension_swap(spark):
    got = guesses(spark, G.ExtensionSwap(), "assets/foo/bar.png", "a.b/none", "x/.hidden", "y/z.customext")
    assert {"assets/foo/bar.dds", "assets/foo/bar.customext", "y/z.hidden"} <= set(got) and "assets/foo/bar.png" not in got
    assert len(got) == 2 * (len(G.EXTENSIONS) + 2) - 2  # two paths swap; both their extensions are among the known ones


def test_prefix_variants(spark):
    assert sorted(guesses(spark, G.PrefixVariants(), "a/icon.dds", "2x_orb.png", "a/4x_", "b/")) == sorted(["a/2x_icon.dds", "a/4x_icon.dds", "a/sd_icon.dds", "orb.png", "4x_orb.png", "sd_orb.png"])


def test_cross_reference(spark):
    m = "plugins/rcp-be-lol-game-data/"
    assert guesses(spark, G.CrossReference(), f"{m}ru/ru_ru/assets/a.dds", "data/x.bin", f"{m}ru/ru_ru/v1/a.json", "plugins/other/global/default/assets/a") == ["assets/a.dds", f"{m}global/default/data/x.bin"]


def test_numeric_range(spark):
    got = guesses(spark, G.NumericRange(10), "ui/icon_03.png", "a/b")
    assert len(got) == 11 + 10 and {"ui/icon_7.png", "ui/icon_07.png", "ui/icon_10.png", "ui/icon_3.png", "ui/icon_03.png"} <= set(got)
    assert sorted(guesses(spark, G.NumericRange(1), "a1b2")) == ["a0b2", "a1b0", "a1b1", "a1b2"]


def test_skin_sweep(spark):
    got = guesses(spark, G.CharacterSkin(20), "assets/skins/skin01/x_skin01.dds")
    assert len(got) == 20 * 2 and "assets/skins/skin07/x_skin07.dds" in got and "assets/skins/skin7/x_skin7.dds" in got and "assets/skins/skin01/x_skin01.dds" not in got
    got = guesses(spark, G.CharacterSkin(9), "skin1/a_skin2_tx.dds")
    assert len(got) == 10 and "skin7/a_skin7_tx.dds" in got and "skin1/a_skin1_tx.dds" in got
    assert "skin00005/x" in guesses(spark, G.CharacterSkin(5), "skin99999/x")
    assert len(guesses(spark, G.CharacterSkin(3), "skin99999999999999999999999999999999999999999/x")) == 4


def test_champion_transfer(spark):
    got = G.CharacterSkin(0).transfer(corpus(spark, "data/characters/ahri/ahri_base.bin", "data/characters/zed/z.bin", "other/ahri")).collect()
    assert sorted(r["path"] for r in got) == ["data/characters/ahri/z.bin", "data/characters/zed/zed_base.bin"]


def test_region_locale(spark):
    got = guesses(spark, G.RegionLocale(), "plugins/x/global/default/index.html", "a/global", "ru/xx_yy/z")
    assert len(got) == 779 + 780 and {"plugins/x/ru/ru_ru/index.html", "plugins/x/global/ja_jp/index.html", "euw/default/z"} <= set(got)


def test_words(spark):
    got = guesses(spark, G.WordSubstitution(), "a1/aatrox_base.dds", "words/riven.txt")
    assert {"a1/riven_base.dds", "a1/aatrox_words.dds", "words/aatrox.txt"} <= set(got)
    w = G.wordlist(corpus(spark, "a1/aatrox_base.dds", "words/riven.txt")).count()
    assert len(got) == 3 * (w - 1)
    got = guesses(spark, G.WordAdd(), "foo/ring.dds", "x/glow.txt")
    assert {"foo/ring_glow.dds", "foo/glow-ring.dds"} <= set(got) and len(got) == 2 * 4 * 5


@pytest.mark.parametrize("faithful", [True, False])
def test_rounds_compose(spark, faithful):
    r = hunted(spark, [G.ExtensionSwap(), G.NumericRange(5)], ["a/b_1.png"], ["a/b_2.png", "a/b_2.dds"], faithful=faithful)
    assert names(r) == {"a/b_2.png", "a/b_2.dds"} and r.rounds == 2 and r.unknown.isEmpty()
    assert stats_frame(spark, r).filter("found > 0").count() == 2


def test_dry_empty_and_none(spark):
    r = hunted(spark, [G.ExtensionSwap()], ["a/b.png"], ["nothing/like/it"])
    assert r.rounds == 1 and r.unknown.count() == 1 and not names(r) and r.stats[0]["candidates"] > 0
    r = hunted(spark, [G.ExtensionSwap()], ["a/b.png"], [])
    assert r.rounds == 1 and not r.stats
    assert hunted(spark, [], ["a/b.png"], ["x"]).rounds == 0


def test_seeds_and_custom(spark):
    class Mine:
        name = "mine"

        def guess(self, corpus):
            return corpus.select(F.upper("path").alias("path"))

    r = Hunt(META).with_(Mine()).with_(G.SeedStrings(corpus(spark, "mined/from/a/wad.dds"))).run(corpus(spark, "x/y"), spark.createDataFrame([(hash_text("mined/from/a/wad.dds", META),), (hash_text("X/Y", META),)], "key long"))
    assert names(r) == {"mined/from/a/wad.dds", "X/Y"}


def test_fnv_keeps_case_and_output(spark):
    meta = TABLES["binhashes"].meta
    r = hunted(spark, [G.ExtensionSwap()], ["Data/Spells/AhriOrb.luabin"], ["Data/Spells/AhriOrb.lua"], meta)
    assert names(r) == {"Data/Spells/AhriOrb.lua"}
    lines = [x["value"] for x in resolved_lines(r, 8, False).collect()]
    assert lines == [f"{hash_text('data/spells/ahriorb.lua', meta):08x} Data/Spells/AhriOrb.lua"]


def test_presets_and_targets(spark):
    assert [g.name for g in G.preset("game")] == ["extension-swap", "prefix-variants", "cross-reference", "numeric-range", "character-skin"]
    assert [g.name for g in G.preset("lcu", seeds=corpus(spark, "x"), words=True)] == ["seed-strings", "extension-swap", "region-locale", "cross-reference", "numeric-range", "word-substitution", "word-add"]
    assert [g.name for g in G.preset("rst")] == ["extension-swap", "numeric-range"]
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key long")
    assert [r["key"] for r in targets(keys(-1, 3, 3, 2), keys(2)).collect()] == [3, -1]
