"""Candidate generators: a corpus of known paths in, candidate paths out, all lazy DataFrames.

Vocabularies (extensions, champions, words) are joined as small sides that Spark
broadcasts when they are small; the corpus is only ever exploded in place.
Copies of a candidate stay, as candidates are counted with copies.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings as S

# Extensions that exist even if no known path has them.
EXTENSIONS = [
    "anm", "bin", "bnk", "cfg", "dat", "dds", "jpg", "json", "lua", "luabin", "mapgeo", "ogg", "png", "preload", "scb",
    "sco", "skl", "skn", "stringtable", "svg", "tex", "tga", "troy", "troybin", "ttf", "txt", "wav", "webm", "wgeo", "wpk",
]
# Prefixes of textures in other resolutions.
PREFIXES = ["2x_", "4x_", "sd_"]
# Regions and locales of plugin paths.
REGIONS = [
    "global", "br", "cn", "eune", "euw", "garena2", "garena3", "id", "jp", "kr", "la1", "la2", "lan", "las", "na", "oc1",
    "oce", "pbe", "ph", "ru", "sg", "tencent", "th", "tr", "tw", "vn",
]
LOCALES = [
    "default", "cs_cz", "de_de", "el_gr", "en_au", "en_gb", "en_ph", "en_sg", "en_us", "es_ar", "es_es", "es_mx", "fr_fr", "hu_hu", "id_id",
    "it_it", "ja_jp", "ko_kr", "ms_my", "pl_pl", "pt_br", "ro_ro", "ru_ru", "th_th", "tr_tr", "vi_vn", "vn_vn", "zh_cn", "zh_my", "zh_tw",
]
LOCALE = r"^(default|[a-z]{2}_[a-z]{2})\z"


def _literals(df: DataFrame, name: str, values: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


def wordlist(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.explode(S.words(F.col("path"))).alias("word")).distinct()


def champions(corpus: DataFrame) -> DataFrame:
    return corpus.select(S.champion(F.col("path")).alias("champion")).filter("champion is not null").distinct()


def extensions(corpus: DataFrame) -> DataFrame:
    seen = corpus.select(S.seen_extension(F.col("path")).alias("ext")).filter("ext is not null")
    return seen.union(_literals(corpus, "ext", EXTENSIONS)).distinct()


class Guesser(Protocol):
    """A user's own generator needs these two; ``fresh`` are the paths that are new since it last ran."""

    name: str

    def guess(self, corpus: DataFrame) -> DataFrame: ...


def _paths(df: DataFrame, path: Column) -> DataFrame:
    return df.select(path.alias("path"))


class SeedStrings:
    name = "seed-strings"
    local = True  # what it makes of a path depends on that path alone

    def __init__(self, seeds: DataFrame):
        self.seeds = seeds.select("path")

    def guess(self, corpus: DataFrame) -> DataFrame:
        return self.seeds


class ExtensionSwap:
    name = "extension-swap"
    local = False

    def guess(self, corpus: DataFrame) -> DataFrame:
        base = S.basename(F.col("path"))
        cut = corpus.select(F.concat(S.directory(F.col("path")), S.stem(base)).alias("root"), F.substring_index(base, ".", -1).alias("cur"), (S.extension(base) != "").alias("has")).filter("has")
        swapped = cut.join(extensions(corpus), F.col("ext") != F.col("cur"))
        return _paths(swapped, F.concat("root", F.lit("."), "ext"))


class PrefixVariants:
    name = "prefix-variants"
    local = True

    def guess(self, corpus: DataFrame) -> DataFrame:
        base = S.basename(F.col("path"))
        parts = corpus.select(S.directory(F.col("path")).alias("dir"), F.regexp_extract(base, "^(" + "|".join(PREFIXES) + ")", 1).alias("had"), base.alias("base"))
        bare = parts.withColumn("bare", F.expr("substring(base, length(had) + 1)")).filter("bare <> ''")
        options = F.filter(F.array(*map(F.lit, ["", *PREFIXES])), lambda p: p != F.col("had"))
        return _paths(bare.select("dir", "bare", F.explode(options).alias("put")), F.concat("dir", "put", "bare"))


class CrossReference:
    name = "cross-reference"
    local = True

    def guess(self, corpus: DataFrame) -> DataFrame:
        asset = lambda p: p.startswith("assets/") | p.startswith("data/")
        below = S.unmounted(F.col("path"))
        found = F.when(asset(below), below).when(asset(F.col("path")), F.concat(F.lit(f"{S.MOUNT}global/default/"), "path"))
        return _paths(corpus, found).filter("path is not null")


class NumericRange:
    name = "numeric-range"
    local = True

    def __init__(self, most: int = 200):
        self.most = most

    def guess(self, corpus: DataFrame) -> DataFrame:
        runs = corpus.select(F.explode(S.rewrites(F.col("path"), "[0-9]+")).alias("r")).select("r.*")
        numbered = runs.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.most))).alias("n"))
        plain, width = F.col("n").cast("string"), F.length("found")
        forms = F.when(F.length(plain) < width, F.array(plain, F.lpad(plain, width, F.lit("0")))).otherwise(F.array(plain))
        return _paths(numbered.select("before", "after", F.explode(forms).alias("put")), F.concat("before", "put", "after"))


class CharacterSkin:
    """Sweeps all skin numbers of a path together, and swaps its champion for every other."""

    name = "character-skin"
    local = False

    def __init__(self, most: int = 100):
        self.most = most

    def guess(self, corpus: DataFrame) -> DataFrame:
        return self.sweep(corpus).union(self.transfer(corpus))

    def sweep(self, corpus: DataFrame) -> DataFrame:
        found = F.regexp_extract_all("path", F.lit("skin([0-9]+)"), F.lit(1))
        value = lambda t: t.try_cast("decimal(38,0)")
        fits = lambda t: F.coalesce(value(t) <= 4294967295, F.lit(False))
        cut = corpus.select(F.split("path", r"(?<=skin)[0-9]+").alias("gaps"), found.alias("found")).filter("size(found) > 0")
        same = F.forall("found", lambda t: fits(t) & (value(t) == value(F.get("found", F.lit(0)))))
        told = cut.withColumn("uniform", F.when(same, value(F.get("found", F.lit(0))).cast("long"))).withColumn("any_padded", F.exists("found", lambda t: fits(t) & (F.length(t) > F.length(value(t).cast("string")))))
        swept = told.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.most))).alias("n")).filter(~F.coalesce(F.col("n") == F.col("uniform"), F.lit(False)))
        filled = F.transform("found", lambda t: S.padded(F.col("n"), F.length(t)))
        plain = F.transform("found", lambda t: F.col("n").cast("string"))
        forms = F.when(F.col("any_padded"), F.array(filled, plain)).otherwise(F.array(filled))
        woven = F.zip_with("gaps", "put", lambda g, p: F.concat(g, F.coalesce(p, F.lit(""))))
        return _paths(swept.select("gaps", F.explode(forms).alias("put")), F.array_join(woven, ""))

    def transfer(self, corpus: DataFrame) -> DataFrame:
        own = corpus.select("path", S.champion(F.col("path")).alias("own")).filter("own is not null")
        other = own.join(champions(corpus), F.col("champion") != F.col("own"))
        return _paths(other, S.replace_token(F.col("path"), F.col("own"), F.col("champion")))


class RegionLocale:
    name = "region-locale"
    local = True

    def __init__(self, regions: list[str] = REGIONS, locales: list[str] = LOCALES):
        self.regions, self.locales = regions, locales

    def guess(self, corpus: DataFrame) -> DataFrame:
        cut = corpus.select(F.split("path", "/").alias("s"))
        pair = F.filter(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.get("s", i).isin(self.regions) & F.get("s", i + 1).rlike(LOCALE))
        spans = cut.filter("size(s) > 1").select("s", F.explode(pair).alias("i"))
        every = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(k).alias("l")) for r in self.regions for k in self.locales))
        put = spans.select("s", "i", F.explode(every).alias("p")).filter((F.col("p.r") != F.get("s", F.col("i"))) | (F.col("p.l") != F.get("s", F.col("i") + 1)))
        parts = F.concat(F.slice("s", F.lit(1), F.col("i")), F.array("p.r", "p.l"), F.slice("s", F.col("i") + 3, F.size("s")))
        return _paths(put, F.array_join(parts, "/"))


class WordSubstitution:
    name = "word-substitution"
    local = False

    def guess(self, corpus: DataFrame) -> DataFrame:
        base = S.basename(F.col("path"))
        cut = corpus.select(S.directory(F.col("path")).alias("dir"), S.stem(base).alias("stem"), S.extension(base).alias("ext"))
        spans = cut.select("dir", "ext", F.explode(S.rewrites(F.col("stem"), r"[^_\-.]+")).alias("r"))
        other = spans.join(wordlist(corpus), F.col("word") != F.col("r.found"))
        return _paths(other, F.concat("dir", "r.before", "word", "r.after", "ext"))


class WordAdd:
    name = "word-add"
    local = False

    def guess(self, corpus: DataFrame) -> DataFrame:
        base = S.basename(F.col("path"))
        cut = corpus.select(S.directory(F.col("path")).alias("dir"), S.stem(base).alias("stem"), S.extension(base).alias("ext")).filter("stem <> ''")
        both = cut.join(wordlist(corpus), F.lit(True))
        forms = F.array(*(F.concat(*order) for sign in "_-" for order in ((F.col("stem"), F.lit(sign), F.col("word")), (F.col("word"), F.lit(sign), F.col("stem")))))
        return _paths(both.select("dir", "ext", F.explode(forms).alias("s")), F.concat("dir", "s", "ext"))


def preset(table: str, most_number: int = 200, most_skin: int = 100, seeds: DataFrame | None = None, words: bool = False) -> list:
    """The generators of a logical table: seeds first, word generators last and only if asked for."""
    if table == "game":
        middle = [ExtensionSwap(), PrefixVariants(), CrossReference(), NumericRange(most_number), CharacterSkin(most_skin)]
    elif table == "lcu":
        middle = [ExtensionSwap(), RegionLocale(), CrossReference(), NumericRange(most_number)]
    else:
        middle = [ExtensionSwap(), NumericRange(most_number)]
    return [*([SeedStrings(seeds)] if seeds is not None else []), *middle, *([WordSubstitution(), WordAdd()] if words else [])]
