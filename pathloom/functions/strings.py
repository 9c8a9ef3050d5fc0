"""Path surgery as column expressions; all of it is case-sensitive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY = r"/_\-. "
# Fixed value: where game data is mounted inside the client's plugins.
MOUNT = "plugins/rcp-be-lol-game-data/"


def directory(path: Column) -> Column:
    """All up to the last slash, that included."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _stem_ext(base: Column, group: int) -> Column:
    return F.regexp_extract(base, r"(?s)^(.+)(\.[^.]*)\z", group)


def stem(base: Column) -> Column:
    """A name without its extension; a dot at its beginning starts none."""
    found = _stem_ext(base, 1)
    return F.when(found == "", base).otherwise(found)


def extension(base: Column) -> Column:
    """A name's last dot and what follows, or nothing."""
    return _stem_ext(base, 2)


def seen_extension(path: Column) -> Column:
    """What follows the last dot of the name (there, even a leading one), if it is 1 to 11 ASCII letters or digits; else null."""
    return F.nullif(F.regexp_extract(basename(path), r"\.([0-9A-Za-z]{1,11})\z", 1), F.lit(""))


def champion(path: Column) -> Column:
    """The alphanumeric segment after the first ``characters/`` that has one; else null."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)characters/([0-9A-Za-z]+)(?:/|\z)", 1), F.lit(""))


def tokens(text: Column, separators: str = r"_\-.") -> Column:
    """Non-empty parts between separators."""
    return F.array_remove(F.split(text, f"[{separators}]"), "")


def words(path: Column) -> Column:
    """Tokens of a path of at least two bytes that are no plain numbers."""
    return F.filter(F.split(path, f"[{BOUNDARY}]"), lambda t: (F.octet_length(t) >= 2) & ~t.rlike(r"^[0-9]+\z"))


def replace_token(path: Column, old: Column, new: Column) -> Column:
    """Every whole token ``old`` (alphanumeric) replaced; neighbours may share a separator."""
    return F.regexp_replace(path, F.concat(F.lit(rf"(?<![^{BOUNDARY}])"), old, F.lit(rf"(?![^{BOUNDARY}])")), new)


def rewrites(path: Column, run: str) -> Column:
    """``run`` is a pattern; array of ``(before, found, after)`` for each of its matches in a path."""
    gaps, found = F.split(path, run), F.regexp_extract_all(path, F.lit(run), F.lit(0))
    # the text between two gaps is the match, so a prefix is gaps and matches in turn
    woven = lambda g, f: F.array_join(F.zip_with(g, f, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    n = F.size(found)
    before = lambda i: F.concat(woven(F.slice(gaps, F.lit(1), i), F.slice(found, F.lit(1), i)), F.get(gaps, i))
    after = lambda i: woven(F.slice(gaps, i + 2, F.size(gaps)), F.slice(F.concat(found, F.array(F.lit(""))), i + 2, F.size(gaps)))
    return F.when(n > 0, F.transform(found, lambda f, i: F.struct(before(i).alias("before"), f.alias("found"), after(i).alias("after")))).otherwise(F.array().cast("array<struct<before:string,found:string,after:string>>"))


def padded(n: Column, width: Column) -> Column:
    """A number with at least ``width`` digits."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(width, F.length(text)), F.lit("0"))


def unmounted(path: Column) -> Column:
    """What stands below the mount's region and locale; else null."""
    return F.nullif(F.regexp_extract(path, rf"(?s)^{MOUNT}[^/]*/[^/]*/(.*)\z", 1), F.lit(""))
