"""Text lists: ``<hex> <path>`` tables, unknown keys, seeds, and the lists that are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import format_hex, is_hex, parse_hex, unsigned


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, value``: lines end with a line feed, of which up to two carriage returns before go too."""
    rows = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    broken = F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("file")))
    return rows.select("file", F.regexp_replace(F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(broken), r"\r{1,2}\z", "").alias("value"))


def read_hash_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``hex, key, path, file``; blank lines are skipped, a malformed line fails the query (``locate`` finds its place)."""
    return parse_hash_lines(read_lines(spark, paths))


_AT = "instr(value, ' ')"


def _token() -> Column:
    return F.expr(f"substring(value, 1, {_AT} - 1)")


def parse_hash_lines(lines: DataFrame) -> DataFrame:
    """A line is cut at its first space; the path is all the rest, be it empty or ending in spaces."""
    wrong = F.raise_error(F.concat(F.col("file"), F.lit(": no <hash> <path>: "), F.col("value")))
    rows = lines.filter(trimmed(F.col("value")) != "").select("file", "value", _token().alias("token"))
    good = F.expr(f"{_AT} > 0") & is_hex(F.col("token"))
    return rows.select(F.when(good, F.col("token")).otherwise(wrong).alias("hex"), parse_hex(F.col("token"), prefix=False).alias("key"), F.expr(f"substring(value, {_AT} + 1)").alias("path"), "file")


def locate(spark: SparkSession, paths: str | list[str]) -> str | None:
    """``file:line`` (from 1) of a malformed line of hash lists, of the first file that has one; None if all are well."""
    bad = read_lines(spark, paths).filter(trimmed(F.col("value")) != "").filter(~(F.expr(f"{_AT} > 0") & is_hex(_token()))).agg(F.min("file").alias("file")).first()["file"]
    if bad is None:
        return None
    # lines of one file are numbered in the order of their places in it
    whole = spark.read.text(bad, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "value"))
    first = whole.filter(trimmed(F.col("value")) != "").filter(~(F.expr(f"{_AT} > 0") & is_hex(_token()))).agg(F.min("at").alias("at")).first()["at"]
    return f"{bad}:{first + 1}"


def read_unknown(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``key``: one hex hash a line, trimmed, ``0x`` allowed."""
    token = trimmed(F.col("value"))
    rows = read_lines(spark, paths).filter(token != "")
    key = parse_hex(token)
    return rows.select(F.coalesce(key, F.raise_error(F.concat(F.col("file"), F.lit(": not a hash: "), token)).cast("long")).alias("key"))


def read_seeds(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path``: every non-empty line as it is."""
    return read_lines(spark, paths).filter("value <> ''").select(F.col("value").alias("path"))


def hash_lines(pairs: DataFrame, digits: int | Column) -> DataFrame:
    """``value``: the lines of a list, in order of key (unsigned) and path."""
    return pairs.orderBy(unsigned(F.col("key")), "path").select(F.concat(format_hex(F.col("key"), digits), F.lit(" "), F.col("path")).alias("value"))


def write_hash_list(pairs: DataFrame, path: str, digits: int = 16, lowercase: bool = False) -> None:
    """A sorted list as text parts; their order is the list's."""
    rows = pairs.withColumn("path", F.lower("path")) if lowercase else pairs
    hash_lines(rows, digits).write.mode("overwrite").text(path)
