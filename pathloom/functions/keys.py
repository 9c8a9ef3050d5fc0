"""Unsigned keys in bigint columns: hex in and out, and unsigned order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN = -(1 << 63)


def is_hex(token: Column) -> Column:
    return F.coalesce(token.rlike(r"^[0-9A-Fa-f]{1,16}\z"), F.lit(False))


def parse_hex(token: Column, prefix: bool = True) -> Column:
    """Key of up to 16 hex digits, null for anything else; ``prefix`` lets any number of ``0x`` stand before them."""
    digits = F.regexp_replace(token, r"^(0x)+", "") if prefix else token
    return F.when(is_hex(digits), F.conv(digits, 16, -10).cast("long"))


def format_hex(key: Column, digits: int | Column = 16) -> Column:
    """Lower-case hex with at least ``digits`` digits."""
    text = F.lower(F.hex(key))
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits) if isinstance(digits, int) else digits), F.lit("0"))


def unsigned(key: Column) -> Column:
    """A bigint whose signed order is the key's unsigned order."""
    return key.bitwiseXOR(F.lit(MIN))


def to_unsigned(key: int) -> int:
    return key & 0xFFFFFFFFFFFFFFFF


def to_signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key
