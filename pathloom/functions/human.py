"""Numbers for people: sizes, durations, grouped digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mebibytes(n: Column) -> Column:
    return F.concat(F.format_number(n / (1 << 20), 1), F.lit(" MiB"))


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def duration(ns: Column) -> Column:
    """Nanoseconds in the largest unit that leaves at least 1."""
    unit = lambda size, name: F.concat(F.format_number(ns / size, 1), F.lit(f" {name}"))
    return F.when(ns < 1000, F.concat(F.format_number(ns, 0), F.lit(" ns"))).when(ns < 10**6, unit(10**3, "µs")).when(ns < 10**9, unit(10**6, "ms")).otherwise(unit(10**9, "s"))
