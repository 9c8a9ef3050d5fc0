"""Keyed tables: build with checks, look up, scan, verify, measure."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ChecksumMismatch, DuplicateKey, KeyOutOfRange, PathTooLong, VerifyError
from ..functions.hashing import hash_path, xxh64
from ..functions.keys import parse_hex, to_signed, to_unsigned, unsigned
from ..meta import MAX_PATH_BYTES, Casing, HashKind, KeyWidth, TableMeta
from ..session import checkpointed

SCHEMA = "key long, path string"


def conflicts(pairs: DataFrame) -> DataFrame:
    """``key, n_paths`` of the keys with more than one path."""
    return pairs.distinct().groupBy("key").agg(F.count("*").alias("n_paths")).filter("n_paths > 1")


def check(pairs: DataFrame, meta: TableMeta) -> None:
    """Raises for the smallest key with two paths, else the smallest key over 32 bits, else the first path (in path order) that is too long.

    ``pairs`` are distinct.  Only keys are shuffled; paths are looked at where they are.
    """
    back = lambda x: to_unsigned(x ^ -(1 << 63))
    twice = pairs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").agg(F.min(unsigned(F.col("key")))).first()[0]
    if twice is not None:
        raise DuplicateKey(back(twice))
    long = F.octet_length("path") > MAX_PATH_BYTES
    wide = ((F.col("key") < 0) | (F.col("key") > 0xFFFFFFFF)) & F.lit(meta.key_width is KeyWidth.U32)
    odd = pairs.filter(wide | long).select("key", "path", wide.alias("wide"), long.alias("long"))
    r = odd.agg(F.min(F.when(F.col("wide"), unsigned(F.col("key")))).alias("wide"), F.min(F.when(F.col("long"), F.struct("path", unsigned(F.col("key")).alias("order")))).alias("long")).first()
    if r["wide"] is not None:
        raise KeyOutOfRange(back(r["wide"]))
    if r["long"] is not None:
        raise PathTooLong(back(r["long"]["order"]), len(r["long"]["path"].encode()))


class KeyedTable:
    """An immutable ``key -> path`` relation with its hash configuration."""

    def __init__(self, df: DataFrame, meta: TableMeta):
        self.df, self.meta = df.select("key", "path"), meta
        self.held: DataFrame | None = None

    @classmethod
    def build(cls, pairs: DataFrame, meta: TableMeta) -> KeyedTable:
        """Distinct pairs, checked; equal pairs collapse.

        The distinct pairs are kept (memory, then disk) for the checks and what
        is done with the table next; ``release`` lets them go.
        """
        rows = pairs.select(F.col("key").cast("long").alias("key"), F.col("path").cast("string").alias("path")).dropDuplicates(["key", "path"]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            check(rows, meta)
        except Exception:
            rows.unpersist()
            raise
        table = cls(rows, meta)
        table.held = rows
        return table

    def release(self) -> None:
        if self.held is not None:
            self.held.unpersist()
            self.held = None

    @classmethod
    def of_paths(cls, paths: DataFrame, meta: TableMeta) -> KeyedTable:
        return cls.build(paths.select(hash_path(F.col("path"), meta).alias("key"), "path"), meta)

    def hash_path(self, path: Column) -> Column:
        return hash_path(path, self.meta)

    def get(self, key: int) -> str | None:
        """The path of one (unsigned) key; an empty path is a hit, a miss is None."""
        rows = self.df.filter(F.col("key") == F.lit(to_signed(key))).select("path").take(1)
        return rows[0]["path"] if rows else None

    def get_batch(self, probes: DataFrame, key: str = "key", order: str | None = None) -> DataFrame:
        """``probes`` with ``path`` (null: a miss) and ``hit``; every probe row stays, copies too.

        With ``order``, a column that numbers the probes, the answers come back in that order.
        """
        table = self.df.select(F.col("key").alias("_key"), "path", F.lit(True).alias("hit"))
        found = probes.join(table, probes[key] == F.col("_key"), "left").drop("_key").withColumn("hit", F.coalesce("hit", F.lit(False)))
        return found if order is None else found.orderBy(order)

    def contains(self, probes: DataFrame, key: str = "key") -> DataFrame:
        """``probes`` with ``known``; of the table only the keys are read."""
        keys = self.df.select(F.col("key").alias("_key"), F.lit(True).alias("known")).distinct()
        return probes.join(keys, probes[key] == F.col("_key"), "left").drop("_key").withColumn("known", F.coalesce("known", F.lit(False)))

    def known(self, probes: DataFrame, key: str = "key") -> DataFrame:
        return probes.join(self.df.select(F.col("key").alias("_key")), probes[key] == F.col("_key"), "left_semi")

    def unknown(self, probes: DataFrame, key: str = "key") -> DataFrame:
        return probes.join(self.df.select(F.col("key").alias("_key")), probes[key] == F.col("_key"), "left_anti")

    def in_path_order(self) -> DataFrame:
        return self.df.orderBy("path", unsigned(F.col("key")))

    def in_key_order(self) -> DataFrame:
        return self.df.orderBy(unsigned(F.col("key")), "path")

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        """``n`` rows picked by a digest of seed and key: the same ones for the same seed, however the table is laid out."""
        return self.df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("key").cast("string"))), unsigned(F.col("key")), "path").limit(n)

    def resident(self) -> dict[int, str]:
        """The whole table on the driver, by unsigned key; for tables that are known to be small."""
        return {to_unsigned(r["key"]): r["path"] for r in self.df.toLocalIterator()}

    def __len__(self) -> int:
        return self.df.count()

    def checksum(self) -> int:
        """Order-independent digest of all pairs."""
        row = self.df.agg(F.bit_xor(xxh64(F.concat_ws(" ", F.hex("key"), "path"))).alias("x"), F.count("*").alias("n")).first()
        return to_unsigned((row["x"] or 0) ^ row["n"])

    def stats(self) -> DataFrame:
        """One row: entries, bytes of distinct paths, longest path, empty paths."""
        per_path = self.df.groupBy("path").agg(F.count("*").alias("n"))
        size = F.octet_length("path")
        return per_path.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("entries"), F.count("*").alias("paths"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("arena_bytes"), F.coalesce(F.max(size), F.lit(0)).cast("long").alias("longest"))

    def violations(self) -> DataFrame:
        """One row of counts that are all 0 in a sound table."""
        per_key = self.df.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("path")).alias("size"), F.max((~F.is_valid_utf8("path")).cast("int")).alias("broken"))
        wide = (F.col("key") < 0) | (F.col("key") > 0xFFFFFFFF) if self.meta.key_width is KeyWidth.U32 else F.lit(False)
        of = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
        return per_key.agg(of(F.col("n") > 1)("repeated_keys"), of(wide)("wide_keys"), of(F.col("size") > MAX_PATH_BYTES)("long_paths"), of(F.col("broken") > 0)("broken_paths"))

    @staticmethod
    def stored_bytes(spark: SparkSession, path: str) -> int:
        """Bytes that a written table takes where it lies."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()

    def mismatches(self) -> DataFrame:
        """Rows whose key is not the hash of their path."""
        return self.df.filter(self.hash_path(F.col("path")) != F.col("key"))

    def verify(self, checksum: int | None = None) -> None:
        if checksum is not None and self.checksum() != checksum:
            raise ChecksumMismatch("the table's checksum is another")
        found = {k: v for k, v in self.violations().first().asDict().items() if v}
        if found:
            raise VerifyError(f"violations: {found}")

    def write(self, path: str, by: str = "path") -> None:
        """zstd Parquet sorted by path (dense) or by key (prunes lookups), with the configuration beside it."""
        order = unsigned(F.col("key")) if by == "key" else F.col("path")
        self.df.repartitionByRange(order).sortWithinPartitions(order).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{by}")
        meta = json.dumps({"key_width": int(self.meta.key_width), "hash_kind": int(self.meta.hash_kind), "casing": int(self.meta.casing)})
        self.df.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def open(cls, spark: SparkSession, path: str, by: str = "path") -> KeyedTable:
        m = json.loads(spark.read.text(f"{path}/meta").first()["value"])
        return cls(spark.read.schema(SCHEMA).parquet(f"{path}/{by}"), TableMeta(KeyWidth(m["key_width"]), HashKind(m["hash_kind"]), Casing(m["casing"])))


def running(rows: DataFrame, order: list[Column], size: Column, to: str) -> DataFrame:
    """``rows`` with the column ``to``: the sum of ``size`` over all rows before, in the given order.

    Rows are dealt by range and summed inside each part; only the parts'
    totals, a row each, are summed one after the other.
    """
    placed = checkpointed(rows.withColumn("_size", size.cast("long")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("_part").agg(F.sum("_size").alias("_total")).select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inner", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(F.broadcast(bases), "_part")
    return summed.withColumn(to, F.col("_base") + F.col("_inner")).drop("_part", "_size", "_base", "_inner")


def placed_in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``place``, counted from 0 in the given order (which tells all rows apart)."""
    return running(rows, list(order), F.lit(1), "place")


def arena_offsets(paths: DataFrame) -> DataFrame:
    """``path, length, offset``: byte offsets of the distinct paths laid end to end in path order."""
    sized = paths.select("path").distinct().select("path", F.octet_length("path").cast("long").alias("length"))
    return running(sized, [F.col("path")], F.col("length"), "offset")


def descents(rows: DataFrame) -> DataFrame:
    """``at, key, before`` of stored keys (``at, key``) that are not over the key stored before them, unsigned; none in a sound table.

    A part's first key is compared with the last one of the part before, of
    which there is a row for each part.
    """
    placed = checkpointed(rows.select("at", "key").repartitionByRange("at").withColumn("_part", F.spark_partition_id()))
    lasts = placed.groupBy("_part").agg(F.max(F.struct("at", "key")).alias("last"))
    carried = lasts.select("_part", F.lag("last.key").over(Window.orderBy("_part")).alias("_carried"))
    inside = F.lag("key").over(Window.partitionBy("_part").orderBy("at"))
    told = placed.withColumn("before", inside).join(F.broadcast(carried), "_part").withColumn("before", F.coalesce("before", "_carried"))
    return told.filter(unsigned(F.col("key")) <= unsigned(F.col("before"))).select("at", "key", "before")


def frame_ids(offsets: DataFrame, frame_size: int) -> DataFrame:
    """``offsets`` with the first and last frame that an entry's bytes lie in (an empty one: that of its offset)."""
    return offsets.withColumn("first_frame", F.floor(F.col("offset") / frame_size)).withColumn("last_frame", F.floor((F.col("offset") + F.greatest("length", F.lit(1)) - 1) / frame_size))


def merge_lists(lists: Iterable[DataFrame]) -> DataFrame:
    """Distinct ``key, path`` of any number of parsed lists; a key with several paths keeps all."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [x.select("key", "path") for x in lists]).distinct()


def merge_report(merged: DataFrame, lists: Iterable[DataFrame]) -> DataFrame:
    """One row: rows, conflicts (paths beyond each key's first) and the widest hex token of the inputs."""
    from functools import reduce

    none = F.lit(None).cast("long")
    width = reduce(DataFrame.unionByName, [x.select("hex") for x in lists]).agg(none.alias("entries"), none.alias("conflicts"), F.coalesce(F.max(F.length("hex")), F.lit(1)).cast("long").alias("digits"))
    counts = merged.groupBy("key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("conflicts"), none.alias("digits"))
    return counts.unionByName(width).agg(*(F.max(c).alias(c) for c in ("entries", "conflicts", "digits")))


def adjacent_conflicts(merged: DataFrame) -> DataFrame:
    """``key, path, next_path``: each key's neighbouring paths, in path order."""
    w = Window.partitionBy("key").orderBy("path")
    return merged.withColumn("next_path", F.lead("path").over(w)).filter("next_path is not null")


def probe_keys(hexes: DataFrame) -> DataFrame:
    return hexes.select(parse_hex(F.trim("hex")).alias("key"))
