"""Lookups through an overlay and a stack of tables: the first that knows a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MergeConfig
from ..functions.hashing import hash_text
from ..functions.keys import to_signed, to_unsigned
from ..meta import TableMeta
from .table import SCHEMA, KeyedTable


class LayeredTable:
    """An overlay of rows that were put in, above tables in the order they were pushed."""

    def __init__(self, spark: SparkSession, bases: list[KeyedTable] | None = None):
        self.spark, self.bases = spark, []
        self.overlay: dict[int, str] = {}
        for base in bases or []:
            self.push_base(base)

    def push_base(self, base: KeyedTable) -> None:
        """Puts a table below the others; all must make keys alike."""
        mine = self.meta
        if mine is not None and (mine.key_width, mine.algorithm, mine.casing) != (base.meta.key_width, base.meta.algorithm, base.meta.casing):
            raise MergeConfig(f"{base.meta} below {mine}")
        self.bases.append(base)

    @property
    def meta(self) -> TableMeta | None:
        return self.bases[0].meta if self.bases else None

    @property
    def overlay_len(self) -> int:
        return len(self.overlay)

    def insert(self, key: int, path: str) -> None:
        self.overlay[to_signed(key)] = path

    def extend(self, pairs) -> None:
        for key, path in pairs:
            self.insert(key, path)

    def insert_path(self, path: str) -> int | None:
        """Puts a path in under the key that the first table's hash gives it; None without tables."""
        if self.meta is None:
            return None
        key = hash_text(path, self.meta)
        self.overlay[key] = path
        return to_unsigned(key)

    def layers(self) -> list[DataFrame]:
        top = self.spark.createDataFrame(list(self.overlay.items()), SCHEMA)
        return [top, *(b.df for b in self.bases)] if self.overlay else [b.df for b in self.bases]

    def get_batch(self, probes: DataFrame, key: str = "key") -> DataFrame:
        """``probes`` with ``path`` and ``layer`` (the overlay is 0, the tables follow; null: a miss)."""
        return resolve(probes, self.layers(), key, 0 if self.overlay else 1)

    def get(self, key: int) -> str | None:
        signed = to_signed(key)
        if signed in self.overlay:
            return self.overlay[signed]
        return next((p for b in self.bases if (p := b.get(key)) is not None), None)

    def contains(self, key: int) -> bool:
        return self.get(key) is not None


def resolve(probes: DataFrame, layers: list[DataFrame], key: str = "key", first: int = 0) -> DataFrame:
    """One left join for each layer; a probe that an upper layer knows finds nothing below.

    Resolved probes keep their own key in the join, so that they stay spread
    over the partitions, however many there are.
    """
    out = probes.withColumn("path", F.lit(None).cast("string")).withColumn("layer", F.lit(None).cast("int"))
    for n, rows in enumerate(layers, first):
        layer = rows.select(F.col("key").alias("_key"), F.col("path").alias("_path"), F.lit(n).alias("_layer"))
        out = out.join(layer, (F.col(key) == F.col("_key")) & F.col("layer").isNull(), "left")
        out = out.withColumn("path", F.when(F.col("_key").isNotNull(), F.col("_path")).otherwise(F.col("path"))).withColumn("layer", F.coalesce("layer", "_layer")).drop("_key", "_path", "_layer")
    return out


class ExtendedTable(LayeredTable):
    """One table with an overlay."""

    def __init__(self, base: KeyedTable):
        super().__init__(base.df.sparkSession, [base])

    @property
    def base(self) -> KeyedTable:
        return self.bases[0]
