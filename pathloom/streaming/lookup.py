"""Streams of hashes against a table: an extension beside the batch lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.table import KeyedTable


def lookup_stream(hashes: DataFrame, table: KeyedTable, key: str = "key") -> DataFrame:
    """A stream of keys with the table's paths; stateless, so every micro-batch is one join."""
    return table.get_batch(hashes, key)


def promote_stream(resolved: DataFrame, path: str, checkpoint: str):
    """Appends newly resolved pairs to a directory, exactly once per micro-batch, each key's smallest path."""

    def write(batch: DataFrame, epoch: int) -> None:
        pairs = batch.filter("path is not null").groupBy("key").agg(F.min("path").alias("path"))
        pairs.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return resolved.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
