"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, shared_dir

__all__ = ["checkpointed", "emit", "fresh_dir", "pieces", "shared_dir", "stored", "table", "text_of", "texts", "thrown_away", "with_text"]

#: Bytes of payload after which a Python stage hands a batch back to Spark.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder as Parquet, for several readers, and where it lies."""
    path = fresh_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def thrown_away(spark: SparkSession, path: str) -> None:
    """Deletes what ``stored`` wrote, once nothing will read it again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text as a string that is never null."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the named columns, and nothing else."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), *(docs[k] for k in keep))


def with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of the struct ``whole``, with ``text`` put in and ``n_chars``, if there is one, counted anew."""

    def of(name: str) -> Column:
        if name == "text":
            return F.col("text").alias(name)
        if name == "n_chars":
            return F.length("text").cast(docs.schema[name].dataType).alias(name)
        return F.col("whole").getField(name).alias(name)

    return rows.select(*(of(c) for c in docs.columns))


def emit(schema: pa.Schema, rows: Iterable[tuple], weigh) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches of about ``BATCH_BYTES`` by ``weigh(row)``."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += weigh(row) + 64
        if size >= BATCH_BYTES:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of ``column`` each."""
    data = batch.column(batch.schema.get_field_index(column))
    start = size = 0
    for i, n in enumerate(_lengths(data)):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield batch.slice(start)


def _lengths(data: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(data), 0).to_pylist()
