"""A corpus pipeline: toxicity, line dedup, near duplicates, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the
columns of ``docs``; a stage that changes texts also brings ``n_chars`` up to
date.  What a stage returns is written to the shared folder and reread, as each
stage goes over its input several times.

Defined cases: a row with a null id cannot be told toxic and is never another
document's near duplicate, so it stays; of rows that are equal in id (or both
have none) and text one stays, from the third stage on.  Empty tables go
through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import jaccard_join, line_dedup, packing, secrets, toxicity
from pathloom.llm.common import stored, table, text_of
from pathloom.session import ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go, with all rows of their id."""
    ship(spark)
    scores = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    gone = scores.filter("predicted = 1 and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them."""
    ship(spark)
    rows = line_dedup.keyed(docs)
    bitmaps = line_dedup.keep_bitmaps(rows)
    return line_dedup.keep_lines(docs, bitmaps)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, once."""
    ship(spark)
    classes = jaccard_join.jaccard_classes(docs)
    gone = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("gone_id"), F.col("row_hash").alias("gone_row")).distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("whole"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("row_hash"))
    left = rows.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col("row_hash") == F.col("gone_row")), "left_anti")
    return left.dropDuplicates(["doc_id", "row_hash"]).select(*(F.col("whole").getField(c).alias(c) for c in docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; the documents stay."""
    ship(spark)
    forest = secrets.train_forest(secrets.findings_frame(spark, secrets.training_findings()))
    return secrets.redacted(docs, forest)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", without_near_duplicates),
    ("secrets", without_secrets),
    ("packing", packed),
]
#: Two of the stages are models, which SQL cannot express; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
