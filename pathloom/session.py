"""Session helpers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """The session that is there, as it is; else one on this machine, for the command line."""
    there = SparkSession.getActiveSession()
    if there is not None:
        return there
    return (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only a session on one
    machine may go without that setting and gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or "file://" + tempfile.mkdtemp(prefix="pathloom-")).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows and bytes of a batch that goes to a Python worker: long texts must not fill an executor's memory beside the heap.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark: SparkSession) -> None:
    """Gives this package's code to the executors' Python workers, once for each application, and bounds their batches where the session does not."""
    given = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in given:
            spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(prefix="pathloom-")) / "pathloom.zip"
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
