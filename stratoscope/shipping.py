"""Sends this package to the executors' Python workers, and names folders that all of them share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of an Arrow batch on its way to a worker and back, where the session has no setting of its own: a few are held at once for each core.
BATCH = 8 << 20


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the application once, so that workers find it wherever they run; and keeps Arrow batches small."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH))
    if context.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="stratoscope-py-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where the session is local and has none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='stratoscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/stratoscope-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession) -> str:
    """A new path in that folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it again: what several steps use is computed once, and a lost executor costs no earlier step.

    With a ``path`` of its own, a table can be discarded, and its shuffle files go as soon as it is written; else they stay until the driver
    happens to collect its garbage.
    """
    if path is None:
        path = shared_path(df.sparkSession)
        df.write.parquet(path)
    else:
        conf = df.sparkSession.conf
        before = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables that no later step reads."""
    for path in paths:
        _delete(spark, path)


def clear_shared(spark: SparkSession) -> None:
    """Deletes what this application has written there; call it once its results are written."""
    _delete(spark, shared_dir(spark))
