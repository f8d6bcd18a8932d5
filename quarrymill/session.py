"""What the library reads from, and keeps in, the running session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark then deletes the shuffle files of a query once it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a narrow table (a few ids and numbers) that may be broadcast: some tens of megabytes.
MOST_BROADCAST = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a temporary folder is
    made and the setting is filled in, but only if the session runs on this one machine: a
    cluster's executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a re-run of the plan before.
    Shuffle files of the write go with its end, the table when it is released or the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    where, files = _hadoop(spark, path)
    files.deleteOnExit(where)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned and that no later plan reads."""
    for df in tables:
        where, files = _hadoop(df.sparkSession, df.written_to)
        files.delete(where, True)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    """A Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def sized(df: DataFrame, name: str = "table", most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, written, with a broadcast hint if it has at most ``most`` rows; else joins shuffle it."""
    written = materialise(df, name)
    if written.count() > most:
        return written
    hinted = F.broadcast(written)
    hinted.written_to = written.written_to
    return hinted


def short_batches(spark: SparkSession) -> None:
    """Hand Python tasks a thousand rows at once instead of Spark's ten thousand: an executor holds
    several copies of a batch, and texts may be long. A session that sets another number keeps it."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python path has it or it was sent.

    ``addPyFile`` serves the archive from the driver, so nothing has to be shared for it.
    """
    here = Path(__file__).resolve().parent
    if str(here.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if any(f.endswith(f"/{here.name}.zip") for f in spark.sparkContext.listFiles):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{here.name}.zip"
    with zipfile.ZipFile(archive, "w") as packed:
        for file in sorted(here.rglob("*.py")):
            packed.write(file, file.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(archive))
