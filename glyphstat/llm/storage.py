"""Cutting lineage through the folder that all executors share."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _on_cluster(spark: SparkSession) -> bool:
    return not spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset, as in tests.

    On a cluster a folder of one machine would be invisible to the others, so the setting is needed there.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if _on_cluster(spark):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="glyphstat-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run meanwhile go when it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FILE_CLEANUP)
        else:
            spark.conf.set(_FILE_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there, so a lost executor repeats little."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        # A query takes the setting as it is when the query is made.
        return df.select("*").checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if the session is still there."""
    sc = spark.sparkContext
    if sc._jsc is not None:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared store, deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def store(df: DataFrame, name: str = "rows", by: str | None = None) -> DataFrame:
    """As :func:`cut`, in Parquet: compressed, and later steps read only the columns they need.

    With ``by`` the table is partitioned by a column.
    """
    path = new_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    with shuffles_removed(df.sparkSession):
        (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
