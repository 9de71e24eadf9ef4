"""Tables in the folder that driver and executors share: where lineage is cut."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, in local mode only, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weirlog-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that this thread's materialise calls write meanwhile; the innermost record gets them."""
    records = _own.__dict__.setdefault("records", [])
    records.append(paths := [])
    try:
        yield paths
    finally:
        records.remove(paths)


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for path in paths:
        fs, where = _file_system(spark, path)
        fs.delete(where, True)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and reads it back, with its path. What is left of such tables goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if records := _own.__dict__.get("records"):
        records[-1].append(path)
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, rows are fixed."""
    return written(df, label)[0]
