"""Helpers shared by operators that need a cut in the lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir`` as it is, or
    the context's; only where neither is set (single-machine tests) a temporary one."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return current or os.path.join(tempfile.gettempdir(), "wordloom-tables")


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: its lineage is cut, its
    size is known to the planner, and losing an executor loses nothing.  The tables are
    removed when the process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wordloom-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def remove_tables() -> None:
    """Removes the tables that materialize() has written."""
    while _written:
        spark, path = _written.pop()
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
        except Exception:  # noqa: BLE001 - the session has ended already
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
