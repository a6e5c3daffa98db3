"""Session-level settings the operators read, and the tables they write on the way."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Folders of tables written on the way and names given to tables, by application.
_written: dict[str, list[str]] = {}
_named: dict[str, list[str]] = {}


def _named_folder(spark: SparkSession) -> str | None:
    return spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    folder = _named_folder(spark)
    if folder is None:
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    return folder


def use_local_folder(spark: SparkSession) -> None:
    """Name a temporary folder for a local session, where driver and executors are one process and none is named."""
    context = spark.sparkContext
    if _named_folder(spark) is None and (context.master == "local" or context.master.startswith("local[")):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="recurra-"))


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a new folder in the shared one; ``remove_tables`` removes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_table(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it from there, which fixes every value in it."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def note_name(spark: SparkSession, name: str) -> None:
    """Let ``remove_tables`` forget a table of this session; its files are not its own."""
    _named.setdefault(spark.sparkContext.applicationId, []).append(name)


def remove_tables(spark: SparkSession) -> None:
    """Remove all tables this application wrote on the way. Results that were computed from them must be saved before."""
    for name in _named.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in _written.pop(spark.sparkContext.applicationId, []):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
