"""Tables on disk: staged ones, appends, pretty JSON files. `versions` has tables that several writers change."""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir), with a part of its own for this application.

    Only a local master may go without the setting (tests); it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.sparkContext.getCheckpointDir()
        if not base:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="qaforge-"))
            base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/qaforge-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the bytes of one Arrow batch, unless the session has a bound of its own.

    By rows alone (10000 by default), a batch of long texts takes tens of MB several times over in the JVM and in Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, size)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once into the folder that all executors share and read back, so that what made it, a served model say, runs
    once."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of `new_path` that nothing reads any more."""
    target, files = _files(spark, path)
    files.delete(target, True)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    """Add rows (snapshots, cleaned texts, question/answer rows). Files appear when the whole job commits, or not at all."""
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def stamped_name(prefix: str, now: datetime | None = None) -> str:
    """A file name with the time in UTC."""
    return f"{prefix}_{(now or datetime.now(timezone.utc)).astimezone(timezone.utc):%Y%m%dT%H%M%SZ}.json"


def save_json(spark: SparkSession, value, path: str) -> None:
    """One small object as an indented UTF-8 file, other letters than ASCII kept."""
    target, files = _files(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()
