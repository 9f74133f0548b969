"""Helpers that the operators of this subpackage share: tables, cut lineage, and small column expressions."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import bounded_batches, new_path  # noqa: F401  (bounded_batches is for the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df into the shared folder and read it back.

    The files survive lost executors. They belong to the checkpoint folder and go when it is emptied;
    `drop` removes one early.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._qaforge_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a table of `written` that nothing reads any more."""
    path = getattr(df, "_qaforge_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: it does so as the driver's garbage goes."""
    gc.collect()
    spark._jvm.System.gc()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with as many underscores before each that no column of df has it, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_rest(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def doc_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns most operators read, under fixed names; a null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
