"""Rows clustered by dataset and time, so that a page of a dataset reads few files however deep it lies.

Files hold neighbouring rows in the order of pages (latest first, then id), and a manifest says which times each file has of
each dataset. A page is asked for by the place after which it begins (the last row of the page before), not by an offset:
the manifest gives the files, and only those are opened.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows without a time come last.
_NEVER = "0001-01-01 00:00:00"


class Cursor(NamedTuple):
    """The last row of a page."""

    created_at: datetime
    id: str


def _time() -> Column:
    return F.coalesce(F.col("created_at").cast("timestamp_ntz"), F.lit(_NEVER).cast("timestamp_ntz"))


def _at(cursor: Cursor) -> Column:
    return F.lit(cursor.created_at.isoformat(sep=" ")).cast("timestamp_ntz")  # as text: no time zone or calendar comes in


def write_clustered(rows: DataFrame, path: str, rows_per_file: int = 100_000, partitions: int | None = None) -> None:
    """Write rows (dataset_id, created_at, id and any others) at a path where nothing is yet.

    Ranges of (dataset_id, time, id) are dealt to tasks, so a dataset of any size is split; ids are unique within a dataset and
    a time, or else equal rows may lie in several files, which pages allow for. A null dataset_id is a dataset of its own.
    """
    spark = rows.sparkSession
    order = [F.col("dataset_id").asc_nulls_first(), F.col("_time").desc(), F.col("id").asc_nulls_first()]
    timed = rows.withColumn("_time", _time())
    dealt = timed.repartitionByRange(partitions, *order) if partitions else timed.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows").select("dataset_id", "_time", F.col("_metadata.file_path").alias("file"))
    facts = stored.groupBy("dataset_id", "file").agg(F.count("*").alias("n"), F.max("_time").alias("newest"), F.min("_time").alias("oldest"))
    # Sorted by dataset, so that a page reads one row group of it.
    facts.repartitionByRange("dataset_id").sortWithinPartitions("dataset_id", F.col("newest").desc()).write.parquet(f"{path}/manifest")


def files_of_page(spark: SparkSession, path: str, dataset_id: str | None, limit: int, after: Cursor | None = None) -> list[str]:
    """The files that a page may have rows in: those that reach over the cursor's time, and the next ones up to `limit` rows."""
    own = spark.read.parquet(f"{path}/manifest").where(F.col("dataset_id").eqNullSafe(F.lit(dataset_id)))
    if after is not None:
        now = _at(after)
        own = own.where(F.col("oldest") <= now)
        whole = F.col("newest") < now  # all of its rows come after the cursor
    else:
        whole = F.lit(True)
    # Rows of the files that begin later than this one. Those that begin at the same time may interleave with it.
    sized = own.withColumn("whole", F.when(whole, F.col("n")).otherwise(0))
    newer = Window.partitionBy("dataset_id").orderBy(F.col("newest").desc())
    before = F.sum("whole").over(newer.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("whole").over(Window.partitionBy("dataset_id", "newest"))
    return [r["file"] for r in sized.withColumn("before", before).where(F.col("before") < limit).select("file").collect()]


def page(spark: SparkSession, path: str, dataset_id: str | None, limit: int = 10, after: Cursor | None = None) -> DataFrame:
    """The `limit` rows of a dataset after a cursor (the first ones without one), the latest first, ties in the order of ids.

    The same rows as an offset gives, but for rows of equal time and id, of which those after the cursor's are left out. An
    unknown dataset, and a page after the last one, are empty.
    """
    if limit < 1:
        raise ValueError(f"limit must be at least 1, not {limit}")
    files = files_of_page(spark, path, dataset_id, limit, after)
    stored = spark.read.parquet(f"{path}/rows")
    if not files:
        return stored.limit(0).drop("_time")
    rows = spark.read.schema(stored.schema).parquet(*files).where(F.col("dataset_id").eqNullSafe(F.lit(dataset_id)))
    if after is not None:
        now = _at(after)
        rows = rows.where((F.col("_time") < now) | (F.col("_time") == now) & (F.col("id") > F.lit(after.id)))
    return rows.orderBy(F.col("_time").desc(), "id").limit(limit).drop("_time")


def cursor_of(one_page: DataFrame) -> Cursor | None:
    """Where the next page begins; None after an empty page."""
    last = one_page.select(_time().alias("t"), "id").orderBy(F.col("t").asc(), F.col("id").desc()).first()
    return None if last is None else Cursor(last["t"], last["id"])
