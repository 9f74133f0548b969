"""Stores bucketed by a key, so that a batch is compared with them without moving them.

A store is a table of the catalogue whose files are dealt by a hash of the key into a fixed number of buckets and sorted
within them. A join on the key then reads each bucket where it lies: only the batch is shuffled, into the store's buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_bucketed(rows: DataFrame, name: str, path: str, key: str = "id", buckets: int = 64) -> DataFrame:
    """Write rows as a bucketed table of this name at this path, and read it back.

    Choose as many buckets as one of them fits a task: a store of 1 TB with 4096 has 256 MB in each. Rows of one key lie in one
    bucket, whatever their number. A table of that name is replaced in the catalogue; files at the path must not exist.
    """
    spark = rows.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    # One file for each bucket, which a sort-merge join takes as sorted.
    dealt = rows.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def append_bucketed(rows: DataFrame, name: str, key: str = "id") -> None:
    """Add rows to a bucketed table, in its own buckets."""
    spark = rows.sparkSession
    found = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED `{name}`").collect()}
    if "Num Buckets" not in found:
        raise ValueError(f"{name} is not bucketed")
    buckets = int(found["Num Buckets"])
    rows.select(*spark.table(name).columns).repartition(buckets, key).write.mode("append").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def probed(batch: DataFrame, store: DataFrame, key: str = "id", flag: str = "exists") -> DataFrame:
    """batch with a flag: whether the store (bucketed by the key) has the row's key. Null keys are in no store.

    Only the batch's distinct keys are shuffled, into the store's buckets, where each bucket's keys are read in a stream past a
    hash table of the batch's; the store's side of the plan has neither an exchange nor a sort. A key that either side has many
    times is probed once. A column of the flag's name is replaced.
    """
    own, hit = "_key", "_hit"
    while own in batch.columns or hit in batch.columns:
        own, hit = f"_{own}", f"_{hit}"
    keys = batch.select(F.col(key).alias(own)).where(F.col(own).isNotNull()).distinct()
    hits = store.select(F.col(key).alias(own)).join(keys.hint("shuffle_hash"), own, "left_semi").distinct().withColumn(hit, F.lit(True))
    return batch.drop(flag).join(hits, F.col(key) == F.col(own), "left").withColumn(flag, F.coalesce(hit, F.lit(False))).drop(own, hit)


def new_rows(batch: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    """The rows of batch whose keys the store doesn't have; those without a key stay."""
    flag = "_exists"
    while flag in batch.columns:
        flag = f"_{flag}"
    return probed(batch, store, key, flag).where(~F.col(flag)).drop(flag)
