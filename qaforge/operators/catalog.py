"""The catalogue of datasets: create, look up, list, change, delete. Tables are immutable; changes return new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_time, sha256


def dataset_id(name: Column) -> Column:
    """A dataset's id, which its name determines."""
    return sha256(F.concat(F.lit("dataset:"), name))


def _new(names: DataFrame, clock: Column) -> DataFrame:
    return names.select(dataset_id(F.col("name")).alias("id"), "name", "description", clock.cast("timestamp_ntz").alias("created_at"))


def get_or_create(existing: DataFrame, wanted: DataFrame, clock: Column) -> DataFrame:
    """existing and the datasets of wanted (name, description) that it lacks; an existing description stays."""
    described = wanted.groupBy("name").agg(F.min("description").alias("description"))
    described = described.withColumn("description", F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("Questions and answers: "), F.col("name"))))
    return existing.unionByName(_new(described.join(existing.select("name"), "name", "left_anti"), clock))


def create(existing: DataFrame, wanted: DataFrame, clock: Column) -> DataFrame:
    """existing and wanted; a name that exists or comes twice is an error."""
    names = existing.select("name", "description").withColumn("_new", F.lit(0)).unionByName(wanted.select("name", "description").withColumn("_new", F.lit(1)))
    taken = names.groupBy("name").agg(F.sum("_new").alias("new"), F.count("*").alias("n")).where("new > 0 AND n > 1").limit(1).collect()
    if taken:
        raise ValueError(f"dataset {taken[0]['name']!r} exists")
    return existing.unionByName(_new(wanted, clock))


def found(existing: DataFrame, value: str, column: str = "id") -> DataFrame:
    """The dataset of this id or name; an error that names some others if there is none."""
    out = existing.where(F.col(column) == value).limit(1)
    if out.isEmpty():
        others = [r[0] for r in existing.select("name").distinct().orderBy("name").limit(20).collect()]
        raise LookupError(f"no dataset with {column} {value!r}; there are {others}")
    return out


def listed(existing: DataFrame) -> DataFrame:
    """id, name, description and created_at, the latest first."""
    return existing.select("id", "name", "description", "created_at").orderBy(F.col("created_at").desc(), "id")


def headers(existing: DataFrame, qa: DataFrame) -> DataFrame:
    """Each dataset with its number of rows."""
    n = qa.groupBy(F.col("dataset_id").alias("id")).agg(F.count("*").alias("qa_sources_count"))
    return existing.join(n, "id", "left").select("id", "name", "description", iso_time(F.col("created_at")).alias("created_at"), F.coalesce("qa_sources_count", F.lit(0).cast("long")).alias("qa_sources_count"))


def described(existing: DataFrame, id: str, description: str) -> DataFrame:
    return existing.withColumn("description", F.when(F.col("id") == id, F.lit(description)).otherwise(F.col("description")))


def deleted(ids: DataFrame, datasets: DataFrame, qa: DataFrame, snapshots: DataFrame, cleaned: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the datasets of ids and all that belongs to them, and `counts`: rows of each dataset that go."""
    gone_pages = snapshots.join(ids.select(F.col("id").alias("dataset_id")), "dataset_id", "left_semi").select(F.col("id").alias("page_snapshot_id"))
    of_dataset = ids.select(F.col("id").alias("dataset_id"))
    counts = of_dataset.join(qa.groupBy("dataset_id").agg(F.count("*").alias("n")), "dataset_id", "left")
    return {
        "datasets": datasets.join(ids.select("id"), "id", "left_anti"),
        "qa": qa.join(of_dataset, "dataset_id", "left_anti"),
        "snapshots": snapshots.join(of_dataset, "dataset_id", "left_anti"),
        "cleaned": cleaned.join(gone_pages, "page_snapshot_id", "left_anti"),
        "counts": counts.select("dataset_id", F.coalesce("n", F.lit(0).cast("long")).alias("records_deleted")),
    }


def orphans(qa: DataFrame, datasets: DataFrame) -> DataFrame:
    """Rows whose dataset is gone."""
    return qa.join(datasets.select(F.col("id").alias("dataset_id")), "dataset_id", "left_anti")
