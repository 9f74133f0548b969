"""Reading and changing question/answer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import checked_page
from . import catalog


def flat(qa: DataFrame) -> DataFrame:
    """The fields of the nested columns under their own names, with defaults for missing ones (a confidence of 0)."""
    empty = F.lit("")
    return qa.select(
        "id",
        F.coalesce("input.question", empty).alias("question"),
        F.coalesce("expected_output.answer", empty).alias("answer"),
        F.coalesce("input.context", empty).alias("context"),
        F.coalesce("input.source_url", empty).alias("source_url"),
        F.coalesce("expected_output.confidence", F.lit(0.0)).alias("confidence"),
        "created_at",
        "dataset_id",
    )


def page(qa: DataFrame, datasets: DataFrame, dataset_id: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of a dataset's rows, the latest first, each with the total of the dataset. An unknown dataset is an error."""
    limit, offset = checked_page(limit, offset)
    catalog.found(datasets, dataset_id)
    rows = qa.where(F.col("dataset_id") == dataset_id)
    one_page = flat(rows.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit))
    return one_page.withColumn("total_count", F.lit(rows.count()).cast("long"))


def detail(qa: DataFrame, datasets: DataFrame) -> DataFrame:
    """Rows with the id and name of their dataset, null where it is missing. Filter by id for one row."""
    names = datasets.select(F.col("id").alias("_id"), "name")
    return flat(qa).join(names, F.col("dataset_id") == F.col("_id"), "left").withColumn("dataset", F.when(F.col("_id").isNotNull(), F.struct(F.col("_id").alias("id"), "name"))).drop("_id", "name", "dataset_id")


def inserted(qa: DataFrame, rows: DataFrame) -> DataFrame:
    """qa and rows; an id that exists or comes twice is an error."""
    ids = qa.select("id").unionByName(rows.select("id"))
    twice = ids.groupBy("id").count().where("count > 1").join(rows.select("id"), "id", "left_semi").limit(1).collect()
    if twice:
        raise ValueError(f"row {twice[0]['id']} exists")
    return qa.unionByName(rows, allowMissingColumns=True)


def updated(qa: DataFrame, id: str, **values: Column) -> DataFrame:
    """qa with new values in the row of this id (updated_at stays as it is); an unknown id is an error."""
    if qa.where(F.col("id") == id).isEmpty():
        raise LookupError(f"no row {id!r}")
    return qa.withColumns({k: F.when(F.col("id") == id, v).otherwise(F.col(k)) for k, v in values.items()})


def without(qa: DataFrame, ids: DataFrame) -> DataFrame:
    """qa without rows of these ids; unknown ids do nothing."""
    return qa.join(ids.select("id"), "id", "left_anti")
