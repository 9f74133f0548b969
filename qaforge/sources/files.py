"""File sources: JSON arrays, directory listings, pages and knowledge files in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import FILE_ITEM


def _status(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.getFileStatus(target) if files.exists(target) else None


def json_items(spark: SparkSession, path: str, schema: T.StructType = FILE_ITEM) -> DataFrame:
    """The objects of a file that holds one JSON array. A missing file or a folder is not found; bad JSON is an error when read."""
    status = _status(spark, path)
    if status is None or status.isDirectory():
        raise FileNotFoundError(path)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_files(spark: SparkSession, folder: str) -> DataFrame:
    """name of each *.json file right in the folder, sorted; none if there is no such folder."""
    status = _status(spark, folder)
    if status is None or not status.isDirectory():
        return spark.createDataFrame([], "name string")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", False).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name")).orderBy("name")


def exploded_files(knowledge: DataFrame) -> DataFrame:
    """knowledge_id and file_id for each entry of `files` (array of structs with an id); a knowledge without files is an error."""
    checked = F.when(F.coalesce(F.size("files"), F.lit(0)) <= 0, F.raise_error(F.lit("No files found"))).otherwise(F.col("files"))
    return knowledge.select("knowledge_id", F.posexplode(checked).alias("n", "f")).select("knowledge_id", "n", F.col("f.id").alias("file_id"))
