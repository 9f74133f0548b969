"""Ingest of a stream of pages. Each micro-batch is compared with the store as it was before the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans import flows
from ..schema import EngineConfig

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
STORE = "page_id long, index int, question string, answer string, context string, confidence double, source_url string, id string, seq long"
KEYS = ["id", "seq", "question", "context", "source_url"]


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(pages: DataFrame, store: str, checkpoint: str, config: EngineConfig = EngineConfig()):
    """Start a query that appends the new rows of each batch of pages to the Parquet table `store`, and stop when all is read.

    Each batch has a folder of its own in the store and overwrites it, so a batch that runs again leaves no row twice.
    """
    spark = pages.sparkSession

    def append(batch: DataFrame, epoch: int) -> None:
        before = spark.read.schema(f"{STORE}, batch long").parquet(store).where(f"batch < {epoch}") if _exists(spark, store) else spark.createDataFrame([], STORE)
        found = flows.generate(batch, before.select(*KEYS), config)
        new = found.where("type = 'new'").select(*(f.split(" ")[0] for f in STORE.split(", ")))
        new.write.mode("overwrite").parquet(f"{store}/batch={epoch}")

    return pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)
