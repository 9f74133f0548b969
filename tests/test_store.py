import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from qaforge.plans import flows, prompts
from qaforge.sources import store


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "dataset_id string, n int")
    store.append(df, path, by="dataset_id")
    store.append(df.where("n = 1"), path, by="dataset_id")
    assert spark.read.parquet(path).count() == 3


def test_json_file(spark, tmp_path):
    name = store.stamped_name("run", datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc))
    assert name == "run_20240506T070809Z.json"
    store.save_json(spark, {"é": [1]}, str(tmp_path / name))
    text = (tmp_path / name).read_text()
    assert json.loads(text) == {"é": [1]} and "é" in text and "\n  " in text


def test_prompts_and_metrics(spark):
    r = spark.createDataFrame([("t" * 10_001,)], "t string").select(prompts.cleaning(F.col("t")).alias("c"), prompts.generation(F.col("t"), F.lit("fr")).alias("g"), prompts.enrichment(F.col("t")).alias("e")).first()
    assert len(r["c"]) == len(prompts.CLEANING) + 10_000 and "'fr'" in r["g"] and r["e"].endswith("t" * 10_001)
    found = spark.createDataFrame([("new",), ("exact",), ("similar",)], "type string")
    assert tuple(flows.metrics(found, 4, 2.0).first()) == (4, 3, 1, 2, 2.0, 2.0)
    assert flows.metrics(found, 4, 0).first()["urls_per_second"] == 0
