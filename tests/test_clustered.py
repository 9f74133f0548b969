"""Pages by cursor, and counters that come with a write."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from qaforge.plans import flows
from qaforge.sources import clustered

ROWS = "dataset_id string, created_at timestamp_ntz, id string, n int"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    rows = [("big", start + timedelta(minutes=rng.randrange(600)), f"i{k:05d}", k) for k in range(3000)]
    rows += [("ties", start, f"t{k:04d}", k) for k in range(150)] + [("small", start, "only", 1), (None, start, "none", 2), ("times", None, "never", 3), ("times", start, "once", 4)]
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("clustered"))
    clustered.write_clustered(spark.createDataFrame(rows, ROWS), path, rows_per_file=100, partitions=6)
    return path, rows


@pytest.mark.parametrize(("dataset", "limit"), [("big", 37), ("ties", 20), ("small", 5), (None, 5), ("times", 1), ("unknown", 5)])
def test_pages_equal_offsets(spark, stored, dataset, limit):
    path, rows = stored
    want = [r[2] for r in sorted((r for r in rows if r[0] == dataset), key=lambda r: (-(r[1] or datetime(1, 1, 2)).timestamp() if r[1] else 1e18, r[2]))]
    got, after, pages = [], None, 0
    while pages < 12:
        page = clustered.page(spark, path, dataset, limit, after).collect()
        got += [r["id"] for r in page]
        after = clustered.cursor_of(clustered.page(spark, path, dataset, limit, after))
        pages += 1
        if after is None:
            assert not page
            break
    assert got == want[: len(got)] and len(got) == min(len(want), pages * limit)


def test_a_deep_page_reads_few_files(spark, stored):
    path, rows = stored
    n_files = spark.read.parquet(f"{path}/manifest").select("file").distinct().count()
    own = sorted((r for r in rows if r[0] == "big"), key=lambda r: (-r[1].timestamp(), r[2]))
    deep = clustered.Cursor(own[2499][1], own[2499][2])
    assert n_files >= 30 and len(clustered.files_of_page(spark, path, "big", 10, deep)) <= 3
    page = clustered.page(spark, path, "big", 10, deep)
    assert [r["id"] for r in page.collect()] == [r[2] for r in own[2500:2510]]
    assert len(page.inputFiles()) <= 3
    with pytest.raises(ValueError):
        clustered.page(spark, path, "big", 0)


def test_counters_come_with_the_write(spark, tmp_path):
    found = spark.createDataFrame([(i, ["new", "exact", "similar", "new"][i % 4]) for i in range(100)], "id int, type string").coalesce(2)
    context, path = spark.sparkContext, str(tmp_path / "rows")
    context.setJobGroup("observed", "one job")
    metrics = flows.stored(found, lambda rows: rows.write.parquet(path), 5)
    jobs = len(context.statusTracker().getJobIdsForGroup("observed"))
    context.setJobGroup("", "")
    assert jobs == 1
    metrics = metrics.first()
    assert (metrics["urls_processed"], metrics["total_questions"], metrics["stored"], metrics["exact_duplicates"], metrics["similar_duplicates"]) == (5, 100, 50, 25, 25)
    assert metrics["seconds"] > 0 and spark.read.parquet(path).columns == ["id"] and spark.read.parquet(path).count() == 50
    none = flows.stored(found.limit(0), lambda rows: rows.write.parquet(str(tmp_path / "none")), 0).first()
    assert (none["total_questions"], none["stored"], none["urls_per_second"]) == (0, 0, 0.0)
    assert found.where(F.col("type") == "new").count() == 50
