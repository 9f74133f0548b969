"""Export of question/answer rows: item projections, previews, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dataset_name
from ..sources.store import bounded_batches
from .qa import flat

#: Characters of the arrays that JSON files hold, about; a longer row has a file of its own.
ARRAY_CHARS = 1 << 24


def _json(c: str) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def items(qa: DataFrame) -> DataFrame:
    """id, and input, expected_output and metadata as JSON; the last two are null where a row has none."""
    return qa.select("dataset_id", "id", _json("input").alias("input"), F.when(F.col("expected_output").isNotNull(), _json("expected_output")).alias("expected_output"), F.when(F.col("qa_metadata").isNotNull(), _json("qa_metadata")).alias("metadata"))


def preview(qa: DataFrame, n: int = 3) -> DataFrame:
    """The first n items of each dataset by seq, with the dataset's total and a note."""
    totals = qa.groupBy("dataset_id").agg(F.count("*").alias("total_items"))
    # Spark limits each group before the shuffle, as only the first n ranks are asked for.
    ranked = qa.withColumn("place", F.row_number().over(Window.partitionBy("dataset_id").orderBy("seq"))).where(F.col("place") <= n)
    shown = ranked.select("dataset_id", "place", "id", _json("input").alias("input")).join(totals, "dataset_id")
    # The note's wording is a fixed value.
    note = F.format_string("Showing %d items out of %d total", F.least(F.lit(n).cast("long"), F.col("total_items")), F.col("total_items"))
    return shown.select("dataset_id", "place", "id", "input", "total_items", note.alias("preview_note"))


def file_items(rows: DataFrame, name: Column) -> DataFrame:
    """Items of a file's array `items` (FILE_ITEM structs) in its order: ids default to item_<n>, confidence to 1, context to ''.

    An item without a question or an answer (null; empty ones pass) is an error that names its file.
    """
    one = rows.select(name.alias("file"), F.posexplode("items").alias("n", "x"), F.size("items").alias("total_items"))
    id_ = F.coalesce("x.id", F.concat(F.lit("item_"), F.col("n").cast("string")))
    whole = F.col("x.question").isNotNull() & F.col("x.answer").isNotNull()
    failed = F.raise_error(F.concat(F.lit("question and answer are required in each item of "), F.coalesce("file", F.lit("a file")))).cast("boolean")
    return one.where(F.when(whole, F.lit(True)).otherwise(failed)).select(dataset_name(F.col("file")).alias("dataset"), id_.alias("id"), F.col("x.question").alias("question"), F.col("x.answer").alias("answer"), F.coalesce("x.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("x.context", F.lit("")).alias("context"), "total_items")


def send(rows: DataFrame, sink: Callable[[], Callable[[dict], None]]) -> DataFrame:
    """Hand each row (id and any columns) to a sink, which is opened once in each task: id, status (created or failed), error.

    One row's failure does not touch the others. A sink must take a row twice, as a task may run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        put = sink()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    put(row)
                    out.append((row["id"], "created", None))
                except Exception as error:  # reported with its row
                    out.append((row["id"], "failed", str(error)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3, ["id", "status", "error"])

    return rows.mapInArrow(run, "id string, status string, error string")


def outcome(sent: DataFrame) -> DataFrame:
    return sent.agg(F.count_if(F.col("status") == "created").alias("created"), F.count_if(F.col("status") == "failed").alias("failed"))


def write(qa: DataFrame, path: str, kind: str) -> None:
    """jsonl: one object a line. json: one array of objects for each file. csv: quoted, with a header.

    Readers hold an array as a whole, so a task writes files of about ARRAY_CHARS characters, as many as its rows need.
    """
    rows = flat(qa)
    bounded_batches(qa.sparkSession)
    if kind == "jsonl":
        rows.write.mode("overwrite").json(path)
    elif kind == "csv":
        rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    elif kind == "json":

        def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def array() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(["[" + "\n,".join(held) + "]"], pa.string())], ["value"])

            held, size, made = [], 0, False
            for batch in batches:
                for row in batch.column("value").to_pylist():
                    if held and size + len(row) > ARRAY_CHARS:
                        yield array()
                        held, size, made = [], 0, True
                    held.append(row)
                    size += len(row)
            if held or not made:
                yield array()

        # A row of the written table is one whole array, and a file has one such row.
        rows.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(arrays, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    else:
        raise ValueError(f"kind must be jsonl, json or csv, not {kind!r}")
