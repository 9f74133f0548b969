"""Whole flows: from pages to a store without duplicates, and from knowledge files to rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.html import page_text
from ..functions.text import chunks, content_id, sha256
from ..operators import dedup, validate
from ..schema import EngineConfig
from ..sources.store import staged
from .models import Cleaner, Generator, offline_cleaner, offline_generator


def snapshots(pages: DataFrame) -> DataFrame:
    """page_id, url, url_hash and content (text) of pages (page_id, url, html)."""
    return pages.select("page_id", "url", sha256(F.col("url")).alias("url_hash"), page_text(F.col("html")).alias("content"))


def pairs_of(texts: DataFrame, generator: Generator, keep: list[str]) -> DataFrame:
    """A row for each pair that the generator gives for `text`, with its index from 0."""
    return texts.select(*keep, F.posexplode(generator(F.col("text"))).alias("index", "p")).select(*keep, "index", "p.question", "p.answer", "p.context", "p.confidence")


def checked_models(config: EngineConfig, *names: str) -> None:
    """An error for a model's name that the configuration does not list."""
    for name in names:
        if name not in config.models:
            raise ValueError(f"model {name!r} is not among {list(config.models)}")


def generate(pages: DataFrame, store: DataFrame, config: EngineConfig = EngineConfig(), cleaner: Cleaner = offline_cleaner, generator: Generator = offline_generator, models: tuple[str, ...] = ("offline",)) -> DataFrame:
    """Classified rows for pages (page_id, url, html) against a store (id, seq, question, context, source_url).

    Identity and similarity look at the page's whole cleaned text as context. Pairs that are not valid drop all of their page.
    The models run once: what they gave is written before its rows are validated and compared. models: their names, which
    must be among those of the configuration.
    """
    checked_models(config, *models)
    cleaned = snapshots(pages).where("content <> ''").select("page_id", F.col("url").alias("source_url"), cleaner(F.col("content")).alias("text"))
    pairs = staged(pairs_of(cleaned, generator, ["page_id", "source_url", "text"]), "generated")
    valid = validate.valid_rows(pairs, batch="page_id").withColumn("context", F.col("text")).drop("text")
    rows = valid.withColumns({"id": content_id(F.col("question"), F.col("context"), F.col("source_url")), "seq": F.col("page_id") * 1_000_000 + F.col("index")})
    return dedup.ingest(rows, store, config.similarity)


def enrich(files: DataFrame, config: EngineConfig = EngineConfig(), generator: Generator = offline_generator, clock: Column | None = None) -> DataFrame:
    """Rows of the store for knowledge files (file_id, dataset_id, content): chunks, pairs of each chunk with their own context,
    rows without a required field skipped, none compared with others. The index counts from 0 in each chunk."""
    parts = files.where("content <> ''").select("file_id", "dataset_id", F.posexplode(chunks(F.col("content"), config.chunk_size, config.overlap)).alias("chunk", "text"))
    pairs = pairs_of(parts, generator, ["file_id", "dataset_id", "chunk"])
    kept = validate.required(pairs, "question", "answer", "context", strict=False)
    return dedup.build_rows(kept.withColumn("source_url", F.col("file_id")), clock if clock is not None else F.current_timestamp())


def metrics(found: DataFrame, n_urls: int, seconds: float) -> DataFrame:
    """One row about a run of generate: URLs, generated pairs (duplicates included), new and duplicate rows, URLs a second."""
    return found.agg(F.count("*").alias("total_questions"), F.count_if(F.col("type") == "new").alias("stored"), F.count_if(F.col("type") != "new").alias("duplicates")).select(
        F.lit(n_urls).alias("urls_processed"), "total_questions", "stored", "duplicates", F.lit(float(seconds)).alias("seconds"), F.lit(n_urls / seconds if seconds > 0 else 0.0).alias("urls_per_second")
    )


def stored(found: DataFrame, write: Callable[[DataFrame], None], n_urls: int) -> DataFrame:
    """Write the new rows of a run of generate, and give its metrics: the counters are observed while the rows are written, so one
    job does both and nothing is read twice. write takes the rows without `type`, such as lambda rows: table.append(rows).

    Counters are null if write reads none of its rows.
    """
    counted, began = Observation(), time.monotonic()
    kind = F.col("type")
    watched = found.observe(counted, F.count(F.lit(1)).alias("total_questions"), F.count_if(kind == "new").alias("stored"), F.count_if(kind == "exact").alias("exact_duplicates"), F.count_if(kind == "similar").alias("similar_duplicates"))
    write(watched.where(kind == "new").drop("type"))
    seconds, seen = time.monotonic() - began, counted.get
    names = ("total_questions", "stored", "exact_duplicates", "similar_duplicates")
    return found.sparkSession.createDataFrame([(n_urls, *(seen.get(n) for n in names), seconds, n_urls / seconds if seconds > 0 else 0.0)], f"urls_processed long, {', '.join(f'{n} long' for n in names)}, seconds double, urls_per_second double")
