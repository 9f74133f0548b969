"""Token counts: whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once from the vocabulary; words that match one are
counted directly, and only the rest go through the merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces, words
from .shared import table


def with_token_counts(df: DataFrame, model_path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """df with the token count of each text under a sentencepiece BPE model.

    Null and empty texts have 0 tokens. Texts of any length are counted whole. Rows are independent of each other, so
    repeated rows, ties and an empty table need no care; a column already named out_col is replaced, all others stay.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = pieces.of_worker(pieces.PieceCounter, model_path)
        for batch in batches:
            yield pa.array([n for _, part in words.groups(batch) for n in counter.count(part.to_pylist())], pa.int64())

    return df.withColumn(out_col, count(F.coalesce(F.col(text_col), F.lit(""))))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens) of each document, repeated rows included."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = with_token_counts(docs.select("doc_id", text.alias("text")), model_path)
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
