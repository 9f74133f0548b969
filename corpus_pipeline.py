"""A corpus pipeline of five operators: toxicity, near duplicates, repeated lines, benchmark contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
All but the last keep the columns of documents, others too, whatever their names, and work on all rows that the stage before
kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaforge.llm import decontamination, ngram_join, packing, substring_dedup, toxicity
from qaforge.llm.shared import free_names, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled ones of docs.

    Without labels of both classes nothing is rejected, as all score 0.5.
    """
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    score, predicted = free_names(docs, "_score", "_predicted")
    return toxicity.with_scores(docs, model, score_col=score, predicted_col=predicted).where(F.col(predicted) == 0).drop(score, predicted)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; documents without words are no group and stay.

    The join's own query fixes four words and 0.85; here, as for near duplicates in general, it is five words and 0.8.
    Of rows that repeat an id, all stay if that id does. Rows with a null id and null or empty texts stay.
    """
    found = ngram_join.near_duplicates(docs, ngram_join.Scheme(5, 4, 5))
    # An id that is not its component's smallest goes.
    (gone,) = free_names(docs, "_later")
    later = found.where("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(later, docs["doc_id"] == F.col(gone), "left_anti")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of ten words or 40 characters, and passages of 16 words, that an earlier place has.

    Null texts stay null, and a text of which nothing is left is empty. Rows that repeat id and text lose the same parts.
    """
    (spans,) = free_names(docs, "_spans")
    return substring_dedup.without_repeats(docs, removed_col=spans).drop(spans)


def without_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark.

    Null and empty texts have no words and stay. Rows that repeat id and text go or stay together; of rows that repeat an id
    alone, those with a contaminated text go. An empty benchmark contaminates nothing.
    """
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    doc, same_text = free_names(docs, "_doc", "_hash")
    bad = found.where("contaminated").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(same_text)).distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (text_hash == F.col(same_text)), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens.

    A null or empty text is one piece, the end id alone; repeated rows are packed once each.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", without_repeated_lines),
    ("decontamination", without_contaminated),
    ("best_fit_packing", packed),
]

#: SQL expresses neither a trained model nor a tokenizer; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
