"""Validation and normalisation of question/answer rows, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import ANSWER_LENGTH, CONTEXT_LENGTH, LANGUAGES, QUESTION_LENGTH


def is_valid(question: Column, answer: Column, context: Column, confidence: Column) -> Column:
    """Lengths count before stripping; a confidence is null or within 0..1."""
    ok = F.length(question).between(*QUESTION_LENGTH) & (F.length(answer) >= ANSWER_LENGTH) & (F.length(context) >= CONTEXT_LENGTH)
    return F.coalesce(ok, F.lit(False)) & (confidence.isNull() | confidence.between(0.0, 1.0))


def with_question_mark(question: Column) -> Column:
    q = strip(question)
    return F.when(F.endswith(q, F.lit("?")), q).otherwise(F.concat(q, F.lit("?")))


def valid_rows(rows: DataFrame, batch: str | None = None) -> DataFrame:
    """The valid rows (question, answer, context, confidence), normalised. With `batch`, a batch counts as a whole: one
    invalid row drops all rows of the same value of that column."""
    ok = is_valid(*(F.col(c) for c in ("question", "answer", "context", "confidence")))
    if batch:
        bad = rows.where(~ok).select(batch).distinct()
        kept = rows.join(bad, rows[batch].eqNullSafe(bad[batch]), "left_anti")
    else:
        kept = rows.where(ok)
    return kept.withColumns({"question": with_question_mark(F.col("question")), "answer": strip(F.col("answer")), "context": strip(F.col("context"))})


def missing(*columns: Column) -> Column:
    """Whether any is null or empty."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.coalesce(c, F.lit("")) == "")
    return out


def required(rows: DataFrame, *columns: str, strict: bool = True) -> DataFrame:
    """Rows that have all columns; strict makes a missing one an error."""
    gone = missing(*(F.col(c) for c in columns))
    if not strict:
        return rows.where(~gone)
    return rows.where(F.when(gone, F.raise_error(F.lit(f"{', '.join(columns)} are required")).cast("boolean")).otherwise(F.lit(True)))


def confidence_or_one(c: Column) -> Column:
    """A number from whatever stands for a confidence; 1 where there is none."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(1.0))


def threshold(c: Column) -> Column:
    """normalise_threshold of the schema module, as an expression."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("string").try_cast("double"), F.lit(0.9))))


def known_language(c: Column) -> Column:
    return c.isin(*LANGUAGES)


def numbered(rows: DataFrame, within: str, order: str) -> DataFrame:
    """rows with `index`, counted from 0 in the given order within each value of a column."""
    return rows.withColumn("index", (F.row_number().over(Window.partitionBy(within).orderBy(order)) - 1).cast("int"))
