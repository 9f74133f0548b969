"""Texts that a served model gets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLEANING = (
    "Keep the running text of this page and nothing else: leave out menus, headers, footers, reference marks in brackets, dates of "
    "change and other technical notes, advertising, edit links, lists of languages and scripts. Return text in paragraphs, without remarks.\n\n"
)
GENERATION = (
    "Write varied questions (who, what, when, where, why, how) about this text in the language '%s'. Answer each in two sentences at "
    "least, quote the passage it rests on word for word as context, and leave out trivial questions.\n\n"
)
ENRICHMENT = "Write question and answer pairs about this text:\n"


def cleaning(text: Column, limit: int = 10_000) -> Column:
    return F.concat(F.lit(CLEANING), F.substring(text, 1, limit))


def generation(text: Column, language: Column) -> Column:
    return F.concat(F.format_string(GENERATION, language), text)


def enrichment(chunk: Column) -> Column:
    return F.concat(F.lit(ENRICHMENT), chunk)
