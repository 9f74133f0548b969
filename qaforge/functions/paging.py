"""Paging arithmetic as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def current_page(offset: Column, limit: Column) -> Column:
    return (F.floor(offset / limit) + 1).cast("long")


def total_pages(total: Column, limit: Column) -> Column:
    return F.ceil(total / limit).cast("long")


def offset_of(page: Column, limit: Column) -> Column:
    return (page - 1) * limit


def visible_pages(current: Column, pages: Column) -> Column:
    """Page labels: all of up to seven, else the first, the current with its neighbours, and the last, '...' for gaps."""
    names = lambda a, b: F.transform(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>")), lambda x: x.cast("string"))
    one, gap, none = F.array(F.lit("1")), F.array(F.lit("...")), F.array().cast("array<string>")
    near = names(F.greatest(F.lit(2).cast("long"), current - 1), F.least(pages - 1, current + 1))
    short = names(F.lit(1).cast("long"), pages)
    return F.when(pages <= 7, short).otherwise(F.concat(one, F.when(current > 3, gap).otherwise(none), near, F.when(current < pages - 2, gap).otherwise(none), F.array(pages.cast("string"))))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100.0)
