"""URL functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_url(c: Column) -> Column:
    """Whether there is a scheme and a host."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))


def base_url(c: Column) -> Column:
    """A base URL that ends in '/'; null and '' give '', and what is no URL is an error."""
    ended = F.when(F.endswith(c, F.lit("/")), c).otherwise(F.concat(c, F.lit("/")))
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(is_url(c), ended).otherwise(F.raise_error(F.concat(F.lit("Invalid URL: "), c)))


def joined(base: Column, endpoint: Column) -> Column:
    """base and endpoint with one '/' between them."""
    return F.concat(base_url(base), F.regexp_replace(endpoint, "^/+", ""))


def picked_agent(url: Column, agents: list[str]) -> Column:
    """A user agent for a URL, the same each time; without a list, a fixed one."""
    if not agents:
        return F.lit("Mozilla/5.0 (compatible; qaforge)")
    return F.element_at(F.array(*map(F.lit, agents)), (F.conv(F.substring(F.sha2(url, 256), 1, 8), 16, 10).cast("long") % len(agents) + 1).cast("int"))
