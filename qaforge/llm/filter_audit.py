"""Filter interaction audit by first-failure lookup.

Each document is reduced to the set of filters that it fails, five bits. A table says for each of the 32 sets and each of
the 120 orders at which step such a document goes, so one pass over the sets gives the effect of every order at once:
tasks look documents up, count removals by part, order, step and label in numpy, and hand on small arrays, which are summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .shared import bounded_batches, table, written

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
_PLACES = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
#: FIRST[set, order]: the step (from 0) at which a document that fails this set of filters goes, 5 if it stays.
FIRST = np.array([[next((s for s, f in enumerate(o) if fails >> f & 1), len(FILTERS)) for o in _PLACES] for fails in range(1 << len(FILTERS))])
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

_CAPITALS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of a text that are split into words at once, and rows and parts that a task counts at once.
_AT_ONCE, _ROWS, _PARTS = 1 << 20, 2048, 64


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that end between words."""
    at = 0
    while at < len(text):
        to = at + _AT_ONCE
        if to < len(text):
            to = min((p for p in (text.find(bytes([s]), to) for s in _SPACE) if p >= 0), default=len(text))
        yield text[at:to]
        at = to


def failed(text: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails, as bits 1, 2, 4 and 8."""
    n, distinct = 0, set()
    for piece in _pieces(text):
        found = piece.split()
        n += len(found)
        distinct.update(found)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    code_points = len(text.translate(None, bytes(range(0x80, 0xC0))))  # all but continuation bytes
    return (n < 100) | (100 * len(distinct) < 80 * n) << 1 | (100 * capitals > 10 * code_points) << 2 | (len(text.translate(None, _MARKS)) < len(text)) << 3


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, part, text_digest (128 bits) and fails (bits of A to D) of each row of docs (doc_id, text, lang)."""
    bounded_batches(docs.sparkSession)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in words.groups(batch.column("text")):
                texts = [t.as_py() for t in part.cast(pa.large_binary())]
                digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(part)) for c in ("doc_id", "part")), digests, pa.array([failed(t) for t in texts], pa.int8())], ["doc_id", "part", "text_digest", "fails"])

    empty = F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), empty).alias("part"), F.coalesce("text", empty).alias("text"))
    return rows.mapInArrow(mark, "doc_id long, part string, text_digest binary, fails byte")


def _report(removed: np.ndarray, sets: np.ndarray) -> list[np.ndarray]:
    """COUNTS (each one 120 x 5) of a part from removals by label (3 x 120 x 6) and documents by failed set (32)."""
    has = (np.arange(len(sets))[:, None] >> np.arange(len(FILTERS)) & 1).astype(bool)
    gone = removed[:, :, : len(FILTERS)]
    own = gone[0]
    shapley = np.array([own[_PLACES == f].sum() for f in range(len(FILTERS))])
    alone = sets[1 << np.arange(len(FILTERS))]
    fails = (sets[:, None] * has).sum(axis=0)
    return [sets.sum() - own.cumsum(axis=1), own, fails[_PLACES] - own, alone[_PLACES], gone[1], gone[2], shapley[_PLACES]]


def _partials(documents: DataFrame) -> DataFrame:
    """part, filter_order, step and COUNTS of each task's documents (part, fails, good, toxic)."""

    def rows(seen: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        n = len(ORDERS) * len(FILTERS)
        for part, (removed, sets) in seen.items():
            keys = [pa.array([part] * n, pa.string()), pa.array(np.repeat(ORDERS, len(FILTERS)).tolist()), pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c.ravel().astype(np.int64)) for c in _report(removed, sets))], ["part", "filter_order", "step", *COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        orders, steps = len(ORDERS), len(FILTERS) + 1
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, len(b), _ROWS)):
            coded = pc.dictionary_encode(batch.column("part"))
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            fails = batch.column("fails").to_numpy().astype(np.int64)
            place = (code[:, None] * orders + np.arange(orders)) * steps + FIRST[fails]
            labels = [np.ones(len(code), bool), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))]
            removed = np.stack([np.bincount(place[of].ravel(), minlength=len(names) * orders * steps).reshape(-1, orders, steps) for of in labels], axis=1)
            sets = np.bincount(code * len(FIRST) + fails, minlength=len(names) * len(FIRST)).reshape(-1, len(FIRST))
            for i, name in enumerate(names):
                before = seen.get(name)
                seen[name] = (removed[i], sets[i]) if before is None else (before[0] + removed[i], before[1] + sets[i])
            if len(seen) > _PARTS:
                yield from rows(seen)
                seen = {}
        yield from rows(seen)

    kinds = ", ".join(f"{c} long" for c in COUNTS)
    return documents.select("part", "fails", "good", "toxic").mapInArrow(count, f"part string, filter_order string, step int, {kinds}")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part of docs (doc_id, text, lang), order of the five filters and step of it.

    Filters fail a document that A: has under 100 words; B: has fewer than 80 distinct words in 100 (case counts); C: has
    over 10 capitals A-Z in 100 code points; D: holds any of #$%&*|; E: has the very text of a smaller doc_id of the table,
    removed or not. A part is a value of lang. Columns: part, filter_order (as ABCDE), step (1 to 5) and, of the documents
    of the part, kept (after the step), removed (in it), redundant (failing its filter, removed before), unique_fails (that
    fail this filter alone), good_lost and toxic_lost (removed in it, labels quality 1 and toxic 1) and shapley (removed by
    its filter in all orders together).

    Null and empty texts have no words: A fails them, and E all but the smallest id. A null lang is the part ''. A null
    doc_id is never smaller than another and has none smaller, so E never fails it, and it has no label. Repeated rows count
    once each; E doesn't fail rows of the smallest id. Of several labels of a document, any 1 counts; missing and null
    labels are 0. An empty table gives no rows. Other columns are not looked at.
    """
    rows = written(marked(docs), "marked")
    copies = rows.groupBy("text_digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    joined = rows.join(copies, "text_digest", "left").withColumn("fails", F.when(again, F.col("fails") + 16).otherwise(F.col("fails")).cast("byte")).select("doc_id", "part", "fails")
    no = F.lit(False)
    joined = joined.join(flags, "doc_id", "left").select("part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return _partials(joined).groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in COUNTS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS fails
  FROM t
), l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS f, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
    list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))) AS earlier
  FROM o, range(1, 6) AS r(step)
), c AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN fails & (coalesce(earlier, 0)::BIGINT | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails & own <> 0 AND fails & coalesce(earlier, 0)::BIGINT = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails & own <> 0 AND fails & coalesce(earlier, 0)::BIGINT <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails & own <> 0 AND fails & coalesce(earlier, 0)::BIGINT = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails & own <> 0 AND fails & coalesce(earlier, 0)::BIGINT = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM c
"""
