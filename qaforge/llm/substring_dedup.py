"""Substring de-duplication by units: lines, and passages that begin and end anywhere.

Units are whole lines and, for passages inside lines or across them, runs of `window` words that begin at anchors. Of any
STEP neighbouring words one at least is an anchor, and which one follows from these words alone. So two copies of a passage
have the same units in it, and all of it is in such units but for STEP - 1 words at each end.
Units are normalised and digested, digests are grouped over the whole corpus, the occurrence of the earliest rank stays, and
the words of every other are removed, with their places in the original text kept. A lone run of words is often a phrase that
texts share by chance, so passages go only where such units make up RUN words without a gap.

Units are told apart by 64-bit digests: two given ones collide with a chance of 2**-64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .shared import drop, free_names, release, table, written
from .words import mix

WINDOW = 16  # words of a passage's unit
STEP = 5  # so a shared passage of WINDOW + STEP - 1 words is found; about every third word is an anchor
RUN = 24  # words that neighbouring repeated units must make up; a shared passage of RUN + 2 * (STEP - 1) words always does
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LINE, _PASSAGE = np.uint64(0x632BE59BD9B4E019), np.uint64(0x9FB21C651E98DF25)


def _doc_key() -> Column:
    """doc_id as a long, the least one for null: the first part of a document's rank."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _starts(before: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    return np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]])) if len(before) else np.zeros(0, np.int64)


def _units(part: pa.Array, min_words: int, min_chars: int, window: int) -> tuple[np.ndarray, ...]:
    """Text, first word, twice the number of words (plus 1 for a line) and digest of each unit of some texts, and whether it
    repeats one that ends before it in its text."""
    w = words.Words(part, words.SPACED)
    n = len(w)
    text = np.repeat(np.arange(len(part)), np.diff(w.first))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash * power[:n], dtype=np.uint64)])
    chars = np.concatenate([[0], np.cumsum((w.bytes & 0xC0) != 0x80)])
    # Lines: words of one text with as many line breaks before them.
    breaks = np.concatenate([[0], np.cumsum(w.bytes == 10)])[w.starts]
    a = _starts(text * (len(w.bytes) + 1) + breaks)
    b = np.append(a[1:], n) if len(a) else a
    letters = np.concatenate([[0], np.cumsum(chars[w.ends] - chars[w.starts])])
    long_enough = (b - a >= min_words) | (letters[b] - letters[a] + b - a - 1 >= min_chars)
    a, b = a[long_enough], b[long_enough]
    # Passages: of any STEP neighbouring words that may begin one, that of the least key (the earliest of these) does.
    c = np.flatnonzero(np.arange(n) + window <= w.first[text + 1]) if window else np.zeros(0, np.int64)
    size, head, tail = w.ends - w.starts, w.bytes[w.starts].astype(np.int64), w.bytes[w.ends - 1].astype(np.int64)
    key = (7 * size[c] * head[c] + 31 * tail[c] + 13 * head[c + 1] + size[c + 1]) % 257
    few = np.bincount(text[c], minlength=len(part))[text[c]] < STEP
    chosen = few.copy()
    if len(c) >= STEP:
        least = np.lib.stride_tricks.sliding_window_view(key, STEP).argmin(axis=1) + np.arange(len(c) - STEP + 1)
        chosen[least[text[c[: len(least)]] == text[c[STEP - 1 :]]]] = True
    c = c[chosen]
    first, last = np.concatenate([a, c]), np.concatenate([b, c + window])
    digest = mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    digest = mix(digest ^ np.where(np.arange(len(first)) < len(a), _LINE, _PASSAGE))
    # The first unit of a digest in its own text; `unique` gives the earliest of equal ones, as each kind is in order.
    _, earliest, same = np.unique(digest + mix(text[first].astype(np.uint64)), return_index=True, return_inverse=True)
    again = first >= last[earliest[same]] if len(first) else np.zeros(0, bool)
    return text[first], first - w.first[text[first]], 2 * (last - first) + (np.arange(len(first)) < len(a)), digest, again


def units(docs: DataFrame, min_words: int = 10, min_chars: int = 40, window: int = WINDOW) -> DataFrame:
    """The units of docs (doc_id, text): doc, text_hash, digest, place and again.

    Units are the lines of at least min_words words or min_chars normalised characters, and the runs of `window` words (two
    at least) that begin at an anchor; a window of 0 leaves these out. A text with fewer than STEP runs has them all as units.
    place: the first word's number times 2**32, plus twice the number of words, plus 1 for a line. again: whether the unit repeats one of its own text
    that ends before it. doc: doc_id, the least long for null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in words.groups(batch.column("text")):
                text, first, size, digest, again = _units(part, min_words, min_chars, window)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(at, len(part)).take(pa.array(text)), batch.column("text_hash").slice(at, len(part)).take(pa.array(text)), pa.array(digest.view(np.int64)), pa.array(first * (1 << 32) + size), pa.array(again)],
                    ["doc", "text_hash", "digest", "place", "again"],
                )

    keyed = docs.select(_doc_key().alias("doc"), _text_hash().alias("text_hash"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return keyed.mapInArrow(cut, "doc long, text_hash long, digest long, place long, again boolean")


def repeats(docs: DataFrame, min_words: int = 10, min_chars: int = 40, window: int = WINDOW) -> DataFrame:
    """doc, text_hash and place of each unit (see `units`) that is not the earliest of its digest.

    Rank is (doc_id, text_hash, place), a null doc_id first. A unit that overlaps the earliest one in its own text stays.
    Rows that repeat id and text are one document. Null and empty texts have no units; an empty table gives no rows.
    """
    # Units are cut twice instead of written: cheap in CPU, and a corpus has more of them than it has text.
    found = units(docs, min_words, min_chars, window)
    # Frequent digests are reduced on the map side. Only digests that occur again go on, and Spark splits a skewed join.
    groups = written(found.groupBy("digest").agg(F.min("doc").alias("first_doc"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-digests")
    release(docs.sparkSession)
    again = written(found.join(groups, "digest"), "repeated-units")
    drop(groups)
    release(docs.sparkSession)
    # Different texts under the id of the first occurrence: the least hash stays.
    earliest = again.where("doc = first_doc")
    ties = earliest.groupBy("digest").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least < most")
    later = earliest.join(ties, "digest").where("text_hash > least AND NOT again")
    return again.where("doc > first_doc OR again").unionByName(later.select(*again.columns)).select("doc", "text_hash", "place")


def _runs(places: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping and touching ranges (first, last), made one."""
    out: list[list[int]] = []
    for first, last in sorted(places):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def removed_spans(text: str, places: list[int], least_run: int = RUN) -> list[tuple[int, int]]:
    """Start and end (code points) of what goes from a text with the units at these places: lines, and runs of other units of at
    least least_run words together.

    A word takes the white space after it along. A run of words that begins inside a line and ends with a line leaves the
    line break.
    """
    at = [m.span() for m in _WORD.finditer(text)]
    ranges = lambda line: [(p >> 32, (p >> 32) + ((p & 0xFFFFFFFF) >> 1)) for p in places if p & 1 == line]
    runs = _runs([*ranges(1), *((a, b) for a, b in _runs(ranges(0)) if b - a >= least_run)])
    out = []
    for first, last in runs:
        begins = first == 0 or "\n" in text[at[first - 1][1] : at[first][0]]
        to = at[last][0] if last < len(at) else len(text)
        if not begins and "\n" in text[at[last - 1][1] : to]:
            to = at[last - 1][1]
        out.append((at[first][0], to))
    return out


def without_repeats(docs: DataFrame, min_words: int = 10, min_chars: int = 40, window: int = WINDOW, removed_col: str = "removed", least_run: int = RUN) -> DataFrame:
    """docs without the lines of `repeats`, and its other units where they make up runs of least_run words, with removed_col: start and end (code points of the original text) of each part
    that went, in order.

    All rows and all other columns stay, whatever their names; a column of the name removed_col is replaced. A document of which nothing is left has an empty
    text; a null text stays null. removed_col is an empty list where nothing went. `n_chars`, where there is one, follows
    the text. An empty table gives an empty one.
    """
    spans = repeats(docs, min_words, min_chars, window)
    kept = docs.drop(removed_col)
    doc, text_hash, places, rest_of = free_names(docs, "_doc", "_hash", "_places", "_rest")
    # A set, as rows that repeat id and text have the same places; it is bounded by the text itself.
    per_doc = spans.groupBy(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash)).agg(F.collect_set("place").alias(places))

    @F.arrow_udf("struct<text:string,removed:array<struct<start:long,end:long>>>")
    def rest(texts: pa.Array, places: pa.Array) -> pa.Array:
        kept, gone = [], []
        for text, own in zip(texts.to_pylist(), places.to_pylist()):
            found = removed_spans(text, own, least_run) if own else []
            cuts = [0, *(x for span in found for x in span), None]
            kept.append("".join([text[a:b] for a, b in zip(cuts[::2], cuts[1::2])]) if found else text)
            gone.append([{"start": a, "end": b} for a, b in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(gone, kind)], ["text", "removed"])

    out = kept.join(per_doc, (_doc_key() == F.col(doc)) & (_text_hash() == F.col(text_hash)), "left").drop(doc, text_hash)
    none = F.struct(F.col("text"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"))
    out = out.withColumn(rest_of, F.when(F.col(places).isNull(), none).otherwise(rest("text", places)))
    out = out.withColumns({"text": F.col(f"{rest_of}.text"), removed_col: F.col(f"{rest_of}.removed")}).drop(rest_of, places)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, its text without repeats, and what went as `start-end` of the original text."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array_join(spans, " ").alias("removed"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*')) AS lead,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS tokens FROM documents
), w AS (
  SELECT doc_id, i - 1 AS i, tokens[i] AS token, lead, regexp_extract(tokens[i], '^[^\x20\x09-\x0D]+') AS word
  FROM t, unnest(range(1, len(tokens) + 1)) AS r(i)
), p AS (
  SELECT doc_id, i, length(word) AS n, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, strpos(token, chr(10)) > 0 AS ends,
    lead + coalesce(sum(length(token)) OVER b, 0) AS start, lead + sum(length(token)) OVER c AS next,
    coalesce(sum(CASE WHEN strpos(token, chr(10)) > 0 THEN 1 ELSE 0 END) OVER b, 0) AS line
  FROM w WINDOW b AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c AS (PARTITION BY doc_id ORDER BY i)
), k AS (
  SELECT doc_id, i, word, octet_length(encode(word)) AS size, CAST('0x' || hex(encode(word))[1:2] AS INT) AS head, CAST('0x' || hex(encode(word))[-2:] AS INT) AS tail FROM p
), d AS (SELECT doc_id, list(word ORDER BY i) AS words FROM k GROUP BY doc_id), e AS (
  SELECT doc_id, i, (7 * size * head + 31 * tail + 13 * lead(head) OVER v + lead(size) OVER v) % 257 AS key FROM k WINDOW v AS (PARTITION BY doc_id ORDER BY i)
), o AS (SELECT e.*, len(words) - 15 AS n FROM e JOIN d USING (doc_id) WHERE i + 16 <= len(words)), l AS (
  SELECT doc_id, min(key * 4294967296 + i) OVER v % 4294967296 AS i, count(*) OVER v AS c FROM o WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), anchors AS (SELECT doc_id, i FROM l WHERE c = 5 UNION SELECT doc_id, i FROM o WHERE n < 5), u AS (
  SELECT doc_id, min(i) AS first, count(*) AS size, true AS is_line, 'line ' || string_agg(word, ' ' ORDER BY i) AS body FROM p GROUP BY doc_id, line
    HAVING count(*) >= 10 OR sum(length(word)) + count(*) - 1 >= 40
  UNION ALL SELECT doc_id, i, 16, false, array_to_string(words[i + 1 : i + 16], ' ') FROM anchors JOIN d USING (doc_id)
), f AS (SELECT *, min(doc_id) OVER (PARTITION BY body) AS first_doc, first_value(first + size) OVER (PARTITION BY body, doc_id ORDER BY first) AS first_end FROM u
), v AS (
  SELECT DISTINCT doc_id, is_line, unnest(range(first, first + size)) AS i FROM f WHERE doc_id > first_doc OR first >= first_end
), h AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, is_line ORDER BY i) AS island FROM v), g AS (
  SELECT DISTINCT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, is_line, island) AS n FROM h) WHERE is_line OR n >= 24
), r AS (
  SELECT p.*, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run, i = 0 OR line <> lag_line AS begins
  FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS lag_line FROM p) p SEMI JOIN g USING (doc_id, i)
), s AS (
  SELECT doc_id, min(start) AS a, CASE WHEN arg_max(ends, i) AND NOT arg_min(begins, i) THEN arg_max(start + n, i) ELSE max(next) END AS b FROM r GROUP BY doc_id, run
), c AS (
  SELECT doc_id, string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ' ' ORDER BY a) AS removed, string_agg(substr(text, CAST(a0 AS BIGINT) + 1, CAST(a - a0 AS BIGINT)), '' ORDER BY a) AS head, max(b) AS b
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a0 FROM s) JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CASE WHEN removed IS NULL THEN text ELSE head || substr(text, CAST(b AS BIGINT) + 1) END AS text, coalesce(removed, '') AS removed FROM t LEFT JOIN c USING (doc_id)
"""
