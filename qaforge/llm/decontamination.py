"""Benchmark decontamination with a positional inverted index.

The postings of the training text (term, document, positions) are stored by term for the rarest terms of the test windows.
Offset adjustment turns a posting of a term that stands at place o of an item into the place where the item would begin in the
document; lists that agree on that place, beginning with the rarest terms, give candidates, and the document's words
decide about exact phrases. Proximity matches come from the same postings, with places that differ a little.

Words are compared by 64-bit hashes: two given words share one with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .shared import bounded_batches, table, written

#: Bytes of test text that are held in memory at a time. A larger benchmark is taken in parts, each against all documents.
PART_BYTES = 16 << 20
SALTS = 16


def _keyed(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


class _Items:
    """The items of one part of the benchmark: word hashes, windows, and the anchors of each window."""

    def __init__(self, rows: list, window: int):
        self.ids = [r["item_id"] for r in rows]
        w = words.Words(pa.array([r["text"] for r in rows], pa.string()), words.ALNUM)
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.window = window
        self.terms = np.unique(w.hash)

    def choose(self, counts: dict[int, int]) -> list[tuple[int, int, int]]:
        """(term, item, place) of the two rarest words of each window; ties go to the earlier place."""
        out = []
        for item, hashes in enumerate(self.words):
            n = len(hashes)
            if not n:
                continue
            size, seen = min(self.window, n), np.array([counts.get(int(h), 0) for h in hashes])
            rarity = np.argsort(np.argsort(seen, kind="stable"), kind="stable")
            views = np.lib.stride_tricks.sliding_window_view(rarity, size)
            places = np.argsort(views, axis=1, kind="stable")[:, :2] + np.arange(len(views))[:, None]
            out += [(int(hashes[p]), item, int(p)) for p in np.unique(places)]
        return out


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


class _Lookup:
    """Which of many hashes are among a few: one bit table first, then a search among the rest."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)
        bits = max(16, (8 * len(terms)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.terms & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.maybe[(hashes & self.mask).astype(np.int64)])
        place = np.searchsorted(self.terms, hashes[at])
        place[place == len(self.terms)] = 0
        return at[self.terms[place] == hashes[at]] if len(self.terms) else at[:0]


def term_counts(keyed: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Occurrences of each test term in all documents."""
    shared = keyed.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(shared.value)
        total = np.zeros(len(lookup.terms), np.int64)
        for batch in batches:
            for _, part in words.groups(batch.column("text")):
                h = words.Words(part, words.ALNUM).hash
                total += np.bincount(np.searchsorted(lookup.terms, h[lookup.find(h)]), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(_signed(lookup.terms[seen])), pa.array(total[seen])], ["term", "n"])

    rows = keyed.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"] & (1 << 64) - 1: r["n"] for r in rows.toLocalIterator()}  # at most one row for each test term


def positional_index(keyed: DataFrame, terms: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The inverted index of the given terms, and the documents.

    Index: term, doc_id, text_hash and positions (ascending), a row for each term and document, dealt by term; the documents
    of a term are dealt over SALTS parts too, so that no task holds a frequent term alone. Documents: doc_id, text_hash and
    n_words of each row. Rows that repeat id and text are one document to the index.
    """
    shared = keyed.sparkSession.sparkContext.broadcast(terms)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(shared.value)
        for batch in batches:
            for at, part in words.groups(batch.column("text")):
                w = words.Words(part, words.ALNUM)
                hit = lookup.find(w.hash)
                doc = np.searchsorted(w.first, hit, "right") - 1
                order = np.lexsort((hit, w.hash[hit], doc))
                hit, doc, term = hit[order], doc[order], w.hash[hit[order]]
                head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])) if len(hit) else np.zeros(0, np.int64)
                # Each document's own row (no term), then its postings.
                own = np.concatenate([np.arange(len(part)), doc[head]])
                cuts = np.concatenate([np.zeros(len(part), np.int64), head, [len(hit)]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(part)).take(pa.array(own)),
                        batch.column("text_hash").slice(at, len(part)).take(pa.array(own)),
                        pa.array(np.diff(w.first)[own].astype(np.int64)),
                        pa.array(np.concatenate([np.zeros(len(part), np.int64), _signed(term[head])]), mask=np.arange(len(own)) < len(part)),
                        pa.ListArray.from_arrays(cuts, (hit - w.first[doc]).astype(np.int64)),
                    ],
                    ["doc_id", "text_hash", "n_words", "term", "positions"],
                )

    found = written(keyed.mapInArrow(index, "doc_id long, text_hash long, n_words long, term long, positions array<long>"), "postings-by-document")
    salt = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS))
    postings = found.where("term IS NOT NULL").select("term", "doc_id", "text_hash", "positions").dropDuplicates(["term", "doc_id", "text_hash"])
    return written(postings.repartition("term", salt).sortWithinPartitions("term", "doc_id", "text_hash"), "inverted-index"), found.where("term IS NULL").select("doc_id", "text_hash", "n_words")


def _alignments(index: DataFrame, anchors: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, text_hash, item, place (in the item) and begin (where the item would begin) of each anchor posting."""
    spark = index.sparkSession
    by_term = spark.createDataFrame([(t - (1 << 64) if t >> 63 else t, item, p) for t, item, p in anchors], "term long, item int, place long")
    # The anchors belong to one part of the benchmark, whose size is bounded by PART_BYTES.
    lists = index.join(F.broadcast(by_term), "term")
    return lists.select("doc_id", "text_hash", "item", "place", F.explode("positions").alias("position")).select("doc_id", "text_hash", "item", "place", (F.col("position") - F.col("place")).alias("begin"))


def _verified(keyed: DataFrame, candidates: DataFrame, items: _Items) -> DataFrame:
    """The runs of words that candidates share with their items, where a run holds a whole window."""
    shared = keyed.sparkSession.sparkContext.broadcast((items.words, items.window))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_words, window = shared.value
        for batch in batches:
            for at, part in words.groups(batch.column("text")):
                w, rows = words.Words(part, words.ALNUM), []
                for i, wanted in enumerate(batch.column("at").slice(at, len(part)).to_pylist()):
                    doc = w.hash[w.first[i] : w.first[i + 1]]
                    for c in wanted:
                        own, begin = item_words[c["item"]], c["begin"]
                        low, high = max(0, begin), min(len(doc), begin + len(own))
                        same = np.zeros(max(0, high - low) + 2, np.int8)
                        same[1:-1] = doc[low:high] == own[low - begin : high - begin]
                        edges = np.flatnonzero(np.diff(same))
                        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                            if b - a >= min(window, len(own)):
                                rows.append((batch.column("doc_id")[at + i].as_py(), batch.column("text_hash")[at + i].as_py(), c["item"], low + a, low + b))
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "text_hash", "item", "begin", "end"])

    per_doc = candidates.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "begin")).alias("at"))
    same = [keyed[c].eqNullSafe(per_doc[c]) for c in ("doc_id", "text_hash")]
    joined = keyed.join(per_doc, same).select(keyed["doc_id"], keyed["text_hash"], keyed["text"], per_doc["at"])
    return joined.mapInArrow(verify, "doc_id long, text_hash long, item int, begin long, end long")


def _parts(benchmark: DataFrame) -> Iterator[list]:
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // PART_BYTES)
    for k in range(parts):
        yield items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> tuple[DataFrame, DataFrame]:
    """All exact occurrences of windows of benchmark (item_id, text) in docs (doc_id, text).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Returns

    * documents: doc_id, text_hash and n_words of each row;
    * matches: doc_id, text_hash, item_id, begin and end, the longest runs of document words that are covered by windows
      of one item at one alignment (word numbers, end excluded).

    Null and empty texts have no words. Rows that repeat id and text are one document to `matches`. A null doc_id or
    item_id is a value like any other. An empty table on either side gives no matches.
    """
    spark, keyed = docs.sparkSession, _keyed(docs)
    matches, documents = None, None
    for rows in _parts(benchmark):
        items = _Items(rows, window)
        if not len(items.terms):
            continue
        anchors = items.choose(term_counts(keyed, items.terms))
        index, documents = positional_index(keyed, np.unique(np.array([a[0] for a in anchors], np.uint64)))
        aligned = _alignments(index, anchors).groupBy("doc_id", "text_hash", "item", "begin").agg(F.count_distinct("place").alias("n"))
        lengths = spark.createDataFrame([(i, len(w)) for i, w in enumerate(items.words)], "item int, n_item long")
        # The two rarest words of a window that occurs agree on where the item begins.
        candidates = aligned.join(F.broadcast(lengths), "item").where(F.col("n") >= F.least(F.lit(2), "n_item")).select("doc_id", "text_hash", "item", "begin")
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {dict(benchmark.dtypes)['item_id']}")
        found = _verified(keyed, candidates, items).join(F.broadcast(names), "item").select("doc_id", "text_hash", "item_id", "begin", "end")
        matches = found if matches is None else matches.unionByName(found)
    if matches is None:
        _, documents = positional_index(keyed, np.zeros(0, np.uint64))
        matches = spark.createDataFrame([], f"doc_id long, text_hash long, item_id {dict(benchmark.dtypes)['item_id']}, begin long, end long")
    return documents, matches.dropDuplicates(["doc_id", "text_hash", "item_id", "begin", "end"])


def proximity_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 3, share: float = 0.5) -> DataFrame:
    """doc_id, item_id, begin and n_anchors where at least `share` of an item's anchors (its windows' two rarest words, two
    of them at least) stand in a document at places that agree up to `slop` words: phrases with words put in or left out.

    Nulls, empty texts, repeats and empty tables are handled as in phrase_matches.
    """
    spark, keyed, out = docs.sparkSession, _keyed(docs), None
    for rows in _parts(benchmark):
        items = _Items(rows, window)
        if not len(items.terms):
            continue
        anchors = items.choose(term_counts(keyed, items.terms))
        index, _ = positional_index(keyed, np.unique(np.array([a[0] for a in anchors], np.uint64)))
        near = Window.partitionBy("doc_id", "text_hash", "item").orderBy("begin").rangeBetween(0, slop)
        counts = _alignments(index, anchors).withColumn("n_anchors", F.size(F.collect_set("place").over(near)).cast("long"))
        of_item = {}
        for _, item, _p in anchors:
            of_item[item] = of_item.get(item, 0) + 1
        needed = spark.createDataFrame([(i, items.ids[i], max(min(2, n), int(np.ceil(share * n)))) for i, n in of_item.items()], f"item int, item_id {dict(benchmark.dtypes)['item_id']}, needed long")
        hits = counts.join(F.broadcast(needed), "item").where(F.col("n_anchors") >= F.col("needed"))
        best = hits.groupBy("doc_id", "text_hash", "item_id").agg(F.max_by("begin", F.struct("n_anchors", -F.col("begin"))).alias("begin"), F.max("n_anchors").alias("n_anchors")).drop("text_hash")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else spark.createDataFrame([], f"doc_id long, item_id {dict(benchmark.dtypes)['item_id']}, begin long, n_anchors long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, per_hit: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs, with its text_hash.

    n_hit: words inside any occurrence of a window. n_items: items with such windows; items_sha256: the digest of their
    ids, sorted as strings and joined with commas. contaminated: n_hit > 0 and per_hit * n_hit >= n_words.
    """
    documents, matches = phrase_matches(docs, benchmark, window)
    before = Window.partitionBy("doc_id", "text_hash").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(F.max("end").over(before), F.lit(0))))
    per_doc = matches.withColumn("new", covered).groupBy("doc_id", "text_hash").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    same = [documents[c].eqNullSafe(per_doc[c]) for c in ("doc_id", "text_hash")]
    n_hit, items = F.coalesce(per_doc["n_hit"], F.lit(0)), F.coalesce(per_doc["items"], F.array().cast("array<string>"))
    return documents.join(per_doc, same, "left").select(
        documents["doc_id"],
        documents["text_hash"],
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (per_hit * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def proximity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents near whose words items stand, by the same index: doc_id, item_id, begin and n_anchors."""
    return proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS s
  FROM b, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM d, sizes, unnest(range(0, len(w) - n + 1)) AS r(i) WHERE len(w) >= n
), hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)), per_doc AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN per_doc USING (doc_id) LEFT JOIN its USING (doc_id)
"""
