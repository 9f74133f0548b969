"""Exact top-k search by inner product with MaxScore.

Vectors are dealt into shards; a shard keeps its vectors as postings, one list of values for each component (a term of
the query), with each list's extremes. For a query, every component has a bound on what it can add. Components are taken
in order of bounds and split into essential ones, traversed for all vectors of the shard, and non-essential ones, which
are only probed for vectors whose partial score and remaining bounds still reach the k-th best score. The shards' best
are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

#: Vectors of a shard and queries of a block.
SHARD, BLOCK = 2048, 1024
#: A bound on the square of a narrow vector's norm. Two of them have a product of at most NORM, and a shard's bounds, which join
#: the extremes of vectors of all lengths n, at most NORM times the root of 1 + ln n: well within 64 bits.
NORM = 1 << 58
_STEP = 8  # components that are probed between two looks at the bounds


def max_score(queries: np.ndarray, query_ids: np.ndarray, postings: np.ndarray, ids: np.ndarray, k: int):
    """(query number, row, score) of the k best rows of a shard for each query; ties go to the smaller id.

    postings[d] holds component d of all rows. ids must ascend. A query takes no row of its own id.
    """
    n_terms, n = postings.shape
    high, low = postings.max(axis=1), postings.min(axis=1)
    out_q, out_r, out_s = [], [], []
    for q, (query, own) in enumerate(zip(queries, query_ids)):
        most, least = np.maximum(query * high, query * low), np.minimum(query * high, query * low)
        # What a posting of a term can add to the term's least: wide terms come first.
        order = np.argsort(least - most, kind="stable")
        rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])  # bound on all terms from a place on
        me = slice(int(np.searchsorted(ids, own)), int(np.searchsorted(ids, own, "right")))
        wanted = min(k, n - (me.stop - me.start))
        if wanted <= 0:
            continue
        # The threshold begins with the exact scores of rows that look best after the widest terms.
        at = min(_STEP, n_terms)
        partial = query[order[:at]] @ postings[order[:at]]
        partial[me] = np.iinfo(np.int64).min // 2
        seed = np.argpartition(-partial, wanted - 1)[:wanted]
        threshold = int((query @ postings[:, seed]).min())
        # A row with the least of all essential terms cannot reach the threshold by the non-essential ones.
        essential, least_so_far = at, int(least[order[:at]].sum())
        while essential < n_terms and least_so_far + int(rest[essential]) >= threshold:
            least_so_far += int(least[order[essential]])
            essential += 1
        partial += query[order[at:essential]] @ postings[order[at:essential]]
        alive = np.flatnonzero(partial + rest[essential] >= threshold)
        partial, at = partial[alive], essential
        while at < n_terms and len(alive):
            to = min(at + _STEP, n_terms)
            partial = partial + query[order[at:to]] @ postings[np.ix_(order[at:to], alive)]
            keep = partial + rest[to] >= threshold
            alive, partial, at = alive[keep], partial[keep], to
        best = np.lexsort((ids[alive], -partial))[:wanted]
        out_q.append(np.full(len(best), q))
        out_r.append(alive[best])
        out_s.append(partial[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and q, the components floor(scale * x), of the vectors that take part.

    Rows with a null id, a null vector, or a null, NaN or infinite component (scaled or not) take no part. Where an integer
    lies beyond 2**26, or the vector's length times its largest integer squared beyond NORM, so that a score or a bound on
    one may leave 64 bits, q is null and `wide` has the integers as doubles, which hold them exactly.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < F.lit(float("inf"))))
    scaled = F.transform(v, lambda x: x * float(scale))
    largest = F.coalesce(F.array_max(F.transform(scaled, lambda x: F.abs(F.floor(x).cast("double")))), F.lit(0.0))
    narrow = F.when(F.coalesce(F.array_max(F.transform(scaled, F.abs)), F.lit(0.0)) > float(1 << 52), False).otherwise((largest <= float(1 << 26)) & (F.size(v) * largest * largest <= float(NORM)))
    # A double of 2**52 or more is an integer already, and floor() would put it into 64 bits.
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))
    q, wide = F.when(narrow, F.transform(scaled, lambda x: F.floor(x))), F.when(~narrow, whole)
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("vec_id"), q.alias("q"), wide.alias("wide"))


def _blocks(rows: DataFrame, size: int, n: int, salt: int, kind: str = "<i4") -> DataFrame:
    """rows packed into blocks of about `size`: block, ids (ascending) and matrix (numbers, one row after the other)."""
    blocks = max(1, -(-n // size))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec_id", "ascending")])
        vectors = group.column("q").combine_chunks()
        width = int(np.diff(vectors.offsets.to_numpy()).max(initial=0))
        matrix = np.zeros((len(group), width), kind)
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v.values.to_numpy()
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int64()), "ids": pa.array([group.column("vec_id").to_pylist()], pa.list_(pa.int64())), "matrix": [matrix.tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(pack, "block long, ids array<long>, matrix binary")


def _met(vectors: DataFrame, queries: DataFrame, kind: str = "<i4") -> DataFrame:
    """Every shard of vectors with every block of queries: ids, matrix, query_ids, query_matrix."""
    n_vectors, n_queries = vectors.count(), queries.count()
    shards = _blocks(vectors, SHARD, n_vectors, 0, kind)
    query_blocks = max(1, -(-n_queries // BLOCK))
    blocks = _blocks(queries, BLOCK, n_queries, 1, kind).select(F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"))
    met = shards.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<long>"))).join(blocks, "query_block")
    # One shard and one block of queries a row, dealt evenly: the rows are few and large.
    met = met.repartition(max(1, min(-(-n_vectors // SHARD) * query_blocks, 10_000)), "block", "query_block")
    return met.select("ids", "matrix", "query_ids", "query_matrix")


def _order_key(score: int) -> str:
    """A string that sorts as the integer does."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _wide_scores(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score and key of the k best rows of each shard for each query, by integers of any size. A score
    beyond 64 bits becomes the nearest one of 64; its key keeps the order."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        integers = lambda raw, n: [[int(x) for x in row] for row in np.frombuffer(raw, "<f8").reshape(n, -1)]
        for batch in batches:
            for i in range(len(batch)):
                ids, query_ids = (batch.column(c)[i].as_py() for c in ("ids", "query_ids"))
                rows, out = integers(batch.column("matrix")[i].as_py(), len(ids)), []
                for own, q in zip(query_ids, integers(batch.column("query_matrix")[i].as_py(), len(query_ids))):
                    scores = ((sum(a * b for a, b in zip(q, row)), -vec_id) for vec_id, row in zip(ids, rows) if vec_id != own)
                    out += [(own, -vec_id, max(-(1 << 63), min((1 << 63) - 1, s)), _order_key(s)) for s, vec_id in heapq.nlargest(k, scores)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, kinds)], ["query_id", "vec_id", "score", "key"])

    return _met(vectors, queries, "<f8").mapInArrow(search, "query_id long, vec_id long, score long, key string")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows of vectors other than its own id.

    Both sides are (vec_id, q, wide) as of `quantised`. Vectors may have any length. Pairs with a wide vector are scored apart, by integers of any size and
    without bounds; a score beyond 64 bits is returned as the nearest one of 64, in the place that it really has. Vectors of
    different lengths meet as if the shorter one went on with zeros. Ties go to the smaller vec_id; fewer than k rows are all returned. A repeated vec_id takes part once for each
    row, and queries of one id share one list, in which a row stands once for each of them. Empty tables give no rows.

    Every block of queries meets every shard: a stated set of queries against all rows. What moves is a shard for each
    block of queries, and k rows for each query and shard come back.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, query_ids = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "query_ids"))
                rows, queries = (np.frombuffer(batch.column(c)[i].as_py(), "<i4").reshape(m, -1) for c, m in (("matrix", len(ids)), ("query_matrix", len(query_ids))))
                width = min(rows.shape[1], queries.shape[1])
                if not width:
                    width, rows, queries = 1, np.zeros((len(ids), 1), np.int64), np.zeros((len(query_ids), 1), np.int64)
                q, r, s = max_score(queries[:, :width].astype(np.int64), query_ids, np.ascontiguousarray(rows[:, :width].T.astype(np.int64)), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids[r]), pa.array(s.astype(np.int64))], ["query_id", "vec_id", "score"])

    # Queries may be few and wide; both paths give every shard's best, and the window merges them.
    narrow = lambda df: df.where("wide IS NULL").select("vec_id", "q")
    as_wide = lambda df: df.select("vec_id", F.coalesce("wide", F.col("q").cast("array<double>")).alias("q"))
    found = _met(narrow(vectors), narrow(queries)).mapInArrow(search, "query_id long, vec_id long, score long")
    best = F.col("score")
    wide_rows, wide_queries = (df.where("wide IS NOT NULL") for df in (vectors, queries))
    if not (wide_rows.isEmpty() and wide_queries.isEmpty()):
        digits = F.replace(F.col("score").cast("string"), F.lit("-"), F.lit(""))
        size = F.length(digits)
        key = F.when(best >= 0, F.concat(F.lit("1"), F.lpad(size.cast("string"), 5, "0"), digits)).otherwise(F.concat(F.lit("0"), F.lpad((99999 - size).cast("string"), 5, "0"), F.translate(digits, "0123456789", "9876543210")))
        found = found.withColumn("key", key)
        for rows, asked in ((vectors, wide_queries), (wide_rows, queries.where("wide IS NULL"))):
            found = found.unionByName(_wide_scores(as_wide(rows), as_wide(asked), k))
        best = F.col("key")
    order = Window.partitionBy("query_id").orderBy(best.desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
