"""Centroid clustering by sort-means, in integers.

Each round, the other centroids are sorted by their distance from each centroid. A vector begins at its centroid of the
round before and looks at the others in that order; by the triangle inequality none can be nearer, or as near, once it lies
strictly beyond twice the vector's distance from where it began. A round is one pass: a task writes its vectors with their
new numbers and, beside them, the sums of its clusters, which are then added up (a fixed number of integers).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, drop, table, written

#: Components up to this size are computed in 64 bits; beyond it, by integers of any size.
NARROW = 1 << 27
#: Sums travel as digits of this base, so that they may have any size.
_BASE = 40
_TOP = (1 << 63) - 1
#: Positions of a cluster's number of vectors and of its inertia, beside those of its components.
_COUNT, _INERTIA = -1, -2
_SUMS = "array<struct<cluster:int,position:int,digit:int,value:long>>"


class SortMeans:
    """Centroids (lists of integers of any size) and, for each, the others in the order of their distance."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = centroids
        self.narrow = [all(-NARROW <= x <= NARROW for x in c) for c in centroids]
        self.array = np.array([c if ok else [0] * len(c) for c, ok in zip(centroids, self.narrow)], np.int64)
        self.order, self.limit = [], []
        for a, one in enumerate(centroids):
            apart = sorted((sum((x - y) ** 2 for x, y in zip(one, other)), b) for b, other in enumerate(centroids) if b != a)
            self.order.append([b for _, b in apart])
            # A squared distance d is under this if and only if the other centroid lies beyond twice d's root.
            self.limit.append([-(-d // 4) for d, _ in apart])

    def nearest(self, rows: np.ndarray, began: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row (narrow integers); `began` has the numbers of the
        round before. The last array has the places of rows that need integers of any size."""
        cluster, distance, open_rows = began.copy(), np.zeros(len(rows), np.int64), []
        away = lambda at, c: ((rows[at] - self.array[c]) ** 2).sum(axis=1)
        for a in np.unique(began).tolist():
            at = np.flatnonzero(began == a)
            if not self.narrow[a]:
                open_rows.append(at)
                continue
            first = away(at, a)
            distance[at] = first
            for b, limit in zip(self.order[a], self.limit[a]):
                more = first >= min(limit, _TOP)
                at, first = at[more], first[more]
                if not len(at):
                    break
                if not self.narrow[b]:
                    open_rows.append(at)
                    continue
                there = away(at, b)
                better = (there < distance[at]) | (there == distance[at]) & (b < cluster[at])
                cluster[at[better]], distance[at[better]] = b, there[better]
        return cluster, distance, np.unique(np.concatenate(open_rows)) if open_rows else np.zeros(0, np.int64)

    def nearest_of(self, row: list[int], began: int) -> tuple[int, int]:
        """The same for one row of integers of any size."""
        away = lambda c: sum((x - y) ** 2 for x, y in zip(row, self.exact[c]))
        first = away(began)
        best = (first, began)
        for b, limit in zip(self.order[began], self.limit[began]):
            if first < limit:
                break
            best = min(best, (away(b), b))
        return best[1], best[0]


def _digits(value: int) -> Iterator[tuple[int, int]]:
    sign, value, digit = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield digit, sign * (value & (1 << _BASE) - 1)
        value, digit = value >> _BASE, digit + 1


def _assigned(rows: DataFrame, centroids: list[list[int]], scale: int) -> DataFrame:
    """rows (vec_id, v, cluster, sums; those of sums left out) with the numbers of their nearest centroids and their squared
    distances, and one row of sums for each task. A distance beyond 64 bits is the largest of 64."""
    kind = dict(rows.dtypes)["v"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, width = SortMeans(centroids), len(centroids[0])
        sums = np.zeros((len(centroids), width), object)
        counts, inertia = [0] * len(centroids), [0] * len(centroids)
        layout = None
        for batch in batches:
            layout = batch.schema.field("v").type
            if not len(batch):
                continue
            scaled = np.floor(batch.column("v").flatten().to_numpy().astype(np.float64).reshape(-1, width) * scale)
            narrow = (np.abs(scaled) <= NARROW).all(axis=1)
            integers = np.where(narrow[:, None], scaled, 0.0).astype(np.int64)
            cluster, distance, rest = means.nearest(integers, batch.column("cluster").to_numpy().astype(np.int64))
            began = batch.column("cluster").to_numpy()
            for i in np.union1d(rest, np.flatnonzero(~narrow)).tolist():
                row = [int(x) for x in scaled[i]]
                cluster[i], exact = means.nearest_of(row, int(began[i]))
                distance[i] = min(exact, _TOP)
                inertia[cluster[i]] += exact - int(distance[i])
                if not narrow[i]:
                    sums[cluster[i]] += row
            for c in np.unique(cluster).tolist():
                own = cluster == c
                sums[c] += integers[own].sum(axis=0)
                counts[c] += int(own.sum())
                inertia[c] += sum(distance[own].tolist())
            empty = pa.nulls(len(batch), sums_type())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(distance), empty], ["vec_id", "v", "cluster", "distance", "sums"])
        if any(counts):
            found = [{"cluster": c, "position": p, "digit": d, "value": x} for c in range(len(centroids)) for p, total in [*enumerate(sums[c]), (_COUNT, counts[c]), (_INERTIA, inertia[c])] for d, x in _digits(int(total))]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, layout), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([found], sums_type())], ["vec_id", "v", "cluster", "distance", "sums"])

    def sums_type() -> pa.DataType:
        return pa.list_(pa.struct([("cluster", pa.int32()), ("position", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())]))

    vectors = rows.where("sums IS NULL").select("vec_id", "v", "cluster")
    return vectors.mapInArrow(assign, f"vec_id long, v {kind}, cluster int, distance long, sums {_SUMS}")


def _totals(rows: DataFrame) -> dict[tuple[int, int], int]:
    """The sums of all tasks by cluster and position: as many as there are components in all centroids, and two more each."""
    found = rows.where("sums IS NOT NULL").select(F.inline("sums")).groupBy("cluster", "position", "digit").agg(F.sum("value").alias("value"))
    out: dict[tuple[int, int], int] = {}
    for r in found.collect():
        key = (r["cluster"], r["position"])
        out[key] = out.get(key, 0) + (r["value"] << _BASE * r["digit"])
    return out


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part.

    Those of vectors (vec_id, embedding) take part that have `width` components, none of them null, NaN, infinite, or
    infinite once scaled; a component x is the integer floor(scale * x). Centroids begin as the k vectors whose sha256 of
    `<salt>:<vec_id>` is smallest, in that order (of rows that share an id, the smaller vector first; null ids last). Each
    round gives every vector to the nearest centroid, the one of the smaller number if several are as near, and makes every
    centroid the floor of its vectors' mean; one without vectors stays as it is. After the rounds vectors are given once
    more. Distances are squared; inertias are their sums over the cluster and over all; centroid_sha256 is that of the
    cluster's last centroid as integers joined by commas.

    Sums and distances are exact at any size; a distance or an inertia beyond 64 bits is returned as the largest of 64.
    Repeated rows take part once each. With fewer than k vectors there are fewer centroids; an empty table gives no rows.
    Other columns are not looked at.
    """
    bounded_batches(vectors.sparkSession)
    v = F.col("embedding")
    kind = dict(vectors.dtypes)["embedding"]
    v = v if kind in ("array<float>", "array<double>") else v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * float(scale)) < F.lit(float("inf"))))
    kept = vectors.where(v.isNotNull() & (F.size(v) == width)).where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()
    centroids = [[int(x) for x in np.floor(np.array(r["v"], np.float64) * scale)] for r in first]
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], result)
    now = kept.withColumns({"cluster": F.lit(0), "sums": F.lit(None).cast(_SUMS)})
    for i in range(rounds + 1):
        following = written(_assigned(now, centroids, scale), "clusters")
        drop(now)
        now, found = following, _totals(following)
        if i < rounds:
            centroids = [[found.get((c, p), 0) // found[c, _COUNT] for p in range(width)] if (c, _COUNT) in found else old for c, old in enumerate(centroids)]
    inertia = [found.get((c, _INERTIA), 0) for c in range(len(centroids))]
    of = lambda values: F.array(*(F.lit(x) for x in values))[F.col("cluster")]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return now.where("sums IS NULL").select(
        "vec_id",
        "cluster",
        "distance",
        of([min(x, _TOP) for x in inertia]).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(inertia), _TOP)).cast("long").alias("inertia"),
        of(names).alias("centroid_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _oracle(k: int = 8, rounds: int = 10) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT row, cluster, d FROM (SELECT row, cluster, sum((x - c) * (x - c)) AS d FROM x JOIN c{i} USING (pos) GROUP BY row, cluster)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT cluster, pos, sum(x) AS s, count(*) AS n FROM x JOIN a{i} USING (row) GROUP BY cluster, pos), c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, c.pos, CAST(CASE WHEN m.n IS NULL THEN c.c ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS BIGINT) AS c
  FROM c{i} c LEFT JOIN m{i} m ON c.cluster = m.cluster AND c.pos = m.pos
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT row, pos, q[pos] AS x FROM v, range(1, 65) AS r(pos)), c0 AS MATERIALIZED (
  SELECT cluster, pos, q[pos] AS c FROM (
    SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS cluster, q FROM v QUALIFY cluster < {k}
  ), range(1, 65) AS r(pos)
), {', '.join(steps)}, h AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN v USING (row) JOIN h USING (cluster)
"""


ORACLE = _oracle()
