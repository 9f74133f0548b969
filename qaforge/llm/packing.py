"""Best-fit packing with certified bin counts.

Pieces of documents are dealt into partitions and each is packed by best-fit decreasing. Dual-feasible functions over the
histogram of lengths give a lower bound on a partition's number of sequences; a partition that meets its bound is
certified as optimal and done. The others hand the pieces of their unfilled sequences to one pool, which is dealt anew
into fewer partitions and packed again, until all are certified or a round gains nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces, words
from .shared import bounded_batches, doc_text, table, written


def lower_bound(histogram: np.ndarray) -> int:
    """Sequences that any packing needs for histogram[n] pieces of each length n = 0..capacity.

    The largest bound among the plain sum, the cut functions f_a (longer than C - a counts as C, shorter than a as 0) and
    the rounding functions u_k(x) = floor((k + 1) x / C) / k, where exact multiples of C / (k + 1) keep x / C.
    """
    capacity = len(histogram) - 1
    n, size = histogram.astype(np.int64), np.arange(capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    weight = np.concatenate([[0], np.cumsum(n * size)])
    count = np.concatenate([[0], np.cumsum(n)])
    for a in range(1, capacity // 2 + 1):
        high = capacity - a
        total = (weight[high + 1] - weight[a]) + capacity * (count[-1] - count[high + 1])
        best = max(best, -(-int(total) // capacity))
    for k in range(1, 33):
        up = (k + 1) * size
        u = np.where(up % capacity == 0, size * k, (up // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((n * u).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the space left in each bin."""
    order = np.argsort(-lengths, kind="stable")
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces = 0  # bit s: some bin has s left
    bins, offsets, left = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = open_spaces >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                open_spaces &= ~(1 << space)
        else:
            space, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - space
        space -= n
        left[b] = space
        if space:
            by_space[space].append(b)
            open_spaces |= 1 << space
    return bins, offsets, np.array(left, np.int64)


def pack(items: DataFrame, capacity: int, per_partition: int = 20_000, rounds: int = 8) -> DataFrame:
    """items (with a unique long `uid` and a long `length` from 1 to capacity) with sequence_id and offset.

    sequence_id is the uid of the piece at offset 0, so ids need no coordination between partitions. Pieces that fill a
    sequence alone are not dealt at all. An empty table gives an empty one.
    """
    keep = items.columns
    full = items.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    schema = items.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "again": F.lit(True)}).schema

    def run(rows: pa.Table) -> pa.Table:
        lengths, uid = rows.column("length").to_numpy(), rows.column("uid").to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        head = np.zeros(len(left), np.int64)
        head[bins[offsets == 0]] = uid[offsets == 0]
        gap = len(left) > lower_bound(np.bincount(lengths, minlength=capacity + 1))
        rows = rows.select(keep).append_column("sequence_id", pa.array(head[bins])).append_column("offset", pa.array(offsets))
        return rows.append_column("again", pa.array((left[bins] > 0) & gap))

    done, waiting, before = [full], items.where(F.col("length") < capacity), None
    for k in range(rounds):
        n = waiting.count()
        if not n:
            break
        parts = -(-n // per_partition)
        dealt = waiting.select(*keep, F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(parts)).alias("part"))
        packed = written(dealt.groupBy("part").applyInArrow(run, schema), f"packed-{k}")
        used = packed.where("again").agg(F.count(F.when(F.col("offset") == 0, 1))).first()[0]
        # One partition has nobody to exchange with; a round that opened as many sequences as it took gains nothing.
        if not used or parts == 1 or before is not None and used >= before or k == rounds - 1:
            done.append(packed.drop("again"))
            break
        before = used
        done.append(packed.where(~F.col("again")).drop("again"))
        waiting = packed.where("again").select(*keep)
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def certificate(packed: DataFrame, capacity: int = 1024) -> tuple[int, int]:
    """Sequences of a packing, and the lower bound over all its pieces: equal numbers certify the whole packing."""
    n = packed.where("offset = 0").count()
    rows = packed.groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    histogram = np.zeros(capacity + 1, np.int64)
    for r in rows:
        histogram[r["length"]] = r["n"]
    return n, lower_bound(histogram) if rows else 0


def document_pieces(docs: DataFrame, vocab_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each document: its ids, then the end id.

    Documents of more than capacity ids are cut into pieces of capacity ids, of which the first may be shorter. A null or
    empty text is the end id alone. Repeated rows give pieces of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces.of_worker(pieces.PieceEncoder, vocab_path)
        for batch in batches:
            for at, part in words.groups(batch.column("text"), pieces.GROUP):
                rows, begin = [], 0
                ids, count = encoder.encode(part, end_id)
                body = memoryview(ids.astype("<u4").tobytes())
                for doc_id, total in zip(batch.column("doc_id").slice(at, len(part)).to_pylist(), count.tolist()):
                    start, piece = 0, 0
                    while start < total:
                        n = (total - 1) % capacity + 1 if start == 0 else capacity
                        rows.append((doc_id, piece, start, n, zlib.crc32(body[4 * (begin + start) : 4 * (begin + start + n)])))
                        start, piece = start + n, piece + 1
                    begin += total
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    return doc_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Each piece of each document with sequence_id and offset (gapless from 0 within its sequence).

    A null or empty text is one piece, the end id alone. Rows that repeat an id or a whole document are pieces of their own, and
    ids may be null. Pieces of one length are tied: which of them shares a sequence with which is free, and any other choice
    would give as many sequences. Only doc_id and text are read, so other columns of docs, whatever their names, take no part.
    An empty table gives an empty one.
    """
    cut = document_pieces(docs, vocab_path, capacity, end_id)
    items = written(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack(items, capacity).drop("uid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
