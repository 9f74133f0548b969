"""Token ids in binary shards with keyed access: a minimal perfect hash index over raw id payloads.

Layout of a store (all integers little-endian):

* `ids/<name>.bin`  raw ids, one after the other, 16 bits each when the vocabulary allows it, else 32. Documents stand in
  ascending id order, each followed by the end id. One file for each range of ids; nothing but ids is in it.
* `index/<name>.mph`  one file for each bucket of keys: a minimal perfect hash (levels of bit arrays with ranks) and one
  record for each key at the place that the hash gives: a 32-bit fingerprint, shard number, place and number of ids.

A key is a document id and its occurrence (0 but for repeated ids), so a lookup costs one probe of a few bit arrays and
one record; the fingerprint tells keys that are not in the store. Tasks write files under names of their own attempt
and report them; only reported files count, so a task that is run again after the loss of an executor does no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pieces, words
from .shared import doc_text, new_path, table, written
from .words import mix

MAGIC = np.uint64(0x3148504D464151)  # the bytes QAFMPH1
RECORD = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])
_LEVELS, _GAMMA = 40, 2.0


def key_hash(doc_id: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.astype(np.int64).view(np.uint64)) + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(h ^ np.uint64((level + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) % np.uint64(size)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h + np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype("<u4")


def build_index(h: np.ndarray, shard: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """The bytes of one index file. Each level keeps the keys that are alone at their place and hands on the others."""
    sizes, words, rest, level = [], [], np.arange(len(h)), 0
    rank_of, taken = np.zeros(len(h), np.int64), 0
    while len(rest):
        if level == _LEVELS:
            raise ValueError("two keys have one hash")
        size = max(64, -(-int(len(rest) * _GAMMA) // 64) * 64)
        at = _place(h[rest], level, size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        kept = alone[at]
        rank = np.cumsum(alone) - 1
        rank_of[rest[kept]] = taken + rank[at[kept]]
        taken += int(alone.sum())
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        rest, level = rest[~kept], level + 1
    bits = np.concatenate(words) if words else np.zeros(0, "<u8")
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])[:-1].astype("<u8") if len(bits) else np.zeros(0, "<u8")
    records = np.zeros(len(h), RECORD)
    records["fingerprint"][rank_of], records["shard"][rank_of] = _fingerprint(h), shard
    records["offset"][rank_of], records["length"][rank_of] = offset, length
    head = np.array([MAGIC, len(h), len(sizes), *sizes], "<u8")
    return head.tobytes() + bits.astype("<u8").tobytes() + before.tobytes() + records.tobytes()


class Index:
    """An index file in memory; find() answers many keys at once."""

    def __init__(self, raw: bytes):
        magic, self.n, levels = (int(x) for x in np.frombuffer(raw, "<u8", 3))
        if magic != int(MAGIC):
            raise ValueError("not an index file")
        self.sizes = np.frombuffer(raw, "<u8", levels, 24).astype(np.int64)
        n_words, at = int(self.sizes.sum()) // 64, 24 + 8 * levels
        self.bits = np.frombuffer(raw, "<u8", n_words, at)
        self.before = np.frombuffer(raw, "<u8", n_words, at + 8 * n_words)
        self.records = np.frombuffer(raw, RECORD, self.n, at + 16 * n_words)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The record number of each key hash, -1 where the store has no such key."""
        out, rest, first = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _place(h[rest], level, size).astype(np.int64) + first
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[hit]] = (self.before[at >> 6].astype(np.int64) + below.astype(np.int64))[hit]
            rest, first = rest[~hit], first + size
        found = out >= 0
        found[found] = self.records["fingerprint"][out[found]] == _fingerprint(h[found])
        return np.where(found, out, -1)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def _shard_writer(uri: str, vocab_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task = pieces.of_worker(pieces.PieceEncoder, vocab_path), TaskContext.get().partitionId()
        name, stream, offset, last, times = f"{uuid.uuid4().hex}.bin", None, 0, "no id yet", 0
        try:
            for batch in batches:
                if stream is None and len(batch):
                    filesystem, folder = _open(f"{uri}/ids")
                    filesystem.create_dir(folder, recursive=True)
                    stream = filesystem.open_output_stream(f"{folder}/{name}")
                for first, part in words.groups(batch.column("text"), pieces.GROUP):
                    rows = []
                    ids, count = encoder.encode(part, end_id)
                    stream.write(ids.tobytes())
                    for doc_id, n in zip(batch.column("doc_id").slice(first, len(part)).to_pylist(), count.tolist()):
                        times = times + 1 if doc_id == last else 0
                        last = doc_id
                        rows.append((doc_id, times, task, name, offset, n))
                        offset += n
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "occurrence", "range", "file", "at", "n_tokens"])
        finally:
            if stream is not None:
                stream.close()

    return write


def write_store(docs: DataFrame, uri: str, vocab_path: str, end_id: int = 0, keys_per_bucket: int = 200_000) -> dict:
    """Encode docs (doc_id, text) and write a store at uri.

    A null text is empty, so its document has the end id alone. Documents with a null id come first, under the key of
    id 0 and an occurrence counted from 2**62. Rows that repeat an id stay, in the order of their texts' hashes, under
    occurrences 0, 1, ... Equal rows are tied and get their occurrences in either order. Only doc_id and text are read, so
    other columns of docs, whatever their names, take no part. An empty table gives a store without files. A task has one
    range of (doc_id, hash, place in the input), as a stream, so an id that very many rows have, or copies under one id, are
    dealt over tasks.

    Returns the store's description: its uri, id width, the table of shards (number, file, first id's place in the whole
    sequence) and the table of index files (bucket, file).
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("place")]
    placed = doc_text(docs).withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    entries = written(ordered.mapInArrow(_shard_writer(uri, vocab_path, end_id), "doc_id long, occurrence long, range int, file string, at long, n_tokens long"), "token-entries")
    entries = _counted_on(entries)
    null = F.col("doc_id").isNull()
    entries = entries.withColumn("occurrence", F.when(null, F.lit(1 << 62)).otherwise(0) + F.col("occurrence")).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    # One row for each file from here on.
    files = entries.groupBy("file").agg(F.min("range").alias("range"), F.sum("n_tokens").alias("n_ids"))
    in_order = Window.orderBy("range")
    shards = written(files.select("file", (F.row_number().over(in_order) - 1).cast("long").alias("shard"), (F.sum("n_ids").over(in_order) - F.col("n_ids")).alias("base"), "n_ids"), "token-shards")
    buckets = max(1, -(-entries.count() // keys_per_bucket))

    def index(rows: pa.Table) -> pa.Table:
        h = key_hash(rows.column("doc_id").to_numpy(), rows.column("occurrence").to_numpy())
        raw = build_index(h, rows.column("shard").to_numpy(), rows.column("at").to_numpy(), rows.column("n_tokens").to_numpy())
        name = f"{uuid.uuid4().hex}.mph"
        filesystem, folder = _open(f"{uri}/index")
        filesystem.create_dir(folder, recursive=True)
        with filesystem.open_output_stream(f"{folder}/{name}") as stream:
            stream.write(raw)
        return pa.table({"bucket": pa.array([rows.column("bucket")[0].as_py()], pa.int64()), "index_file": [name]})

    keyed = entries.join(shards, "file").withColumn("bucket", bucket_of(buckets))
    index_files = written(keyed.groupBy("bucket").applyInArrow(index, "bucket long, index_file string"), "token-index")
    size = pieces.of_worker(pieces.PieceEncoder, vocab_path).dtype.itemsize
    return {"uri": uri, "width": size, "buckets": buckets, "shards": shards, "index": index_files, "spark": spark}


def _counted_on(entries: DataFrame) -> DataFrame:
    """entries, whose occurrences are counted in each range anew, counted on from range to range.

    An id that several ranges share is the first or the last one of each of them, so the tables on the way have a few rows for
    each range (a task) and may be broadcast.
    """
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"))
    ends = entries.groupBy("range").agg(F.array(F.min(key), F.max(key)).alias("ends"))
    shared = ends.select("range", F.explode("ends").alias("end")).distinct().groupBy("end").agg(F.count("*").alias("n")).where("n > 1").select(F.col("end.doc_id").alias("id"))
    own = entries.join(F.broadcast(shared), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").groupBy("doc_id", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    before = own.select(F.col("doc_id").alias("id"), F.col("range").alias("of"), F.coalesce(before, F.lit(0)).alias("before"))
    on = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("range") == F.col("of"))
    out = entries.join(F.broadcast(before), on, "left").withColumn("occurrence", F.col("occurrence") + F.coalesce("before", F.lit(0)))
    return out.drop("id", "of", "before")


def keys_of(docs: DataFrame) -> DataFrame:
    """The keys (doc_id, occurrence) that `write_store` gives to the rows of docs.

    Rows of an id are counted by parts of the table and numbered from what the parts before have, so an id that very many rows
    have is numbered by many tasks.
    """
    salted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.spark_partition_id() % 256).alias("salt")).groupBy("doc_id", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))  # 256 rows at most
    first = salted.withColumn("first", F.coalesce(before, F.lit(0))).repartition(F.col("doc_id"), F.col("salt"))
    rows = first.select("doc_id", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("occurrence"))
    null = F.col("doc_id").isNull()
    return rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), (F.when(null, F.lit(1 << 62)).otherwise(0) + F.col("occurrence")).alias("occurrence"))


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(buckets)).cast("long")


def lookup(keys: DataFrame, store: dict) -> DataFrame:
    """Each key (doc_id, occurrence) that the store has, with shard, place and number of ids, from the index files alone."""
    uri = store["uri"]

    def find(rows: pa.Table) -> pa.Table:
        filesystem, folder = _open(f"{uri}/index")
        with filesystem.open_input_stream(f"{folder}/{rows.column('index_file')[0].as_py()}") as stream:
            index = Index(stream.read())
        at = index.find(key_hash(rows.column("doc_id").to_numpy(), rows.column("occurrence").to_numpy()))
        rows, got = rows.filter(pa.array(at >= 0)), index.records[at[at >= 0]]
        return pa.table({"doc_id": rows.column("doc_id"), "occurrence": rows.column("occurrence"), "shard": pa.array(got["shard"].astype(np.int64)), "at": pa.array(got["offset"].astype(np.int64)), "n_tokens": pa.array(got["length"].astype(np.int64))})

    placed = keys.withColumn("bucket", bucket_of(store["buckets"])).join(store["index"], "bucket")
    # A bucket's keys may be asked for many times over: deal them out by a salt too.
    return placed.groupBy("bucket", F.pmod(F.hash("occurrence", "doc_id"), F.lit(4))).applyInArrow(find, "doc_id long, occurrence long, shard long, at long, n_tokens long")


def read_ids(found: DataFrame, store: dict, checksum_only: bool = False) -> DataFrame:
    """The ids of each found document, read from the shards, with start (its place in the whole sequence).

    With checksum_only, the crc32 of the ids as 32-bit integers stands in for the ids.
    """
    uri, dtype = store["uri"], np.dtype(f"<u{store['width']}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, (filesystem, folder) = None, None, _open(f"{uri}/ids")
        try:
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("file", "at", "n_tokens")]
                out = []
                for file, at, n in zip(*cols):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, filesystem.open_input_file(f"{folder}/{file}")
                    ids = np.frombuffer(source.read_at(n * dtype.itemsize, at * dtype.itemsize), dtype)
                    out.append(zlib.crc32(ids.astype("<u4").tobytes()) if checksum_only else ids.astype(np.int32))
                kind = pa.int64() if checksum_only else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "occurrence", "start", "n_tokens")), pa.array(out, kind)], ["doc_id", "occurrence", "start", "n_tokens", "ids"])
        finally:
            if source is not None:
                source.close()

    placed = found.join(store["shards"], "shard").select("doc_id", "occurrence", "file", "at", "n_tokens", (F.col("base") + F.col("at")).alias("start"))
    # Neighbours in a file are read one after the other.
    ranged = placed.repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    return ranged.mapInArrow(read, f"doc_id long, occurrence long, start long, n_tokens long, ids {'long' if checksum_only else 'array<int>'}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    store = write_store(docs, new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    out = read_ids(lookup(keys_of(docs), store), store, checksum_only=True)
    known = F.col("occurrence") < (1 << 62)
    return out.select(F.when(known, F.col("doc_id")).alias("doc_id"), "start", "n_tokens", F.col("ids").alias("ids_crc32"))
