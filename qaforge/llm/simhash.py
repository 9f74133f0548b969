"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits are cut into a ring of distance + 1 boxes. If two fingerprints differ in at most `distance` bits,
then from some box on, every chain of l consecutive boxes differs in at most l * distance // boxes bits (0, 1, 2, ...: its
share of the budget). So a pair is looked for under keys made of a chain's bits: the first box is equal, and the others are
met by small neighbourhoods. A candidate's chain is then followed box by box and dropped at the first excess, and what has
gone all the way round is within the distance: the last step is the full Hamming check.

Only distinct fingerprints take part, so copies cost nothing. A list (the fingerprints under one key) of bounded length is
compared inside its task, which gives a spanning forest of its links and never its pairs. A longer list is handled exactly
and in linear time: its members are compared with one centre; if that and the other lists leave it in several components,
its members go on under keys of a longer chain. Under the keys of the whole ring, points half-way between two
fingerprints, all members of a list are within the distance of each other, so a star joins them without a comparison.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .components import components
from .shared import bounded_batches, doc_text, drop, table, written

#: Lists up to this length are compared within a task.
LONGEST = 256
#: Shingles that are hashed and counted at once.
_AT_ONCE = 1 << 14
#: A-Z lower-cased, and the six separators made one.
_PLAIN = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_GAPS = re.compile(rb" +")


def fingerprint(text: bytes, n: int = 4, seed: int = 42) -> int:
    """The SimHash of a text (UTF-8) over its n-word shingles, repeats included, as an unsigned integer.

    A text of fewer words has its whole sequence as one shingle; one without words has fingerprint 0.
    """
    text = text.translate(_PLAIN)
    if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
        text = _GAPS.sub(b" ", text).strip(b" ")
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    n = min(n, len(gaps) + 1)
    begins, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(text)]])
    begins, ends, digest = begins[: len(begins) - n + 1], ends[n - 1 :], xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begins), _AT_ONCE):
        hashes = np.array([digest(text[a:b], seed) for a, b in zip(begins[at : at + _AT_ONCE].tolist(), ends[at : at + _AT_ONCE].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit integer) of each row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in words.groups(batch.column("text")):
                found = np.array([fingerprint(t.as_py(), n) for t in part.cast(pa.large_binary())], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return doc_text(docs).mapInArrow(hashed, "doc_id long, fp long")


class Ring:
    """Boxes of 64 bits for a distance (1 to 8): chains, their budgets and their keys."""

    def __init__(self, distance: int = 4):
        if not 1 <= distance <= 8:
            raise ValueError(f"the distance must be from 1 to 8, not {distance}")
        self.distance, self.boxes = distance, distance + 1
        bounds = [64 * i // self.boxes for i in range(self.boxes + 1)]
        of = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(bounds, bounds[1:])]
        #: chain[i, l]: the bits of the l boxes from box i on.
        self.chain = np.array([[sum(of[(i + j) % self.boxes] for j in range(l)) for l in range(self.boxes + 1)] for i in range(self.boxes)], np.uint64)
        self.lengths = sorted({min(2, self.boxes), min(3, self.boxes), self.boxes})

    def budget(self, length: int) -> int:
        return length * self.distance // self.boxes

    def viable(self, apart: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Whether differences (64-bit) stay within the budget of every chain that begins at their box, up to the whole ring."""
        ok = np.arange(len(apart))
        for length in range(1, self.boxes + 1):
            ok = ok[np.bitwise_count(apart[ok] & self.chain[box[ok], length]) <= self.budget(length)]
        out = np.zeros(len(apart), bool)
        out[ok] = True
        return out

    def keys(self, fp: np.ndarray, box: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of fingerprints by their chain of this length from a box on, and the row of each.

        A budget of one bit is met by clearing a set bit on either side (the one that has it set finds the other); a larger
        one by flipping half of it on both sides.
        """
        base, rows = fp & self.chain[box, length], np.arange(len(fp))
        free = int(self.chain[box, length] & ~self.chain[box, 1])
        bits = [1 << b for b in range(64) if free >> b & 1]
        if self.budget(length) == 1:
            cleared = base[:, None] & ~np.array(bits, np.uint64)
            at, _ = np.nonzero(changed := cleared != base[:, None])
            return np.concatenate([base, cleared[changed]]), np.concatenate([rows, at])
        flips = [sum(some) for k in range((self.budget(length) + 1) // 2 + 1) for some in combinations(bits, k)]
        return (base[:, None] ^ np.array(flips, np.uint64)).ravel(), np.repeat(rows, len(flips))


def _entries(members: DataFrame, ring: Ring, length: int) -> DataFrame:
    """box, key, fp: the keys of members (box, fp) by chains of this length; a null box stands for all."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                boxes, fps = part.column("box").fill_null(-1).to_numpy(), part.column("fp").to_numpy().view(np.uint64)
                for box in range(ring.boxes):
                    own = fps[(boxes == box) | (boxes < 0)]
                    key, row = ring.keys(own, box, length)
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), box, np.int8)), pa.array(key.view(np.int64)), pa.array(own[row].view(np.int64))], ["box", "key", "fp"])

    return members.select(F.col("box").cast("byte").alias("box"), "fp").mapInArrow(emit, "box byte, key long, fp long")


def _forest(fp: np.ndarray, box: int, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Members of one list, each with the first member that links inside the list reach (those that are their own left out)."""
    n = len(fp)
    near = ring.viable((fp[:, None] ^ fp).ravel(), np.full(n * n, box)).reshape(n, n)
    first = np.arange(n)
    while True:
        reached = np.where(near, first, n).min(axis=1)
        if (reached == first).all():
            break
        first = reached
    moved = np.flatnonzero(first != np.arange(n))
    return fp[moved], fp[first[moved]]


def _links(lists: DataFrame, ring: Ring) -> DataFrame:
    """u, v: a spanning forest of the links inside each list (box, members)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, box = batch.column("members"), batch.column("box").to_numpy()
            first, fps = members.offsets.to_numpy(), members.values.to_numpy().view(np.uint64)
            size = np.diff(first)
            two = np.flatnonzero(size == 2)
            a, b = fps[first[two]], fps[first[two] + 1]
            ok = ring.viable(a ^ b, box[two])
            u, v = [a[ok]], [b[ok]]
            for i in np.flatnonzero(size > 2).tolist():
                x, y = _forest(fps[first[i] : first[i + 1]], int(box[i]), ring)
                u.append(x)
                v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"])

    return lists.select("box", "members").mapInArrow(compare, "u long, v long").distinct()


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, ring: Ring, longest: int = LONGEST) -> DataFrame:
    """u, v: edges over distinct fingerprints (fp) whose components are those of all pairs within the distance."""
    members, found = fps.select(F.lit(None).cast("byte").alias("box"), "fp"), None
    for length in ring.lengths:
        entries = _entries(members, ring, length)
        counted = written(entries.groupBy("box", "key").agg(F.count("*").alias("n"), F.min("fp").alias("center")).where("n > 1"), "lists")
        whole = length == ring.boxes  # then everything under a key is within the distance
        short = counted.where(F.col("n") <= (0 if whole else longest)).select("box", "key")
        gathered = entries.join(short, ["box", "key"]).groupBy("box", "key").agg(F.collect_list("fp").alias("members"))  # `longest` at most
        long = entries.join(counted.where(F.col("n") > (0 if whole else longest)), ["box", "key"])
        new = None if whole else _links(gathered, ring)
        if whole or not counted.where(F.col("n") > longest).isEmpty():
            long = long if whole else written(long, "long-lists")
            star = long.where("fp <> center").where(_apart(F.col("fp"), F.col("center")) <= ring.distance).select(F.col("fp").alias("u"), F.col("center").alias("v"))
            new = star.distinct() if new is None else new.unionByName(star).distinct()
            found = written(new if found is None else found.unionByName(new), "links")
        else:
            return written(new if found is None else found.unionByName(new), "links")
        if whole:
            break
        # Long lists that are still in several components go on under longer chains.
        labels = components(found)
        labelled = long.join(labels, F.col("fp") == F.col("node"), "left").select("box", "key", "fp", F.coalesce("root", "fp").alias("root"))
        split = labelled.groupBy("box", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("box", "key")
        members = written(long.join(split, ["box", "key"], "left_semi").select("box", "fp").distinct(), "members")
        drop(counted)
        if members.isEmpty():
            break
    return found


def near_duplicates(docs: DataFrame, n: int = 4, distance: int = 4, longest: int = LONGEST) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row of docs (doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text, A-Z lower-cased; shingles are n words joined by a space, repeats
    included, hashed by XXH64 with seed 42. A bit of the fingerprint is set if it is in over half of the hashes. Documents
    whose fingerprints differ in at most `distance` bits are linked; component_id is the smallest doc_id that links reach.

    Null and empty texts and texts of white space have fingerprint 0, which is linked like any other. Texts of fewer words
    have one shingle. Rows that repeat a doc_id are one document to the links, each with its own fingerprint. A row with a
    null doc_id takes part and has its component's smallest id, null if there is none. An empty table gives no rows; other
    columns are not looked at. `longest` bounds the lists that are compared in one task and doesn't change the result.
    """
    ring = Ring(distance)
    rows = written(fingerprints(docs, n), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    several = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).where("v < w").select("doc_id", "v")
    same_id = rows.join(several, "doc_id").select(F.col("fp").alias("u"), "v")
    roots = written(components(links(classes, ring, longest).unionByName(same_id)).withColumnRenamed("node", "fp"), "roots")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = rooted.join(least, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(placed, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
