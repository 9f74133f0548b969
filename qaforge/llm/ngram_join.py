"""N-gram Jaccard join by the pigeonhole principle over a partitioned universe.

Shingles are hashed, and for each band of set sizes the hash space is cut into segments. Two sets of Jaccard similarity
of at least t differ in at most H shingles, H following from their sizes, so among H + 1 segments they agree on one at
least. A document is indexed in the band of its size under the content of each of its segments, and looks for smaller
partners in the band or bands below.

A looked-up segment may be skipped (worth 0), matched exactly (worth 1), or matched up to one deletion on either side
(worth 2: two sets that do not match so differ there twice at least); any choice worth H + 1 in sum finds every partner.
Small contents are shared by many sets, so by a cost that falls with a segment's size the smallest segments are skipped,
paid for by spare segments and by one-deletion neighbourhoods of the first segments of the band, which are indexed too.

Two sets' bit maps of shingle parities differ in no more places than the sets do in shingles; that bound drops most pairs
before their sets are fetched. Candidates are verified exactly on the shingle sets. Within a list, every member is first compared with one centre, which
is linear; then members that are still in different components are compared with each other. So components are exact
and no group of near copies is expanded into its pairs.

Shingles are told apart by 64-bit hashes: any two given ones collide with a chance of 2**-64.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .components import components
from .shared import bounded_batches, doc_text, release, table, written

BOTH, INDEXED, LOOKED_UP = 0, 1, 2
#: Rows up to which a side is broadcast; beyond it, Spark shuffles both.
BROADCAST_ROWS = 1_000_000
#: Bytes of text whose sets are held at once, a longer text by itself.
GROUP = 1 << 17
#: 64-bit words of a parity map.
MAP_WORDS = 16
_PRIMES = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xA0761D6478BD642F], np.uint64)


class Scheme:
    """Bands and segments for shingles of n words and a similarity of at least part / whole."""

    def __init__(self, n: int = 4, part: int = 17, whole: int = 20, growth: float = 1.3):
        self.n, self.part, self.whole, self.growth = n, part, whole, growth
        self.lows = [1]

    def band(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * self.growth)))
        return bisect_right(self.lows, size) - 1

    def differ(self, a: int, b: int) -> int:
        """The most shingles in which linked sets of these sizes differ (a bound)."""
        return (self.whole - self.part) * (a + b) // (self.whole + self.part)

    def linked(self, common, a, b):
        return self.whole * common >= self.part * (a + b - common)

    def spare(self, band: int) -> int:
        return (self.differ(self.lows[band], self.lows[band]) + 1) // 12

    def with_deletions(self, band: int) -> int:
        low = self.differ(self.lows[band], self.lows[band])
        return 1 + low // 64 if low else 0

    def segments(self, band: int) -> int:
        top = self.lows[band + 1] - 1
        return self.differ(self.whole * top // self.part, top) + 1 + self.spare(band)

    def looked_up(self, size: int, band: int) -> int:
        """How many of the band's segments a set looks up to find all partners that are not larger."""
        return self.differ(size, min(size, self.lows[band + 1] - 1)) + 1 + self.spare(band)

    def indexed(self, size: int, band: int) -> int:
        largest = self.whole * size // self.part
        return self.differ(largest, min(largest, self.lows[band + 1] - 1)) + 1 + self.spare(band)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-word shingles of each text, one after the other, and where each text's begin.

    A text of fewer words has its whole sequence as the only one; a text without words has none.
    """
    w = words.Words(texts, words.SPACED)
    count, h = np.diff(w.first), w.hash
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    rolled = np.zeros(len(h), np.uint64)
    short = count < n
    for i in range(n):
        rolled[: len(h) - i] += h[i:] * _PRIMES[i % 8] * np.uint64(2 * (i // 8) + 1)
    own = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(h)) - w.first[own]
    keep = place <= np.maximum(count[own] - n, -1)
    for t in np.flatnonzero(short & (count > 0)):
        at = w.first[t]
        rolled[at] = (h[at : at + count[t]] * _PRIMES[np.arange(count[t]) % 8]).sum(dtype=np.uint64) + np.uint64(count[t])
        keep[at] = True
    rolled, own = words.mix(rolled[keep]), own[keep]
    first = np.searchsorted(own, np.arange(len(texts) + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        rolled[a:b].sort()
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (own[1:] != own[:-1])
    return rolled[new], np.searchsorted(own[new], np.arange(len(texts) + 1))


def _digests(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.mix(sets ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(words.mix((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _parities(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set, the parity of the number of its shingles in each of 64 * MAP_WORDS classes, as 64-bit integers."""
    bits = 64 * MAP_WORDS
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = own * bits + (words.mix(sets ^ np.uint64(0xBE5466CF34E90C6C)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=(len(first) - 1) * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _key(content: np.ndarray, band: int, segment: np.ndarray) -> np.ndarray:
    return words.mix(words.mix(content) + (segment.astype(np.uint64) + np.uint64(1)) * _PRIMES[1] + np.uint64((band + 1) * int(_PRIMES[2]) & (1 << 64) - 1))


def _cut(own: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of a set's m segments, and where each begins; segments are equal ranges of the hash space."""
    bounds = np.arange(1, m, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // m)
    first = np.concatenate([[0], np.searchsorted(own, bounds), [len(own)]])
    return np.diff(first), first[:-1]


def signatures(own: np.ndarray, scheme: Scheme) -> tuple[list[np.ndarray], list[np.ndarray], list[tuple[int, int, int]]]:
    """Keys and roles of one sorted shingle set, and its (band, segment, role) of empty segments."""
    size, keys, roles, empty = len(own), [], [], []
    mixed = words.mix(own ^ np.uint64(0x452821E638D01377))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    home = scheme.band(size)
    for band in range(scheme.band(-(-scheme.part * size // scheme.whole)), home + 1):
        sizes, first = _cut(own, scheme.segments(band))
        content = total[first + sizes] - total[first]
        looked, spare, deletions = scheme.looked_up(size, band), scheme.spare(band), scheme.with_deletions(band)
        # Allocation: skip the smallest segments that the spare ones pay for, and then empty and single ones that a
        # deletion neighbourhood pays for.
        rank = np.argsort(sizes[:looked], kind="stable")
        worth = np.ones(looked, np.int8)
        worth[rank[:spare]] = 0
        payers = [i for i in range(min(deletions, looked)) if sizes[i] >= 3 and worth[i] == 1]
        for payer, small in zip(payers, rank[spare:].tolist()):
            if sizes[small] > 1:
                break
            worth[payer], worth[small] = 2, 0
        count = scheme.indexed(size, band) if band == home else looked
        segment = np.arange(count)
        asked = np.zeros(count, bool)
        asked[:looked] = worth > 0
        role = np.where(asked, BOTH, INDEXED) if band == home else np.full(count, LOOKED_UP)
        send = (sizes[:count] > 0) & (asked | (band == home))
        keys.append(_key(content[:count][send], band, segment[send]))
        roles.append(role[send])
        for i in range(min(deletions, count)):
            # In the home band these serve the index (a segment that asks has three shingles, so four are needed here to
            # match it) and this set's own search; below, the search alone.
            paid = i < looked and worth[i] == 2
            if paid or band == home and sizes[i] > 3:
                less = content[i] - mixed[first[i] : first[i] + sizes[i]]
                keys.append(_key(less, band, np.full(len(less), i)))
                roles.append(np.full(len(less), (BOTH if paid else INDEXED) if band == home else LOOKED_UP))
        for i in np.flatnonzero(sizes[:count] == 0).tolist():
            if band == home:
                empty.append((band, i, BOTH if asked[i] else INDEXED))
            elif asked[i]:
                empty.append((band, i, LOOKED_UP))
    return keys, roles, empty


def _ids(docs: DataFrame) -> DataFrame:
    return doc_text(docs).where(F.col("doc_id").isNotNull())


def set_digests(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, n_shingles, the set's digest (d1, d2) and its parity map of each row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in words.groups(batch.column("text"), GROUP):
                sets, first = shingle_sets(part, scheme.n)
                d1, d2 = _digests(sets, first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.array(np.diff(first)), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(np.arange(0, len(part) * MAP_WORDS + 1, MAP_WORDS, dtype=np.int32), _parities(sets, first))], ["doc_id", "n_shingles", "d1", "d2", "map"])

    return doc_text(docs).mapInArrow(digest, "doc_id long, n_shingles long, d1 long, d2 long, map array<long>")


def _entries(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """key, doc_id, n (set size), role of each signature; a set that a task has met before is not sent again.

    Empty segments have role + 10: their lists are long, and only sets whose allocation had to look one up use them.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for at, part in words.groups(batch.column("text"), GROUP):
                sets, first = shingle_sets(part, scheme.n)
                d1, d2 = (d.tolist() for d in _digests(sets, first))
                keys, roles, owners, sizes = [], [], [], []
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    if a == b or (d1[i], d2[i]) in met:
                        continue
                    if len(met) < 200_000:
                        met.add((d1[i], d2[i]))
                    k, r, empty = signatures(sets[a:b], scheme)
                    if empty:
                        e = np.array(empty, np.int64)
                        k.append(_key(np.zeros(len(e), np.uint64), 0, e[:, 0] << 32 | e[:, 1]))
                        r.append(e[:, 2] + 10)
                    keys += k
                    roles += r
                    n = sum(map(len, k))
                    owners.append(np.full(n, ids[at + i]))
                    sizes.append(np.full(n, b - a))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(roles).astype(np.int8))], ["key", "doc_id", "n", "role"])

    return _ids(docs).mapInArrow(emit, "key long, doc_id long, n int, role byte")


_LIST = "key long, center long, center_n int, center_role byte, node long, n int, role byte"


def _lists(entries: DataFrame) -> DataFrame:
    """Each member of each list of two or more, beside the list's centre: its first by role and id.

    A list is walked in order and never gathered, so it may have any length.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the key, id, size and role of the list that the batch before ended with
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch.column(c).to_numpy() for c in ("key", "doc_id", "n", "role")]
            if last is not None:
                cols = [np.concatenate([np.array([x], c.dtype), c]) for x, c in zip(last, cols)]
            key = cols[0]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            last = [c[head[-1]] for c in cols]
            member = np.flatnonzero(~new & (cols[1] != cols[1][head]))
            center = head[member]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[member], cols[1][center], cols[2][center], cols[3][center], cols[1][member], cols[2][member], cols[3][member])], ["key", "center", "center_n", "center_role", "node", "n", "role"])

    return entries.repartition("key").sortWithinPartitions("key", "role", "doc_id").mapInArrow(walk, _LIST)


def _meets(a, b):
    """One of the two looked the key up, and the other is indexed under it."""
    return ((a != LOOKED_UP) & (b != INDEXED)) | ((b != LOOKED_UP) & (a != INDEXED))


def _near(scheme: Scheme, a, b):
    """Sizes that a link allows."""
    return scheme.whole * F.least(a, b) >= scheme.part * F.greatest(a, b)


def _may_link(scheme: Scheme, a, b, map_a, map_b):
    """Whether sizes and parity maps allow a link."""
    apart = F.bit_count(map_a[0].bitwiseXOR(map_b[0]))
    for i in range(1, MAP_WORDS):
        apart = apart + F.bit_count(map_a[i].bitwiseXOR(map_b[i]))
    return _near(scheme, a, b) & ((scheme.whole + scheme.part) * apart <= (scheme.whole - scheme.part) * (a + b))


def _verified(pairs: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The linked ones of pairs (u, v) of doc_ids, by their shingle sets."""
    pairs = written(pairs.distinct(), "pairs")
    involved = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    involved = written(involved, "nodes")
    few = involved.count() <= BROADCAST_ROWS
    texts = _ids(docs).join(F.broadcast(involved) if few else involved, F.col("doc_id") == F.col("node"), "left_semi")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in words.groups(batch.column("text"), GROUP):
                sets, first = shingle_sets(part, scheme.n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), pa.LargeListArray.from_arrays(first, sets.view(np.int64)).cast(pa.list_(pa.int64()))], ["node", "shingles"])

    sets = written(texts.mapInArrow(build, "node long, shingles array<long>"), "sets")
    left, right = sets.select(F.col("node").alias("u"), F.col("shingles").alias("s")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("t"))
    common = F.size(F.array_intersect("s", "t")).cast("long")
    both = pairs.join(left, "u").join(right, "v")
    linked = both.where(scheme.linked(common, F.size("s").cast("long"), F.size("t").cast("long"))).select("u", "v").distinct()
    return written(linked, "links")


def near_duplicates(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text).

    n_shingles is the size of the set of distinct shingles of words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Two documents
    are linked when their sets' Jaccard similarity reaches the scheme's threshold; component_id is the smallest doc_id
    that links reach. Null and empty texts, and texts of white space, have the empty set and no link. Rows that repeat a
    doc_id are one document to the links, each with its own n_shingles. A null doc_id is linked with nothing and has a
    null component. An empty table gives no rows; other columns are not looked at.
    """
    scheme = scheme or Scheme()
    bounded_batches(docs.sparkSession)
    infos = written(set_digests(docs, scheme), "sets-digested")
    classes = infos.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    placed = written(infos.where("n_shingles > 0 AND doc_id IS NOT NULL").join(classes, ["d1", "d2"]).select("doc_id", F.col("n_shingles").cast("int").alias("n_shingles"), "node", "map"), "placed")
    # Rows of one id may have different sets.
    by_id = placed.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w").select("doc_id", "v")
    same_id = placed.join(by_id, "doc_id").select(F.col("node").alias("u"), "v")

    lists = written(_lists(_entries(docs, scheme)), "lists")
    release(docs.sparkSession)
    sets_of = placed.select("doc_id", "node", "map").distinct()
    # Lists of empty segments count only where someone looked one up.
    empties = lists.where("role >= 10")
    used = empties.groupBy("key").agg(F.min(F.least("role", "center_role")).alias("best"), F.max(F.greatest("role", "center_role")).alias("last")).where(f"best = {BOTH + 10} OR last = {LOOKED_UP + 10}").select("key")
    lists = lists.where("role < 10").unionByName(empties.join(used, "key", "left_semi").withColumns({"role": (F.col("role") - 10).cast("byte"), "center_role": (F.col("center_role") - 10).cast("byte")}))

    star = lists.where(_meets(F.col("center_role"), F.col("role")) & _near(scheme, F.col("center_n"), F.col("n"))).select("center", "center_n", "node", "n").distinct()
    left, right = (sets_of.select(F.col("doc_id").alias(c), F.col("node").alias(v), F.col("map").alias(f"map_{v}")) for c, v in (("center", "u"), ("node", "v")))
    star = star.join(left, "center").join(right, "node").where(F.col("u") != F.col("v")).where(_may_link(scheme, F.col("center_n"), F.col("n"), F.col("map_u"), F.col("map_v")))
    star = written(star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "star")
    first = _verified(star, docs, scheme)
    labels = written(components(first.unionByName(same_id)), "labels")

    # Members of a list that the star has not joined: compare them across components.
    members = lists.select("key", F.col("node").alias("doc_id"), "n", "role").unionByName(lists.select("key", F.col("center").alias("doc_id"), F.col("center_n").alias("n"), F.col("center_role").alias("role")).distinct())
    node_of = placed.select("doc_id", "node").distinct()
    labelled = written(members.join(node_of, "doc_id").join(labels, "node", "left").select("key", "node", "n", "role", F.coalesce("root", "node").alias("root"), "doc_id").distinct(), "members")
    split = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low < high AND size > 2").select("key")
    rest = labelled.join(split, "key").join(sets_of.drop("node"), "doc_id").drop("doc_id")
    a, b = rest.alias("a"), rest.alias("b")
    allowed = _meets(F.col("a.role"), F.col("b.role")) & _may_link(scheme, F.col("a.n"), F.col("b.n"), F.col("a.map"), F.col("b.map"))
    crossing = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & allowed)
    crossing = crossing.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
    second = _verified(crossing.join(star, ["u", "v"], "left_anti"), docs, scheme)
    release(docs.sparkSession)
    roots = components(first.unionByName(second).unionByName(same_id))

    linked = placed.join(roots, "node", "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("root", "node").alias("component_id"))
    return linked.unionByName(infos.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS s FROM w, unnest(range(0, greatest(1, len(w) - 3))) AS r(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (
  SELECT doc_id, doc_id AS root FROM w UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id WHERE r.root < e.y
)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM w JOIN r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
