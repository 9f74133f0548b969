"""SimHash, the filter audit and clustering against brute force, with odd rows."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from qaforge.llm import clustering, filter_audit, simhash

DOCS = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_fingerprint(text, n=4):
    w = words_of((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)][: len(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(rows, distance=4):
    """(id, fingerprint, component) of rows (id, text); rows of one id are linked."""
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance or rows[a][0] is not None and rows[a][0] == rows[b][0]:
                parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def near_rows():
    rng = random.Random(5)
    vocabulary, rows, doc = [f"w{i}" for i in range(300)], [], 10
    for size, copies in ((3, 20), (40, 60), (120, 1), (120, 30), (200, 40), (5, 8)):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((doc, " ".join(w) if rng.random() < 0.8 else "  ".join(w).upper() + "\n"))
            doc += 1
    odd = [(1, ""), (2, None), (3, "  \t"), (None, rows[5][1]), (4, "a"), (4, "b c"), (4, "d é f"), (None, "x y z"), (None, None), (5, "É " + "lang " * 30000), (9, rows[0][1])]
    return rows + odd + rows[:3]


@pytest.mark.parametrize("longest", [256, 3])
def test_simhash_components(spark, longest):
    """Short lists in tasks, and long ones by centres, longer chains and half-way points, give the same."""
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in rows], "doc_id long, text string, fp long, box string")
    got = simhash.near_duplicates(docs, longest=longest).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == plain_near(rows)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_fingerprints():
    for text in ("", "a", "a b  C", "Ab c d e", "é ü\x0bß x\x0c y z ", " ".join(f"w{i % 700}" for i in range(40000))):
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("distance", [1, 2, 4, 6])
def test_ring_loses_no_pair(distance):
    """Each pair within the distance meets under a key of a chain that is viable for it, at each length."""
    rng, ring = random.Random(distance), simhash.Ring(distance)
    for _ in range(60):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, distance)):
            b ^= 1 << bit
        pair = np.array([a, b], np.uint64)
        viable = [i for i in range(ring.boxes) if ring.viable(pair[:1] ^ pair[1:], np.array([i]))[0]]
        assert viable
        for length in ring.lengths:
            if length == ring.boxes and distance > 4:
                continue  # very many keys
            for box in viable:
                key, row = ring.keys(pair, box, length)
                assert set(key[row == 0].tolist()) & set(key[row == 1].tolist()), (length, box)
    far = np.array([0, (1 << distance + 1) - 1], np.uint64)
    assert not any(ring.viable(far[:1] ^ far[1:], np.array([i]))[0] for i in range(ring.boxes))
    with pytest.raises(ValueError):
        simhash.Ring(9)


def plain_audit(rows, labels):
    """rows: (id, text, lang); labels: (id, quality, toxic)."""
    least, good, toxic = {}, set(), set()
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    for d, q, x in labels:
        good |= {d} if q == 1 else set()
        toxic |= {d} if x == 1 else set()
    docs = []
    for d, t, lang in rows:
        t = t or ""
        w = words_of(t)
        fails = {f for f, bad in (("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)), ("D", bool(re.search("[#$%&*|]", t))), ("E", d is not None and d > least[t])) if bad}
        docs.append((lang or "", fails, d is not None and d in good, d is not None and d in toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            everything = list(left)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in d[1] for d in everything)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in everything), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    rng, rows = random.Random(3), []
    for i in range(150):
        n = rng.choice([0, 3, 99, 100, 101, 130, 300])
        w = [f"w{rng.randrange(rng.choice([40, 5000]))}" for _ in range(n)]
        text = " ".join(x.upper() if rng.random() < 0.3 else x for x in w) + rng.choice(["", "", " #", "|", "é" * 30])
        rows.append((i, text, rng.choice(["en", "fr", None, ""])))
    rows += [(rng.randrange(400, 500), rng.choice(rows)[1], rng.choice(["en", "de"])) for _ in range(60)]
    rows += [rows[3], (None, rows[3][1], "en"), (None, None, "en"), (501, None, "en"), (502, "", "en"), (503, "long " * 300000 + "|", "xx"), (503, "A" * 50, "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 520, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return rows, labels


def test_audit(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], DOCS + ", fails int, part string")
    got = filter_audit.audit(docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in got} == plain_audit(rows, labels)


def test_audit_of_many_parts_and_of_none(spark, monkeypatch):
    rows = [(i, f"text {i % 50}", f"l{i % 90}") for i in range(200)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark.createDataFrame(rows, DOCS).coalesce(1), labels).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in got} == plain_audit(rows, [])
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).collect() == []


def test_words_of_long_texts():
    rng = random.Random(1)
    text = "".join(rng.choice(["a", "b", "cd ", "e\n", " ", "é"]) for _ in range(3_000_000)).encode()
    pieces = list(filter_audit._pieces(text))
    assert b"".join(pieces) == text and len(pieces) > 1
    assert [w for p in pieces for w in p.split()] == text.split()


def plain_clusters(rows, k=8, rounds=10, width=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x * 1024.0) for x in v):
            kept.append((i, [int(np.floor(x * 1024.0)) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [nearest(v) for _, v in kept]
    top = (1 << 63) - 1
    inertia = [sum(d for d, n in found if n == c) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, min(d, top), min(inertia[n], top), min(sum(inertia), top), names[n]) for (i, _), (d, n) in zip(kept, found)), key=str)


VECTORS = "vec_id long, embedding array<double>"


def vector_rows(width=64, n=300):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.7) for c in centres[i % 6]]) for i in range(n)]
    bad = [None, [], [0.0] * (width - 1), [0.0] * (width + 1), [None] + [0.0] * (width - 1), [float("nan")] + [0.0] * (width - 1), [float("inf")] * width, [1.7e308] * width]
    rows += [(1000 + i, v) for i, v in enumerate(bad)]
    return rows + rows[:5] + [(3, [0.0] * width), (None, [0.5] * width)]


def collected(found):
    return sorted((tuple(r) for r in found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_clusters(spark):
    rows = vector_rows()
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS + ", cluster int, v string")
    assert collected(clustering.clusters(vectors.repartition(4))) == plain_clusters(rows)


def test_clusters_of_integers_of_any_size(spark):
    """Components beyond 64 bits, ties, and empty clusters."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 1.0, -1.0]) * rng.choice([1, 1, 1, 2.0**18, 1e300, 3e17]) for _ in range(4)]) for i in range(60)] + [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(20)]
    vectors = spark.createDataFrame(rows, VECTORS)
    assert collected(clustering.clusters(vectors, k=5, rounds=4, width=4)) == plain_clusters(rows, 5, 4, 4)


def test_clusters_of_few_or_no_vectors(spark):
    for rows in ([(1, [0.25] * 64)], [(1, [0.25] * 64)] * 20, []):
        assert collected(clustering.clusters(spark.createDataFrame(rows, VECTORS))) == plain_clusters(rows)
    floats = spark.createDataFrame(vector_rows(n=40), VECTORS).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert collected(clustering.clusters(floats)) == plain_clusters([tuple(r) for r in floats.collect()])


def test_sort_means_agrees_with_all_distances():
    rng = np.random.default_rng(4)
    rows = rng.integers(-3, 4, (500, 3))
    centroids = rng.integers(-3, 4, (9, 3)).tolist()
    means = clustering.SortMeans(centroids)
    distances = ((rows[:, None, :] - np.array(centroids)) ** 2).sum(axis=2)
    for began in (np.zeros(500, np.int64), rng.integers(0, 9, 500)):
        cluster, distance, rest = means.nearest(rows, began)
        assert not len(rest) and (cluster == distances.argmin(axis=1)).all() and (distance == distances.min(axis=1)).all()
    assert all(means.nearest_of(r, 3) == (int(d.argmin()), int(d.min())) for r, d in zip(rows.tolist(), distances))


def test_task_sums_are_digits():
    for value in (0, 1, -1, (1 << 40) - 1, 1 << 40, -(10**50), 10**300):
        assert sum(x << 40 * d for d, x in clustering._digits(value)) == value
    assert pa.array([x for _, x in clustering._digits(10**300)], pa.int64())
