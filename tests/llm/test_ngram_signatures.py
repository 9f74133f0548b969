"""Every linked pair of sets must meet under a key that one of the two looks up and the other is indexed under."""

import numpy as np
import pytest

from qaforge.llm.ngram_join import BOTH, INDEXED, LOOKED_UP, Scheme, shingle_sets, signatures


def meet(x, y):
    a, b = (dict(), dict())
    for own, out in ((x, a), (y, b)):
        keys, roles, empty = own
        for k, r in zip(keys, roles):
            for i, j in zip(k.tolist(), r.tolist()):
                out.setdefault(i, set()).add(j)
        for band, i, r in empty:
            out.setdefault(("empty", band, i), set()).add(r)
    for k in a.keys() & b.keys():
        for i in a[k]:
            for j in b[k]:
                if (i != LOOKED_UP and j != INDEXED) or (j != LOOKED_UP and i != INDEXED):
                    return True
    return False


@pytest.mark.parametrize("size", [1, 2, 3, 5, 6, 7, 8, 9, 12, 13, 19, 20, 27, 40, 64, 100, 177, 300, 1000, 3000])
def test_linked_pairs_meet(size):
    rng, scheme, tried = np.random.default_rng(size), Scheme(), 0
    for _ in range(400 if size < 500 else 40):
        base = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        limit = scheme.differ(size, int(size / 0.85)) + 1
        drop, add = rng.integers(0, limit + 1), rng.integers(0, limit + 1)
        other = np.unique(np.concatenate([rng.permutation(base)[int(drop) :], rng.integers(0, 1 << 64, int(add), dtype=np.uint64)]))
        common = len(np.intersect1d(base, other))
        if not len(other) or not 100 * common >= 85 * (len(base) + len(other) - common):
            continue
        tried += 1
        assert meet(signatures(base, scheme), signatures(other, scheme)), (len(base), len(other), common)
    assert tried


def test_shingles():
    import pyarrow as pa

    texts = ["a b c d e", "A b\tc\nd e", "", " \n", "a b c", "a b c d", "d c b a", "a a a a a a a", "é ü ß x y"]
    sets, first = shingle_sets(pa.array(texts), 4)
    parts = [sets[a:b].tolist() for a, b in zip(first[:-1], first[1:])]
    assert [len(p) for p in parts] == [2, 2, 0, 0, 1, 1, 1, 1, 2]
    assert parts[0] == parts[1] and parts[5][0] in parts[0] and parts[4] != parts[5] and parts[6] != parts[5]
