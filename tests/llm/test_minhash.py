"""b-bit MinHash against exact similarity of all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import common, minhash_dedup
from folioflow.llm.queries import op11_minhash_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w)


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    out = [(d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    return [(*r, r[0] == r[2]) for r in out]


def rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    out = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 6, 30, 80]))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append((len(out) + 10 * group, " ".join(copy)))
    # a chain: neighbours are alike, its ends are not
    chain = [rng.choice(words) for _ in range(60)]
    for k in range(40):
        out.append((1000 - k, "\n".join([*chain[k:], *[f"new{j}" for j in range(k)]])))
    # exactly 0.8, and just below
    out += [(2000, "a b c d e f"), (2001, "A  B\tC d E"), (2002, "p q r s t"), (2003, "p q r s"), (2004, "t p q r")]
    out += [(3000, None), (3001, ""), (3002, " \n "), (3003, "alone"), (3004, "ALONE"), (3005, "Élan vital"), (3006, "élan vital"), (None, "a b c d e f"), (None, None), (None, "nobody else"), (None, "nobody else")]
    out += [(2000, "a b c d e f"), (2000, "another text of the same id"), (4000, "long " * 30_000), (4001, "long " * 20_000), (4002, " ".join(map(str, range(20_000)))), (4003, " ".join(map(str, range(21_000))))]
    return out + out[:3]


def frame(spark, data):
    return spark.createDataFrame([(d, t, "a", 1, 2, 3, "b") for d, t in data], "doc_id long, text string, node string, id int, n int, root int, key string").repartition(3)


def ordered(found):
    return sorted(found, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("sizes", [(2_000, 4_000, 1_000_000, 32, 1 << 29), (4, 5, 200, 2, 1 << 29), (1, 3, 100, 0, 0)])
def test_components_are_exact(spark, monkeypatch, sizes):
    for name, value in zip(("BUCKET", "PART_NODES", "PART_SHINGLES", "LEADERS", "BITMAP_BITS"), sizes, strict=True):
        monkeypatch.setattr(minhash_dedup, name, value)
    data = rows()
    got = [tuple(r) for r in minhash_dedup.near_duplicates(frame(spark, data)).collect()]
    # a null row alone is kept: its component has no id, and it is the only one of it
    want = [(*r[:3], r[3] or (r[0] is None and r[2] is None)) for r in brute(data)]
    assert ordered(got) == ordered(want)


@pytest.mark.parametrize("bits", [1 << 29, 0])
def test_intersections(monkeypatch, bits):
    monkeypatch.setattr(minhash_dedup, "BITMAP_BITS", bits)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 120, n).astype(np.uint64)) for n in (1, 3, 50, 80, 80, 100, 7)] + [np.array([500], np.uint64), np.array([600, 601], np.uint64)] * 2 + [np.array([900], np.uint64)]
    shared = minhash_dedup._Shared(sets)
    assert (shared.bits is not None) == bool(bits)
    for i in range(len(sets)):
        others = np.array([j for j in range(len(sets)) if j != i])
        assert shared.sizes_with(i, others).tolist() == [len(set(sets[i]) & set(sets[j])) for j in others]


def test_small_groups_do_not_collect_garbage(monkeypatch):
    """Thousands of small groups are in a task, and a collection takes far longer than one of them."""
    collected = []
    monkeypatch.setattr(common, "release", lambda: collected.append(1))

    def links(n):
        rng = np.random.default_rng(4)
        base = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        sets = [base, base[: len(base) * 9 // 10], base[: len(base) // 2]]
        low = [minhash_dedup.low_bits(minhash_dedup.minima(s)) for s in sets]
        rows = pa.table({"a": [5, 6, 7, 5], "label": [5, 6, 7, 5], "low": [*low, low[0]], "hashes": [*map(np.ndarray.tobytes, sets), sets[0].tobytes()]})
        return minhash_dedup.group_links(rows, 80).to_pylist()

    assert links(1_000) == [{"a": 6, "b": 5}] and not collected
    assert links(300_000) == [{"a": 6, "b": 5}] and collected


def test_empty_table(spark):
    assert minhash_dedup.near_duplicates(frame(spark, rows()).limit(0)).count() == 0


def test_bands_and_estimates_follow_theory():
    """Pairs of similarity 0.8: bands agree as often as 0.8**5, estimates stay well above the cut."""
    rng = np.random.default_rng(9)
    agree, found = [], []
    for _ in range(300):
        names = rng.integers(0, 1 << 64, 110, dtype=np.uint64)
        # 88 of 110 in common
        one, two = (np.concatenate([names[:88], names[88 + 11 * k : 99 + 11 * k]]) for k in range(2))
        a, b = minhash_dedup.minima(one), minhash_dedup.minima(two)
        agree.append((minhash_dedup.band_keys(a) == minhash_dedup.band_keys(b)).sum())
        planes = minhash_dedup._planes([minhash_dedup.low_bits(a), minhash_dedup.low_bits(b)])
        found.append(minhash_dedup.similarity(planes[0], planes[1:])[0])
    # mean of 64 * 0.8**5 = 21
    assert 20 < np.mean(agree) < 22 and min(agree) > 3 and np.std(agree) < 5
    assert abs(np.mean(found) - 0.8) < 0.01 and min(found) > 0.68


def test_query_equals_its_sql(spark, small, oracle):
    cursor = oracle.execute(minhash_dedup.ORACLE)
    names = [c[0] for c in cursor.description]
    got = op11_minhash_dedup(spark, small)
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == sorted(cursor.fetchall())
