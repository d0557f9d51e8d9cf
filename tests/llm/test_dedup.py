"""Operators that compare documents, against brute force over small tables with copies, near copies, ties, nulls and repeated rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from folioflow.llm import decontamination, line_dedup, simhash_dedup, substring_dedup, suffix_dedup
from folioflow.llm.components import components
from folioflow.llm.queries import op1_suffix_dedup, op4_line_dedup, op5_simhash_dedup, op9_substring_dedup

WORD = r"[^\x20\x09-\x0D]+"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, places string")


def byte_rows():
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh é") for _ in range(3000))

    def edited():
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        a = rng.randrange(0, 1500)
        return "".join(t)[a : a + rng.randint(300, 1500)]

    rows = [(100 + i, edited()) for i in range(30)]
    rows += [(200, None), (201, ""), (202, "a" * 1500), (203, "abc" * 400), (204, "é" * 200), (205, "x" * 399), (206, base[:500] + base[:500]), (None, base[:700]), (207, "q" * 10 + base[100:499]), (208, "q" * 10 + base[100:500] + "r")]
    return rows + rows[:4]


def brute_bytes(rows):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + 400] for i in range(len(b) - 399))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                m[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, f in zip(b, m, strict=True) if not f)
        out.append((d or -1, len(b), sum(m), sum(f and (not i or not m[i - 1]) for i, f in enumerate(m)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1, 128])
def test_repeated_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = byte_rows()
    got = suffix_dedup.remove_repeated_bytes(table(spark, rows).repartition(3)).collect()
    assert sorted((r[0] or -1, *r[1:5]) for r in got) == brute_bytes(rows)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_long_texts_are_hashed_in_segments(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    for a, b in zip(whole, suffix_dedup.anchors(data), strict=True):
        assert (a == b).all()


def test_maximal_repeats_list_all_occurrences():
    contexts = [(b"zab", b"cdefX"), (b"yab", b"cdefY"), (b"ab", b"cdZ"), (b"q", b"cdefX")]
    groups = {(left, right, tuple(sorted(m))) for left, right, m in suffix_dedup.maximal_repeats(contexts, 4)}
    # "abcdef" has no longer common neighbours; "cdef" is in three, "cdefX" in two
    assert (0, 5, (0, 3)) in groups and (0, 4, (0, 1, 3)) in groups
    assert all(left + right >= 4 for left, right, _ in groups)


def word_rows():
    rng = random.Random(2)
    rows = [(1000 + i, " ".join(rng.choice(["a", "b", "cc", "d"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, "é " * 40), (2004, "x\t" + "é  " * 30 + "é " * 30), (2005, "one " * 12)]
    return rows + rows[:20]


def test_repeated_windows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HASH_BYTES", 1500)
    rows = word_rows()
    first = {}
    for d, t in rows:
        w = re.findall(WORD, t or "")
        for i in range(len(w) - 12):
            first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), 1 << 60), d)
    want = []
    for d, t in rows:
        w = re.findall(WORD, t or "")
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = [tuple(r) for r in substring_dedup.remove_repeats(table(spark, rows).repartition(4)).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 0


def test_windows_that_weak_hashes_confuse_stay(spark):
    """A polynomial modulo 2**64 gives the Thue-Morse string over two letters and its complement one value, whatever its base."""
    morse = "".join("ab"[i.bit_count() & 1] for i in range(4096))
    other = morse.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join([*[f"w{k}" for k in range(6)], "z" + t, *[f"v{k}" for k in range(6)]])) for i, t in enumerate([morse, other, morse])]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(table(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 13}


def test_a_window_of_very_many_documents(spark):
    """A third of all rows share a passage, over several blocks, buckets and partitions."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"own{i} " + (passage if i % 3 == 0 else f"x{i} " * 20)) for i in range(900)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(table(spark, rows).repartition(7)).collect()}
    assert got == {i: 20 * (i % 3 == 0 and i > 0) + 0 for i in range(900)}


def fingerprint(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    w = regex.findall(WORD, t)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(nodes, linked):
    parent = {v: v for v in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in nodes}


def test_bk_tree_forest():
    rng = random.Random(3)
    values = {0}
    for b in [rng.getrandbits(64) for _ in range(10)]:
        for _ in range(30):
            v = b
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    forest = set(simhash_dedup.shard_forest(list(values), 2))
    want = joined(values, lambda a, b: (a ^ b).bit_count() <= 2)
    assert joined(values, lambda a, b: (a, b) in forest or (b, a) in forest) == want


@pytest.mark.parametrize("shard", [simhash_dedup.SHARD, 3])
def test_near_duplicates(spark, monkeypatch, shard):
    """With whole shards, and with shards cut into many blocks."""
    monkeypatch.setattr(simhash_dedup, "SHARD", shard)
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (3, long + " tail"), (9, long.upper()), (7, None), (8, ""), (6, " \n"), (4, "A b"), (2, "a B"), (10, "é x y z é x"), (3, long + " tail")]
    fp = {(d, t): fingerprint(t) for d, t in rows}
    ids = {}
    for (d, _), f in fp.items():
        ids[d] = f
    want = joined(list(ids), lambda a, b: (ids[a] ^ ids[b]).bit_count() <= 2)
    got = simhash_dedup.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.fingerprint == format(ids[r.doc_id], "016x") and r.component_id == want[r.doc_id] for r in got)
    kept = simhash_dedup.keep_one_of_each(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "places"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash_dedup.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_a_shard_that_very_many_fingerprints_share(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "SHARD", 50)
    rng = random.Random(4)
    # two bands alike for all, so every fingerprint is in one shard
    fps = sorted({rng.getrandbits(32) & 0x3F3F for _ in range(900)} | {(1 << 40) + 3})
    links = [(r.a, r.b) for r in simhash_dedup.near_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {f: root(f) for f in fps} == joined(fps, lambda a, b: (a ^ b).bit_count() <= 2)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def line_rows():
    rows = [(9000 + i, "\n".join(f"line {j} of {i // 2}" for j in range(i, 30 + i))) for i in range(12)]
    rows += [(9500, None), (9501, ""), (9502, "\n" * 7), (9503, "\n" * 7), (9504, "only one line"), (9505, "only one line")]
    return rows + rows[:3]


def test_repeated_chunks(spark):
    rows = line_rows()
    places = {}
    for d, t in rows:
        for n, _, _, body in line_dedup._multi(line_dedup._lines(t)):
            places.setdefault(body, []).append((d, n))
    want = []
    for d, t in rows:
        gone = [n for n, _, _, body in line_dedup._multi(line_dedup._lines(t)) if (d, n) != min(places[body])]
        kept, lines, removed = line_dedup.kept_lines(t, gone)
        want.append((d, lines, removed, len(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in line_dedup.repeated_chunks(table(spark, rows).repartition(3), keep_text=False).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 0
    out = line_dedup.drop_repeated_chunks(table(spark, rows).withColumn("__key", F.lit("own")).withColumn("block", F.lit(1)).withColumn("tag", F.lit(None).cast("date")))
    assert out.where("__key = 'own' AND block = 1 AND tag IS NULL").count() == out.count()
    out = out.drop("__key", "block", "tag")
    assert out.columns == ["doc_id", "text", "places"] and out.where("doc_id IN (9500, 9501)").count() == 2


def test_boundaries_resist_shifts():
    lines = [f"line {i}".encode() for i in range(200)]
    chunks = lambda x: {b"\n".join(x[a:b]) for a, b in line_dedup.cut_chunks(x)}
    assert len(chunks(lines) - chunks([b"new", *lines[:50], b"other", *lines[50:]])) <= 4
    assert b"\n".join(b"\n".join(lines[a:b]) for a, b in line_dedup.cut_chunks(lines)) == b"\n".join(lines)


def test_contained_items(spark):
    item = " ".join(f"Word{i}" for i in range(40))
    hidden = " ".join(f"x{i}" for i in range(5000)) + ", " + item.upper() + "! " + " ".join(f"y{i}" for i in range(5000))
    partly = " ".join(item.split()[:37]) + " tail"
    half = " ".join(item.split()[:20])
    docs = table(spark, [(1, hidden), (2, partly), (3, half), (4, None), (5, ""), (None, item), (1, "other text")])
    bench = spark.createDataFrame([(7, item), (8, "two words"), (9, None), (10, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared) for r in decontamination.contained_items(docs, bench).collect()}
    assert got == {(d, i, n) for i in (7, 10) for d, n in ((1, 36), (2, 33), (None, 36))}
    kept = decontamination.drop_contaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and kept.columns == docs.columns
    assert decontamination.contained_items(docs, bench.limit(0)).count() == 0 and decontamination.contained_items(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("query", [op1_suffix_dedup, op4_line_dedup, op5_simhash_dedup, op9_substring_dedup])
def test_queries_return_every_document(spark, small, query):
    df = query(spark, small)
    assert df.select("doc_id").distinct().count() == df.count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_op1_over_the_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1_suffix_dedup(spark, small).collect())
    assert got == brute_bytes(rows)
