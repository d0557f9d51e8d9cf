"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random

import pytest

import corpus_pipeline
from folioflow.llm import near_dedup, simhash_dedup


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    """Ids of the rows that stay; rows are in order of their ids."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return {rows[g][0] for g in group}


def edited_rows():
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 300))]
        for _ in range(8):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            rows.append((len(rows), " ".join(own).upper() if rng.random() < 0.2 else "  ".join(own)))
            words = own if base % 2 else words
    common = " ".join(f"c{i}" for i in range(30))
    rows += [(200 + i, common + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60)))) for i in range(20)]
    return rows + [(300, None), (301, ""), (302, " \n"), (303, "A b"), (304, "a B"), (305, "one two three four")]


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "extra", "own", 1) for i, t in rows], "doc_id long, text string, source string, key string, block int").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("key = 'own' AND block = 1").count() == kept.count()
    return sorted(r.doc_id for r in kept.collect())


@pytest.mark.parametrize("part", [near_dedup.PART_SHINGLES, 900])
def test_a_few_changed_words(spark, monkeypatch, part):
    """In groups of one part and of many."""
    monkeypatch.setattr(near_dedup, "PART_SHINGLES", part)
    rows = edited_rows()
    want = brute(rows)
    assert stage(spark, rows) == sorted(want) and len(want) < len(rows) - 40


def test_fingerprints_come_first(spark, monkeypatch):
    """Near copies are in groups of fingerprints; their links are confirmed, and the rest is between classes only."""
    groups, classes = [], []
    find, confirm = near_dedup.fingerprint_groups, near_dedup.confirmed_links

    def found(nodes, radius):
        groups.append((radius, {(r.a, r.root) for r in find(nodes, radius).collect()}))
        return find(nodes, radius)

    def confirmed(blocks, names, members, **limits):
        classes.append({(r.a, r.label) for r in members.collect()})
        return confirm(blocks, names, members, **limits)

    monkeypatch.setattr(near_dedup, "fingerprint_groups", found)
    monkeypatch.setattr(near_dedup, "confirmed_links", confirmed)
    rng = random.Random(3)
    rows = []
    for base in range(5):
        words = [f"b{base}w{i}" for i in range(4000)]
        for _ in range(4):
            words[rng.randrange(4000)] = "other"
            rows.append((len(rows), " ".join(words)))
    # similar enough, but not by fingerprint
    rows += [(100, " ".join(f"q{i}" for i in range(104))), (101, " ".join(f"q{i}" for i in range(11, 115)))]
    assert stage(spark, rows) == [0, 4, 8, 12, 16, 100] == sorted(brute(rows))
    (radius, near), (first, rest) = groups[0], classes
    assert radius == 3 and len(near) == len(first) == 20 and len({root for _, root in near}) == 5
    assert len(rest) == len({label for _, label in rest}) == 2


def test_set_fingerprints():
    import numpy as np

    rng = np.random.default_rng(6)
    for n in (1, 2, 255, 256, 600):
        h = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        h[: n // 2] |= np.uint64(0xF0)
        assert near_dedup.set_fingerprint(h) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)


def test_fingerprint_links(spark):
    """Of three bits, against all pairs."""
    rng = random.Random(11)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values):
        for _ in range(3):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                v ^= 1 << bit
            values.add(v)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)

    def classes(links):
        group = {v: v for v in values}
        for a, b in links:
            least, most = sorted((group[a], group[b]))
            group = {v: least if g == most else g for v, g in group.items()}
        return group

    links = [tuple(r) for r in simhash_dedup.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), 3).collect()]
    want = classes([(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    assert classes(links) == want and 60 < len(set(want.values())) < len(values)


def test_repeated_rows_and_no_rows(spark):
    assert stage(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other"), (2, "other")]) == [1, 1]
    assert stage(spark, []) == []


def test_linked_over_a_chain():
    import numpy as np

    sets = [np.arange(i * 5, i * 5 + 100) for i in range(40)] + [np.arange(9000, 9050)]
    assert near_dedup.linked(sets, 0.8) == [0] * 40 + [40]


def test_the_small_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, small).collect()]
    assert sorted(kept) == sorted(brute(rows))


def test_a_common_passage_brings_no_groups_together(spark, monkeypatch):
    """Rare shingles come first: texts that share a passage, but not most of it, are not compared."""
    sizes, confirm = [], near_dedup.confirmed_links

    def confirmed(blocks, names, members, **limits):
        sizes.append([r["count"] for r in members.groupBy("root").count().collect()])
        return confirm(blocks, names, members, **limits)

    monkeypatch.setattr(near_dedup, "confirmed_links", confirmed)
    common = [f"c{i}" for i in range(40)]
    rows = []
    for pair in range(12):
        own = [f"p{pair}w{i}" for i in range(60)]
        rows += [(len(rows), " ".join(common + own)), (len(rows) + 1, " ".join(common + own[:-1] + ["end"]))]
    assert stage(spark, rows) == sorted(brute(rows)) == list(range(0, 24, 2))
    assert all(n <= 2 for group in sizes for n in group)


def test_sets_without_their_own_shingles():
    """Shingles that one set alone has count by their number."""
    import numpy as np

    sets = [np.arange(80), np.arange(80), np.arange(1000, 1080), np.arange(1000, 1080)]
    assert near_dedup.linked(sets, 0.8, None, np.array([90, 90, 91, 90])) == [0, 0, 2, 3]


def test_steps_leave_no_shuffles(spark):
    """What a step shuffled is removed once its rows are written, not when the driver collects its garbage."""
    import time

    from folioflow.llm.common import checkpointed

    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")
    before = held()
    rows = checkpointed(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    deadline = time.time() + 20
    while held() > before and time.time() < deadline:
        time.sleep(0.1)
    assert held() <= before and rows.count() == 7
