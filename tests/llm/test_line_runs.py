"""Runs of repeated lines against brute force: passages of every length in other surroundings, copies, repeated lines."""

import random

import pytest

from folioflow.llm import line_dedup


def brute(docs):
    """Kept lines by doc_id: a line of a pair of adjacent lines that stands earlier goes."""
    first = {}
    for d in sorted(docs):
        for i in range(len(docs[d]) - 1):
            first.setdefault(tuple(docs[d][i : i + 2]), (d, i))
    out = {}
    for d, lines in docs.items():
        gone = set()
        for i in range(len(lines) - 1):
            at = first[tuple(lines[i : i + 2])]
            if at != (d, i) and "".join(lines[i : i + 2]).strip():
                gone |= {i, i + 1} - ({at[1], at[1] + 1} if at[0] == d else set())
        out[d] = [x for i, x in enumerate(lines) if i not in gone]
    return out


def run(spark, docs):
    df = spark.createDataFrame([(d, "\n".join(x), len("\n".join(x))) for d, x in docs.items()], "doc_id long, text string, n_chars int").repartition(3)
    return {r.doc_id: (r.text, r.n_chars) for r in line_dedup.drop_repeated_chunks(df).collect()}


def test_passages_go_whole(spark):
    docs, number = {}, iter(range(10**6))
    own = lambda: [f"own line {next(number)}" for _ in range(5)]
    want = {}
    for n in range(2, 16):
        for _ in range(4):
            passage = [f"shared line {next(number)}" for _ in range(n)]
            d = len(docs)
            docs[d] = own() + passage + own()
            before, after = own(), own()
            docs[d + 1] = before + passage + after
            want[d], want[d + 1] = docs[d], before + after
    got = run(spark, docs)
    assert {d: t.split("\n") for d, (t, _) in got.items()} == want
    assert all(n == len(t) for t, n in got.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = {d: [rng.choice(["a", "b", "c", "", " ", "long line", "x", f"u{rng.randrange(60)}"]) for _ in range(rng.randint(1, 12))] for d in range(60)}
    docs |= {100: ["same"] * 7, 101: ["same"] * 3, 102: [f"copy {i}" for i in range(9)], 103: [f"copy {i}" for i in range(9)]}
    want = {d: "\n".join(x) for d, x in brute(docs).items() if "\n".join(x) or len(x) == len(docs[d])}
    assert {d: t for d, (t, _) in run(spark, docs).items()} == want and 103 not in want and want[100] == "same\nsame"


def test_shared_passages_are_cut_alike_and_long_runs_by_number(spark):
    passage = [f"shared line {i}" for i in range(60)]
    texts = {d: [f"own {d} {i}" for i in range(n)] + passage + [f"end {d}"] for d, n in ((1, 3), (2, 8), (3, 1))}
    chunks = {d: {tuple(x[a:b]) for a, b in line_dedup.cut_chunks([t.encode() for t in x])} for d, x in texts.items()}
    assert len(chunks[1] & chunks[2] & chunks[3]) > 8
    same = {4: ["same"] * 500 + ["tail"], 5: ["head"] + ["same"] * 300}
    assert max(b - a for a, b in line_dedup.cut_chunks([t.encode() for t in same[4]])) <= line_dedup.MOST_LINES
    docs = texts | same
    assert {d: t for d, (t, _) in run(spark, docs).items()} == {d: "\n".join(x) for d, x in brute(docs).items() if x}
