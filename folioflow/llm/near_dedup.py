"""Operator 5 in the pipeline: SimHash over five-word shingles, confirmed by exact similarity.

Two documents are linked if their sets of distinct shingles have a Jaccard similarity of ``LEAST`` or more.

1. A set's fingerprint is the SimHash of its shingles. The BK-trees of operator 5, in shards of two agreeing bands,
   find all fingerprints of ``RADIUS`` or fewer differing bits. What they connect is compared exactly; the links
   that stand unite documents to classes.
2. Fingerprints miss links, most of those near the limit. What is left is found exactly: under any order of shingles
   common to all documents, two such sets share one of their first m - ceil(LEAST m) + 1 (m is the set's size). A
   shingle that occurs once, as a merged count-min sketch (``sketch.py``) estimates, is in no other document and comes
   first: a document that has more of them than its prefix is long has no link at all, and of the others only the
   repeated shingles are kept, in place of the texts. These are counted exactly, and the rarest come first, so that what
   many documents share, like a passage or a license, brings together only those that hold little else. Only a
   shingle that documents of two classes send makes candidates, and within a class nothing is compared again.

A group of candidates has no size bound. Its sets are dealt to parts of about ``PART_SHINGLES``, and each two parts
meet in a task of their own, which gives a spanning forest of the links that it finds; the forests are joined by
connected components. A group of one part is compared in one task. In a task, a document is not compared again
with members of a component that it is already in.

Words are runs of bytes other than the six blanks, in ASCII lower case. Defined results: a text of fewer words
than a shingle is one shingle, and null, empty and blank texts are alike; equal sets are linked. One row of
each component stays: of the smallest doc_id (null first), then of the least hash of id and text; of equal rows
one stays. Other columns are returned unchanged, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release, release_after, row_key, small_batches, unused
from .components import components
from .simhash_dedup import near_links, set_fingerprint
from .sketch import Shape, dealt, may_repeat, repeat_marks
from .substring_dedup import text_groups, window_hashes

SHINGLE, LEAST = 5, 0.8
#: Bits in which fingerprints of candidates may differ.
RADIUS = 3
#: Shingles of the sets of a part of a large group.
PART_SHINGLES = 1_000_000


def prefix_size(n: int, least: float) -> int:
    """How many of a set's first shingles hold one that a set of such similarity shares."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def shingle_sets(texts: pa.ChunkedArray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, sorted hashes of the distinct shingles, where each first stands among all windows) of the texts that have any."""
    at = 0
    for first, w in text_groups(texts, width, True):
        names = w.names()
        cuts = np.flatnonzero(np.diff(w.row)) + 1
        for a, b in pairwise([0, *cuts.tolist(), len(names)] if len(names) else [0]):
            h, place = np.unique(names[a:b], return_index=True)
            yield int(w.row[a]) + first, h, place + a + at
        at += len(names)


def _short_digest(text: str | None) -> str:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return xxhash.xxh3_128_hexdigest(b" ".join(words), 1)


def linked(sets: list[np.ndarray], least: float, classes: np.ndarray | None = None, whole: np.ndarray | None = None) -> list[int]:
    """The least index of each set's component; sets are not empty, those of one class are linked from the start.

    A set may lack shingles that no other has; ``whole`` has the sizes with them. Sets come in order of size, and each is held against smaller ones that share a shingle of both prefixes and
    are not in its component yet: some of the latest first, which settles most members of a large component,
    then all that are left.
    """
    n = len(sets)
    if n < 2:
        return list(range(n))
    given = np.fromiter(map(len, sets), np.int64, n)
    order = np.argsort(given if whole is None else whole, kind="stable")
    given = given[order]
    sizes = given if whole is None else whole[order]
    offsets = np.concatenate([[0], np.cumsum(given)])
    _, token, counts = np.unique(np.concatenate([sets[i] for i in order.tolist()]), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    token, single = rank[token], int((counts == 1).sum())  # a shingle of one set links nothing
    owner = np.repeat(np.arange(n, dtype=np.int32), given)
    token = token[np.lexsort((token, owner))]
    heads = given - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1  # without those that the set lacks
    inside = (np.arange(len(token)) - offsets[owner] < heads[owner]) & (token >= single)
    head_token, head_owner = token[inside], owner[inside]
    bounds = np.searchsorted(head_owner, np.arange(n + 1)).tolist()
    # the owners of each prefix shingle in order of size, and where each prefix entry stands among them
    by_token = np.lexsort((head_owner, head_token))
    posting = head_owner[by_token]
    at = np.empty(len(by_token), np.int64)
    at[by_token] = np.arange(len(by_token))
    first = np.searchsorted(head_token[by_token], head_token)
    label = np.arange(n) if classes is None else np.unique(classes[order], return_inverse=True)[1]
    own, seen = np.zeros(len(counts), np.uint8), np.zeros(n, bool)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        """The others that are similar enough; ``own`` marks the shingles of i."""
        others = others[sizes[others] >= least * sizes[i] - 1e-9]
        if not len(others):
            return others
        starts = np.concatenate([[0], np.cumsum(given[others])])
        cells = np.arange(starts[-1]) + np.repeat(offsets[others] - starts[:-1], given[others])
        shared = np.add.reduceat(own[token[cells]], starts[:-1], dtype=np.int64)
        return others[shared >= least * (sizes[i] + sizes[others] - shared) - 1e-9]

    def join(i: int, others: np.ndarray) -> None:
        if not len(others):
            return
        labels = np.unique(np.append(label[others], label[i]))
        for x in labels[1:].tolist():
            label[label == x] = labels[0]

    for i in range(n):
        entries = [(f, a) for f, a in zip(first[bounds[i] : bounds[i + 1]].tolist(), at[bounds[i] : bounds[i + 1]].tolist(), strict=True) if a > f]
        if not entries:
            continue
        mine = token[offsets[i] : offsets[i + 1]]
        own[mine] = 1
        latest = np.unique(np.concatenate([posting[max(f, a - 4) : a] for f, a in entries]))
        seen[latest] = True
        join(i, near(i, latest))
        for f, a in entries:
            left = posting[f:a]
            left = left[~seen[left] & (label[left] != label[i])]
            seen[left] = True
            for k in range(0, len(left), 512):
                part = left[k : k + 512]
                join(i, near(i, part[label[part] != label[i]]))
        own[mine], seen[:] = 0, False
    least_of: dict[int, int] = {}
    for x, i in zip(label.tolist(), order.tolist(), strict=True):
        least_of[x] = min(i, least_of.get(x, i))
    out = [0] * n
    for x, i in zip(label.tolist(), order.tolist(), strict=True):
        out[i] = least_of[x]
    return out


def fingerprint_groups(nodes: DataFrame, radius: int) -> DataFrame:
    """a and root of the nodes (a, fp) whose fingerprints, in steps of so many bits, lead to another node's."""
    held = nodes.where("fp IS NOT NULL").select("a", "fp")
    roots = components(near_links(held.select("fp").distinct(), radius))
    placed = held.join(roots, F.col("fp") == F.col("node"), "left").select("a", F.coalesce("root", "fp").alias("root"))
    many = placed.groupBy(F.col("root").alias("of")).agg(F.count("*").alias("held")).where("held > 1")
    return placed.join(many, F.col("root") == F.col("of"), "left_semi")


def group_links(rows: pa.Table, least: float) -> pa.Table:
    """Spanning links (a, b) of a group, which has a, label, n and shingles; nodes of one label are linked already."""
    nodes, sets = rows.column("a").to_pylist(), rows.column("shingles").combine_chunks()
    bounds, values = sets.offsets.to_numpy(), sets.values.to_numpy()
    roots = linked([values[i:j] for i, j in pairwise(bounds)], least, rows.column("label").to_numpy(), rows.column("n").to_numpy())
    links = [(nodes[i], nodes[r]) for i, r in enumerate(roots) if r != i]
    release_after(rows)
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def confirmed_links(sets: DataFrame, names: tuple[str, str], members: DataFrame, *, least: float) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs of a group; members has a, label, n and root (its group).

    sets has the repeated shingles of the nodes; names are those of its columns of node and shingles.
    """
    parts = members.groupBy(F.col("root").alias("of")).agg(F.ceil(F.sum("n") / PART_SHINGLES).cast("int").alias("parts"))
    members = members.join(parts, F.col("root") == F.col("of")).select("a", "label", "n", "root", "parts")
    held = members.join(sets.select(F.col(names[0]).alias("of"), F.col(names[1]).alias("shingles")), F.col("a") == F.col("of")).drop("of")
    own = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("own"))
    meets = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.transform(others, lambda p: F.struct(F.least("own", p).alias("i"), F.greatest("own", p).alias("j"))))
    held = held.withColumn("own", own).select("root", "a", "label", "n", "shingles", F.explode(meets).alias("pair")).select("root", "pair.i", "pair.j", "a", "label", "n", "shingles")
    return held.groupBy("root", "i", "j").applyInArrow(lambda rows: group_links(rows, least), "a long, b long")


def rare_first(sets: DataFrame, least: float) -> DataFrame:
    """a and prefix of nodes (a, n, shingles): the first shingles of each in order of how many nodes have them, without those that one has."""
    spread = sets.select("a", "n", F.explode("shingles").alias("shingle"))
    counts = spread.groupBy(F.col("shingle").alias("of")).agg(F.count("*").alias("held")).where("held > 1")
    ranked = spread.join(counts, F.col("shingle") == F.col("of")).groupBy("a").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("ranked"))
    length = (F.size("ranked") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int")
    return ranked.withColumn("length", length).where("length > 0").select("a", F.slice("ranked", F.lit(1), F.col("length"))["shingle"].alias("prefix"))


def keep_dissimilar(docs: DataFrame, *, width: int = SHINGLE, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """One row of each component of documents whose shingles have a similarity of ``least``; of equal rows one."""
    size = small_batches(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shape = Shape.of(size, size // 6)
    key, block = unused(docs, "key"), unused(docs, "block")
    blocks = dealt(docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))), F.col(key), shape, block)

    def summaries(of: tuple, rows: pa.Table, marks: pa.Table) -> pa.Table:
        again = may_repeat(window_hashes(rows.column("text"), width, True), marks, shape)
        nodes: list[str | None] = [None] * rows.num_rows
        sets: list[np.ndarray | None] = [None] * rows.num_rows  # of documents that may have a link
        sizes = [0] * rows.num_rows
        prints: list[int | None] = [None] * rows.num_rows
        for row, h, place in shingle_sets(rows.column("text"), width):
            nodes[row], sizes[row] = xxhash.xxh3_128_hexdigest(h.tobytes()), len(h)
            prints[row] = set_fingerprint(h)
            own = again[place]
            if int((~own).sum()) < prefix_size(len(h), least):
                sets[row] = h[own].view(np.int64)
        texts = rows.column("text").to_pylist()
        nodes = [_short_digest(t) if n is None else n for n, t in zip(nodes, texts, strict=True)]
        release()
        return pa.table({"doc_id": rows.column("doc_id"), "key": rows.column(key), "block": rows.column(block), "node": pa.array(nodes, pa.string()), "n": pa.array(sizes, pa.int64()), "fp": pa.array(prints, pa.uint64()).view(pa.int64()), "shingles": pa.array(sets, pa.list_(pa.int64()))})

    marks = repeat_marks(blocks, block, shape, lambda rows: window_hashes(rows.column("text"), width, True))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = blocks.groupBy(block).cogroup(marks.groupBy("block")).applyInArrow(summaries, f"doc_id {id_type}, key string, block int, node string, n long, fp long, shingles array<long>")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "key", "block")).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "shingles")])
    # 64 bits name a candidate
    nodes = checkpointed(nodes.select(F.xxhash64("node").alias("a"), "first", "n", "fp", "shingles"))
    sets = nodes.where("size(shingles) > 0").select("a", "n", "fp", "shingles")

    near = fingerprint_groups(sets, radius).withColumnRenamed("a", "of")
    members = checkpointed(sets.join(near, F.col("a") == F.col("of")).select("a", F.col("a").alias("label"), "n", "root"))
    classes = components(confirmed_links(sets, ("a", "shingles"), members, least=least))

    # what fingerprints miss, between classes
    labelled = rare_first(sets, least).join(classes, F.col("a") == F.col("node"), "left").select("a", F.coalesce("root", "a").alias("label"), "prefix")
    sent = checkpointed(labelled.select("a", "label", F.explode("prefix").alias("shingle")))
    lowest = sent.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("most")).where("low <> most").select(F.col("shingle").alias("of"), "low")
    met = checkpointed(sent.join(lowest, F.col("shingle") == F.col("of")).select("a", "label", "low").distinct())
    groups = components(met.select(F.col("label").alias("a"), F.col("low").alias("b")))
    # a group's root is no node of the table of components
    groups = groups.select(F.col("root").alias("node"), "root").distinct().union(groups)
    rest = met.select(F.col("a").alias("of"), "label").distinct().join(groups, F.col("label") == F.col("node")).drop("node")
    members = checkpointed(sets.select("a", "n").join(rest, F.col("a") == F.col("of")).drop("of"))
    missed = confirmed_links(sets, ("a", "shingles"), members, least=least)
    linked_nodes = components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).union(missed))
    placed = nodes.join(linked_nodes, F.col("a") == F.col("node"), "left").select(F.coalesce("root", "a").alias("root"), "first")
    staying = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.block").alias("block"), F.col("first.key").alias("key"))

    def keep(rows: pa.Table, staying: pa.Table) -> pa.Table:
        left = set(staying.column("key").to_pylist())
        kept = []
        for row, k in enumerate(rows.column(key).to_pylist()):
            if k in left:
                left.remove(k)  # of equal rows one
                kept.append(row)
        return rows.drop_columns([key, block]).take(pa.array(kept, pa.int64()))

    return blocks.groupBy(block).cogroup(staying.groupBy("block")).applyInArrow(keep, docs.schema)
