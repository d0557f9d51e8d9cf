"""Operator 5: near-duplicates by SimHash fingerprints and BK-trees.

Distinct fingerprints are dealt to shards by two of their four 16-bit bands: two fingerprints that differ
in at most two bits agree in two bands at least, so every link lies inside a shard. A shard's BK-tree keys
the children of a node by their Hamming distance to it, and a search follows only the edges within the
radius. A shard of more than ``SHARD`` fingerprints is cut into blocks by hash; the tree of each block is sent
to every later block of its shard, which searches it, so that no task holds more than two blocks however many
fingerprints agree. Trees are not broadcast to all tasks: all together have no size bound. A shard gives a spanning forest of its links, never all pairs, and the forests are joined
by connected components over fingerprints. Copies share a fingerprint and are one node.

Defined results: a null text, an empty one, or one without a word has fingerprint zero and is linked like
any other; fewer words than a shingle has are one shingle; component_id is the smallest doc_id of the
component, and null only if all its ids are; repeated rows are returned each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, row_key, small_batches, unused
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Shingles whose bits are counted at once, and fingerprints of a block of a shard.
BLOCK, SHARD = 50_000, 20_000

_lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """64 bits of a text; bytes.split() parts words at just the six blanks of the contract."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_lower).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    stops = (starts + sizes)[SHINGLE - 1 :].tolist()
    starts = starts.tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(stops), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:], stops[at : at + BLOCK])], "<u8")  # noqa: B905
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(stops), bitorder="little").view("<u8")[0])


def set_fingerprint(hashes: np.ndarray) -> int:
    """64 bits of a set that is given by 64-bit hashes: one if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[at : at + BLOCK], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        # eight counts to a word, each of 255 hashes at most
        ones += np.add.reduceat(bits, np.arange(0, len(part), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Integers under Hamming distance; a child's key is its distance to its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[at] ^ value).bit_count()
            child = self.children[at].setdefault(d, new)
            if child == new:
                return
            at = child

    def near(self, value: int, radius: int) -> list[int]:
        """Places of the values within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


def shard_forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning links (value, least value of its tree) among distinct unsigned values."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values = sorted(values)
    for i, v in enumerate(values):
        for j in tree.near(v, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, values[r]) for i, v in enumerate(values) if (r := root(i)) != i]


def fingerprints(docs: DataFrame, *, key: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and key (from the column of that name, if one is given) of each row."""
    names = ["doc_id", "fp", "key"] if key else ["doc_id", "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), *batch.columns[2:]], names=names)

    read = ["doc_id", "text", key] if key else ["doc_id", "text"]
    return small_batches(docs).select(*read).mapInArrow(run, "doc_id long, fp long" + ", key string" * bool(key))


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints within the radius.

    There are two bands more than bits that may differ, four at least, so that two bands are sure to agree.
    """
    bands = max(4, radius + 2)
    cuts = [64 * k // bands for k in range(bands + 1)]
    band = lambda k: F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << cuts[k + 1] - cuts[k]) - 1).cast("long"))
    pairs = [(i, j) for i in range(bands) for j in range(i + 1, bands)]
    keys = F.array(*[F.lit(n << 32).cast("long").bitwiseOR(F.shiftleft(band(i), 16)).bitwiseOR(band(j)) for n, (i, j) in enumerate(pairs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_keys, open_fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def closed(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.diff(keys)) + 1
            bounds = np.concatenate([[0], cuts, [len(keys)]])
            links: list[tuple[int, int]] = []
            for k in np.flatnonzero(np.diff(bounds) > 1):
                links += shard_forest(fps[bounds[k] : bounds[k + 1]].view(np.uint64).tolist(), radius)
            table = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([open_keys, batch.column(0).to_numpy()])
            fps = np.concatenate([open_fps, batch.column(1).to_numpy()])
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                yield closed(keys[:last], fps[:last])
            open_keys, open_fps = keys[last:], fps[last:]
        if len(open_keys):
            yield closed(open_keys, open_fps)

    sharded = fps.select(F.explode(keys).alias("key"), "fp")
    # a shard is cut where it is large; two blocks meet in a task, whose key is made of the shard's and theirs
    large = sharded.groupBy("key").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("blocks")).where("blocks > 1").withColumnRenamed("key", "of")
    cut = sharded.join(large, F.col("key") == F.col("of"), "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own"))
    meets = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(F.transform(others, lambda b: F.xxhash64("key", F.least("own", b), F.greatest("own", b))))
    dealt = cut.select(F.explode(meets).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def _placed(nodes: DataFrame, radius: int) -> DataFrame:
    """nodes (fp and first) with the least fingerprint of their component as root."""
    roots = components(near_links(nodes.select("fp"), radius))
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def link_documents(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of each row."""
    rows = checkpointed(fingerprints(docs))
    placed = checkpointed(_placed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), radius))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "of")
    named = placed.join(least, F.col("root") == F.col("of")).select(F.col("fp").alias("own"), "component_id")
    return rows.join(named, F.col("fp") == F.col("own")).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    return link_documents(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """One row of each component: of the smallest doc_id, then of the least hash of id and text; of equal rows one."""
    key = unused(docs, "key")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    rows = checkpointed(fingerprints(keyed, key=key))
    placed = _placed(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("first")), radius)
    staying = placed.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("staying"))
    kept = keyed.join(staying, keyed[key] == staying["staying"], "left_semi")
    return kept.dropDuplicates([key]).drop(key)
