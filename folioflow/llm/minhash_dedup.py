"""Operator 11: near-duplicates by b-bit MinHash.

A document's set of distinct 2-word shingles gives ``BANDS * DEPTH`` minima. ``DEPTH`` minima make the key of a
band; of every minimum only ``BITS`` low bits are kept, packed in bit planes, so that two signatures are compared
by a few XORs and bit counts. Equal sets are one node from the start: copies cost one row.

1. Nodes that share a band's key are candidates. A bucket (the nodes of one key) of up to ``BUCKET`` nodes is held in
   one task, which keeps a spanning forest of the pairs whose estimated similarity, corrected for chance collisions
   of the low bits, is ``ESTIMATE`` or more. A larger bucket is hung on its smallest node without an estimate, by a
   join that Spark can split; that keeps more than the estimate would, never less.
2. Links lie inside the connected components of these candidates. Their members' texts are read again for the full
   sets, and pairs that pass the estimate are confirmed on them. A component is dealt to parts of bounded size.
   First each part is compared in itself and with ``LEADERS`` nodes common to all parts; what that does not unite
   is then compared, part by part, with the whole component. A component that the leaders unite, like the near
   copies of one text, costs time in proportion to its size; only one that is no union is quadratic.

What can be lost: the bands find a pair of similarity 0.8 but for a chance of (1 - 0.8**5)**64 = 9e-12, the
estimate keeps it but for one of about 3e-12; a pair below the limit never gets in, as links are confirmed on
the sets. Shingles are named by 64 bits, sets by 128.

Defined results: a text of one word is one shingle; a null, empty or blank text has no shingles and is linked with
nothing; component_id is the smallest doc_id of the component (null only if all its ids are); a row whose doc_id is
null and that is linked with nothing is kept; repeated rows are returned each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, release, release_after, row_key, small_batches
from .components import components
from .hashing import mix
from .substring_dedup import text_groups

SHINGLE, PERCENT = 2, 80
#: Minima of a band, bands, and low bits kept of each minimum.
DEPTH, BANDS, BITS = 5, 64, 2
#: Least estimated similarity of a pair that is confirmed.
ESTIMATE = 0.58
#: Nodes of a bucket that one task compares; nodes and shingles of a part; nodes that meet every part.
BUCKET, PART_NODES, PART_SHINGLES, LEADERS = 2_000, 4_000, 1_000_000, 32
#: Bits of the bitmaps of a part.
BITMAP_BITS = 1 << 29
_MINIMA = BANDS * DEPTH
_random = np.random.Generator(np.random.PCG64(11))
_A = _random.integers(0, 1 << 31, _MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _random.integers(0, 1 << 32, _MINIMA, dtype=np.uint32)
_CHUNK = 1_024


def minima(names: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions."""
    x = (names >> np.uint64(32)).astype(np.uint32)
    out = np.full(_MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _CHUNK):
        values = np.multiply.outer(_A, x[at : at + _CHUNK])
        values += _B[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """64 bits of each band's minima and number."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32)
    for column in least.reshape(BANDS, DEPTH).T:
        key = mix(key ^ column)
    return key.view(np.int64)


def low_bits(least: np.ndarray) -> bytes:
    """The low bits of the mixed minima, a bit plane after the other."""
    mixed = mix(least.astype(np.uint64) + np.arange(_MINIMA, dtype=np.uint64))
    return b"".join(np.packbits((mixed >> np.uint64(b)).astype(np.uint8) & 1).tobytes() for b in range(BITS))


def _planes(signatures: list[bytes]) -> np.ndarray:
    """Signatures as words: (rows, planes, words)."""
    return np.frombuffer(b"".join(signatures), np.uint64).reshape(len(signatures), BITS, -1)


def similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of a signature and others, corrected for low bits that agree by chance."""
    differ = np.bitwise_or.reduce(one ^ others, axis=1)
    equal = 1 - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) / _MINIMA
    chance = 0.5**BITS
    return (equal - chance) / (1 - chance)


def shingle_names(texts: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted names of its distinct shingles) of the texts that have a word."""
    for first, w in text_groups(texts, SHINGLE, True):
        names = w.names()
        cuts = np.flatnonzero(np.diff(w.row)) + 1
        for a, b in pairwise([0, *cuts.tolist(), len(names)] if len(names) else [0]):
            yield int(w.row[a]) + first, np.unique(names[a:b])


def shingle_sets(texts: pa.ChunkedArray) -> list[np.ndarray]:
    """Sorted names of each text's shingles: of two words, or the only word."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    for row, names in shingle_names(texts):
        out[row] = names
    for row, text in enumerate(texts.to_pylist()):
        if not len(out[row]) and text and (words := text.encode("utf-8", "surrogatepass").lower().split()):
            out[row] = np.array([xxhash.xxh3_64_intdigest(words[0])], np.uint64)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key, n (shingles), node (digest of the set), bands and low (packed low bits) of each row; the last three null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(pa.chunked_array([batch.column("text")]))
            least = [minima(s) if len(s) else None for s in sets]
            columns = [
                batch.column("doc_id"),
                batch.column("key"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([None if m is None else band_keys(m) for m in least], pa.list_(pa.int64())),
                pa.array([None if m is None else low_bits(m) for m in least], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n", "node", "bands", "low"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = small_batches(docs).select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    return read.mapInArrow(run, f"doc_id {kind}, key string, n long, node binary, bands array<long>, low binary")


class _Forest:
    """Components of numbered things, and the links that united them."""

    def __init__(self, labels: np.ndarray):
        self.label = labels
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        if a != b:
            self.label[self.label == max(a, b)] = min(a, b)
            self.links.append((i, j))


def bucket_links(nodes: np.ndarray, planes: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of the pairs of a bucket that are similar enough by estimate."""
    forest = _Forest(np.arange(len(nodes)))
    for i in range(1, len(nodes)):
        for j in np.flatnonzero(similarity(planes[i], planes[:i]) >= ESTIMATE).tolist():
            forest.join(i, j)
    return [(int(nodes[i]), int(nodes[j])) for i, j in forest.links]


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) whose components hold every pair of nodes that share a band and pass the estimate; nodes has id, bands and low."""
    entries = nodes.select("id", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("held"), F.min("id").alias("least")).where("held > 1").withColumnRenamed("band", "of")
    met = checkpointed(entries.join(shared, F.col("band") == F.col("of")).select("id", "band", "held", "least"))
    large = met.where((F.col("held") > BUCKET) & (F.col("id") != F.col("least"))).select(F.col("id").alias("a"), F.col("least").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows: pa.Table | None = None

        def closed(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
            ids, planes = rows.column("id").to_numpy(), _planes(rows.column("low").to_pylist())
            links = [x for a, b in pairwise(bounds.tolist()) for x in bucket_links(ids[a:b], planes[a:b])]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([open_rows, rows]) if open_rows is not None else rows
            bands = rows.column("band").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(bands)) + 1])
            if len(starts) > 1:
                yield closed(rows, starts)
            open_rows = rows.slice(int(starts[-1])).combine_chunks()
        if open_rows is not None:
            yield closed(open_rows, np.array([0, open_rows.num_rows]))

    small = met.where(F.col("held") <= BUCKET).select("id", "band")
    signed = small.join(nodes.select(F.col("id").alias("own"), "low"), F.col("id") == F.col("own")).select("band", "id", "low")
    return signed.repartition("band").sortWithinPartitions("band").mapInArrow(run, "a long, b long").union(large)


class _Shared:
    """Sizes of the intersections of a part's sets, over the shingles that two of them or more have.

    Near copies share most of their shingles: if these are few for the sets' sizes, sets are bitmaps of them; else a
    set marks its own in an array that the others' lists look up.
    """

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        _, token, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = counts > 1
        kept = often[token]
        self.owner, self.token = np.repeat(np.arange(len(sets)), sizes)[kept], (np.cumsum(often) - 1)[token[kept]]
        self.offsets = np.searchsorted(self.owner, np.arange(len(sets) + 1))
        wide = -(-int(often.sum()) // 64) * 64
        # a lookup costs as much as several words of bits
        self.bits = self._bitmaps(len(sets), wide) if wide <= max(64, 256 * len(self.token) // max(1, len(sets))) and len(sets) * wide <= BITMAP_BITS else None
        self.marks = np.zeros(wide, np.uint8)

    def _bitmaps(self, n: int, wide: int) -> np.ndarray:
        out = np.empty((n, wide // 64), np.uint64)
        for at in range(0, n, 256):
            a, b = self.offsets[at], self.offsets[min(n, at + 256)]
            held = np.zeros((min(n, at + 256) - at, wide), bool)
            held[self.owner[a:b] - at, self.token[a:b]] = True
            out[at : at + 256] = np.packbits(held, axis=1).view(np.uint64)
        return out

    def sizes_with(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1, dtype=np.int64)
        own = self.token[self.offsets[i] : self.offsets[i + 1]]
        self.marks[own] = 1
        lengths = self.offsets[others + 1] - self.offsets[others]
        starts = np.cumsum(lengths) - lengths
        cells = np.arange(lengths.sum()) + np.repeat(self.offsets[others] - starts, lengths)
        found = np.concatenate([[0], np.cumsum(self.marks[self.token[cells]], dtype=np.int64)])
        self.marks[own] = 0
        return found[starts + lengths] - found[starts]


def confirmed(ids: np.ndarray, labels: np.ndarray, planes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Spanning links between the labels: pairs that pass the estimate and whose sets are similar enough."""
    n = len(ids)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    shared = _Shared(sets)
    forest = _Forest(np.unique(labels, return_inverse=True)[1])
    for i in range(1, n):
        others = np.flatnonzero(forest.label[:i] != forest.label[i])
        others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
        if not len(others):
            continue
        near = similarity(planes[i], planes[others])
        others, near = others[near >= ESTIMATE], near[near >= ESTIMATE]
        others = others[np.argsort(-near, kind="stable")]
        width = 1
        while len(others):
            # the most similar first, then more at once; the united ones need no look
            some, others = others[:width], others[width:]
            both = shared.sizes_with(i, some)
            for j in some[100 * both >= percent * (sizes[i] + sizes[some] - both)].tolist():
                forest.join(i, j)
            others = others[forest.label[others] != forest.label[i]]
            width = min(4_096 if shared.bits is not None else 256, 4 * width)
    return [(int(ids[i]), int(ids[j])) for i, j in forest.links]


def group_links(rows: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) of a group, which has a, label, low and hashes, a node once or more; there are very many small ones."""
    _, first = np.unique(rows.column("a").to_numpy(), return_index=True)
    rows = rows.take(pa.array(first))
    sets = [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()]
    links = confirmed(rows.column("a").to_numpy(), rows.column("label").to_numpy(), _planes(rows.column("low").to_pylist()), sets, percent)
    release_after(rows)
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def _compared(held: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that the tasks find; held has task, a, label, low and hashes, a node once or more in a task."""
    return held.groupBy("task").applyInArrow(lambda rows: group_links(rows, percent), "a long, b long")


def _sets_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The members (key, and other columns) with the hashes of their shingles, from the texts; a node once a task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes = batch.column("a").to_pylist()
            # of rows that are equal in id and text, which share a key, the first
            new = [i for i, a in enumerate(nodes) if not (a in seen or seen.add(a))]
            rows = batch.take(pa.array(new, pa.int64()))
            hashes = [s.tobytes() for s in shingle_sets(pa.chunked_array([rows.column("text")]))]
            kept = [k for k in range(rows.num_columns) if rows.schema.names[k] != "text"]
            yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in kept], pa.array(hashes, pa.binary())], names=[*[rows.schema.names[k] for k in kept], "hashes"])
        release()

    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("of"), "text")
    joined = texts.join(members, F.col("of") == F.col("key")).drop("of", "key")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name != "text")
    return joined.mapInArrow(run, f"{kinds}, hashes binary")


def confirmed_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """Links (node, root) of the components of all pairs of candidates whose sets are similar enough."""
    groups = components(candidates)
    # a group's root is no node of the table of components
    groups = groups.select(F.col("root").alias("node"), "root").distinct().union(groups)
    members = nodes.join(groups, F.col("id") == F.col("node")).select(F.col("id").alias("a"), "n", "low", F.col("first.key").alias("key"), "root")
    sizes = members.groupBy(F.col("root").alias("of")).agg(F.ceil(F.greatest(F.sum("n") / PART_SHINGLES, F.count("*") / PART_NODES)).cast("int").alias("parts"), F.count("*").alias("size"))
    members = members.join(sizes, F.col("root") == F.col("of")).drop("of", "n")
    # the leaders of a large group: about LEADERS of its nodes, by hash
    lead = (F.col("parts") > 1) & (F.pmod(F.xxhash64(F.lit(1), "a"), F.col("size")) < LEADERS)
    members = members.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).withColumn("lead", lead)
    held = checkpointed(_sets_of(docs, members))
    parts = F.when(F.col("lead"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))
    first = _compared(held.select(F.explode(parts).alias("part"), "root", "a", F.col("a").alias("label"), "low", "hashes").withColumn("task", F.struct("root", "part")).drop("root", "part"), percent)
    united = components(first)

    # what the first round leaves in several components: all but the largest of each group meets the whole group
    large = held.where("parts > 1").drop("lead")
    placed = large.select("root", "parts", "a").distinct().join(united.withColumnRenamed("root", "to"), F.col("a") == F.col("node"), "left").select("root", "parts", "a", F.coalesce("to", "a").alias("label"))
    counted = placed.groupBy("root", "label").agg(F.count("*").alias("size"))
    main = counted.groupBy("root").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("size"), F.max("size").alias("most"))
    main = main.where("size > most").withColumn("left", (F.col("size") - F.col("most")) / F.col("size")).select(F.col("root").alias("of"), "main", "left")
    placed = placed.join(main, F.col("root") == F.col("of")).select(F.col("a").alias("own"), "label", "main", F.ceil(F.col("parts") * F.col("left")).cast("int").alias("rest"))
    again = large.join(placed, F.col("a") == F.col("own")).drop("own")
    others = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda r: F.struct(r.alias("r"), F.col("part").alias("p")))
    mine = F.pmod(F.xxhash64(F.lit(2), "a"), F.col("rest")).cast("int")
    own = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(mine.alias("r"), p.alias("p")))
    meets = F.when(F.col("label") == F.col("main"), others).otherwise(F.array_union(own, others))
    second = _compared(again.select(F.explode(meets).alias("at"), "root", "a", "label", "low", "hashes").withColumn("task", F.struct("root", "at.r", "at.p")).drop("root", "at"), percent)
    return components(united.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; documents of a similarity of ``percent`` or more are linked."""
    rows = checkpointed(signatures(docs))
    nodes = rows.where("node IS NOT NULL").groupBy(F.col("node").alias("set")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first"), *[F.first(c).alias(c) for c in ("n", "bands", "low")])
    nodes = checkpointed(nodes.withColumn("id", F.monotonically_increasing_id()))
    linked = confirmed_links(docs, nodes, candidate_links(nodes), percent=percent)
    placed = nodes.select("id", "set", F.col("first.doc_id").alias("doc")).join(linked, F.col("id") == F.col("node"), "left").select("set", "doc", F.coalesce("root", "id").alias("root"))
    least = placed.groupBy("root").agg(F.min("doc").alias("component_id")).withColumnRenamed("root", "of")
    named = checkpointed(placed.join(least, F.col("root") == F.col("of")).select("set", "component_id"))
    found = rows.select("doc_id", "n", "node").join(named, F.col("node") == F.col("set"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: The same in SQL: sets, their pairs with a common shingle, links, and the least doc_id by repeated steps.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS shingles
  FROM words
), nodes AS MATERIALIZED (
  SELECT min(doc_id) AS node, shingles, len(shingles) AS n FROM sets WHERE len(shingles) > 0 GROUP BY shingles
), places AS MATERIALIZED (
  SELECT node, n, unnest(shingles) AS s FROM nodes
), links AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM places a JOIN places b ON a.s = b.s AND a.node <> b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
  SELECT node, node AS root FROM nodes
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node AND r.root < l.b
), least AS MATERIALIZED (
  SELECT node, min(root) AS root FROM reached GROUP BY node
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(l.root, s.doc_id) AS component_id, coalesce(l.root, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN nodes n ON n.shingles = s.shingles LEFT JOIN least l ON l.node = n.node
"""
