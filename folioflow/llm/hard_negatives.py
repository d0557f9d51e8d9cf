"""Operator 13: hard negatives by Four-Russians scoring.

Every vector is written once as packed bit planes: of its integer components in two's complement, bit b of eight
neighbouring ones makes a byte. For each anchor and group of eight components a table holds the sums of all 256
subsets of the anchor's components. A score is then a sum of looked-up entries: for each plane, the entries of its
bytes, shifted by the plane's number and added, those of the sign's plane subtracted. That is the whole integer
inner product, exact; nothing is estimated.

Anchors are the stated query set, and are held against all rows in blocks: a task has a block of candidates and a
block of anchors, scores them in pieces and sends what may be among the first of each anchor. Two passes are
made: one for the positives, one for the negatives in the ranges that they set.

Defined results: rows with a null label, a null vector, or a component that is null, not finite or beyond +-2**24
after scaling (scores of so long vectors would not fit a long) take no part; missing components of a shorter vector
count as zero; other rows than the anchor are those of another vec_id, null ids among them, which come last of
equal scores; repeated rows count each, as anchors, positives and negatives; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed
from .vectors import scaled, usable

SCALE, MOST_BITS = 256, 24
POSITIVES, NEGATIVES = 5, 10
#: Percent of a positive's score that a negative reaches at least and at most.
LEAST, MOST = 30, 90
#: Rows of a block of candidates and of one of anchors; groups of components times anchors whose tables are held at once; candidates scored at once.
ROWS, ANCHORS, TABLES, PIECE = 8_192, 8_192, 4_096, 512
_ROW = "row long, vec_id long, label long, bits int, planes binary"


def pack_planes(values: np.ndarray) -> tuple[int, bytes]:
    """Bits of the components in two's complement, and the bytes of their planes, lowest first."""
    bits = max((int(v).bit_length() for v in (values.max(initial=0), ~values.min(initial=0))), default=0) + 1
    planes = (values[None, :] >> np.arange(bits)[:, None]) & 1
    return bits, np.packbits(planes.astype(np.uint8), axis=1, bitorder="little").tobytes()


def unpack_planes(bits: int, planes: bytes) -> np.ndarray:
    """The components, padded with zeros to whole groups."""
    held = np.unpackbits(np.frombuffer(planes, np.uint8).reshape(bits, -1), axis=1, bitorder="little").astype(np.int64)
    weight = np.left_shift(1, np.arange(bits))
    weight[-1] *= -1
    return weight @ held


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (group, subset, anchor) of the sums of the anchors' components; anchors is (anchor, 8 * groups)."""
    parts = anchors.reshape(len(anchors), -1, 8).transpose(1, 2, 0)
    out = np.zeros((parts.shape[0], 256, parts.shape[2]), np.int64)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + parts[:, j, None]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (candidate, anchor); planes is (candidate, bits, groups)."""
    n, bits, groups = planes.shape
    out = np.zeros((n, tables.shape[2]), np.int64)
    plane, entry = np.empty_like(out), np.empty_like(out)
    for b in range(bits - 1, -1, -1):
        plane[:] = 0
        for g in range(min(groups, len(tables))):
            np.take(tables[g], planes[:, b, g], axis=0, out=entry)
            plane += entry
        # the sign's plane comes first
        out += out
        out += -plane if b == bits - 1 else plane
    return out


def packed_rows(embeddings: DataFrame, *, scale: int = SCALE) -> DataFrame:
    """vec_id, label (after the stated change), bits and planes of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack_planes(np.array(x, np.int64)) for x in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([b for b, _ in packed], pa.int32()), pa.array([p for _, p in packed], pa.binary())], names=["vec_id", "label", "bits", "planes"])

    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.where(F.col("label").isNotNull() & usable(F.col("embedding"), scale, MOST_BITS))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), scaled(F.col("embedding"), scale).alias("x"))
    return rows.mapInArrow(run, "vec_id long, label long, bits int, planes binary")


class _Block:
    """Candidates in order of vec_id (null last), as groups of one shape."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("vec_id")
        null = ids.is_null().to_numpy()
        known = ids.fill_null(-(1 << 63)).to_numpy()
        order = np.lexsort((rows.column("row").to_numpy(), known, null))
        self.rows = rows.take(pa.array(order))
        self.ids, self.labels = known[order], rows.column("label").to_numpy()[order]
        bits, planes = self.rows.column("bits").to_numpy(), self.rows.column("planes").to_pylist()
        shape = np.array([(b, len(p) // b) for b, p in zip(bits.tolist(), planes, strict=True)]).reshape(-1, 2)
        self.pieces = []
        for b, g in np.unique(shape, axis=0).tolist():
            own = np.flatnonzero((shape == (b, g)).all(axis=1))
            for at in range(0, len(own), PIECE):
                some = own[at : at + PIECE]
                self.pieces.append((some, np.frombuffer(b"".join([planes[i] for i in some.tolist()]), np.uint8).reshape(len(some), b, g)))


def _first(score: np.ndarray, valid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, columns) of the first ``most`` valid entries of each column: higher scores, then smaller places."""
    n = len(score)
    if int(np.abs(score).max(initial=0)) < (1 << 61) // max(1, n):
        rank = np.where(valid, score * n + np.arange(n - 1, -1, -1)[:, None], np.iinfo(np.int64).min)
        top = np.argpartition(rank, max(0, n - most), axis=0)[-most:]
    else:
        top = np.argsort(np.where(valid, -score, np.iinfo(np.int64).max), axis=0, kind="stable")[:most]
    kept = np.take_along_axis(valid, top, axis=0)
    columns = np.broadcast_to(np.arange(score.shape[1]), top.shape)
    return top[kept], columns[kept]


def _best(block: _Block, anchors: pa.Table, most: int, ranges: int, valid) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(range, anchor, candidate, score) arrays of the first ``most`` candidates of each anchor and range; valid(k, anchors, score, labels equal, ids equal) says which may be."""
    values = [unpack_planes(b, p) for b, p in zip(anchors.column("bits").to_pylist(), anchors.column("planes").to_pylist(), strict=True)]
    width = max(8, max(map(len, values), default=0))
    matrix = np.stack([np.pad(v, (0, width - len(v))) for v in values])
    ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
    step, out = max(1, TABLES // (width // 8)), []
    for at in range(0, len(values), step):
        some = slice(at, at + step)
        tables = subset_sums(matrix[some])
        found: list[list[tuple]] = [[] for _ in range(ranges)]
        for places, planes in block.pieces:
            score = scores(tables, planes)
            alike, same = block.labels[places][:, None] == labels[some], block.ids[places][:, None] == ids[some]
            for k in range(ranges):
                row, column = _first(score, valid(k, some, score, alike, same), most)
                found[k].append((column, places[row], score[row, column]))
        for k, parts in enumerate(found):
            column, place, score = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, -score, column))
            column, place, score = column[order], place[order], score[order]
            kept = np.arange(len(column)) - np.searchsorted(column, column) < most
            out.append((np.full(kept.sum(), k), column[kept] + at, place[kept], score[kept]))
    return out


def _blocks(rows: DataFrame, anchors: DataFrame, counts: tuple[int, int]):
    """The rows and the anchors, each in every cell of the grid of blocks where they meet; counts are the numbers of blocks."""
    candidates, queries = counts
    left = rows.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(candidates))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(queries - 1))))
    right = anchors.withColumn("q", F.pmod(F.xxhash64("row"), F.lit(queries)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(candidates - 1).cast("long"))))
    return left.groupBy("c", "q").cogroup(right.groupBy("c", "q"))


def _rows_in(side: pa.Table) -> bool:
    """Whether a side of a cell has rows: an empty one has no columns."""
    return "row" in side.column_names and side.num_rows > 0


def _nothing(names: list[str]) -> pa.Table:
    """No rows of longs."""
    return pa.table({name: pa.array([], pa.int64()) for name in names})


def _top(found: DataFrame, by: list[str], score: str, vec_id: str, most: int) -> DataFrame:
    """The first rows of each key, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(vec_id), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine_negatives(embeddings: DataFrame, *, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of each anchor's negatives."""
    rows = checkpointed(packed_rows(embeddings).withColumn("row", F.monotonically_increasing_id()))
    anchors = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    counts = max(1, -(-n // ROWS)), max(1, -(-m // ANCHORS))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (_rows_in(left) and _rows_in(right)):
            return _nothing(["row", "found", "positive_id", "positive_score"])
        block = _Block(left)
        found = _best(block, right, positives, 1, lambda k, some, score, alike, same: alike & ~same)
        _, a, p, s = (np.concatenate(x) for x in zip(*found, strict=True))
        mine, theirs = right.take(pa.array(a)), block.rows.take(pa.array(p))
        return pa.table({"row": mine.column("row"), "found": theirs.column("row"), "positive_id": theirs.column("vec_id"), "positive_score": pa.array(s)})

    shown = _blocks(rows, anchors, counts).applyInArrow(near, "row long, found long, positive_id long, positive_score long")
    own = _top(shown, ["row"], "positive_score", "positive_id", positives).groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("own"))
    ready = checkpointed(anchors.join(own, F.col("row") == F.col("of")).drop("of"))

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (_rows_in(left) and _rows_in(right)):
            return _nothing([k.split()[0] for k in kinds.split(", ")])
        block = _Block(left)
        own = right.column("own").to_pylist()
        # of an anchor with fewer positives, the rest have an empty range
        value = np.array([[x["positive_score"] for x in o] + [-1] * (positives - len(o)) for o in own], np.int64).reshape(-1, positives)
        low, high = -(-(LEAST * value) // 100), MOST * value // 100

        def valid(k: int, some: slice, score: np.ndarray, alike: np.ndarray, same: np.ndarray) -> np.ndarray:
            return ~alike & (score >= low[some, k]) & (score <= high[some, k])

        k, a, p, s = (np.concatenate(x) for x in zip(*_best(block, right, negatives, positives, valid), strict=True))
        mine, theirs = right.take(pa.array(a)), block.rows.take(pa.array(p))
        positive = [own[i][j] for i, j in zip(a.tolist(), k.tolist(), strict=True)]
        return pa.table({
            "row": mine.column("row"), "no": pa.array(k), "found": theirs.column("row"), "anchor_id": mine.column("vec_id"),
            "positive_id": pa.array([x["positive_id"] for x in positive], pa.int64()), "positive_score": pa.array([x["positive_score"] for x in positive], pa.int64()),
            "negative_id": theirs.column("vec_id"), "negative_score": pa.array(s),
        })

    kinds = "row long, no long, found long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    mined = _top(_blocks(rows, ready, counts).applyInArrow(hard, kinds), ["row", "no"], "negative_score", "negative_id", negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in SQL: anchors against all rows.
ORACLE = """
WITH rows AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id IS DISTINCT FROM b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id NULLS LAST, n.b) AS rank
  FROM positives p JOIN scored n ON n.a = p.a AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
