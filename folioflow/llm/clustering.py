"""Operator 12: centroid clustering with Ptolemaic pivots.

The initial centroids are the fixed pivots. Each vector's distances to them are computed once and written with
the vector. For points x and c and pivots p and q, Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q)

so a centroid whose bound over the fixed pairs of pivots exceeds the distance to another one needs no look. The
bound is made smaller by more than rounding can have made it larger; survivors are compared by exact integer
distances. A round is one pass over the written vectors: a task sends the sums and counts of each cluster, and
the driver gets the new centroids, a row of sums for each cluster and component.

Defined results: vectors of another length, null vectors, and such as have a component that is null, not finite
or beyond +-2**27 after scaling (squared distances would not fit a long) take no part; repeated rows count
each; equal hashes go by the components; a null vec_id hashes last; with fewer vectors than clusters, each
vector starts one; sums of distances beyond a long are null; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .vectors import scaled, usable

SCALE, DIMENSIONS, CLUSTERS, ROUNDS, SEED = 1024, 64, 8, 10, 3
#: Bits of a component's size, and vectors that are compared at once.
MOST_BITS, _CHUNK = 27, 4_096
#: More than the relative error of a distance, a product and a quotient of doubles.
_SLACK = 1e-12


def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors to a point, exact."""
    d = x - point
    return np.einsum("ij,ij->i", d, d)


def pivot_pairs(pivots: np.ndarray) -> list[tuple[int, int]]:
    """The fixed pairs: each pivot and the next that is another point, around the circle."""
    n = len(pivots)
    out = []
    for p in range(n):
        for q in (*range(p + 1, n), *range(p)):
            if (pivots[p] != pivots[q]).any():
                out.append((p, q))
                break
    return out


def lower_bounds(to_pivots: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each vector and centroid, a number that its squared distance surely reaches."""
    own = np.sqrt(np.stack([distances(centroids, p) for p in pivots], axis=1).astype(float))
    out = np.zeros((len(to_pivots), len(centroids)))
    for p, q in pivot_pairs(pivots):
        one, two = to_pivots[:, p, None] * own[:, q], to_pivots[:, q, None] * own[:, p]
        apart = np.sqrt(float(distances(pivots[p : p + 1], pivots[q])[0]))
        np.maximum(out, (np.abs(one - two) - _SLACK * (one + two)) / apart, out=out)
    return out * out * (1 - _SLACK)


def nearest(x: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid (of equally near the smaller), squared distance to it, and how many distances were computed."""
    bounds = lower_bounds(to_pivots, pivots, centroids)
    cluster = bounds.argmin(axis=1)
    best = distances(x, centroids[cluster])
    looked = np.ones(len(x), np.int32)
    first = cluster.copy()
    for k in range(len(centroids)):
        left = np.flatnonzero((bounds[:, k] <= best * (1 + _SLACK)) & (first != k))
        d = distances(x[left], centroids[k])
        closer = (d < best[left]) | ((d == best[left]) & (k < cluster[left]))
        best[left[closer]], cluster[left[closer]] = d[closer], k
        looked[left] += 1
    return cluster, best, looked


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _with_pivot_distances(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, x (components) and away (distances to the pivots), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
            away = np.sqrt(np.stack([distances(x, p) for p in pivots], axis=1).astype(float))
            columns = [batch.column("vec_id"), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array([r.tobytes() for r in away], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "x", "away"])

    return vectors.select("vec_id", "x").mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, x binary, away binary")


def _assigned(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, centroids: np.ndarray) -> Iterator[tuple]:
    """(rows, components, cluster, distance, distances computed) of chunks of the batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            rows = batch.slice(at, _CHUNK)
            x = _matrix(rows.column("x"), "<i4").astype(np.int64)
            yield rows, x, *nearest(x, _matrix(rows.column("away"), "<f8"), pivots, centroids)


def _moved(cached: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for _, x, cluster, _, _ in _assigned(batches, pivots, centroids):
            for k in np.unique(cluster).tolist():
                own = cluster == k
                sums[k] += x[own].sum(axis=0)
                counts[k] += own.sum()
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = cached.mapInArrow(run, "cluster int, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    # exact: sums of longs may need more than 64 bits; one row a cluster and component comes to the driver
    found = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    moved = centroids.copy()
    for r in found:
        moved[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return moved


def cluster_vectors(embeddings: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and n_looked (distances computed for it at the end) of each vector."""
    whole = embeddings.where((F.size("embedding") == dimensions) & usable(F.col("embedding"), scale, MOST_BITS))
    whole = whole.select("vec_id", scaled(F.col("embedding"), scale).alias("x"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    # ``clusters`` rows come to the driver
    starts = whole.orderBy(digest.asc_nulls_last(), "x").limit(clusters).collect()
    if not starts:
        return whole.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in _RESULT[1:]])
    pivots = np.array([r["x"] for r in starts], np.int64)
    cached = checkpointed(_with_pivot_distances(whole, pivots))
    centroids = pivots
    for _ in range(rounds):
        centroids = _moved(cached, pivots, centroids)
    last = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, cluster, best, looked in _assigned(batches, pivots, last):
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(best), pa.array(looked)], names=["vec_id", "cluster", "distance", "n_looked"])

    placed = checkpointed(cached.mapInArrow(run, f"vec_id {whole.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, n_looked int"))
    # a row for each cluster, ``clusters`` at most
    inertia = {r["cluster"]: int(r["total"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    total = sum(inertia.values())
    fits = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    own, sha = F.lit(None).cast("long"), F.lit(None).cast("string")
    for k, n in inertia.items():
        here = F.col("cluster") == k
        own = F.when(here, fits(n)).otherwise(own)
        sha = F.when(here, hashlib.sha256(",".join(map(str, last[k].tolist())).encode()).hexdigest()).otherwise(sha)
    return placed.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), fits(total).alias("inertia"), sha.alias("centroid_sha256"), "n_looked")


_RESULT = [("vec_id", "long"), ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("n_looked", "int")]


def _oracle() -> str:
    """The contract in SQL, a pair of tables for each round."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT r, min({{'d': d, 'k': k}}) AS best FROM (SELECT p.r, c.k, sum((p.x - c.x) * (p.x - c.x)) AS d FROM parts p JOIN c{i} c ON p.pos = c.pos GROUP BY p.r, c.k) GROUP BY r
)""")
        if i < ROUNDS:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c.k, c.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x)::BIGINT AS x
  FROM c{i} c LEFT JOIN (SELECT n.best.k AS k, p.pos, sum(p.x) AS s, count(*) AS n FROM near{i} n JOIN parts p ON p.r = n.r GROUP BY n.best.k, p.pos) m ON m.k = c.k AND m.pos = c.pos
)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, unnest(v) AS x, unnest(range(1, {DIMENSIONS} + 1)) AS pos FROM kept
), c0 AS MATERIALIZED (
  SELECT p.pos, p.x, s.k FROM parts p JOIN (
    SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS k FROM kept QUALIFY k < {CLUSTERS}
  ) s ON s.r = p.r
), {", ".join(steps)}, hashed AS (
  SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY pos)) AS sha FROM c{ROUNDS} GROUP BY k
)
SELECT t.vec_id, n.best.k::INTEGER AS cluster, n.best.d::BIGINT AS distance, (sum(n.best.d) OVER (PARTITION BY n.best.k))::BIGINT AS cluster_inertia,
       (sum(n.best.d) OVER ())::BIGINT AS inertia, h.sha AS centroid_sha256
FROM near{ROUNDS} n JOIN kept t ON t.r = n.r JOIN hashed h ON h.k = n.best.k
"""


ORACLE = _oracle()
