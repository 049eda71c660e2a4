"""Centroid clustering whose bounds are loosened by geometry, not by the full drift of a centroid.

Each vector keeps its cluster, an upper bound of the distance to its centroid and a lower bound of that to all others. When centroids
move, the upper bound grows by the own centroid's drift. The lower bound need not fall by the largest drift of the others: a cluster's vectors lie in a
sphere around its old centroid, and a centroid that moves from p to q comes nearer to a point x by |x - p| - |x - q|. The points where that is v or more lie within a
hyperbola branch around q, hence within its asymptotic cone: apex in the middle of p and q, cosine v / |q - p| to the axis. In the plane through
the sphere's centre and the axis, the least angle of the sphere to the axis, seen from the apex, therefore bounds the loss by |q - p| cos(angle), and by nothing from a right angle on.
Vectors whose bounds still do not part are scanned exactly, in integers; so the clusters are those of plain rounds, ties to the smaller number included.

Components are integers, floor(64 x). Rows without exactly DIM components, with a null or non-finite one, or with one whose integer is beyond LIMIT (squared
distances would not fit a long) are no vectors and give no row. Repeated rows are vectors of their own; a null vec_id hashes as the empty text. Fewer vectors than clusters give
as many clusters as vectors; an empty table gives no rows; other columns are not read. State between rounds is a written table of narrow rows: a lost executor
costs its tasks, and the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import forget, written

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, "1"
LIMIT = 1 << 27
SLACK = 1e-9  # relative; far above what doubles lose here, far below what bounds gain

STATE = "v array<int>, cluster int, upper double, lower double, scans int"


@dataclass(frozen=True)
class Moves:
    """Centroids now, and what the step from the ones before does to bounds: the drift of each, and each sphere's loss against all others."""

    centroids: np.ndarray
    drift: np.ndarray
    loss: np.ndarray


def vectors(table: DataFrame, of: str = "embedding", dim: int = DIM) -> DataFrame:
    """(vec_id, v): the rows that are vectors, as integers."""
    raw = table.select("vec_id", F.col(of).cast("array<double>").alias("raw"))
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LIMIT // SCALE)
    return raw.where((F.size("raw") == dim) & F.forall("raw", fits)).select("vec_id", F.transform("raw", lambda x: F.floor(x * SCALE).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, in that order; of equal hashes the smaller components first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in kept.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(clusters).collect()], dtype=np.int64)


def squares(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors (rows) to centroids (columns)."""
    return (v * v).sum(axis=1)[:, None] - 2 * (v @ centroids.T) + (centroids * centroids).sum(axis=1)


def loss(centre: np.ndarray, radius: float, p: np.ndarray, q: np.ndarray) -> float:
    """An upper bound of |x - p| - |x - q| over the sphere's points x; at most |q - p|, and never below 0."""
    axis = q - p
    drift = float(np.sqrt(axis @ axis))
    if drift == 0:
        return 0.0
    to = centre - (p + q) / 2
    far = float(np.sqrt(to @ to))
    if radius >= far * (1 - SLACK):  # the sphere holds the apex
        return drift
    along = min(1.0, max(-1.0, float(to @ axis) / (far * drift)))
    least = np.arccos(along) - np.arcsin(min(1.0, radius / far)) - SLACK
    return drift * min(1.0, max(0.0, float(np.cos(max(least, 0.0))) + SLACK))


def moves(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> Moves:
    old, new = before.astype(float), after.astype(float)
    k = range(len(old))
    lost = [max((loss(old[a], radius[a], old[j], new[j]) for j in k if j != a), default=0.0) for a in k]
    return Moves(after, np.sqrt(((new - old) ** 2).sum(axis=1)), np.array(lost))


def _flat(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper and lower bound of each vector by a full scan."""
    d = squares(v, centroids)
    best = d.argmin(axis=1)  # the first of equals
    rows = np.arange(len(v))
    own = d[rows, best]
    d[rows, best] = np.iinfo(np.int64).max
    other = np.sqrt(d.min(axis=1).astype(float)) if len(centroids) > 1 else np.full(len(v), np.inf)
    return best, np.sqrt(own.astype(float)) * (1 + SLACK), other * (1 - SLACK)


def scanned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The state after the first assignment, in which every vector is scanned."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, upper, lower = _nearest(_flat(b.column("v"), dim), centroids)
            yield _state(b, best, upper, lower, np.ones(b.num_rows))

    return kept.mapInArrow(run, _schema(kept))


def _schema(kept: DataFrame) -> str:
    return f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, {STATE}"


def _state(b: pa.RecordBatch, cluster, upper, lower, scans) -> pa.RecordBatch:
    columns = [b.column("vec_id"), b.column("v"), pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), pa.array(lower, pa.float64()), pa.array(scans, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "upper", "lower", "scans"])


def rescanned(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: Moves):
    """New cluster, upper and lower bounds after a step, and which vectors had to be scanned."""
    cluster = cluster.copy()
    lower = (lower - step.loss[cluster]) * (1 - SLACK) - SLACK
    upper = (upper + step.drift[cluster]) * (1 + SLACK)
    loose = np.flatnonzero(~(upper < lower))
    own = v[loose] - step.centroids[cluster[loose]]
    upper[loose] = np.sqrt((own * own).sum(axis=1).astype(float)) * (1 + SLACK)
    rows = loose[~(upper[loose] < lower[loose])]
    cluster[rows], upper[rows], lower[rows] = _nearest(v[rows], step.centroids)
    return cluster, upper, lower, rows


def reassigned(state: DataFrame, step: Moves) -> DataFrame:
    dim = step.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, upper, lower, rows = rescanned(_flat(b.column("v"), dim), *[b.column(c).to_numpy() for c in ("cluster", "upper", "lower")], step)
            scans = b.column("scans").to_numpy().copy()
            scans[rows] += 1
            yield _state(b, cluster, upper, lower, scans)

    return state.mapInArrow(run, _schema(state))


def measured(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, scans) with the exact squared distance to the cluster's centroid."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _flat(b.column("v"), dim) - centroids[b.column("cluster").to_numpy()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array((own * own).sum(axis=1), pa.int64()), b.column("scans")], names=["vec_id", "cluster", "distance", "scans"])

    return state.mapInArrow(run, f"vec_id {state.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, scans int")


def updated(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New centroids, floor(sum / count) by component, and the radius of each sphere; one row a cluster comes to the driver."""
    after, radius = centroids.copy(), np.zeros(len(centroids))
    sums = [F.sum(F.col("v")[k].cast("long")).alias(f"s{k}") for k in range(centroids.shape[1])]
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("upper").alias("radius"), *sums).collect():
        after[r.cluster] = [r[f"s{k}"] // r.n for k in range(centroids.shape[1])]
        radius[r.cluster] = r.radius
    return after, radius


def cluster(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, of: str = "embedding", dim: int = DIM, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, scans, cluster_inertia, inertia, centroid_sha256 of every vector after rounds updates and a last assignment."""
    spark = table.sparkSession
    kept = vectors(table, of, dim)
    centroids = first_centroids(kept, clusters, seed)
    if not len(centroids):
        none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("scans", "int"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return kept.limit(0).select("vec_id", *none)
    state, path = written(scanned(kept, centroids), "clusters")
    for k in range(rounds):
        after, radius = updated(state, centroids)
        step, centroids, last = moves(centroids, after, radius), after, path
        moved = reassigned(state, step)
        state, path = written(measured(moved, centroids) if k == rounds - 1 else moved, "clusters")
        forget(spark, last)
    rows = state if rounds else measured(state, centroids)
    held = {r.cluster: int(r.inertia) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # one row a cluster
    of_cluster = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    long = lambda c: c.try_cast("long")
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return rows.select(
        "vec_id", "cluster", "distance", "scans", long(of_cluster([str(held.get(k, 0)) for k in range(len(centroids))])).alias("cluster_inertia"),
        long(F.lit(str(sum(held.values())))).alias("inertia"), of_cluster(digests).alias("centroid_sha256"),
    )
