import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from weft.llm import drift_clusters as c
from weft.llm.queries import op13_drift_clusters


def brute(rows, clusters=16, rounds=3, dim=64):
    """Plain rounds in Python integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) <= c.LIMIT // 64 for x in v)]
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in order[:clusters]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {k: sum(d for _, a, d in found if a == k) for k in range(len(centroids))}
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in found), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_query_against_plain_rounds(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(op13_drift_clusters(spark, sf_dir)) == brute(rows)


def test_edges_and_ties(spark):
    rng = random.Random(5)
    v = lambda: [rng.choice([-0.02, 0.0, 0.3, 1.0]) for _ in range(64)]
    same = v()
    rows = [(k, v()) for k in range(40)] + [(k, same) for k in range(50, 90)] + [(3, same), (3, v()), (None, v()), (None, v()), (100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 63 + [None]), (104, [1.0] * 63 + [float("nan")]), (105, [1.0] * 63 + [float("-inf")]), (106, [1e30] * 64), (107, [2e6] * 64)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    assert got(c.cluster(frame)) == brute(rows)
    assert got(c.cluster(frame, clusters=5, rounds=0)) == brute(rows, 5, 0)
    few = rows[:3]
    assert got(c.cluster(frame.where("vec_id < 3"))) == brute(few)
    assert got(c.cluster(frame.where("vec_id = 7"))) == brute([rows[7]])
    for none in (frame.limit(0), frame.where("vec_id = 101")):
        assert c.cluster(none).collect() == [] and "inertia" in c.cluster(none).columns


def test_loss_bounds_what_a_sphere_can_lose():
    rng = np.random.default_rng(1)
    tighter = 0
    for _ in range(3000):
        dim = int(rng.integers(2, 6))
        centre, p, q = rng.normal(size=(3, dim)) * rng.choice([0.1, 1, 5], size=(3, 1))
        radius = float(rng.choice([0, 0.2, 1, 3])) * rng.random()
        bound, drift = c.loss(centre, radius, p, q), np.linalg.norm(q - p)
        x = rng.normal(size=(200, dim))
        x = centre + x / np.linalg.norm(x, axis=1, keepdims=True) * radius * rng.choice([1, 1, 0.5], size=(200, 1))
        lost = np.linalg.norm(x - p, axis=1) - np.linalg.norm(x - q, axis=1)
        assert lost.max() <= bound + 1e-12 and bound <= drift * (1 + 1e-8)
        tighter += bound < 0.9 * drift
    assert tighter > 1000
    assert c.loss(np.zeros(2), 1.0, np.ones(2), np.ones(2)) == 0


def test_bounds_hold_and_spare_scans(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 64)) * 3
    rows = [(k, (centres[k % 8] + rng.normal(size=64) * 0.2).tolist()) for k in range(800)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = c.cluster(frame, clusters=8)
    assert got(found) == brute(rows, 8)
    assert found.agg(F.sum("scans")).first()[0] < 4 * len(rows) * 0.6  # plain rounds: 4 scans each
    old = c.first_centroids(c.vectors(frame), 8)
    new = old + rng.integers(-40, 40, size=old.shape)
    v = np.array([np.floor(np.array(x) * 64) for _, x in rows]).astype(np.int64)
    at, upper, lower = c._nearest(v, old)
    radius = np.array([upper[at == k].max(initial=0) for k in range(8)])
    step = c.moves(old, new, radius)
    assert (step.loss < np.array([max(step.drift[j] for j in range(8) if j != a) for a in range(8)])).any()
    at2, upper2, lower2, _ = c.rescanned(v, at, upper, lower, step)
    d = np.sqrt(c.squares(v, new).astype(float))
    own = d[np.arange(len(v)), at2]
    d[np.arange(len(v)), at2] = np.inf
    assert (own <= upper2 * (1 + 1e-12)).all() and (d.min(axis=1) >= lower2 * (1 - 1e-12)).all() and np.array_equal(at2, c._nearest(v, new)[0])
