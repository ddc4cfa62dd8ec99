import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscan.llm import clusters
from fieldscan.llm.registry import ORACLES, QUERIES, load
from tests.llm.helpers import given

load()


def brute(rows, k=16, rounds=3, dims=64, scale=64):
    """All distances anew in every round, in Python numbers; rows list (vec_id, embedding)."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    draw = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in draw[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), at) for at, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        found = nearest()
        for at in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(kept, found) if c == at]
            if own:
                centroids[at] = [sum(column) // len(own) for column in zip(*own)]
    found = nearest()
    inertia = [sum(d for d, c in found if c == at) for at in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), names[c]) for (i, _), (d, c) in zip(kept, found)), key=str)


def got(frame):
    assert frame.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, frame.collect()), key=str)


def test_given_vectors(spark):
    rows = got(QUERIES["op13_centroid_clusters"](spark, "/root/testdata/sf0.001"))
    assert rows == brute([(d["vec_id"], d["embedding"]) for d in given(table="embeddings")])
    assert "op13_centroid_clusters" in ORACLES


def test_hard_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 4) / 2]) for i in range(60)]
    rows += [(70, None), (71, []), (72, [1.0, None, 0.0, 0.0]), (73, [1.0, float("nan"), 0.0, 0.0]), (74, [float("inf"), 0.0, 0.0, 0.0]),
             (75, [1.0] * 3), (76, [1.0] * 5), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (77, [-0.0] * 4), (78, [0.0] * 4),
             (79, [-1e5, 1e5, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("cluster", F.lit("c"))
    for k in (16, 200, 1):
        assert got(clusters.cluster(frame.repartition(3), k=k, dims=4)) == brute(rows, k, dims=4)
    assert clusters.cluster(frame.limit(0)).count() == 0
    assert got(clusters.cluster(frame.where("vec_id >= 70 and vec_id < 77"), dims=4)) == []


def test_identical_vectors_fill_one_cluster(spark):
    frame = spark.createDataFrame([(i, [0.5, -0.25]) for i in range(30)], "vec_id long, embedding array<float>")
    rows = got(clusters.cluster(frame, dims=2))
    assert rows == brute([(i, [0.5, -0.25]) for i in range(30)], dims=2)
    assert {r[1] for r in rows} == {0}


def test_a_component_too_large_fails(spark):
    frame = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        clusters.cluster(frame, dims=2).collect()


def test_dot_products_follow_only_what_changed():
    rng = np.random.default_rng(4)
    x, before = rng.integers(-50, 50, (40, 8)), rng.integers(-50, 50, (5, 8))
    after = before.copy()
    after[1, 3] += 7
    after[4] += rng.integers(-2, 3, 8)
    moved = clusters.changes(before, after)
    assert [len(p) for p, _ in moved][:4] == [0, 1, 0, 0]
    assert (clusters.updated(x, x @ before.T, moved) == x @ after.T).all()
