"""Centroid clustering over an incremental distance matrix.

Vectors are whole numbers. Each vector keeps its exact dot product with every centroid beside it.
When centroids move, a dot product changes by the vector's components at the places where its
centroid changed, times that change; nothing else is recomputed. The nearest centroid is then the
least ``|c|**2 - 2 x.c``. Centroids are component sums folded by each task, so the driver and the
shuffle see (tasks x centroids) rows. Each state is written to the shared folder once read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscan.llm.common import shared_folder

CENTROIDS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, "1"
#: Components at or beyond this in size are refused: 64 squared differences would leave 64 bits.
LARGEST = 1 << 27
#: Rows worked on at once.
ROWS = 8192

STATE = "vec_id long, x array<int>, dots array<long>, cluster int"


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): kept vectors with x = floor(scale * component); a component too large fails the job."""
    values = F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("v")).where(
        (F.size("v") == dims) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))

    def whole(e):
        return F.when(F.abs(e) < LARGEST / scale, F.floor(e * scale).cast("int")).otherwise(
            F.raise_error(F.lit("a component is too large for 64-bit distances")).cast("int"))

    return good.select("vec_id", F.transform("v", whole).alias("x"))


def seeds(whole: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The vectors with the smallest sha256 of ``seed:vec_id``; of repeated ids the smaller vectors, null ids last."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.select(draw.alias("draw"), "x").orderBy(F.col("draw").asc_nulls_last(), "x").limit(k).collect()
    return [r["x"] for r in rows]


def changes(before: np.ndarray, after: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per centroid the places of its nonzero changes and the changes."""
    return [(np.flatnonzero(d), d[np.flatnonzero(d)]) for d in after - before]


def updated(x: np.ndarray, dots: np.ndarray, moved: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Dot products with the moved centroids."""
    out = dots.copy()
    for c, (places, change) in enumerate(moved):
        if len(places):
            out[:, c] += x[:, places] @ change
    return out


def assigned(dots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, the smaller number of equals."""
    return ((centroids * centroids).sum(axis=1) - 2 * dots).argmin(axis=1)


def _matrix(column: pa.ListArray, width: int, kind: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(values.ravel(), kind))


def moved_state(state: DataFrame, centroids: np.ndarray, moved: list[tuple[np.ndarray, np.ndarray]], first: bool) -> DataFrame:
    """The state after a move: dot products updated, or made from zero at ``first``, and vectors assigned anew."""
    k, dims = centroids.shape
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("dots", pa.list_(pa.int64())), ("cluster", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(1), dims, "<i8")
                dots = np.zeros((len(x), k), np.int64) if first else _matrix(part.column(2), k, "<i8")
                dots = updated(x, dots, moved)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(dots, pa.int64()),
                                                  pa.array(assigned(dots, centroids), pa.int32())], schema=schema)

    return state.mapInArrow(run, STATE)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids as exact floors of their vectors' component means; one without vectors stays."""
    k, dims = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            cluster, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dims, "<i8")
            counts += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            starts = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            if len(order):
                totals[cluster[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(counts), _lists(totals, pa.int64())], schema=schema)

    folded = state.select("cluster", "x").mapInArrow(fold, "cluster int, n long, total array<long>") \
        .select("cluster", "n", F.posexplode("total").alias("at", "part")) \
        .groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = centroids.copy()
    for row in folded.where("n > 0").collect():  # centroids x dimensions cells
        out[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    return out


def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
            seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of (vec_id, embedding).

    Kept are vectors of exactly ``dims`` components, none null or non-finite; null, empty, shorter and
    longer ones have no row. Repeated rows and ids are vectors of their own; a null id counts as a
    vector and starts a centroid only where ids are too few. With fewer than ``k`` vectors there are as
    many centroids as vectors; an empty table gives no rows. A component of 2**27 / ``scale`` or more
    fails the job, as its distance would not fit 64 bits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    whole = quantised(vectors, dims, scale)
    centroids = np.array(seeds(whole, k, seed), np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    folder = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}"
    moved = changes(np.zeros_like(centroids), centroids)
    state = _written(moved_state(whole, centroids, moved, True), f"{folder}/0")
    for step in range(rounds):
        after = means(state, centroids)
        moved, centroids = changes(centroids, after), after
        state = _written(moved_state(state, centroids, moved, False), f"{folder}/{step + 1}")
    return _with_distances(state, centroids)


RESULT = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
    T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])


def _with_distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    spark = state.sparkSession
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = spark.createDataFrame([(at, int((c * c).sum()), d) for at, (c, d) in enumerate(zip(centroids, digests, strict=True))],
                                  "cluster int, square long, centroid_sha256 string")
    square = F.aggregate("x", F.lit(0).cast("long"), lambda total, e: total + e.cast("long") * e)
    placed = state.join(F.broadcast(known), "cluster").select(  # one row per centroid
        "vec_id", "cluster", (square - 2 * F.get("dots", F.col("cluster")) + F.col("square")).alias("distance"), "centroid_sha256")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in sums)
    inertia = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total) for r in sums],
                                    "cluster int, cluster_inertia long, inertia long")
    return placed.join(F.broadcast(inertia), "cluster").select(*RESULT.fieldNames())
