"""Helpers the training-data operators share: reading, storing, Arrow mapping, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"

Columns = dict[str, list]
#: Bytes of an Arrow batch on its way to Python. Spark's own limit of 10 000 rows is 10 000 texts, or pairs of sets, however
#: long they are; the JVM's buffers and the worker's columns hold each batch several times.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share")
    base = tempfile.mkdtemp(prefix="fieldscan-shared-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def stored(frame: DataFrame, label: str, rows_a_file: int = 0) -> DataFrame:
    """Write a frame to the shared folder and read it back: evaluated once, lineage cut, safe from lost executors.

    With ``rows_a_file``, no file has more rows, so that few long rows are read by several tasks.
    """
    path = f"{shared_folder(frame.sparkSession)}/{label}-{uuid.uuid4().hex}"
    frame.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def map_arrow(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of about BATCH_BYTES; a longer row is alone, or the last of its batch.

    Spark reads the limit when the frame is executed, so it stays with the session. Results do not depend on it.
    """
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return frame.mapInArrow(run, schema)


def map_batches(frame: DataFrame, schema: str, function: Callable[[Columns], Columns]) -> DataFrame:
    """Apply a function of column lists to every Arrow batch of a frame."""
    names = T.StructType.fromDDL(schema).fieldNames()
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays(
                    [_array(out[n], arrow.field(n).type) for n in names], schema=arrow)

    return map_arrow(frame, run, schema)


_held: dict = {}


def worker_state(key, make: Callable[[], object]):
    """What a Python worker keeps between tasks, made once for each ``key``.

    A worker holds one thing at a time: another key drops it first, so the stages of a pipeline do not add up.
    To be called inside tasks; a module's own dictionary would travel with each task and start empty.
    """
    if _held.get("key") != key:
        _held.clear()
        _held.update(key=key, value=make())
    return _held["value"]


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values in a text or binary column have about ``most`` bytes; a longer value is alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        reach = (sizes[at - 1] if at else 0) + most
        stop = max(at + 1, int(np.searchsorted(sizes, reach, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(T.StructType.fromDDL(schema))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, component_id) of every id that occurs in ``edges`` (u, v); the component is its smallest id.

    Alternating stars: each round links every node's larger neighbours, then its smaller ones, to
    the smallest neighbour it knows. Rounds grow with the logarithm of the number of nodes. Repeated
    edges and loops are allowed. A hub's edges stay one row each and are dealt by hash and join, so
    no task needs a hub's whole neighbourhood in memory.
    """
    both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    current, before = stored(both, label), None
    while True:
        large = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = large.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        star = large.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.filter("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        star = star.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.union(low.select("u", F.col("m").alias("v"))).distinct()
        current = stored(star, label)
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    member = current.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return member.union(member.select(F.col("component_id").alias("id"), "component_id").distinct())
