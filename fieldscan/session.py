"""Session settings and the two places where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # The JVM never compiles a method beyond 8000 bytes of bytecode; such stages
    # run several times faster without whole-stage code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
#: Rows of a task that folds nearly distinct keys: some 50 MB of groups.
ROWS_PER_TASK = 500_000
PER_QUERY = ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit")


def build_session(app: str = "fieldscan", master: str | None = None, **settings: str) -> SparkSession:
    """A UTC session with adaptive execution on; ANSI mode keeps its default (on)."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Settings a foreign session may lack: day keys are UTC dates, and see above."""
    for key in PER_QUERY:
        if spark.conf.get(key, None) != SETTINGS[key]:
            spark.conf.set(key, SETTINGS[key])


def checkpointed(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder.

    Used where two branches must see one evaluation (partition ids, sketch
    bounds). The folder comes from ``spark.checkpoint.dir``; a temporary one is
    made only on a local master, where it is shared by definition.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        configured = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if configured:
            context.setCheckpointDir(configured)
        elif context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldscan-checkpoint-"))
        else:
            raise RuntimeError("Set spark.checkpoint.dir to a folder all executors share")
    return frame.checkpoint()


def spread(frame: DataFrame) -> DataFrame:
    """Deal the rows to as many partitions as there are cores, if the scan has fewer.

    A small file is one partition, however dear its rows are to fit and score. Large scans stay as they are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def dealt_by(frame: DataFrame, *columns: str | Column, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows with the same ``columns`` in one partition, of about ``rows_per_task`` rows however large the table is.

    For an aggregate with nearly a group per row, whose table of groups would otherwise grow with the scan's split and
    the number of shuffle partitions. Smaller frames keep the usual number of shuffle partitions. The rows are counted,
    which reads no column of a plain scan.
    """
    usual = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(max(usual, -(-frame.count() // rows_per_task)), *columns)
