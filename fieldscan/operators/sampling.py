"""Exact-size samples and membership digests that ignore partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscan import constants as C
from fieldscan.operators.lookup import lookup_join
from fieldscan.session import checkpointed

FANOUT_BITS = 16


def sample_order(identity: Column, seed: int) -> Column:
    """A seeded pseudo-random sort key that depends on the row's identity only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), identity.cast("string")))


def exact_sample(rows: DataFrame, identity: str, size: int, seed: int = C.MODEL_SEED) -> DataFrame:
    """``size`` rows without replacement (all when fewer); a distributed top-k."""
    return rows.orderBy(sample_order(F.col(identity), seed), identity).limit(size)


def exact_sample_by(rows: DataFrame, keys: list[str], identity: str, size: int,
                    seed: int = C.MODEL_SEED) -> DataFrame:
    """``size`` rows per group without replacement; all of a smaller group.

    The sort key is uniform, so its leading digits cut a group of n rows to
    about 2 * size before anything is shuffled, and the first ``size`` rows by
    key are always among those. Counting the groups costs one narrow scan; a
    cut that kept too few rows would fail the job, not shorten the sample.
    """
    sizes = checkpointed(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    known = sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("weight")).first()
    keyed = lookup_join(rows, sizes, keys, "_n", known["groups"], known["weight"] or 0) \
        .withColumn("_key", sample_order(F.col(identity), seed))
    share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") / F.lit(float(2 ** 32))
    near = keyed.where(share * F.col("_n") < 2 * size + 64)
    group = Window.partitionBy(*keys)
    placed = near.withColumns({"_position": F.row_number().over(group.orderBy("_key", identity)),
                               "_near": F.count(F.lit(1)).over(group)})
    enough = F.when(F.col("_near") >= F.least(F.col("_n"), F.lit(size)), F.lit(True)) \
        .otherwise(F.raise_error(F.lit("sample cut kept too few rows")).cast("boolean"))
    return placed.where(enough & (F.col("_position") <= size)).drop("_key", "_n", "_position", "_near")


def membership_digest(rows: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """(keys, members, digest): SHA-256 tree over sorted 64-bit ids.

    Each level hashes at most 2**16 children in order, so no task ever holds
    more than one block, whatever the size of the group.
    """
    level = rows.select(*keys, F.col(identity).cast("bigint").alias("id")).distinct()
    level = level.select(*keys, F.shiftright("id", FANOUT_BITS).alias("block"), F.col("id").alias("child"),
                         F.col("id").cast("string").alias("text"), F.lit(1).cast("bigint").alias("members"))
    for depth in range(4):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("child", "text"))), lambda s: s["text"])
        level = level.groupBy(*keys, "block").agg(
            F.sha2(F.array_join(ordered, ","), 256).alias("text"), F.sum("members").alias("members"))
        if depth < 3:
            level = level.select(*keys, F.shiftright("block", FANOUT_BITS).alias("block"),
                                 F.col("block").alias("child"), "text", "members")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda s: s["text"])
    return level.groupBy(*keys).agg(F.sum("members").alias("members"), F.sha2(F.array_join(ordered, ","), 256).alias("digest"))
