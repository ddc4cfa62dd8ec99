"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis).

Only DataFrame functions. Each document gets the key -ln(u) / w, u a hash of its id in (0, 1) and
w its quality weight; ascending keys are a weighted random order. Within a source, whole epochs
come first; what is left of the target is taken in key order until the words are used up, the last
document in part. The running sum of a source is cut into key ranges of bounded expected size, so
a source that holds most rows is summed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldscan.llm.common import WORD, stored

#: Weights given to the sources in code-point order, repeating.
SOURCE_WEIGHTS = (1, 2, 3)
#: No source's target exceeds so many times its size.
MOST_EPOCHS = 3
#: Expected rows of one key range of a source.
RANGE_ROWS = 2048


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_text: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of the id's MD5; the same on every run and cluster."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_text, F.lit("null")), F.lit(seed)).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Target words per source from (source, source_size, source_rows).

    Sources in code-point order, null last, weigh as ``weights`` repeats. Targets share all words by
    weight; capped ones leave their excess to the others, by weight: the level ``l`` with
    ``sum(min(cap, l * weight)) = total``. One row per source goes through one window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((place - 1) % len(weights)) + 1).cast("int"))
    ranked = sizes.select("*", place.alias("source_no"), weight.alias("weight"))
    ranked = ranked.select("*", (F.col("source_size") * float(most)).alias("cap"),
                           (F.col("source_size") * float(most) / F.col("weight")).alias("ratio"))
    by_ratio = Window.orderBy("ratio", "source_no")
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every).cast("double")
    spent = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.select("*", ((total - spent) / rest).alias("level"))
    level = F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(every)
    ranked = ranked.select("*", level.alias("final_level"))
    target = F.when(F.col("final_level").isNull() | (F.col("ratio") <= F.col("final_level")), F.col("cap")) \
        .otherwise(F.col("final_level") * F.col("weight"))
    return ranked.select("source", "source_no", "source_size", "source_rows", target.alias("target"))


def mix(docs: DataFrame, quality: Column | None = None, size: Column | None = None, weights: tuple[int, ...] = SOURCE_WEIGHTS,
        most: int = MOST_EPOCHS, seed: str = ":mix", keep: list[str] | None = None) -> DataFrame:
    """Words each document of ``docs`` (doc_id, text, source) gives to the mix.

    Returns one row per input row: doc_id, ``keep`` columns, source_no, size, source_size, target,
    taken. ``quality`` is a positive weight per document (default 1; null or not positive counts
    as 1). ``size`` is the words of a document (default: counted in ``text``). Null or empty texts have size 0 and give nothing; a null source is a source of its own,
    the last. Repeated rows are separate documents; equal keys are ordered by id, then size. An
    empty table gives no rows.
    """
    given = F.lit(1.0) if quality is None else quality.cast("double")
    worth = F.when((given > 0) & (given < float("inf")), given).otherwise(1.0)
    names = keep or []
    sized = docs.select("doc_id", "source", *names, (word_count(F.col("text")) if size is None else size).alias("size"),
                        (-F.log(uniform(F.col("doc_id").cast("string"), seed)) / worth).alias("key"))
    sized = stored(sized, "mix-sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    targets = source_targets(sizes, weights, most)
    ranges = F.ceil(F.col("source_rows") / RANGE_ROWS)
    part = F.least(F.floor((1 - F.exp(-F.col("key"))) * ranges), ranges - 1).cast("long")
    placed = sized.join(targets.withColumnRenamed("source", "of_source"),
                        F.col("source").eqNullSafe(F.col("of_source")))
    placed = placed.drop("of_source").withColumn("part", part)
    starts = placed.groupBy("source_no", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source_no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("source_no", "part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("source_no", "part").orderBy("key", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(starts, ["source_no", "part"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor("target") - epochs * F.col("source_size") - F.col("start") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return placed.select("doc_id", *names, "source_no", "size", "source_size", "target", taken.cast("long").alias("taken"))


def copies(mixed: DataFrame) -> DataFrame:
    """Rows of a mix as documents: a text once per whole copy taken, a last partial copy cut at its words.

    Takes (text, size, taken and any other columns); a document with nothing taken gives no row.
    """
    times = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    repeated = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).filter("taken > 0")
    words = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    parts = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    first = F.array_join(F.slice(parts, 1, F.greatest(words, F.lit(0)).cast("int")), "")
    return repeated.withColumn("text", F.when(words >= F.col("size"), F.col("text")).otherwise(first)).drop("copy")
