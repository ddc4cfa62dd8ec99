from pyspark.sql import functions as F

from fieldscan.llm import common


def test_batches_are_bounded_by_bytes_and_lose_no_row(spark):
    rows = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    long = spark.range(3000, 3002, 1, 1).select("id", F.repeat(F.lit("y"), 2 * common.BATCH_BYTES).alias("text"))

    def batch(rows):
        size = sum(map(len, rows["text"]))
        return {"id": rows["id"], "bytes": [size] * len(rows["id"]), "longest": [max(map(len, rows["text"]))] * len(rows["id"])}

    seen = common.map_batches(rows.union(long), "id long, bytes long, longest long", batch).collect()
    assert sorted(r.id for r in seen) == list(range(3002))
    assert max(r.bytes - r.longest for r in seen) <= common.BATCH_BYTES
    assert max(r.bytes for r in seen if r.id < 2900) <= common.BATCH_BYTES + 10_000
