from pyspark.sql import functions as F

from fieldscan.llm import common


def test_state_outlives_a_task_and_only_one_is_held(spark):
    def tally(key):
        def batch(rows):
            seen = common.worker_state(key, list)
            seen.append(1)
            return {"id": rows["id"], "n": [len(seen)] * len(rows["id"]), "keys": [len(common._held)] * len(rows["id"])}
        return batch

    rows = spark.range(0, 64, 1, 64)
    first = common.map_batches(rows, "id long, n long, keys long", tally("one")).agg(F.max("n"), F.max("keys")).first()
    assert first[0] > 1 and first[1] == 2
    common.map_batches(rows, "id long, n long, keys long", tally("two")).count()
    calls = []
    assert common.worker_state("a", lambda: calls.append("a") or 1) == 1 == common.worker_state("a", lambda: calls.append("a") or 2)
    assert common.worker_state("b", lambda: calls.append("b") or 3) == 3 and calls == ["a", "b"]
