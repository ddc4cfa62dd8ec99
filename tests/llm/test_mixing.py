import math

import duckdb
from pyspark.sql import functions as F

from fieldscan.llm import mixing
from fieldscan.llm.registry import ORACLES, QUERIES, load
from tests.helpers import normalized
from tests.llm.helpers import documents

load()


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, sql in ORACLES.items():
        assert normalized(QUERIES[name](spark, folder).toPandas()) == normalized(duck.sql(sql).df()), name


def slow_targets(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        target = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if target[s] > most * sizes[s]]
        if not above:
            return target | capped
        capped |= {s: most * sizes[s] for s in above}


def test_targets_and_bounds(spark):
    words = {"a": 1, "b": 40, "c": 2, "é": 100, "z": 7, None: 3}
    rows = [(i, "w " * (1 + i % 5), None, s) for i, s in enumerate(s for s, n in words.items() for _ in range(n))]
    rows += [(999, None, None, "a"), (1000, "", None, "empty"), (5, "again and again", None, "b"), (5, "again and again", None, "b")]
    docs = documents(spark, rows).withColumn("key", F.lit("x")).withColumn("size", F.lit(3)).withColumn("taken", F.lit(0))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[3] for r in rows}
    sizes, taken, targets = {}, {}, {}
    for r in got:
        s = by_id[r.doc_id]
        sizes[s], taken[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r.taken
        targets[s] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    want = slow_targets(sizes, (1, 2, 3), 3)
    for s in sizes:
        assert math.isclose(targets[s], want[s], abs_tol=1e-6)
        assert abs(taken[s] - targets[s]) < 1 + 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_quality_raises_the_chance(spark):
    docs = documents(spark, [(i, "a b", None, "big") for i in range(3000)] + [(i, "c", None, "a") for i in range(9000, 12000)])
    mixed = mixing.mix(docs, F.when(F.col("doc_id") % 2 == 0, 8.0).otherwise(F.lit(float("nan"))), weights=(3, 1), most=3).collect()
    even = sum(r.taken for r in mixed if r.doc_id < 9000 and r.doc_id % 2 == 0)
    odd = sum(r.taken for r in mixed if r.doc_id < 9000 and r.doc_id % 2)
    assert even > 1.5 * odd


def test_copies_take_effect(spark):
    frame = spark.createDataFrame([(1, "a  b\nc", 3, 7), (2, "x", 1, 0), (3, "p q", 2, 2), (4, None, 0, 0)],
                                  "doc_id long, text string, size long, taken long")
    assert sorted((r.doc_id, r.text) for r in mixing.copies(frame).collect()) == [(1, "a"), (1, "a  b\nc"), (1, "a  b\nc"), (3, "p q")]
