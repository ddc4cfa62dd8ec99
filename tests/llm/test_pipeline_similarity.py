from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from fieldscan.llm import minhash
from tests.llm.helpers import documents, given
from tests.llm.test_near_duplicates import joined, slow_shingles

STAGES = dict(corpus_pipeline.STAGES)


def kept(rows, percent):
    """Ids of the smallest document of each group, by brute force."""
    sets = {i: slow_shingles(t) for i, t in rows}
    holding = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holding[x].add(i)
    both = Counter(pair for members in holding.values() for pair in combinations(sorted(members), 2))
    links = [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return {i for i, root in joined(list(sets), links).items() if i == root}


def planted():
    """Pairs of 104 words, so 100 shingles, that share 89 to 93 of them: similarities 0.80 to 0.87."""
    rows = []
    for n, last in enumerate([11, 10, 9, 8, 7] * 4):
        words = [f"p{n}w{k}" for k in range(104)]
        rows += [(20000 + 2 * n, " ".join(words)), (20001 + 2 * n, " ".join(words[:-last] + [f"q{n}w{k}" for k in range(last)]))]
    return rows


def test_stage_removes_what_is_similar_by_four_fifths(spark):
    rows = [(d["doc_id"], d["text"]) for d in given("sf0.01")] + planted()
    want = kept(rows, 80)
    assert len(kept(rows, 85) - want) > 12
    got = STAGES["near_duplicates"](spark, documents(spark, rows), "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)


def test_stage_on_hard_rows(spark):
    words = " ".join(f"h{k}" for k in range(60))
    rows = [(1, words), (2, words), (2, words + " z"), (3, "b c d e f"), (3, "a c d e f"), (3, "a c d e f"), (4, None), (5, ""), (None, words)]
    docs = documents(spark, rows).withColumn("row", F.lit(1)).withColumn("kept", F.lit(True))
    got = STAGES["near_duplicates"](spark, docs, "/root/testdata/sf0.001")
    assert tuple(got.columns) == corpus_pipeline.COLUMNS
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, words), (3, "a c d e f"), (4, None), (5, "")}
    assert got.count() == 4


def test_op9_keeps_its_own_similarity(spark):
    rows = planted()
    got = minhash.near_duplicates(documents(spark, rows)).filter("kept").collect()
    assert {r.doc_id for r in got} == kept(rows, 85) != kept(rows, 80)


def test_layouts_meet_their_bounds():
    assert (minhash.OP9.symbols, minhash.OP9.distance, minhash.OP9.confirm) == (40, 15, 20)
    rng = np.random.default_rng(0)
    for percent in (80, 85, 95):
        layout = minhash.Layout(percent)
        wrong = rng.random((200_000, layout.chunks, minhash.CHUNK)) >= percent / 100
        assert ((wrong.sum(axis=2) <= minhash.ERRORS).any(axis=1)).mean() > 0.9999
        assert (wrong.sum(axis=(1, 2)) <= layout.confirm).mean() > 0.9999
        base = rng.integers(0, 1 << 16, layout.symbols).astype("<u2")
        for _ in range(200):
            other = base.copy()
            other[rng.choice(layout.symbols, layout.distance, replace=False)] += np.uint16(1)
            keys = minhash.bucket_keys(np.stack([base, other]), layout)
            assert (keys[0] == keys[1]).any()
