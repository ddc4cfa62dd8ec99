import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fieldscan.llm import lexical
from fieldscan.llm.registry import ORACLES, QUERIES, load
from tests.llm.helpers import documents, given

load()
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, top=10):
    """Every document scored for every item; docs and items list (id, text)."""
    bags = [(doc, Counter(terms(text))) for doc, text in docs]
    bags = [(doc, bag, sum(bag.values())) for doc, bag in bags if bag]
    count, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    rows = []
    for item, wanted in asked.items():
        scored = []
        for doc, bag, n in bags:
            m = 100 - 90 + 90 * n * count // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t in wanted if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda s: s[:3])
        rows += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(scored[:top], 1)]
    return sorted(rows, key=str)


def got(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


def test_given_documents(spark):
    rows = got(QUERIES["op12_lexical_search"](spark, "/root/testdata/sf0.001"))
    assert rows == brute([(d["doc_id"], d["text"]) for d in given()], [(d["item_id"], d["text"]) for d in given(table="benchmark")])
    assert "op12_lexical_search" in ORACLES


def test_hard_texts_blocks_and_ties(spark, monkeypatch):
    docs = [(1, None), (2, ""), (3, " .,;\x00"), (4, "The the CAT"), (5, "the cat"), (6, "the cat"), (7, "ÉÉ été 12"), (8, "a" * 40000),
            (9, "the " * 30000 + "dog"), (6, "the cat"), (None, "the cat"), (-3, "cat-dog_fish"), (10, "語言 cat"), *((i, "cat cat tail") for i in range(20, 50))]
    items = [(1, "The cat's tail"), (2, None), (3, "zebra"), (4, "ÉÉ, dog DOG"), (5, "語言 " + " ".join(f"w{i}" for i in range(90)) + " cat"), (1, "dog"), (None, "été"), (7, "the")]
    frame = documents(spark, docs).withColumn("terms", F.lit("x")).withColumn("n", F.lit("y")).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("z"))
    wanted = brute(docs, items)
    for block, cells in ((lexical.BLOCK_TERMS, lexical.CELLS), (20, 256)):
        monkeypatch.setattr(lexical, "CELLS", cells)
        assert got(lexical.search(frame, asked, block_terms=block)) == wanted
    assert got(lexical.search(frame, asked, top=3)) == brute(docs, items, 3)
    assert lexical.search(frame.limit(0), asked).count() == 0
    assert lexical.search(frame, asked.limit(0)).count() == 0


def test_masks_group_documents_exactly():
    present = np.random.default_rng(1).random((70, 300)) < 0.02
    columns, member = lexical.masks(present)
    assert (columns[:, member] == present).all()
    assert len({c.tobytes() for c in columns.T}) == columns.shape[1]


def test_pruning_skips_masks_and_loses_nothing(monkeypatch):
    """Documents of a mask whose maximum is too small are never added up."""
    rng = np.random.default_rng(2)
    scores = np.where(rng.random((12, 4000)) < 0.3, rng.integers(1, 50, (12, 4000)), 0) * np.arange(1, 13)[:, None] ** 2
    seen = []
    best = lexical.Best(10)
    monkeypatch.setattr(lexical.Best, "add", lambda self, s, d, n, real=lexical.Best.add: (seen.append(len(s)), real(self, s, d, n)))
    lexical.search_chunk([best], [np.arange(12)], scores, scores > 0, np.arange(4000), np.zeros(4000, bool))
    total = scores.sum(axis=0)
    order = np.lexsort((np.arange(4000), -total))[:10]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == total[order].tolist()
    assert sum(seen) < 2000
