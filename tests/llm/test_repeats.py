import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldscan.llm import repeats
from fieldscan.llm.registry import QUERIES, load
from tests.llm.helpers import documents, given

load()


def slow(rows):
    """Remove each byte that a repeated 200-byte string covers, window by window."""
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[k:k + 200] for _, d in data for k in range(len(d) - 199))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - 199):
            if count[d[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def test_given_documents(spark):
    got = Counter(tuple(r) for r in QUERIES["op5_repeated_strings"](spark, "/root/testdata/sf0.001").collect())
    want = slow([(d["doc_id"], d["text"]) for d in given()])
    assert got == want
    assert sum(r[2] for r in want) > 1000


def passages(seed):
    rng = random.Random(seed)

    def fresh(n):
        return "".join(rng.choice("abcdefgh ijklé語\n") for _ in range(n))

    shared = [fresh(n) for n in (150, 199, 200, 201, 260, 700)]
    texts = [None, "", "short", "a" * 1000, "ab" * 150, "a" * 199, "b" * 200, "語" * 100, fresh(3000)]
    texts += [fresh(rng.randrange(300)) + rng.choice(shared) + fresh(rng.randrange(300)) + rng.choice(shared) for _ in range(60)]
    return texts + texts[9:12] + [texts[-1]]


@pytest.mark.parametrize(("salted", "shard"), [(repeats.SEGMENTS, repeats.SHARD), (3, 1500)])
def test_hard_texts(spark, monkeypatch, salted, shard):
    monkeypatch.setattr(repeats, "SEGMENTS", salted)
    monkeypatch.setattr(repeats, "SHARD", shard)
    rows = list(enumerate(passages(4)))
    docs = documents(spark, rows).withColumn("row", F.lit("x")).withColumn("first", F.lit(1)).withColumn("spans", F.lit(2)).repartition(4)
    assert Counter(tuple(r) for r in repeats.digests(docs).collect()) == slow(rows)
    assert repeats.digests(docs.limit(0)).count() == 0


def test_merging_shards_equals_one_sort():
    texts = [t.encode() for t in passages(9) if t and len(t.encode()) >= 200][:12]
    whole = {}
    for text, own in zip(texts, repeats.repeated_windows(texts), strict=True):
        for k, interval in enumerate(own.tolist()):
            assert whole.setdefault(interval, text[k:k + 200]) == text[k:k + 200]
    assert len(set(whole.values())) == len(whole)
    parts = [[t + repeats.END for t in texts[i:i + 4]] for i in (0, 4, 8)]
    apart = repeats.merged_intervals([repeats.transform(p) for p in parts])
    once = repeats.merged_intervals([repeats.transform(sum(parts, []))])
    assert sorted(np.unique(np.concatenate(apart), return_counts=True)[1].tolist()) == \
        sorted(np.unique(np.concatenate(once), return_counts=True)[1].tolist())


def test_merge_carries_windows_only(monkeypatch):
    """No round of the merge sorts more rotations than there are windows, however long the segments around them."""
    sizes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda values, **how: sizes.append(len(values)) or sort(values, **how))
    shards = [repeats.transform([bytes(random.Random(n // 2).choices(range(97, 105), k=210)) + repeats.END]) for n in range(6)]
    sizes.clear()
    found = repeats.merged_intervals(shards)
    assert sizes and max(sizes) <= 6 * (211 - 200)
    shared = np.unique(np.concatenate(found), return_counts=True)[1]
    assert (shared == 2).sum() == 3 * (211 - 200)


def test_salts_of_one_anchor_are_merged_apart(monkeypatch):
    """Two salts of a hot anchor never meet in one merge once the bound is reached; their windows meet by digest."""
    monkeypatch.setattr(repeats, "MERGED", 1)
    texts = [bytes([97 + n] * 1) + bytes(random.Random(n // 2).choices(range(97, 105), k=230)) for n in range(8)]
    rows = [(5, n % 2, True, n, 0, texts[n]) for n in (0, 2, 4, 6, 1, 3, 5, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["anchor", "salt", "salted", "row", "first", "text"])
    out = [b.to_pylist() for b in repeats._merge(iter([batch]))]
    assert [{r["row"] % 2 for r in rows} for rows in out] == [{0}, {1}]
    met = Counter(r["digest"] for rows in out for r in rows if r["digest"] is not None)
    assert sum(n == 2 for n in met.values()) == 4 * (231 - 200)


def test_null_and_repeated_ids(spark):
    long = "".join(random.Random(6).choices("abcdefgh", k=400))
    rows = [(None, long), (None, "x" + long), (3, "q"), (3, "other " + long), (4, None), (-(1 << 63), "")]
    assert Counter(tuple(r) for r in repeats.digests(documents(spark, rows)).collect()) == slow(rows)
