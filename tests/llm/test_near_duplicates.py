import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldscan.llm import common, embeddings, minhash
from fieldscan.llm.registry import QUERIES, load
from tests.llm.helpers import documents, given

load()


def joined(ids, links):
    """Smallest id reachable from each."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {i: find(i) for i in ids}


def slow_vectors(rows, threshold=0.9):
    ids, units = [], []
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            ids.append(i)
            units.append(np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)))
    links = [(ids[x], ids[y]) for x in range(len(ids)) for y in range(x)
             if len(units[x]) == len(units[y]) and units[x] @ units[y] >= threshold]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    comp = joined([i for i, _ in rows], links)
    return {(i, count[i], comp[i], comp[i] == i) for i, _ in rows}


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(40, 90)] + [(500, i) for i in range(100, 160)] + [(7, 7), (3, 2), (2, 3), (2, 3)]
    random.Random(1).shuffle(edges)
    got = common.components(spark.createDataFrame(edges, "u long, v long"), "test").collect()
    nodes = {x for e in edges for x in e} - {7}
    assert {r.id: r.component_id for r in got} == joined(nodes, [e for e in edges if e[0] != 7])
    assert len(got) == len(nodes)
    assert common.components(spark.createDataFrame([], "u long, v long"), "test").count() == 0


@pytest.mark.parametrize("tile", [embeddings.TILE, 64])
def test_embeddings_of_the_given_table(spark, tile):
    folder = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = {tuple(r) for r in embeddings.near_duplicates(frame, tile=tile).select("vec_id", "n_links", "component_id", "kept").collect()}
    assert got == slow_vectors([(r["vec_id"], r["embedding"]) for r in given(table="embeddings")])


def test_hard_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, (base + rng.normal(size=8) * 0.25).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [0.0] * 8), (103, [1.0, None] + [0.0] * 6), (104, [float("nan")] * 8), (105, [float("inf")] * 8),
             (106, [1e-30, 0.0]), (107, [2.5, 0.0]), (108, [0.9, 0.43588989]), (109, [1.0, 0.0]), (110, [1.0, 0.0]), (111, [-1.0, 0.0]), (112, [1.0])]
    frame = spark.createDataFrame(rows + [(None, [1.0, 0.0])], "vec_id long, embedding array<double>") \
        .withColumn("rep", F.lit("x")).withColumn("n", F.lit(0))
    got = {tuple(r) for r in embeddings.near_duplicates(frame).collect()}
    assert got == slow_vectors(rows) | {(None, 0, None, False)}
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_repeats_widths_and_lengths(spark):
    """Copies in other partitions, doubles that single precision does not hold, long and short vectors in small blocks."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=5) + [2, 1, 0, 0, 0]).tolist()) for i in range(150)]
    rows += [(i, np.float32(rng.normal(size=10)).astype(float).tolist()) for i in range(150, 300)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(60)] + [(500 + i, rows[160][1]) for i in range(60)]
    rows += [(600, [-0.0] + rows[0][1][1:]), (601, [0.0] + rows[0][1][1:]), (602, [1e60, 1e-60]), (603, [1e-60, 0.0])]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    for tile in (20, embeddings.TILE):
        got = {tuple(r) for r in embeddings.near_duplicates(frame, tile=tile).select("vec_id", "n_links", "component_id", "kept").collect()}
        assert got == slow_vectors(rows)


def test_disk_grows_with_the_table_not_with_its_tiles(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [Path(d.getPath()) for d in local] + [Path(common.shared_folder(spark).removeprefix("file:"))]

    def used():
        return sum(f.stat().st_size for d in folders for f in d.rglob("*") if f.is_file())

    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2000, 64)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = used()
    got = embeddings.near_duplicates(frame, tile=20).collect()  # 100 blocks
    assert len(got) == 2000 and not any(r["n_links"] for r in got)
    assert used() - before < 10 * 2000 * 64 * 8


def test_every_pair_of_a_dense_tile():
    """All vectors alike, some pairs at the threshold: links and components of a task equal a brute force."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=16) * 2 + rng.normal(size=(700, 16))
    sides = []
    for part in (vectors[:300], vectors[300:]):
        ids, copies = np.arange(len(part)) + 1000 * len(sides), np.arange(len(part)) % 3 + 1
        sides.append(embeddings.unpacked(16, *(pa.py_buffer(x.tobytes()) for x in (ids, copies, part))))
    found = embeddings.Found()
    places = [found.place((16, k), s) for k, s in enumerate(sides)]
    for x, y in ((0, 0), (0, 1), (1, 1)):
        for i, j in embeddings.linked(sides[x], sides[y], x == y, 0.9):
            found.add(sides[x], sides[y], places[x], places[y], i, j)
    rows = found.rows().to_pylist()
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = units @ units.T >= 0.9
    np.fill_diagonal(links, False)
    ids, copies = np.concatenate([s.reps for s in sides]), np.concatenate([s.copies for s in sides])
    assert 0.1 < links.mean() < 0.9
    assert {r["u"]: r["n"] for r in rows if r["v"] is None} == {int(u): n for u, n in zip(ids, links @ copies, strict=True) if n}
    edges = [(r["u"], r["v"]) for r in rows if r["v"] is not None]
    assert len(edges) < len(ids)
    assert joined(ids.tolist(), edges) == joined(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in np.argwhere(links)])


def test_error_bound_holds():
    rng = np.random.default_rng(2)
    parts = [embeddings.quantise(rng.standard_t(1.5, size=32).tobytes()) for _ in range(200)]
    for u, q, s, e in parts:
        for v, r, t, f in parts[:40]:
            assert abs(u @ v - s * t * (q.astype(int) @ r.astype(int))) <= e + f + e * f


def slow_shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def slow_documents(rows, percent=85):
    sets = {i: slow_shingles(t) for i, t in rows}
    holding = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holding[x].append(i)
    tested, links = set(), []
    for members in holding.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in tested:
                    tested.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        links.append((a, b))
    comp = joined(list(sets), links)
    return {(i, len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def test_minhash_of_the_given_documents(spark):
    got = {tuple(r) for r in QUERIES["op9_minhash_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    want = slow_documents([(d["doc_id"], d["text"]) for d in given("sf0.01")])
    assert got == want
    assert sum(not r[3] for r in want) > 10


def family(seed, size, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("small", [minhash.SMALL, 4])
def test_minhash_on_hard_families(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 4000)
    texts = family(1, 60, 200, 9) + family(2, 40, 60, 3) + family(3, 30, 400, 30)
    texts += [None, "", "  \n", "One two", "one TWO", "a b c d e", "A b c d e f", "É a b c d", "é a b c d", "z " * 30000, "z " * 9]
    rows = list(enumerate(texts))
    docs = documents(spark, rows[::-1] + [rows[0]]).withColumn("digest", F.lit(1)).withColumn("kept", F.lit("x"))
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 1
    assert {tuple(r) for r in got} == slow_documents(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_tiles_return_a_forest(spark, monkeypatch):
    """A large group of which only some pairs are similar enough: rows grow with the members, the components are those of all links."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    made = []
    tiles = minhash._tiles
    monkeypatch.setattr(minhash, "_tiles", lambda *given: made.append(common.stored(tiles(*given), "test-tiles")) or made[0])
    rows = list(enumerate(family(8, 150, 100, 7)))
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    assert {tuple(r) for r in got} == slow_documents(rows)
    assert made[0].count() < 150 * minhash.SYMBOLS


def test_tile_shares_are_those_of_the_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, size).astype(np.uint64)) for size in (1, 40, 90, 5, 300)]
    held = minhash._Sets([s.tobytes() for s in sets])
    for x in range(len(sets)):
        others = np.array([y for y in range(len(sets)) if y != x])
        assert held.shared(x, others).tolist() == [len(np.intersect1d(sets[x], sets[y])) for y in others]


def test_rows_of_one_id_share_links(spark):
    near = family(4, 2, 200, 2)
    rows = [(1, near[0]), (5, "q w e r t y"), (5, near[1]), (5, near[1]), (9, "q w e r t y"), (7, "u i o"), (None, near[0]), (5, None)]
    got = {tuple(r) for r in minhash.near_duplicates(documents(spark, rows)).select("doc_id", "component_id", "kept").collect()}
    assert got == {(1, 1, True), (5, 1, False), (9, 1, False), (7, 7, True), (None, None, False), (5, 5, True)}


def test_keys_guarantee_the_distance():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 16, minhash.SYMBOLS).astype("<u2")
    for _ in range(500):
        other = base.copy()
        other[rng.choice(minhash.SYMBOLS, minhash.DISTANCE, replace=False)] += np.uint16(1)
        keys = minhash.bucket_keys(np.stack([base, other]))
        assert (keys[0] == keys[1]).any()
