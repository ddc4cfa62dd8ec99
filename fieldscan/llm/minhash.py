"""Near-duplicate documents by MinHash signatures joined under Hamming distance.

A signature has min-hashes of 16 bits, CHUNK of them in each chunk; a Layout says how many chunks a
similarity needs. Two signatures that differ in fewer than ``chunks * (ERRORS + 1)`` symbols have, by
the pigeonhole principle, a chunk with at most ERRORS = 1 wrong symbol. The allowed errors are enumerated: a chunk gives one key for each symbol
left out, so such a pair shares a key for certain. Every shared key is a bucket.

Buckets are not paired out. First each bucket's most central member (the one with the most bucket
mates overall) is compared with the others; then only members whose components still differ are
compared, in small buckets by a join, in large ones tile by tile, each pair once, in the first
bucket it shares. Tiles hold full sets and return a forest, so their rows grow with the members.
All links are confirmed on full shingle sets. The result is exact for all pairs
within the signature distance and for those further apart that share a bucket; a pair at the
similarity threshold shares none with probability below 1e-6 (and is then missed only if no chain
of other links joins it).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscan.llm.common import Columns, components, map_batches, stored, worker_state

SHINGLE = 5
#: Documents are linked when intersection * 100 >= percent * union; this is the percent of op9.
PERCENT = 85
CHUNK, ERRORS = 5, 1
#: Of pairs at the threshold, at most these shares have no key in common, and lie beyond the confirm distance.
NO_KEY, BEYOND = 1e-6, 5e-8


@dataclass(frozen=True)
class Layout:
    """The signature that a similarity of ``percent`` needs; each symbol of a pair is wrong with probability 1 - similarity."""

    percent: int
    chunks: int = field(init=False)
    #: Pairs that share a bucket are confirmed up to this signature distance.
    confirm: int = field(init=False)

    def __post_init__(self) -> None:
        if not 50 <= self.percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        same = self.percent / 100
        wrong = 1 - same
        shared = sum(math.comb(CHUNK, k) * wrong**k * same**(CHUNK - k) for k in range(ERRORS + 1))
        chunks = 1
        while (1 - shared)**chunks > NO_KEY:
            chunks += 1
        symbols, beyond, confirm = chunks * CHUNK, 1.0, -1
        while beyond > BEYOND and confirm < symbols:
            confirm += 1
            beyond = sum(math.comb(symbols, k) * wrong**k * same**(symbols - k) for k in range(confirm + 1, symbols + 1))
        object.__setattr__(self, "chunks", chunks)
        object.__setattr__(self, "confirm", confirm)

    @property
    def symbols(self) -> int:
        return self.chunks * CHUNK

    @property
    def distance(self) -> int:
        """Pairs within this signature distance surely share a bucket."""
        return self.chunks * (ERRORS + 1) - 1


OP9 = Layout(PERCENT)
SYMBOLS, DISTANCE = OP9.symbols, OP9.distance
#: Buckets up to this size are joined with themselves; larger ones go tile by tile.
SMALL, TILE = 32, 2048
#: Shingles that one side of a tile has on average, at most; a document of more is whole in its part.
TILE_SHINGLES = 1_000_000
#: Distinct words whose hashes a Python worker remembers.
REMEMBERED = 200_000

MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@cache
def _draws(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """What each symbol's hash is made with: a flip and an odd factor."""
    random = np.random.default_rng(2024)
    flip = random.integers(0, 1 << 63, symbols, np.uint64)
    return flip, random.integers(0, 1 << 63, symbols, np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's ``size``-word shingles; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known: _Hashes = worker_state("shingle words", _Hashes)
    values = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(known) > REMEMBERED:
        known.clear()
    width = min(size, len(words))
    mixed = values[:len(values) - width + 1].copy()
    for k in range(1, width):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * MULTIPLY + values[k:len(values) - width + 1 + k]
    if width < size:
        mixed += np.uint64(width)
    return np.unique((mixed ^ (mixed >> np.uint64(31))) * MULTIPLY)


def signature(found: np.ndarray, layout: Layout = OP9) -> np.ndarray:
    """The layout's 16-bit min-hashes of a non-empty set."""
    flip, factor = _draws(layout.symbols)
    low = None
    for at in range(0, len(found), 2048):
        part = ((found[at:at + 2048, None] ^ flip) * factor).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return (((low ^ (low >> np.uint64(32))) * MULTIPLY) >> np.uint64(48)).astype("<u2")


def bucket_keys(signatures: np.ndarray, layout: Layout = OP9) -> np.ndarray:
    """For each row of signatures a key per symbol: chunk by chunk, one symbol left out at a time."""
    rows = len(signatures)
    chunks = signatures.reshape(rows, layout.chunks, CHUNK).astype(np.uint64)
    keys = np.empty((rows, layout.chunks, CHUNK), np.uint64)
    for left_out in range(CHUNK):
        packed = np.zeros((rows, layout.chunks), np.uint64)
        for k in range(CHUNK):
            if k != left_out:
                packed = (packed << np.uint64(16)) | chunks[:, :, k]
        place = (np.arange(layout.chunks, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(left_out + 1)) * MULTIPLY
        packed = (packed ^ place) * MULTIPLY
        keys[:, :, left_out] = packed ^ (packed >> np.uint64(29))
    return keys.reshape(rows, layout.symbols).view(np.int64)


def signed(docs: DataFrame, layout: Layout = OP9) -> DataFrame:
    """(doc_id, digest, n_shingles, signature); equal sets share a digest, an empty set has none."""
    def batch(rows: Columns) -> Columns:
        out: Columns = {c: [] for c in ("doc_id", "digest", "n_shingles", "signature")}
        for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
            found = shingles(text)
            some = len(found) > 0 and doc is not None
            out["doc_id"].append(doc)
            out["digest"].append(xxhash.xxh3_128_digest(found.tobytes()) if some else None)
            out["n_shingles"].append(len(found))
            out["signature"].append(signature(found, layout).tobytes() if some else None)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                       "doc_id long, digest binary, n_shingles long, signature binary", batch)


def _keyed(classes: DataFrame, layout: Layout) -> DataFrame:
    def batch(rows: Columns) -> Columns:
        keys = bucket_keys(np.frombuffer(b"".join(rows["signature"]), "<u2").reshape(-1, layout.symbols), layout)
        place = pa.array(np.repeat(np.arange(len(keys)), layout.symbols))
        return {"key": pa.array(keys.ravel()), "rep": pa.array(rows["rep"], pa.int64()).take(place)}

    return map_batches(classes.select("rep", "signature"), "key long, rep long", batch)


def _close(pairs: DataFrame, classes: DataFrame, layout: Layout) -> DataFrame:
    """Pairs (a, b) whose sizes allow a link and whose signatures are within the confirm distance."""
    def batch(rows: Columns) -> Columns:
        left = np.frombuffer(b"".join(rows["sa"]), "<u2").reshape(-1, layout.symbols)
        right = np.frombuffer(b"".join(rows["sb"]), "<u2").reshape(-1, layout.symbols)
        near = np.flatnonzero((left != right).sum(axis=1) <= layout.confirm)
        return {c: [rows[c][i] for i in near] for c in ("a", "b")}

    own = classes.select("rep", "n", "signature")
    joined = pairs.join(own.toDF("a", "na", "sa"), "a").join(own.toDF("b", "nb", "sb"), "b") \
        .filter(100 * F.least("na", "nb") >= layout.percent * F.greatest("na", "nb"))
    return map_batches(joined.select("a", "b", "sa", "sb"), "a long, b long", batch)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of the documents in ``wanted`` (rep), repeated rows once."""
    return docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")) \
        .join(wanted, "rep", "left_semi").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, layout: Layout) -> DataFrame:
    """Edges (u, v) of the pairs whose full sets are similar enough.

    Sets are derived again for the documents in question only, found by a shuffle join on the id.
    """
    pairs = stored(pairs, "minhash-pairs")
    wanted = stored(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "minhash-wanted")

    def sets(rows: Columns) -> Columns:
        return {"rep": rows["rep"], "shingles": [shingles(text).tobytes() for text in rows["text"]]}

    full = stored(map_batches(_texts(docs, wanted), "rep long, shingles binary", sets), "minhash-sets")

    def similar(rows: Columns) -> Columns:
        out: Columns = {"u": [], "v": []}
        for a, b, sa, sb in zip(rows["a"], rows["b"], rows["xa"], rows["xb"], strict=True):
            x, y = np.frombuffer(sa, "<u8"), np.frombuffer(sb, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= layout.percent * (len(x) + len(y) - both):
                out["u"].append(a)
                out["v"].append(b)
        return out

    joined = pairs.join(full.toDF("a", "xa"), "a").join(full.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
    return map_batches(joined, "u long, v long", similar)


class _Sets:
    """The shingle sets of a tile, and how many shingles one shares with others."""

    def __init__(self, sets: list[bytes]) -> None:
        self.sizes = np.array([len(s) // 8 for s in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        distinct, self.numbers = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True)
        self.marked = np.zeros(len(distinct), bool)

    def shared(self, x: int, others: np.ndarray) -> np.ndarray:
        mine = self.numbers[self.starts[x]:self.starts[x] + self.sizes[x]]
        self.marked[mine] = True
        sizes = self.sizes[others]
        begin = np.cumsum(sizes) - sizes
        places = np.arange(sizes.sum()) + np.repeat(self.starts[others] - begin, sizes)
        counts = np.add.reduceat(self.marked[self.numbers[places]].astype(np.int64), begin)
        self.marked[mine] = False
        return counts


def _tile(group: pa.Table, layout: Layout) -> list[tuple[int, int]]:
    """Edges of a forest that joins what the tile's links join; pairs that are joined already are not compared."""
    own, rep = group["own"].to_numpy(), group["rep"].to_numpy()
    signs = np.frombuffer(b"".join(group["signature"].to_pylist()), "<u2").reshape(-1, layout.symbols)
    keys, key = bucket_keys(signs, layout), group["key"][0].as_py()
    sets = _Sets(group["shingles"].to_pylist())
    n, label = sets.sizes, np.unique(group["comp"].to_numpy(), return_inverse=True)[1]
    within = group["i"][0].as_py() == group["j"][0].as_py()
    first = np.flatnonzero(own == 0)
    second = first if within else np.flatnonzero(own == 1)
    edges: list[tuple[int, int]] = []
    for x in first:
        y = second[(label[second] != label[x]) & (100 * np.minimum(n[second], n[x]) >= layout.percent * np.maximum(n[second], n[x]))]
        y = y[y > x] if within else y
        y = y[(signs[y] != signs[x]).sum(axis=1) <= layout.confirm]
        if len(y):
            same = keys[y] == keys[x]
            y = y[same.any(axis=1) & (keys[x][same.argmax(axis=1)] == key)]
        if len(y):
            both = sets.shared(x, y)
            y = y[100 * both >= layout.percent * (n[x] + n[y] - both)]
            met, at = np.unique(label[y], return_index=True)
            edges += [(rep[x], rep[z]) for z in y[at]]
            label[np.isin(label, met)] = label[x]
    return edges


def _tiles(members: DataFrame, docs: DataFrame, layout: Layout) -> DataFrame:
    """Forest edges (u, v) within large buckets, from (key, rep, comp).

    A bucket is cut into parts by its members and by their shingles; every two parts meet in a tile,
    with full sets, so links are confirmed where they are found.
    """
    def sets(rows: Columns) -> Columns:
        found = [(rep, shingles(text)) for rep, text in zip(rows["rep"], rows["text"], strict=True)]
        found = [(rep, s) for rep, s in found if len(s)]
        return {"rep": [rep for rep, _ in found], "n": [len(s) for _, s in found],
                "signature": [signature(s, layout).tobytes() for _, s in found], "shingles": [s.tobytes() for _, s in found]}

    members = stored(members, "minhash-large")
    full = stored(map_batches(_texts(docs, members.select("rep").distinct()),
                              "rep long, n long, signature binary, shingles binary", sets), "minhash-large-sets")
    weights = members.join(full.select("rep", "n"), "rep").groupBy("key").agg(
        F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles"))
    dealt = members.join(weights, "key").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: F.struct(
        F.least("mine", other).alias("i"), F.greatest("mine", other).alias("j"), (F.col("mine") > other).cast("int").alias("own")))
    spread = dealt.join(full, "rep").select("key", "rep", "comp", "signature", "shingles", F.explode(pairs).alias("p")) \
        .select("key", "p.i", "p.j", "p.own", "rep", "comp", "signature", "shingles")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        edges = _tile(group, layout)
        return pa.table({"u": pa.array([u for u, _ in edges], pa.int64()), "v": pa.array([v for _, v in edges], pa.int64())}, schema=schema)

    return spread.groupBy("key", "i", "j").applyInArrow(run, "u long, v long")


def _shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) between the classes of rows that share an id."""
    own = rows.join(classes.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
    several = own.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high")
    return own.join(several, "doc_id").filter("rep <> low").select(F.col("rep").alias("u"), F.col("low").alias("v"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text), linked from ``percent`` similarity on.

    ``component_id`` is the smallest doc_id reachable by links. Null and empty texts have no
    shingles and no links. Repeated rows and equal sets are linked; rows with words that share an id
    share its links. A row without an id has no links, a null component and is not kept. An empty table gives
    no rows.
    """
    layout = Layout(percent)
    rows = stored(signed(docs, layout), "minhash-rows")
    classes = stored(rows.filter("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")), "minhash-classes")
    keyed = _keyed(classes, layout)
    counts = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = stored(keyed.join(counts, "key"), "minhash-buckets")

    central = buckets.groupBy("rep").agg(F.sum("size").alias("mates"))
    hubs = buckets.join(central, "rep").groupBy("key").agg(F.max_by("rep", F.struct("mates", "rep")).alias("hub"))
    stars = buckets.join(hubs, "key").filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    edges = stored(_confirmed(_close(stars, classes, layout), docs, layout).union(_shared_ids(rows, classes)), "minhash-edges")

    member = stored(components(edges, "minhash-stars"), "minhash-members")
    placed = buckets.join(member.withColumnRenamed("id", "rep"), "rep", "left") \
        .select("key", "size", "rep", F.coalesce("component_id", "rep").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    placed = stored(placed.join(open_keys, "key"), "minhash-open")
    small = placed.filter(F.col("size") <= SMALL)
    left = small.select("key", F.col("rep").alias("a"), F.col("comp").alias("ca"))
    right = small.select("key", F.col("rep").alias("b"), F.col("comp").alias("cb"))
    paired = left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct()
    large = _tiles(placed.filter(F.col("size") > SMALL).drop("size"), docs, layout)
    more = _confirmed(_close(paired, classes, layout), docs, layout).union(large)

    final = components(edges.union(more), "minhash-links")
    grouped = classes.select("digest", "rep").join(final.withColumnRenamed("id", "rep"), "rep", "left") \
        .select("digest", F.coalesce("component_id", "rep").alias("component_id"))
    result = rows.select("doc_id", "n_shingles", "digest").join(grouped, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
