"""Near-duplicate embeddings by quantised tile products.

Equal vectors fold into one class first. Each class has its unit vector quantised to int8 with its
own scale; ``u = s q + d`` with ``|d| = e`` known in double precision. A tile product of two blocks
of quantised vectors is off by at most ``e_i + e_j + e_i e_j`` plus rounding, so a pair whose
product stays below the threshold by more than that is not linked, and one above by more is. Only
the others are computed from the full vectors in double precision. Every pair of classes is
compared once, so products grow with the square of the number of classes. Vectors are dealt into
blocks once, and a task reads the blocks of its tiles where they are stored, so disk grows with the
table. A task emits link counts and the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscan.llm.common import components, map_arrow, stored

THRESHOLD = 0.9
#: Classes on one side of a tile.
TILE = 4096
#: Bytes of a block's vectors in double precision; long vectors come in blocks of fewer.
TILE_BYTES = 16 << 20
#: Rounding of a single-precision product of unit vectors, per dimension, generously.
ROUNDING = 2.0**-22
#: Rows of a tile multiplied at once, so that their products stay in the processor's cache.
STRIP = 128
#: Pairs that wait for their components.
WAITING = 1 << 18

ROWS = pa.schema([("vec_id", pa.int64()), ("digest", pa.binary()), ("rep", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()),
                  ("vector", pa.binary())])
BLOCK = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("reps", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())])
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _folded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of ``prepared`` for a batch of (vec_id, embedding)."""
    ids, lists = batch.column(0), batch.column(1)
    known, edges = ids.to_pylist(), lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # a null is NaN, -0.0 is 0.0
    with np.errstate(over="ignore"):
        short = flat.astype("<f4")

    def within(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[edges])

    good = ids.is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
    good &= (within(~np.isfinite(flat)) == 0) & (within(flat != 0) > 0)
    narrow = within(short != flat) == 0
    out = {c: [None] * batch.num_rows for c in ("digest", "rep", "n", "dim", "vector")}
    first: dict[bytes, int] = {}
    for row in np.flatnonzero(good).tolist():
        part = slice(edges[row], edges[row + 1])
        vec_id, digest = known[row], hashlib.md5(flat[part]).digest()
        out["digest"][row] = digest
        at = first.setdefault(digest, row)
        if at == row:
            out["rep"][row], out["n"][row], out["dim"][row] = vec_id, 1, part.stop - part.start
            out["vector"][row] = (short if narrow[row] else flat)[part].tobytes()
        else:
            out["rep"][at] = min(out["rep"][at], vec_id)
            out["n"][at] += 1
    return pa.RecordBatch.from_arrays([ids, *(pa.array(out[f.name], f.type) for f in list(ROWS)[1:])], schema=ROWS)


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, digest, rep, n, dim, vector): equal vectors share a digest; it is null for those that link with nothing.

    Of equal vectors of an Arrow batch the first has the rest: their smallest id and number, and the vector, in single
    precision where that is exact.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (_folded(b) for b in batches if b.num_rows)

    return map_arrow(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>")),
                     run, "vec_id long, digest binary, rep long, n long, dim int, vector binary")


def _packed(group: pa.Table) -> pa.Table:
    """One row for a block: its classes' smallest ids, numbers of rows and vectors, laid end to end."""
    dim = group["dim"][0].as_py()
    _, first, of = np.unique(np.array(group["digest"].to_pylist(), object), return_index=True, return_inverse=True)
    rep, n = group["rep"].to_numpy(), np.zeros(len(first), np.int64)
    reps = rep[first]
    np.minimum.at(reps, of, rep)
    np.add.at(n, of, group["n"].to_numpy())
    vectors = group["vector"].take(first).to_pylist()
    if any(len(v) > 4 * dim for v in vectors):
        vectors = [v if len(v) > 4 * dim else np.frombuffer(v, "<f4").astype("<f8").tobytes() for v in vectors]
    return pa.table([[dim], [group["block"][0].as_py()], [reps.astype("<i8").tobytes()], [n.astype("<i8").tobytes()], [b"".join(vectors)]],
                    schema=BLOCK)


def blocks(rows: DataFrame, tile: int) -> DataFrame:
    """(dim, block, reps, copies, vectors) of what ``prepared`` gives: classes dealt by their digest, about ``tile`` to a block."""
    firsts = rows.filter("n is not null")
    most = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(TILE_BYTES / (8 * F.col("dim")))))
    # The number of blocks need not be exact.
    counts = firsts.groupBy("dim").agg(F.approx_count_distinct("digest").alias("classes")) \
        .select("dim", F.ceil(F.col("classes") / most).alias("blocks"))
    dealt = firsts.join(F.broadcast(counts), "dim").withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
    return dealt.select("dim", "block", "digest", "rep", "n", "vector").groupBy("dim", "block") \
        .applyInArrow(_packed, "dim int, block int, reps binary, copies binary, vectors binary")


def quantise(vectors: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(unit vector, int8 components, scale, error norm) of a vector's doubles, or of each row of a matrix."""
    v = np.frombuffer(vectors, "<f8") if isinstance(vectors, bytes) else vectors
    v = v / np.abs(v).max(-1, keepdims=True)
    unit = v / np.sqrt((v * v).sum(-1, keepdims=True))
    scale = np.abs(unit).max(-1, keepdims=True) / 127
    q = np.rint(unit / scale).astype(np.int8)
    return unit, q, scale[..., 0], np.linalg.norm(unit - scale * q, axis=-1) * (1 + 1e-9) + 1e-12


class Block(NamedTuple):
    """A block in a task. ``reach`` is 1 + the error norm; it is the last component of ``codes`` too, so that a product of
    two rows of ``codes`` is that of the quantised vectors, plus ``e_i + e_j + e_i e_j``, plus 1."""

    reps: np.ndarray
    copies: np.ndarray
    units: np.ndarray
    codes: np.ndarray
    reach: np.ndarray


def unpacked(dim: int, reps: pa.Buffer, copies: pa.Buffer, vectors: pa.Buffer) -> Block:
    ids = np.frombuffer(reps, "<i8")
    kind = "<f4" if vectors.size == 4 * dim * len(ids) else "<f8"
    units, q, scale, error = quantise(np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64))
    return Block(ids, np.frombuffer(copies, "<i8"), units,
                 np.column_stack([q * scale[:, None], 1 + error]).astype(np.float32), 1 + error)


def linked(left: Block, right: Block, within: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs in both blocks, some rows at a time; each pair once if the block is the same (``within``)."""
    dim = left.units.shape[1]
    rounding = ROUNDING * (dim + 4) * left.reach.max() * right.reach.max()
    step = max(1, TILE_BYTES // (8 * dim))
    least = np.float32(threshold + 1 - rounding)
    for at in range(0, len(left.reps), STRIP):
        skip = at if within else 0
        product = left.codes[at:at + STRIP] @ right.codes[skip:].T
        hits = np.flatnonzero(product >= least)
        i, j = np.divmod(hits, product.shape[1])
        product = product.ravel()[hits]
        i, j = i + at, j + skip
        if within:
            once = i < j
            i, j, product = i[once], j[once], product[once]
        sure = product - (2 * left.reach[i] * right.reach[j] - 1) >= threshold + rounding
        open_pairs = np.flatnonzero(~sure)
        for part in range(0, len(open_pairs), step):
            k = open_pairs[part:part + step]
            sure[k] = np.einsum("ij,ij->i", left.units[i[k]], right.units[j[k]]) >= threshold
        if sure.any():
            yield i[sure], j[sure]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after ``a`` and ``b`` are linked; a label is the smallest position of its component, before and after."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


class Found:
    """Links and components of the classes that a task has seen."""

    def __init__(self) -> None:
        self.start: dict[tuple[int, int], int] = {}
        self.reps = self.links = self.label = np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def place(self, key: tuple[int, int], block: Block) -> slice:
        """Where a block's classes stand."""
        at = self.start.setdefault(key, len(self.reps))
        if at == len(self.reps):
            self.reps = np.concatenate([self.reps, block.reps])
            self.links = np.concatenate([self.links, np.zeros(len(block.reps), np.int64)])
            self.label = np.concatenate([self.label, np.arange(at, len(self.reps))])
        return slice(at, at + len(block.reps))

    def add(self, left: Block, right: Block, at: slice, to: slice, i: np.ndarray, j: np.ndarray) -> None:
        self.links[at] += np.bincount(i, right.copies[j], len(left.reps)).astype(np.int64)
        self.links[to] += np.bincount(j, left.copies[i], len(right.reps)).astype(np.int64)
        self.waiting.append((i + at.start, j + to.start))
        if sum(len(x) for x, _ in self.waiting) > WAITING:
            self.join()

    def join(self) -> None:
        if self.waiting:
            self.label = joined(self.label, *(np.concatenate(x) for x in zip(*self.waiting, strict=True)))
            self.waiting = []

    def rows(self) -> pa.RecordBatch:
        self.join()
        node, child = np.flatnonzero(self.links), np.flatnonzero(self.label != np.arange(len(self.label)))
        return pa.RecordBatch.from_arrays([
            pa.array(self.reps[np.concatenate([node, child])]),
            pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(self.reps[self.label[child]])]),
            pa.array(np.concatenate([self.links[node], np.zeros(len(child), np.int64)]))], schema=LINKS)


def tile_links(packed: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n): with v null, u has n further links; else an edge. Takes stored ``blocks``.

    The tiles are a Cartesian product of the stored blocks: its tasks read the files of both sides, nothing is shuffled.
    """
    names = ("dim", "block", "reps", "copies", "vectors")
    left, right = (packed.select(*(F.col(c).alias(f"{side}_{c}") for c in names)) for side in ("left", "right"))
    tiles = left.join(right.hint("shuffle_replicate_nl"),
                      (F.col("left_dim") == F.col("right_dim")) & (F.col("left_block") <= F.col("right_block")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = Found(), (None, None)
        for batch in batches:
            for row in range(batch.num_rows):
                dim, block, other = (batch.column(c)[row].as_py() for c in ("left_dim", "left_block", "right_block"))
                if held[0] != (dim, block):  # a left block meets all right ones of the task before the next
                    held = (dim, block), unpacked(dim, *(batch.column(f"left_{c}")[row].as_buffer() for c in names[2:]))
                left = held[1]
                right = left if other == block else unpacked(dim, *(batch.column(f"right_{c}")[row].as_buffer() for c in names[2:]))
                at, to = found.place((dim, block), left), found.place((dim, other), right)
                for i, j in linked(left, right, other == block, threshold):
                    found.add(left, right, at, to, i, j)
        yield found.rows()

    return map_arrow(tiles.drop("right_dim"), run, "u long, v long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Links join vectors of equal length with cosine >= ``threshold``, in double precision. Null,
    empty and zero vectors, and those with null or non-finite components, have no links and their
    own component. Repeated rows and equal vectors link with each other. A row without an id has
    no links, a null component and is not kept. An empty table gives no rows.
    """
    all_rows = stored(prepared(vectors), "embedding-rows")
    classes = all_rows.filter("n is not null").groupBy("digest").agg(F.min("rep").alias("rep"), F.sum("n").alias("n"))
    found = stored(tile_links(stored(blocks(all_rows, tile), "embedding-blocks", 1), threshold), "embedding-links")
    links = found.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    member = components(found.filter("v is not null").select("u", "v"), "embedding-edges")
    summary = classes.join(links, "rep", "left").join(member.withColumnRenamed("id", "rep"), "rep", "left") \
        .select("digest", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                F.coalesce("component_id", "rep").alias("component_id"))
    result = all_rows.select("vec_id", "digest").join(summary, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
