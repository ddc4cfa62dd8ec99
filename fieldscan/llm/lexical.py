"""Ranked lexical search by presence-mask grouping.

Items go in blocks whose vocabulary fits a worker. Per block one pass over the texts keeps each
document's size and its counts of the block's terms. The second pass takes documents in chunks: a
bitmap per term marks the documents that hold it. For an item the bitmaps of its terms are packed to
one mask per document, documents are grouped by mask, and a mask's maximum score is the sum of its
terms' largest scores in the chunk. Masks are evaluated by descending maximum until it falls below
the worst score kept; a tie is still evaluated, because a smaller id may win it. Each task keeps
``top`` documents per item, so what is shuffled does not grow with the documents of a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldscan.llm.common import stored

TOP = 10
#: Terms of all items of a block, with repeats, about; bounds what is sent to the workers.
BLOCK_TERMS = 200_000
#: Cells of a chunk's table of terms by documents.
CELLS = 4 << 20
#: Bytes of text cut at once.
SLICE_BYTES = 6 << 20
#: A to Z are lowered; ASCII bytes other than letters and digits become a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

COUNTED = "doc_id long, n long, terms array<int>, tfs array<int>"


def cut(texts: pa.Array) -> pa.Array:
    """Lists of terms, and empty strings, of a binary array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    low = bytes(memoryview(data)[offsets[0]:offsets[-1]]).translate(TABLE) if data is not None else b""
    plain = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(low)])
    return pc.ascii_split_whitespace(plain)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): distinct terms of every item; rows of one id are one item."""
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = cut(pc.fill_null(batch.column(1), b""))
            owner = pc.list_parent_indices(found)
            pairs = pa.RecordBatch.from_arrays([batch.column(0).take(owner), found.flatten()], schema=schema)
            yield pairs.filter(pc.greater(pc.binary_length(pairs.column(1)), 0))

    narrow = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "item_id long, term string").distinct()


def counted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms of a document, and its counts of the vocabulary's, by position there."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def count(ids: pa.Array, texts: pa.Array, known: pa.Array) -> pa.RecordBatch:
        found = cut(texts)
        words, owner = found.flatten(), pc.list_parent_indices(found).to_numpy()
        filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        n = np.bincount(owner[filled], minlength=len(ids))
        place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
        hit = place >= 0
        pairs, tf = np.unique(owner[hit] * len(known) + place[hit], return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(ids) + 1) * len(known)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (pairs % max(len(known), 1), tf)]
        return pa.RecordBatch.from_arrays([ids, pa.array(n), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            texts = pc.fill_null(batch.column(1), b"")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                reach = (sizes[at - 1] if at else 0) + SLICE_BYTES
                stop = max(at + 1, int(np.searchsorted(sizes, reach, side="right")))
                yield count(batch.column(0).slice(at, stop - at), texts.slice(at, stop - at), known)
                at = stop

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(run, COUNTED)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one column of bits per distinct mask, the mask of each document) of bitmaps (terms, documents)."""
    packed = np.packbits(present, axis=0, bitorder="little")
    width = -(-packed.shape[0] // 8) * 8
    rows = np.zeros((packed.shape[1], width), np.uint8)
    rows[:, :packed.shape[0]] = packed.T
    flat = rows.view("<u8" if width == 8 else f"V{width}").ravel()
    _, first, member = np.unique(flat, return_index=True, return_inverse=True)
    return present[:, first], member


class Best:
    """The ``top`` documents of one item: highest score, then smallest id, a null id last."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A lower score cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(p) for p in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[:self.top]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


def search_chunk(best: list[Best], items: list[np.ndarray], scores: np.ndarray, present: np.ndarray,
                 doc: np.ndarray, null: np.ndarray) -> None:
    """Offer a chunk's documents to every item; ``scores`` and ``present`` are (terms, documents)."""
    for kept, terms in zip(best, items, strict=True):
        if not len(terms):
            continue
        own, bits = scores[terms], present[terms]
        most = own.max(axis=1).astype(np.float64)  # sums of whole numbers below 2**53
        if most.sum() < kept.least:
            continue
        distinct, member = masks(bits)
        bound = most @ distinct
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rank = place[member]  # of each document's mask
        by_rank = np.argsort(rank, kind="stable")
        ends = np.searchsorted(rank[by_rank], np.arange(len(order)), side="right")
        at, step = 0, 8
        while at < len(order) and bound[order[at]] >= kept.least:
            stop = min(at + step, len(order))
            while bound[order[stop - 1]] < kept.least:
                stop -= 1
            chosen = by_rank[ends[at - 1] if at else 0:ends[stop - 1]]
            total = own[:, chosen].sum(axis=0)
            good = total >= kept.least
            kept.add(total[good], doc[chosen[good]], null[chosen[good]])
            at, step = stop, step * 2


def ranked_block(docs: DataFrame, item_ids: list[int | None], item_words: list[list[str]], top: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of the items of one block over all documents."""
    vocabulary = sorted({w for words in item_words for w in words})
    rows = stored(counted(docs, vocabulary), "lexical-counts")
    size = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holding = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = dict(holding.collect())  # at most one row per term of the block
    documents, length = size["documents"], size["terms"]
    place = {w: at for at, w in enumerate(vocabulary)}
    weights = np.array([weight(documents, df[t]) if t in df else 0 for t in range(len(vocabulary))], np.int64)
    # terms of weight 0 or in no document add nothing
    lists = [np.array(sorted(place[w] for w in words if weights[place[w]] > 0), np.int64) for words in item_words]
    sent = docs.sparkSession.sparkContext.broadcast((item_ids, lists, weights))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items, weigh = sent.value
        best = [Best(top) for _ in items]
        chunk = max(1, CELLS // max(len(weigh), 1))
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                n = part.column(1).to_pylist()
                m = np.array([10 + 90 * x * documents // max(length, 1) for x in n], np.int64)
                sizes = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(n)), sizes)
                term = part.column(2).flatten().to_numpy()
                tf = part.column(3).flatten().to_numpy().astype(np.int64)
                scores = np.zeros((len(weigh), len(n)), np.int64)
                scores[term, owner] = weigh[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[owner]))
                ids = part.column(0)
                search_chunk(best, items, scores, scores > 0, pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        owner = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        if len(owner):
            doc = pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.null for b in best]))
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in owner], pa.int64()), doc,
                                              pa.array(np.concatenate([b.score for b in best]))], schema=schema)

    offered = rows.mapInArrow(run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return offered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id, text) its best documents of (doc_id, text).

    Whole texts. Null and empty texts have no terms: such documents are never found, such items find
    nothing. Items of one id are one item with the terms of all its rows; repeated documents are each
    ranked, a null doc_id behind its ties. Fewer than ``top`` documents with a score above 0 are all
    returned. Empty tables give no rows. Other columns are ignored. An item's terms must fit a worker.
    """
    terms = stored(item_terms(items), "lexical-terms")
    blocks = max(1, -(-terms.count() // block_terms))
    found = None
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        gathered = mine.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()  # a block is bounded
        one = ranked_block(docs, [r["item_id"] for r in gathered], [r["terms"] for r in gathered], top)
        found = one if found is None else found.unionByName(one)
    return found
