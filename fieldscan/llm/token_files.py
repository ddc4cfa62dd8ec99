"""Token ids in word-aligned binary blocks (Simple-8b with escapes).

A 64-bit word holds a 4-bit selector and 60 bits of payload. Selector ``s`` of 0 to 13 packs
``COUNTS[s]`` ids of ``WIDTHS[s]`` bits each, first id lowest. Selector 15 is an escape: the word's
payload is one id of up to 60 bits that the packer did not want to spread. A block holds whole
documents of about BLOCK_IDS ids; its words, the number of ids, and per document the id, the
first position and the length are one row of a Parquet table, so blocks are found by statistics
and read alone. Decoding handles all words of one selector at a time.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldscan.llm.common import Columns, map_batches, shared_folder, slices, stored, worker_state
from fieldscan.llm.units import regular, units

WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = tuple(60 // w for w in WIDTHS)
ESCAPE = 15
LIMITS = np.array([(1 << w) - 1 for w in WIDTHS], np.uint64)
#: Ids of about so many per block; a longer document has a block of its own.
BLOCK_IDS = 1 << 17
#: Distinct units whose ids a Python worker remembers.
REMEMBERED = 500_000
#: Bytes of text cut into units at once; a longer document is taken alone.
SLICE_BYTES = 10 << 20
#: Units encoded as one text.
JOINED = 256
#: A space and Latin letters (one piece), and ASCII marks behind them (another piece).
SPACE_WORD = re.compile(r"( [A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)")


def pack(ids: np.ndarray) -> bytes:
    """Words of the ids (unsigned, below 2**60), greedily: each word takes as many of the next ids as fit."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return b""
    if int(ids.max()) >> 60:
        raise ValueError("An id has more than 60 bits")
    width = np.searchsorted(LIMITS, ids).astype(np.int8)  # narrowest selector that holds each id
    choice = np.full(n, len(WIDTHS) - 1, np.int8)
    running, covered = width, 1  # widest need among the ids from each place on
    for selector in range(len(WIDTHS) - 1, -1, -1):
        while covered < min(COUNTS[selector], n):
            step = min(covered, COUNTS[selector] - covered)
            running[:n - step] = np.maximum(running[:n - step], running[step:])
            covered += step
        whole = max(n - COUNTS[selector] + 1, 0)
        fits = running[:whole] <= selector
        if not fits.any():
            break  # more ids in fewer bits fit nowhere either
        choice[:whole][fits] = selector
    jump = (np.arange(n) + np.asarray(COUNTS)[choice]).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = jump[at]
    first = np.asarray(starts)
    selectors = choice[first]
    words = np.zeros(len(first), np.uint64)
    for selector in np.unique(selectors):
        mine = np.flatnonzero(selectors == selector)
        count, bits_each = COUNTS[selector], WIDTHS[selector]
        value = np.zeros(len(mine), np.uint64)
        for k in range(count):
            value |= ids[first[mine] + k] << np.uint64(k * bits_each)
        code = ESCAPE if bits_each == 60 else int(selector)
        words[mine] = value | np.uint64(code << 60)
    return words.astype("<u8").tobytes()


def unpack(data: bytes) -> np.ndarray:
    words = np.frombuffer(data, "<u8")
    codes = (words >> np.uint64(60)).astype(np.int64)
    selectors = np.where(codes == ESCAPE, len(WIDTHS) - 1, codes)
    counts = np.asarray(COUNTS)[selectors]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(selectors):
        mine = np.flatnonzero(selectors == selector)
        mask = np.uint64((1 << WIDTHS[selector]) - 1)
        for k in range(COUNTS[selector]):
            out[starts[mine] + k] = (words[mine] >> np.uint64(k * WIDTHS[selector])) & mask
    return out


class _Ids(dict):
    """Unit to its ids as little-endian bytes, filled by the tokenizer.

    A space and letters are cut from what follows them, so such words are encoded JOINED at a time as one
    text, and its ids are dealt out by the bytes they stand for. Marks behind them are cut as well. Other
    units are encoded one by one.
    """

    def __init__(self, tokenizer_file: str):
        super().__init__()
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        #: Found by the library before it cuts pieces, also beside white space: a text with one is encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        count = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # a byte-level token has one character per byte
        self.sizes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(count)])

    def learn(self, found: list[str]) -> None:
        split, rest = [], []
        for unit in found:
            if unit not in self:
                parts = SPACE_WORD.fullmatch(unit)
                if parts:
                    split.append((unit, parts[1], parts[2]))
                else:
                    rest.append(unit)
        words = list({word for _, word, _ in split} - self.keys())
        for at in range(0, len(words), JOINED):
            self._joined(words[at:at + JOINED])
        self._apart(list({u for u in [*rest, *words, *[marks for _, _, marks in split]] if u not in self}))
        for unit, word, marks in split:
            if marks:
                self[unit] = self[word] + self[marks]

    def _joined(self, part: list[str]) -> None:
        """Learn the units of ``part``; none if ids and bytes do not meet at every unit's end."""
        encoded = self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0]
        ids = np.asarray(encoded.ids, "<u4")
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in part])
        stops = np.searchsorted(ends, wanted) + 1
        if stops[-1] != len(ids) or (ends[stops - 1] != wanted).any():
            return
        data, start = ids.tobytes(), 0
        for unit, stop in zip(part, (stops * 4).tolist(), strict=True):
            self[unit] = data[start:stop]
            start = stop

    def _apart(self, new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            part = new[at:at + 4096]
            for unit, encoded in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[unit] = np.asarray(encoded.ids, "<u4").tobytes()

    def trim(self) -> None:
        if len(self) > REMEMBERED + 200_000:
            for unit in list(self)[REMEMBERED:]:
                del self[unit]


BLOCK = "first_doc long, seq long, n_ids long, docs binary, lengths binary, words binary"
#: Stands for a null id in a block.
NO_ID = -(1 << 63)


def _marked(text: str) -> str:
    """The text with a NUL between its units; it holds none itself."""
    if not regular(text):
        return "\0".join(units(text))
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ")


def encoded(texts: list[str | None], known: _Ids, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, each with ``end_id`` behind it; where each text starts, and the end).

    Distinct units are found by Arrow, their ids looked up once and dealt out by position.
    """
    alone = {at: t for at, t in enumerate(texts) if t and ("\0" in t or any(a in t for a in known.added))}
    marked = pa.array(["" if t is None or at in alone else _marked(t) for at, t in enumerate(texts)], pa.string())
    cut = pc.split_pattern(marked, "\0")
    coded = cut.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    known.learn(distinct)
    values = [known[u] for u in distinct] + [np.asarray([end_id], "<u4").tobytes()]
    codes, stops = coded.indices.to_numpy().astype(np.int64), np.cumsum(pc.list_value_length(cut).to_numpy().astype(np.int64))
    if alone:  # such a text is one unit of its own, in place of its empty one
        place = {at: len(values) + n for n, at in enumerate(alone)}
        values += [np.asarray(e.ids, "<u4").tobytes() for e in known.tokenizer.encode_batch_fast(list(alone.values()), add_special_tokens=False)]
        codes[stops[list(place)] - 1] = list(place.values())
    end = len(distinct)
    flat = np.frombuffer(b"".join(values), "<u4")
    sizes = np.array([len(v) for v in values]) // 4
    begins = np.cumsum(sizes) - sizes
    codes = np.insert(codes, stops, end)
    long = sizes[codes]
    after = np.cumsum(long)
    ids = flat[np.repeat(begins[codes] - (after - long), long) + np.arange(int(after[-1]))]
    known.trim()
    return ids, np.concatenate([[0], after[stops + np.arange(len(stops))]])


def _block(docs: list[int], parts: list[np.ndarray], seq: int) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    row = (docs[0], seq, len(ids), np.asarray(docs, "<i8").tobytes(), np.asarray([len(p) for p in parts], "<i8").tobytes(), pack(ids))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                                      names=["first_doc", "seq", "n_ids", "docs", "lengths", "words"])


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0) -> None:
    """Encode (doc_id, text) and write blocks, in ascending doc_id order over files and within them.

    Texts are sorted by range on the id, then encoded and packed in one pass: ids are never
    shuffled. A repeated id keeps each of its rows, in the order of their texts; a null id comes first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        parts: list[np.ndarray] = []
        held = seq = 0
        known: _Ids = worker_state(("token files", tokenizer_file), lambda: _Ids(tokenizer_file))
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                found, starts = encoded(part.column(1).to_pylist(), known, end_id)
                for doc, start, stop in zip(part.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    ids.append(NO_ID if doc is None else doc)
                    parts.append(found[start:stop])
                    held += stop - start
                    if held >= BLOCK_IDS:
                        yield _block(ids, parts, seq)
                        ids, parts, held, seq = [], [], 0, seq + 1
        if ids:
            yield _block(ids, parts, seq)

    order = F.col("doc_id").asc_nulls_first()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    narrow.repartitionByRange(order).sortWithinPartitions(order, "text").mapInArrow(run, BLOCK).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    ``start`` counts the ids of all documents before it, by summing block sizes over the blocks'
    order; one small row per block goes through the window, never one per document.
    """
    files = spark.read.schema(BLOCK).parquet(path)

    def batch(rows: Columns) -> Columns:
        out: Columns = {c: [] for c in ("doc_id", "block", "inside", "n_tokens", "ids_crc32")}
        for key, docs, lengths, words in zip(rows["key"], rows["docs"], rows["lengths"], rows["words"], strict=True):
            ids = unpack(words).astype("<u4")
            sizes = np.frombuffer(lengths, "<i8")
            ends = np.cumsum(sizes)
            for doc, size, end in zip(np.frombuffer(docs, "<i8").tolist(), sizes.tolist(), ends.tolist(), strict=True):
                out["doc_id"].append(None if doc == NO_ID else doc)
                out["block"].append(key)
                out["inside"].append(end - size)
                out["n_tokens"].append(size)
                out["ids_crc32"].append(zlib.crc32(ids[end - size:end].tobytes()))
        return out

    keyed = files.select(F.xxhash64("first_doc", "seq", "docs", "words").alias("key"), "*")
    docs = map_batches(keyed.select("key", "docs", "lengths", "words"),
                       "doc_id long, block long, inside long, n_tokens long, ids_crc32 long", batch)
    index = stored(keyed.select("key", "first_doc", "seq", "n_ids"), "token-blocks")
    before = Window.orderBy("first_doc", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = index.select(F.col("key").alias("block"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("block_start"))
    return docs.join(starts, "block").select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"),
                                             "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Encode, write, and read back; null and empty texts hold the end id alone."""
    path = f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_file)
    return read(docs.sparkSession, path)
