"""Packing documents into sequences along a space-filling curve.

A document's token ids are hashed to a signed count vector, which fixed random axes project to DIMS
coordinates in [0, 1). Its key is the place of that point on a Hilbert curve. Documents are sorted by
range on (key, doc_id), so neighbours on the curve meet in one sequence. Within a range the
documents are laid end to end and cut every ``length`` ids. What is left at the end of a range is
cut into sequences whose sizes are powers of two, which need no padding.

Ids travel through one shuffle. A hot key (a third of the documents may be copies) is split by its
ids. Tasks hold one batch and one open sequence.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscan.llm.common import stored

LENGTH = 2048
END_ID = 1
#: Hash buckets of a document vector, axes of the projection, bits of a coordinate.
BUCKETS, DIMS, BITS = 256, 4, 10
#: Bytes of text that are cut into words at once; a longer document is taken alone.
SLICE_BYTES = 12 << 20
#: Distinct words whose ids a Python worker remembers.
REMEMBERED = 400_000
#: Words encoded as one text.
JOINED = 512
#: Latin letters (one piece, composed already) and ASCII marks behind them (another piece).
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)")

_worker: dict = {}


class Words(dict):
    """White-space separated word to its ids as little-endian bytes, filled by the tokenizer library.

    The tokenizer drops white space and never joins over it, so a word's ids depend on the word alone.
    Words of Latin letters are lowered and encoded many at a time, as one text with spaces: each ends
    with an id that carries the end mark. All others are encoded one by one.
    """

    def __init__(self, tokenizer_file: str):
        super().__init__()
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = id_kind(size)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.cores: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self]
        simple, rest = [], []
        for word in new:
            parts = SIMPLE.fullmatch(word)
            core = parts[1].lower() if parts else ""
            if core.isalpha():
                simple.append((word, core, parts[2]))
            else:
                rest.append(word)
        cores = list({core for _, core, _ in simple} - self.cores.keys())
        for at in range(0, len(cores), JOINED):
            self._joined(cores[at:at + JOINED])
        self._apart(self.cores, list({marks for _, _, marks in simple if marks} - self.cores.keys()))
        for word, core, marks in simple:
            self[word] = self.cores[core] + self.cores[marks] if marks else self.cores[core]
        self._apart(self, rest)

    def _joined(self, part: list[str]) -> None:
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(part) or stops[-1] != len(ids):
            self._apart(self.cores, part)
            return
        data, start = ids.tobytes(), 0
        for word, stop in zip(part, (stops * self.kind.itemsize).tolist(), strict=True):
            self.cores[word] = data[start:stop]
            start = stop

    def _apart(self, known: dict[str, bytes], new: list[str]) -> None:
        for at in range(0, len(new), 4096):
            part = new[at:at + 4096]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[word] = np.asarray(found.ids, self.kind).tobytes()

    def trim(self) -> None:
        for held in (self, self.cores):
            if len(held) > REMEMBERED + 200_000:
                for word in list(held)[REMEMBERED:]:
                    del held[word]


def id_kind(vocabulary: int) -> np.dtype:
    """The narrowest unsigned type that holds every id."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def encode(texts: pa.Array, words: Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, each with its end id; where each text starts, and the end)."""
    cut = pc.ascii_split_whitespace(texts)
    coded = cut.flatten().dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    words.learn(distinct)
    values = [words[w] for w in distinct]
    flat = np.frombuffer(b"".join(values) + np.asarray([end_id], words.kind).tobytes(), words.kind)
    sizes = np.array([len(v) for v in values] + [words.kind.itemsize]) // words.kind.itemsize
    begins = np.cumsum(sizes) - sizes
    per_text = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    stops = np.cumsum(per_text)
    codes = np.insert(coded.indices.to_numpy().astype(np.int64), stops, len(values))  # the end of each text
    long = sizes[codes]
    after = np.cumsum(long)
    ids = flat[np.repeat(begins[codes] - (after - long), long) + np.arange(int(after[-1]))]
    starts = np.concatenate([[0], after[stops + np.arange(len(stops))]])
    words.trim()
    return ids, starts


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows, dims), each coordinate of ``bits`` bits.

    From the highest bit down, a set bit mirrors the lower bits of the first coordinate and a clear
    bit exchanges them with it; the Gray code of the bits is then undone over all coordinates.
    """
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(len(x)):
            set_bit = (x[d] >> bit) & 1 == 1
            swapped = np.where(set_bit, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(set_bit, x[0] ^ low, x[0]) ^ swapped
            x[d] = x[d] ^ swapped
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = (key << 1) | (((x[d] ^ turn) >> bit) & 1)
    return key


def document_points(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Integer points of documents: hashed signed counts, damped and scaled to length 1, on fixed random axes."""
    mixed = ids.astype(np.uint32) * np.uint32(2654435761)
    bucket = (mixed >> np.uint32(24)).astype(np.int64) % BUCKETS
    sign = 1.0 - 2.0 * ((mixed >> np.uint32(20)) & np.uint32(1))
    docs = len(starts) - 1
    owner = np.repeat(np.arange(docs), np.diff(starts))
    counts = np.bincount(owner * BUCKETS + bucket, sign, docs * BUCKETS).reshape(docs, BUCKETS)
    damped = np.sign(counts) * np.sqrt(np.abs(counts))
    size = np.sqrt((damped * damped).sum(axis=1, keepdims=True))
    axes = np.random.default_rng(11).standard_normal((BUCKETS, DIMS))
    placed = (damped / np.maximum(size, 1e-300)) @ axes  # about normal, so the logistic spreads it evenly
    return np.minimum((1 << BITS) / (1 + np.exp(-1.702 * placed)), (1 << BITS) - 1).astype(np.int64)


TOKENS = "doc_id long, key long, ids binary"


def tokenise(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, key, ids) of (doc_id, text): whole texts, null as empty; ids in the narrowest type."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _worker.get("file") != tokenizer_file:
            _worker.update(file=tokenizer_file, words=Words(tokenizer_file))
        words: Words = _worker["words"]
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                reach = (sizes[at - 1] if at else 0) + SLICE_BYTES
                stop = max(at + 1, int(np.searchsorted(sizes, reach, side="right")))
                ids, starts = encode(texts.slice(at, stop - at), words, end_id)
                keys = hilbert_keys(document_points(ids, starts), BITS)
                offsets = pa.py_buffer((starts * words.kind.itemsize).astype("<i4").tobytes())
                data = pa.Array.from_buffers(pa.binary(), stop - at, [None, offsets, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.array(keys), data], schema=schema)
                at = stop

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, TOKENS)


def powers(size: int) -> list[int]:
    """``size`` as descending powers of two."""
    return [1 << b for b in range(size.bit_length() - 1, -1, -1) if size >> b & 1]


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Filler:
    """Cuts a stream of documents into pieces of full sequences, and the rest into powers of two."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence = length, first_sequence
        self.open: list[tuple] = []  # pieces of the sequence being filled: (doc, start, ids, doc_tokens)
        self.held = 0
        self.done: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at:at + self.length - self.held]
            self.open.append((doc, at, part, len(ids)))
            self.held += len(part)
            at += len(part)
            if self.held == self.length:
                self._close(self.open)
                self.open, self.held = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), total, self.sequence, offset, ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        rest, self.open = self.open[::-1], []
        for size in powers(self.held):
            pieces = []
            while size:
                doc, start, ids, total = rest.pop()
                pieces.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    rest.append((doc, start + size, ids[size:], total))
                size -= min(size, len(ids))
            self._close(pieces)
        self.held = 0


def pack(tokens: DataFrame, vocabulary: int, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids) of every piece; ids are 32-bit little-endian.

    Takes (doc_id, key, ids). Pieces of a sequence are in one task, in order of their offsets. Sequence
    ids are unique, not dense: a range's number and a count. No padding is needed: sequences hold
    ``length`` ids, or, at the end of a range, a power of two.
    """
    kind = id_kind(vocabulary)
    names = [c.split()[0] for c in PIECES.split(", ")]
    schema = pa.schema([*[(n, pa.int64()) for n in names[:-1]], ("ids", pa.binary())])

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = Filler(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filler.add(doc, np.frombuffer(data, kind))
                if len(filler.done) >= 4096:
                    yield emit(filler.done)
                    filler.done = []
        filler.finish()
        if filler.done:
            yield emit(filler.done)

    order = ["key", F.col("doc_id").asc_nulls_first(), "ids"]
    return tokens.repartitionByRange("key", F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order) \
        .select("doc_id", "ids").mapInArrow(run, PIECES)


def packed(docs: DataFrame, tokenizer_file: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all rows of (doc_id, text), see ``pack``; other columns are ignored.

    A null or empty text is its end id alone. Repeated rows and ids are documents of their own; a null
    id is kept. An empty table gives no rows. Tokens are written once to the shared folder, because
    sorting by range reads them twice.
    """
    from tokenizers import Tokenizer
    vocabulary = Tokenizer.from_file(tokenizer_file).get_vocab_size(with_added_tokens=True)
    return pack(stored(tokenise(docs, tokenizer_file, end_id), "packing-tokens"), vocabulary, length)
