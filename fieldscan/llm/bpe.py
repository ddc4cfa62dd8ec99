"""Byte-level BPE encoding and decoding.

The corpus is counted by distinct units (see ``units``). Units that occur often, at most
TABLE_UNITS of them, are encoded by Spark's higher-order functions: a unit's pieces become arrays
of single bytes, and a fold merges, step by step, the neighbours whose concatenation has the lowest
rank, leftmost first, until no neighbours have a rank. Ranks come from one literal: an array of
small maps addressed by CRC-32, because a lookup in one large map would scan it. Documents then
join their units' ids where they lie: the bounded table is sent to all tasks, and the remaining
rare and very long units are merged by the tokenizer library in place, since a join on them would
shuffle every text. Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscan.llm.common import Columns, map_arrow, map_batches, stored, worker_state
from fieldscan.llm.units import SPACES, units

Ranks = dict[bytes, int]

#: Units encoded ahead: the most frequent, so many at most, of so many bytes at most.
TABLE_UNITS, UNIT_BYTES = 300_000, 48
#: Maps in the rank literal; each holds about three ranks for two slots.
SLOTS = 1 << 15
#: Distinct units counted in a task before they go to the shuffle.
HELD = 200_000
#: The public pattern with its white space written out, as Java's differs.
PATTERN = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{SPACES}\p{{L}}\p{{N}}]") \
    .replace(r"\s+(?!\S)", rf"[{SPACES}]+(?![^{SPACES}])").replace(r"|\s+", rf"|[{SPACES}]+")


def rank_table(path: str) -> Ranks:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _library(ranks: Ranks) -> tiktoken.Encoding:
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_units(docs: DataFrame) -> DataFrame:
    """(unit, n) over all whole texts; tasks add up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             names=["unit", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(units(text or ""))
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    return map_arrow(docs.select(F.col("text").cast("string")), run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent(counted: DataFrame, most: int = TABLE_UNITS) -> DataFrame:
    """The units above the least count that leaves at most ``most``."""
    steps = counted.groupBy(F.least("n", F.lit(4096)).alias("n")).count().orderBy(F.desc("n")).collect()
    total, least = 0, None
    for n, units_here in steps:
        total += units_here
        if total > most:
            break
        least = n
    return counted.filter(F.lit(False) if least is None else F.col("n") >= least)


def rank_literal(ranks: Ranks) -> Column:
    """array<map<string, int>>: a piece, its bytes as Latin-1 characters, is in the map CRC-32 modulo SLOTS.

    The optimizer folds it into one literal.
    """
    slots: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        slots[zlib.crc32(text.encode()) % SLOTS][text] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string, int>>")


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value once in the plan."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merged(piece: Column, slots: Column) -> Column:
    """The ids of one piece by folding ranked merges over its bytes."""
    def rank(text: Column) -> Column:
        return F.try_element_at(F.element_at(slots, (F.crc32(text.cast("binary")) % SLOTS + 1).cast("int")), text)

    def step(parts: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                            lambda right, i: rank(F.concat(F.element_at(parts, i + 1), right)))

        def join(found: Column) -> Column:
            at = F.array_position(found, F.array_min(found)).cast("int")
            return F.when(F.array_min(found).isNull(), parts).otherwise(F.concat(
                F.slice(parts, 1, F.greatest(at - 1, F.lit(0))),
                F.array(F.concat(F.element_at(parts, F.greatest(at, F.lit(1))), F.element_at(parts, F.least(at + 1, F.size(parts))))),
                F.slice(parts, at + 2, F.size(parts))))

        return _bind(pairs, join)

    text = F.decode(piece.cast("binary"), "ISO-8859-1")
    bytes_of = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), bytes_of, step)
    return F.transform(folded, rank)


def encode_units(found: DataFrame, ranks: Ranks) -> DataFrame:
    """(unit, ids) of distinct units, natively.

    The rank literal has some MB wherever the plan or its text holds it, so it stands there once.
    """
    pieces = F.regexp_extract_all("unit", F.lit(PATTERN), F.lit(0))
    return found.filter(F.octet_length("unit") <= UNIT_BYTES) \
        .select("unit", _bind(rank_literal(ranks), lambda slots: F.flatten(F.transform(pieces, lambda p: merged(p, slots)))).alias("ids"))


class _Ids(dict):
    """Unit to its ids as little-endian bytes; what the table lacks is merged by the library and not kept."""

    def __init__(self, table: pa.Table, ranks: Ranks):
        ids = table["ids"].combine_chunks()
        offsets, flat = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        super().__init__((u, flat[a:b].tobytes()) for u, a, b in zip(table["unit"].to_pylist(), offsets, offsets[1:], strict=False))
        self.library = _library(ranks)

    def __missing__(self, unit: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.library.encode_ordinary(unit))


def _mapped(docs: DataFrame, ranks: Ranks, most: int, schema: str, use: Callable[[Columns, list[bytes]], Columns]) -> DataFrame:
    """Encode every text and apply ``use`` to the rows and their ids, in one pass over the documents."""
    found = frequent(stored(count_units(docs), "bpe-units"), most).select("unit")
    table = stored(encode_units(found, ranks), "bpe-table").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    sent, key = docs.sparkSession.sparkContext.broadcast((sink.getvalue().to_pybytes(), ranks)), uuid.uuid4().hex

    def batch(rows: Columns) -> Columns:
        known: _Ids = worker_state(key, lambda: _Ids(pa.ipc.open_stream(sent.value[0]).read_all(), sent.value[1]))
        return use(rows, [b"".join(map(known.__getitem__, units(text or ""))) for text in rows["text"]])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), schema, batch)


def encode(docs: DataFrame, ranks: Ranks, most: int = TABLE_UNITS) -> DataFrame:
    """(doc_id, ids binary) of every row: ids of the whole text as little-endian 32-bit integers.

    Null and empty texts have no ids. Special tokens are ordinary text. One row per input row; an
    empty table gives no rows.
    """
    return _mapped(docs, ranks, most, "doc_id long, ids binary", lambda rows, ids: {"doc_id": rows["doc_id"], "ids": ids})


def decoded(ids: bytes, pieces: list[bytes]) -> bytes:
    """The bytes of the ids, by concatenating their pieces."""
    return b"".join(map(pieces.__getitem__, memoryview(ids).cast("I").tolist()))


def piece_list(ranks: Ranks) -> list[bytes]:
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def digests(docs: DataFrame, ranks: Ranks, most: int = TABLE_UNITS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids."""
    pieces = piece_list(ranks)

    def use(rows: Columns, ids: list[bytes]) -> Columns:
        return {"doc_id": rows["doc_id"], "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(decoded(i, pieces)).hexdigest() for i in ids]}

    return _mapped(docs, ranks, most, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", use)
