"""Removing long strings that occur more than once, by merging Burrows-Wheeler transforms.

A string is a window of LENGTH bytes inside one text. To divide the work without losing a match,
each window is filed under its anchor, the window's least hashed k-gram: equal windows have equal
anchors at equal places. Consecutive windows with one anchor form a segment of text.

1. Segments equal as a whole fold to a count; those that occur twice are repeated, all windows.
2. A segment that occurs once, under an anchor that other segments share, is compared window by
   window. Such segments, with one example of each folded kind, are dealt by anchor. In a task they
   form shards of bounded size. Each shard's Burrows-Wheeler transform is sorted alone; the shards
   are then merged by refining their interleave: in every round the symbols before the suffixes, in
   merged order, are sorted stably and lead to the suffixes that start with them, so that after
   ``h`` rounds the interleave is right to ``h`` symbols, and places where symbol or interval change
   bound the intervals of equal prefixes. No suffix is sorted again. The intervals left at depth
   LENGTH that hold two or more suffixes are the repeated windows. A symbol is two bytes, so that 100
   rounds reach 200 bytes.
3. An anchor with very many segments is dealt to several tasks by salt; there each interval of
   windows that its task saw once, and one window of each repeated interval, meets the other tasks'
   under its digest.

Spans of repeated windows are joined back to the texts. Strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscan.llm.common import Columns, map_batches, stored

#: Bytes of a string; bytes of a k-gram.
LENGTH, GRAM = 200, 32
#: An anchor with more segments than this is dealt by salt, so many to a task on average.
SEGMENTS = 4096
#: Bytes merged at once in a task, and bytes of one shard.
MERGED, SHARD = 1 << 20, 1 << 18
#: Ends every segment; never part of UTF-8.
END = b"\xff\xff"
POSITION = 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    size = len(data) - 7
    eight = np.empty(size, np.uint64)
    raw = data.tobytes()
    for off in range(min(8, size)):
        part = np.frombuffer(raw, "<u8", (len(raw) - off) // 8, off)
        eight[off::8] = part[:len(eight[off::8])]
    count = len(data) - GRAM + 1
    mixed = eight[:count] * FACTOR
    for k in range(8, GRAM, 8):
        mixed ^= mixed >> np.uint64(29)
        mixed *= FACTOR
        mixed += eight[k:k + count]
    mixed ^= mixed >> np.uint64(32)
    mixed *= FACTOR
    return mixed


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of the segments of a text, in order.

    A text is worked in blocks of 2**POSITION places, so that hash and place fit one number; a
    segment that a block border cuts is two.
    """
    anchors, firsts, lasts = [], [], []
    data = np.frombuffer(text, np.uint8)
    windows = len(data) - LENGTH + 1
    span = LENGTH - GRAM + 1
    for at in range(0, max(windows, 0), 1 << (POSITION - 1)):
        some = min(windows - at, 1 << (POSITION - 1))
        keys = _grams(data[at:at + some + LENGTH - 1])
        keys = (keys & ~np.uint64((1 << POSITION) - 1)) | np.arange(len(keys), dtype=np.uint64)
        width = 1
        while width < span:
            step = min(width, span - width)
            keys = np.minimum(keys[:len(keys) - step], keys[step:])
            width += step
        change = np.flatnonzero(keys[1:] != keys[:-1])
        first = np.concatenate([[0], change + 1])
        anchors.append((keys[first] >> np.uint64(POSITION)).astype(np.int64))
        firsts.append(first + at)
        lasts.append(np.concatenate([change, [some - 1]]) + at)
    if not anchors:
        none = np.empty(0, np.int64)
        return none, none, none
    return np.concatenate(anchors), np.concatenate(firsts), np.concatenate(lasts)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def found_segments(docs: DataFrame) -> DataFrame:
    """(anchor, digest, row, first, last) of every segment of (row, text)."""
    def batch(rows: Columns) -> Columns:
        anchors, firsts, lasts, digests, owners = [], [], [], [], []
        for row, text in zip(rows["row"], rows["text"], strict=True):
            data = _bytes(text)
            anchor, first, last = segments(data)
            if len(anchor):
                anchors.append(anchor)
                firsts.append(first)
                lasts.append(last)
                owners.append(np.full(len(anchor), row))
                ends = (last + LENGTH).tolist()
                digests.append(np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), ends, strict=True)], np.uint64))
        join = (lambda parts: np.concatenate(parts)) if anchors else (lambda parts: np.empty(0, np.int64))
        return {"anchor": pa.array(join(anchors)), "digest": pa.array(join(digests).astype(np.uint64).view(np.int64)),
                "row": pa.array(join(owners)), "first": pa.array(join(firsts).astype(np.int64)), "last": pa.array(join(lasts).astype(np.int64))}

    return map_batches(docs, "anchor long, digest long, row long, first long, last long", batch)


Shard = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def transform(parts: list[bytes]) -> Shard:
    """A shard's transform: (order, symbols, back, ends).

    The shard's segments are cyclic, each with its end mark. ``order`` sorts their rotations by
    LENGTH bytes at least, found by doubling. A symbol is the two bytes before a rotation, and
    ``back`` the place in the order of the rotation that starts with them. ``ends`` are the places
    of the rotations that start where a window ends, one for each window.
    """
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    offset = np.arange(len(data)) - start
    packed = np.zeros(len(data), np.uint64)
    for k in range(8):
        packed = packed << np.uint64(8) | data[start + (offset + k) % size]
    keys, depth = packed, 8
    while True:
        order = np.argsort(keys)
        ordered = keys[order]
        rank = np.empty(len(data), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if depth >= LENGTH:
            break
        keys = rank * len(data) + rank[start + (offset + depth) % size]
        depth *= 2
    place = np.empty(len(data), np.int64)
    place[order] = np.arange(len(data))
    earlier = start + (offset - 2) % size
    symbols = data[earlier].astype(np.uint16) << np.uint16(8) | data[start + (offset - 1) % size]
    ends = np.flatnonzero(((offset >= LENGTH) & (offset <= size - len(END)))[order])
    return order, symbols[order], place[earlier][order], ends


def merged_intervals(shards: list[Shard]) -> list[np.ndarray]:
    """For every shard, by place in its order, the interval of a window among all, to LENGTH bytes.

    Refines the interleave of the shards' transforms, two bytes a round: the interleave is a list of
    places, each shard's in its own order; the symbols at these places, sorted stably, give the
    interleave of the places they lead back to, right to two bytes more. Where symbol or interval
    change, an interval ends. The rotations where windows end lead back to the windows in all rounds
    together, and no other one does, so the list starts with those. A rotation alone in its interval stays alone, and so does the one it
    leads back to, so neither is carried further; its interval is a number of its own below 0.
    """
    starts = np.cumsum([0, *[len(s[0]) for s in shards]])
    symbols = np.concatenate([s[1] for s in shards])
    back = np.concatenate([s[2] + at for s, at in zip(shards, starts.tolist(), strict=False)]).astype(np.int32)
    places = np.concatenate([s[3] + at for s, at in zip(shards, starts.tolist(), strict=False)]).astype(np.int32)
    interval = np.zeros(len(places), np.int32)
    for _ in range(LENGTH // 2):
        merged = symbols[places]
        turn = np.argsort(merged, kind="stable")
        places, ordered, carried = back[places][turn], merged[turn], interval[turn]
        border = np.ones(len(places) + 1, bool)
        border[1:-1] = (ordered[1:] != ordered[:-1]) | (carried[1:] != carried[:-1])
        interval = np.cumsum(border[:-1], dtype=np.int32)
        shared = ~(border[:-1] & border[1:])
        places, interval = places[shared], interval[shared]
        if not len(places):
            break
    found = -1 - np.arange(len(symbols))
    found[places] = interval
    return [found[a:b] for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]


def repeated_windows(texts: list[bytes]) -> list[np.ndarray]:
    """For each segment the interval of every window in it, by merging the transforms of shards.

    Equal windows, and only they, have equal intervals.
    """
    members, held, size = [], [], 0
    for i, text in enumerate(texts):
        held.append(i)
        size += len(text)
        if size >= SHARD or i == len(texts) - 1:
            members.append(held)
            held, size = [], 0
    shards = [transform([texts[i] + END for i in own]) for own in members]
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    for own, (order, *_), interval in zip(members, shards, merged_intervals(shards), strict=True):
        by_place = np.empty(len(order), np.int64)
        by_place[order] = interval
        at = 0
        for i in own:
            out[i] = by_place[at:at + len(texts[i]) - LENGTH + 1]
            at += len(texts[i]) + len(END)
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, salt, salted, row, first, text) in order of anchor and salt to (row, first, last, digest).

    Anchors are merged together up to MERGED bytes; one anchor and salt is never cut, two salts of an anchor need not meet.

    Without a digest: a span of repeated windows. With one: a window to be met by other tasks.
    """
    held: list[tuple] = []
    size = 0

    def solve() -> pa.RecordBatch:
        found = repeated_windows([h[-1] for h in held])
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        rows: list[tuple] = []
        shown: set[int] = set()
        for (_, _, salted, row, first, text), own in zip(held, found, strict=True):
            twice = counts[np.searchsorted(values, own)] > 1
            border = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8)))
            rows += [(row, first + a, first + b - 1, None) for a, b in border.reshape(-1, 2).tolist()]
            if salted:
                for k, (interval, again) in enumerate(zip(own.tolist(), twice.tolist(), strict=True)):
                    if not again or interval not in shown:
                        shown.add(interval)
                        rows.append((row, first + k, first + k, xxhash.xxh3_128_digest(text[k:k + LENGTH])))
        held.clear()
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[i], pa.int64()) for i in range(3)] + [pa.array(columns[3], pa.binary())],
                                          names=["row", "first", "last", "digest"])

    last = None
    for batch in batches:
        for item in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if size >= MERGED and item[:2] != last:
                yield solve()
                size = 0
            held.append(item)
            size += len(item[-1])
            last = item[:2]
    if held:
        yield solve()


def spans(docs: DataFrame) -> DataFrame:
    """(row, first, last): runs of windows of (row, text) that start anywhere else as well; may overlap."""
    found = stored(found_segments(docs), "repeat-segments")
    seen = found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    found = stored(found.join(seen, "anchor"), "repeat-candidates")
    kinds = stored(found.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("row", "first")).alias("example")),
                   "repeat-kinds")
    shared = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    whole = found.join(kinds.filter("n > 1").select("anchor", "digest"), ["anchor", "digest"]).select("row", "first", "last")

    salted = F.col("kinds") > SEGMENTS
    open_kinds = kinds.join(shared, "anchor").select(
        "anchor", salted.alias("salted"), F.col("example.row").alias("row"), F.col("example.first").alias("first"),
        F.when(salted, F.pmod(F.xxhash64("digest"), F.ceil(F.col("kinds") / SEGMENTS))).otherwise(0).alias("salt"))
    wanted = stored(open_kinds, "repeat-open")
    per_text = wanted.groupBy("row").agg(F.collect_list(F.struct("anchor", "salted", "first", "salt")).alias("wanted"))
    texts = docs.join(per_text, "row")

    def cut(rows: Columns) -> Columns:
        out: Columns = {c: [] for c in ("anchor", "salted", "salt", "row", "first", "text")}
        for row, text, wishes in zip(rows["row"], rows["text"], rows["wanted"], strict=True):
            data = _bytes(text)
            _, firsts, lasts = segments(data)
            ends = dict(zip(firsts.tolist(), lasts.tolist(), strict=True))
            for w in wishes:
                for c in ("anchor", "salted", "salt", "first"):
                    out[c].append(w[c])
                out["row"].append(row)
                out["text"].append(data[w["first"]:ends[w["first"]] + LENGTH])
        return out

    pieces = map_batches(texts.select("row", "text", "wanted"),
                         "anchor long, salted boolean, salt long, row long, first long, text binary", cut)
    dealt = pieces.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    met = stored(dealt.select("anchor", "salt", "salted", "row", "first", "text").mapInArrow(
        _merge, "row long, first long, last long, digest binary"), "repeat-windows")
    again = met.filter("digest is not null").groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    across = met.join(again, "digest").select("row", "first", "last")
    return whole.union(met.filter("digest is null").select("row", "first", "last")).union(across)


def kept(docs: DataFrame, keep: list[str], schema: str, use) -> DataFrame:
    """Apply ``use(columns, list of (bytes, spans removed))`` to all rows of ``docs`` and its columns ``keep``.

    ``spans removed`` are maximal (start, end) runs of bytes.
    """
    texts = docs.select(*keep, F.col("text").cast("string").alias("text"))
    ids = docs.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if len(set(ids)) == 1:
        numbered = texts.withColumn("row", docs["doc_id"].cast("long"))
    else:  # ids that don't tell rows apart are replaced, once for all passes
        numbered = stored(texts.withColumn("row", F.monotonically_increasing_id()), "repeat-texts")
    out = spans(numbered.select("row", "text"))
    per_text = stored(out.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "repeat-spans")
    joined = numbered.join(per_text, "row", "left")

    def batch(rows: Columns) -> Columns:
        done = []
        for text, found in zip(rows["text"], rows["spans"], strict=True):
            runs: list[list[int]] = []
            for a, b in sorted((s["first"], s["last"] + LENGTH) for s in found or []):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            done.append((_bytes(text), runs))
        return use(rows, done)

    return map_batches(joined.select(*keep, "text", "spans"), schema, batch)


def without(data: bytes, runs: list[list[int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of (doc_id, text).

    Null and empty texts have no bytes. Texts below LENGTH bytes keep all. Repeated rows are
    separate texts, so all of their long strings repeat. An empty table gives no rows.
    """
    def use(rows: Columns, done: list) -> Columns:
        return {"doc_id": rows["doc_id"], "n_bytes": [len(d) for d, _ in done],
                "n_removed": [sum(b - a for a, b in runs) for _, runs in done], "n_spans": [len(runs) for _, runs in done],
                "kept_sha256": [hashlib.sha256(without(d, runs)).hexdigest() for d, runs in done]}

    return kept(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"],
                "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", use)
