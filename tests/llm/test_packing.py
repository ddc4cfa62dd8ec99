import itertools
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldscan.llm import packing
from fieldscan.llm.registry import QUERIES, load
from tests.llm.helpers import documents, given

load()
FILE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)
ODD = [None, "", " ", "\n \t", "It's don't we'll 's", "a<|endoftext|>Bx's <|ENDOFTEXT|>.", "Ünïcödé İstanbul ΣΑΣ ½² Ⅷ", "éa ́b", "語言" * 3000,
       "x y z\x1cq", "end...,,, 123 a1b2 --", "Word " * 9000, "a" * 5000, "नमस्ते", "same text", "same text", "$$$ price.%% ª º"]


def plain(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, texts, length=2048):
    """``texts`` lists (doc_id, text); every id lies in one piece, sequences are gapless, sizes full or powers of two."""
    docs = {}
    for doc, text in texts:
        docs.setdefault(doc, []).append(plain(text))
    found = {}
    for r in rows:
        found.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert {k for k, _ in found} == set(docs)
    for (doc, total), pieces in found.items():
        wanted = [ids for ids in docs[doc] if len(ids) == total]
        cover = sorted((p.start, p.length) for p in pieces)
        assert sum(n for _, n in cover) == total * len(wanted) and wanted
        for p in pieces:
            crcs = [zlib.crc32(np.asarray(ids[p.start:p.start + p.length], "<u4").tobytes()) for ids in wanted]
            assert p.ids_crc32 in crcs
        if len(wanted) == 1:
            assert [s for s, _ in cover] == list(itertools.accumulate([n for _, n in cover[:-1]], initial=0))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(itertools.accumulate([n for _, n in pieces[:-1]], initial=0))
        size = sum(n for _, n in pieces)
        assert size == length or (size < length and size & (size - 1) == 0)


def test_pieces_of_the_given_documents(spark):
    rows = QUERIES["op11_curve_packing"](spark, "/root/testdata/sf0.001").collect()
    check(rows, [(d["doc_id"], d["text"]) for d in given()])


def test_pieces_of_hard_texts(spark):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(14, "other"), (None, "no id"), (14, "same text")]
    docs = documents(spark, texts).withColumn("ids", F.lit("x")).withColumn("key", F.lit(1)).repartition(5)
    for length in (2048, 64, 1):
        rows = packing.packed(docs, FILE, length).withColumn("ids_crc32", F.crc32("ids")).collect()
        check(rows, texts, length)
    assert packing.packed(docs.limit(0), FILE).count() == 0


def test_runs_agree(spark):
    docs = spark.createDataFrame([(d["doc_id"], d["text"]) for d in given()], "doc_id long, text string")
    one, two = (sorted(map(tuple, packing.packed(docs.repartition(n), FILE).select("doc_id", "start", "length").collect())) for n in (3, 3))
    assert one == two


def test_curve_visits_every_cell_step_by_step():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        along = cells[np.argsort(keys)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_are_alike():
    """Documents of one language share words: along the curve neighbours agree more often than at random."""
    docs = [d for d in given("sf0.01") if d["text"] and d["lang"]]
    ids = [np.asarray(plain(d["text"])) for d in docs]
    points = packing.document_points(np.concatenate(ids), np.concatenate([[0], np.cumsum([len(i) for i in ids])]))
    order = np.argsort(packing.hilbert_keys(points, packing.BITS), kind="stable")
    langs = np.array([d["lang"] for d in docs])
    alike = (langs[order][1:] == langs[order][:-1]).mean()
    chance = sum((langs == x).mean() ** 2 for x in set(langs))
    assert alike > chance + 0.3


def test_powers():
    assert packing.powers(0) == [] and packing.powers(2047) == [1 << b for b in range(10, -1, -1)]
