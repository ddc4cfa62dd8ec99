import hashlib
import zlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldscan.llm import bpe, token_files
from fieldscan.llm.registry import QUERIES, load
from fieldscan.llm.units import IRREGULAR, regular, units
from tests.llm.helpers import documents, given

load()
RANKS = bpe.rank_table(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [None, "", " ", "\n", "  a", "a  b \n\n c", "tab\tx\r\ny", "I'm we'll", "　 x", "<|endoftext|>", "語言" * 300, "a" * 3000,
       "x\n y", "\n\nq", "é \U0001f600", "a  b", "1234 567", "end ", "the the the",
       "a <|endoftext|> b", "two  <|endoftext|>\n\n<|endoftext|>x", "nul\0 in it", "word " * 50000]


def ids_digest(ids):
    return hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


@settings(max_examples=300, deadline=None)
@drawn(st.text(alphabet=st.sampled_from("ab1. \n\t\r 　'é\x0b\x85"), max_size=14))
def test_units_cut_where_the_pattern_cuts(text):
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert "".join(units(text)) == text
    assert [p for u in units(text) for p in pattern.findall(u)] == pattern.findall(text)


@settings(max_examples=400, deadline=None)
@drawn(st.text(alphabet=st.sampled_from("ab1. \n\t\r 　'é\x0b\x85\x1c\u2003"), max_size=10))
def test_regular_texts_are_those_the_pattern_leaves(text):
    assert regular(text) == (not IRREGULAR.search(text))


def test_bpe_equals_the_library(spark):
    rows = QUERIES["op4_byte_bpe"](spark, "/root/testdata/sf0.001").collect()
    texts = {d["doc_id"]: d["text"] or "" for d in given()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), ids_digest(ids))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_on_hard_texts_with_and_without_a_table(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(ODD)] + [(4, ODD[4])]).withColumn("ids", F.lit(1)).withColumn("unit", F.lit("u"))
    for most in (bpe.TABLE_UNITS, 0):
        rows = bpe.digests(docs, RANKS, most).collect()
        assert len(rows) == len(ODD) + 1
        for r in rows:
            assert r.ids_sha256 == ids_digest(LIBRARY.encode_ordinary(ODD[r.doc_id] or ""))
            assert r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0), RANKS).count() == 0


def test_native_fold_alone(spark):
    words = ["the", " encoding", "über", "語", "<|endoftext|>", "I'm", " ", "\n", "ab　", "x" * 40, "😀é"]
    frame = spark.createDataFrame([(w,) for w in words], "unit string")
    got = {r.unit: r.ids for r in bpe.encode_units(frame, RANKS).collect()}
    assert got == {w: LIBRARY.encode_ordinary(w) for w in words}


def test_frequent_keeps_within_its_bound(spark):
    frame = spark.createDataFrame([(str(i), i % 5 + 1) for i in range(100)], "unit string, n long")
    assert [bpe.frequent(frame, m).count() for m in (100, 59, 20, 19, 0)] == [100, 40, 20, 0, 0]


@settings(max_examples=200, deadline=None)
@drawn(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, (1 << 60) - 1)), max_size=300))
def test_packing_round_trip(ids):
    assert token_files.unpack(token_files.pack(np.asarray(ids, np.uint64))).tolist() == ids


def test_packing_is_dense():
    assert len(token_files.pack(np.ones(600, np.uint64))) == 80
    assert len(token_files.pack(np.full(600, 5000, np.uint64))) == 1200


def plain(texts):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # as it comes: added tokens in a text are found
    start, out = 0, []
    for doc, text in texts:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_the_given_documents(spark):
    rows = QUERIES["op6_token_files"](spark, "/root/testdata/sf0.001").collect()
    want = plain(sorted((d["doc_id"], d["text"]) for d in given()))
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_token_files_of_hard_texts(spark):
    rows = [(i * 3, t) for i, t in enumerate(ODD)]
    docs = documents(spark, rows[::-1]).withColumn("start", F.lit("x")).withColumn("words", F.lit(1)).repartition(5)
    got = token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == plain(rows)
    twice = token_files.round_trip(documents(spark, [(1, "a"), (1, "b"), (None, "c"), (1, "a")]), public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r.doc_id is not None, r.start) for r in twice.collect()) == [(False, 0), (True, 2), (True, 4), (True, 6)]
    assert token_files.round_trip(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_the_plan_holds_the_ranks_once(spark):
    """The rank literal has some MB, and every copy of the plan and of its text has as many of it as the plan."""
    ranks = {bytes([b]): b for b in range(256)} | {b"qz": 987654321}
    found = spark.createDataFrame([("qz",), ("zq",)], "unit string")
    ids = bpe.encode_units(found, ranks)
    assert ids._jdf.queryExecution().optimizedPlan().toString().count("987654321") == 1
    assert {r["unit"]: list(r["ids"]) for r in ids.collect()} == {"qz": [987654321], "zq": [122, 113]}
