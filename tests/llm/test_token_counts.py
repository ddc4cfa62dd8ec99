import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from fieldscan.llm import token_counts
from fieldscan.llm.registry import QUERIES, load
from tests.llm.helpers import documents, given

load()
PIECES = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def library(pieces):
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return tokenizer


def test_counts_equal_the_library(spark):
    own = library(PIECES)
    texts = {d["doc_id"]: d["text"] for d in given()}
    rows = QUERIES["op7_token_counts"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_ties_unknowns_and_hard_texts(spark):
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("b", -3.0), ("ab", -4.0), ("▁aa", -3.0)]
    own = library(pieces)
    odd = [None, "", " ", "a", "aaaa", "a  b", " ab ▁a", "xyz a語b", "a" * 5000, "▁▁", "b\nb"]
    docs = documents(spark, [(i, t) for i, t in enumerate(odd)]).withColumn("n_tokens", F.lit("x"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, pieces).collect()}
    assert got == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(odd)}
    assert token_counts.count_tokens(docs.limit(0), pieces).count() == 0
