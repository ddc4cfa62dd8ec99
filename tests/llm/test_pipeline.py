from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from fieldscan.llm import bpe
from fieldscan.llm.common import stored
from tests.llm.helpers import documents, given
from tests.llm.test_near_duplicates import slow_documents
from tests.llm.test_repeats import slow

RANKS = bpe.rank_table(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_every_stage_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(d["doc_id"], d["text"], d["lang"], d["source"]) for d in given()] + [(9001, None), (9002, "12 34"), (9003, "")]
    docs, before = documents(spark, rows), {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), name)
        got = docs.collect()
        if name == "language_id":
            assert {r.doc_id: r.text for r in got} == {i: t for i, t in before.items() if i < 9001}
        elif name == "near_duplicates":
            assert {r.doc_id for r in got} == {r[0] for r in slow_documents(before.items(), corpus_pipeline.NEAR_PERCENT) if r[3]}
        elif name == "repeated_strings":
            gone = {r[0]: r[2] for r in slow(before.items())}
            assert len(got) == len(before)
            assert all(len(r.text.encode()) <= len(before[r.doc_id].encode()) - gone[r.doc_id] for r in got)
            assert all(r.text == before[r.doc_id] for r in got if not gone[r.doc_id])
        elif name == "source_mixing":
            assert max(Counter(r.doc_id for r in got).values()) <= 3
            assert all(before[r.doc_id].startswith(r.text.rstrip()) for r in got)
        else:
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
            want = Counter((i, tuple(library.encode_ordinary(t))) for i, t in mixed)
            assert Counter((r.doc_id, tuple(memoryview(r.ids).cast("I").tolist())) for r in got) == want
            break
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        before = {r.doc_id: r.text for r in got}
        mixed = [(r.doc_id, r.text) for r in got]


def test_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0
