import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldscan.llm import quality
from fieldscan.llm.registry import QUERIES, load
from tests.llm.helpers import documents, given

load()


def slow_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n")]
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_base_statistics_equal_a_plain_count(spark):
    rows = QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.001").collect()
    texts = {d["doc_id"]: d["text"] for d in given()}
    assert len(rows) == len(texts)
    for r in rows:
        want = slow_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_hard_texts(spark):
    odd = [None, "", " \n\t ", "a b c d e f a b c d e", "x y z　w", "é " * 50000, "l\nl\n \nl", "a\vb\fc\rd", "##" * 9]
    docs = documents(spark, [(i, t, None if i % 2 else "en") for i, t in enumerate(odd)] + [(3, odd[3], "en")]) \
        .withColumn("stratum", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(7))
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, None), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == len(odd) + 1
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_stats(odd[r.doc_id])
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_upper_bound_is_the_exact_binomial_one():
    for failures, trials, error in ((0, 50, 0.01), (3, 200, 0.05), (10, 10, 0.1), (7, 40, 1e-4)):
        p = quality.upper_bound(failures, trials, error)
        tail = sum(math.comb(trials, i) * p**i * (1 - p)**(trials - i) for i in range(failures + 1))
        assert p == 1.0 if failures == trials else tail == pytest.approx(error, rel=1e-6)


def test_certified_needs_evidence_and_is_lenient():
    cells = len(quality.GRID) + 1
    good, bad = [0] * cells, [0] * cells
    good[0], bad[-1] = 5000, 300
    assert quality.certified(good, bad, 100) == quality.GRID[-1]
    good[0] = 20
    assert quality.certified(good, bad, 100) is None
    good[0], good[-1] = 5000, 400
    assert quality.certified(good, bad, 100) is None


def test_bad_documents_go_and_good_ones_stay(spark):
    rows = QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.1").filter("not base_failed").collect()
    truth = {r["doc_id"]: r["quality"] for r in given("sf0.1", "labels")}
    good = [r.kept for r in rows if truth.get(r.doc_id) == 1]
    assert sum(good) >= 0.99 * len(good)
    langs = {d["doc_id"]: d["lang"] for d in given("sf0.1")}
    labelled = Counter(langs[r.doc_id] for r in rows if truth.get(r.doc_id) == 1)
    error = (1 - quality.CONFIDENCE) / (len(labelled) * len(quality.RULES) * len(quality.GRID))
    able = {lang for lang, n in labelled.items() if quality.upper_bound(0, n, error) <= quality.RISK / 2}
    assert able
    bad = [r.kept for r in rows if truth.get(r.doc_id) == 0 and langs[r.doc_id] in able]
    assert sum(bad) <= 0.05 * len(bad)
