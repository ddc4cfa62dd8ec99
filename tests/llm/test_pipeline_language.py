import zlib

import corpus_pipeline
from tests.llm.helpers import documents, given
from tests.llm.test_html import CHINESE, POLISH, RUSSIAN

STAGE = dict(corpus_pipeline.STAGES)["language_id"]


def test_the_predicted_language_acts(spark):
    rows = [(d["doc_id"], d["text"], d["lang"]) for d in given("sf0.01")]
    known = {d[0]: d[2] for d in rows if d[1] and len(d[1].split()) > 100}
    clean = set(known)
    nulled, wrong = sorted(known)[::40], sorted(known)[20::40]
    sent = [(i, t, None if i in nulled else "en" if i in wrong and x != "en" else "de" if i in wrong else x) for i, t, x in rows]
    sent += [(50000 + i, "\n".join(lines), "en") for i, lines in enumerate((RUSSIAN, CHINESE, POLISH))] + [(50010, "12 34", "en")]
    got = {r.doc_id: r for r in STAGE(spark, documents(spark, sent), "/root/testdata/sf0.01").collect()}
    assert {i for i in got if i >= 50000} == set()
    assert clean <= set(got)
    assert {i for i, t, _ in rows if t and any(c.isalpha() for c in t)} == set(got)
    unlearned = [i for i in wrong if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(nulled) > 10 and len(unlearned) > 2
    assert [i for i in nulled + unlearned if got[i].lang != known[i]] == []
    assert sum(got[i].lang == known[i] for i in wrong) >= 0.9 * len(wrong)
