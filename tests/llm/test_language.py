from pyspark.sql import functions as F

from fieldscan.llm import language
from fieldscan.llm.registry import QUERIES, load
from tests.llm.helpers import documents, given

load()


def test_held_out_accuracy(spark):
    rows = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {d["doc_id"]: (d["lang"], len((d["text"] or "").split())) for d in given("sf0.01")}
    tested = [(r.lang_pred, *truth[r.doc_id]) for r in rows if r.held_out]
    assert len(tested) > 200
    assert sum(p == t for p, t, _ in tested) >= 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows)


def test_hard_texts_and_no_other_inputs(spark):
    learn = documents(spark, [(i, t, lang) for i, (t, lang) in enumerate(
        [("the cat sat on the mat", "en"), ("der hund und die katze", "de"), (None, "en"), ("lost", None)] * 20)])
    model = language.learn(learn)
    assert model.langs == ["de", "en"]
    odd = [None, "", "123 !!", "the", "hundkatze", "THE CAT", "der " * 20000, "語語"]
    docs = documents(spark, [(i, t) for i, t in enumerate(odd)]).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    assert [got[i][0] for i in range(7)] == ["und", "und", "und", "en", "de", "en", "de"]
    assert got[0][1] == 0.0 and got[7][0] in ("de", "en")
    nothing = language.learn(learn.limit(0))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_backoff_uses_the_longest_known_order():
    keys = [(0, "word"), (4, "^xyz"), (1, "x"), (3, "^wo")]
    model = language.Model(["a", "b"], keys, [[5, 0], [0, 3], [9, 0], [1, 0]])
    for word, key in (("word", (0, "word")), ("xyzq", (4, "^xyz")), ("wot", (3, "^wo")), ("axb", (1, "x"))):
        assert model.word(word) == model.known[key[0]][key[1]]
    assert model.word("qq") == (0.0, 0.0)


def test_holding_out_follows_the_id():
    import zlib
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(8)].count(True) in range(0, 8)


def test_letters_are_letters_with_their_marks():
    text = "½² Ⅷ ① 12 _ x² 一二 नमस्ते, e\u0301te\u0301! a1b"
    found = ["x", "一二", "नमस्ते", "e\u0301te\u0301", "a", "b"]
    assert language.letters(text) == found and language.letters(text + " \U0001f600 \U00010400\U00010401") == [*found, "\U00010400\U00010401"]
    assert language.letters("½² Ⅷ ① 3 - \U0001f600") == []


def test_forgetting_changes_no_score(monkeypatch):
    monkeypatch.setattr(language, "REMEMBERED", 10)
    monkeypatch.setattr(language, "SPARE", 5)
    model = language.Model(["a", "b"], [(0, f"w{c}") for c in "abcdefgh"] + [(1, c) for c in "xyz"], [[i, 11 - i] for i in range(11)])
    tokens = language._Remembered(model, share=True)
    for start in range(0, 300, 20):
        words = [f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3] * (i % 40)}" for i in range(start, start + 20)]
        for word in words:
            at = tokens[word]
            row = tokens.rows[at]
            known = sum(len(w) for w in language.letters(word) if model.knows(w))
            assert (*row[:-2], row[-1]) == model.token(word) and row[-2] == known
        tokens.trim()
        assert len(tokens) <= 15 and len(tokens.rows) <= 15
