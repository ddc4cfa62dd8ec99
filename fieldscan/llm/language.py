"""Language identification with words first and character n-grams behind them.

A model holds, per language, log frequencies of known words and of character n-grams of words
(``^word$``), orders 4 to 1. A known word is scored by its own frequencies. An unseen word falls
back to its known 4-grams; with none known, to 3-grams, and so on. A text's score per language is
the sum over its words.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscan.llm.common import Columns, map_arrow, map_batches, stored, worker_state

#: The classifier is fitted on about so many labelled documents, chosen by a hash of their id.
LEARN_DOCUMENTS = 20_000
#: Longest n-gram, and the entries of words and n-grams that a model holds at most (most frequent first).
ORDERS, WORD_ENTRIES, GRAM_ENTRIES = 4, 60_000, 60_000
#: Added to every count.
SMOOTH = 0.5
UNKNOWN = "und"


def _class(holds: Callable[[str], bool], most: int) -> str:
    """The characters up to ``most`` that satisfy ``holds``, as ranges of a character class."""
    ranges: list[list[int]] = []
    for code in range(most + 1):
        if holds(chr(code)):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in ranges)


@cache
def _words(most: int) -> re.Pattern:
    letter, mark = _class(str.isalpha, most), _class(lambda c: unicodedata.category(c) in ("Mn", "Mc"), most)
    return re.compile(f"[{letter}]+(?:[{mark}]+[{letter}]*)*")


#: Letters with the combining marks behind them; numerals such as superscripts, fractions and circled digits are no letters.
LETTERS = _words(0xFFFF)
#: Characters that only a wider, slower pattern knows; it is made when one occurs.
WIDE = re.compile("[\U00010000-\U0010ffff]")


def letters(text: str) -> list[str]:
    """The runs of letters of a text."""
    return (_words(sys.maxunicode) if not text.isascii() and WIDE.search(text) else LETTERS).findall(text)


#: Distinct tokens whose scores a Python worker remembers, and so many more until it forgets those.
REMEMBERED, SPARE = 150_000, 100_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(word: str, order: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i:i + order] for i in range(len(marked) - order + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows: Counter = Counter()
        for lang, words in counts.items():
            for word, n in words.items():
                rows[lang, 0, word] += n
                for order in range(1, ORDERS + 1):
                    for gram in grams(word, order):
                        rows[lang, order, gram] += n
        counts.clear()
        keys = list(rows)
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([k[2] for k in keys], pa.string()), pa.array([rows[k] for k in keys], pa.int64())],
            names=["lang", "order", "gram", "n"])

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(letters((text or "").lower()))
        if sum(map(len, counts.values())) > 300_000:
            yield flush()
    if counts:
        yield flush()


class Model:
    """Log frequencies by language, ``known[order][gram]``; order 0 holds words."""

    def __init__(self, langs: list[str], keys: list[tuple[int, str]], counts: np.ndarray):
        """``counts``: one row per key, one column per language."""
        self.langs = langs
        orders = np.array([order for order, _ in keys], int)
        counts = np.asarray(counts, float).reshape(len(keys), len(langs))
        table = np.log(counts + SMOOTH)
        for order in range(ORDERS + 1):
            rows = orders == order
            table[rows] -= np.log(counts[rows].sum(axis=0) + SMOOTH * rows.sum() + 1e-9)
        self.known: list[dict[str, tuple[float, ...]]] = [{} for _ in range(ORDERS + 1)]
        for (order, gram), row in zip(keys, table.tolist(), strict=True):
            self.known[order][gram] = tuple(row)

    def word(self, word: str) -> tuple[float, ...]:
        found = self.known[0].get(word)
        if found is not None:
            return found
        marked = f"^{word}$"
        for order in range(ORDERS, 0, -1):
            get = self.known[order].get
            hits = [v for i in range(len(marked) - order + 1) if (v := get(marked[i:i + order])) is not None]
            if hits:
                return tuple([sum(column) / len(hits) for column in zip(*hits, strict=True)])
        return (0.0,) * len(self.langs)

    def knows(self, word: str) -> bool:
        """Whether the word, or one of its n-grams of the longest order, was learned."""
        return word in self.known[0] or any(gram in self.known[ORDERS] for gram in grams(word, ORDERS))

    def token(self, token: str) -> tuple[float, ...]:
        """Scores of a space-delimited token, and its number of letters."""
        words = letters(token.lower())
        if len(words) == 1:
            return (*self.word(words[0]), len(words[0]))
        scores = [self.word(w) for w in words] or [(0.0,) * len(self.langs)]
        return (*[sum(column) for column in zip(*scores, strict=True)], sum(map(len, words)))


def learn(docs: DataFrame, documents: int = LEARN_DOCUMENTS, least: int = 1) -> Model:
    """Fit on about ``documents`` rows of (doc_id, text, lang); rows without text or lang teach nothing.

    Words and n-grams are counted by the executors; the driver receives the most frequent entries
    only, at most WORD_ENTRIES words and GRAM_ENTRIES n-grams. Entries seen fewer than ``least``
    times are left out.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = known.count()
    share = min(1.0, documents / max(rows, 1))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    parts = chosen.select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counted = stored(map_arrow(parts, _count, "lang string, order int, gram string, n long"), "language-counts")
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    by_lang = F.array(*[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)) for lang in langs])
    grouped = counted.groupBy("order", "gram").agg(F.sum("n").alias("total"), by_lang.alias("counts")) if langs else None
    keys: list[tuple[int, str]] = []
    counts: list[np.ndarray] = []
    for words, most in ((True, WORD_ENTRIES), (False, GRAM_ENTRIES)) if langs else ():
        top = grouped.filter(((F.col("order") == 0) == F.lit(words)) & (F.col("total") >= least)).orderBy(F.desc("total"), "order", "gram").limit(most)
        found = top.select("order", "gram", "counts").toArrow()
        keys += zip(found["order"].to_pylist(), found["gram"].to_pylist(), strict=True)
        counts.append(np.array(found["counts"].combine_chunks().flatten()).reshape(-1, len(langs)))
    return Model(langs, keys, np.concatenate(counts) if counts else np.zeros((0, 0)))


class _Remembered(dict):
    """Token to row of ``rows``; filled on demand, up to REMEMBERED tokens."""

    def __init__(self, model: Model, share: bool = False):
        super().__init__()
        self.model, self.share = model, share
        self.rows = np.zeros((REMEMBERED + SPARE, len(model.langs) + share + 1))
        self.used = 0

    def __missing__(self, token: str) -> int:
        if self.used == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows[:SPARE])])
        at = self.used
        scores = self.model.token(token)
        if self.share:
            known = sum(len(w) for w in letters(token.lower()) if self.model.knows(w))
            scores = (*scores[:-1], known, scores[-1])
        self.rows[at] = scores
        self[token] = at
        self.used += 1
        return at

    def trim(self) -> None:
        """Forget what came last when there are many more; called between texts."""
        if self.used > REMEMBERED + SPARE:
            for token in list(self)[REMEMBERED:]:
                del self[token]
            self.used = REMEMBERED
            self.rows = self.rows[:REMEMBERED + SPARE].copy()


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, share: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score), and columns ``keep``, of every row of (doc_id, text), by text alone.

    ``score`` is the posterior of the predicted language under equal priors. Null texts and texts
    without a letter are ``und`` with score 0; so is everything if the model has learned no
    language. Ties go to the first language in code-point order. One row per input row. With ``share`` a column ``known`` gives the share of the
    letters in words that the model knows, or knows a longest n-gram of; 0 where the language is ``und``.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def batch(rows: Columns) -> Columns:
        tokens: _Remembered = worker_state(key, lambda: _Remembered(sent.value, share))
        langs = tokens.model.langs
        names, scores, known = [], [], []
        for text in rows["text"]:
            idx = np.fromiter(map(tokens.__getitem__, (text or "").split()), np.int64)
            sums = tokens.rows[idx].sum(axis=0) if len(idx) else np.zeros(len(langs) + share + 1)
            if not langs or sums[-1] == 0:
                names.append(UNKNOWN)
                scores.append(0.0)
                known.append(0.0)
            else:
                own = sums[:len(langs)]
                best = int(np.argmax(own))
                names.append(langs[best])
                scores.append(float(1 / np.exp(np.minimum(0, own - own[best])).sum()))
                known.append(float(sums[-2] / sums[-1]))
            tokens.trim()
        return {**rows, "lang_pred": names, "score": scores, **({"known": known} if share else {})}

    more = [docs.schema[c] for c in keep or [] if c not in ("doc_id", "text")]
    schema = "doc_id long, text string, lang_pred string, score double" + ", known double" * share + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in more)
    if "text" not in (keep or []):
        schema = schema.replace("text string, ", "")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[f.name for f in more])
    return map_batches(narrow, schema, batch)
