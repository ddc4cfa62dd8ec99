"""A training corpus from ``documents``: language, near duplicates, repeated passages, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan.llm import bpe, language, minhash, mixing, repeats
from fieldscan.llm.common import stored, table
from fieldscan.llm.queries import label_weight
from fieldscan.llm.registry import query

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The language model holds words and n-grams seen so often, so that a text's label does not come back through its own rare words.
LEAST_SEEN = 5
#: Least share of a document's letters in words that this model knows, or knows a 4-gram of. By trial on the given tables
#: documents with letters have 0.76 and more, texts in other languages 0.59 and less.
KNOWN_SHARE = 0.65
#: Documents of this similarity in percent, and more, are near duplicates to the pipeline; op9 has its own.
NEAR_PERCENT = 80
#: Not SQL: trained scores, hashed signatures, byte strings and tokens; tested against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with the predicted one in ``lang``.

    Those without a letter (or text) go, and those with less than KNOWN_SHARE of their letters in known words.
    """
    model = language.learn(docs.filter(~language.held_out()), least=LEAST_SEEN)
    found = language.predict(docs, model, keep=list(COLUMNS[1:]), share=True)
    good = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("known") >= KNOWN_SHARE))
    return good.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Rows that share an id are one document: the least of them stays, by text, then the other columns,
    nulls first. Null and empty texts have no near duplicates and stay. A row without an id goes. Repeated rows
    fold to one; further columns are dropped; an empty table stays empty.
    """
    good = minhash.near_duplicates(docs, NEAR_PERCENT).filter("kept").select("doc_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    least = docs.join(good, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    return least.select("doc_id", "row.*").select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that occur again; a character cut in two goes whole."""
    def use(rows, done):
        texts = [repeats.without(data, runs).decode("utf-8", "ignore") if runs else text
                 for text, (data, runs) in zip(rows["text"], done, strict=True)]
        sizes = [len(t) if runs else n for t, n, (_, runs) in zip(texts, rows["n_chars"], done, strict=True)]
        return {**{c: rows[c] for c in COLUMNS}, "text": texts, "n_chars": sizes}

    return repeats.kept(docs.select(*COLUMNS), ["doc_id", "lang", "source", "n_chars"],
                        "doc_id long, text string, lang string, source string, n_chars long", use)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a document once per whole copy taken, a last partial copy cut at its words."""
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    weighted = label_weight(sized, table(spark, sf_dir, "labels"))
    taken = mixing.mix(weighted, F.col("quality_weight"), F.col("words")).filter("taken > 0").select("doc_id", "size", "taken")
    full = mixing.copies(docs.join(taken, "doc_id"))
    return full.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, and the ids of every text."""
    ranks = bpe.rank_table(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs, ranks).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", remove_repeats),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
