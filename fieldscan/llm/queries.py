"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan.llm import (bpe, clusters, embeddings, html, language, lexical, minhash, mixing, packing, quality, repeats, token_counts,
                           token_files)
from fieldscan.llm.common import table
from fieldscan.llm.registry import query


@query("op1_quality_rules")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_embedding_near_dedup")
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.filter(~language.held_out()))
    found = language.predict(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.rank_table(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks)


@query("op5_repeated_strings")
def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces)


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def label_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a quality weight: 2 if labelled good, 0.5 if labelled bad, 1 without a label."""
    truth = labels.filter("quality is not null and doc_id is not null") \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("label_quality"))
    weight = F.when(F.col("label_quality") > 0, 2.0).when(F.col("label_quality") <= 0, 0.5).otherwise(1.0)
    return docs.join(truth, "doc_id", "left").withColumn("quality_weight", weight).drop("label_quality")


@query("op10_source_mixing", r"""WITH truth AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
sized AS (SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  -ln((CAST('0x' || substr(md5(d.doc_id::VARCHAR || ':mix'), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
   / (CASE WHEN t.q > 0 THEN 2.0 WHEN t.q <= 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS key
  FROM documents d LEFT JOIN truth t USING (doc_id)),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS source_no, source_size * 3.0::DOUBLE AS cap FROM sizes),
levels AS (SELECT *, cap / weight AS ratio,
  ((SELECT sum(source_size) FROM sizes)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, source_no
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
targets AS (SELECT source, source_size, CASE WHEN f.final IS NULL OR ratio <= f.final THEN cap ELSE f.final * weight END AS target
  FROM levels, (SELECT min_by(level, ratio) FILTER (ratio > level) AS final FROM levels) f),
placed AS (SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(sum(s.size) OVER (PARTITION BY s.source
   ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM counted""")
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    weighted = label_weight(docs, table(spark, sf_dir, "labels"))
    return mixing.mix(weighted, F.col("quality_weight"), F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_curve_packing")
def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op12_lexical_search", r"""WITH words AS (SELECT row_number() OVER () AS row_id, doc_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row_id, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
size AS (SELECT count(*)::BIGINT AS documents, coalesce(sum(n), 0)::BIGINT AS total FROM docs),
tf AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * (SELECT documents FROM size) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, row_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // total))))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN docs USING (row_id), size GROUP BY ALL),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
  FROM scored JOIN docs USING (row_id) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clusters_sql(rounds: int) -> str:
    """The clustering query: every round computes all distances anew."""
    def assign(step: int) -> str:
        return f"""near{step} AS (SELECT row_id, cluster, distance FROM (SELECT row_id, cluster, sum((x - c) * (x - c)) AS distance
    FROM cells JOIN cent{step} USING (pos) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, cluster) = 1)"""

    def move(step: int) -> str:
        return f"""cent{step + 1} AS (SELECT o.cluster, o.pos, coalesce(m.c, o.c) AS c FROM cent{step} o LEFT JOIN (
    SELECT cluster, pos, CASE WHEN sum(x) < 0 THEN -((-sum(x) + count(*) - 1) // count(*)) ELSE sum(x) // count(*) END AS c
    FROM cells JOIN near{step} USING (row_id) GROUP BY ALL) m ON o.cluster = m.cluster AND o.pos = m.pos)"""

    steps = ",\n".join(f"{assign(s)},\n{move(s)}" for s in range(rounds))
    return f"""WITH kept AS (SELECT row_number() OVER () AS row_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64),
cells AS (SELECT row_id, unnest(list_transform(v, lambda e: floor(64 * e)::BIGINT)) AS x, generate_subscripts(v, 1) AS pos FROM kept),
start AS (SELECT row_id, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS cluster FROM kept),
cent0 AS (SELECT cluster, pos, x AS c FROM start JOIN cells USING (row_id) WHERE cluster < 16),
{steps},
{assign(rounds)},
named AS (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM cent{rounds} GROUP BY ALL)
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM near{rounds} JOIN kept USING (row_id) JOIN named USING (cluster)"""


@query("op13_centroid_clusters", clusters_sql(clusters.ROUNDS))
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))
