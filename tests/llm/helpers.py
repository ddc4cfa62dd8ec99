"""Small documents with the hard cases: nulls, empty and long texts, ties, repeats, clashing extra columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def given(folder="sf0.001", table="documents"):
    import pyarrow.parquet as pq
    return pq.read_table(f"/root/testdata/{folder}/{table}.parquet").to_pylist()
