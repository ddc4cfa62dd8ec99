"""Join rows to a per-key lookup when one key may own a third of the rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A lookup of this size at most is broadcast, counted as its rows times ``row_bytes``.
BROADCAST_BYTES = 16 << 20
#: Assumed for a plain column of a lookup, with its share of the hash table.
COLUMN_BYTES = 32
HOT_SHARE = 1_000
SALTS = 1_024


def lookup_join(rows: DataFrame, lookup: DataFrame, on: list[str], weight: str,
                lookup_rows: int, weight_total: int = 0, unmatched: str | None = None, row_bytes: int | None = None,
                weighed: Callable[[], tuple[DataFrame, int]] | None = None) -> DataFrame:
    """Left join ``rows`` to ``lookup`` (one row per key) without a hot task.

    ``weight`` says how many rows share a lookup key; ``weighed`` gives the lookup with its weights and
    their total, if they are to be counted only where needed. A lookup of at most
    BROADCAST_BYTES is broadcast. Beyond that, keys owning more than
    1/HOT_SHARE of the total weight are broadcast - at most HOT_SHARE keys can -
    and their rows are spread over salts in the shuffle join that serves the rest.
    Keys are compared null-safe, so a NULL group key is a group of its own. Rows
    with a NULL in the key column ``unmatched``, which the lookup never holds, are salted too.
    """
    payload = [c for c in lookup.columns if c not in on]
    if lookup_rows * (row_bytes or COLUMN_BYTES * len(lookup.columns)) <= BROADCAST_BYTES:
        return _join(rows, F.broadcast(lookup), on, payload)
    if weighed is not None:
        lookup, weight_total = weighed()
        payload = [c for c in lookup.columns if c not in on]

    hot = lookup.where(F.col(weight) * HOT_SHARE > weight_total)
    renamed = hot.select(*on, *[F.col(c).alias(f"_hot_{c}") for c in payload])
    marked = _join(rows, F.broadcast(renamed), on, [f"_hot_{c}" for c in payload])
    is_hot = F.col(f"_hot_{weight}").isNotNull()
    spread = is_hot if unmatched is None else is_hot | F.col(unmatched).isNull()
    salted = marked.withColumn("_salt", F.when(
        spread, 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(F.lit(0)))
    joined = _join(salted, lookup.withColumn("_salt", F.lit(0).cast("bigint")), on + ["_salt"], payload)
    return joined.select(*rows.columns,
                         *[F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in payload])


def _join(rows: DataFrame, lookup: DataFrame, on: list[str], payload: list[str]) -> DataFrame:
    right = lookup.select(*[F.col(c).alias(f"_key_{c}") for c in on], *payload)
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in on])
    return rows.join(right, match, "left").drop(*[f"_key_{c}" for c in on])
