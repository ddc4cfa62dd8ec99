"""Identifiers, fingerprints, lists kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldscan import constants as C


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def is_hex_digest(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-f]{64}$"), F.lit(False))


OMITTED = "[credentials omitted]"


def scrub_credentials(text: Column) -> Column:
    """Web addresses in a message without what follows their first question mark.

    The message is cut at white space, each part that holds ``http://`` or ``https://`` before a question
    mark is shortened, and a closing quote is kept.
    """
    def shortened(part: Column) -> Column:
        head = F.substring_index(part, "?", 1)
        closing = F.when(F.right(part, F.lit(1)).isin("'", '"'), F.right(part, F.lit(1))).otherwise("")
        query = F.substr(part, F.length(head) + 2, F.length(part) - F.length(head) - 1 - F.length(closing))
        address = head.contains("http://") | head.contains("https://")
        return F.when(address & (F.length(query) > 0), F.concat(head, F.lit(f"?{OMITTED}"), closing)).otherwise(part)

    return F.array_join(F.transform(F.split(text, r"(?<=\s)|(?=\s)"), shortened), "")


def product_id_ok(scene_id: Column, platform: Column, acquired_at: Column) -> Column:
    """Product name, platform letter and acquisition second must agree."""
    parts = F.split(scene_id, "_")
    return F.coalesce(
        scene_id.rlike(r"^S2[ABC]_MSIL2A_") & platform.isin(*C.PLATFORMS)
        & (F.substring(scene_id, 3, 1) == F.right(platform, F.lit(1)))
        & (F.get(parts, F.lit(2)) == F.date_format(acquired_at, "yyyyMMdd'T'HHmmss")),
        F.lit(False))


def sorted_json(fields: dict[str, Column]) -> Column:
    """JSON object text with its keys in sorted order."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]),
                     {"ignoreNullFields": "false"})


def fingerprint(fields: dict[str, Column]) -> Column:
    return F.sha2(sorted_json(fields), 256)


def canonical_json_hash(text: Column) -> Column:
    """SHA-256 of a JSON document with keys sorted at every depth and types kept; invalid JSON fails."""
    return F.sha2(F.to_json(F.parse_json(text)), 256)


def canonical_text_hash(text: Column) -> Column:
    """SHA-256 after CRLF -> LF."""
    return F.sha2(F.regexp_replace(text, "\r\n", "\n"), 256)


def join_list(items: Column, separator: str = ";") -> Column:
    return F.array_join(items, separator)


def split_list(text: Column, separator: str = ";") -> Column:
    return F.split(text, separator)


def ordered_union(*lists: Column) -> Column:
    """Distinct union, first occurrence wins."""
    return F.array_distinct(F.concat(*lists))


def purpose_of(use_case: Column) -> Column:
    pairs = [F.lit(part) for item in C.USE_CASE_PURPOSE.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), use_case)
