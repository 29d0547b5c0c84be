"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(value: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(value, pattern, group)


def match_count(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern))


def edit_distance(left: Column, right: Column) -> Column:
    return F.levenshtein(left, right)


def hex_text(value: Column) -> Column:
    return F.hex(F.encode(value, "UTF-8"))


def base64_text(value: Column) -> Column:
    """One line of base64; Spark breaks lines after 76 characters when it is so configured."""
    return F.translate(F.base64(F.encode(value, "UTF-8")), "\r\n", "")


def json_field(document: Column, path: str) -> Column:
    return F.get_json_object(document, path)
