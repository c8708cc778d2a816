"""Identifiers in one spelling, whatever sender wrote them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_id(col: Column, digits: int) -> Column:
    """A hexadecimal number as `digits` lower-case digits; null if it has no value.

    Spaces around it, a 0x prefix, dashes, braces, upper case and missing or surplus leading zeros
    do not matter. Null, blank, zero, too long and non-hexadecimal values give null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), "^\\{?0x", ""), "[\\s{}\\-]", "")
    digits_only = F.ltrim(bare, F.lit("0"))
    fits = digits_only.rlike(f"^[0-9a-f]{{1,{digits}}}$")
    plain = col.rlike(f"^[0-9a-f]{{{digits}}}$") & (col != F.lit("0" * digits))
    return F.when(plain, col).when(fits, F.lpad(digits_only, digits, "0"))


def trace_id(col: Column) -> Column:
    return hex_id(col, 32)


def span_id(col: Column) -> Column:
    return hex_id(col, 16)


def message_id(col: Column) -> Column:
    """A UUID as 8-4-4-4-12 lower-case digits; other texts trimmed and lowered; blank gives null.

    Braces, the urn:uuid: prefix, missing dashes, spaces and upper case do not matter.
    """
    low = F.lower(F.trim(col))
    bare = F.regexp_replace(F.regexp_replace(low, "^urn:uuid:", ""), "[\\s{}\\-]", "")
    cut = [F.substring(bare, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    plain = col.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return (
        F.when(plain, col)
        .when(bare.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *cut))
        .when(F.length(low) > 0, low)
    )


def tenant(col: Column) -> Column:
    """A null project stands for the project `default`."""
    return F.coalesce(col, F.lit("default"))
