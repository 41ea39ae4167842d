"""Canonical JSON of fixed shapes as column expressions: sorted keys, no spaces, ASCII only.

The text is built from the columns, so that content ids need no Python worker.
``operators.nested`` rewrites JSON of any shape.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The escapes of JSON that have a short form, by their UTF-16 code.
SHORT = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "000C": "\\f", "000A": "\\n", "000D": "\\r", "0009": "\\t"}


def json_text(c: Column) -> Column:
    """A JSON string; what is not printable ASCII is escaped as UTF-16 units. Null gives null."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1))

    def one(u: Column) -> Column:
        shown = F.when(u.between("0020", "007E"), F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))
        for code, text in SHORT.items():
            shown = F.when(u == code, F.lit(text)).otherwise(shown)
        return shown

    plain = c.rlike(r"^[ !#-\[\]-~]*$")
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(F.array_join(F.transform(units, one), "")), F.lit('"'))


def json_number(c: Column, digits: int = 4) -> Column:
    """A double with at most ``digits`` decimals, as the shortest decimal text; whole numbers keep one zero."""
    t = F.regexp_replace(F.round(c, digits).cast(f"decimal(30,{digits})").cast("string"), r"(\.\d*?)0+$", "$1")
    return F.when(t.endswith("."), F.concat(t, F.lit("0"))).otherwise(t)


def json_list(c: Column) -> Column:
    """An array of strings."""
    return F.concat(F.lit("["), F.array_join(F.transform(c, json_text), ","), F.lit("]"))


def json_map(c: Column) -> Column:
    """A map of strings, by key; null values are null."""
    pairs = F.array_sort(F.map_entries(c))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(json_text(e["key"]), F.lit(":"), F.coalesce(json_text(e["value"]), F.lit("null")))), ","), F.lit("}"))


def json_object(**parts: Column) -> Column:
    """An object of JSON texts, its keys sorted; null texts are null."""
    rows = [F.concat(F.lit(f'"{k}":'), F.coalesce(parts[k], F.lit("null"))) for k in sorted(parts)]
    return F.concat(F.lit("{"), F.concat_ws(",", *rows), F.lit("}"))


def digest(prefix: str, source: Column, length: int = 24) -> Column:
    """``prefix`` and the first hex digits of the SHA-256 of a text."""
    return F.concat(F.lit(prefix), F.left(F.sha2(source, 256), F.lit(length)))
