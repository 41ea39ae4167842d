"""Decimal rounding of the exact value of a double, ties to the even digit.

Spark's own rounding takes the shortest decimal that names the double, half up:
1.0005, which is a little less than that, becomes 1.001. Here the product with the
power of ten is carried as a sum of two doubles, without any error (Dekker, 1971),
so the digit that follows is compared as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import let

SPLIT = float((1 << 27) + 1)


def _scaled(v: Column, digits: int) -> Column:
    """The whole number nearest to |v| * 10^digits, the even one of two; exact for products below 2^52. The error of the product is only looked at where the product is next to a half."""
    power = float(10**digits)
    ten_high = SPLIT * power - (SPLIT * power - power)
    ten_low = power - ten_high
    size = F.abs(v)
    product = size * power
    whole = F.floor(product).cast("double")
    over = product - whole
    high = SPLIT * size - (SPLIT * size - size)  # the upper 26 bits
    low = size - high
    # product + rest is exact
    rest = ((high * ten_high - product) + high * ten_low + low * ten_high) + low * ten_low
    # the product is off by half a unit in its last place at most
    clear = F.abs(over - 0.5) > product * 2.0**-52
    up = F.when(clear, over > 0.5).otherwise((over > 0.5) | ((over == 0.5) & ((rest > 0) | ((rest == 0) & (whole % 2 == 1)))))
    return whole + F.when(up, 1.0).otherwise(0.0)


def rounded_column(v: Column, digits: int) -> Column:
    """As ``rounded``, of a plain column: no lambda, so Spark compiles it whole. An expression would be computed at each of its places."""
    w = _scaled(v, digits) / float(10**digits)
    return F.when(F.abs(v) * 10.0**digits < 2.0**52, F.when(v < 0, -w).otherwise(w)).otherwise(v)


def rounded(x: Column, digits: int) -> Column:
    """x to some decimal digits. Numbers of over 15 digits, infinite ones and NaN stay as they are."""
    return let(x, lambda v: rounded_column(v, digits))


def fixed_column(v: Column, digits: int) -> Column:
    """As ``fixed``, of a plain column."""
    n, unit = _scaled(v, digits).cast("long"), 10**digits
    shown = n.cast("string")
    if digits:
        shown = F.concat(((n - n % unit) / unit).cast("long").cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), digits, "0"))
    return F.when(F.abs(v) * 10.0**digits < 2.0**52, F.when(v < 0, F.concat(F.lit("-"), shown)).otherwise(shown))


def fixed(x: Column, digits: int) -> Column:
    """x as text with exactly so many decimal digits; null where x is null or has over 15 digits."""
    return let(x, lambda v: fixed_column(v, digits))
