"""Price algebra of listings as column expressions.

Columns are price, list_price, shipping, fees (doubles, the last three may be null), sizes
(array), size_prices (map), in_stock and condition; a null or zero list price is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the double itself, which engines agree on."""
    k = float(10**digits)
    return F.when(x < 0, -F.floor(-x * k + 0.5) / k).otherwise(F.floor(x * k + 0.5) / k)


def money(x: Column) -> Column:
    return rounded(x, 2)


def size_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "^0+", "")


def price_for(size: str = "") -> Column:
    """The price in a size: by the seller's curve if it has the size, else the headline price."""
    if not size:
        return F.col("price")
    hit = F.filter(F.map_entries("size_prices"), lambda e: size_key(e["key"]) == size_key(F.lit(size)))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["value"], F.col("price"))


def extras() -> Column:
    return money(F.coalesce("shipping", F.lit(0.0)) + F.coalesce("fees", F.lit(0.0)))


def total_for(size: str = "") -> Column:
    return money(price_for(size) + extras())


def discount_for(size: str = "") -> Column:
    p, top = price_for(size), F.col("list_price")
    return F.when((top > 0) & (p < top), rounded((1 - p / top) * 100, 1)).otherwise(0.0)


def premium_for(size: str = "") -> Column:
    p, top = price_for(size), F.col("list_price")
    return F.when((top > 0) & (p > top), rounded((p / top - 1) * 100, 1)).otherwise(0.0)


def has_size(size: str = "") -> Column:
    if not size:
        return F.lit(True)
    known = F.concat(F.coalesce("sizes", F.array().cast("array<string>")), F.coalesce(F.map_keys("size_prices"), F.array().cast("array<string>")))
    return F.exists(known, lambda s: size_key(s) == size_key(F.lit(size)))


def listing_id(source: Column, url: Column) -> Column:
    return F.substring(F.sha1(F.lower(F.concat_ws("|", source, url))), 1, 16)
