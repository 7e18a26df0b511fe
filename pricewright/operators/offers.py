"""Offers of products: eligibility, ranking, savings, votes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.functions import pricing as p
from pricewright.functions.text import slug, style_code


@dataclass(frozen=True)
class Spec:
    """A question in structured form."""

    text: str = ""
    brands: tuple[str, ...] = ()
    terms: str = ""
    style_code: str = ""
    size: str = ""
    gender: str = ""
    max_price: float | None = None
    min_discount: float | None = None
    condition: str = ""
    in_stock_only: bool = True
    include_shipping: bool = True
    top_k: int = 40
    intent: str = "compare"
    notes: tuple[str, ...] = field(default=())

    def describe(self) -> str:
        bits = [
            f"brand={'/'.join(self.brands)}" if self.brands else "",
            f"model~{self.terms}" if self.terms else "",
            f"sku={self.style_code}" if self.style_code else "",
            f"size={self.size}" if self.size else "",
            f"gender={self.gender}" if self.gender else "",
            f"under ${self.max_price:g}" if self.max_price else "",
            f"condition={self.condition}" if self.condition else "",
        ]
        return ", ".join(filter(None, bits)) or "(no filters)"


def passes(spec: Spec) -> Column:
    """The conjunction of a question's filters; budget and discount hold for the size asked for."""
    tests = [F.lit(True)]
    if spec.brands:
        tests.append(F.col("brand").isin(*spec.brands))
    if spec.in_stock_only:
        tests.append(F.col("in_stock"))
    if spec.size:
        tests.append(p.has_size(spec.size))
    if spec.condition:
        tests.append(F.col("condition") == spec.condition)
    if spec.gender:
        tests.append(F.col("gender").isin("", spec.gender, "unisex"))
    if spec.max_price is not None:
        tests.append((p.total_for(spec.size) if spec.include_shipping else p.price_for(spec.size)) <= spec.max_price)
    if spec.min_discount is not None:
        tests.append(p.discount_for(spec.size) >= spec.min_discount)
    return reduce(lambda a, b: a & b, tests)


def ranked(listings: DataFrame, size: str = "", in_stock_only: bool = True, include_shipping: bool = True, condition: str = "", product: str = "product") -> DataFrame:
    """Eligible offers with unit_price, total and offer_rank within their product; ties by listing id."""
    ok = p.has_size(size)
    if in_stock_only:
        ok = ok & F.col("in_stock")
    if condition:
        ok = ok & (F.col("condition") == condition)
    rows = listings.where(ok).withColumns({"unit_price": p.price_for(size), "total": p.total_for(size)})
    order = ["total", "unit_price"] if include_shipping else ["unit_price", "total"]
    return rows.withColumn("offer_rank", F.row_number().over(Window.partitionBy(product).orderBy(*order, "listing_id")))


def best(listings: DataFrame, product: str = "product", **how) -> DataFrame:
    return ranked(listings, product=product, **how).where("offer_rank = 1")


def savings(listings: DataFrame, product: str = "product", **how) -> DataFrame:
    """Total of the last ranked offer less that of the first; 0 for a single offer. A plain aggregate: no window."""
    rows = ranked(listings, product=product, **how)
    return rows.groupBy(product).agg(
        F.count("*").alias("offers"),
        p.money(F.max_by("total", "offer_rank") - F.min_by("total", "offer_rank")).alias("saving"),
    )


def price_range(listings: DataFrame, size: str = "", product: str = "product") -> DataFrame:
    rows = listings.where(F.col("in_stock") & p.has_size(size))
    return rows.groupBy(product).agg(F.min(p.total_for(size)).alias("lowest"), F.max(p.total_for(size)).alias("highest"))


def availability(listings: DataFrame, product: str = "product") -> DataFrame:
    """Whether a product is sold outside resale, and whether resale has it."""
    resale = F.col("source_kind") == "resale"
    return listings.groupBy(product).agg(
        F.coalesce(F.bool_or(~resale & F.col("in_stock")), F.lit(False)).alias("at_retail"),
        F.coalesce(F.bool_or(resale), F.lit(False)).alias("has_resale"),
    )


def msrp(listings: DataFrame, product: str = "product") -> DataFrame:
    """The price of the first brand-store listing (in stock first, then by total) that is not discounted, else the largest list price."""
    order = F.struct((~F.col("in_stock")).alias("a"), p.total_for().alias("b"), F.col("listing_id").alias("c"))
    full = (F.col("source_kind") == "brand") & (p.discount_for() == 0)
    return listings.groupBy(product).agg(F.coalesce(F.min_by(F.when(full, F.col("price")), F.when(full, order)), F.max(F.nullif("list_price", F.lit(0.0)))).alias("msrp"))


def vote(rows: DataFrame, attributes: Sequence[str], product: str = "product") -> DataFrame:
    """The most frequent non-empty value of each attribute by product; ties to the longest, then the last in order; '' if none.

    All attributes are counted in one aggregation by (product, attribute, value), so a hot
    product is combined before it is shuffled.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.trim(F.coalesce(F.col(a).cast("string"), F.lit(""))).alias("v")) for a in attributes)))
    counts = rows.select(product, pairs.alias("x")).groupBy(product, "x.a", "x.v").agg(F.count("*").alias("n"))
    weight = F.struct(F.when(F.col("v") == "", 0).otherwise(F.col("n")).alias("n"), F.length("v").alias("l"), F.col("v").alias("v"))
    return counts.groupBy(product).agg(*(F.coalesce(F.max(F.when(F.col("a") == a, weight))["v"], F.lit("")).alias(a) for a in attributes))


def product_key(brand: Column, model: Column, colorway: Column, code: Column, gender: Column) -> Column:
    """brand:code, or the slugs of what is known."""
    by_code = F.lower(F.replace(F.concat_ws(":", brand, style_code(code)), F.lit(" "), F.lit("-")))
    parts = F.concat_ws(":", *(F.nullif(x, F.lit("")) for x in (slug(brand), slug(model), slug(colorway), gender)))
    return F.when(style_code(code) != "", by_code).otherwise(parts)


def deals(listings: DataFrame, min_pct: float = 10.0, brand: str = "", limit: int = 20) -> DataFrame:
    """In-stock listings at a discount of min_pct or more, the largest first."""
    rows = listings.where(F.col("brand") == brand) if brand else listings
    rows = rows.withColumn("discount_pct", p.discount_for()).where((F.col("discount_pct") >= min_pct) & F.col("in_stock"))
    return rows.orderBy(F.desc("discount_pct"), "listing_id").limit(limit)
