"""Raw records to listings: sellers, files, searches and the normalising projection."""

from __future__ import annotations

import os
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewright import vocabulary as v
from pricewright.functions import text as t
from pricewright.functions.pricing import listing_id
from pricewright.operators.catalog import LISTING, conform
from pricewright.session import schema
from pricewright.sources import pages as pg

RAW = schema(
    "title string, url string, brand string, model string, colorway string, style_code string, retailer_sku string, price string, list_price string, currency string, shipping string, fees string, "
    "in_stock boolean, sizes array<string>, size_prices map<string,string>, condition string, gender string, image string, scraped_at string"
)


def sites(spark: SparkSession) -> DataFrame:
    """The sellers as a dimension of a few rows."""
    return spark.createDataFrame([(*s[:5], list(s[5]), s[6]) for s in v.SITES], "key string, name string, home string, search_url string, product_link string, brands array<string>, kind string")


def sells(brand: str) -> Column:
    return (F.size("brands") == 0) | F.array_contains("brands", brand)


def site(key: str) -> dict:
    found = {s[0]: dict(zip(("key", "name", "home", "search_url", "product_link", "brands", "kind"), s, strict=True)) for s in v.SITES}
    return found[key]


def normalise(raw: DataFrame, key: str) -> DataFrame:
    """Raw records of a seller as listings; those without title, address or price are rejected.

    The headline price is the least of the stated one and the size curve; sizes of the curve
    count as listed; words of the colourway leave the model unless nothing else is in it.
    """
    s, have = site(key), set(raw.columns)
    rows = raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW), F.to_json(F.struct(*raw.columns)).alias("raw"))
    rows = rows.withColumns({"title": F.trim(F.coalesce("title", F.lit(""))), "p": t.price(F.col("price")), "x": t.parse_title(F.col("title"), F.coalesce("brand", F.lit("")))})
    rows = rows.where("title <> '' and coalesce(url, '') <> '' and p.amount is not null")
    own = s["brands"][0] if len(s["brands"]) == 1 else ""
    first = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))
    entries = F.filter(F.transform(F.map_entries(F.coalesce("size_prices", F.create_map().cast("map<string,string>"))), lambda e: F.struct(t.shoe_size(e["key"]).alias("key"), t.price(e["value"])["amount"].alias("value"))), lambda e: e["value"].isNotNull())
    curve = F.map_from_entries(F.array_distinct(F.transform(F.array_distinct(F.transform(entries, lambda e: e["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value")))))
    rows = rows.withColumns({"curve": curve, "colour": first(t.colourway(F.col("colorway")), F.col("x.colorway"))})
    model = first(F.col("model"), F.col("x.model"))
    kept = F.filter(F.split(model, r"\s+"), lambda w: ~F.array_contains(F.split("colour", "[^a-z0-9]+"), w))
    state = F.lower(F.trim(first(F.col("condition"), F.lit("new"))))
    gender = first(F.lower(F.trim("gender")), F.col("x.gender"))
    address = F.col("url")
    root = s["home"].rstrip("/")
    full = F.when(address.rlike("^[a-zA-Z][a-zA-Z+.-]*:"), address).when(address.startswith("//"), F.concat(F.lit("https:"), address)).when(address.startswith("/"), F.concat(F.lit(root), address)).otherwise(F.concat(F.lit(s["home"]), address))
    out = rows.withColumns({
        "source": F.lit(s["key"]), "source_name": F.lit(s["name"]), "source_kind": F.lit(s["kind"]),
        "url": full,
        "brand": first(t.brand_of(F.col("brand")), F.col("x.brand"), F.lit(own)),
        "model": F.when((F.col("colour") != "") & (F.size(kept) > 0), F.array_join(kept, " ")).otherwise(model),
        "colorway": F.col("colour"),
        "style_code": first(t.style_code(F.col("style_code")), F.col("x.style_code")),
        "price": F.least(F.col("p.amount"), F.array_min(F.map_values("curve"))),
        "list_price": t.price(F.col("list_price"))["amount"],
        "currency": F.upper(first(F.col("currency"), F.col("p.currency"), F.lit("USD"))),
        "shipping": t.price(F.col("shipping"))["amount"], "fees": t.price(F.col("fees"))["amount"],
        "in_stock": F.coalesce("in_stock", F.lit(True)),
        "sizes": F.array_union(t.shoe_sizes(F.col("sizes")), F.map_keys("curve")),
        "size_prices": F.col("curve"),
        "condition": F.when(state.isin("new", "used"), state).when(state.contains("used") | state.contains("pre-owned"), "used").otherwise("new"),
        "gender": F.when(gender.isin("men", "women", "kids", "unisex"), gender).otherwise(""),
        "retailer_sku": first(F.col("retailer_sku")), "image": first(F.col("image")),
        "scraped_at": F.col("scraped_at").try_cast("timestamp"),
    })
    return conform(out.withColumn("listing_id", listing_id(F.col("source"), F.col("url"))))


class Source(ABC):
    """A seller's listings."""

    def __init__(self, spark: SparkSession, key: str):
        self.spark, self.key = spark, key
        self.name = site(key)["name"]

    @abstractmethod
    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Listings for a query, best first by `_order`."""

    def all(self) -> DataFrame:
        """All listings that the seller shows without a query, each once."""
        return self.collect([""], 10_000)

    def collect(self, queries: Iterable[str], limit: int = 20) -> DataFrame:
        """Listings of several queries, each once, as first found."""
        found = [self.search(q, limit).withColumn("_q", F.lit(n)) for n, q in enumerate(queries)]
        rows = reduce(DataFrame.unionByName, found)
        w = Window.partitionBy("listing_id").orderBy("_q", "_order")
        return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_q", "_r", "_order")


class StaticSource(Source):
    """Records that are at hand."""

    def __init__(self, spark: SparkSession, key: str, raw: DataFrame):
        super().__init__(spark, key)
        self.rows = normalise(raw, key)

    def all(self) -> DataFrame:
        return self.rows.dropDuplicates(["listing_id"])

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """Rows whose summary has most of the query's words, as parts of it; all rows for an empty query."""
        asked = query.lower().split()
        hay = F.lower(t.summary())
        hits = reduce(lambda a, b: a + b, (F.contains(hay, F.lit(w)).cast("int") for w in asked), F.lit(0))
        rows = self.rows.withColumn("_hits", hits)
        rows = rows.where("_hits > 0") if asked else rows
        best = rows.orderBy(F.desc("_hits"), "listing_id").limit(limit)
        return best.withColumn("_order", F.row_number().over(Window.orderBy(F.desc("_hits"), "listing_id"))).drop("_hits")  # limit rows at most


class PageSource(Source):
    """Listings from pages that were fetched into a table (url, html): a search page leads to product pages."""

    def __init__(self, spark: SparkSession, key: str, fetched: DataFrame):
        super().__init__(spark, key)
        self.pages = fetched

    def search(self, query: str, limit: int = 20) -> DataFrame:
        s = site(self.key)
        start = self.pages.where(F.col("url") == pg.search_url(s["search_url"], query))
        found = start.select(F.posexplode(pg.links(F.col("html"), s["product_link"], s["home"], limit)).alias("_order", "url"))
        rows = pg.extract(found.join(self.pages, "url"))
        raw = rows.select("_order", "url", "fields").select("_order", *(F.col(f"fields.{c}").alias(c) for c in ("title", "brand", "style_code", "retailer_sku", "colorway", "gender", "image", "price", "list_price", "currency", "in_stock", "sizes", "size_prices", "condition")), F.coalesce(F.nullif("fields.url", F.lit("")), "url").alias("url"))
        out = normalise(raw.drop("_order"), self.key)
        order = raw.select(F.col("url").alias("_u"), "_order").groupBy("_u").agg(F.min("_order").alias("_order"))
        return out.join(order, out.url == F.col("_u"), "left").drop("_u")


def fixture(spark: SparkSession, key: str, folder: str) -> StaticSource:
    """A seller's file <folder>/<key>.json, an object with `listings` or a bare list; empty if there is none."""
    path = f"{folder.rstrip('/')}/{key}.json"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if not exists:
        return StaticSource(spark, key, spark.createDataFrame([], RAW))
    whole = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", T.ArrayType(RAW))
    in_object = F.from_json("value", T.StructType([T.StructField("listings", T.ArrayType(RAW))]))["listings"]
    rows = F.when(F.ltrim("value").startswith("["), as_list).otherwise(in_object)
    return StaticSource(spark, key, whole.select(F.explode(rows).alias("r")).select("r.*"))


def sources(spark: SparkSession, keys: Iterable[str] | None = None, mode: str = "", folder: str = "", fetched: DataFrame | None = None) -> list[Source]:
    """Sources of some sellers, or of all, from files or from fetched pages."""
    mode = mode or os.environ.get("PRICEWRIGHT_MODE", "fixtures")
    make: dict[str, Callable[[str], Source]] = {"fixtures": lambda k: fixture(spark, k, folder), "live": lambda k: PageSource(spark, k, fetched)}
    if mode == "live" and fetched is None:
        raise ValueError("mode live needs a table of fetched pages")
    known = [s[0] for s in v.SITES]
    return [make[mode](site(k)["key"]) for k in (keys if keys is not None else known)]


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    """n invented listings by rule, for benchmarks."""
    models = F.array(*(F.lit(f"{a} {b}") for a in ("air max", "samba", "gazelle", "dunk low", "ultraboost", "superstar", "campus", "spezial") for b in ("90", "95", "1")))
    shades = F.array(*map(F.lit, v.COLOURS[:10]))
    pick = lambda arr, salt: F.element_at(arr, (F.pmod(F.xxhash64("id", F.lit(salt)), F.size(arr)) + 1).cast("int"))
    brands, names = F.array(*map(F.lit, v.BRANDS)), F.array(*(F.lit(s[0]) for s in v.SITES))
    rows = spark.range(n).withColumns({"brand": pick(brands, 1), "model": pick(models, 2), "colorway": pick(shades, 3), "source": pick(names, 4)})
    rows = rows.withColumns({"title": F.concat_ws(" ", "brand", "model", "colorway"), "url": F.concat(F.lit("https://example.com/"), "id"), "source_name": F.col("source"), "style_code": F.concat(F.lit("AB"), F.lpad((F.col("id") % 9000 + 1000).cast("string"), 4, "0"))})
    rows = rows.withColumns({"price": (80 + F.pmod(F.xxhash64("id", F.lit(5)), F.lit(12000)) / 100).cast("double"), "list_price": F.lit(150.0), "gender": F.lit(""), "in_stock": F.lit(True), "listing_id": listing_id(F.col("source"), F.col("url"))})
    return conform(rows, LISTING)
