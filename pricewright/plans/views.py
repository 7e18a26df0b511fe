"""Views of the driver's tables in the listing domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.functions.pricing import money
from pricewright.session import table


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as offers of parts by suppliers. Sizes are line numbers; a pair's curve has the cheapest price of each.

    part and supplier join by broadcast only where Spark finds them under its threshold.
    """
    item = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_brand", "p_name", "p_type")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    price = money(F.col("l_extendedprice") / F.col("l_quantity"))
    rows = item.join(part, "l_partkey").join(supplier, "l_suppkey").withColumn("price", price)
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("listing_id"),
        F.col("l_partkey").alias("product"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("s_name").alias("source"),
        F.when(F.col("s_nationkey") < 5, "brand").otherwise("resale").alias("source_kind"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("model"),
        "price",
        F.col("p_retailprice").alias("list_price"),
        money(F.col("price") * F.col("l_tax")).alias("shipping"),
        money(F.col("price") * F.col("l_discount")).alias("fees"),
        (F.col("l_linestatus") == "O").alias("in_stock"),
        F.when(F.col("l_returnflag") == "N", "new").otherwise("used").alias("condition"),
        F.col("l_linenumber").cast("string").alias("size"),
        F.col("l_shipdate").alias("observed_at"),
    )


def curved(rows: DataFrame) -> DataFrame:
    """offers with sizes and size_prices of their product and seller: at most seven sizes a pair, so nothing grows."""
    least = rows.groupBy("product", "seller_id", "size").agg(F.min("price").alias("p"))
    curve = least.groupBy("product", "seller_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("size", "p")))).alias("size_prices"))
    return rows.join(curve, ["product", "seller_id"]).withColumn("sizes", F.array("size"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of a price."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("listing_id"), F.col("ts").alias("observed_at"), F.col("value").alias("price"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listings with names, codes and colours, for matching."""
    part = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return part.select(
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("listing_id"),
        F.lower("p_brand").alias("brand"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_name", "p_size").alias("model"),
        F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")).alias("colorway"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit("-"), F.col("p_size"), F.lit("-"), F.substring(F.sha1("p_name"), 1, 3))).otherwise("").alias("style_code"),
        F.lit("").alias("gender"),
        F.col("p_retailprice").alias("price"),
    )
