"""Exact duplicates by skew-safe combining; DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.session import stash


def normalised(text: Column) -> Column:
    """text with only A-Z lower-cased, null as empty.

    lower() agrees on all-ASCII texts and is several times faster than translate().
    """
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised contents are; the largest id of a group stays.
    Equal texts are merged within each task first (partial aggregation), then within
    (digest, salt), then the salts' winners within the digest; the text is part of every
    grouping key, so contents and not only digests are compared. Rows find their group by (digest, salt),
    to which the group's result goes, at most `salts` rows of it. So a group that holds a third of all rows
    is dealt to `salts` tasks at every step, by default as many as the session has shuffle partitions. If two
    contents ever share a digest, those rows use digest, salt and content.

    Null text counts as empty. A null id never wins over another; a group with null ids
    only has a null keep_id and is kept. Rows that repeat the winning id are all kept.
    An empty table gives no rows; other columns of docs are ignored, whatever their names.
    """
    salts = salts or max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("i"), normalised(F.col(text_col)).alias("t"))
    rows = rows.select("i", "t", F.sha2(F.encode("t", "utf-8"), 256).alias("d"), F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int").alias("s"))
    local = rows.groupBy("d", "s", "t").agg(F.max("i").alias("k"), F.count("*").alias("n"))
    winners = local.groupBy("d", "t").agg(F.max("k").alias("k"), F.sum("n").alias("n"), F.collect_set("s").alias("ss"))
    winners = stash(winners.select("d", "k", "n", "ss"), "winners")
    clash = winners.groupBy("d").agg(F.count("*").alias("c")).where("c > 1").select("d")
    groups = winners.where("n > 1")
    if clash.isEmpty():
        found = rows.select("i", "d", "s").join(groups.select("d", F.explode("ss").alias("s"), "k", "n"), ["d", "s"], "left")
    else:
        clashing = F.broadcast(clash.withColumn("two", F.lit(True))) if clash.count() < 1000 else clash.withColumn("two", F.lit(True))
        again = rows.join(clashing, "d", "left_semi")
        exact = again.groupBy("d", "s", "t").agg(F.max("i").alias("k"), F.count("*").alias("n"))
        whole = exact.groupBy("d", "t").agg(F.max("k").alias("k"), F.sum("n").alias("n"), F.collect_set("s").alias("ss"))
        exact = again.join(whole.select("d", "t", F.explode("ss").alias("s"), "k", "n"), ["d", "s", "t"]).select("d", "s", "i", "k", "n")
        alone = groups.join(clashing, "d", "left_anti").select("d", F.explode("ss").alias("s"), "k", "n")
        found = rows.join(clashing, "d", "left_anti").select("d", "s", "i").join(alone, ["d", "s"], "left").unionByName(exact)
    keep = F.when(F.col("n").isNull(), F.col("i")).otherwise(F.col("k"))
    return found.select(
        F.col("i").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("i").eqNullSafe(keep).alias("kept"),
        F.col("d").alias("text_sha256"),
    )
