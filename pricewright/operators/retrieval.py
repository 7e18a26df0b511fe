"""Hybrid retrieval: field-weighted BM25 fused with vectors, under filters and a relevance floor.

An index is four tables. Queries come in batches; everything below is joins and aggregates
over (query, document), so a batch of any size is one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewright import vocabulary as v
from pricewright.functions import pricing as p
from pricewright.functions.similarity import trigram_similarity, trigrams
from pricewright.functions.text import style_code, tokens, variants
from pricewright.operators.offers import Spec, passes
from pricewright.plans.understand import expand, meaningful
from pricewright.session import stash

#: A side is broadcast only after a count shows that it has at most so many rows.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is proven to be small, else to be joined by a shuffle, whatever Spark takes its size for."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


@dataclass
class Index:
    """tf(doc, term, tf), docs(doc, len), df(term, df), stats(n, avg_len)."""

    tf: DataFrame
    docs: DataFrame
    df: DataFrame
    stats: DataFrame

    def write(self, path: str) -> None:
        """tf is laid out by term, so that a query reads few row groups."""
        self.tf.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/tf")
        for name in ("docs", "df", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def stored(self) -> Index:
        """The index as tables in the session's shared folder, its terms in ranges, so that a question reads few row groups."""
        tf = stash(self.tf.repartitionByRange("term").sortWithinPartitions("term"), "tf")
        docs = stash(self.docs, "docs")
        stats = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
        return Index(tf, docs, stash(tf.groupBy("term").agg(F.count("*").alias("df")), "df"), stash(stats, "stats"))

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("tf", "docs", "df", "stats")))


def build(rows: DataFrame, doc: str, fields: dict[str, float] | None = None, once: bool = False) -> Index:
    """Term frequencies weighted by field; a numbered model's parts count less; lengths are of whole words only.

    With `once` the words of each document are written first, so that a large corpus is split only once.
    """
    fields = fields or v.FIELD_WEIGHTS

    def weighed(field: str, w: float) -> Column:
        return F.transform(tokens(F.col(field)), lambda t: F.struct(t.alias("t"), F.lit(w).alias("w"), F.lit(w).alias("l")))

    words = F.flatten(F.array(*(weighed(f, w) for f, w in fields.items())))
    parts = F.flatten(F.transform(F.filter("x", lambda s: s["t"].rlike("[0-9]v")), lambda s: F.transform(variants(s["t"]), lambda t: F.struct(t.alias("t"), (s["w"] * v.VARIANT_WEIGHT).alias("w"), F.lit(0.0).alias("l")))))
    each = rows.select(F.col(doc).alias("doc"), words.alias("x"))
    each = stash(each, "split") if once else each
    length = F.aggregate("x", F.lit(0.0), lambda s, e: s + e["l"])
    docs = each.select("doc", length.alias("len"))
    tf = each.select("doc", F.explode(F.concat("x", parts)).alias("e")).groupBy("doc", F.col("e.t").alias("term")).agg(F.sum("e.w").alias("tf"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    return Index(tf, docs, tf.groupBy("term").agg(F.count("*").alias("df")), stats)


def append(index: Index, rows: DataFrame, doc: str, fields: dict[str, float] | None = None) -> Index:
    """The index with more documents; only counts are merged."""
    new = build(rows, doc, fields)
    docs = index.docs.unionByName(new.docs)
    df = index.df.unionByName(new.df).groupBy("term").agg(F.sum("df").alias("df"))
    return Index(index.tf.unionByName(new.tf), docs, df, docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")))


def query_terms(spark: SparkSession, queries: dict[str, str], widen: bool = True) -> DataFrame:
    """(query, term, weight, sources) of some questions."""
    out = []
    for q, text in queries.items():
        found = expand(text) if widen else {t: (1.0, {t}) for t in meaningful(text, keep=True)}
        out += [(q, t, w, sorted(s)) for t, (w, s) in sorted(found.items())]
    return spark.createDataFrame(out, "query string, term string, weight double, sources array<string>")


def known_terms(terms: DataFrame, df: DataFrame) -> DataFrame:
    """(term): those of terms that the index has. The terms go to the index, which is large, and not the index to them."""
    return df.select("term").join(small(terms.select("term").distinct()), "term", "left_semi")


def repair(terms: DataFrame, df: DataFrame, least: int = 4) -> DataFrame:
    """terms with each unknown one replaced by the nearest known one, by shared trigrams over the threshold, at less weight.

    Terms without one are dropped. Only unknown terms meet the index, on equal
    trigrams; ties go to the term first by name. A term repaired to one already there stays a row of its own.
    """
    found = small(stash(known_terms(terms, df), "found"))
    known = terms.join(found, "term", "left_semi")
    lost = terms.join(found, "term", "left_anti").where(F.length("term") >= least)
    grams = df.select(F.col("term").alias("near"), F.explode(trigrams(F.col("term"))).alias("gram"))
    asked = lost.select("term", F.explode(trigrams(F.col("term"))).alias("gram")).distinct()
    pairs = grams.join(small(asked), "gram").select("term", "near").distinct()
    close = pairs.withColumn("sim", trigram_similarity(F.col("term"), F.col("near"))).where(F.col("sim") > v.FUZZY_THRESHOLD)
    pick = close.groupBy("term").agg(F.min(F.struct((-F.col("sim")).alias("s"), F.col("near").alias("n")))["n"].alias("near"))
    fixed = pick.join(small(lost), "term").select("query", F.col("near").alias("term"), (F.col("weight") * v.FUZZY_WEIGHT).alias("weight"), "sources")
    return known.select("query", "term", "weight", "sources").unionByName(fixed)


def prune(terms: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """terms with df and idf; common ones go where the corpus is large and the query has a rare one."""
    rows = df.join(small(terms), "term").crossJoin(F.broadcast(stats))  # stats is one row
    rare = F.max((F.col("df") <= v.RARE_DF * F.col("n")).cast("int")).over(Window.partitionBy("query"))
    rows = rows.withColumn("rare", rare).where((F.col("n") < v.PRUNE_FROM) | (F.col("rare") == 0) | (F.col("df") <= v.COMMON_DF * F.col("n")))
    return rows.withColumn("idf", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("rare")


def bm25(index: Index, terms: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """(query, doc, lexical, matched): summed contributions of pruned terms.

    They are added in the order of terms, so documents with the same counts and length have the very same score
    and tie, whatever order rows come in. Only rows of asked terms meet the eligible documents.
    """
    hits = index.tf.join(small(terms), "term")
    if eligible is not None:  # a semi-join would be moved below the join with terms, where it shuffles the whole index
        hits = hits.join(small(eligible.select("doc").distinct()), "doc")
    hits = hits.join(index.docs, "doc")
    part = F.col("weight") * F.col("idf") * F.col("tf") * (v.BM25_K1 + 1) / (F.col("tf") + v.BM25_K1 * (1 - v.BM25_B + v.BM25_B * F.col("len") / F.col("avg_len")))
    parts = hits.groupBy("query", "doc").agg(F.array_sort(F.collect_list(F.struct("term", part.alias("part")))).alias("x"))
    return parts.select("query", "doc", F.aggregate("x", F.lit(0.0), lambda s, e: s + e["part"]).alias("lexical"), F.array_distinct("x.term").alias("matched"))


def top(scores: DataFrame, by: str, k: int, query: str = "query", doc: str = "doc") -> DataFrame:
    """The k best of each query; Spark limits groups before the shuffle for this shape."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(by), doc))).where(F.col("rank") <= k)


def fuse(scores: DataFrame, how: str = "hybrid", alpha: float = v.ALPHA) -> DataFrame:
    """fused from lexical and vector (null where a side has none): shares of the maxima, reciprocal ranks, or their mean."""
    w = Window.partitionBy("query")
    share = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / F.coalesce(F.nullif(F.greatest(F.max(c).over(w), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rank = lambda c: F.when(F.col(c).isNotNull(), F.row_number().over(w.orderBy(F.desc_nulls_last(c), "doc")))
    linear = alpha * share("lexical") + (1 - alpha) * share("vector")
    rrf = (v.RRF_K + 1) * (F.coalesce(alpha / (v.RRF_K + rank("lexical")), F.lit(0.0)) + F.coalesce((1 - alpha) / (v.RRF_K + rank("vector")), F.lit(0.0)))
    return scores.withColumn("fused", {"linear": linear, "rrf": rrf}.get(how, 0.5 * (linear + rrf)))


def coverage(matched: DataFrame, terms: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, doc, covered, identifying) from (query, doc, term): share of the typed words met, each term credited to the words that it came from."""
    asked = wanted.groupBy("query").agg(F.count_distinct("word").alias("asked"))
    credit = terms.select("query", "term", F.explode("sources").alias("word")).distinct().join(wanted.distinct(), ["query", "word"])
    met = matched.join(small(credit), ["query", "term"], "left")
    by = met.groupBy("query", "doc").agg(F.count_distinct("word").alias("met"), F.bool_or(~F.col("term").isin(*v.GENERIC)).alias("identifying"))
    return by.join(small(asked), "query").select("query", "doc", (F.col("met") / F.col("asked")).alias("covered"), "identifying")


def relevant(covered: str = "covered", identifying: str = "identifying", vector: str = "vector") -> Column:
    strong = (F.col(covered) >= v.HIGH_COVERAGE) | (F.col(identifying) & (F.col(covered) >= v.MIN_COVERAGE))
    return F.coalesce(strong, F.lit(False)) | (F.coalesce(F.col(vector), F.lit(0.0)) >= v.MIN_VECTOR)


def search(index: Index, listings: DataFrame, queries: dict[str, str], spec: Spec | None = None, top_k: int = 40, how: str = "hybrid", widen: bool = True, full_vectors: bool = False, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Hits (query, listing_id, score, lexical, vector, boost, terms), best first by rank.

    Filters come before scoring. The 400 best by BM25 of a query meet the vectors;
    a query without any lexical hit, or full_vectors, meets all eligible ones. A query
    without content words takes whatever passes the filters. An exact style code is over every other score
    and is not held to the floor. Listings carry `vector`; queries are embedded alike.
    """
    spark, spec = listings.sparkSession, spec or Spec()
    from pricewright.functions.vectors import dot, embedder

    eligible = listings.where(passes(spec)).select(F.col("listing_id").alias("doc"), "vector", p.total_for().alias("total"), style_code(F.col("style_code")).alias("code"))
    terms = query_terms(spark, queries, widen)
    wanted = spark.createDataFrame([(q, w) for q, t in queries.items() for w in (meaningful(t) if widen else meaningful(t, keep=True))], "query string, word string")
    used = repair(terms, index.df)
    lexical = top(bm25(index, prune(used, index.df, index.stats), eligible), "lexical", v.RERANK_DEPTH).drop("rank")
    ask = spark.createDataFrame(list(queries.items()), "query string, text string").select("query", (embed or embedder())(F.col("text")).cast("array<double>").alias("ask"))
    bare = F.broadcast(ask) if full_vectors else F.broadcast(ask.join(lexical.select("query").distinct(), "query", "left_anti"))
    pairs = eligible.crossJoin(bare).select("query", "doc", F.lit(None).cast("double").alias("lexical"), F.array().cast("array<string>").alias("matched"))  # a stated query set against all rows
    rows = lexical if full_vectors is False else lexical.join(pairs.select("query", "doc"), ["query", "doc"], "full")
    if not full_vectors:
        rows = rows.unionByName(pairs)
    rows = rows.join(eligible, "doc").join(F.broadcast(ask), "query")
    rows = rows.withColumn("vector", F.coalesce(dot(F.col("vector"), F.col("ask")), F.lit(0.0)))
    scored = fuse(rows, how)
    boost = F.when((F.lit(spec.style_code) != "") & (F.col("code") == style_code(F.lit(spec.style_code))), v.CODE_BOOST).otherwise(0.0)
    met = coverage(lexical.select("query", "doc", F.explode("matched").alias("term")), terms, wanted)
    free = wanted.select("query").distinct().withColumn("asks", F.lit(True))
    judged = scored.withColumn("boost", boost).join(met, ["query", "doc"], "left").join(F.broadcast(free), "query", "left")
    judged = judged.where((F.col("boost") > 0) | F.col("asks").isNull() | relevant())
    out = judged.withColumn("score", F.round(F.col("fused") + F.col("boost"), 6))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "total", "doc"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top_k).select(
        "query", F.col("doc").alias("listing_id"), "rank", "score",
        F.round(F.coalesce("lexical", F.lit(0.0)), 4).alias("lexical"), F.round("vector", 4).alias("vector"),
        "boost", F.array_sort(F.coalesce("matched", F.array().cast("array<string>"))).alias("terms"),
    )


def quality(results: DataFrame, truth: DataFrame) -> DataFrame:
    """recall_at_1, recall_at_3 and mean reciprocal rank of results(query, item, rank) against truth(query, acceptable)."""
    hit = truth.join(results, "query", "left").withColumn("ok", F.array_contains("acceptable", F.col("item")))
    pos = hit.groupBy("query").agg(F.min(F.when(F.col("ok"), F.col("rank"))).alias("pos"))
    at = lambda k: F.avg(F.coalesce((F.col("pos") <= k).cast("double"), F.lit(0.0)))
    return pos.agg(F.count("*").alias("queries"), at(1).alias("recall_at_1"), at(3).alias("recall_at_3"), F.avg(F.coalesce(1 / F.col("pos"), F.lit(0.0))).alias("mrr"))


def prefixed_any(text: Column, words: list[str]) -> Column:
    """How many of the words occur anywhere in a text."""
    return reduce(lambda a, b: a + b, (F.contains(F.lower(text), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
