"""A training corpus from `documents`: five stages, each over all that the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last have the columns of
documents. Null texts have no letter, so the first stage rejects them; other columns
may hold nulls. Ids may repeat: the third and fourth stages drop the rows that they mark, not their ids.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm import langid, toxicity
from pricewright.llm.exact_dedup import exact_dedup
from pricewright.llm.packing import pack
from pricewright.llm.queries import tokenizer_path
from pricewright.llm.simhash import similar_components
from pricewright.session import stash, table

#: Documents whose main language has less of their letters, or is less certain, are rejected.
LEAST_LANGUAGE = 0.3
#: Documents that score this much or more as toxic are rejected.
MOST_TOXICITY = 0.3
#: The column that tells rows apart within a stage; ids may be null or repeat.
KEY = "__row_key"
#: So many marked rows are sent to every task, so that texts are not shuffled to drop them; more are joined by a shuffle.
MOST_SENT = 1 << 19


def _whole(docs: DataFrame) -> DataFrame:
    """docs as one column `whole` beside the text, so that a score keeps its row without a join."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts without a main language."""
    model = langid.train(docs)
    scored = langid.identify(_whole(docs), model, id_col="whole")
    return scored.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select("whole.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score as toxic by the labelled ones among docs."""
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(_whole(docs), index, id_col="whole", threshold=MOST_TOXICITY)
    return scored.where("predicted = 0").select("whole.*")


def _keyed(docs: DataFrame, null_id: int) -> DataFrame:
    """docs with KEY, a number that only one row has, in the order of ids; null ids count as null_id."""
    wide = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(Decimal(null_id)).cast("decimal(20,0)"))
    row = F.monotonically_increasing_id().cast("decimal(20,0)")
    return stash(docs.withColumn(KEY, (wide * F.lit(Decimal(1 << 63)).cast("decimal(19,0)") + row).cast("decimal(38,0)")), "keyed")


def _without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs without the rows of the KEYs in lost."""
    lost = stash(lost, "lost")
    return docs.join(F.broadcast(lost) if lost.count() <= MOST_SENT else lost, KEY, "left_anti").drop(KEY)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts: the one with the largest id, before null ids, and one of those that repeat it."""
    docs = _keyed(docs, -(1 << 63) - 1)
    lost = exact_dedup(docs, id_col=KEY).where("not kept").select(KEY)
    return _without(docs, lost)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked texts, of 5-word shingles with a Jaccard similarity of 0.8 or more: the one with the smallest id, before null ids."""
    docs = _keyed(docs, 1 << 63)
    lost = similar_components(docs, id_col=KEY).where(F.col(KEY) != F.col("component_id")).select(KEY)
    return _without(docs, lost)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", toxic), ("exact_dedup", exact), ("simhash_dedup", near), ("packing", packing)]

#: The models of the first two stages and the tokenizer have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
