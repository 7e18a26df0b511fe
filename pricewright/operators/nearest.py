"""The nearest vectors of a set of queries among all rows, exactly, by blocks of both."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.operators.retrieval import top
from pricewright.session import stash

BLOCK, ASKED = 4096, 1024  # rows and queries of a block
SENT = 64  # blocks of queries that are sent to every task; more meet rows by a cartesian product


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """(ids, values): rows (id, v) of one length in blocks of at most `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                own = b.slice(at, most)
                ids, values = own.column(0).to_numpy(), own.column(1).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()]), pa.array([values.astype(np.float64).tobytes()])], ["ids", "v"])

    return rows.mapInArrow(run, "ids binary, v binary")


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows of a with rows of b, added from the first dimension to the last as vectors.dot() does."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def best_of(q: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray, k: int, cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, score) of the k rows of b that score highest with each of a, ties by id, without the own id.

    A matrix product, with room for its rounding, says which rows may be among them; their scores are then added in order.
    """
    na, nb = np.sqrt(in_order(a, a)), np.sqrt(in_order(b, b))
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = (np.where(n[:, None] > 0, m / n[:, None], 0.0) if cosine else m for n, m in ((na, a), (nb, b)))
    scores = x @ y.T
    scores[q[:, None] == ids[None, :]] = -np.inf
    room = 8 * a.shape[1] * np.finfo(float).eps * (np.ones(len(a)) if cosine else na * nb.max(initial=0.0)) + np.finfo(float).tiny
    least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q), -np.inf)
    i, j = np.nonzero((scores >= (least - room)[:, None]) & (scores > -np.inf))
    exact = in_order(a[i], b[j])
    if cosine:
        some = (na[i] > 0) & (nb[j] > 0)
        exact = np.where(some, exact / np.where(some, na[i] * nb[j], 1.0), 0.0)
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], exact[rank < k]


def nearest(rows: DataFrame, asked: Column, measure: Callable[[Column, Column], Column], k: int, cosine: bool) -> DataFrame:
    """(query, doc, score, rank): for each of rows (id, v) that asked holds for, the k others of highest score, ties by id.

    All pairs are looked at, in blocks: a task holds one of rows and one of queries. Vectors of another length than
    most, or with nulls or infinite values, are scored one by one with measure.
    """
    rows = rows.where("id is not null")
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = max(1, usual.n if usual else 1)
    fit = F.coalesce((F.size("v") == size) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e75)), F.lit(False))
    rows = rows.withColumn("fit", fit)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.where("fit").select("id", "v")
    blocks = stash(_packed(whole, BLOCK).repartition(width), "blocks")
    queries = stash(_packed(whole.where(asked), ASKED), "queries").toDF("qids", "q")
    queries = F.broadcast(queries) if queries.count() <= SENT else queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v, qids, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, asks = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                i, j, score = best_of(asks, np.frombuffer(q).reshape(len(asks), -1), own, np.frombuffer(v).reshape(len(own), -1), k, cosine)
                yield pa.RecordBatch.from_arrays([pa.array(asks[i]), pa.array(own[j]), pa.array(score)], ["query", "doc", "score"])

    scores = blocks.crossJoin(queries).select("ids", "v", "qids", "q").mapInArrow(run, "query long, doc long, score double")
    if not rows.where("not fit").isEmpty():
        q = rows.where(asked).select(F.col("id").alias("query"), F.col("v").alias("a"), F.col("fit").alias("fits"))
        pairs = rows.crossJoin(q).where("id <> query and not (fit and fits)")
        scores = scores.unionByName(pairs.select("query", F.col("id").alias("doc"), measure(F.col("a"), F.col("v")).alias("score")))
    return top(scores, "score", k)
