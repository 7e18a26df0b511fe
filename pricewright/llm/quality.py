"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.workers import bounded_sample, portions, words_of
from pricewright.session import stash

BINS = 12
EDGES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95])
FEATURES = ("upper", "marks", "digits", "bars", "stutter", "repeats", "copies", "length", "word_length", "words")


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of texts: the text of each, its length in bytes, and a bin from 0 to BINS - 1 for each feature."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
    lines = lists.flatten()
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    size = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "")[0].as_buffer() if len(lines) else b"", np.uint8)

    def count(which: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(which[raw], dtype=np.int64)])
        return sums[ends] - sums[ends - size]

    b = np.arange(256)
    upper = (b >= 65) & (b <= 90)
    letter = upper | (b >= 97) & (b <= 122) | (b >= 0xC0)
    digit = (b >= 48) & (b <= 57)
    space = (b == 32) | (b >= 9) & (b <= 13)
    mark = (b < 128) & ~letter & ~digit & ~space
    letters, solid = count(letter), np.maximum(size - count(space), 1)
    codes, row, _ = words_of(lines)
    words = np.bincount(row, minlength=len(lines))
    same = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    stutter = np.bincount(row[1:][same], minlength=len(lines))
    kinds = np.unique(row.astype(np.int64) << 32 | codes)
    distinct = np.bincount(kinds >> 32, minlength=len(lines))
    coded = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    _, back, times = np.unique(doc.astype(np.int64) << 32 | coded, return_inverse=True, return_counts=True)
    w = np.maximum(words, 1)
    shares = [count(upper) / np.maximum(letters, 1), count(mark) / solid, count(digit) / solid, count(b == 124) / w, stutter / w, 1 - distinct / w]
    bins = [np.searchsorted(EDGES, s, side="left") for s in shares]
    bins.append(np.minimum(times[back] - 1, 3))
    bins.append(np.minimum(np.log2(size + 1), BINS - 1))
    bins.append(np.clip(solid / w, 0, BINS - 1))
    bins.append(np.minimum(np.log2(words + 1), BINS - 1))
    return doc, size, np.stack(bins, 1).astype(np.int8)


def _neighbours(doc: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The bins of each line, of the one before and of the one after; BINS where there is none."""
    none = np.full((1, bins.shape[1]), BINS, np.int8)
    before, after = np.concatenate([none, bins[:-1]]), np.concatenate([bins[1:], none])
    edge = np.diff(doc, prepend=-1) != 0
    before[edge] = BINS
    after[np.append(edge[1:], True)] = BINS
    return np.concatenate([bins, before, after], 1)


def _emissions(weights: np.ndarray, full: np.ndarray) -> np.ndarray:
    out = np.zeros(len(full))
    for k in range(full.shape[1]):
        out += weights[k, full[:, k]]
    return out


def forward_backward(e: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 for lines with log odds e in documents that begin at `start`; and the expected transitions.

    Every step takes one line of each document that is long enough, longest first.
    """
    n, lens = len(e), np.diff(np.append(start, len(e)))
    order = np.argsort(-lens, kind="stable")
    at, lens = start[order], lens[order]
    most = int(lens[0]) if len(lens) else 0
    live = [int(x) for x in np.searchsorted(-lens, -np.arange(most), side="left")]
    a, z = np.zeros((n, 2)), np.zeros((n, 2))
    both = np.stack([np.zeros(n), e], 1)
    prev = None
    for t in range(most):
        i = at[: live[t]] + t
        now = both[i] if prev is None else both[i] + np.logaddexp(prev[: len(i), 0, None] + trans[0], prev[: len(i), 1, None] + trans[1])
        now -= np.logaddexp(now[:, 0], now[:, 1])[:, None]
        a[i] = prev = now
    pair = np.zeros((2, 2))
    for t in reversed(range(most - 1)):
        i = at[: live[t + 1]] + t
        into = both[i + 1] + z[i + 1]
        back = np.logaddexp(trans[:, 0] + into[:, :1], trans[:, 1] + into[:, 1:])
        joint = a[i][:, :, None] + trans[None] + into[:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        z[i] = back - back.max(1, keepdims=True)
    m = a + z
    return 1 / (1 + np.exp(np.clip(m[:, 0] - m[:, 1], -60, 60))), pair


@dataclass
class LineModel:
    """Weights of line features, transitions between line labels, and the calibration of documents."""

    weights: np.ndarray
    trans: np.ndarray
    slope: float
    shift: float

    def lines(self, doc: np.ndarray, bins: np.ndarray) -> np.ndarray:
        full = _neighbours(doc, bins)
        return forward_backward(_emissions(self.weights, full), np.flatnonzero(np.diff(doc, prepend=-1)), self.trans)[0]

    def documents(self, doc: np.ndarray, size: np.ndarray, good: np.ndarray, n: int) -> np.ndarray:
        """Log odds of the documents' length-weighted mean."""
        weight = size + 1.0
        mean = np.bincount(doc, weight * good, minlength=n) / np.maximum(np.bincount(doc, weight, minlength=n), 1)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))



def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_docs: int = 4000, rounds: int = 60, chain: int = 256) -> LineModel:
    """Fit on a bounded sample (about `most_docs`) of the labelled rows; lines carry their document's label.

    Long documents count as chains of `chain` lines while fitting. Conditional likelihood
    with a quadratic prior, maximised by Adam; then documents' log odds are calibrated.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    known = known.join(rows.select("i").distinct(), "i", "left_semi")
    rows = rows.join(bounded_sample(known, "i", most_docs), "i").select("y", "t", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "t"):
                doc, size, bins = line_features(b.column(1))
                starts = np.append(np.searchsorted(doc, np.arange(b.num_rows)), len(doc))
                lists = [(size[x:z].tolist(), bins[x:z].ravel().tolist()) for x, z in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array([x[0] for x in lists], pa.list_(pa.int64())), pa.array([x[1] for x in lists], pa.list_(pa.int8()))], ["i", "y", "s", "b"])

    held = stash(rows.mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, y int, s array<long>, b array<tinyint>"), "lines").orderBy("i", "y").toArrow()
    slots = 3 * len(FEATURES)
    model = LineModel(np.zeros((slots, BINS + 1)), np.zeros((2, 2)), 1.0, 0.0)
    y = held.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        model.slope, model.shift = 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return model
    doc = np.repeat(np.arange(len(y)), pc.list_value_length(held.column("s")).to_numpy())
    size = held.column("s").combine_chunks().flatten().to_numpy()
    bins = held.column("b").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    full = _neighbours(doc, bins)
    inner = np.arange(len(doc)) - np.searchsorted(doc, doc)
    start = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (inner % chain == 0))
    target = y[doc].astype(float)
    linked = np.ones(len(doc), bool)
    linked[start] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (target[linked].astype(int), target[linked].astype(int)), 1)
    flat = full + (np.arange(slots) * (BINS + 1))[None, :]
    theta, m1, m2 = np.zeros(slots * (BINS + 1) + 4), 0.0, 0.0
    for k in range(1, rounds + 1):
        e = theta[flat].sum(1)
        p, pair = forward_backward(e, start, theta[-4:].reshape(2, 2))
        g = np.bincount(flat.ravel(), np.repeat(target - p, slots), minlength=len(theta) - 4)
        g = np.concatenate([g, (seen - pair).ravel()]) / len(doc) - 1e-4 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    model.weights, model.trans = theta[:-4].reshape(slots, BINS + 1), theta[-4:].reshape(2, 2)
    x = model.documents(doc, size, model.lines(doc, bins), len(y))
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((y - p) * x).sum() - 0.01 * a, (y - p).sum()])
        hess = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a + step[0], b + step[1]
    model.slope, model.shift = float(a), float(b)
    return model


def score_quality(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, lines: bool = False) -> DataFrame:
    """One row per input row: id, score, predicted (and for each line the probability that it is good).

    Null and empty texts are one empty line and are scored like any other. Ids may be
    null or repeat; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for b in portions(whole, "t"):
                doc, size, bins = line_features(b.column(1))
                good = own.lines(doc, bins)
                s = 1 / (1 + np.exp(-(own.slope * own.documents(doc, size, good, b.num_rows) + own.shift)))
                cols = [b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
                if lines:
                    starts = np.append(np.searchsorted(doc, np.arange(b.num_rows)), len(doc)).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(good)))
                yield pa.RecordBatch.from_arrays(cols, ["i", "score", "predicted", "lines"][: len(cols)])

    return rows.mapInArrow(run, f"i {kind}, score double, predicted int" + ", lines array<double>" * lines).withColumnRenamed("i", id_col)
