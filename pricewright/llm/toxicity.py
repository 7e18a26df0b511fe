"""Toxicity by exact nearest labelled examples in TF-IDF space, found with block-max inverted lists."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.workers import bounded_sample, portions, words_of
from pricewright.session import stash

STEMS = (4, 5, 6, 7)
LEVELS = (1, 2, 4)
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def terms_of(word: str) -> list[str]:
    """The terms of a word: its letters, and the stems that it begins with."""
    w = _NOT_LETTERS.sub("", word.lower())
    return [w, *(w[:k] + "*" for k in STEMS if len(w) > k)] if w else []


@dataclass
class BlockMaxIndex:
    """Unit vectors of examples as inverted lists in blocks that know their largest weight."""

    terms: dict[str, list[int]]  # by term: its feature at each level of frequency, or -1
    idf: np.ndarray
    ids: list
    labels: np.ndarray
    base: float  # rate of label 1 among examples without a term
    block: int = 64
    lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    memo: dict = field(default_factory=dict)

    def weigh(self, features: list[int]) -> dict[int, float]:
        """The unit TF-IDF vector of a text; frequency is in the features, by level."""
        norm = float((self.idf[features] ** 2).sum() ** 0.5)
        return {t: float(self.idf[t]) / norm for t in features}

    def build(self, vectors: list[dict[int, float]]) -> None:
        posts: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for d, v in enumerate(vectors):
            for t, x in v.items():
                posts[t].append((d, x))
        for t in range(len(self.idf)):
            own = posts.get(t, [])
            d, x = np.array([p[0] for p in own], np.int64), np.array([p[1] for p in own], float)
            top = np.maximum.reduceat(x, np.arange(0, len(x), self.block)) if len(x) else x
            self.lists.append((d, x, top))

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[int, float]]:
        """The k examples of largest cosine with a unit query, ties by their order; exact.

        Lists are read in the order of what they can add at most. Once the rest cannot lift a
        new example over the k-th, only those seen are completed; blocks whose largest weight
        keeps all of their examples under it are passed over.
        """
        order = sorted(query, key=lambda t: -query[t] * (self.lists[t][2].max() if len(self.lists[t][2]) else 0))
        most = [query[t] * (self.lists[t][2].max() if len(self.lists[t][2]) else 0) for t in order]
        left = np.append(np.cumsum(most[::-1])[::-1], 0)
        seen, sums = np.zeros(0, np.int64), np.zeros(0)
        for n, t in enumerate(order):
            d, x, top = self.lists[t]
            floor = np.partition(sums, -k)[-k] if len(sums) >= k else -1.0
            if left[n] < floor:  # nothing unseen can enter any more
                at = np.searchsorted(d, seen)
                hit = (at < len(d)) & (d[np.minimum(at, len(d) - 1)] == seen) if len(d) else np.zeros(len(seen), bool)
                sums[hit] += query[t] * x[at[hit]]
                continue
            live = query[t] * top + left[n + 1] >= floor
            pick = np.repeat(live, self.block)[: len(d)]
            if len(seen):
                pick |= np.isin(d, seen)
            seen, back = np.unique(np.concatenate([seen, d[pick]]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([sums, query[t] * x[pick]]), minlength=len(seen))
        best = np.lexsort((seen, -np.round(sums, 12)))[:k]
        return [(int(seen[i]), float(min(1.0, sums[i]))) for i in best if sums[i] > 0]

    def score(self, features: list[int], k: int, prior: float) -> tuple[float, list[tuple[int, float]]]:
        """Vote of the neighbours, weighed by squared cosine, with `prior` votes of the base rate."""
        key = tuple(features)
        if key not in self.memo:
            if len(self.memo) > 5_000:
                self.memo.clear()
            near = self.nearest(self.weigh(features), k) if features else []
            w = np.array([c * c for _, c in near])
            y = self.labels[[d for d, _ in near]] if near else np.zeros(0)
            self.memo[key] = (float((w @ y + prior * self.base) / (w.sum() + prior)) if near else self.base, near)
        return self.memo[key]


def features_of(texts: pa.Array, vocab: dict[str, list[int]]) -> list[list[int]]:
    """The features of each text, ascending: its terms in vocab, once for each level that their count reaches."""
    codes, row, words = words_of(texts, unicode_space=True)
    known = [[t for t in terms_of(w) if t in vocab] for w in words.to_pylist()]
    has = np.fromiter(map(bool, known), bool, len(known))
    hit = has[codes] if len(codes) else np.zeros(0, bool)
    counts: list[Counter] = [Counter() for _ in range(len(texts))]
    for r, c in zip(row[hit].tolist(), codes[hit].tolist(), strict=True):
        counts[r].update(known[c])
    return [sorted(f for t, n in c.items() for f, least in zip(vocab[t], LEVELS, strict=True) if f >= 0 and n >= least) for c in counts]


def least_ratio(chance: float) -> float:
    """The likelihood ratio (chi-squared, one degree of freedom) that is exceeded by chance with this probability."""
    low, high = 0.0, 1500.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > chance else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_docs: int = 20_000, most_terms: int = 4096, chance: float = 1.0, lift: float = 1.5) -> BlockMaxIndex:
    """Index a bounded sample (about `most_docs`) of the labelled rows of docs.

    The vector space has the terms that tell the labels apart: words, stems and
    how often they occur (once, twice, four times), those of at least 3 examples whose odds differ by e^`lift` and whose
    likelihood ratio would come by chance to `chance` of all terms together, so the cut follows
    the number of terms and labels; the `most_terms` strongest.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    known = known.join(rows.select("i").distinct(), "i", "left_semi")
    rows = stash(rows.join(bounded_sample(known, "i", most_docs), "i").select("i", "t", "y"), "examples")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "t"):
                codes, row, words = words_of(b.column(1), unicode_space=True)
                y = np.array(b.column(2).to_pylist())
                names: dict[str, int] = {}
                per = [[names.setdefault(t, len(names)) for t in terms_of(w)] for w in words.to_pylist()]
                if not names:
                    continue
                width = np.array([len(p) for p in per], np.int64)[codes]
                flat = np.array([t for p in per for t in p], np.int64)
                begin = np.concatenate([[0], np.cumsum([len(p) for p in per])])[codes]
                pairs = [row[width > k].astype(np.int64) * len(names) + flat[begin[width > k] + k] for k in range(1 + len(STEMS))]
                pair, times = np.unique(np.concatenate(pairs), return_counts=True)
                for level, least in enumerate(LEVELS):
                    r, t = np.divmod(pair[times >= least], len(names))
                    n = np.bincount(t, minlength=len(names))
                    p = np.bincount(t, y[r], minlength=len(names))
                    some = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()).filter(pa.array(some)), pa.array(np.full(some.sum(), level, np.int32)), pa.array(p[some].astype(np.int64)), pa.array(n[some].astype(np.int64))], ["w", "level", "p", "n"])

    total, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    chosen: list = []
    if 0 < positive < total:
        seen = rows.mapInArrow(terms, "w string, level int, p long, n long").groupBy("w", "level").agg(F.sum("p").alias("a"), F.sum("n").alias("n")).where("n >= 3")
        seen = stash(seen, "terms")
        significance = least_ratio(chance / max(1, seen.count()))
        a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
        part = lambda x, of: F.when(x > 0, x * F.log(x * total / (F.col("n") * of))).otherwise(0.0)
        rest = lambda x, of: F.when(of - x > 0, (of - x) * F.log((of - x) * total / ((total - F.col("n")) * of))).otherwise(0.0)
        none = total - positive
        g = 2 * (part(a, F.lit(positive)) + part(b, F.lit(none)) + rest(a, F.lit(positive)) + rest(b, F.lit(none)))
        odds = F.abs(F.log((a + 0.5) / (positive + 0.5)) - F.log((b + 0.5) / (none + 0.5)))
        strong = seen.where(f"n < {total}").select("w", "level", g.alias("g"), odds.alias("o")).where(f"g >= {significance} and o >= {lift}")
        chosen = strong.orderBy(F.desc("g"), "w", "level").limit(most_terms).collect()
    place: dict[str, list[int]] = {}
    for k, r in enumerate(chosen):
        place.setdefault(r.w, [-1] * len(LEVELS))[r.level] = k

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "t"):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(features_of(b.column(1), place), pa.list_(pa.int32()))], ["i", "y", "f"])

    vectors = rows.mapInArrow(vectors_of, f"i {rows.schema['i'].dataType.simpleString()}, y int, f array<int>")
    plain = vectors.where("size(f) = 0").agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    rate = (positive + 1) / (total + 2) if total else 0.0
    base = (plain[1] + 2 * rate) / (plain[0] + 2)
    held = vectors.where("size(f) > 0").orderBy("i").collect()
    df = np.zeros(len(chosen))
    for r in held:
        df[r.f] += 1
    index = BlockMaxIndex(place, np.log(1 + max(1, total) / np.maximum(df, 1)), [r.i for r in held], np.array([r.y for r in held], float), float(base))
    index.build([index.weigh(r.f) for r in held])
    return index


def score_toxicity(docs: DataFrame, index: BlockMaxIndex, id_col: str = "doc_id", text_col: str = "text", neighbours: int = 15, prior: float = 1.0, threshold: float = 0.3, evidence: bool = False) -> DataFrame:
    """One row per input row: id, score, predicted (and evidence: the examples that voted).

    A text's cosine with every indexed example is exact in the index's space; its
    `neighbours` nearest vote with squared cosines. A text without any term of
    the space scores the rate of label 1 among such examples; so do null and empty texts.
    Ties between examples go to the smaller id. Ids may be null or repeat; an empty table gives no
    rows; an index without examples scores a constant; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for b in portions(whole, "t"):
                got = [own.score(c, neighbours, prior) for c in features_of(b.column(1), own.terms)]
                s = np.array([g[0] for g in got], float)
                cols = [b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
                if evidence:
                    cols.append(pa.array([[{"example": str(own.ids[d]), "cosine": c, "label": int(own.labels[d])} for d, c in g[1]] for g in got], pa.list_(pa.struct([("example", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(cols, ["i", "score", "predicted", "evidence"][: len(cols)])

    more = ", evidence array<struct<example: string, cosine: double, label: int>>" if evidence else ""
    return rows.mapInArrow(run, f"i {kind}, score double, predicted int{more}").withColumnRenamed("i", id_col)
