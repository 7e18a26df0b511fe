"""Language-model scoring from a log-frequency Bloom filter of n-gram counts.

N-grams are told apart by hashes and dealt by ranges of them. A range of the model has the exact
counts of its words, and the part of the filter that holds its words and pairs of words. Texts are scored in groups: a
group asks each range once for all of its distinct n-grams, in sorted runs, and gets their counts
and levels back in the same order. A small filter is broadcast instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.workers import WordTable, mix, portions, raw_of, release, word_places
from pricewright.session import stash

PROBES = 4
LEVEL_BITS = 6  # of the filter for each level of an n-gram: some half of them get set
RANGE_BYTES = 1 << 24  # of text to a range of hashes
GROUP_BYTES = 1 << 23  # of text to a group
END = np.uint64(0x452821E638D01377)  # stands for the end among the hashes of words


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two words' hashes; 48 bits, at the top."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b)) & ~np.uint64(0xFFFF)


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def levels_of(n: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of base 2, from 1."""
    return 1 + np.floor(np.log2(n)).astype(np.int64)


def counts_of(levels: np.ndarray) -> np.ndarray:
    """What a level stands for: its counts' geometric middle; 0 for none."""
    return np.where(levels == 0, 0.0, np.where(levels == 1, 1.0, 2.0 ** (levels - 0.5)))


def _probe(h: np.ndarray, level: np.ndarray | int, cells: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where n-grams are probed at a level: one of 64-bit cells, and its bits, all read at once."""
    g = mix(h + np.uint64(0xA0761D6478BD642F) * (np.atleast_1d(level).astype(np.uint64) + np.uint64(1)))
    bits = np.zeros(len(g), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << (g >> np.uint64(6 * k) & np.uint64(63))
    return ((g >> np.uint64(32)) * np.asarray(cells, np.uint64) >> np.uint64(32)).astype(np.int64), bits


@dataclass
class LogFrequencyFilter:
    """Bits by ranges of hashes; an n-gram of level q has its probes set at the levels 1 to q, in its range."""

    cells: np.ndarray
    start: np.ndarray  # of each range's cells, and the end

    @staticmethod
    def of(h: np.ndarray, n: np.ndarray, level_bits: int = LEVEL_BITS) -> np.ndarray:
        """The cells of a range, as many as its n-grams' levels ask for. Every n-gram is kept."""
        level = levels_of(n)
        each = np.repeat(np.arange(len(h)), level)
        q = np.arange(len(each)) - np.repeat(np.cumsum(level) - level, level) + 1
        cells = np.zeros(max(1, -(-level_bits * len(each) // 64)), np.uint64)
        np.bitwise_or.at(cells, *_probe(h[each], q, len(cells)))
        return cells

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The largest q such that all probes at levels 1 to q are set."""
        r = range_of(h, len(self.start) - 1)
        first, size = self.start[r], np.diff(self.start)[r]
        out, live, q = np.zeros(len(h), np.int64), np.flatnonzero(size > 0), 0
        while len(live):
            q += 1
            cell, bits = _probe(h[live], q, size[live])
            live = live[self.cells[first[live] + cell] & bits == bits]
            out[live] = q
        return out


def pack_runs(words: np.ndarray, pairs: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted hashes of words (64 bits) and of pairs (48), by halves, and other columns, as bytes."""
    cols = [np.array([len(words), len(pairs)], "<u4")]
    for h, low in ((words, True), (pairs, False)):
        cols += [(h >> np.uint64(48)).astype("<u2"), (h >> np.uint64(16)).astype("<u4")] + [h.astype("<u2")] * low
    return b"".join(c.tobytes() for c in (*cols, *more))


def unpack_runs(data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """The words, the pairs, and where the other columns begin."""
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    at, out = 8, []
    for size, low in ((n, True), (m, False)):
        h = np.frombuffer(data, "<u2", size, at).astype(np.uint64) << np.uint64(48) | np.frombuffer(data, "<u4", size, at + 2 * size).astype(np.uint64) << np.uint64(16)
        at += 6 * size
        if low:
            h |= np.frombuffer(data, "<u2", size, at).astype(np.uint64)
            at += 2 * size
        out.append(h)
    return out[0], out[1], at


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token in order, ends included: the hash of its word, that of the pair with the one before (the end, before a text), and its text."""
    raw, at = raw_of(pa.compute.ascii_lower(pa.compute.fill_null(texts.cast(pa.string()), "")))
    begin, size, per = word_places(raw, at)
    n = len(per)
    h = np.full(len(begin) + n, END, np.uint64)
    h[np.arange(len(begin)) + np.repeat(np.arange(n), per)] = np.maximum(WordTable.hashes(raw, begin, size), np.uint64(1))
    before = np.concatenate([[END], h[:-1]]).astype(np.uint64)  # before a text is the last one's end
    return h, pair_hash(before, h), np.repeat(np.arange(n), per + 1)


@dataclass
class NgramModel:
    """total and distinct tokens of training, the table of ranges (r, words, cells), and the filter if it is small."""

    tokens: int
    distinct: int
    ranges: int
    parts: DataFrame | None
    filter: LogFrequencyFilter | None = None
    trust: float = 10.0  # a context seen this often weighs its own counts as much as the words' own


def _slices(h: np.ndarray, ranges: int) -> np.ndarray:
    """Where the ranges of sorted hashes begin and end."""
    return np.searchsorted(range_of(h, ranges), np.arange(ranges + 1))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = 1 << 26, level_bits: int = LEVEL_BITS) -> NgramModel:
    """The model of all words and pairs of words of docs; the end is a word, and stands before a text too.

    There is a range of hashes to 16 MB of text, so none grows with the corpus. The filter is gathered
    and broadcast if it has `most_bits` at most (8 MB), and stays a table of ranges else; both give the same scores.
    Null and empty texts have an end only. Ids do not matter; without rows the model knows nothing.
    """
    rows = docs.select(F.col(text_col).alias("t"))
    ranges = max(1, -(-int(rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]) // RANGE_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "t", 1 << 23):
                h, p, _ = tokens(b.column(0))
                w, n = np.unique(h, return_counts=True)
                p, m = np.unique(p, return_counts=True)
                a, z = _slices(w, ranges), _slices(p, ranges)
                for r in range(ranges):
                    own, two = slice(a[r], a[r + 1]), slice(z[r], z[r + 1])
                    data = pack_runs(w[own], p[two], n[own].astype("<u4"), m[two].astype("<u4"))
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([data])], ["r", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def total(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            own, back = np.unique(np.concatenate(h), return_inverse=True)
            return own, np.bincount(back, np.concatenate(n), minlength=len(own)).astype(np.int64)

        for r, data in _by_first(batches):
            got = [unpack_runs(d) for d in data]
            w, n = total([g[0] for g in got], [np.frombuffer(d, "<u4", len(g[0]), g[2]) for d, g in zip(data, got, strict=True)])
            p, m = total([g[1] for g in got], [np.frombuffer(d, "<u4", len(g[1]), g[2] + 4 * len(g[0])) for d, g in zip(data, got, strict=True)])
            cells = LogFrequencyFilter.of(np.concatenate([w, tagged(p)]), np.concatenate([n, m]), level_bits) if len(w) + len(p) else np.zeros(0, np.uint64)
            cols = [pa.array([r], pa.int32()), pa.array([int(n.sum())]), pa.array([len(w)]), pa.array([len(cells)]), pa.array([w.tobytes() + n.tobytes()]), pa.array([cells.tobytes()])]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["r", "tokens", "distinct", "size", "words", "cells"])

    dealt = rows.mapInArrow(count, "r int, data binary").repartition("r").sortWithinPartitions("r")
    parts = stash(dealt.mapInArrow(merge, "r int, tokens long, distinct long, size long, words binary, cells binary"), "model")
    total, distinct, size = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct", "size"))).first()
    model = NgramModel(total, distinct, ranges, parts)
    if 64 * size <= most_bits:
        held = {r.r: np.frombuffer(r.cells, np.uint64) for r in parts.select("r", "cells").collect()}
        each = [held.get(r, np.zeros(0, np.uint64)) for r in range(ranges)]
        model.filter = LogFrequencyFilter(np.concatenate(each), np.concatenate([[0], np.cumsum([len(c) for c in each])]))
    return model


def tagged(pairs: np.ndarray) -> np.ndarray:
    """Pairs' hashes in the filter: their free bits tell them from words'."""
    return pairs | np.uint64(0x2D5B)


def _by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Of rows (r, data) sorted by r: each r and its data."""
    key, held = None, []
    for b in batches:
        for r, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if r != key and held:
                yield key, held
                held = []
            key = r
            held.append(d)
    if held:
        yield key, held


def score(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score.

    base_score has add-one unigram probabilities from exact counts. score has bigram probabilities
    from the filter's levels, drawn to the words' own probabilities with the weight model.trust; both
    sum log10 over words and the end. Rows are dealt by a hash of id and text to groups of some 8 MB.

    Null texts count as empty: the end alone. Ids may be null or repeat; an empty table gives no rows;
    without training rows every probability of base_score is one; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0])
    groups, ranges = max(1, -(-size // GROUP_BYTES)), model.ranges
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, parts=None))
    below = model.tokens + 1 * (model.distinct + 1)
    small = model.filter is not None
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("i", "t"), F.lit(groups)).cast("int")).repartition("g")

    def asked(w: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(w), np.zeros(0, np.uint64) if small else np.unique(p)

    def ask(key: tuple, texts: pa.Table) -> pa.Table:
        h, p, _ = tokens(texts.column("t").combine_chunks())
        w, p = asked(h, p)
        a, z = _slices(w, ranges), _slices(p, ranges)
        data = [pack_runs(w[a[r] : a[r + 1]], p[z[r] : z[r + 1]]) for r in range(ranges)]
        release()
        return pa.table({"r": pa.array(range(ranges), pa.int32()), "g": pa.array([key[0].as_py()] * ranges, pa.int32()), "data": pa.array(data, pa.binary())})

    def look(rows: pa.Table, part: pa.Table) -> pa.Table:
        known, n, own = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        if part.num_rows:
            data = part.column("words")[0].as_py()
            known, n = np.frombuffer(data, np.uint64, len(data) // 16), np.frombuffer(data, np.int64, len(data) // 16, len(data) // 2)
            cells = np.frombuffer(part.column("cells")[0].as_py(), np.uint64)
            r = part.column("r")[0].as_py()
            own = LogFrequencyFilter(cells, np.where(np.arange(ranges + 1) > r, len(cells), 0))
        known, n = np.append(known, np.uint64(0xFFFFFFFFFFFFFFFF)), np.append(n, 0)
        out = []
        for d in rows.column("data").to_pylist():
            w, p, _ = unpack_runs(d)
            at = np.searchsorted(known, w)
            counts = np.where(known[at] == w, n[at], 0)
            none = np.zeros(0, np.uint8) if small else np.zeros(len(w) + len(p), np.uint8)
            levels = none if small or own is None else own.levels(np.concatenate([w, tagged(p)])).astype(np.uint8)
            out.append(np.array([len(w)], "<u4").tobytes() + counts.astype("<u8").tobytes() + levels.tobytes())
        return pa.table({"g": rows.column("g"), "r": rows.column("r"), "data": pa.array(out, pa.binary())})

    def scored(texts: pa.Table, found: pa.Table) -> pa.Table:
        model = shared.value
        n = texts.num_rows
        h, p, of = tokens(texts.column("t").combine_chunks())
        w, code = np.unique(h, return_inverse=True)
        counts, one, two_levels = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]
        for _, d in sorted(zip(found.column("r").to_pylist(), found.column("data").to_pylist(), strict=True)):
            m = int(np.frombuffer(d, "<u4", 1)[0])
            counts.append(np.frombuffer(d, "<u8", m, 4).astype(np.int64))
            levels = np.frombuffer(d, np.uint8, -1, 4 + 8 * m)
            one.append(levels[:m])
            two_levels.append(levels[m:])
        c = np.concatenate(counts)
        if small:
            one_n, two_n = counts_of(model.filter.levels(w)), counts_of(model.filter.levels(tagged(p)))
        else:
            back = np.unique(p, return_inverse=True)[1]
            one_n, two_n = counts_of(np.concatenate(one).astype(np.int64)), counts_of(np.concatenate(two_levels).astype(np.int64))[back]
        base = np.bincount(of, np.log10((c + 1) / below)[code], minlength=n)
        known = np.bincount(of, (c > 0)[code], minlength=n).astype(np.int64)
        own = one_n[code]
        context = one_n[np.concatenate([[np.searchsorted(w, END)], code[:-1]])] if len(code) else own
        two_n = np.minimum(two_n, np.minimum(context, own))
        prob = (two_n + model.trust * (own + 1) / below) / (context + model.trust)
        total = np.bincount(of, np.log10(np.minimum(prob, 1.0)), minlength=n)
        release()
        return pa.table({"i": texts.column("i"), "n_tokens": np.bincount(of, minlength=n).astype(np.int64), "n_known": known, "base_score": base, "score": total})

    asks = dealt.groupBy("g").applyInArrow(ask, "r int, g int, data binary")
    answers = asks.groupBy("r").cogroup(model.parts.groupBy("r")).applyInArrow(look, "g int, r int, data binary")
    out = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(scored, f"i {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("i").alias(id_col), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
