"""Language identification: scripts narrow the candidates, Viterbi over words finds the spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.workers import bounded_sample, portions, words_of, worker_cache

UNKNOWN = "und"
BUCKETS = 1 << 16
GRAMS = (1, 2, 3, 4)
# First code points of the Unicode blocks that begin another script, and the script.
SCRIPTS = ((0x0, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x780, 6), (0x900, 7), (0x980, 8), (0xA00, 9), (0xA80, 10), (0xB00, 11), (0xB80, 12), (0xC00, 13), (0xC80, 14), (0xD00, 15), (0xD80, 16), (0xE00, 17), (0xE80, 18), (0xF00, 19), (0x1000, 20), (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x13A0, 0), (0x1780, 24), (0x1800, 25), (0x1D00, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 26), (0x30A0, 26), (0x3100, 27), (0x3130, 22), (0x3190, 27), (0xA000, 0), (0xAC00, 22), (0xD7B0, 0), (0xF900, 27), (0xFB00, 0), (0xFB1D, 4), (0xFB50, 5), (0xFE00, 0), (0xFF66, 26), (0xFFA0, 0), (0x20000, 27), (0x32000, 0))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: 2 a letter, 1 a mark, else 0; and its script."""
    cache = worker_cache()
    if "letters" not in cache:
        kind = {"L": 2, "M": 1}
        cache["letters"] = np.array([kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x33000)], np.int8)
        starts = np.array([s for s, _ in SCRIPTS])
        cache["scripts"] = np.array([s for _, s in SCRIPTS], np.int8)[np.searchsorted(starts, np.arange(0x33000), side="right") - 1]
    return cache["letters"], cache["scripts"]


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: letters in each, a bit set of their scripts, and their n-grams as (word, bucket)."""
    letters, scripts = _tables()
    text = " " + " ".join(words.to_pylist()).lower() + " "
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    code = np.minimum(code, 0x32FFF)
    kind = letters[code]
    kept = (kind > 0) | (code == 32)
    code, kind = code[kept], kind[kept]
    gap = code == 32
    word = np.cumsum(gap) - 1  # a space belongs to the word that it opens
    n = len(words)
    inside = ~gap
    count = np.bincount(word[kind == 2], minlength=n + 1)[:n]
    mask = np.zeros(n + 1, np.int64)
    np.bitwise_or.at(mask, word[inside], np.int64(1) << scripts[code[inside]].astype(np.int64))
    own, bucket = [], []
    for k in GRAMS:
        m = len(code) - k + 1
        if m < 1:
            continue
        h = np.full(m, 7919 * k, np.uint32)
        bad = np.zeros(m, bool)
        for j in range(k):
            h = (h ^ code[j : j + m]) * np.uint32(0x01000193)
            if 0 < j < k - 1:
                bad |= gap[j : j + m]
        bad |= gap[:m] & gap[k - 1 :]
        at = np.flatnonzero(~bad)
        own.append(word[at])
        bucket.append((h[at] * np.uint32(0x9E3779B1)) >> np.uint32(16))
    return count, mask[:n], np.concatenate(own), np.concatenate(bucket)


@dataclass
class LanguageModel:
    """Log probabilities of n-gram buckets by language, and the scripts that each language uses."""

    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # bit sets

    def word_scores(self, words: pa.Array, floor: float = -8.0) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each word, and its log posterior by language, not under `floor`; 0 for words that tell nothing."""
        letters, mask, own, bucket = word_features(words)
        size = len(self.langs)
        s = np.zeros((len(words), size))
        for k in range(size):
            s[:, k] = np.bincount(own, self.table[bucket, k], minlength=len(words))[: len(words)]
        fits = (mask[:, None] & self.scripts[None, :]) != 0
        fits |= ~fits.any(1, keepdims=True)
        s[~fits] = -np.inf
        top = s.max(1, keepdims=True)
        s -= top + np.log(np.exp(s - top).sum(1, keepdims=True))
        s = np.maximum(s, floor)
        s[letters == 0] = 0
        return letters, s.astype(np.float32)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = 20_000) -> LanguageModel:
    """Fit on a bounded sample (about `most_docs`) of the rows with text and language, by n-gram counts."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null")
    rows = bounded_sample(rows, "i", most_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "t", 1 << 20):
                langs = b.column(2).dictionary_encode()
                codes, row, words = words_of(b.column(1), unicode_space=True)
                letters, mask, own, bucket = word_features(words)
                of = langs.indices.to_numpy(zero_copy_only=False)[row]
                out: tuple[list, list, list] = ([], [], [])
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    times = np.bincount(codes[of == k], minlength=len(words))
                    grams = np.bincount(bucket, times[own], minlength=BUCKETS)
                    seen = np.flatnonzero(grams)
                    bits = mask[:, None] >> np.arange(32)[None, :] & 1
                    chars = (bits * (times * letters)[:, None]).sum(0)
                    used = np.flatnonzero(chars)
                    out[0].extend([lang] * (len(seen) + len(used)))
                    out[1].append(np.concatenate([seen, -1 - used]))
                    out[2].append(np.concatenate([grams[seen], chars[used]]))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]).astype(float))], ["l", "k", "n"])

    found = rows.mapInArrow(run, "l string, k long, n double").groupBy("l", "k").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found.l.unique())
    table = np.zeros((BUCKETS, max(1, len(langs))))
    scripts = np.zeros(max(1, len(langs)), np.int64)
    for k, lang in enumerate(langs):
        own = found[found.l == lang]
        grams, chars = own[own.k >= 0], own[own.k < 0]
        table[grams.k.to_numpy(), k] = grams.n
        for j, n in zip(-1 - chars.k, chars.n, strict=True):
            if n >= 0.005 * chars.n.sum():
                scripts[k] |= 1 << int(j)
    table = np.log(table + 0.5) - np.log(table.sum(0) + 0.5 * BUCKETS)
    return LanguageModel(list(langs), table.astype(np.float32), scripts)


def viterbi(score: np.ndarray, start: np.ndarray, penalty: float, chunk: int = 64) -> np.ndarray:
    """The best label of each word for documents that begin at `start`, where a change of label costs `penalty`.

    Documents are cut into chunks. The gains between each chunk's first and last label form a
    matrix; chunks of all documents fill theirs at once, then matrices are joined in the
    order of the document, and chunks are traced back apart. Steps are as many as a chunk is long,
    plus the chunks of the longest document.
    """
    n, size = score.shape
    if not n or size == 1:
        return np.zeros(n, np.int32)
    lens = np.diff(np.append(start, n))
    per = -(-lens // chunk)
    first = np.concatenate([[0], np.cumsum(per)])
    total = int(first[-1])
    doc = np.repeat(np.arange(len(lens)), per)
    at = start[doc] + (np.arange(total) - first[doc]) * chunk
    have = np.minimum(chunk, (start + lens)[doc] - at)

    def gains(t: int) -> np.ndarray:
        pos = np.minimum(at + t, n - 1)
        return np.where((t < have)[:, None], score[pos], 0).astype(np.float32)

    m = np.full((total, size, size), -np.inf, np.float32)
    m[:, np.arange(size), np.arange(size)] = 0
    for t in range(chunk):
        m = np.maximum(m, m.max(2, keepdims=True) - penalty) + gains(t)[:, None, :]
    entry = np.zeros((total, size), np.int32)
    enter = np.zeros((total, size), np.float32)
    last = np.zeros((len(lens), size), np.float32)
    order = np.argsort(-per, kind="stable")
    for k in range(int(per.max())):
        live = order[: int((per > k).sum())]
        c = first[live] + k
        enter[c] = last[live]
        both = last[live][:, :, None] + m[c]
        entry[c] = both.argmax(1)
        last[live] = both.max(1)
    leave, begin = np.zeros(total, np.int32), np.zeros(total, np.int32)
    state = last.argmax(1).astype(np.int32)
    for k in reversed(range(int(per.max()))):
        live = order[: int((per > k).sum())]
        c = first[live] + k
        leave[c] = state[live]
        state[live] = entry[c, state[live]]
        begin[c] = state[live]
    v = np.full((total, size), -np.inf, np.float32)
    v[np.arange(total), begin] = 0
    stay, best = np.zeros((chunk, total, size), bool), np.zeros((chunk, total), np.int32)
    for t in range(chunk):
        best[t] = v.argmax(1)
        moved = v.max(1, keepdims=True) - penalty
        stay[t] = v >= moved
        v = np.maximum(v, moved) + gains(t)
    label = np.zeros((total, chunk), np.int32)
    state, every = leave.copy(), np.arange(total)
    for t in reversed(range(chunk)):
        label[:, t] = state
        state = np.where(stay[t, every, state], state, best[t])
    return label[np.arange(chunk)[None, :] < have[:, None]]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 6.0, spans: bool = False) -> DataFrame:
    """One row per input row: id, lang_pred, score (and spans of words by language).

    Words are scored by the languages whose scripts they are written in; Viterbi with a
    penalty for each change labels them all. lang_pred has the most letters in its spans;
    score is their share of the letters, lowered where the runner-up explains
    them nearly as well. spans holds (first word, words, language).

    Null texts, and texts without a letter, are `und` with score 0; so is every text if the model
    knows no language. Ties go to the language first by name. Ids may be null or repeat;
    an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        size = max(1, len(own.langs))
        for whole in batches:
            for b in portions(whole, "t", 1 << 20):
                n = b.num_rows
                codes, row, words = words_of(b.column(1), unicode_space=True)
                letters, scores = own.word_scores(words) if own.langs else (np.zeros(len(words), np.int64), np.zeros((len(words), 1), np.float32))
                s, w = scores[codes], letters[codes]
                begins = np.flatnonzero(np.diff(row, prepend=-1))
                label = viterbi(s, begins, penalty)
                by = np.bincount(row * size + label, w, minlength=n * size).reshape(n, size)
                best = by.argmax(1)
                all_letters = by.sum(1)
                share = by[np.arange(n), best] / np.maximum(all_letters, 1)
                mine = label == best[row]
                sums = np.stack([np.bincount(row[mine], s[mine, k], minlength=n) for k in range(size)], 1).astype(float)
                lead = sums[np.arange(n), best]
                sums[np.arange(n), best] = -np.inf
                margin = np.clip(lead - sums.max(1), -30, 30) if size > 1 else np.full(n, 30.0)
                some = (all_letters > 0) & bool(own.langs)
                score = np.where(some, share / (1 + np.exp(-margin)), 0.0)
                names = np.array([*own.langs, UNKNOWN], object)
                cols = [b.column(0), pa.array(names[np.where(some, best, len(own.langs))], pa.string()), pa.array(score)]
                if spans:
                    cols.append(_spans(row, label, n, names))
                yield pa.RecordBatch.from_arrays(cols, ["i", "lang_pred", "score", "spans"][: len(cols)])

    more = ", spans array<struct<first_word: int, words: int, lang: string>>" if spans else ""
    return rows.mapInArrow(run, f"i {kind}, lang_pred string, score double{more}").withColumnRenamed("i", id_col)


def _spans(row: np.ndarray, label: np.ndarray, n: int, names: np.ndarray) -> pa.Array:
    new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
    begins = np.searchsorted(row, row[new])
    length = np.diff(np.append(new, len(row)))
    parts = pa.StructArray.from_arrays([pa.array((new - begins).astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(names[label[new]], pa.string())], ["first_word", "words", "lang"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), parts)
