"""What the Python workers of several operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Whitespace of the contracts: \x20 and \x09-\x0D, as bytes.split() takes it.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fold(text: str | None) -> bytes:
    """UTF-8 with only A-Z lower-cased; null is empty."""
    return b"" if text is None else text.encode().translate(_FOLD)


def worker_cache() -> dict:
    """A dictionary that lives as long as the worker process, across tasks."""
    return sys.__dict__.setdefault("_pricewright_cache", {})


def slices(raw: bytes, most: int = 1 << 21) -> Iterator[bytes]:
    """raw in pieces of about `most` bytes, cut only at ASCII whitespace."""
    at = 0
    while len(raw) - at > most:
        end = at + most
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def portions(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of about `most` text bytes, a row at least."""
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(col).to_pylist()], dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Give memory that is free within this process back to the system; a reused worker else keeps its peak."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def gather(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where the members of rows of a ragged array lie, one row after the other, from where each row begins and how many it has."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordTable:
    """Words of at most `longest` bytes and their ids, in arrays of bounded size; full, it forgets all and begins anew.

    Words are told apart by 64 bits of hash. `encode` gives the ids of words, in a row, and how many each has.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bits: int = 22, longest: int = 64):
        self.encode, self.bits, self.longest = encode, bits, longest
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.key, self.at, self.n = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, np.int16)
        self.held, self.used, self.ids = 0, 0, np.zeros(1 << 16, np.uint32)

    @staticmethod
    def hashes(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """64-bit hashes of words raw[begin : begin + size]. raw has eight more bytes than its words."""
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        h = size.astype(np.uint64)
        live, at, left = slice(None), begin, size
        while len(left):
            cover = np.where(left >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) << np.uint64(3))) - np.uint64(1))
            h[live] = mix(h[live] * np.uint64(0x9E3779B97F4A7C15) + (eight[at] & cover))
            more = np.flatnonzero(left > 8)
            live = more if isinstance(live, slice) else live[more]
            at, left = at[more] + 8, left[more] - 8
        return np.maximum(h, np.uint64(1))

    def _find(self, h: np.ndarray) -> np.ndarray:
        out, live, s = np.full(len(h), -1, np.int64), np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(live):
            k = self.key[s]
            hit = k == h[live]
            out[live[hit]] = s[hit]
            on = (k != 0) & ~hit
            live, s = live[on], (s[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Distinct words that are not held."""
        self.held += len(h)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        live, s = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        begin = self.used + np.cumsum(n) - n
        while len(live):
            free = self.key[s] == 0
            self.key[s[free]] = h[live[free]]
            won = self.key[s] == h[live]
            self.at[s[won]], self.n[s[won]] = begin[live[won]], n[live[won]]
            live, s = live[~won], (s[~won] + 1) & ((1 << self.bits) - 1)
        self.used += len(ids)

    def rows(self, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words raw[begin : begin + size] in a row, and how many each has. raw has eight more bytes."""
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        brief = np.flatnonzero(size > self.longest)
        own = size if not len(brief) else np.where(size > self.longest, 0, size)
        h = self.hashes(raw, begin, own)
        slot = self._find(h)
        lost = np.flatnonzero(slot < 0)
        if len(lost):
            new, first = np.unique(h[lost], return_index=True)
            if self.held + len(new) > (1 << self.bits) * 5 // 8:
                self.clear()
                new, first = np.unique(h, return_index=True)
                lost = np.arange(len(h))
                if len(new) > (1 << self.bits) * 5 // 8:
                    raise ValueError("a portion has more words than the table")
            data = raw.tobytes()
            words = [data[b : b + n] for b, n in zip(begin[lost[first]].tolist(), own[lost[first]].tolist(), strict=True)]
            self._add(new, *self.encode(words))
            slot[lost] = self._find(h[lost])
        n, at = self.n[slot].astype(np.int64), self.at[slot]
        if not len(brief):
            return self.ids[gather(at, n)], n
        ids, more = self.encode([raw[begin[i] : begin[i] + size[i]].tobytes() for i in brief.tolist()])
        pool = np.concatenate([self.ids[: self.used], ids.astype(np.uint32)])
        n[brief], at[brief] = more, self.used + np.cumsum(more) - more
        return pool[gather(at, n)], n


def raw_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts in a row, followed by eight zeros, and where each text begins, and the last ends."""
    t = pa.concat_arrays([texts])
    ends = np.frombuffer(t.buffers()[1], np.int32, len(t) + 1 + t.offset)[t.offset :].astype(np.int64)
    raw = np.frombuffer(t.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.concatenate([raw, np.zeros(8, np.uint8)]), ends - ends[0]


def word_places(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of raw_of()'s texts: where words (between ASCII whitespace) begin, how long they are, and how many each text has."""
    inside = ~_SPACE[raw[:-8]]
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] & ~inside[:-1]
    edge[at[:-1][np.diff(at) > 0]] = True
    begins = np.flatnonzero(edge[:-1] & inside)
    stop = np.zeros(len(inside) + 1, bool)
    stop[1:-1] = inside[:-1] & ~inside[1:]
    stop[at[1:][np.diff(at) > 0]] = True
    ends = np.flatnonzero(stop[1:] & inside) + 1
    return begins, ends - begins, np.diff(np.searchsorted(begins, at))


def fold_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links a-b: the smallest node that each can reach."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def words_of(texts: pa.Array, unicode_space: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of texts in order: their codes, the row of each, and the distinct words by code.

    A-Z are lower-cased. Words end at ASCII whitespace, or at any Unicode whitespace.
    """
    pc = pa.compute
    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    lists = (pc.utf8_split_whitespace if unicode_space else pc.ascii_split_whitespace)(low)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(texts), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), row[full.to_numpy(zero_copy_only=False)], coded.dictionary


def held_out(id_col: str, parts: int, rest: int):
    """Whether crc32(id as text) mod parts is rest, as a column; not for null ids, which are learned from."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % parts == rest, F.lit(False))


def bounded_sample(df, key: str, bound: int):
    """About `bound` rows of df, or all if it has fewer: those whose hash of key is lowest.

    Only a count goes over all rows first; the choice depends on the keys alone.
    """
    from pyspark.sql import functions as F

    n = df.count()
    if n <= bound:
        return df
    share = int(bound / n * (1 << 32))
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 32)) < share)
