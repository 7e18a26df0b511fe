"""SentencePiece encoding and decoding with a BPE model as a max-plus parallel scan.

Merging leaves a sequence of pieces as it is exactly where it leaves each two neighbours as they
are. So a step from piece to piece weighs 0 where the model keeps the two apart and minus infinity
elsewhere, and the one path of weight 0 through a text is the model's encoding of it. A
text is cut into chunks; the state at a cut is the piece that covers the character before it. Each
chunk gives the matrix of its best weights from state to state, matrices are joined by the
associative max-plus product, and with the states at its ends known each chunk is traced back alone.

Blanks stand only at a piece's begin, or alone, and some characters are in no longer piece: a cut
there has one state, its matrix is 1 x 1. What lies between such cuts, a stretch, is scanned once
and remembered.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.workers import WordTable, gather, mix, portions, raw_of, worker_cache
from pricewright.session import stash

BLANK = "▁"
CHUNK = 64
GIANT = 1 << 20
SEGMENT = 1 << 16
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20
_PAIR_SLOTS = 21
_START = -1  # a chunk's begin where a stretch begins: every piece may follow
_NONE = -2


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The best weights over two runs of chunks, from theirs."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each cut on the best path through all matrices, the first one's only state and the last one's only state included.

    Matrices are joined pairwise, level by level; going down again, each half of a joined pair
    gets the state at its inner cut from its own two matrices.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        m = levels[-1]
        levels.append([max_plus(m[k], m[k + 1]) if k + 1 < len(m) else m[k] for k in range(0, len(m), 2)])
    states = [0, 0]
    for m in reversed(levels[:-1]):
        out = []
        for k in range(0, len(m), 2):
            out.append(states[k // 2])
            if k + 1 < len(m):
                out.append(int((m[k][states[k // 2]] + m[k + 1][:, states[k // 2 + 1]]).argmax()))
        states = [*out, states[-1]]
    return states


@dataclass
class Chunks:
    """Scanned chunks: their states at both ends as (chunk, offset, piece), sorted, and a lane for each state at the begin."""

    entry: np.ndarray  # 3 x lanes
    exits: np.ndarray  # 3 x states, those at the end
    base: np.ndarray  # of each lane in the arrays below
    size: np.ndarray  # characters of each chunk
    piece: np.ndarray  # the piece that ends at a place of a lane
    length: np.ndarray
    count: np.ndarray  # pieces up to there

    def matrices(self) -> list[np.ndarray]:
        lanes, ends = (np.searchsorted(x[0], np.arange(len(self.size) + 1)) for x in (self.entry, self.exits))
        out = []
        for k in range(len(self.size)):
            own, to = np.arange(lanes[k], lanes[k + 1]), slice(ends[k], ends[k + 1])
            at = self.base[own][:, None] + self.size[k] + self.exits[1, to][None, :]
            out.append(np.where(self.piece[at] == self.exits[2, to][None, :], 0.0, -np.inf).astype(np.float32))
        return out

    def trace(self, lane: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces after each lane's entry up to place `stop`, in order, and how many each lane has."""
        at, first = self.base[lane] + stop, self.base[lane] + np.maximum(self.entry[1, lane], 0)
        n = self.count[at]
        out = np.empty(int(n.sum()), np.int32)
        to = np.cumsum(n) - 1
        while len(at):
            live = at > first
            at, first, to = at[live], first[live], to[live]
            out[to] = self.piece[at]
            at, to = at - self.length[at], to - 1
        return out, n


class PieceScanner:
    """A SentencePiece BPE model's pieces and, asked of its merges and remembered, which two stay apart."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        special = [self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) for i in ids]
        self.names = [self.model.id_to_piece(i) for i in ids]
        normal = [(p, i) for i, p in enumerate(self.names) if not special[i]]
        long = [p for p, _ in normal if len(p) > 1]
        if any(BLANK in p[1:] and p.strip(BLANK) for p in long) or any("\n" in p for p, _ in normal):
            raise ValueError("pieces of this model hold blanks within or line ends")
        self.unknown = len(self.names)
        self.widest = max(map(len, long), default=1)
        self.byte = np.array([self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.single = np.full(0x110000, self.unknown, np.int32)
        for p, i in normal:
            if len(p) == 1:
                self.single[ord(p)] = i
        # hashes of longer pieces by slot
        key = np.array([int(self._hash(np.array([[ord(c) for c in p]], np.uint64))[0]) for p in long], np.uint64)
        order = np.argsort(key, kind="stable")
        self.key, self.of = key[order], np.array([i for p, i in normal if len(p) > 1], np.int32)[order]
        self.slot = np.searchsorted(self.key >> np.uint64(64 - _SLOTS), np.arange((1 << _SLOTS) + 1, dtype=np.uint64)).astype(np.int32)
        self.full = np.diff(self.slot).astype(np.int8)
        # pairs that were asked about, by slot; a newer one takes the place of an older one
        self.pair_key = np.full(1 << _PAIR_SLOTS, -1, np.int64)
        self.pair_apart = np.zeros(1 << _PAIR_SLOTS, bool)
        bare = [b"" if self.model.is_control(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(self.names)]
        for b, i in enumerate(self.byte):
            bare[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(bare), np.uint8)
        self.surface_len = np.array([len(b) for b in bare], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len

    def _hash(self, chars: np.ndarray) -> np.ndarray:
        h = np.zeros(len(chars), np.uint64)
        for k in range(chars.shape[1]):
            h = h * _PRIME + chars[:, k] + np.uint64(1)
        return mix(h)

    def _pieces(self, code: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces within strings that end at `end` (of each character), by where they end, the longest first: that end, length, id."""
        own = code.astype(np.uint64) + np.uint64(1)
        at, h = np.arange(len(code)), own.copy()
        found = [(at + 1, np.ones(len(code), np.int32), self.single[code])]
        for n in range(2, self.widest + 1):
            live = at + n <= end[at]
            at, h = at[live], h[live]
            if not len(at):
                break
            h = h * _PRIME + own[at + n - 1]
            key = mix(h)
            s = (key >> np.uint64(64 - _SLOTS)).astype(np.int64)
            some = np.flatnonzero(self.full[s] > 0)
            for r in range(int(self.full.max(initial=0))):
                some = some[self.full[s[some]] > r]
                hit = some[self.key[self.slot[s[some]] + r] == key[some]]
                found.append((at[hit] + n, np.full(len(hit), n, np.int32), self.of[self.slot[s[hit]] + r]))
        stop, length, piece = (np.concatenate(c[::-1]) for c in zip(*found, strict=True))
        order = np.argsort(stop.astype(np.int32), kind="stable")
        return stop[order], length[order], piece[order]

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves piece a before piece b as they are."""
        known = (a >= self.unknown) | (b >= self.unknown)
        key = a.astype(np.int64) << 32 | b
        s = (mix(key.astype(np.uint64)) >> np.uint64(64 - _PAIR_SLOTS)).astype(np.int64)
        out = known | self.pair_apart[s]
        lost = np.flatnonzero(~known & (self.pair_key[s] != key))
        if len(lost):
            new, back = np.unique(key[lost], return_inverse=True)
            x, y = (new >> 32).tolist(), (new & 0xFFFFFFFF).tolist()
            ids = np.array(self.model.encode("\n" + "".join(f"{self.names[p]}{self.names[q]}\n" for p, q in zip(x, y, strict=True)), num_threads=1), np.int64)
            line = np.flatnonzero(ids == self.byte[10])
            two = np.diff(line) == 3
            first, second = ids[line[:-1] + 1], ids[np.minimum(line[:-1] + 2, len(ids) - 1)]
            got = (two & (first == new >> 32) & (second == new & 0xFFFFFFFF))[back]
            out[lost] = got
            self.pair_key[s[lost]], self.pair_apart[s[lost]] = key[lost], got
            # of several pairs of one slot the last is kept: its key and answer are written in the same order
        return out

    def scan(self, texts: list[str], begin: np.ndarray, end: np.ndarray, open_left: np.ndarray, open_right: np.ndarray) -> Chunks:
        """Scan characters begin..end of each text (blanks as BLANK); beyond an open end the text goes on for as far as a piece may reach."""
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        origin = np.cumsum(size) - size
        chunk_of = np.repeat(np.arange(len(texts)), size)
        stop, length, piece = self._pieces(code, (origin + size)[chunk_of])
        own = chunk_of[stop - 1]
        start = stop - length
        b, e = (origin + begin)[own], (origin + end)[own]
        left, right = (open_left[own] & (start < b) & (stop >= b)), (open_right[own] & (start < e) & (stop >= e))
        entry = np.stack([own, stop - b, piece])[:, left]
        plain = np.flatnonzero(~open_left)
        entry = np.concatenate([entry, np.stack([plain, np.zeros(len(plain), np.int64), np.full(len(plain), _START)])], axis=1)
        exits = np.stack([own, stop - e, piece])[:, right]
        closed = np.flatnonzero(~open_right)
        exact = ~open_right[own] & (stop == e)
        exits = np.concatenate([exits, np.stack([own, stop - e, piece])[:, exact], np.zeros((3, 0), np.int64)], axis=1)
        entry, exits = (x[:, np.lexsort(x[::-1])] for x in (entry, exits))
        del closed
        # candidates by the place where they end; only those that begin within the chunk
        inside = (start >= b) & (start < e)
        stop, length, piece = stop[inside], length[inside], piece[inside]
        many = np.bincount(stop, minlength=len(code) + 1)
        head = np.cumsum(many) - many
        lane_chunk = entry[0]
        span = (end - begin)[lane_chunk]
        reach = np.where(open_right, np.minimum(size - begin, end - begin + self.widest - 1), end - begin)[lane_chunk]
        base = np.cumsum(reach + 1) - (reach + 1)
        total = int((reach + 1).sum())
        last, last_len, count = np.full(total, _NONE, np.int32), np.zeros(total, np.int32), np.zeros(total, np.int32)
        last[base + entry[1]] = entry[2]
        del span
        text_at = (origin + begin)[lane_chunk]
        order = np.argsort(-reach, kind="stable")
        falling = -reach[order]
        for k in range(1, int(reach.max(initial=0)) + 1):
            lanes = order[: int(np.searchsorted(falling, -k, side="right"))]
            lanes = lanes[entry[1, lanes] < k]
            place, r = text_at[lanes] + k, 0
            n = many[place]
            while len(lanes):
                some = n > r
                lanes, place, n = lanes[some], place[some], n[some]
                if not len(lanes):
                    break
                c = head[place] + r
                size_c, t = length[c], piece[c]
                from_ = base[lanes] + k - size_c
                fits = k - size_c >= 0
                before = np.where(fits, last[np.maximum(from_, 0)], _NONE)
                ok = before == _START
                ask = np.flatnonzero(before >= 0)
                ok[ask] = self._apart(before[ask], t[ask])
                to = base[lanes[ok]] + k
                last[to], last_len[to], count[to] = t[ok], size_c[ok], count[from_[ok]] + 1
                lanes, place, n, r = lanes[~ok], place[~ok], n[~ok], r + 1
        return Chunks(entry, exits, base, end - begin, last, last_len, count)

    def _ids(self, piece: np.ndarray, n: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of n pieces; characters that are no piece become their bytes."""
        lost = np.flatnonzero(piece == self.unknown)
        if not len(lost):
            return piece, n
        run = np.repeat(np.arange(len(n)), n)
        begin = np.cumsum(n) - n
        each, raw = np.ones(len(piece), np.int64), []
        for r in np.unique(run[lost]).tolist():
            at = 0
            for k in range(int(begin[r]), int(begin[r] + n[r])):
                if piece[k] == self.unknown:
                    raw.append(texts[r][at].encode("utf-8", "replace"))
                    each[k] = len(raw[-1])
                    at += 1
                else:
                    at += len(self.names[piece[k]])
        out = np.repeat(piece, each)
        out[np.repeat(piece == self.unknown, each)] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.bincount(run, each, minlength=len(n)).astype(np.int64)

    def stretches(self, words: list[bytes], chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches, in a row, and how many each has. Longer ones than a chunk are cut and joined by matrices."""
        texts = [w.decode().replace(" ", BLANK) for w in words]
        parts, counts = [], []
        for a in range(0, len(texts), 1 << 16):
            own = texts[a : a + (1 << 16)]
            size = np.array([len(t) for t in own])
            if size.max() <= chunk:
                no = np.zeros(len(own), bool)
                done = self.scan(own, np.zeros(len(own), np.int64), size, no, no)
                got, n = self._ids(*done.trace(np.arange(len(own)), size), own)
            else:
                each = [self.long(t, 0, len(t), False, False, None, None, chunk) if t else np.zeros(0, np.int32) for t in own]
                got, n = np.concatenate(each), np.array([len(x) for x in each])
            parts.append(got)
            counts.append(n)
        return (np.concatenate(parts), np.concatenate(counts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _cut(self, text: str, begin: int, end: int, open_left: bool, open_right: bool, chunk: int) -> Chunks:
        """The chunks of characters begin..end of a text, scanned at once."""
        w = self.widest
        cuts = [*range(begin, end, chunk), end]
        if len(cuts) > 2 and cuts[-1] - cuts[-2] < w:  # a piece may cover one cut only
            del cuts[-2]
        low = [max(0, c - w) for c in cuts[:-1]]
        parts = [text[a : z + w] for a, z in zip(low, cuts[1:], strict=True)]
        m = len(parts)
        left, right = np.ones(m, bool), np.ones(m, bool)
        left[0], right[-1] = open_left, open_right
        if not open_right:
            parts[-1] = text[low[-1] : end]
        if not open_left:
            low[0], parts[0] = begin, text[begin : cuts[1] + w] if m > 1 or open_right else text[begin:end]
        low_at = np.array(low)
        return self.scan(parts, np.array(cuts[:-1]) - low_at, np.array(cuts[1:]) - low_at, left, right)

    def matrix(self, text: str, begin: int, end: int, open_left: bool, open_right: bool, chunk: int = CHUNK) -> np.ndarray:
        """The best weights over characters begin..end of a text, by the states at both ends."""
        m = self._cut(text, begin, end, open_left, open_right, chunk).matrices()
        while len(m) > 1:
            m = [max_plus(m[k], m[k + 1]) if k + 1 < len(m) else m[k] for k in range(0, len(m), 2)]
        return m[0]

    def long(self, text: str, begin: int, end: int, open_left: bool, open_right: bool, entry: int | None, leave: int | None, chunk: int = CHUNK) -> np.ndarray:
        """The ids of the pieces after state `entry` up to and with state `leave` (None at closed ends)."""
        done = self._cut(text, begin, end, open_left, open_right, chunk)
        m = done.matrices()
        m[0] = m[0][[entry or 0]]
        m[-1] = m[-1][:, [leave]] if open_right else m[-1].max(1, keepdims=True)
        state = boundary_states(m)
        lanes, ends = (np.searchsorted(x[0], np.arange(len(done.size) + 1)) for x in (done.entry, done.exits))
        lane = lanes[:-1] + np.array([entry or 0, *state[1:-1]])
        last = leave if open_right else int(np.flatnonzero(done.matrices()[-1][lane[-1] - lanes[-2]] == 0)[0])
        place = done.size + done.exits[1, ends[:-1] + np.array([*state[1:-1], last])]
        piece, n = done.trace(lane, place)
        at = begin + (int(done.entry[1, lane[0]]) if open_left else 0)
        return self._ids(piece, np.array([len(piece)]), [text[at:]])[0]

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of runs of n ids, with the blank before each text, and how many bytes each run has."""
        size = self.surface_len[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        stop = np.cumsum(n)
        return self.surface[gather(self.surface_at[ids], size)], ends[stop] - ends[stop - n]


def scanner(path: str) -> PieceScanner:
    cache = worker_cache()
    if ("pieces", path) not in cache:
        cache["pieces", path] = PieceScanner(path)
    return cache["pieces", path]


def words_of_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts as raw_of(), each begun by the blank that the library puts before it; where each ends, and where stretches begin, and how many each text has."""
    t = pc.fill_null(texts.cast(pa.string()), "")
    t = pc.replace_substring(t, BLANK, " ")
    t = pc.if_else(pc.equal(t, ""), "", pc.binary_join_element_wise(" ", t, ""))
    raw, at = raw_of(t)
    cut = np.zeros(len(raw) - 7, bool)
    blank, line = raw[:-8] == 32, raw[:-8] == 10
    cut[1:-1] = blank[1:] & ~blank[:-1] | line[1:] | line[:-1]
    cut[at[:-1][np.diff(at) > 0]] = True
    begins = np.flatnonzero(cut[:-1])
    return raw, at, begins, np.diff(np.searchsorted(begins, at))


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts in a row, how many each has, and whether they decode to it."""
    own, cache = scanner(path), worker_cache()
    known = cache.setdefault(("stretches", path), WordTable(own.stretches))
    raw, at, begins, per = words_of_text(texts)
    ids, n = known.rows(raw, begins, np.diff(np.append(begins, len(raw) - 8)))
    count = np.bincount(np.repeat(np.arange(len(texts)), per), n, minlength=len(texts)).astype(np.int64)
    got, size = own.decode(ids, count)
    same = size == np.diff(at)
    if same.all():
        same[np.searchsorted(at[1:], np.flatnonzero(got != raw[:-8]), side="right")] = False
    else:
        ends = np.cumsum(size) - size
        same &= np.array([x and (got[a : a + k] == raw[z : z + k]).all() for x, a, z, k in zip(same, ends, at[:-1], size, strict=True)], bool)
    return ids, count, same


def _rows(i: pa.Array, ids: np.ndarray, n: np.ndarray, same: np.ndarray, with_ids: bool) -> pa.RecordBatch:
    stop = np.cumsum(n)
    raw = ids.astype("<u4")
    crc = [zlib.crc32(raw[a:z]) for a, z in zip((stop - n).tolist(), stop.tolist(), strict=True)]
    cols = [i, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)]
    if with_ids:
        cols.append(pa.ListArray.from_arrays(pa.array(np.append(stop - n, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
    return pa.RecordBatch.from_arrays(cols, ["i", "n_pieces", "ids_crc32", "round_trip", "ids"][: len(cols)])


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, giant: int = GIANT, segment: int = SEGMENT) -> DataFrame:
    """One row per input row: id, n_pieces, ids_crc32 (little-endian 32-bit ids), round_trip (and ids).

    Ids equal the library's on whole texts; round_trip tells whether they decode to the text.
    A text of more than `giant` characters is dealt over tasks in segments: each gives its
    matrix, a text's matrices are joined, and each segment is traced back apart.

    Null and empty texts have no pieces. Ids may be null or repeat; an empty table gives
    no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    out = f"i {kind}, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "t"):
                yield _rows(b.column(0), *encode_texts(path, b.column(1)), with_ids)

    long = F.coalesce(F.length("t"), F.lit(0)) > giant
    small = rows.where(~long).mapInArrow(run, out)
    big = rows.where(long)
    if big.isEmpty():
        return small.withColumnRenamed("i", id_col)
    big = stash(big.withColumn("k", F.monotonically_increasing_id()), "giants")
    return small.unionAll(_giants(big, path, out, with_ids, segment)).withColumnRenamed("i", id_col)


def _segment(own: PieceScanner, text: str, begin: int, end: int, first: bool, last: bool, entry: int | None, leave: int | None, solve: bool) -> np.ndarray:
    """A segment's matrix, or its ids between two states if solve. A cut with one state within it parts the work."""
    cuts = [k for k in range(max(begin + own.widest, 1), end) if text[k] == BLANK and text[k - 1] != BLANK]
    head = cuts[0] if cuts else None
    tail = next((c for c in reversed(cuts) if c <= end - own.widest), None)
    if tail is None or head is None or tail < head:
        head = tail = None
    if not solve:
        if head is None:
            return own.matrix(text, begin, end, not first, not last)
        return max_plus(_closed(own.matrix(text[:head], begin, head, not first, False)), own.matrix(text[tail:], 0, end - tail, False, not last))
    if head is None:
        return own.long(text, begin, end, not first, not last, entry, leave)
    inner = np.zeros(0, np.int32)
    if tail > head:
        inner = encode_texts_of(own, text[head:tail])
    return np.concatenate([own.long(text[:head], begin, head, not first, False, entry, None), inner, own.long(text[tail:], 0, end - tail, False, not last, None, leave)])


def encode_texts_of(own: PieceScanner, text: str) -> np.ndarray:
    """The ids of a run of whole stretches, which begins with a blank."""
    raw, _, begins, _ = words_of_text(pa.array([text.replace(BLANK, " ")[1:]]))
    data = raw.tobytes()
    return own.stretches([data[a:z] for a, z in zip(begins.tolist(), [*begins[1:].tolist(), len(raw) - 8], strict=True)])[0]


def _closed(m: np.ndarray) -> np.ndarray:
    """A matrix up to a cut that has one state."""
    return m.max(1, keepdims=True)


def _giants(big: DataFrame, path: str, out: str, with_ids: bool, segment: int) -> DataFrame:
    """What encode_pieces returns, of stored rows (i, t, k) with texts of several segments."""
    parts = "k long, j int, t string, lead int, size int, first boolean, last boolean"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = scanner(path).widest
        for b in batches:
            for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), strict=True):
                t = BLANK + t.replace(" ", BLANK)
                cuts = [*range(0, len(t), segment), len(t)]
                if len(cuts) > 2 and cuts[-1] - cuts[-2] < 2 * w:
                    del cuts[-2]
                for j, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    low = max(0, a - w)
                    row = [k, j, t[low : z + w], a - low, z - a, a == 0, z == len(t)]
                    yield pa.RecordBatch.from_arrays([pa.array([x], p) for x, p in zip(row, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()), strict=True)], ["k", "j", "t", "lead", "size", "first", "last"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(path)
        for b in batches:
            for r in b.to_pylist():
                m = _segment(own, r["t"], r["lead"], r["lead"] + r["size"], r["first"], r["last"], None, None, False)
                m = _closed(m) if r["last"] else m
                yield pa.RecordBatch.from_arrays([pa.array([r["k"]]), pa.array([r["j"]], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([np.packbits(m == 0).tobytes()]), pa.array([m.shape[0]], pa.int32())], ["k", "j", "wide", "m", "high"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["j"])
        m = [np.where(np.unpackbits(np.frombuffer(r["m"], np.uint8), count=r["high"] * r["wide"]).reshape(r["high"], r["wide"]) > 0, 0.0, -np.inf).astype(np.float32) for r in rows]
        state = boundary_states(m)
        return pa.table({"k": pa.array([r["k"] for r in rows], pa.int64()), "j": pa.array([r["j"] for r in rows], pa.int32()), "entry": pa.array(state[:-1], pa.int32()), "leave": pa.array(state[1:], pa.int32())})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(path)
        for b in batches:
            for r in b.to_pylist():
                raw = _segment(own, r["t"], r["lead"], r["lead"] + r["size"], r["first"], r["last"], r["entry"], r["leave"], True)
                yield pa.RecordBatch.from_arrays([pa.array([r["k"]]), pa.array([r["j"]], pa.int32()), pa.array([raw.astype("<u4").tobytes()], pa.binary())], ["k", "j", "raw"])

    def whole(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        raw = b"".join(r["raw"] for r in sorted(found.to_pylist(), key=lambda r: r["j"]))
        ids = np.frombuffer(raw, "<u4").astype(np.int32)
        got, _ = scanner(path).decode(ids, np.array([len(ids)]))
        same = got.tobytes() == (" " + texts.column("t")[0].as_py().replace(BLANK, " ")).encode()
        return pa.Table.from_batches([_rows(texts.column("i").combine_chunks(), ids, np.array([len(ids)]), np.array([same]), with_ids)])

    dealt = stash(big.select("k", "t").mapInArrow(deal, parts).repartition("k", "j"), "segments")
    states = dealt.mapInArrow(weigh, "k long, j int, wide int, m binary, high int").groupBy("k").applyInArrow(join, "k long, j int, entry int, leave int")
    traced = dealt.join(states, ["k", "j"]).mapInArrow(solve, "k long, j int, raw binary")
    return big.groupBy("k").cogroup(traced.groupBy("k")).applyInArrow(whole, out)


def decode_pieces(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows of ids; null ids give null. Ids repeat or not; an empty table gives no rows; other columns are ignored."""
    own = rows.select(F.col(id_col).alias("i"), F.col(ids_col).alias("x"))
    kind = own.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scanner(path).model
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else model.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["i", "text"])

    return own.mapInArrow(run, f"i {kind}, text string").withColumnRenamed("i", id_col)
