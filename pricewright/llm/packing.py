"""Packing of tokenised documents into sequences of equal attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.workers import WordTable, portions, raw_of, word_places, worker_cache

WINDOW = 2048
END_ID = 1
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets: printable bytes of Latin-1 stand for themselves, the rest for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


def word_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Texts to their ids in a row and how many each has, by a tokenizer whose tokens never cross ASCII whitespace.

    Every whitespace-free word is encoded once and remembered, in bounded memory. One of
    letters of the Latin blocks, with or without `.`, `,` or `!` at its end, goes to the
    tokenizer's model as the word and the marks that its rules would make of it; any other goes
    through all of its rules.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    cache = worker_cache()
    if ("tokenizer", path) not in cache:
        whole = Tokenizer.from_file(path)
        bare = Tokenizer(whole.model)
        bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        letters = _byte_letters()

        def by_rules(words: list[bytes]) -> list[bytes]:
            return [np.array(g.ids, "<u4").tobytes() for g in whole.encode_batch([w.decode() for w in words], add_special_tokens=False)]

        def by_model(words: list[bytes], run: int = 256) -> list[bytes]:
            out = []
            for k in range(0, len(words), run):
                own = words[k : k + run]
                got = bare.encode(" ".join(w.decode() if w.isascii() else w.decode("latin-1").translate(letters) for w in own), add_special_tokens=False)
                ids = np.array(got.ids, "<u4").tobytes()
                ends = np.searchsorted(np.array(got.word_ids), np.arange(len(own) + 1)) * 4
                out += [ids[x:z] for x, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            return out

        def plain(core: bytes) -> bool:
            t = core.decode()
            return t.isalpha() and (t.isascii() or max(t) < "\u0250" and "\u0130" not in t)

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            cores = [w.rstrip(b".,!") for w in words]
            simple = [k for k, c in enumerate(cores) if c and plain(c)]
            rest = [k for k, c in enumerate(cores) if not (c and plain(c))]
            low = [cores[k].lower() if cores[k].isascii() else cores[k].decode().lower().encode() for k in simple]
            ends = [words[k][len(cores[k]) :] for k in simple]
            marks = {m: b"" for m in set(ends)}
            marks.update(zip([m for m in marks if m], by_rules([m for m in marks if m]), strict=True))
            out = [b""] * len(words)
            for k, x, m in zip(simple, by_model(low), ends, strict=True):
                out[k] = x + marks[m]
            for k, x in zip(rest, by_rules([words[k] for k in rest]), strict=True):
                out[k] = x
            return np.frombuffer(b"".join(out), "<u4"), np.fromiter(map(len, out), np.int64, len(out)) // 4

        cache["tokenizer", path] = WordTable(encode, bits=21)
    known = cache["tokenizer", path]
    pc = pa.compute

    def encode_all(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        t = pc.fill_null(texts.cast(pa.string()), "")
        raw, at = raw_of(pc.if_else(pc.match_substring(t, "<|"), t, pc.ascii_lower(t)))  # special tokens keep their case
        begin, size, per = word_places(raw, at)
        ids, n = known.rows(raw, begin, size)
        return ids, np.bincount(np.repeat(np.arange(len(t)), per), n, minlength=len(t)).astype(np.int64)

    return encode_all


def assign(lengths: np.ndarray, window: int = WINDOW, linear: float = 1.0, quadratic: float = 1 / WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these token counts.

    Whole windows of a long document are sequences of their own. The rests, in descending
    order, each go to the sequence of lowest cost that has room for all of it, where a piece of n
    tokens costs linear*n + quadratic*n^2; what has no room anywhere is cut over the
    cheapest sequences that have some. Capacities are as many windows as the tokens fill,
    and powers of two for what is left, which need no padding; so every sequence is full.
    """
    out, seq = [], 0
    for d in np.flatnonzero(lengths >= window):
        for k in range(int(lengths[d]) // window):
            out.append((int(d), k * window, window, seq, 0))
            seq += 1
    rest = lengths % window
    total = int(rest.sum())
    left = total % window
    room = np.array([window] * (total // window) + [1 << k for k in reversed(range(window.bit_length())) if left >> k & 1], np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), np.int64)

    def put(d: int, start: int, n: int, s: int) -> None:
        out.append((d, start, n, seq + s, int(used[s])))
        room[s] -= n
        used[s] += n
        cost[s] += linear * n + quadratic * n * n

    cut = []
    for d in np.argsort(-rest, kind="stable"):
        n = int(rest[d])
        if not n:
            break
        price = np.where(room >= n, cost, np.inf)
        s = int(price.argmin())
        if price[s] < np.inf:
            put(int(d), int(lengths[d]) - n, n, s)
        else:
            cut.append((int(d), n))
    for d, n in cut:
        start = int(lengths[d]) - n
        while n:
            s = int(np.where(room > 0, cost, np.inf).argmin())
            m = min(n, int(room[s]))
            put(d, start, m, s)
            start, n = start + m, n - m
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batch_tokens: int = 4_000_000, batch_docs: int = 16_384, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Each task packs its own rows in batches of up to `batch_tokens` tokens or `batch_docs`
    documents, so nothing is shuffled, memory is bounded and no batch depends on the size
    of the corpus; see assign() for the order and the costs. sequence_id holds the
    partition in its upper bits, so a task that is run again names its sequences alike.

    Null and empty texts are the one end id. A long text gives as many pieces as it needs.
    Null ids and repeated rows are packed as rows of their own; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        base, held, size, ids = TaskContext.get().partitionId() << 40, [], 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, held, size, ids
            lengths = np.array([len(h) for h in held], np.int64)
            pieces = assign(lengths, window)
            d, start, n, s, off = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            crc = [zlib.crc32(held[a][b : b + c]) for a, b, c, _, _ in pieces]
            cols = [pa.array(ids, rows_type).take(pa.array(d)), start, n, np.array(crc, np.int64), lengths[d], base + s, off]
            cols = [c if isinstance(c, pa.Array) else pa.array(c) for c in cols]
            names = ["i", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array([held[a][b : b + c].astype(np.int32) for a, b, c, _, _ in pieces], pa.list_(pa.int32())))
                names.append("ids")
            base, held, size, ids = base + int(s.max()) + 1, [], 0, []
            yield pa.RecordBatch.from_arrays(cols, names)

        rows_type = pa.int64()
        for b in batches:
            rows_type = b.column(0).type
            for part in portions(b, "t"):
                flat, n = encode(part.column(1))
                stop = np.cumsum(n + 1)
                with_end = np.full(len(flat) + len(n), END_ID, "<u4")
                ends = np.zeros(len(with_end), bool)
                ends[stop - 1] = True
                with_end[~ends] = flat
                for i, a, z in zip(part.column(0).to_pylist(), (stop - n - 1).tolist(), stop.tolist(), strict=True):
                    held.append(with_end[a:z])
                    ids.append(i)
                    size += z - a
                    if size >= batch_tokens or len(held) >= batch_docs:
                        yield from flush()
        if held:
            yield from flush()

    out = rows.mapInArrow(run, f"i {kind}, {PIECES}" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("i", id_col)
