"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.workers import WordTable, fold, fold_components, gather, mix, portions, raw_of, release, slices, word_places
from pricewright.operators.components import connected_components
from pricewright.session import stash

BITS = 64


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The 2^(radius+1) - 1 masks of a covering family.

    Bit i carries the vector 1 + i mod (2^(radius+1) - 1) over GF(2); the mask of v has the
    bits whose vector has an odd inner product with v. Any `radius` differing bits span at
    most `radius` of the radius+1 dimensions, so some v is orthogonal to all of them: its
    mask touches none of the differing bits, and the pair collides in that table.
    """
    top = 1 << (radius + 1)
    vec = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vec[i] & v).bit_count() & 1) for v in range(1, top)]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text; 0 where it has no word."""
    ones, total, tail = np.zeros(BITS, np.int64), 0, []
    parts = slices(fold(text))
    for part in parts:
        words = tail + part.split()
        if len(words) >= shingle:
            grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
            h = np.fromiter(map(xxhash.xxh64_intdigest, grams, (seed for _ in words)), np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(h)
            tail = words[len(words) - shingle + 1 :]
        else:
            tail = words
    if not total:
        if not tail:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(tail), seed)
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, f): the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = rows.schema["i"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f)], ["i", "f"])

    return rows.mapInArrow(run, f"i {kind.simpleString()}, f long")


def _forest(radius: int):
    """Links of runs of rows with equal (t, k, lo, hi): for each row the root that it reaches within its batch."""

    def links(f: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(f)
        i, step, root = np.arange(n), 0, np.arange(n)
        a, b, held = [], [], 0
        while len(i):
            step += 1
            i = i[i + step < n]
            i = i[run[i] == run[i + step]]
            near = np.bitwise_count(f[i] ^ f[i + step]) <= radius
            a.append(i[near])
            b.append(i[near] + step)
            held += len(a[-1])
            if held > 1 << 20 or not len(i):
                root = fold_components(n, np.concatenate([np.arange(n), *a]), np.concatenate([root, *b]))
                a, b, held = [], [], 0
        return np.arange(n), root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)])
            rest = keys if rest is None else np.concatenate([rest, keys], axis=1)
            new = (np.diff(rest[:4], axis=1) != 0).any(0)
            if not new.any():
                continue
            cut = int(np.flatnonzero(new)[-1]) + 1
            head, rest = rest[:, :cut], rest[:, cut:]
            yield from out(head)
        if rest is not None:
            yield from out(rest)

    def out(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.concatenate([[0], np.cumsum((np.diff(keys[:4], axis=1) != 0).any(0))])
        f = keys[4].astype(np.int64)
        me, root = links(f.view(np.uint64), start)
        tied = me != root
        pairs = np.unique(np.stack([f[tied], f[root[tied]]]), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        if pairs.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["src", "dst"])

    return run


def near_links(nodes: DataFrame, radius: int = 3, block: int = 512) -> DataFrame:
    """(src, dst): links that connect all fingerprints f of nodes (distinct) within `radius` bits.

    Each of the covering tables buckets a fingerprint by its masked bits. Buckets of one
    fingerprint end there. A bucket of more than `block` is cut into blocks by a hash, and
    each pair of blocks is a unit of its own, so no task holds a bucket that grows with the
    data, and every pair of the bucket is still compared. A unit returns a spanning forest
    of its pairs within the radius, not the pairs.
    """
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)])
    rows = nodes.select("f", F.explode(keys).alias("x")).select("f", "x.t", "x.k")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["t", "k"]).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    mine = F.pmod(F.xxhash64("f"), F.col("parts")).cast("int")
    rows = rows.withColumn("b", mine).select("t", "k", "b", "f", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    rows = rows.select("t", "k", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "f")
    units = rows.repartition("t", "k", "lo", "hi").sortWithinPartitions("t", "k", "lo", "hi", "f")
    return units.mapInArrow(_forest(radius), "src long, dst long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, block: int = 512) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most `radius` bits are linked; component_id is the
    smallest id reachable over links, the own id included. Equal fingerprints are one node
    of the graph, so a hot group of copies is counted once and costs one row a task.

    A null or wordless text has fingerprint zero and links like any other. Null ids never
    become component_id unless a component has no other. Repeated rows each get their row;
    an empty table gives no rows; other columns of docs are ignored.
    """
    prints = stash(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = stash(prints.groupBy("f").agg(F.min("i").alias("first")), "nodes")
    member = connected_components(stash(near_links(nodes.select("f"), radius, block), "links"))
    member = nodes.join(member, nodes.f == member.node, "left").select("f", "first", F.coalesce("component", "f").alias("c"))
    lowest = member.groupBy("c").agg(F.min("first").alias("low"))
    named = stash(member.join(lowest, "c").select("f", "low"), "named")
    return prints.join(named, "f", "left").select(
        F.col("i").alias(id_col),
        F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"),
        F.col("low").alias("component_id"),
    )


# Similarity of word shingles: wide fingerprints, parts of them covered, and an exact check.

WIDE = 4  # 64-bit words of a wide fingerprint
PART_BITS = 36
PARTS = 7
PART_RADIUS = 4
FAR = 28  # of 128 bits: over this, a pair is not looked at
CLOSE = 8  # of 128 bits: rows of a task so close to another go on as that one
MOST_DEALT = 1 << 23  # bytes that are dealt at once
UNIT = 1 << 17  # rows of a table that are compared in one unit, about
NEAREST = 8  # centres of a row, over all tables, whose texts are compared in the first pass
SAMPLED = 20_000  # texts, about, from which common shingles are known, or
SAMPLED_SHARE = 1 / 8  # of all texts, if that is more: so what is common does not begin at more texts as the input grows
RANKED = 1 << 18  # common shingles that are told apart in the order of all
RANGE = 1 << 24  # bytes of text to a range of prefix shingles, about
WANTED = 1 << 20  # keys of texts that are sent to every task; more are joined by a shuffle


def shingle_hashes(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word shingles, in order, and the text of each. A text of fewer words has one of them all, one without words none."""
    raw, at = raw_of(pa.compute.ascii_lower(pa.compute.fill_null(texts.cast(pa.string()), "")))
    begin, size, per = word_places(raw, at)
    h = WordTable.hashes(raw, begin, size)
    last = np.cumsum(per)
    row = np.repeat(np.arange(len(per)), per)
    left = last[row] - np.arange(len(row))
    first = np.arange(len(row)) == (last - per)[row]
    start = np.flatnonzero((left >= shingle) | first)
    out = np.zeros(len(start), np.uint64)
    for k in range(shingle):
        there = k < left[start]
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + np.where(there, h[np.minimum(start + k, max(0, len(h) - 1))], np.uint64(k)) if len(h) else out)
    return out, row[start]


def wide_prints(texts: pa.Array, shingle: int, most: int = 1 << 23) -> np.ndarray:
    """The SimHash of each text in WIDE words; zeros where it has no word. Texts of over `most` bytes are read in slices."""
    ones, total = np.zeros((len(texts), WIDE * BITS), np.int64), np.zeros(len(texts), np.int64)

    def add(h: np.ndarray, row: np.ndarray) -> None:
        total[:] += np.bincount(row, minlength=len(total))
        for a in range(0, len(h), 1 << 17):
            own, rows = h[a : a + (1 << 17)], row[a : a + (1 << 17)]
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            for w in range(WIDE):
                bits = np.unpackbits(mix(own + np.uint64(0xD1B54A32D192ED03 * (w + 1) & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones[rows[starts], w * BITS : (w + 1) * BITS] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)

    if len(texts) == 1 and texts[0].is_valid and len(fold(texts[0].as_py())) > most:
        tail: list[bytes] = []
        for part in slices(fold(texts[0].as_py())):
            words = tail + part.split()
            if len(words) >= shingle:
                add(*shingle_hashes(pa.array([b" ".join(words).decode()]), shingle))
                words = words[len(words) - shingle + 1 :]
            tail = words
    else:
        add(*shingle_hashes(texts, shingle))
    return np.packbits((2 * ones > total[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def cover(key: np.ndarray, a: np.ndarray, b: np.ndarray, seed: int = 0, far: int = FAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal key, in an order that seed gives: each that no earlier centre covers becomes one and covers the rest within `far` of 128 bits.

    Returns the centre and the row of each cover, and all centres, sorted by key. So copies of one
    text cost a comparison each, however many they are. A row whose centre proves unlike it in one
    order has another centre in the next, so tables of different seeds lose fewer of its links.
    """
    order = np.lexsort((mix(a ^ np.uint64(seed)), key))
    k, x, y = key[order], a[order], b[order]
    stays = np.ones(len(order), bool)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    live = np.flatnonzero(same[1:] | same[:-1])
    centres, rows = [], []
    while len(live):
        head = np.flatnonzero(np.diff(k[live].astype(np.int64), prepend=-1))
        of = np.repeat(live[head], np.diff(np.append(head, len(live))))
        near = np.bitwise_count(x[live] ^ x[of]).astype(np.int64) + np.bitwise_count(y[live] ^ y[of]) <= far
        hit = near & (live != of)
        centres.append(of[hit])
        rows.append(live[hit])
        stays[live[hit]] = False
        live = live[~near & (live != of)]
        lone = np.ones(len(live) + 1, bool)
        lone[1:-1] = k[live[1:]] != k[live[:-1]]
        live = live[~(lone[1:] & lone[:-1])]
    join = lambda v: order[np.concatenate(v)] if v else np.zeros(0, np.int64)
    return join(centres), join(rows), order[stays]


def gaps(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """In how many bits rows of words differ."""
    return np.bitwise_count(f ^ g).sum(1, dtype=np.uint64)


def part_tables() -> list[tuple[int, int]]:
    """(part, mask) of every table."""
    return [(p, m) for p in range(PARTS) for m in covering_masks(PART_RADIUS, PART_BITS)]


def _deal(ranges: int):
    """A mapInArrow body: nodes (f0..f3) to packed rows (u, data): covers at once, and what is left by table and range of keys."""
    tables = part_tables()
    weights = np.uint64(1) << np.arange(PART_BITS, dtype=np.uint64)

    def out(f: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")
        part = [(bits[:, p * PART_BITS : (p + 1) * PART_BITS].astype(np.uint64) * weights).sum(1, dtype=np.uint64) for p in range(PARTS)]
        units, data = [], []
        for t, (p, m) in enumerate(tables):
            key = (mix((part[p] & np.uint64(m)) + np.uint64(t << 48)) >> np.uint64(32)).astype(np.uint32)
            c, r, left = cover(key, f[:, 0], f[:, 1], far=CLOSE)
            if len(c):
                units.append(-1 - t)
                data.append(np.stack([f[c, 0], f[r, 0], gaps(f[c, :2], f[r, :2])]).tobytes())
            cuts = np.searchsorted(key[left], [(-(-(g << 32) // ranges)) for g in range(1, ranges)])
            for g, own in enumerate(np.split(left, cuts)):
                if len(own):
                    units.append(t * ranges + g)
                    data.append(key[own].tobytes() + f[own, 0].tobytes() + f[own, 1].tobytes())
            if sum(map(len, data)) >= MOST_DEALT or t == len(tables) - 1:
                if units:
                    yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(data, pa.binary())], ["u", "data"])
                units, data = [], []
        release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(np.stack([c.to_numpy().view(np.uint64) for c in b.columns], axis=1))
            n += b.num_rows
            if n >= UNIT:
                yield from out(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from out(np.concatenate(held))

    return run


def _compare(ranges: int):
    """A mapInArrow body: rows (u, data) sorted by u to the distinct covers (centre src, row dst, bits between them) of each unit."""

    def solve(u: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        if u < 0:
            c, r, gap = np.unique(np.concatenate([np.frombuffer(d, np.int64).reshape(3, -1) for d in data], axis=1), axis=1)
        else:
            n = [len(d) // 20 for d in data]
            key = np.concatenate([np.frombuffer(d, np.uint32, k) for d, k in zip(data, n, strict=True)])
            a, b = (np.concatenate([np.frombuffer(d, np.uint64, k, k * (4 + 8 * j)) for d, k in zip(data, n, strict=True)]) for j in range(2))
            x, y, _ = cover(key, a, b, u // ranges)
            c, r = a[x].view(np.int64), a[y].view(np.int64)
            gap = gaps(np.stack([a[x], b[x]], axis=1), np.stack([a[y], b[y]], axis=1))
        if len(c):
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(r), pa.array(gap.astype(np.int32))], ["src", "dst", "gap"])

    return _by_unit(solve)


def _by_unit(solve):
    """A mapInArrow body that gives solve the data of each unit of rows (u, data) sorted by u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for u, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if u != key and held:
                    yield from solve(key, held)
                    held = []
                    release()
                key = u
                held.append(d)
        if held:
            yield from solve(key, held)
        release()

    return run


def close_pairs(nodes: DataFrame) -> DataFrame:
    """(src, dst): each text of nodes (d, f0..f3) with the NEAREST of the centres that cover it in any table, and with one of those of the same first word."""
    reps = stash(nodes.groupBy("f0").agg(F.min(F.struct("d", "f1", "f2", "f3")).alias("x")).select("f0", "x.*"), "reps")
    ranges = max(1, -(-reps.count() // UNIT))
    dealt = reps.select("f0", "f1", "f2", "f3").mapInArrow(_deal(ranges), "u int, data binary")
    met = dealt.repartition("u").sortWithinPartitions("u").mapInArrow(_compare(ranges), "src long, dst long, gap int").where("src <> dst")
    best = met.groupBy("dst").agg(F.slice(F.array_sort(F.collect_set(F.struct("gap", "src"))), 1, NEAREST).alias("best"))
    best = best.select("dst", F.explode("best.src").alias("src"))
    of = reps.select("f0", "d")
    best = best.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").select("a", "b")
    twins = nodes.join(reps.select("f0", F.col("d").alias("a")), "f0").where("a <> d").select("a", F.col("d").alias("b"))
    return best.unionAll(twins).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def least_shared(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many members a set of n shares at least with any set of this similarity."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def prefixes(texts: pa.Array, shingle: int, similarity: float, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Of each text: how many different shingles it has, and those of its prefix, as 64-bit keys in ascending order.

    One order holds for all texts: shingles that are not among common (sorted) by their hash, then those by their rank.
    Two sets of this similarity have a shingle in common that is in the prefixes of both.
    """
    h, row = shingle_hashes(texts, shingle)
    key = h >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        key = np.where(common[at] == h, rank[at] | np.uint64(1 << 63), key)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, n = key[new], np.bincount(row[new], minlength=len(texts))
    end = np.cumsum(n)
    size = np.where(n > 0, n - least_shared(n, similarity) + 1, 0)
    return n, [key[a : a + k].tobytes() for a, k in zip((end - n).tolist(), size.tolist(), strict=True)]


def common_shingles(rows: DataFrame, nodes: int, shingle: int, most: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
    """The RANKED most frequent shingles of two or more of a sample of texts of rows (t, d), sorted, and their ranks, from the rarest on.

    The ranks only order shingles, so the sample has no bearing on results. Of a text, the `most` lowest hashes count.
    """
    some = rows.where(F.pmod("d", F.lit(1 << 32)) < int(min(1.0, max(SAMPLED / max(nodes, 1), SAMPLED_SHARE)) * (1 << 32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "t", 1 << 21):
                h, row = shingle_hashes(b.column(0), shingle)
                own = [np.unique(x)[:most] for x in np.split(h, np.searchsorted(row, np.arange(1, b.num_rows)))]
                h, n = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counts = some.groupBy("d").agg(F.first("t").alias("t")).select("t").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counts.where("n >= 2").orderBy(F.desc("n"), "h").limit(RANKED).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    h = h[np.lexsort((h, n))]
    back = np.argsort(h)
    return h[back], back.astype(np.uint64)


def _deal_prefixes(ranges: int, most: int = 1 << 12):
    """A mapInArrow body: nodes (d, c, n, p) to packed rows (u, data) by range of their prefix shingles."""

    def out(d: np.ndarray, c: np.ndarray, n: np.ndarray, p: list[bytes]) -> Iterator[pa.RecordBatch]:
        size = np.array([len(x) // 8 for x in p])
        g = mix(np.frombuffer(b"".join(p), np.uint64))
        node = np.repeat(np.arange(len(d)), size)
        pos = np.minimum(np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size), 65535).astype(np.uint16)
        unit = ((g >> np.uint64(48)) * np.uint64(ranges) >> np.uint64(16)).astype(np.int32)
        order = np.argsort(unit, kind="stable")
        cuts = np.searchsorted(unit[order], np.arange(1, ranges))
        units, data = [], []
        for u, own in enumerate(np.split(order, cuts)):
            if len(own):
                who, times = np.unique(node[own], return_counts=True)
                tied = np.flatnonzero(c[who] != d[who])
                parts = [np.array([len(who), len(own), len(tied)], np.int64), d[who], c[who[tied]], n[who].astype(np.int32), times.astype(np.int32), tied.astype(np.int32), g[own].astype(np.uint32), pos[own]]
                units.append(u)
                data.append(b"".join(x.tobytes() for x in parts))
        if units:
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(data, pa.binary())], ["u", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, most):
                own = b.slice(a, most)
                yield from out(*(own.column(k).to_numpy(zero_copy_only=False) for k in range(3)), own.column(3).to_pylist())
            release()

    return run


def _meet(similarity: float, most: int = 1 << 20):
    """A mapInArrow body: rows (u, data) sorted by u to pairs of nodes of different components that share a prefix shingle and may be similar by their sizes and its places."""
    share = similarity / (1 + similarity)

    def solve(u: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        kinds = ((np.int64, 0), (np.int64, 2), (np.int32, 0), (np.int32, 0), (np.int32, 2), (np.uint32, 1), (np.uint16, 1))
        cols: list[list[np.ndarray]] = [[] for _ in kinds]
        base = 0
        for x in data:
            held, at = np.frombuffer(x, np.int64, 3), 24
            for col, (kind, of) in zip(cols, kinds, strict=True):
                col.append(np.frombuffer(x, kind, held[of], at))
                at += col[-1].nbytes
            cols[4][-1] = cols[4][-1] + base
            base += int(held[0])
        d, own, n, times, tied, h, pos = (np.concatenate(x) for x in cols)
        c = d.copy()
        c[tied] = own
        node = np.repeat(np.arange(len(d), dtype=np.int32), times)
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        order = order[np.append(same, False) | np.append(False, same)] if len(h) else order
        h, node, pos = h[order], node[order], pos[order]
        order = np.lexsort((c[node], h))
        h, node, pos = h[order], node[order], pos[order]
        new = np.append(h[1:] != h[:-1], True)
        end = np.flatnonzero(new)[np.cumsum(new) - new] + 1  # of the rows that share the shingle
        new |= np.append(c[node[1:]] != c[node[:-1]], True)
        other = np.flatnonzero(new)[np.cumsum(new) - new] + 1  # of those of the row's component
        live = np.flatnonzero(other < end)
        total = np.cumsum(end[live] - other[live])
        while len(live):
            k = max(1, int(np.searchsorted(total, most, side="right")))
            own, live, total = live[:k], live[k:], total[k:] - total[k - 1]
            i, j = np.repeat(own, end[own] - other[own]), gather(other[own], end[own] - other[own])
            x, y = node[i], node[j]
            a, b = n[x].astype(np.int64), n[y].astype(np.int64)
            may = np.minimum(a - pos[i], b - pos[j]) >= share * (a + b) - 1e-6
            may &= np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6
            if may.any():
                s, t = d[x[may]], d[y[may]]
                pairs = np.unique(np.stack([np.minimum(s, t), np.maximum(s, t)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["src", "dst"])

    return _by_unit(solve)


def apart_pairs(rows: DataFrame, nodes: DataFrame, member: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(src, dst): all pairs of texts of rows (t, d) of different components by member that may have this similarity; no other such pair has it.

    This is a prefix filter, which is exact: of n shingles in one order for all texts, similar ones share one among
    the first n - ceil(similarity * n) + 1. Pairs within a component are not made, so a group of copies
    costs what its prefixes have.
    """
    count, size = nodes.count(), rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    common, rank = common_shingles(rows, count, shingle)
    ranges = min(1 << 16, max(1, -(-size // RANGE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "t", 1 << 21):
                n, p = prefixes(b.column(0), shingle, similarity, common, rank)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n.astype(np.int32)), pa.array(p, pa.binary())], ["d", "n", "p"])

    firsts = rows.select("t", "d").mapInArrow(run, "d long, n int, p binary").groupBy("d").agg(F.first("n").alias("n"), F.first("p").alias("p"))
    firsts = firsts.where("n > 0").join(member.toDF("d", "c"), "d", "left").select("d", F.coalesce("c", "d").alias("c"), "n", "p")
    units = firsts.mapInArrow(_deal_prefixes(ranges), "u int, data binary").repartition("u").sortWithinPartitions("u")
    return units.mapInArrow(_meet(similarity), "src long, dst long").distinct()


def outline(texts: pa.Array, shingle: int) -> tuple[np.ndarray, list[bytes]]:
    """Of each text: how many different shingles it has, and how many of them, up to 255, lie in each of about half as many ranges of hashes."""
    h, row = shingle_hashes(texts, shingle)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = mix(h[new]), row[new]
    n = np.bincount(row, minlength=len(texts))
    bits = np.clip(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) - 1, 3, 16)
    end = np.cumsum(1 << bits)
    start = end - (1 << bits)
    at = start[row] + (h >> (64 - bits[row]).astype(np.uint64)).astype(np.int64)
    held = np.minimum(np.bincount(at, minlength=int(end[-1]) if len(end) else 0), 255).astype(np.uint8).tobytes()
    return n, [held[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def may_share(a: bytes, b: bytes) -> int:
    """The most members that two sets of these outlines can have in common: in each range, the lesser count."""
    if b"\xff" in a or b"\xff" in b:  # there may be more than were counted
        return sys.maxsize
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x.reshape(len(y), -1).sum(1)
    return int(np.minimum(x, y).sum(dtype=np.int64))


def outlines(rows: DataFrame, shingle: int) -> DataFrame:
    """(d, n, o): the outline of each text of rows (t, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "t", 1 << 20):
                n, o = outline(b.column(0), shingle)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(n.astype(np.int32)), pa.array(o, pa.binary())], ["d", "n", "o"])

    return rows.select("t", "d").mapInArrow(run, "d long, n int, o binary").groupBy("d").agg(F.first("n").alias("n"), F.first("o").alias("o"))


def possible(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """pairs (src, dst) without those that cannot have this similarity by their outlines in lines (d, n, o). No pair that has it is lost."""
    both = pairs.join(lines.toDF("src", "m", "a"), "src").join(lines.toDF("dst", "n", "b"), "dst").select("src", "dst", "m", "n", "a", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in batches:
            need = similarity / (1 + similarity) * (c.column(2).to_numpy().astype(np.int64) + c.column(3).to_numpy()) - 1e-6
            keep = [may_share(a, b) >= k for a, b, k in zip(c.column(4).to_pylist(), c.column(5).to_pylist(), need.tolist(), strict=True)]
            yield c.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "src long, dst long")


def similar_links(rows: DataFrame, pairs: DataFrame, lines: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of pairs (src, dst) whose texts in rows (t, d) have at least this Jaccard similarity of shingles, by their whole texts.

    Only pairs that their outlines in lines (d, n, o) leave possible meet texts: the others may be many times more.
    """
    pairs = stash(possible(stash(pairs, "pairs"), lines, similarity), "possible")
    wanted = stash(pairs.select(F.explode(F.array("src", "dst")).alias("d")).distinct(), "wanted")
    if wanted.count() <= WANTED:
        wanted = F.broadcast(wanted)
    texts = stash(rows.select("d", "t").join(wanted, "d").groupBy("d").agg(F.first("t").alias("t")), "texts")
    both = pairs.join(texts.toDF("src", "a"), "src").join(texts.toDF("dst", "b"), "dst").select("src", "dst", "a", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "a", 1 << 20):
                sets = []
                for col in (2, 3):
                    h, row = shingle_hashes(b.column(col), shingle)
                    sets.append(np.split(h, np.searchsorted(row, np.arange(1, b.num_rows))))
                keep = []
                for x, y in zip(*sets, strict=True):
                    x, y = np.unique(x), np.unique(y)
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(n >= similarity * (len(x) + len(y) - n) - 1e-9)
                yield b.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "src long, dst long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: id, component_id, the smallest id reachable over links of texts of at least this Jaccard similarity.

    Similarity is that of sets of word shingles, A-Z lower-cased. Two passes find the links. The first is SimHash:
    fingerprints have 256 bits; seven parts of 36 bits each have the 31 tables of radius 4, so a pair that differs in at
    most 4 bits of some part meets. What meets within FAR of 128 bits goes to the first centre of its bucket, in another
    order in each table, and a row's NEAREST centres are compared with it, so that a group of copies costs a few pairs a row.
    The second pass makes all pairs between the components of the first that a prefix filter cannot rule out. Whole
    texts decide in both, so components are exact, up to equal 64-bit hashes. Equal texts are one node.

    Null and wordless texts are linked with each other and with nothing else. Null ids never become component_id
    unless a component has no other. Repeated rows each get their row; an empty table gives
    no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in portions(whole, "t", 1 << 21):
                f = wide_prints(b.column(1), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(f[:, k]) for k in range(WIDE))], ["i", "d", *(f"f{k}" for k in range(WIDE))])

    rows = rows.withColumn("d", F.xxhash64("t"))
    prints = stash(rows.mapInArrow(run, f"i {kind}, d long, f0 long, f1 long, f2 long, f3 long"), "prints")
    nodes = prints.groupBy("d").agg(F.min("i").alias("first"), F.min(F.struct("f0", "f1", "f2", "f3")).alias("x"))
    nodes = stash(nodes.select("d", "first", "x.*"), "nodes")
    texts = rows.select("t", "d")
    lines = stash(outlines(texts, shingle), "outlines")
    links = stash(similar_links(texts, close_pairs(nodes), lines, shingle, similarity), "links")
    member = stash(connected_components(links), "member")
    links = similar_links(texts, apart_pairs(texts, nodes, member, shingle, similarity), lines, shingle, similarity)
    member = connected_components(stash(links.unionAll(member.toDF("src", "dst")), "links"))
    member = nodes.join(member, nodes.d == member.node, "left").select("d", "first", F.coalesce("component", "d").alias("c"))
    lowest = member.groupBy("c").agg(F.min("first").alias("low"))
    named = stash(member.join(lowest, "c").select("d", "low"), "named")
    return prints.join(named, "d", "left").select(F.col("i").alias(id_col), F.col("low").alias("component_id"))
