"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.workers import fold_components
from pricewright.operators.components import connected_components
from pricewright.session import stash

SLACK = 1e-7  # bounds are widened by this, so rounding prunes no pair


@dataclass
class CoverTree:
    """Nested nodes over unit vectors; a level's centres cover its points at half the radius of the level above.

    A node keeps its centre among its children, and the distance to the farthest of its points.
    """

    unit: np.ndarray
    leaf: int = 8
    depth: int = 16
    points: list[np.ndarray] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    kids: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        gap = np.sqrt(np.maximum(0, 2 - 2 * (self.unit @ self.unit.T)))

        def add(own: np.ndarray, level: int) -> int:
            node = len(self.points)
            self.points.append(own)
            self.radius.append(float(gap[own[0], own].max()))
            self.kids.append([])
            if len(own) > self.leaf:
                groups = [own]
                while len(groups) == 1 and level < self.depth:
                    level += 1
                    groups, rest = [], own
                    while len(rest):
                        near = gap[rest[0], rest] <= 2.0 ** (1 - level)
                        near[0] = True
                        groups.append(rest[near])
                        rest = rest[~near]
                if len(groups) > 1:
                    self.kids[node] = [add(g, level) for g in groups]
            return node

        if len(self.unit):
            add(np.arange(len(self.unit)), 0)


def dual(a: CoverTree, b: CoverTree, raw_a: np.ndarray, raw_b: np.ndarray, wa: np.ndarray, wb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the points of two trees, or within one if b is a: their weights by point, and the smallest point that each reaches.

    Points of a come first, then b's. A pair of nodes whose points must all be farther apart
    than the threshold is dropped, one whose points must all be nearer is counted as a whole, and
    others are opened; single points are compared by their cosine.
    """
    one = b is a
    na, n = len(raw_a), len(raw_a) + (0 if one else len(raw_b))
    shift = 0 if one else na
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    links, root = np.zeros(n, np.int64), np.arange(n)
    len_a, len_b = np.sqrt((raw_a**2).sum(1)), np.sqrt((raw_b**2).sum(1))
    pend: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def join(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal held, root
        pend.append((x, y))
        held += len(x)
        if held > 1 << 20:
            settle()

    def settle() -> None:
        nonlocal held, root
        if pend:
            root = fold_components(n, np.concatenate([np.arange(n), *(p[0] for p in pend)]), np.concatenate([root, *(p[1] for p in pend)]))
            pend.clear()
            held = 0

    def linked(x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(links, x, wb[y])
        np.add.at(links, y + shift, wa[x])
        join(x, y + shift)

    def brute(p: np.ndarray, q: np.ndarray, same: bool) -> None:
        cos = (raw_a[p] @ raw_b[q].T) / (len_a[p][:, None] * len_b[q][None, :])
        hit = cos >= threshold
        x, y = np.nonzero(np.triu(hit, 1) if same else hit)
        linked(p[x], q[y])

    def whole(p: np.ndarray, q: np.ndarray, same: bool) -> None:
        if same:
            links[p] += wb[p].sum() - wb[p]
            join(np.full(len(p), p[0]), p)
        else:
            links[p] += wb[q].sum()
            links[q + shift] += wa[p].sum()
            join(p, np.full(len(p), q[0] + shift))
            join(np.full(len(q), p[0]), q + shift)

    stack = [(0, 0)] if len(raw_a) and len(raw_b) else []
    while stack:
        s, t = stack.pop()
        same = one and s == t
        ks, kt = a.kids[s] or [s], b.kids[t] or [t]
        if not a.kids[s] and not b.kids[t]:
            if same and 2 * a.radius[s] <= reach - SLACK:
                whole(a.points[s], b.points[t], True)
            else:
                brute(a.points[s], b.points[t], same)
            continue
        cs, ct = np.array([a.points[k][0] for k in ks]), np.array([b.points[k][0] for k in kt])
        rs, rt = np.array([a.radius[k] for k in ks]), np.array([b.radius[k] for k in kt])
        zs, zt = np.array([len(a.points[k]) for k in ks]), np.array([len(b.points[k]) for k in kt])
        gap = np.sqrt(np.maximum(0, 2 - 2 * (a.unit[cs] @ b.unit[ct].T)))
        wide = rs[:, None] + rt[None, :]
        near = gap - wide <= reach + SLACK
        if same:
            near = np.triu(near)
        single = near & (zs == 1)[:, None] & (zt == 1)[None, :]
        if same:
            np.fill_diagonal(single, False)
        x, y = np.nonzero(single)
        if len(x):
            p, q = cs[x], ct[y]
            cos = np.einsum("ij,ij->i", raw_a[p], raw_b[q]) / (len_a[p] * len_b[q])
            linked(p[cos >= threshold], q[cos >= threshold])
        for x, y in zip(*np.nonzero(near & ~single), strict=True):
            twin = same and x == y
            if twin and zs[x] == 1:
                continue
            if gap[x, y] * (not twin) + wide[x, y] <= reach - SLACK:
                whole(a.points[ks[x]], b.points[kt[y]], twin)
            else:
                stack.append((ks[x], kt[y]))
    settle()
    return links, root, np.flatnonzero(links > 0)


def _units(threshold: float):
    """A mapInArrow body: rows (g, lo, hi, b, v, w, e) sorted by unit to (v, n, root) of linked vectors."""

    def solve(v: np.ndarray, w: np.ndarray, side: np.ndarray, e: np.ndarray, alone: bool) -> pa.RecordBatch | None:
        halves = [np.arange(len(v))] if alone else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
        if min(map(len, halves)) == 0:
            return None
        trees = [CoverTree(e[h] / np.sqrt((e[h] ** 2).sum(1, keepdims=True))) for h in halves]
        x, y = halves[0], halves[-1]
        links, root, some = dual(trees[0], trees[-1], e[x], e[y], w[x], w[y], threshold)
        order = x if alone else np.concatenate([x, y])
        ids = v[order]
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], ["v", "n", "root"]) if len(some) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if parts:
                v, w, side = (np.concatenate([p[k] for p in parts]) for k in range(3))
                out = solve(v, w, side, np.concatenate([p[3] for p in parts]), key[1] == key[2])
                if out is not None:
                    yield out

        for batch in batches:
            g, lo, hi, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            v, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
            lists = batch.column(6)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))])
            new = (np.diff(g, prepend=g[:1]) != 0) | (np.diff(lo, prepend=lo[:1]) != 0) | (np.diff(hi, prepend=hi[:1]) != 0)
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for s, t in zip(cuts[:-1], cuts[1:], strict=True):
                if s == t:
                    continue
                now = (int(g[s]), int(lo[s]), int(hi[s]))
                if now != key:
                    yield from close()
                    key, parts = now, []
                parts.append((v[s:t], w[s:t], (b[s:t] != lo[s]).astype(np.int8), flat[ends[s] : ends[t]].reshape(t - s, -1)))
        yield from close()

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, block: int = 2048) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Vectors of one label and length are linked where their cosine is at least `threshold`;
    no pair is left out. Equal vectors are one weighted point. A label's points are cut by
    hash into blocks of about `block`; each pair of blocks is a unit with a cover tree
    for either side, so no task holds a label, and a unit returns a count and a root for each linked point,
    not its pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    without label or id, link with nothing and are their own component. Repeated rows count as
    vectors of their own; an empty table gives no rows; other columns are ignored.
    """
    e = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("i"), F.col(label_col).alias("l"), e.alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    fit = F.col("i").isNotNull() & F.col("l").isNotNull() & F.coalesce(F.size("e") > 0, F.lit(False)) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(norm > 0, F.lit(False))
    usable = rows.where(fit)
    points = stash(usable.groupBy("l", "e").agg(F.min("i").alias("v"), F.count("*").alias("w")), "points")
    points = points.withColumn("g", F.xxhash64("l", F.size("e")))
    sizes = points.groupBy("g", "l", F.size("e").alias("z")).agg(F.count("*").alias("c")).select("g", "l", "z", F.ceil(F.col("c") / block).cast("int").alias("parts"))
    held = points.withColumn("z", F.size("e")).join(sizes, ["g", "l", "z"])
    held = held.withColumn("g", F.xxhash64("l", "z", F.lit("unit"))).withColumn("b", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    units = held.select("g", "b", "v", "w", "e", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
    units = units.select("g", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "v", "w", "e")
    units = units.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "v")
    kind = rows.schema["i"].dataType.simpleString()
    found = stash(units.mapInArrow(_units(threshold), f"v {kind}, n long, root {kind}"), "links")
    member = connected_components(found.where("v <> root"), "v", "root").withColumnRenamed("node", "v")
    counted = found.groupBy("v").agg(F.sum("n").alias("n"))
    named = points.select("l", "e", "v", "w").join(counted, "v", "left").join(member, "v", "left")
    named = named.select("l", "e", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "v").alias("c"))
    named = stash(named, "named")
    linked = usable.join(named, ["l", "e"]).select("i", "n", "c")
    rest = rows.where(~fit).select("i", F.lit(0).cast("long").alias("n"), F.col("i").alias("c"))
    return linked.unionAll(rest).select(F.col("i").alias(id_col), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.col("i").eqNullSafe(F.col("c")).alias("kept"))
