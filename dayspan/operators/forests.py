"""Many regression forests over the same rows, grown together: one scan of the rows for each level of all trees."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspan.session import cut_lineage

BINS = 32
# Numbers of one pass that a worker holds; more trees take more passes.
NUMBERS = 8_000_000
# Trees whose sums travel together.
BLOCK = 32
# Poisson(1) draws by 16 bits of a hash.
_DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]), (np.arange(65536) + 0.5) / 65536).astype(float)


@dataclass
class Forests:
    """Trees as full binary trees: forests x trees x nodes. A closed node sends everything left."""

    edges: list[np.ndarray]
    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray  # of the leaves; no number where a forest had no rows
    depth: int


def _codes(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Features x rows: number of edges under each value."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]).astype(np.int64)


def _draw(h: np.ndarray, tree: int) -> np.ndarray:
    """Poisson(1) weights of a tree from the rows' hashes, so that a lost task draws the same sample."""
    u = h ^ np.uint32((tree * 0x9E3779B1 + 0x85EBCA6B) & 0xFFFFFFFF)
    u ^= u >> np.uint32(16)
    u *= np.uint32(0x7FEB352D)
    u ^= u >> np.uint32(15)
    u *= np.uint32(0x846CA68B)
    return _DRAWS[u >> np.uint32(16)]


def _walk(codes: np.ndarray, feature: np.ndarray, bound: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row within level ``levels`` of one tree."""
    n = codes.shape[1]
    flat, at = codes.ravel(), np.arange(n)
    node = np.zeros(n, np.int64)
    for level in range(levels):
        place = node + (2**level - 1)
        node = 2 * node + (flat[feature[place] * n + at] > bound[place])
    return node


def _best(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node the cut of least squared error, from weights and weighted targets: trees x nodes x features x bins x 2."""
    left = sums.cumsum(3)[:, :, :, :-1]
    total = sums[:, :, :1].sum(3, keepdims=True)
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - total[..., 1] ** 2 / total[..., 0]
        gain = np.where((left[..., 0] > 0) & (right[..., 0] > 0), gain, -1.0).reshape(*sums.shape[:2], -1)
        at = gain.argmax(2)
        pick = lambda a: np.take_along_axis(a.reshape(*a.shape[:2], -1), at[..., None], 2)[..., 0]
        means = [total[:, :, 0, 0, 1] / total[:, :, 0, 0, 0], pick(left[..., 1] / left[..., 0]), pick(right[..., 1] / right[..., 0])]
    return at // (BINS - 1), at % (BINS - 1), pick(gain), *means


def fit_forests(rows: DataFrame, forests: int = 1, trees: int = 100, depth: int = 5, seed: int = 42) -> Forests:
    """Bagged regression trees; every split looks at all features, each cut into at most 32 bins at its quantiles.

    ``rows`` has x (array), y, h (a hash that tells rows apart) and first: the row is learned by the forests
    ``first`` and up. The cuts come from the rows of the earliest forest that has any. A worker adds up weights and
    targets per tree, node, feature and bin; sums of a block of trees meet in one task, which chooses the cuts, and
    only these reach the driver.
    """
    start = rows.filter(F.col("first") < forests).agg(F.min("first").alias("f"), F.avg("y").alias("m"), F.max(F.size("x")).alias("p")).first()
    leaves, count = 2**depth, forests * trees
    feature, bound = np.zeros((count, leaves - 1), np.int64), np.full((count, leaves - 1), BINS, np.int64)
    value = np.full((count, leaves), np.nan)
    if start["f"] is None:
        return Forests([], feature.reshape(forests, trees, -1), bound.reshape(forests, trees, -1), value.reshape(forests, trees, -1), depth)
    p, shift = start["p"], start["m"]
    shares = F.array(*[F.lit(i / (2 * BINS)) for i in range(1, 2 * BINS)])
    early = rows.filter(F.col("first") <= start["f"])
    cuts = early.agg(*[F.percentile_approx(F.col("x")[i], shares, 10_000).alias(f"q{i}") for i in range(p)]).first()
    # A cut lies halfway between two values beside each other, as far as 63 quantiles tell.
    edges = [np.unique((q[1::2][:BINS - 1] + q[2::2]) / 2) for q in (np.array(cuts[f"q{i}"], float) for i in range(p))]

    def encode(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
                codes = pa.array([r.tobytes() for r in _codes(x, edges).T.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([codes, b.column(1), b.column(2), b.column(3)], names=["b", "y", "h", "first"])

    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    given = rows.filter(F.col("first") < forests).select("x", (F.col("y") - F.lit(shift)).alias("y"), "h", F.col("first").cast("int"))
    coded = cut_lineage(given.mapInArrow(encode, "b binary, y double, h long, first int").repartition(tasks, "h"))
    closed = np.zeros((count, 1), bool)
    for level in range(depth):
        nodes = 2**level
        size = nodes * p * BINS * 2
        step = max(BLOCK, NUMBERS // size // BLOCK * BLOCK)
        found = [np.zeros((count, nodes)) for _ in range(6)]
        for low in range(0, count, step):
            high = min(count, low + step)

            def add(batches, low=low, high=high, level=level, nodes=nodes):
                sums = np.zeros((high - low, nodes, p, BINS, 2))
                for b in batches:
                    if not b.num_rows:
                        continue
                    every = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, p).T.astype(np.int64)
                    ys, first = b.column(1).to_numpy(), b.column(3).to_numpy()
                    hs = (b.column(2).to_numpy() & 0xFFFFFFFF).astype(np.uint32) ^ np.uint32(seed)
                    for k in range(low // trees, (high - 1) // trees + 1):
                        used = first <= k
                        codes, y, h = (every, ys, hs) if used.all() else (np.ascontiguousarray(every[:, used]), ys[used], hs[used])
                        for t in range(max(low, k * trees), min(high, (k + 1) * trees)):
                            w = _draw(h, t)
                            wy = w * y
                            node = _walk(codes, feature[t], bound[t], level) * BINS
                            for f in range(p):
                                place = node + codes[f]
                                sums[t - low, :, f, :, 0] += np.bincount(place, w, nodes * BINS).reshape(nodes, BINS)
                                sums[t - low, :, f, :, 1] += np.bincount(place, wy, nodes * BINS).reshape(nodes, BINS)
                for at in range(0, high - low, BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([sums[at:at + BLOCK].tobytes()], pa.binary())], names=["block", "part"])

            def choose(batches, nodes=nodes):
                total: dict[int, np.ndarray] = {}
                for b in batches:
                    for k, part in zip(b.column(0).to_pylist(), b.column(1)):
                        numbers = np.frombuffer(part.as_buffer())
                        total[k] = total[k] + numbers if k in total else numbers
                for k, numbers in total.items():
                    best = np.stack(_best(numbers.reshape(-1, nodes, p, BINS, 2)))
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([best.tobytes()], pa.binary())], names=["block", "part"])

            blocks = -(-(high - low) // BLOCK)
            shape = "block int, part binary"
            for r in coded.mapInArrow(add, shape).repartition(min(blocks, tasks), "block").mapInArrow(choose, shape).collect():
                best = np.frombuffer(r["part"]).reshape(6, -1, nodes)
                here = low + r["block"] * BLOCK
                for into, numbers in zip(found, best):
                    into[here:here + best.shape[1]] = numbers
        at_feature, at_bin, gain, mean, left, right = found
        own = mean if level == 0 else np.where(closed, inherited, mean)
        shut = closed | ~(gain > 1e-12)
        inside = slice(nodes - 1, 2 * nodes - 1)
        feature[:, inside] = np.where(shut, 0, at_feature)
        bound[:, inside] = np.where(shut, BINS, at_bin)
        inherited = np.stack([np.where(shut, own, left), np.where(shut, own, right)], 2).reshape(count, -1)
        closed = np.repeat(shut, 2, 1)
    value = inherited + shift
    shaped = lambda a: a.reshape(forests, trees, -1)
    return Forests(edges, shaped(feature), shaped(bound), shaped(value), depth)


def forest_prediction(df: DataFrame, model: Forests, x: Column, which: Column) -> Column:
    """Mean of the trees of forest ``which`` at ``x``; null if that forest had no rows or ``which`` is negative."""
    given = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def guess(xs: pa.Array, ks: pa.Array) -> pa.Array:
        m, k = given.value, ks.to_numpy(zero_copy_only=False)
        out = np.full(len(k), np.nan)
        if len(m.edges) and len(k):
            codes = _codes(np.asarray(xs.flatten()).reshape(len(k), -1), m.edges)
            for forest in np.unique(k[k >= 0]):
                here = k == forest
                part = np.ascontiguousarray(codes[:, here])
                leaves = (v[_walk(part, f, b, m.depth)] for f, b, v in zip(m.feature[forest], m.bound[forest], m.value[forest]))
                out[here] = sum(leaves) / m.feature.shape[1]
        return pa.array(out, from_pandas=True)

    return guess(x, which)
