"""Pairwise models fitted on all pairs: each round is one aggregate over the pairs, and only its sums come to the driver.

pairs: p and n, the feature vectors (arrays of doubles, equally long) of a positive and a negative.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import settled


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df, written, with `number`: its rows in order, from 0. Rows are sorted by ranges; a range starts where the ones before it end."""
    rows = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn("number", F.col("_before") + place).drop("_id", "_part", "_before")


def cut_points(pairs: DataFrame, most: int = 80) -> list[np.ndarray]:
    """For each feature up to `most` of the middles between its neighbouring distinct values, evenly spread by rank."""
    width = pairs.select(F.size("p").alias("w")).first()
    if width is None:
        return []

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.concatenate([_vectors(batch, name, width.w) for name in ("p", "n")])
            own = [np.unique(both[:, f]) for f in range(width.w)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width.w, dtype=np.int32), [len(x) for x in own])), pa.array(np.concatenate(own))], names=["f", "v"])

    values = pairs.select("p", "n").mapInArrow(distinct, "f int, v double").distinct()
    rows = numbered(values, "f", "v")
    spans = {r.f: (r.first, r.m) for r in rows.groupBy("f").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("m")).collect()}  # a row for each feature
    places = {f: np.linspace(0, m - 2, min(m - 1, most)).astype(int) + first for f, (first, m) in spans.items() if m > 1}
    wanted = sorted({int(x) for at in places.values() for i in at for x in (i, i + 1)})
    found = {}
    if wanted:
        asked = pairs.sparkSession.createDataFrame([(x,) for x in wanted], "number long")
        found = {r.number: r.v for r in rows.join(F.broadcast(asked), "number").select("number", "v").collect()}  # two for each cut
    return [np.array([(found[int(i)] + found[int(i) + 1]) / 2 for i in places.get(f, ())]) for f in range(width.w)]


def _vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


#: Pairs in a row of a packed table: a round reads the bytes of matrices, not an array a pair.
PACK = 16


def _packed(pairs: DataFrame, made: Callable[[pa.RecordBatch], np.ndarray], tag: str) -> DataFrame:
    """x, written: the matrices that are made from batches of pairs (a row a pair), PACK pairs in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = made(batch)
            yield pa.RecordBatch.from_arrays([pa.array([m[i : i + PACK].tobytes() for i in range(0, len(m), PACK)], pa.binary())], names=["x"])

    return settled(pairs.select("p", "n").mapInArrow(run, "x binary"), tag)


def _summed(packed: DataFrame, kind: type, width: int, size: int, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all matrices of a packed table of a vector of `size` numbers: added up within tasks, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for i in range(0, len(batch), 1024):
                total += sums(np.frombuffer(b"".join(batch.column("x").slice(i, 1024).to_pylist()), kind).reshape(-1, width))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "x"])

    out = np.zeros(size)
    for r in packed.mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r.at] = r.x
    return out


def fit_stumps(pairs: DataFrame, rounds: int = 40, rate: float = 0.08, cuts: int = 80) -> list[tuple[int, float, float, float]]:
    """Boosted stumps (feature, threshold, value at most, value above): as operators.datasets.train_stumps, on pairs of any number.

    Features are counted into bins once; a round adds up the gradients by feature and bin.
    """
    points = cut_points(pairs, cuts)
    width, bins = len(points), max([len(p) for p in points], default=0) + 1
    if width == 0 or bins == 1:
        return []

    def quantised(batch: pa.RecordBatch) -> np.ndarray:
        sides = [(name, f) for name in ("p", "n") for f in range(width)]
        vectors = {name: _vectors(batch, name, width) for name in ("p", "n")}
        return np.stack([np.searchsorted(points[f], vectors[name][:, f], "left") for name, f in sides], axis=1).astype(np.uint8)

    binned = _packed(pairs, quantised, "binned-pairs")
    offset = np.arange(width) * bins

    def differing(both: np.ndarray) -> np.ndarray:
        p, n = both[:, :width].astype(np.int64), both[:, width:].astype(np.int64)
        count = lambda x: np.bincount((x + offset).ravel(), minlength=width * bins)
        return (count(np.minimum(p, n)) - count(np.maximum(p, n))).astype(float)

    by_cut = lambda x: np.cumsum(x.reshape(width, bins), axis=1)
    told = by_cut(_summed(binned, np.uint8, 2 * width, width * bins, differing))
    real = np.arange(bins)[None, :] < np.array([len(p) for p in points])[:, None]
    out, steps = [], []
    for _ in range(rounds):
        held = list(steps)

        def gradients(both: np.ndarray) -> np.ndarray:
            p, n = both[:, :width], both[:, width:]
            ahead = np.zeros(len(p))
            for f, j, low, high in held:
                ahead += rate * (np.where(p[:, f] <= j, low, high) - np.where(n[:, f] <= j, low, high))
            g = 1 / (1 + np.exp(np.clip(ahead, -20, 20)))
            at, f = np.nonzero(p != n)  # equal bins of both sides take each other's weight away
            add = lambda x: np.bincount(x[at, f] + offset[f], weights=g[at], minlength=width * bins)
            return add(p) - add(n)

        s = by_cut(_summed(binned, np.uint8, 2 * width, width * bins, gradients))
        gain = np.where(real & (told > 0.5), s * s / (told + 1), 0.0)
        f, j = divmod(int(np.argmax(gain)), bins)
        delta = s[f, j] / (told[f, j] + 1) if gain[f, j] > 0 else 0.0
        if abs(delta) < 1e-6:
            break
        steps.append((f, j, delta / 2, -delta / 2))
        out.append((f, float(points[f][j]), float(delta / 2), float(-delta / 2)))
    return out


def _simplex_qp(a: np.ndarray, b: np.ndarray, l2: float, x: np.ndarray, steps: int = 3000) -> np.ndarray:
    """About the largest b.x - |a'x|^2 / (2 l2) over the simplex, by pairwise steps between the best and the worst used vertex."""
    gram = a @ a.T / l2
    slope = b - gram @ x
    for _ in range(steps):
        up, used = int(np.argmax(slope)), np.flatnonzero(x > 0)
        down = int(used[np.argmin(slope[used])])
        bend = gram[up, up] + gram[down, down] - 2 * gram[up, down]
        if slope[up] - slope[down] < 1e-9 or bend <= 0:
            break
        step = min(x[down], (slope[up] - slope[down]) / bend)
        x[up] += step
        x[down] -= step
        slope -= step * (gram[up] - gram[down])
    return x


def fit_hinge(pairs: DataFrame, l2: float = 0.01, gap: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float, float]:
    """Weights w, their objective and a lower bound: l2 / 2 |w|^2 plus the mean of max(0, 1 - w.(p - n)) over all pairs.

    A bundle method: each round adds up loss and subgradient at the current weights over all pairs; they make a plane below the mean loss.
    The next weights are the least of the planes' maximum with the penalty. The dual of this small problem bounds the objective from below,
    so the fit stops when the best weights are proved to be within `gap` of the least objective.
    """
    first = pairs.select(F.size("p").alias("w")).first()
    if first is None:
        return np.zeros(0), 0.0, 0.0
    width = first.w
    w, best, least = np.zeros(width), (np.inf, np.zeros(width)), -np.inf
    planes, offsets, x = np.zeros((0, width)), np.zeros(0), np.zeros(0)
    packed = _packed(pairs, lambda batch: _vectors(batch, "p", width) - _vectors(batch, "n", width), "pair-differences")
    for _ in range(rounds):
        now = w

        def sums(d: np.ndarray) -> np.ndarray:
            slack = 1 - d @ now
            short = slack > 0
            return np.r_[-d[short].sum(axis=0), slack[short].sum(), len(d)]

        total = _summed(packed, np.float64, width, width + 2, sums)
        slope, loss = total[:width] / total[-1], total[width] / total[-1]
        objective = loss + l2 / 2 * now @ now
        best = min(best, (objective, now), key=lambda t: t[0])
        planes, offsets = np.vstack([planes, slope]), np.r_[offsets, loss - slope @ now]
        x = _simplex_qp(planes, offsets, l2, np.r_[x, 0.0] if len(x) else np.ones(1))
        mixed = planes.T @ x
        w, least = -mixed / l2, max(least, offsets @ x - mixed @ mixed / (2 * l2))
        if best[0] - least <= gap:
            break
    return best[1], float(best[0]), float(least)
