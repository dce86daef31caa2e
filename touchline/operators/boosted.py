"""Gradient-boosted trees for a yes-or-no target, fitted on counted cells.

Trees see a row only through the bins of its features, and all rows of a bin in each feature and of one label (a cell) have the same margin in
every round. So rows are read once: a cell's rows are counted, all of them and those that each round draws. The rounds then work on the
cells alone, of which there are as many as bins allow, whatever the number of rows.

The rules are those of Spark's ``GBTClassifier``: its candidate thresholds, its draw of 80 % of the rows in each round (the same rows), variance
as impurity, the first split of greatest gain, log loss, a first tree of weight one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, SAMPLE_RATE = 32, 0.8
#: cells that a table of probabilities holds at most; rows that thresholds are taken from
CELLS, THRESHOLD_ROWS = 1 << 17, 10_000


def known(features: Sequence[str]) -> Column:
    """Rows that have a number in each feature; others are neither fitted on nor scored."""
    out = F.lit(True)
    for f in features:
        value = F.col(f).cast("double")
        out = out & value.isNotNull() & ~F.isnan(value)
    return out


def thresholds(values: np.ndarray, expected: float | None = None, bins: int = BINS) -> np.ndarray:
    """Candidate thresholds of a feature: between all values where they are few, else near equal shares of the rows. Rows of a sample that
    were ``expected`` beyond those with a value other than zero count as zeros, as in Spark."""
    expected = float(len(values)) if expected is None else expected
    distinct, counts = np.unique(values[values != 0], return_counts=True)
    if not len(distinct):
        return np.empty(0)
    if (zeros := expected - counts.sum()) > 2.0**-52 * counts.sum() * 100:
        at = int(np.searchsorted(distinct, 0))
        distinct, counts = np.insert(distinct, at, 0), np.insert(counts.astype(float), at, zeros)
    if len(distinct) <= bins:
        return (distinct[:-1] + distinct[1:]) / 2
    stride, upto = expected / bins, np.cumsum(counts)
    out, target = [], stride
    for k in range(1, len(distinct)):
        if abs(upto[k - 1] - target) < abs(upto[k] - target):
            out.append((distinct[k - 1] + distinct[k]) / 2)
            target += stride
    return np.array(out)


def _sampled(rows: DataFrame, count: int, seed: int) -> DataFrame:
    """The rows that Spark's trees take their thresholds from."""
    if count <= THRESHOLD_ROWS:
        return rows
    spark = rows.sparkSession
    draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    some = rows._jdf.toJavaRDD().sample(False, THRESHOLD_ROWS / count, draw)
    return DataFrame(spark._jsparkSession.createDataFrame(some, rows._jdf.schema()), spark)


def with_bins(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """Columns ``__bin0`` and on: how many of a feature's thresholds lie below its value."""
    used = [k for k, c in enumerate(cuts) if len(c)]
    out = df.withColumns({f"__x{k}": F.lit(0.0) - F.col(features[k]).cast("double") for k in used})
    if used:
        # a bucket has its lower bound, a bin its upper one, so values change their sign
        splits = [[-np.inf, *(0.0 - cuts[k][::-1]).tolist(), np.inf] for k in used]
        out = Bucketizer(splitsArray=splits, inputCols=[f"__x{k}" for k in used], outputCols=[f"__b{k}" for k in used]).transform(out)
    bins = {f"__bin{k}": F.lit(len(c)) - F.col(f"__b{k}").cast("int") if len(c) else F.lit(0) for k, c in enumerate(cuts)}
    return out.withColumns(bins).drop(*[f"__{x}{k}" for k in used for x in "xb"])


def _impurity(n, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 0, (q - s * s / n) / n, 0.0)


def _tree(bins: np.ndarray, sizes: Sequence[int], weight: np.ndarray, goal: np.ndarray, grid: np.ndarray, depth: int) -> np.ndarray:
    """What a regression tree on the cells foretells for each place of the grid of all bins."""
    out = np.empty(len(grid))
    sums = (weight, weight * goal, weight * goal * goal)
    nodes = [(np.flatnonzero(weight), np.arange(len(grid)), 0)]
    while nodes:
        here, places, level = nodes.pop()
        n, s, q = (float(x[here].sum()) for x in sums)
        out[places] = s / n if n else 0.0
        if level == depth or (level and abs(_impurity(n, s, q)) < 2.0**-52):
            continue
        best, chosen = 0.0, None
        for f, size in enumerate(sizes):
            if size == 1:
                continue
            left = [np.cumsum(np.bincount(bins[here, f], x[here], size))[:-1] for x in sums]
            right = [x - y for x, y in zip((n, s, q), left, strict=True)]
            share = left[0] / max(n, 1)
            gain = _impurity(n, s, q) - share * _impurity(*left) - (1 - share) * _impurity(*right)
            gain[(left[0] < 1) | (right[0] < 1)] = -np.inf
            at = int(gain.argmax())
            if gain[at] > best:
                best, chosen = gain[at], (f, at)
        if chosen:
            f, at = chosen
            below, low = bins[here, f] <= at, grid[places, f] <= at
            nodes += [(here[below], places[low], level + 1), (here[~below], places[~low], level + 1)]
    return out


@dataclass
class BoostedTrees:
    """Thresholds of each feature, and the probability at every place of the grid of their bins, the last feature's bins side by side."""

    features: list[str]
    cuts: list[np.ndarray]
    probability: np.ndarray

    def score(self, df: DataFrame, output: str) -> DataFrame:
        rows, place = with_bins(df.where(known(self.features)), self.features, self.cuts), F.lit(0)
        for k, c in enumerate(self.cuts):
            place = place * (len(c) + 1) + F.col(f"__bin{k}")
        # a literal of so many numbers is folded from one text; a list of literals takes seconds to plan
        table = F.split(F.lit(",".join(map(repr, self.probability.tolist()))), ",").cast("array<double>")
        return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.get(table, place).alias(output))


def fit(rows: DataFrame, features: Sequence[str], label: str, rounds: int, depth: int, step: float, seed: int) -> BoostedTrees | None:
    """Trees on the ``rows`` that have all features; none where the grid of bins has more than ``CELLS`` places."""
    rows = rows.select(label, *features).where(known(features))
    count = rows.count()
    if not count:
        raise ValueError("no row to fit on")
    sample = np.array([r[1:] for r in _sampled(rows, count, seed).collect()], np.float64).reshape(-1, len(features))
    cuts = [thresholds(column, min(1, THRESHOLD_ROWS / count) * count, min(BINS, count)) for column in sample.T]
    sizes = [len(c) + 1 for c in cuts]
    if np.prod(sizes, dtype=float) > CELLS:
        return None
    names = [f"__bin{k}" for k in range(len(features))]
    # a round's draw is that of Spark's own bagging: one number a row from a generator of the partition
    draws = {f"__d{m}": (F.rand(seed + m + 1) < SAMPLE_RATE).cast("int") for m in range(rounds)}
    drawn = with_bins(rows.withColumns(draws), features, cuts)
    cells = drawn.groupBy(label, *names).agg(*[F.sum(d).alias(d) for d in draws]).collect()
    if any(r[0] not in (0.0, 1.0) for r in cells):
        raise ValueError("labels must be 0 or 1")
    goal = np.array([2 * r[0] - 1 for r in cells])
    bins = np.array([r[1 : 1 + len(names)] for r in cells], np.int64).reshape(len(cells), len(names))
    weight = np.array([r[1 + len(names) :] for r in cells], np.float64)
    grid = np.stack(np.unravel_index(np.arange(int(np.prod(sizes))), sizes), axis=1)
    own = np.ravel_multi_index(bins.T, sizes)
    margin = _tree(bins, sizes, weight[:, 0], goal, grid, depth)
    for m in range(1, rounds):
        rest = 4 * goal / (1 + np.exp(2 * goal * margin[own]))
        margin += step * _tree(bins, sizes, weight[:, m], rest, grid, depth)
    return BoostedTrees(list(features), cuts, 1 - 1 / (1 + np.exp(2 * margin)))
