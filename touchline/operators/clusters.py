"""k-means as repeated aggregates: farthest-point start, then Lloyd steps, both without drawing anything at random.

The driver holds the centres, at most ``k`` short rows. A starting step takes the row farthest from the centres so far (ties by the features, the
greatest first); a Lloyd step averages the rows of each centre. In both, tasks hand on a few sums or one row each, found over whole batches at a
time. Assignment is an expression over the centres, so nothing is joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.plans.staging import written

STEPS = 40
STILL = 1e-4


@dataclass
class Clusters:
    """Centres on the scaled features, with the sum of squared distances of the training rows and their count in each cluster."""

    features: list[str]
    means: list[float]
    spreads: list[float]
    centres: list[list[float]]
    sizes: list[int]
    inertia: float

    @property
    def count(self) -> int:
        return len(self.centres)

    def scaled(self) -> list[Column]:
        """Scaled features; a missing value takes the mean."""
        return [F.coalesce((F.col(f).cast("double") - F.lit(m)) / F.lit(s), F.lit(0.0)) for f, m, s in zip(self.features, self.means, self.spreads, strict=True)]

    def assign(self, df: DataFrame, output: str = "style_cluster") -> DataFrame:
        return df.withColumn(output, _nearest(self.scaled(), self.centres)["j"])


def _nearest(row: Sequence[Column], centres: Sequence[Sequence[float]]) -> Column:
    """``(d, j)`` of the nearest centre, the first of equal ones. The centres are data to the generated code, which all steps share."""
    here = F.array(*row)
    square = lambda c: F.aggregate(F.zip_with(here, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.array_min(F.transform(F.lit([[float(v) for v in c] for c in centres]), lambda c, j: F.struct(square(c).alias("d"), j.alias("j"))))


def _distances(batch: pa.RecordBatch, centres: Sequence[Sequence[float]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns of a batch, and of each row the squared distance to the nearest centre and its number, the first of equal ones."""
    columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    squares = np.empty((len(centres), batch.num_rows))
    for j, centre in enumerate(centres):
        squares[j] = sum((x - v) * (x - v) for x, v in zip(columns, centre, strict=True))
    near = squares.argmin(axis=0)
    return columns, squares[near, np.arange(len(near))], near


def _farthest(rows: DataFrame, centres: Sequence[Sequence[float]]):
    """The row farthest from its centre as (d, features), the greatest features among equal ones; None without rows."""
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns, d, _ = _distances(batch, centres)
                top = np.flatnonzero((d == d.max()) | np.isnan(d))
                at = top[np.lexsort([c[top] for c in reversed(columns)])[-1]]
                yield pa.RecordBatch.from_arrays([pa.array([v[at]], pa.float64()) for v in (d, *columns)], names=["d", *names])

    found = rows.mapInArrow(work, ", ".join(f"{n} double" for n in ("d", *names)))
    return found.agg(F.max(F.struct("d", *names)).alias("far")).first()["far"]


def _sums(rows: DataFrame, centres: Sequence[Sequence[float]]) -> dict:
    """Of each centre that has rows: their number ``n``, the sum ``d`` of their squared distances and the sums of their features."""
    names = ["n", "d", *rows.columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centres), len(names)))
        for batch in batches:
            columns, d, near = _distances(batch, centres)
            for i, v in enumerate((np.ones(len(d)), d, *columns)):
                sums[:, i] += np.bincount(near, v, len(centres))
        some = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(v, pa.float64()) for v in sums[some].T]], names=["j", *names])

    found = rows.mapInArrow(work, ", ".join(["j int", *[f"{n} double" for n in names]]))
    return {r["j"]: r for r in found.groupBy("j").agg(*[F.sum(n).alias(n) for n in names]).collect()}


def fit_clusters(df: DataFrame, features: Sequence[str], train: Column, k: int, steps: int = STEPS) -> Clusters:
    """Features are scaled by all rows; centres come from the training rows. Fewer distinct training rows than ``k`` give fewer clusters; none
    gives one cluster around the mean."""
    df = written(df.select(*features, train.alias("__train")))
    stats = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    out = Clusters(list(features), [stats[f"m_{f}"] or 0.0 for f in features], [stats[f"s_{f}"] or 1.0 for f in features], [], [], 0.0)
    names = [f"z{i}" for i in range(len(features))]
    rows = written(df.where("__train").select(*[c.alias(n) for c, n in zip(out.scaled(), names, strict=True)]))
    origin = [[0.0] * len(features)]
    for _ in range(k):
        found = _farthest(rows, out.centres or origin)
        if found is None or (out.centres and found["d"] <= 0):
            break
        out.centres.append([found[n] for n in names])
    if not out.centres:
        out.centres, out.sizes = origin, [0]
        return out
    for _ in range(steps):
        means = {j: [r[n] / r["n"] for n in names] for j, r in _sums(rows, out.centres).items()}
        centres = [means.get(j, c) for j, c in enumerate(out.centres)]
        moved = sum((a - b) ** 2 for new, old in zip(centres, out.centres, strict=True) for a, b in zip(new, old, strict=True))
        out.centres = centres
        if moved <= STILL:
            break
    sums = _sums(rows, out.centres)
    out.sizes = [int(sums[j]["n"]) if j in sums else 0 for j in range(out.count)]
    out.inertia = float(sum(r["d"] for r in sums.values()))
    return out
