"""Quality classifier: a Gaussian kernel over document statistics by random Fourier features, ridge scores, isotonic calibration.

Statistics come from the text alone. Each partition sums its part of the normal equations, partial sums are added up in tasks, and the
driver solves one system of fixed size. Scores of labelled documents that the fit has not seen are gathered in ``BINS`` bins at most,
pooled into a monotone curve, and that curve turns scores into probabilities. All labelled rows are used.

Defined cases: a null text is an empty one; a null label is no label; several labels of a document count one by one; without labels the
score is 0.5, with labels of one value only it is that value; repeated documents are scored one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.shared import written
from touchline.llm.text import packed

FEATURES, BANDWIDTH, RIDGE = 256, 3.0, 1e-3
BINS = 4001
LEVEL = 0.01
FOLDS = 5
#: parts in which partial sums meet before the driver adds them up
MEETING = 8
STATISTICS = (
    "log_words", "word_length", "symbols", "capitals", "digits", "marks", "letters", "distinct", "stutter", "same_lines",
    "shouted", "long_words", "line_words", "ends",
)
_CLASS = np.zeros(256, np.uint8)
for _chars, _code in ((b"#*$%&|<>=+~^@\\/{}[]_", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b".,;:!?'\"()-", 4), (b"abcdefghijklmnopqrstuvwxyz", 5)):
    _CLASS[list(_chars)] = _code
_CLASS[128:] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 6


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7)
    chars = max(1, len(raw) - int(kinds[6]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), chars / n, kinds[1] / n, kinds[2] / chars, kinds[3] / chars, kinds[4] / n, kinds[5] / chars,
        len(set(words)) / n**0.9, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1 - len(set(lines)) / len(lines),
        sum(w.isupper() for w in words) / n, sum(len(w) > 20 for w in words) / n,
        float(np.log1p(n / len(lines))), (raw.count(b".") + raw.count(b"!") + raw.count(b"?")) / n,
    ]


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``_row`` without its text, and ``x``, the statistics."""
    rows = packed(docs, text).withColumn("_row", F.col("_row").dropFields(text) if len(docs.columns) > 1 else F.col("_row"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["_row", "x"])

    return rows.mapInArrow(work, T.StructType([rows.schema["_row"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def summed(rows: DataFrame, size: int, part) -> np.ndarray:
    """Sum over all batches of ``part(batch)``, an array of ``size`` doubles: within tasks, then in ``MEETING`` parts, then here."""

    def sums(batches, one):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += one(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def add(batch):
        return sum(np.frombuffer(b, np.float64) for b in batch.column(0).to_pylist())

    partial = rows.mapInArrow(lambda it: sums(it, part), "s binary").repartition(MEETING)
    met = partial.mapInArrow(lambda it: sums(it, add), "s binary").collect()
    return sum((np.frombuffer(r.s, np.float64) for r in met), np.zeros(size))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), len(STATISTICS))


class Kernel:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1)
        self.w = rng.standard_normal((len(mean), FEATURES)) / BANDWIDTH
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def pooled(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic regression: adjacent violators of rising order are pooled to their mean. ``x`` is in order."""
    value, mass, count = [], [], []
    for v, w in zip(y, weight, strict=True):
        value.append(v)
        mass.append(w)
        count.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            v2, w2, c2 = value.pop(), mass.pop(), count.pop()
            value[-1] = (value[-1] * mass[-1] + v2 * w2) / (mass[-1] + w2)
            mass[-1] += w2
            count[-1] += c2
    return np.repeat(value, count)


class QualityModel:
    def __init__(self, kernel: Kernel | None, weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        self.kernel, self.weights, self.x, self.y = kernel, weights, x, y

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.kernel(stats) @ self.weights

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(stats), self.y[0])
        raw = self.raw(stats)
        # where the curve is level, the ridge score still tells documents apart
        return (1 - LEVEL) * np.clip(np.interp(raw, self.x, self.y), 0, 1) + LEVEL * np.clip((raw + 0.5) / 2, 0, 1)


def fit(labelled: DataFrame) -> QualityModel:
    """``labelled``: x, y (0 or 1) and ``calibrates``, which rows the curve is made of."""
    d = len(STATISTICS)
    train = labelled.where(~F.col("calibrates"))

    def moments(batch):
        x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
        return np.concatenate([[len(x), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)])

    total = summed(train.select("x", "y"), 2 + 2 * d, moments)
    n, ones = total[:2]
    if n == 0 or ones in (0, n):
        return QualityModel(None, np.empty(0), np.zeros(1), np.array([0.5 if n == 0 else ones / n]))
    mean = total[2 : 2 + d] / n
    kernel = Kernel(mean, np.sqrt(np.maximum(total[2 + d :] / n - mean**2, 0)))
    size = FEATURES + 1
    balance = (n / (2 * (n - ones)), n / (2 * ones))  # either label weighs the same

    def equations(batch):
        z, y = kernel(_matrix(batch.column(0))), batch.column(1).to_numpy().astype(np.float64)
        w = np.where(y == 1, balance[1], balance[0])
        return np.concatenate([((z * w[:, None]).T @ z).ravel(), z.T @ (w * y)])

    total = summed(train.select("x", "y"), size * size + size, equations)
    weights = np.linalg.solve(total[: size * size].reshape(size, size) + RIDGE * n * np.eye(size) / FEATURES, total[size * size :])
    model = QualityModel(kernel, weights, np.zeros(1), np.zeros(1))

    def bins(batch):
        raw, y = model.raw(_matrix(batch.column(0))), batch.column(1).to_numpy()
        at = np.clip(np.rint((raw + 0.5) * (BINS - 1) / 2), 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, raw, BINS)])

    held = labelled.where(F.col("calibrates"))
    count, hits, raw = summed(held.select("x", "y"), 3 * BINS, bins).reshape(3, BINS)
    if not count.any():
        count, hits, raw = summed(train.select("x", "y"), 3 * BINS, bins).reshape(3, BINS)
    some = count > 0
    x = raw[some] / count[some]
    return QualityModel(kernel, weights, x, pooled(x, hits[some] / count[some], count[some]))


def remainder(key: Column, by: int = FOLDS) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(by)).cast("int")


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """(key, held_out, score, predicted). Labels of documents with remainder 0 are never read; those with remainder 4 make the curve."""
    stats = written(document_statistics(docs, text).select(F.col("_row")[key].alias(key), "x"))
    known = labels.select(F.col(key), F.col(label).cast("double").alias("y")).where("y is not null")
    part = remainder(F.col(key))
    labelled = stats.join(known, key).where(part != 0).select("x", "y", (part == FOLDS - 1).alias("calibrates"))
    model = docs.sparkSession.sparkContext.broadcast(fit(written(labelled)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value(_matrix(batch.column(1))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=[key, "score"])

    scored = stats.select(key, "x").mapInArrow(work, T.StructType([stats.schema[key], T.StructField("score", T.DoubleType())]))
    return scored.select(key, F.coalesce(remainder(F.col(key)) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
