"""Logistic models fitted side by side by Newton's method: one scan a step for all of them.

The models of one call share their input rows and a raw basis: numbers as they are (less a common centre), flags for missing values, flags for the
levels of categories. Filling, scaling and one-hot encoding of each model is a small matrix on that basis, so what a step needs of the rows
are sums over the basis: ``sum p x`` for the gradients and ``sum p (1 - p) x x'`` for the Hessians, by generated code over a small basis and by
products of matrices over a wide one. The input is staged once with the needed columns; constants take one scan of it, each step another.

The objective is the sum of losses plus ``|coefficients|^2 / (2 c)`` without the intercept, features scaled by the population deviation.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.quantiles import medians
from touchline.plans.staging import written

MAX_STEPS = 40
SMALL_STEP = 1e-7
MOST_SCALARS = 60


@dataclass
class FeatureContract:
    """What a model needs to score: column lists and the model's name. Stored next to the coefficients."""

    model_type: str
    numeric: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    rows: int = 0

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.binary, *self.categorical]


@dataclass
class FittedModel:
    """Coefficients with the constants of their inputs; scoring is one column expression."""

    contract: FeatureContract
    names: list[str]
    weights: list[float]
    intercept: float
    numbers: dict[str, list[float]]  # fill, mean, deviation
    flags: dict[str, float]  # fill
    fills: dict[str, str | None]
    levels: dict[str, list[str]]

    @property
    def linear(self) -> SimpleNamespace:
        return SimpleNamespace(coefficients=np.array(self.weights), intercept=self.intercept)

    def margin(self) -> Column:
        """Log odds. A level that was not there at the fit adds nothing."""
        out, weights = F.lit(float(self.intercept)), iter(self.weights)
        for n in self.contract.numeric:
            fill, mean, spread = self.numbers[n]
            out = out + (F.coalesce(F.col(n).cast("double"), F.lit(fill)) - mean) / spread * next(weights)
        for n in self.contract.binary:
            out = out + F.coalesce(F.col(n).cast("double"), F.lit(self.flags[n])) * next(weights)
        for n in self.contract.categorical:
            values = [v for level in self.levels[n] for v in (F.lit(level), F.lit(float(next(weights))))]
            if values:
                level = F.coalesce(F.col(n).cast("string"), F.lit(self.fills[n]))
                out = out + F.coalesce(F.element_at(F.create_map(*values), level), F.lit(0.0))
        return out

    def score(self, df: DataFrame, output: str = "cxg_prediction") -> DataFrame:
        """Add the probability column; all other columns stay as they are."""
        missing = sorted(set(self.contract.columns) - set(df.columns))
        if missing:
            raise ValueError(f"missing feature columns: {missing}")
        return df.withColumn(output, probability(self.margin()))

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """Feature, coefficient and absolute value: one row per model input."""
        return spark.createDataFrame([(n, v, abs(v)) for n, v in zip(self.names, self.weights, strict=True)], "feature string, coefficient double, abs_coefficient double")

    def save(self, path: str) -> None:
        SparkSession.getActiveSession().createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str) -> FittedModel:
        stored = json.loads(SparkSession.getActiveSession().read.text(path).first()[0])
        return FittedModel(**{**stored, "contract": FeatureContract(**stored["contract"])})


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


@dataclass
class ModelSpec:
    """One of the models of a call. ``where`` picks its rows; ``skip_empty`` leaves out features without any value in them."""

    contract: FeatureContract
    c: float = 1.0
    scale: bool = True
    where: Column | None = None
    skip_empty: bool = False


def _moments(rows: int, known: int, mean: float, spread: float, fill: float) -> tuple[float, float]:
    """Mean and population deviation after the missing values take ``fill``; a constant column is left unscaled."""
    missing = rows - known
    whole = (known * mean + missing * fill) / rows
    square = (known * (spread * spread + (mean - whole) ** 2) + missing * (fill - whole) ** 2) / rows
    return whole, square**0.5 or 1.0


class _Basis:
    """Columns that all models of a call are combinations of; position 0 is the intercept."""

    def __init__(self) -> None:
        self.places: dict[tuple, int] = {("one",): 0}
        self.columns: list[Column] = []

    def add(self, key: tuple, column: Column) -> None:
        if key not in self.places:
            self.places[key] = len(self.places)
            # numbers of flags' columns may be any; what is missing, and the levels, are 0 or 1
            self.columns.append(column.cast("double" if key[0] in ("x", "b") else "byte"))


@dataclass
class _Problem:
    spec: ModelSpec
    member: Column
    design: np.ndarray
    penalty: np.ndarray
    model: FittedModel
    at: np.ndarray
    step: np.ndarray | None = None
    before: np.ndarray | None = None
    loss: float = np.inf
    done: bool = False


def _stage(df: DataFrame, specs: Sequence[ModelSpec], target: str) -> DataFrame:
    numbers = dict.fromkeys(n for s in specs for n in [*s.contract.numeric, *s.contract.binary])
    levels = dict.fromkeys(n for s in specs for n in s.contract.categorical)
    rows = df.select(
        F.col(target).cast("double").alias("__y"), *[F.col(n).cast("double").alias(f"__n_{n}") for n in numbers],
        *[F.col(n).cast("string").alias(f"__c_{n}") for n in levels],
        *[(F.lit(True) if s.where is None else F.coalesce(s.where, F.lit(False))).alias(f"__in_{k}") for k, s in enumerate(specs)],
    ).where(F.col("__y").isNotNull())
    # each step reads all rows: deal them evenly once, whatever partitions the input came in
    return written(rows.repartition(df.sparkSession.sparkContext.defaultParallelism))


def _problems(rows: DataFrame, specs: Sequence[ModelSpec]) -> tuple[_Basis, list[_Problem]]:
    aggs, asked = [], set()

    def ask(name: str, column: Column) -> None:
        if name not in asked:
            asked.add(name)
            aggs.append(column.alias(name))

    for k, s in enumerate(specs):
        member = F.col(f"__in_{k}")
        ask(f"rows {k}", F.count(F.when(member, 1)))
        for n in s.contract.numeric:
            x = F.when(member, F.col(f"__n_{n}"))
            ask(f"known {k} {n}", F.count(x))
            ask(f"mean {k} {n}", F.avg(x))
            ask(f"spread {k} {n}", F.stddev_pop(x))
        for n in s.contract.binary:
            ask(f"known {k} {n}", F.count(F.when(member, F.col(f"__n_{n}"))))
            ask(f"mode {k} {n}", F.mode(F.when(member, F.col(f"__n_{n}")), deterministic=True))
        for n in s.contract.categorical:
            ask(f"known {k} {n}", F.count(F.when(member, F.col(f"__c_{n}"))))
            ask(f"mode {k} {n}", F.mode(F.when(member, F.col(f"__c_{n}")), deterministic=True))
            ask(f"levels {k} {n}", F.collect_set(F.when(member, F.col(f"__c_{n}"))))
    known = rows.agg(*aggs).first().asDict()
    basis = _Basis()
    problems = []
    centres: dict[str, float] = {}
    for k, s in enumerate(specs):
        total, contract = known[f"rows {k}"], s.contract
        if not total:
            raise ValueError(f"no rows to fit {contract.model_type}")
        if s.skip_empty:
            for name in ("numeric", "binary", "categorical"):
                setattr(contract, name, [n for n in getattr(contract, name) if known[f"known {k} {n}"]])
        if not contract.columns:
            raise ValueError("no usable feature columns")
        gaps = [n for n in contract.numeric if 0 < known[f"known {k} {n}"] < total]
        mids = medians(rows.where(F.col(f"__in_{k}")), [f"__n_{n}" for n in gaps]).first().asDict() if gaps else {}
        inputs: list[dict[tuple, float]] = [{("one",): 1.0}]
        numbers, flags, fills, levels, names = {}, {}, {}, {}, []
        for n in contract.numeric:
            x, count = F.col(f"__n_{n}"), known[f"known {k} {n}"]
            fill = float(mids.get(f"__n_{n}", 0.0))
            mean, spread = _moments(total, count, known[f"mean {k} {n}"] or 0.0, known[f"spread {k} {n}"] or 0.0, fill)
            if not s.scale:
                mean, spread = 0.0, 1.0
            centre = centres.setdefault(n, known[f"mean {k} {n}"] or 0.0)
            basis.add(("x", n), F.coalesce(x - F.lit(centre), F.lit(0.0)))
            use = {("x", n): 1 / spread, ("one",): (centre - mean) / spread}
            if count < total:
                basis.add(("gap", n), x.isNull())
                use[("gap", n)] = (fill - centre) / spread
            numbers[n] = [fill, mean, spread]
            inputs.append(use)
            names.append(n)
        for n in contract.binary:
            x, fill = F.col(f"__n_{n}"), float(known[f"mode {k} {n}"] or 0.0)
            basis.add(("b", n), F.coalesce(x, F.lit(0.0)))
            use = {("b", n): 1.0}
            if known[f"known {k} {n}"] < total:
                basis.add(("b gap", n), x.isNull())
                use[("b gap", n)] = fill
            flags[n] = fill
            inputs.append(use)
            names.append(n)
        for n in contract.categorical:
            x = F.col(f"__c_{n}")
            fills[n], levels[n] = known[f"mode {k} {n}"], sorted(known[f"levels {k} {n}"])
            for level in levels[n]:
                basis.add(("level", n, level), F.coalesce(x == level, F.lit(False)))
                use = {("level", n, level): 1.0}
                if level == fills[n] and known[f"known {k} {n}"] < total:
                    basis.add(("c gap", n), x.isNull())
                    use[("c gap", n)] = 1.0
                inputs.append(use)
                names.append(f"{n}_{level}")
        contract.rows = int(total)
        model = FittedModel(contract, names, [0.0] * len(names), 0.0, numbers, flags, fills, levels)
        penalty = np.full(len(inputs), 1.0 / s.c)
        penalty[0] = 0.0
        problems.append((s, F.col(f"__in_{k}"), inputs, penalty, model))
    out = []
    for s, member, inputs, penalty, model in problems:
        design = np.zeros((len(basis.places), len(inputs)))
        for j, use in enumerate(inputs):
            for key, value in use.items():
                design[basis.places[key], j] = value
        out.append(_Problem(s, member, design, penalty, model, np.zeros(len(inputs))))
    return basis, out


def _unpacked(sums: np.ndarray, weight: float, size: int) -> np.ndarray:
    """``sum w x x'`` with the intercept first, from the sums of a second-degree expansion: for each i its own value, then its products with 0 to i."""
    out = np.zeros((size + 1, size + 1))
    out[0, 0] = weight
    at = 0
    for i in range(1, size + 1):
        out[0, i] = out[i, 0] = sums[at]
        out[i, 1 : i + 1] = out[1 : i + 1, i] = sums[at + 1 : at + 1 + i]
        at += 1 + i
    return out


class _ScalarSums:
    """Sums over a small basis, a column each: all of it is generated code."""

    def __init__(self, flat: DataFrame, names: list[str], models: int) -> None:
        self._rows, self._names = flat, names
        self._members = [F.col(f"__in_{k}") for k in range(models)]
        self._products = [p for i, n in enumerate(names) for p in ((n,), *[(names[j], n) for j in range(i + 1)])]

    def _margin(self, raw: list[float]) -> Column:
        # the coefficients stand in an array, so that every step has the same code
        terms = F.zip_with(F.array(*[F.col(n) for n in self._names]), F.array(*[F.lit(v) for v in raw[1:]]), lambda x, v: x * v)
        return F.aggregate(terms, F.element_at(F.array(F.lit(raw[0])), 1), lambda s, t: s + t)

    def _first(self, weight: Column, name: str) -> list[Column]:
        return [F.sum(weight * F.col(n)).alias(f"{name}_{j}") for j, n in enumerate(self._names)]

    def _second(self, weight: Column, name: str) -> list[Column]:
        out = []
        for j, factors in enumerate(self._products):
            value = weight
            for f in factors:
                value = value * F.col(f)
            out.append(F.sum(value).alias(f"{name}_{j}"))
        return out

    def begin(self) -> list[tuple[float, np.ndarray]]:
        """Rows of each model and its sums of ``y x``."""
        aggs = []
        for k, member in enumerate(self._members):
            one = F.when(member, 1.0).otherwise(0.0)
            aggs += [F.sum(one).alias(f"n{k}"), F.sum(one * F.col("__y")).alias(f"y{k}"), *self._first(one * F.col("__y"), f"t{k}")]
        hits = self._rows.agg(*aggs).first()
        return [(hits[f"n{k}"], np.array([hits[f"y{k}"], *[hits[f"t{k}_{j}"] for j in range(len(self._names))]])) for k in range(len(self._members))]

    def step(self, raw: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """Loss, ``sum p x`` and ``sum p (1 - p) x x'`` of each model, whose coefficients on the basis are given."""
        step = self._rows.withColumns({f"__m{k}": self._margin(v.tolist()) for k, v in raw.items()})
        step = step.withColumns({f"__p{k}": F.when(self._members[k], probability(F.col(f"__m{k}"))).otherwise(0.0) for k in raw})
        step = step.withColumns({f"__w{k}": F.col(f"__p{k}") * (1 - F.col(f"__p{k}")) for k in raw})
        aggs = []
        for k in raw:
            m, chance, weight = F.col(f"__m{k}"), F.col(f"__p{k}"), F.col(f"__w{k}")
            loss = F.log1p(F.exp(-F.abs(m))) + F.greatest(m, F.lit(0.0)) - F.col("__y") * m
            aggs += [F.sum(F.when(self._members[k], loss)).alias(f"l{k}"), F.sum(chance).alias(f"p{k}"), F.sum(weight).alias(f"q{k}"), *self._first(chance, f"g{k}"), *self._second(weight, f"w{k}")]
        found, size = step.agg(*aggs).first(), len(self._names)
        return {
            k: (
                found[f"l{k}"], np.array([found[f"p{k}"], *[found[f"g{k}_{j}"] for j in range(size)]]),
                _unpacked(np.array([found[f"w{k}_{j}"] for j in range(len(self._products))]), found[f"q{k}"], size),
            )
            for k in raw
        }


class _MatrixSums:
    """Sums over a wide basis: each task multiplies matrices of its rows and hands on one row of sums for each model. What the tasks found is added
    up by place, so the driver gets each sum once."""

    def __init__(self, flat: DataFrame, names: list[str], models: int) -> None:
        self._rows, self._width = flat, len(names)
        self._members = [f"__in_{k}" for k in range(models)]

    def _added(self, work) -> dict[int, np.ndarray]:
        found = self._rows.mapInArrow(work, "k int, s array<double>").select("k", F.posexplode("s").alias("at", "v")).groupBy("k", "at").agg(F.sum("v").alias("v"))
        out: dict[int, list] = {}
        for r in found.orderBy("k", "at").toLocalIterator():
            out.setdefault(r["k"], []).append(r["v"])
        return {k: np.array(v) for k, v in out.items()}

    def _task(self, models: Sequence[int], one):
        """The work of a task: ``one(k, x, y)`` are the sums of a model's rows, added up over batches. ``x`` begins with the intercept."""
        members, width = self._members, self._width

        def work(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                y = columns["__y"].to_numpy(zero_copy_only=False)
                x = np.ones((len(y), width + 1), order="F")
                for j in range(width):
                    x[:, j + 1] = columns[f"__r{j}"].to_numpy(zero_copy_only=False)
                for k in models:
                    member = columns[members[k]].to_numpy(zero_copy_only=False).astype(bool)
                    found = one(k, *((x, y) if member.all() else (x[member], y[member])))
                    sums[k] = sums[k] + found if k in sums else found
            for k, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["k", "s"])

        return work

    def begin(self) -> list[tuple[float, np.ndarray]]:
        """Rows of each model and its sums of ``y x``."""
        found = self._added(self._task(range(len(self._members)), lambda k, x, y: np.concatenate(([len(y)], y @ x))))
        return [(float(found[k][0]), found[k][1:]) for k in range(len(self._members))]

    def step(self, raw: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
        """Loss, ``sum p x`` and ``sum p (1 - p) x x'`` of each model, whose coefficients on the basis are given."""
        def one(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            m = x @ raw[k]
            small = np.exp(-np.abs(m))
            p = np.where(m >= 0, 1.0, small) / (1 + small)
            loss = (np.log1p(small) + np.maximum(m, 0) - y * m).sum()
            return np.concatenate(([loss], p @ x, (x.T @ (x * (p * (1 - p))[:, None])).ravel()))

        side = self._width + 1
        return {k: (float(v[0]), v[1 : side + 1], v[side + 1 :].reshape(side, side)) for k, v in self._added(self._task(list(raw), one)).items()}


def fit_models(df: DataFrame, specs: Sequence[ModelSpec], target: str = "is_goal") -> list[FittedModel]:
    """Fit all ``specs`` on ``df``; rows without a target are left out."""
    rows = _stage(df, specs, target)
    basis, problems = _problems(rows, specs)
    size = len(basis.columns)
    names = [f"__r{j}" for j in range(size)]
    flat = rows.select("__y", *[F.col(f"__in_{k}") for k in range(len(specs))], *[c.alias(n) for c, n in zip(basis.columns, names, strict=True)])
    scalar = len(problems) * (size + 1) * (size + 2) // 2 <= MOST_SCALARS
    # each step reads all of a wide basis, so its flags are compared with their levels once
    summed = _ScalarSums(flat, names, len(problems)) if scalar else _MatrixSums(written(flat), names, len(problems))
    goals = []
    for p, (count, hits) in zip(problems, summed.begin(), strict=True):
        goals.append(hits)
        # begin at the share of goals, which is where most of the first steps go
        share = min(max(hits[0] / count, 1e-6), 1 - 1e-6)
        p.at[0] = np.log(share / (1 - share))
    for _ in range(MAX_STEPS):
        open_ = [(k, p) for k, p in enumerate(problems) if not p.done]
        if not open_:
            break
        found = summed.step({k: p.design @ p.at for k, p in open_})
        for k, p in open_:
            lost, expected, second = found[k]
            loss = lost + 0.5 * float(p.penalty @ p.at**2)
            if loss > p.loss * (1 + 1e-12) and p.step is not None and np.abs(p.step).max() > SMALL_STEP:
                # too far: half of the last step from where it began
                p.step = p.step / 2
                p.at = p.before + p.step
                continue
            gradient = p.design.T @ (expected - goals[k]) + p.penalty * p.at
            curve = p.design.T @ second @ p.design + np.diag(p.penalty)
            move = -np.linalg.lstsq(curve, gradient, rcond=None)[0]
            p.before, p.step, p.loss = p.at, move, loss
            p.at = p.at + move
            # steps shrink quadratically, so what is left after a small one is below rounding
            p.done = bool(np.abs(move).max() < SMALL_STEP)
    for p in problems:
        p.model.intercept, p.model.weights = float(p.at[0]), [float(v) for v in p.at[1:]]
    return [p.model for p in problems]

