"""Isotonic steps against pooling adjacent violators on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import isotonic as I
from touchline.operators.blocks import SplitDecision


def pooled(x, y):
    levels = {}
    for a, b in zip(x, y, strict=True):
        n, s = levels.get(a, (0, 0.0))
        levels[a] = (n + 1, s + b)
    stack = []
    for a in sorted(levels):
        n, s = levels[a]
        stack.append([n, s, [a]])
        while len(stack) > 1 and stack[-2][1] / stack[-2][0] >= stack[-1][1] / stack[-1][0]:
            n, s, xs = stack.pop()
            stack[-1][0] += n
            stack[-1][1] += s
            stack[-1][2] += xs
    return {a: s / n for n, s, xs in stack for a in xs}


@pytest.mark.parametrize(("block", "kind"), [(8, "noise"), (8, "convex"), (512, "noise"), (6, "drop")])
def test_against_pooling(spark, monkeypatch, block, kind):
    monkeypatch.setattr(I, "BLOCK", block)
    rng = np.random.default_rng(block)
    x = rng.integers(0, 60, 400) / 60.0
    y = {"noise": (rng.random(400) < x).astype(float), "convex": x * x, "drop": np.where(x < 0.9, x * x, 0.0)}[kind]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(3)
    want = pooled(x.tolist(), y.tolist())
    policy = SplitDecision(50.0) if block == 6 else I.DEFAULT_POLICY
    model = I.fit_isotonic(df, "x", F.col("y"), policy)
    got = {r["x"]: r["fit"] for r in model.transform(df, "x", "fit", policy).collect()}
    assert got.keys() == want.keys()
    assert np.allclose([got[a] for a in want], list(want.values()), atol=1e-9)


def test_between_outside_and_missing(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.2, 0.0), (0.6, 1.0), (0.8, 1.0), (None, 1.0), (0.3, None)], "x double, y double")
    model = I.fit_isotonic(df, "x", F.col("y"))
    new = spark.createDataFrame([(0.0,), (0.15,), (0.4,), (0.7,), (0.9,), (None,)], "x double").withColumn("value", F.lit("kept"))
    got = {r["x"]: r["p"] for r in model.transform(new, "x", "p").collect()}
    assert got == pytest.approx({0.0: 0.0, 0.15: 0.0, 0.4: 0.5, 0.7: 1.0, 0.9: 1.0, None: None})
    none = I.fit_isotonic(df.limit(0), "x", F.col("y"))
    assert none.transform(new, "x", "p").where("p is null").count() == 6
