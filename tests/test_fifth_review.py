"""Findings of the fourth round on the event part."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from touchline.operators import boosted as B
from touchline.operators import model as MD


def rows(spark, n, parts=4, seed=1):
    draw = np.random.default_rng(seed)
    a, b, c = draw.normal(size=n).round(2), draw.integers(0, 9, n) - 3.0, draw.exponential(size=n)
    y = draw.random(n) < 1 / (1 + np.exp(-(a + 0.4 * b - c * a)))
    given = [(k, bool(y[k]), float(a[k]), float(b[k]), None if k % 97 == 5 else float("nan") if k % 97 == 6 else float(c[k])) for k in range(n)]
    return spark.createDataFrame(given, "id long, y boolean, a double, b double, c double").repartition(parts, "id").sortWithinPartitions("id").localCheckpoint()


def by_spark(df, features, rounds):
    labelled = df.select(F.col("y").cast("double").alias("label"), *features)
    stages = [VectorAssembler(inputCols=features, outputCol="f", handleInvalid="skip"),
              GBTClassifier(featuresCol="f", labelCol="label", maxIter=rounds, maxDepth=5, stepSize=0.05, subsamplingRate=0.8, seed=42)]
    scored = Pipeline(stages=stages).fit(labelled).transform(df).select("id", vector_to_array("probability")[1].alias("p"))
    return {r.id: r.p for r in scored.collect()}


@pytest.mark.parametrize("n", [30, 2_000, 25_000])
def test_trees_on_cells_are_those_on_rows(spark, n):
    df = rows(spark, n)
    model = MD.fit_boosted(df, ["a", "b", "c"], "y", rounds=6)
    assert isinstance(model, B.BoostedTrees)
    found = {r.id: r.boosted for r in MD.score_boosted(model, df).collect()}
    want = by_spark(df, ["a", "b", "c"], 6)
    assert found.keys() == want.keys() and max(abs(found[k] - want[k]) for k in want) < 1e-9


def test_rows_are_read_a_few_times_whatever_the_rounds(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = rows(spark, 1_000)
    counted_rows = df.mapInArrow(counted, df.schema)
    MD.fit_boosted(counted_rows, ["a", "b"], "y", rounds=12)
    assert read.value <= 3 * 1_000


def test_features_without_a_threshold_and_labels_that_are_none(spark):
    df = rows(spark, 300).withColumns({"one": F.lit(1.0), "none": F.lit(0.0)})
    model = MD.fit_boosted(df, ["one", "a", "none"], "y", rounds=3)
    assert [len(c) for c in model.cuts][::2] == [0, 0]
    found = {r.id: r.boosted for r in MD.score_boosted(model, df).collect()}
    want = by_spark(df, ["one", "a", "none"], 3)
    assert len(want) == 300 and max(abs(found[k] - want[k]) for k in want) < 1e-9
    with pytest.raises(ValueError):
        MD.fit_boosted(df.withColumn("y", F.when(F.col("id") > 5, F.col("y"))), ["a"], "y", rounds=2)
    with pytest.raises(ValueError):
        MD.fit_boosted(df.limit(0), ["a"], "y", rounds=2)


def test_many_features_are_fitted_on_rows(spark):
    df = rows(spark, 3_000).withColumn("d", F.rand(3))
    model = MD.fit_boosted(df, ["a", "c", "d", "b"], "y", rounds=2)
    assert not isinstance(model, B.BoostedTrees) and MD.score_boosted(model, df).where("boosted between 0 and 1").count() > 2_900


def test_bins_end_with_their_threshold(spark):
    cuts = [np.array([-1.0, 0.0, 2.5])]
    values = [float("-inf"), -1.0, -0.9, -0.0, 0.0, 1e-9, 2.5, 2.6, float("inf")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    assert [r["__bin0"] for r in B.with_bins(df, ["x"], cuts).orderBy("k").collect()] == [0, 0, 1, 1, 1, 2, 2, 3, 3]
