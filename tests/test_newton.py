"""Side-by-side fits against a plain Newton solve on the driver."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.test_jobs import newton
from touchline.catalog.common import located_shots
from touchline.catalog.models import _training
from touchline.operators import model as MD
from touchline.operators import newton as NW


def encoded(pdf, numeric, binary, categorical):
    parts, names = [], []
    for n in numeric:
        x = pdf[n].astype(float).fillna(pdf[n].astype(float).median())
        parts.append((x - x.mean()) / (x.std(ddof=0) or 1.0))
        names.append(n)
    for n in binary:
        x = pdf[n].astype(float)
        parts.append(x.fillna(x.mode()[0]))
        names.append(n)
    for n in categorical:
        x = pdf[n].fillna(pdf[n].mode()[0])
        for level in sorted(x.unique()):
            parts.append((x == level).astype(float))
            names.append(f"{n}_{level}")
    return np.stack(parts, 1), names


@pytest.mark.parametrize("scalars", [0, 10_000])
def test_models_of_one_call(spark, monkeypatch, scalars):
    """Folds with gaps of their own, another contract and another strength in one call, by both kinds of sums."""
    monkeypatch.setattr(NW, "MOST_SCALARS", scalars)
    rows = MD.assign_folds(_training(spark, SMALL), "match_id", 3).withColumns({
        "shot_angle": F.when(F.col("second") % 5 != 0, F.col("shot_angle")), "is_leading": F.when(F.col("second") % 4 != 0, F.col("is_leading")),
        "pressure_state": F.when(F.col("second") % 3 != 0, F.col("pressure_state")),
    })
    numeric, binary, categorical = ["shot_distance", "shot_angle", "minute"], ["is_leading"], ["pressure_state", "score_state"]
    specs = [NW.ModelSpec(NW.FeatureContract("fold", list(numeric), list(binary), list(categorical)), 0.5, where=F.col("fold") != i) for i in range(3)]
    specs.append(NW.ModelSpec(NW.FeatureContract("other", ["shot_distance"], [], ["score_state"]), 2.0))
    models = NW.fit_models(rows, specs)
    pdf = rows.select("fold", "is_goal", *numeric, *binary, *categorical).toPandas()
    for i, m in enumerate(models[:3]):
        own = pdf[pdf.fold != i]
        x, names = encoded(own, numeric, binary, categorical)
        assert m.names == names
        assert np.allclose([*m.weights, m.intercept], newton(x, own.is_goal.to_numpy().astype(float), 0.5), atol=1e-8)
    x, names = encoded(pdf, ["shot_distance"], [], ["score_state"])
    assert np.allclose([*models[3].weights, models[3].intercept], newton(x, pdf.is_goal.to_numpy().astype(float), 2.0), atol=1e-8)


def test_one_scan_a_step(spark, monkeypatch):
    """All folds share the staged input: it is written once and read once for each of few steps."""
    calls = []
    before = NW.written
    monkeypatch.setattr(NW, "written", lambda df: calls.append(1) or before(df))
    rows = MD.assign_folds(located_shots(spark, SMALL), "match_id", 5)
    scored = MD.cross_validate(rows, MD.fit_baseline, 5)
    assert len(calls) == 1 and scored.count() == rows.count()


def test_extreme_inputs(spark):
    rows = spark.createDataFrame([(float(i % 7), 1.0, i % 7 > 3, "a") for i in range(200)], "x double, one double, is_goal boolean, c string")
    model = NW.fit_models(rows, [NW.ModelSpec(NW.FeatureContract("split", ["x", "one"], [], ["c"]), 1000.0)])[0]
    got = model.score(rows, "p").agg(F.max(F.when(~F.col("is_goal"), F.col("p"))), F.min(F.when(F.col("is_goal"), F.col("p")))).first()
    assert got[0] < 0.05 and got[1] > 0.95
    never = NW.fit_models(rows.withColumn("is_goal", F.lit(False)), [NW.ModelSpec(NW.FeatureContract("never", ["x"]))])[0]
    assert never.score(rows, "p").agg(F.max("p")).first()[0] < 0.01
    with pytest.raises(ValueError):
        NW.fit_models(rows.where("false"), [NW.ModelSpec(NW.FeatureContract("none", ["x"]))])
    odd = model.score(spark.createDataFrame([(None, None, "z"), (1.0, None, None)], "x double, one double, c string"), "p")
    assert odd.where("p between 0 and 1").count() == 2


def test_bucket_models_side_by_side_and_by_fold(spark):
    rows = MD.assign_folds(_training(spark, SMALL), "match_id", 3).withColumn("set_piece_category", F.when(F.col("second") % 6 != 0, F.col("set_piece_category")))
    specs = [MD.BucketSpec("piece", ["set_piece_category", "score_state"], 5), MD.BucketSpec("pressure", ["pressure_state"], 10, ["set_piece_category"], 0.3)]
    pdf = rows.select("fold", "is_goal", "statsbomb_xg", "set_piece_category", "score_state", "pressure_state").toPandas()

    def check(table, own, columns, c, least):
        own = own.assign(b=own[columns].fillna("Unknown").agg("|".join, axis=1), y=own.is_goal.astype(float))
        levels = sorted(own.b.unique())
        x = np.c_[own.statsbomb_xg, np.stack([(own.b == v).astype(float) for v in levels], 1)]
        w = newton(x, own.y.to_numpy(), c)
        own = own.assign(p=1 / (1 + np.exp(-(np.c_[x, np.ones(len(x))] @ w))))
        want = {v: (len(g), g.y.sum(), g.p.mean(), w[1 + levels.index(v)]) for v, g in own.groupby("b") if len(g) >= least}
        got = {"|".join(r[c] for c in columns): (r["shots"], r["goals"], r["modeled_prob"], r["bucket_logit"]) for r in table.collect()}
        assert got.keys() == want.keys()
        assert np.allclose([got[v] for v in want], [want[v] for v in want], atol=1e-8)

    tables, metrics = MD.fit_bucket_models(rows, specs)
    check(tables["piece"], pdf, specs[0].columns, 1.0, 5)
    check(tables["pressure"], pdf[pdf.set_piece_category.notna()], specs[1].columns, 0.3, 10)
    assert {r["model"]: r["samples"] for r in metrics.collect()} == {"piece": len(pdf), "pressure": int(pdf.set_piece_category.notna().sum())}
    held, _ = MD.fit_bucket_models(rows, specs, folds=3)
    for i in range(3):
        check(held["piece"].where(F.col("held") == i), pdf[pdf.fold != i], specs[0].columns, 1.0, 5)
    cells = MD.bucket_cells(rows, specs)
    assert cells.agg(F.sum("shots")).first()[0] == len(pdf) + pdf.set_piece_category.notna().sum()
    assert isinstance(pdf, pd.DataFrame)


def test_out_of_fold_priors_are_those_of_the_other_folds(spark):
    from touchline.plans import pipeline as PL

    rows = MD.assign_folds(_training(spark, SMALL), "match_id", 2).withColumns({
        n: F.lit(v) for n, v in {"set_piece_phase": "p", "minute_bucket_label": "0-15", "assist_category": "a", "pass_style": "s", "def_label": "d"}.items()})
    out = PL.enrich_out_of_fold(rows, None, 2)
    assert out.count() == rows.count()
    alone = PL.enrich(rows.where("fold = 0"), None, PL.bucket_priors(rows.where("fold = 1")))
    a, b = (d.where("fold = 0").select("shot_id", F.round("set_piece_logit", 8), F.round("pressure_logit", 8)).toPandas().sort_values("shot_id").to_numpy() for d in (out, alone))
    assert np.allclose(a.astype(float), b.astype(float), atol=1e-7)
