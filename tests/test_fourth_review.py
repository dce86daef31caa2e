"""Steps that moved too much, or stood still, on larger tables."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from touchline.catalog import metrics as CM
from touchline.catalog import models as CX
from touchline.catalog import priors as CP
from touchline.operators import clusters as CL
from touchline.operators import isotonic as I
from touchline.operators import metrics as M
from touchline.operators import newton as NW
from touchline.sources import projections as P


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("seed", [42, -7])
def test_draws_are_those_of_the_column(spark, seed):
    groups = [0, 1, 5, 1499, 2_147_483_646]
    df = spark.createDataFrame([(g,) for g in groups], "g long").withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(40))))
    want = {(r.g, r.r): r.w for r in df.select("g", "r", M.poisson_weight(F.col("g"), F.col("r"), F.lit(seed)).alias("w")).collect()}
    got = M._poisson_draws(np.array(groups), 40, seed)
    assert {(g, r + 1): int(got[i, r]) for i, g in enumerate(groups) for r in range(40)} == want


def test_replicates_rank_one_score_of_many_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), None if s == 7 else float(s), bool(y)) for g, s, y in zip(rng.integers(0, 300, 900), rng.integers(0, 8, 900), rng.random(900) < 0.4, strict=True)]
    df = spark.createDataFrame([*rows, (1, 2.0, None)], "m long, s double, y boolean").repartition(5)
    aucs = M._replicate_aucs(df, "m", "s", "y", 6, 42)
    assert "Generate" not in plan(aucs)
    w = M._poisson_draws(np.arange(300), 6, 42)
    for r in aucs.collect():
        weights = w[[g for g, _, _ in rows], r.replicate - 1]
        s, y = np.array([-1.0 if s is None else s for _, s, _ in rows]), np.array([y for _, _, y in rows])
        pos, neg = {v: weights[(s == v) & y].sum() for v in set(s)}, {v: weights[(s == v) & ~y].sum() for v in set(s)}
        credit = sum(pos[a] * neg[b] * (1 if b < a else 0.5 if a == b else 0) for a in pos for b in neg)
        assert r.auc == pytest.approx(credit / (sum(pos.values()) * sum(neg.values())))


def test_rows_of_one_score_do_not_stand_in_one_window(spark):
    df = spark.range(4000).select("id", (F.col("id") % 3 / 4).alias("x"), (F.col("id") % 5 == 0).cast("double").alias("y"))
    odd = df.unionByName(spark.createDataFrame([(-1, float("nan"), 0.0), (-2, None, 1.0), (-3, 0.6, 0.0)], "id long, x double, y double"))
    fitted = I.fit_isotonic(df, "x", F.col("y")).transform(odd, "x", "fit")
    assert "Window" not in plan(fitted)
    got = {r.id: r.fit for r in fitted.where("id < 3").collect()}
    assert got[-1] is None and got[-2] is None and got[-3] is not None and fitted.count() == 4003


def test_sides_are_built_once(spark):
    form, _ = CP._holdout_form(spark, SMALL)
    assert "Join" not in plan(form) and form.count() > 0


def test_clusters_by_batches(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 2.0), (-1.0, -2.0), (9.0, 9.0)], "z0 double, z1 double").repartition(3)
    assert tuple(CL._farthest(rows.where("z0 < 5"), [[0.0, 0.0]])) == (5.0, 1.0, 2.0)
    sums = CL._sums(rows, [[0.0, 0.0], [0.0, 0.0], [8.0, 8.0]])
    assert {j: (r["n"], r["d"], r["z0"], r["z1"]) for j, r in sums.items()} == {0: (4.0, 11.0, 1.0, 0.0), 2: (1.0, 2.0, 9.0, 9.0)}


def test_matrix_sums(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 3)), rng.integers(0, 2, 300).astype(float)
    inside = rng.random(300) < 0.7
    rows = [(float(b), True, bool(i), *map(float, a)) for a, b, i in zip(x, y, inside, strict=True)]
    df = spark.createDataFrame(rows, "__y double, __in_0 boolean, __in_1 boolean, __r0 double, __r1 double, __r2 double").repartition(4)
    raw = {0: np.array([0.1, 1.0, -2.0, 0.5]), 1: np.array([0.0, 0.3, 0.2, 0.1])}
    for kind in (NW._ScalarSums, NW._MatrixSums):
        sums = kind(df, ["__r0", "__r1", "__r2"], 2)
        begun, step = sums.begin(), sums.step(raw)
        for k, member in enumerate((np.ones(300, bool), inside)):
            a, b = np.column_stack([np.ones(member.sum()), x[member]]), y[member]
            m = a @ raw[k]
            p = 1 / (1 + np.exp(-m))
            assert begun[k][0] == member.sum() and np.allclose(begun[k][1], b @ a)
            assert np.allclose(step[k][0], (np.log1p(np.exp(m)) - b * m).sum()) and np.allclose(step[k][1], p @ a)
            assert np.allclose(step[k][2], (a * (p * (1 - p))[:, None]).T @ a)


def test_both_models_leave_one_scan(spark):
    assert plan(CM._sliced(spark, SMALL)).count("Location") == 2  # line items and orders


def test_events_move_as_plain_columns(spark):
    text = plan(P.flat_documents(spark, SMALL))
    moved = text[text.index("Exchange\nInput"):].split("Input [")[1].split("]")[0]
    assert int(moved) <= 7


def test_boosted_rows_are_joined_once(spark):
    assert "Join" not in plan(CX.boosted_scores(spark, SMALL))


def test_windows_cover_whole_texts():
    from touchline.llm import pii

    for window, stride in ((pii.WINDOW, pii.STRIDE), (pii.LONG, pii.LONG_STRIDE)):
        for n in (0, 1, window - 1, window, window + 1, 5 * window + 7):
            covered = {k for at in pii.window_starts("x" * n, window, stride) for k in range(at, min(at + window, n))}
            assert covered == set(range(n))
    kinds = pii.window_kinds("x" * 200 + "7" + "x" * 200, [("card", 300, 310)], len(pii.window_starts("x" * 401)))
    assert kinds.tolist() == [
        2 if at < 310 and at + pii.WINDOW > 300 else 1 if at <= 200 < at + pii.WINDOW else 0 for at in pii.window_starts("x" * 401)
    ]


def test_network_reads_text_without_digits():
    from touchline.llm import pii

    tagger = pii.Tagger(seed=3)
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 98, (6, 2 * pii.WINDOW)).astype(np.uint8)
    slow = tagger.scores(ids)[0]
    assert np.allclose(tagger.emissions(ids), slow, atol=1e-4)
    # a network that is sure of "outside" leaves no row open; one that calls every q an email finds it in plain text
    rows, tags, _ = tagger.decode_open(ids)
    every = tagger.decode(ids)[0]
    assert (tags == every[rows]).all() and not np.delete(every, rows, axis=0).any()
    tagger.p["out_b"][0] = 50
    assert len(tagger.decode_open(ids)[0]) == 0
    for k in tagger.p:
        tagger.p[k] = np.zeros_like(tagger.p[k])
    q = pii.char_ids("q")[0]
    tagger.p["emb"][q, 0], tagger.p["fx"][0, 0], tagger.p["fx"][0, 60], tagger.p["fx"][0, 40], tagger.p["fb"][20:40] = 1, 50, 50, 50, -50
    tagger.p["out"][0, 2], tagger.p["out_b"][0] = 80, 20
    text = "word " * 200 + "qqqqqqqqqqqq" + " word" * 200
    (base, every), = pii.Finder(tagger)([text])
    assert base == [] and every == [("email", 1000, 1012)]
