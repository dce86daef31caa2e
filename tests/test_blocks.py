"""Cutting hot groups must never change a result: forced small blocks against plain windows and brute force."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tests.conftest import SMALL
from touchline.catalog.common import documents, matches, shots
from touchline.operators import metrics as M
from touchline.operators import priors as R
from touchline.operators.asof import asof_backward
from touchline.operators.blocks import DEFAULT_POLICY, OrderedScan, SplitPolicy, decide, with_blocks
from touchline.operators.joins import salted_join
from touchline.operators.quantiles import exact_quantiles
from touchline.operators.sequences import possession_features, running_score
from touchline.plans.context import shot_context

TINY = [SplitPolicy(16, 4096), SplitPolicy(50, 100_000)]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in group 7, one group null, order ties broken by id."""
    g = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 29 == 0, None).otherwise(F.pmod(F.hash("id"), F.lit(40)))
    return spark.range(3000).select(
        "id", g.cast("int").alias("g"), F.pmod(F.xxhash64("id"), F.lit(300)).alias("t"), (F.col("id") % 5).alias("s"),
        F.pmod(F.hash("id", F.lit(1)), F.lit(10)).cast("long").alias("v"),
    ).cache()


def rows(df):
    return sorted(df.collect(), key=lambda r: r["id"])


@pytest.mark.parametrize("policy", TINY)
def test_scan_equals_plain_windows(skewed, policy):
    hit = F.when(F.col("v") == 3, F.struct("id", "v"))
    got = (
        OrderedScan(skewed, ["g"], ["t", "id"], policy)
        .running_sum("total", F.col("v")).running_sum("own", F.col("v"), ["s"], inclusive=True).row_number("rn")
        .last_seen("last", hit).last_seen("last_s", hit, ["s"], inclusive=False).first_seen("first", F.col("t"), ["s"])
        .previous_rows("r5", "sum", F.col("v"), 5).previous_rows("a35", "avg", F.col("v"), 35)
        .previous_rows("c5", "count", F.col("v"), 5).result()
    )
    w, ws = W.partitionBy("g").orderBy("t", "id"), W.partitionBy("g", "s").orderBy("t", "id")
    upto, before = (W.unboundedPreceding, 0), (W.unboundedPreceding, -1)
    want = skewed.select(
        "*", F.coalesce(F.sum("v").over(w.rowsBetween(*before)), F.lit(0)).alias("total"),
        F.sum("v").over(ws.rowsBetween(*upto)).alias("own"), F.row_number().over(w).cast("long").alias("rn"),
        F.last(hit, True).over(w.rowsBetween(*upto)).alias("last"), F.last(hit, True).over(ws.rowsBetween(*before)).alias("last_s"),
        F.first("t").over(ws.rowsBetween(*upto)).alias("first"), F.sum("v").over(w.rowsBetween(-5, -1)).alias("r5"),
        F.avg("v").over(w.rowsBetween(-35, -1)).alias("a35"), F.count("v").over(w.rowsBetween(-5, -1)).alias("c5"),
    )
    assert rows(got) == rows(want)


def test_blocks_split_the_hot_group_only(skewed):
    width = decide(skewed, ["g"], SplitPolicy(100, 4096)).width
    per_group = {
        r["g"]: r["n"] for r in with_blocks(skewed, ["g"], ["t", "id"], width).groupBy("g").agg(F.countDistinct("__block").alias("n")).collect()
    }
    assert per_group[7] > 5
    assert per_group[1] == 1
    sizes = with_blocks(skewed, ["g"], ["t", "id"], width).where("g = 7").groupBy("__block").count()
    assert sizes.agg(F.max("count")).first()[0] < 400


def test_threshold_bounds_the_number_of_hot_groups(skewed):
    assert decide(skewed, ["g"], DEFAULT_POLICY).width is None
    assert decide(skewed, ["g"], SplitPolicy(1, 10)).width == 300.0


@pytest.mark.parametrize("policy", [DEFAULT_POLICY, *TINY])
def test_asof_against_brute_force(skewed, policy):
    left = skewed.where("v < 4").select("id", "g", "t", "s")
    right = skewed.where("v >= 6").select(F.col("id").alias("rid"), "g", "t", "s", F.col("v").alias("val"))
    got = asof_backward(left, right, ["g"], "t", "t", "id", "rid", ["rid", "val"], "m_", within=["s"], tolerance=20, gap="gap", policy=policy)
    pool = right.collect()
    for r in rows(got):
        near = [x for x in pool if r["g"] is not None and x["g"] == r["g"] and x["s"] == r["s"] and x["t"] <= r["t"]]
        best = max(near, key=lambda x: (x["t"], x["rid"]), default=None)
        assert r["gap"] == (None if best is None else r["t"] - best["t"])
        hit = best is not None and r["t"] - best["t"] <= 20
        assert r["m_rid"] == (best["rid"] if hit else None)
        assert r["m_val"] == (best["val"] if hit else None)


def test_asof_never_looks_ahead_and_strict_excludes_equal(skewed):
    left, right = skewed.where("v < 4"), skewed.where("v >= 6")
    loose = asof_backward(left, right, ["g"], "t", "t", "id", "id", ["t"], "m_", gap="gap")
    strict = asof_backward(left, right, ["g"], "t", "t", "id", "id", ["t"], "m_", gap="gap", strict=True)
    assert loose.agg(F.min("gap")).first()[0] == 0
    assert strict.agg(F.min("gap")).first()[0] > 0
    assert loose.count() == left.count() == strict.count()


@pytest.mark.parametrize("policy", TINY)
def test_quantiles_and_auc_with_a_hot_group(skewed, policy):
    got = {r["g"]: (r["a"], r["b"]) for r in exact_quantiles(skewed, ["g"], "t", [0.3, 0.5], ["a", "b"], policy).collect()}
    table = skewed.where("g is not null").toPandas()
    for g, part in table.groupby("g"):
        assert got[g] == pytest.approx(tuple(np.quantile(part["t"], [0.3, 0.5])))
    scored = skewed.where("g is not null").withColumns({"is_goal": F.col("v") > 6, "prediction": F.col("t") / 300})
    split = {r["g"]: r["auc"] for r in M.auc(scored, ["g"], policy=policy).collect()}
    for g, part in scored.toPandas().groupby("g"):
        pos, neg = part[part.is_goal].prediction.to_numpy(), part[~part.is_goal].prediction.to_numpy()
        if len(pos) == 0 or len(neg) == 0:
            assert split[g] is None
        else:
            diff = pos[:, None] - neg[None, :]
            assert split[g] == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).mean())


def test_auc_is_invariant_under_monotone_maps(skewed):
    scored = skewed.withColumns({"is_goal": F.col("v") > 6, "prediction": F.col("t") / 300})
    moved = scored.withColumn("prediction", F.pow("prediction", 3) / 2 + 0.1)
    assert M.auc(scored).first()[0] == pytest.approx(M.auc(moved).first()[0])


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_keeps_every_row(skewed, how):
    right = skewed.where("g is not null and g % 2 = 1").select("g", (F.col("g") * 10).alias("w")).distinct()
    plain = skewed.join(right, ["g"], how)
    salted = salted_join(skewed, right, ["g"], how, ["id"], salts=8, policy=SplitPolicy(50, 4096))
    columns = plain.columns
    assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, salted.select(columns).collect()))


def same(a, b, keys):
    columns = a.columns
    order = lambda df: sorted((tuple(r) for r in df.select(*keys, *[c for c in columns if c not in keys]).collect()), key=str)
    left, right = order(a), order(b)
    assert len(left) == len(right) and len(left) > 0
    for x, y in zip(left, right, strict=True):
        assert x == pytest.approx(y, nan_ok=True) if all(isinstance(v, (int, float)) for v in x) else x == y


@pytest.mark.parametrize("policy", [SplitPolicy(8, 100_000)])
def test_operators_do_not_depend_on_the_split(spark, policy):
    raw, games = documents(spark, SMALL), matches(spark, SMALL)
    labels = ["shot_id", "score_diff_at_shot", "chain_label", "def_label", "possession_label", "foot_finish_group"]
    same(
        shot_context(raw, games, tolerance=60).select(*labels), shot_context(raw, games, tolerance=60, policy=policy).select(*labels), ["shot_id"]
    )
    rows_ = shots(spark, SMALL)
    key = ["minute", "second", "shot_id", "l_linenumber"]
    score = lambda p: running_score(rows_, "player_id", "team_id", key, F.col("is_goal"), p).select("shot_id", "l_linenumber", "score_diff_at_shot")
    same(score(DEFAULT_POLICY), score(policy), ["shot_id", "l_linenumber"])
    poss = lambda p: possession_features(
        rows_.withColumn("clock", F.col("minute") * 60 + F.col("second")), ["team_id"], ["clock", "shot_id", "l_linenumber"], "clock", "body_part",
        recent_types=["Head"], policy=p,
    ).select("shot_id", "l_linenumber", "possession_sequence_length", "possession_duration", "previous_action_gap", "recent_def_actions_count")
    same(poss(DEFAULT_POLICY), poss(policy), ["shot_id", "l_linenumber"])
    unique = rows_.dropDuplicates(["shot_id"]).withColumn("statsbomb_xg", F.col("xg"))
    form = lambda p: R.player_form(unique, policy=p).select("shot_id", F.round("player_goal_rate", 9), F.round("player_xg_rate", 9), "player_shot_volume")
    same(form(DEFAULT_POLICY), form(policy), ["shot_id"])
