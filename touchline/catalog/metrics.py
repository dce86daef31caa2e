"""Queries over predictions: discrimination, calibration, slices, drift, gates, resampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from touchline.catalog import sql as S
from touchline.catalog.common import TEST_TOLERANCE, context, event_shots, located_shots, register, shots
from touchline.functions.labels import pressure_state
from touchline.operators import metrics as M
from touchline.plans.staging import written
from touchline.sources.projections import table


def _predicted(spark, folder):
    return shots(spark, folder).withColumn("prediction", F.col("xg"))


def _sliced(spark, folder):
    """Order shots as two models, with the columns the slices need."""
    rows = located_shots(spark, folder).withColumns(
        {"pressure_state": pressure_state(F.col("under_pressure")), "score_diff_at_shot": F.col("l_linenumber") - 4}
    )
    # both models' scores leave one scan of the joined shots
    scores = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("prediction")) for m, p in (("provider", F.col("xg")), ("flat", F.round(F.col("xg") * 0.5 + 0.05, 4)))])
    return rows.select("*", F.inline(scores))


_NLL = "-(case when is_goal then ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))) " \
    "else ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))) end)"


@register("brier_logloss", S.query(S.L, f"""
select count(*) as "count", avg(pow(xg - is_goal::int, 2)) as brier, avg({_NLL.replace('p))', 'xg))')}) as log_loss,
  avg(is_goal::int) as goal_rate, avg(xg) as mean_prediction from l""", ["brier", "log_loss", "goal_rate", "mean_prediction"]))
def brier_logloss(spark, folder):
    return M.probability_metrics(_predicted(spark, folder))


def _auc_sql(source: str, p: str, keys: str = "") -> str:
    part = f"partition by {keys} " if keys else ""
    head, group = (f"{keys}, ", f"group by {keys}") if keys else ("", "")
    return f"""
select {head}(sum(case when is_goal then r end) - count(*) filter (is_goal)*(count(*) filter (is_goal) + 1)/2.0::double)
  /nullif(count(*) filter (is_goal)*count(*) filter (not is_goal)::double, 0) as auc
from (select *, min_r + (cnt - 1)/2.0::double as r from (
  select *, rank() over ({part}order by {p}) as min_r, count(*) over (partition by {keys + ', ' if keys else ''}{p}) as cnt from {source}) q) z {group}"""


@register("auc", S.query(S.L, _auc_sql("l", "xg"), ["auc"]))
def auc(spark, folder):
    return M.auc(_predicted(spark, folder))


@register("auc_events", S.query(S.E, _auc_sql("(select * from e where type = 'Shot') s", "xg"), ["auc"]))
def auc_events(spark, folder):
    return M.auc(event_shots(spark, folder), prediction="xg")


@register("auc_by_team", S.query(S.L, _auc_sql("l", "xg", "team_id"), ["auc"]))
def auc_by_team(spark, folder):
    return M.auc(_predicted(spark, folder), ["team_id"])


@register("pr_auc", S.query(S.L, """
, s as (select xg, count(*) filter (is_goal) as pos, count(*) as n from l group by 1),
c as (select *, sum(pos) over (order by xg desc) as hits, sum(n) over (order by xg desc) as flagged, sum(pos) over () as p_all from s)
select sum(pos*(hits/flagged)/p_all) as pr_auc from c""", ["pr_auc"]))
def pr_auc(spark, folder):
    return M.pr_auc(_predicted(spark, folder))


_EDGES = ["0.1", "0.2", "0.30000000000000004", "0.4", "0.5", "0.6000000000000001", "0.7000000000000001", "0.8", "0.9"]


def _bin(p: str) -> str:
    return f"case when {p} >= 0 and {p} < 1 then " + " + ".join(f"({p} >= {e}::double)::int" for e in _EDGES) + " end"


@register("ece", S.query(S.L, f"""
select sum(case when bin is not null then n*abs(y - p) else 0 end)/sum(n) as ece from (
  select {_bin('xg')} as bin, count(*) as n, avg(xg) as p, avg(is_goal::int) as y from l group by 1) q""", ["ece"]))
def ece(spark, folder):
    return M.ece(_predicted(spark, folder))


@register("reliability_width", S.query(S.L, f"""
select cast(b.i as bigint) as bin, coalesce(q.n, 0) as "count", p as mean_prediction, y as observed, (b.i + 0.5)/10.0::double as bin_center
from (select unnest(range(10)) as i) b left join (
  select {_bin('xg')} as bin, count(*) as n, avg(xg) as p, avg(is_goal::int) as y from l group by 1) q on q.bin = b.i""",
    ["mean_prediction", "observed", "bin_center"]))
def reliability_width(spark, folder):
    return M.reliability_curve(_predicted(spark, folder))


@register("reliability_dashboard", S.query(S.E, f"""
select least({_bin('least(p, 0.9999999::double)')}, 9) as bin, count(*) as "count", avg(p) as mean_prediction, avg(is_goal::int) as observed from (
  select least(xg*2, 1.0) as p, is_goal from e where type = 'Shot') q group by 1""", ["mean_prediction", "observed"]))
def reliability_dashboard(spark, folder):
    rows = event_shots(spark, folder).withColumn("prediction", F.least(F.col("xg") * 2, F.lit(1.0)))
    return M.reliability_curve(rows, clip_top=True, keep_empty=False).drop("bin_center")


_CUTS = ", ".join(f"quantile_cont(p, {i / 10}) as q{i}" for i in range(1, 10))
_BELOW = " + ".join(f"(q{i} < p)::int" for i in range(1, 10))


@register("reliability_quantile", S.query(S.E, f"""
, s as (select xg as p, is_goal from e where type = 'Shot'), q as (select {_CUTS} from s)
select {_BELOW} as bin, count(*) as "count", avg(p) as mean_prediction, avg(is_goal::int) as observed from s cross join q group by 1""",
    ["mean_prediction", "observed"]))
def reliability_quantile(spark, folder):
    return M.reliability_quantile(event_shots(spark, folder).withColumn("prediction", F.col("xg")))


@register("reliability_quantile_by_pressure", S.query(S.E, f"""
, s as (select xg as p, is_goal, under_pressure from e where type = 'Shot'), q as (select under_pressure, {_CUTS} from s group by 1)
select under_pressure, {_BELOW} as bin, count(*) as "count", avg(p) as mean_prediction, avg(is_goal::int) as observed from s join q using (under_pressure) group by 1, 2""",
    ["mean_prediction", "observed"]))
def reliability_quantile_by_pressure(spark, folder):
    return M.reliability_quantile(event_shots(spark, folder).withColumn("prediction", F.col("xg")), ["under_pressure"])


_SLICES = {
    "overall": "true", "under_pressure": "under_pressure", "not_under_pressure": "not under_pressure", "leading": "l_linenumber > 4",
    "trailing": "l_linenumber < 4", "drawing": "l_linenumber = 4", "first_half": "minute < 46", "second_half": "minute >= 46",
    "close_range": "shot_distance <= 12", "long_range": "shot_distance >= 20", "set_piece": "set_piece_category <> 'Open Play'",
    "open_play": "set_piece_category = 'Open Play'",
}
_SLICED = S.LG + """,
m as (select *, 'provider' as model, xg as p from lg union all select *, 'flat', round(xg*0.5::double + 0.05::double, 4) from lg),
x as (""" + " union all ".join(f"select *, '{n}' as slice from m where {c}" for n, c in _SLICES.items()) + f"""),
a as ({_auc_sql('x', 'p', 'model, slice')}),
e as (select model, slice, sum(case when bin is not null then n*abs(y - pp) else 0 end)/sum(n) as ece from (
  select model, slice, {_bin('p')} as bin, count(*) as n, avg(p) as pp, avg(is_goal::int) as y from x group by 1, 2, 3) q group by 1, 2)"""


@register("slice_metrics", S.query(_SLICED, f"""
select model, slice, count(*) as "count", avg(pow(p - is_goal::int, 2)) as brier, avg({_NLL}) as log_loss, any_value(auc) as auc, any_value(ece) as ece
from x join a using (model, slice) join e using (model, slice) group by 1, 2 having count(*) >= 100""", ["brier", "log_loss", "auc", "ece"]))
def slice_metrics(spark, folder):
    return M.slice_metrics(_sliced(spark, folder))


@register("slice_memberships", S.query(_SLICED, "select slice, count(*) as n from x where model = 'flat' group by 1"))
def slice_memberships(spark, folder):
    from touchline.operators.filters import explode_slices

    rows = explode_slices(_sliced(spark, folder).where("model = 'flat'"))
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@register("model_comparison", S.query(_SLICED, f"""
select model, avg(pow(p - is_goal::int, 2)) as brier, avg({_NLL}) as log_loss, any_value(auc) as auc
from x join a using (model, slice) where slice = 'overall' group by 1""", ["brier", "log_loss", "auc"]))
def model_comparison(spark, folder):
    overall = M.full_metrics(_sliced(spark, folder), ["model"])
    long = M.metrics_long(overall, ["model"], ["brier", "log_loss", "auc"])
    return M.comparison_table(long, "model", ["brier", "log_loss", "auc"])


@register("provider_metrics", S.query(S.context(TEST_TOLERANCE), f"""
, x as (select goal as is_goal, least(greatest(xg*1.3, 0), 1) as p from cx), a as ({_auc_sql('x', 'p')})
select count(*) as "count", avg(pow(p - is_goal::int, 2)) as brier, (select auc from a) as auc from x""", ["brier", "auc"]))
def provider_metrics(spark, folder):
    rows = context(spark, folder).withColumn("statsbomb_xg", F.col("statsbomb_xg") * 1.3)
    return M.full_metrics(M.provider_prediction(rows), ["model"]).select("count", "brier", "auc")


@register("quartile_slices", S.query(S.E, """
, s as (select xg as p, is_goal, sec from e where type = 'Shot'), q as (select quantile_cont(sec, 0.25) as q1, quantile_cont(sec, 0.75) as q3 from s)
select case when sec > q3 then 'late' else 'early' end as slice, count(*) as "count", avg(pow(p - is_goal::int, 2)) as brier
from s cross join q where sec > q3 or sec < q1 group by 1""", ["brier"]))
def quartile_slices(spark, folder):
    rows = M.quartile_slices(event_shots(spark, folder).withColumn("prediction", F.col("xg")), "sec", "early", "late")
    return M.probability_metrics(rows, ["slice"]).select("slice", "count", "brier")


@register("neutral_checks", S.query(S.L, """
select avg(xg*0.1::double) as mean_diff, corr(minute, xg*0.1::double) as rating_corr, corr(under_pressure::int, xg*0.1::double) as pressure_corr from l""",
    ["mean_diff", "rating_corr", "pressure_corr"]))
def neutral_checks(spark, folder):
    rows = shots(spark, folder).withColumns({"diff": F.col("xg") * 0.1, "pressure": F.col("under_pressure").cast("int")})
    return M.neutral_checks(rows, "diff", "minute", "pressure")


@register("gates", S.query(_SLICED, f"""
, mm as (select model, slice, count(*) as n, avg(pow(p - is_goal::int, 2)) as brier, any_value(auc) as auc, any_value(ece) as ece
  from x join a using (model, slice) join e using (model, slice) group by 1, 2)
select (select brier from mm where model = 'provider' and slice = 'overall') - o.brier >= 0.002 as brier_gate, o.ece <= 0.06 as ece_gate,
  (select ece from mm where model = 'flat' and slice = 'under_pressure') <= 0.05 as pressure_ece_gate,
  abs((select avg(xg*0.1::double) from l)) <= 0.005 as neutral_gate, o.auc > 0.70 as auc_gate,
  (select max(ece) from mm where model = 'flat' and n >= 100) <= 0.08 as slice_ece_gate
from mm o where model = 'flat' and slice = 'overall'"""))
def gates(spark, folder):
    metrics = written(M.slice_metrics(_sliced(spark, folder)))  # a few rows that each gate reads
    flat = metrics.where("model = 'flat'")
    neutral = shots(spark, folder).agg(F.avg(F.col("xg") * 0.1).alias("mean_diff"))
    return M.acceptance_gates(
        flat.where("slice = 'overall'"), flat.where("slice = 'under_pressure'"), flat,
        metrics.where("model = 'provider' and slice = 'overall'"), neutral,
    )


@register("monthly_ece", S.query(S.L, f"""
select month, sum(case when bin is not null then n*abs(y - p) else 0 end)/sum(n) as ece from (
  select strftime(match_date, '%Y-%m') as month, {_bin('xg')} as bin, count(*) as n, avg(xg) as p, avg(is_goal::int) as y from l group by 1, 2) q group by 1""", ["ece"]))
def monthly_ece(spark, folder):
    return M.monthly_ece(_predicted(spark, folder), "match_date")


@register("drift_ks", S.query(S.L, """
, v as (select xg, count(*) filter (season = 1996) as a, count(*) filter (season = 2000) as b from l group by 1),
c as (select sum(a) over (order by xg) as ca, sum(b) over (order by xg) as cb, sum(a) over () as na, sum(b) over () as nb from v)
select max(abs(ca/na - cb/nb)) as ks from c""", ["ks"]))
def drift_ks(spark, folder):
    return M.ks_distance(shots(spark, folder), "xg", "season", 1996, 2000)


@register("drift_ks_by_team", S.query(S.LG, """
, v as (select team_id, shot_distance as d, count(*) filter (season = 1996) as a, count(*) filter (season = 2000) as b from lg group by 1, 2),
c as (select team_id, sum(a) over (partition by team_id order by d) as ca, sum(b) over (partition by team_id order by d) as cb,
    sum(a) over (partition by team_id) as na, sum(b) over (partition by team_id) as nb from v)
select team_id, max(abs(ca/na - cb/nb)) as ks from c group by 1""", ["ks"]))
def drift_ks_by_team(spark, folder):
    return M.ks_distance(located_shots(spark, folder), "shot_distance", "season", 1996, 2000, ["team_id"])


@register("fold_summary", S.query(S.L, f"""
, x as (select *, match_id%5 as fold, xg as p from l), a as ({_auc_sql('x', 'p', 'fold')}),
f as (select fold, avg(pow(p - is_goal::int, 2)) as brier, avg({_NLL}) as log_loss, any_value(auc) as auc from x join a using (fold) group by 1)
select avg(brier) as brier_mean, stddev_pop(brier) as brier_std, avg(log_loss) as log_loss_mean, stddev_pop(log_loss) as log_loss_std,
  avg(auc) as auc_mean, stddev_pop(auc) as auc_std from f""",
    ["brier_mean", "brier_std", "log_loss_mean", "log_loss_std", "auc_mean", "auc_std"]))
def fold_summary(spark, folder):
    rows = _predicted(spark, folder).withColumn("fold", F.col("match_id") % 5)
    return M.fold_summary(M.full_metrics(rows, ["fold"]))


@register("quality_label_metrics", S.query("", """
select avg(pow(least(n_chars/20000.0::double, 1.0) - quality, 2)) as brier, count(*) as "count" from labels join documents using (doc_id)""", ["brier"]))
def quality_label_metrics(spark, folder):
    share = F.least(F.col("n_chars") / 20000.0, F.lit(1.0))
    docs = table(spark, folder, "documents").select("doc_id", share.alias("prediction"))
    rows = table(spark, folder, "labels").join(docs, "doc_id")
    return M.probability_metrics(rows, target="quality").select("brier", "count")


def _poisson(group: str, *parts: str) -> tuple[str, str]:
    """The draw of ``poisson_weight``: its number ``h``, and the weight of ``u``, which is that number over the prime."""
    h = group
    for k, part in enumerate([*parts, "97", "1009"]):
        v = f"v{k}"
        h = f"[(({v}%{M.DRAW_PRIME})*({v}%{M.DRAW_PRIME}) + {group})%{M.DRAW_PRIME} for {v} in [({h})*{[48271, 69621, 40692][k % 3]} + {part}]][1]"
    steps, cumulative = "", 0.0
    for k in range(16):
        cumulative += math.exp(-1.0) / math.factorial(k)
        steps += f" when u < {cumulative!r}::double then {k}"
    return h, f"case{steps} else 16 end"


_H, _W = _poisson("match_id::bigint", "r", "42")
_REPLICATES = "(select unnest(range(1, 1001)) as r) reps"


@register("bootstrap_ci", S.query(S.L, f"""
, g as materialized (select match_id, count(*) as n, sum(pow(xg - is_goal::int, 2) - pow(xg*0.5 + 0.05 - is_goal::int, 2)) as d from l group by 1),
st as (select r, sum(w*d)/sum(w*n) as x from (select r, n, d, {_W} as w from (select r, n, d, ({_H})/{M.DRAW_PRIME}::double as u from g cross join {_REPLICATES}) q) q group by r)
select (select sum(d)/sum(n) from g) as estimate, quantile_cont(x, 0.025) as low, quantile_cont(x, 0.975) as high from st""", ["estimate", "low", "high"]))
def bootstrap_ci(spark, folder):
    rows = shots(spark, folder).withColumns({"first": F.col("xg"), "second": F.col("xg") * 0.5 + 0.05})
    return M.bootstrap_difference(rows, "match_id", "first", "second")


def _replicate_auc(name: str, score: str) -> str:
    return f"""{name}_c as materialized (select match_id, {score} as s, is_goal, count(*) as n from e where type = 'Shot' group by all),
{name}_w as (select r, s, sum(case when is_goal then w*n else 0 end) as pos, sum(case when is_goal then 0 else w*n end) as neg from (
  select *, {_W} as w from (select *, ({_H})/{M.DRAW_PRIME}::double as u from {name}_c cross join {_REPLICATES}) q) q group by r, s),
{name} as (select r, sum(pos*(below + neg/2))/nullif(sum(pos)*sum(neg), 0)::double as auc from (
  select *, coalesce(sum(neg) over (partition by r order by s rows between unbounded preceding and 1 preceding), 0) as below from {name}_w) q group by r)"""


@register("bootstrap_auc_ci", S.query(S.E + ", " + _replicate_auc("fa", "xg") + ", " + _replicate_auc("fb", "x"), """
select quantile_cont(d, 0.025) as low, quantile_cont(d, 0.5) as median, quantile_cont(d, 0.975) as high
from (select fa.auc - fb.auc as d from fa join fb using (r)) q where d is not null""", ["low", "median", "high"]))
def bootstrap_auc_ci(spark, folder):
    rows = event_shots(spark, folder).withColumns({"first": F.col("xg"), "second": F.col("x")})
    return M.bootstrap_auc_difference(rows, "match_id", "first", "second")
