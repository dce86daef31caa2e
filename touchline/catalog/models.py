"""Queries that fit models or run a stream. The SQL of the linear models writes Newton's steps out, see ``newton_sql``."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline import config as C
from touchline.catalog import newton_sql as NS
from touchline.catalog import priors as CP
from touchline.catalog import sql as S
from touchline.catalog.common import TEST_TOLERANCE, context, located_shots, matches, register
from touchline.catalog.metrics import _NLL, _auc_sql, _bin
from touchline.functions.labels import pressure_state, score_state, simple_state, state_flags
from touchline.operators import clusters as CL
from touchline.operators import model as MD
from touchline.operators import priors as R
from touchline.operators.clusters import fit_clusters
from touchline.plans import pipeline as PL
from touchline.plans.context import modelling_dataset
from touchline.plans.staging import shared_folder, written
from touchline.sources.projections import table
from touchline.streaming.live import LiveScorer


def _training(spark, folder):
    """Order shots with the feature columns of the contextual model."""
    diff = F.col("l_linenumber") - 4
    rows = located_shots(spark, folder).withColumns(
        {
            "statsbomb_xg": F.col("xg"), "score_diff_at_shot": diff, "pressure_state": pressure_state(F.col("under_pressure")),
            "score_state": score_state(diff), "time_gap_seconds": F.when(F.col("second") % 7 != 0, F.col("second").cast("double")),
            "possession_match": F.col("second") % 2 == 0, **state_flags(diff),
        }
    )
    return rows.withColumn("simple_state", simple_state(F.col("is_leading"), F.col("is_trailing"), F.col("is_drawing")))


def _dataset(spark, folder):
    return modelling_dataset(context(spark, folder), matches(spark, folder))


_GEOMETRY = S.LG + """,
nr as materialized (select 0 as g, (shot_distance - avg(shot_distance) over ())/stddev_pop(shot_distance) over () as z1,
  (shot_angle - avg(shot_angle) over ())/stddev_pop(shot_angle) over () as z2, is_goal::int as y from lg), """ + NS.geometry_fits()


@register("baseline_model", S.query(_GEOMETRY, f"""
select feature, coefficient, abs(coefficient) as abs_coefficient from (
  select 'shot_distance' as feature, b1 as coefficient from m{NS.STEPS} union all select 'shot_angle', b2 from m{NS.STEPS}) q""", ["coefficient", "abs_coefficient"]))
def baseline_model(spark, folder):
    model = MD.fit_baseline(located_shots(spark, folder))
    return model.coefficients(spark)


_NAMES, _, _ROWS = NS.training()
_CONTEXTUAL = "recursive " + S.LG.strip() + _ROWS + ", " + NS.fits(len(_NAMES), 0.5)
_MARGIN = " + ".join(["b[1]", *[f"b[{j + 1}]*x{j}" for j in range(1, len(_NAMES) + 1)]])


@register("contextual_model", S.query(_CONTEXTUAL, f"""
select feature, coefficient, abs(coefficient) as abs_coefficient from (
  select unnest({_NAMES}) as feature, unnest(b[2:]) as coefficient from b{NS.STEPS}) q""", ["coefficient", "abs_coefficient"]))
def contextual_model(spark, folder):
    return MD.fit_contextual(_training(spark, folder)).coefficients(spark)


@register("contextual_scores", S.query(_CONTEXTUAL, f"""
select shot_id, match_id, is_goal, round(1/(1 + exp(-({_MARGIN}))), 6) as cxg_prediction from nr cross join b{NS.STEPS}"""))
def contextual_scores(spark, folder):
    """Probabilities to six digits: the two solutions differ in the last bits."""
    rows = _training(spark, folder)
    model = MD.fit_contextual(rows)
    return model.score(rows).select("shot_id", "match_id", "is_goal", F.round("cxg_prediction", 6).alias("cxg_prediction"))


_GAP = """case when gap >= 0 and gap < 2 then '0-2s' when gap >= 2 and gap < 5 then '2-5s' when gap >= 5 and gap < 10 then '5-10s'
  when gap >= 10 and gap < 30 then '10-30s' when gap >= 30 then '30s+' else 'Unknown' end"""
_TRIGGER_ROWS = f"""select def_label || '|' || time_gap_bucket || '|' || possession_state as bucket, * from (
  select def_label, {_GAP} as time_gap_bucket, case when possession_alignment then 'Same' else 'Different' end as possession_state, xg, goal::int as y
  from cx where gap is not null) q"""
_PIECE_COLUMNS = ["set_piece_category", "set_piece_phase", "score_state", "minute_bucket_label"]
_PIECE_ROWS = f"select concat_ws('|', {', '.join(_PIECE_COLUMNS)}) as bucket, {', '.join(_PIECE_COLUMNS)}, xg, goal::int as y from cx"


@register("bucket_model", S.query(S.context(TEST_TOLERANCE) + ", " + NS.bucket_fits("t", _TRIGGER_ROWS), NS.bucket_rows("t", C.TRIGGER_BUCKET, 25), NS.BUCKET_DOUBLES))
def bucket_model(spark, folder):
    rows = PL.trigger_buckets(_dataset(spark, folder))
    return MD.fit_bucket_model(rows, C.TRIGGER_BUCKET, required=["time_gap_seconds", "possession_match"])[0]


@register("bucket_model_metrics", S.query(S.context(TEST_TOLERANCE) + ", " + NS.bucket_fits("s", _PIECE_ROWS), """
select count(*) as samples, avg(pow(p - y, 2)) as brier, avg(-(y*ln(p) + (1 - y)*ln(1 - p))) as log_loss, avg(y) as goal_rate, avg(p) as mean_prediction from s_scored""",
    ["brier", "log_loss", "goal_rate", "mean_prediction"]))
def bucket_model_metrics(spark, folder):
    return MD.fit_bucket_model(_dataset(spark, folder), C.SET_PIECE_BUCKET, min_shots=15)[1]


@register("bucket_models", S.query(S.context(TEST_TOLERANCE) + ", " + NS.bucket_fits("s", _PIECE_ROWS) + ", " + NS.bucket_fits("t", _TRIGGER_ROWS), f"""
select 'set_piece' as model, concat_ws('|', {', '.join(_PIECE_COLUMNS)}) as bucket, shots, goals, modeled_prob, bucket_logit, odds_multiplier from ({NS.bucket_rows("s", _PIECE_COLUMNS, 15)}) q
union all
select 'def_trigger', concat_ws('|', {', '.join(C.TRIGGER_BUCKET)}), shots, goals, modeled_prob, bucket_logit, odds_multiplier from ({NS.bucket_rows("t", C.TRIGGER_BUCKET, 25)}) q""",
    ["modeled_prob", "bucket_logit", "odds_multiplier"]))
def bucket_models(spark, folder):
    """Two of the four bucket tables of one side-by-side fit."""
    tables = PL.bucket_priors(_dataset(spark, folder))
    parts = [
        tables[s.name].select(F.lit(s.name).alias("model"), F.concat_ws("|", *s.columns).alias("bucket"), "shots", "goals", "modeled_prob", "bucket_logit", "odds_multiplier")
        for s in PL.BUCKET_SPECS if s.name in ("set_piece", "def_trigger")
    ]
    return parts[0].unionByName(parts[1])


# inputs of the reference context, by their place among the contextual model's inputs
_NEUTRAL = {"score_diff_at_shot": C.NEUTRAL.score_diff_at_shot, "minute": C.NEUTRAL.minute, "is_leading": 0, "is_trailing": 0, "is_drawing": 1}
_NEUTRAL |= {n: int(n in ("score_state_Level", "simple_state_Drawing", f"pressure_state_{C.NOT_UNDER_PRESSURE}")) for n in _NAMES if n.startswith(("score_state_", "simple_state_", "pressure_state_"))}
_NEUTRAL_MARGIN = " + ".join(["b[1]", *[
    f"b[{j + 2}]*" + (f"(({_NEUTRAL[n]} - {n}_mean)/{n}_spread)" if n in ("score_diff_at_shot", "minute") else str(_NEUTRAL[n]) if n in _NEUTRAL else f"x{j + 1}")
    for j, n in enumerate(_NAMES)
]])


@register("neutral_scores", S.query(_CONTEXTUAL, f"""
select shot_id, round(p, 6) as cxg_prediction, round(q, 6) as neutral_cxg, round(p - q, 6) as opponent_adjusted_diff, round(p/q, 6) as opponent_adjusted_ratio from (
  select shot_id, 1/(1 + exp(-({_MARGIN}))) as p, 1/(1 + exp(-({_NEUTRAL_MARGIN}))) as q from nr cross join b{NS.STEPS} cross join (
    select avg(n_score_diff_at_shot) as score_diff_at_shot_mean, stddev_pop(n_score_diff_at_shot) as score_diff_at_shot_spread,
      avg(n_minute) as minute_mean, stddev_pop(n_minute) as minute_spread from filled) m) z"""))
def neutral_scores(spark, folder):
    """To six digits, as the scores above."""
    rows = _training(spark, folder)
    model = MD.fit_contextual(rows)
    scored = MD.neutral_scores(model, rows)
    return scored.select("shot_id", *[F.round(c, 6).alias(c) for c in ("cxg_prediction", "neutral_cxg", "opponent_adjusted_diff", "opponent_adjusted_ratio")])


@register("style_clusters", S.query(CP._STYLE + ", " + NS.clusters("select *, true as train from st", R.STYLE_FEATURES, ["match_id", "team_id"]), """
select j as style_cluster, count(*) as match_sides, sum(d) as inertia, (select count(*) from ctr40) as cluster_count from lloyd group by j""",
    ["inertia"], ["style_cluster", "cluster_count"]))
def style_clusters(spark, folder):
    """Match sides and squared distances of each style cluster."""
    rows = CP._style(spark, folder)
    found = fit_clusters(rows, R.STYLE_FEATURES, F.lit(True), C.STYLE_CLUSTERS)
    distance = CL._nearest(found.scaled(), found.centres)
    table = rows.select(distance.alias("near")).groupBy(F.col("near.j").alias("style_cluster")).agg(F.count(F.lit(1)).alias("match_sides"), F.sum("near.d").alias("inertia"))
    return table.withColumn("cluster_count", F.lit(found.count))


_HELD = CP._FORM + ", " + NS.clusters("select *, season <> 1999 as train from form", CP.FORM_FEATURES, ["match_id", "team_id"]) + f""",
cl as (select form.*, j, train from form join lloyd using (match_id, team_id)),
cs as (select j, {CP._log('sum(goals_for)', 'sum(shots_for)')} - {CP._log('sum(xg_for)', 'sum(shots_for)')} as a,
    {CP._log('sum(goals_against)', 'sum(shots_against)')} - {CP._log('sum(xg_against)', 'sum(shots_against)')} as b from cl where train group by 1)"""


@register("holdout_style_bias", S.query(_HELD, """
select match_id, team_id, j as style_cluster, not train as is_holdout, a as style_att_bias, b as style_def_bias from cl join cs using (j)""",
    ["style_att_bias", "style_def_bias"], ["style_cluster"]))
def holdout_style_bias(spark, folder):
    """Style clusters and their bias from all seasons but one; the holdout's sides get the clusters of the others."""
    form, train = CP._holdout_form(spark, folder)
    clustered = fit_clusters(form, CP.FORM_FEATURES, train, C.STYLE_CLUSTERS).assign(form)
    return R.style_bias(clustered, train).select("match_id", "team_id", "style_cluster", "is_holdout", "style_att_bias", "style_def_bias")


@register("holdout_prior_summary", S.query(_HELD, """
select count(*) as total_rows, count(*) filter (not train) as excluded_rows, (select count(*) from ctr40) as cluster_count,
  sum(d) filter (train) as inertia from lloyd""", ["inertia"]))
def holdout_prior_summary(spark, folder):
    """How many sides the fit left out, and its clusters."""
    form, train = CP._holdout_form(spark, folder)
    clusters = fit_clusters(form, CP.FORM_FEATURES, train, C.STYLE_CLUSTERS)
    style = R.style_bias(clusters.assign(form), train)
    priors = R.combine_priors(R.rolling_bias(form), style, R.player_sides(CP._player_form(spark, folder)))
    return R.prior_summary(priors, clusters).select("total_rows", "excluded_rows", "cluster_count", "inertia")


_FOLDS = S.LG + ", " + NS.balanced_folds()
_OUT_OF_FOLD = f""",
lf as materialized (select lg.*, fold from lg join folds using (match_id)), held as (select unnest(range(5)) as g),
st as materialized (select g, avg(shot_distance) as m1, stddev_pop(shot_distance) as s1, avg(shot_angle) as m2, stddev_pop(shot_angle) as s2
  from lf join held on fold <> g group by g),
nr as materialized (select g, (shot_distance - m1)/s1 as z1, (shot_angle - m2)/s2 as z2, is_goal::int as y from lf join st on fold <> g), {NS.geometry_fits()},
x as materialized (
  select fold, is_goal, round(1/(1 + exp(-(b0 + b1*(shot_distance - m1)/s1 + b2*(shot_angle - m2)/s2))), 9) as p from lf join st on fold = g join m{NS.STEPS} using (g)),
a as ({_auc_sql('x', 'p', 'fold')}),
c as (select fold, sum(abs(pos - sp)) as gap from (select fold, {_bin('p')} as bin, sum(is_goal::int) as pos, sum(p) as sp from x group by 1, 2) q group by 1)"""


@register("cross_validation", S.query(_FOLDS + _OUT_OF_FOLD, f"""
select fold, count(*) as "count", avg(pow(p - is_goal::int, 2)) as brier, avg({_NLL}) as log_loss, any_value(auc) as auc, any_value(gap)/count(*) as ece
from x join a using (fold) join c using (fold) group by 1""", ["brier", "log_loss", "auc", "ece"], ["fold"]))
def cross_validation(spark, folder):
    """Predictions are compared to nine digits, so that scores equal but for their last bits tie."""
    rows = MD.assign_folds(located_shots(spark, folder), "match_id", 5, method="balanced")
    scored = MD.cross_validate(rows, MD.fit_baseline, 5)
    return MD.fold_metrics(scored.withColumn("prediction", F.round("prediction", 9)))


@register("fold_balance", S.query(_FOLDS, "select row_number() over (order by count(*) desc) as place, count(*) as rows from l join folds using (match_id) group by fold"))
def fold_balance(spark, folder):
    """Fold sizes of the greedy rule, largest first."""
    rows = MD.assign_folds(located_shots(spark, folder).select("shot_id", "match_id"), "match_id", 5, method="balanced")
    sizes = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.select(F.row_number().over(Window.orderBy(F.desc("rows"))).alias("place"), "rows")


# the max-min formula: the highest over starts at or below a score of the lowest mean up to an end at or above it
@register("isotonic_calibration", S.query(S.L, """
, c as materialized (select xg as x, count(*) as n, sum(is_goal::int) as y from l group by 1),
r as materialized (select x, sum(n) over w as n, sum(y) over w as y, n as own, y as own_y from c window w as (order by x)),
m as materialized (select a.x as a, b.x as b, (b.y - a.y + a.own_y)/(b.n - a.n + a.own) as mean from r a join r b on b.x >= a.x),
low as materialized (select m.a, c.x, min(m.mean) as v from m join c on m.a <= c.x and m.b >= c.x group by 1, 2),
fit as (select x, max(v) as calibrated from low group by 1)
select shot_id, xg, calibrated from l join fit on fit.x = l.xg""", ["xg", "calibrated"]))
def isotonic_calibration(spark, folder):
    rows = located_shots(spark, folder)
    model = MD.fit_isotonic(rows, "xg")
    return MD.apply_isotonic(model, rows, "xg").select("shot_id", "xg", "calibrated")


@register("boosted_scores")
def boosted_scores(spark, folder):
    rows = written(located_shots(spark, folder).select("shot_id", "is_goal", "shot_distance", "shot_angle", "xg"))
    model = MD.fit_boosted(rows, ["shot_distance", "shot_angle", "xg"])
    return MD.score_boosted(model, rows).select("shot_id", "boosted")


@register("enriched_dataset")
def enriched_dataset(spark, folder):
    rows = PL.filtered(_dataset(spark, folder))
    return PL.enrich(rows, None, PL.bucket_priors(rows)).select(
        "shot_id", "set_piece_logit", "assist_quality_logit", "pressure_multiplier", "def_trigger_multiplier", "finishing_bias_logit"
    )


@register("prediction_run")
def prediction_run(spark, folder):
    rows = PL.filtered(_dataset(spark, folder))
    model = MD.fit_contextual(rows)
    return PL.predict(model, rows)[2]


@register("model_evaluation")
def model_evaluation(spark, folder):
    rows = PL.filtered(_dataset(spark, folder))
    return PL.evaluate(rows, {"baseline_geometry": MD.fit_baseline(rows)})


_LIVE = """,
s as (select event_id, cast(2*coalesce(sum(case when is_goal then 1 else 0 end) over (partition by match_id, team_id order by sec, event_id
    rows between unbounded preceding and 1 preceding), 0) - coalesce(sum(case when is_goal then 1 else 0 end) over (partition by match_id
    order by sec, event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as score_diff_at_shot
  from e where type = 'Shot'),
t as (select * from e where type in ('Pressure', 'Duel', 'Carry')),
a as (select s.event_id, arg_max(t.event_id, t.sec*100000000::bigint + t.event_id) as seq from e s join t on t.match_id = s.match_id and t.sec <= s.sec
  where s.type = 'Shot' group by 1)"""


@register("live_scoring", S.query(S.E + _LIVE, """
select s.event_id as seq, score_diff_at_shot, t.type as def_event_type, e.sec - t.sec as seconds_since_def_action, false as late
from s join e on e.event_id = s.event_id left join a on a.event_id = s.event_id left join t on t.event_id = a.seq"""))
def live_scoring(spark, folder):
    """The event table as a stream, scored micro-batch by micro-batch."""
    source = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    k = "cast(get_json_object(props, '$.k') as int)"
    events = source.selectExpr(
        "user_id as match_id", f"user_id * 2 + {k} % 2 as team_id", "event_id as seq",
        "cast(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 400 as int) as clock",
        "case event_type when 'click' then 'Pressure' when 'view' then 'Pass' when 'error' then 'Duel' "
        "when 'signup' then 'Carry' else 'Shot' end as type", "value > 115 as is_goal",
    )
    root = f"{shared_folder(spark)}/live/{uuid.uuid4().hex}"
    scorer = LiveScorer(f"{root}/out")
    scorer.start(events, f"{root}/checkpoint").awaitTermination()
    return scorer.shots(spark).select("seq", "score_diff_at_shot", "def_event_type", "seconds_since_def_action", "late")
