"""Queries over match sides: rolling form, player form, style, tables and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import config as C
from touchline.catalog import sql as S
from touchline.catalog.common import TEST_TOLERANCE, context, events, located_shots, register, shots
from touchline.functions.labels import pressure_state
from touchline.operators import priors as R
from touchline.operators.filters import (
    apply_modelling_filters, competition_split, drop_empty_features, filter_audit, time_split,
)
from touchline.operators.metrics import error_report
from touchline.operators.model import bucket_table
from touchline.operators.quantiles import medians
from touchline.operators.reports import entity_aggregates, finishing_delta, match_table, season_table, top_entities
from touchline.operators.sequences import possessions
from touchline.plans.staging import written


def _side_shots(spark, folder):
    return located_shots(spark, folder).withColumns(
        {
            "statsbomb_xg": F.col("xg"), "pressure_state": pressure_state(F.col("under_pressure")),
            "competition_id": F.col("season") % 3, "competition_statsbomb_id": F.when(F.col("season") != 1997, F.lit(2)),
            "competition_season": F.concat(F.col("season").cast("string"), F.lit("/"), (F.col("season") + 1).cast("string")),
        }
    )


_SIDES = S.LG + """,
sides as (select match_id, team_id, opponent_team_id, match_date, is_home, season, case when season = 1997 then -1 else 2 end as comp,
    count(*) as shots_for, count(*) filter (is_goal) as goals_for, sum(xg) as xg_for, avg(shot_distance) as avg_shot_distance,
    avg(under_pressure::int) as under_pressure_rate, avg((set_piece_category <> 'Open Play')::int) as set_piece_share
  from lg group by 1, 2, 3, 4, 5, 6),
fa as (select s.*, o.shots_for as shots_against, o.goals_for as goals_against, o.xg_for as xg_against
  from sides s left join sides o on o.match_id = s.match_id and o.team_id = s.opponent_team_id)"""


@register("match_side_summary", S.query(_SIDES, """
select match_id, team_id, is_home, comp || '-' || season || '/' || (season + 1) as competition_season_key, shots_for, goals_for, xg_for, avg_shot_distance,
  under_pressure_rate, set_piece_share from sides""", ["xg_for", "avg_shot_distance", "under_pressure_rate", "set_piece_share"]))
def match_side_summary(spark, folder):
    return R.match_sides(_side_shots(spark, folder)).select(
        "match_id", "team_id", "is_home", "competition_season_key", "shots_for", "goals_for", "xg_for", "avg_shot_distance",
        "under_pressure_rate", "set_piece_share",
    )


@register("match_side_for_against", S.query(_SIDES, """
select match_id, team_id, shots_for, shots_against, goals_against, xg_against from fa""", ["xg_against"]))
def match_side_for_against(spark, folder):
    return R.with_against(R.match_sides(_side_shots(spark, folder))).select(
        "match_id", "team_id", "shots_for", "shots_against", "goals_against", "xg_against"
    )


def _windows() -> str:
    parts = ["row_number() over w - 1 as match_number"]
    for w in C.ROLLING_WINDOWS:
        for prefix, side in (("att", "for"), ("def", "against")):
            for m in ("goals", "shots", "xg"):
                parts.append(
                    f"sum({m}_{side}) over (partition by comp, season, team_id order by match_date, match_id "
                    f"rows between {w} preceding and 1 preceding) as {prefix}_{m}_window_{w}"
                )
    return ", ".join(parts)


def _logit(p: str) -> str:
    q = f"greatest(0.0001::double, least(0.9999::double, coalesce({p}, 0)))"
    return f"ln({q}/(1 - {q}))"


def _bias_columns() -> str:
    parts = []
    for prefix in ("att", "def"):
        for w in C.ROLLING_WINDOWS:
            g, n, x = (f"{prefix}_{m}_window_{w}" for m in ("goals", "shots", "xg"))
            parts.append(f"{_logit(f'{g}/nullif({n}, 0)')} - {_logit(f'{x}/nullif({n}, 0)')} as {prefix}_delta_{w}")
            parts.append(f"case when {n} is null then 0 else greatest(0, least(1, {n}/({w}*6.0::double))) end as {prefix}_weight_{w}")
    return ", ".join(parts)


def _combined(prefix: str) -> str:
    weight = "(" + " + ".join(f"{prefix}_weight_{w}" for w in C.ROLLING_WINDOWS) + ")"
    total = "(" + " + ".join(f"{prefix}_weight_{w}*{prefix}_delta_{w}" for w in C.ROLLING_WINDOWS) + ")"
    return (
        f"greatest(-3, least(3, case when {weight} > 0 then {total}/{weight} else 0 end)) as {prefix}_rolling_component, "
        f"greatest(0, least(1, {weight}/3)) as {prefix}_rolling_reliability"
    )


_FORM = _SIDES + f""",
form as (select *, {_windows()} from fa window w as (partition by comp, season, team_id order by match_date, match_id)),
bias0 as (select *, {_bias_columns()} from form),
bias as (select *, {_combined('att')}, {_combined('def')} from bias0)"""
_FORM_COLUMNS = [f"{p}_{m}_window_{w}" for w in C.ROLLING_WINDOWS for p in ("att", "def") for m in ("goals", "shots", "xg")]


def _form(spark, folder):
    return R.rolling_form(R.match_sides(_side_shots(spark, folder)))


FORM_FEATURES = ["shots_for", "xg_for", "shots_against", "xg_against"]


def _holdout_form(spark, folder):
    """Form of all sides, of which one season is the holdout, and the condition that leaves it out. Written once: fit and bias read it."""
    form = written(_form(spark, folder).withColumn("is_holdout", F.year("match_date") == 1999))
    return form, ~F.col("is_holdout")


@register("rolling_form", S.query(_FORM, f"select match_id, team_id, match_number, {', '.join(_FORM_COLUMNS)} from form",
                                  [c for c in _FORM_COLUMNS if "xg" in c], [c for c in _FORM_COLUMNS if "xg" not in c]))
def rolling_form(spark, folder):
    return _form(spark, folder).select("match_id", "team_id", "match_number", *_FORM_COLUMNS)


_BIAS = ["att_rolling_component", "att_rolling_reliability", "def_rolling_component", "def_rolling_reliability"]


@register("finishing_bias_rolling", S.query(_FORM, f"select match_id, team_id, {', '.join(_BIAS)} from bias", _BIAS))
def finishing_bias_rolling(spark, folder):
    return R.rolling_bias(_form(spark, folder)).select("match_id", "team_id", *_BIAS)


# ---- players ----------------------------------------------------------------------------------------------------

_PLAYER = S.L + """,
pf as (select shot_id, match_id, team_id, player_id,
    coalesce(avg(is_goal::int) over w, (select avg(is_goal::int) from l)) as player_goal_rate,
    coalesce(avg(xg) over w, (select avg(xg) from l)) as player_xg_rate, cast(count(*) over w as double) as player_shot_volume
  from l window w as (partition by player_id order by match_date, match_id, shot_id rows between 35 preceding and 1 preceding)),
snap as (select *, player_goal_rate - player_xg_rate as lift from pf
  qualify row_number() over (partition by match_id, team_id, player_id order by shot_id) = 1),
rk as (select *, row_number() over (partition by match_id, team_id order by lift desc, player_id) as r from snap),
pt as (select match_id, team_id, sum(player_shot_volume) as player_volume, avg(lift) filter (r <= 3) as player_bias_top3,
    greatest(0, least(1, sum(player_shot_volume)/105.0::double)) as player_reliability from rk group by 1, 2)"""


def _player_form(spark, folder):
    return R.player_form(shots(spark, folder).withColumn("statsbomb_xg", F.col("xg")))


@register("player_rolling", S.query(_PLAYER, "select shot_id, player_goal_rate, player_xg_rate, player_shot_volume from pf",
                                    ["player_goal_rate", "player_xg_rate", "player_shot_volume"]))
def player_rolling(spark, folder):
    return _player_form(spark, folder).select("shot_id", "player_goal_rate", "player_xg_rate", "player_shot_volume")


@register("top3_mean", S.query(_PLAYER, "select *, player_bias_top3*player_reliability as player_component from pt",
                               ["player_volume", "player_bias_top3", "player_reliability", "player_component"]))
def top3_mean(spark, folder):
    return R.player_sides(_player_form(spark, folder))


# ---- style ------------------------------------------------------------------------------------------------------

_STYLE = S.E + f""",
sh as (select match_id, team_id, avg({S.distance('x', 'y')}) as avg_shot_distance, count(*) as shots_for, count(*) filter (is_goal) as goals_for, sum(xg) as xg_for
  from e where type = 'Shot' group by 1, 2),
po as (select match_id, possession, arg_min(team_id, sec*100000000::bigint + event_id) as team_id, cast(max(sec) - min(sec) as double) as d from e group by 1, 2),
pt as (select match_id, team_id, sum(d) as duration_seconds from po group by 1, 2),
sr as (select *, case when sum(duration_seconds) over (partition by match_id) > 0 then duration_seconds/sum(duration_seconds) over (partition by match_id) end as possession_share from pt),
df as (select match_id, team_id, count(*) filter (type = 'Pressure') as pe, avg(x) filter (type = 'Pressure') as pl, avg(x) as dl
  from e where type in ('Pressure', 'Duel') group by 1, 2),
s0 as (select sh.*, sr.possession_share as ps, coalesce(pe, 0)/95.0::double as press_intensity, coalesce(pl, 60)/120.0::double as press_height,
    coalesce(dl, 60)/120.0::double as def_line_height from sh left join sr using (match_id, team_id) left join df using (match_id, team_id)),
st as (select *, coalesce(ps, (select quantile_cont(ps, 0.5) from s0), 0.5) as possession_share from s0)"""


def _event_possessions(spark, folder):
    return possessions(events(spark, folder), "match_id", "possession", "team_id", "sec", "event_id")


def _event_sides(spark, folder):
    from touchline.functions.geometry import distance

    s = events(spark, folder).where(F.col("type") == "Shot")
    return s.groupBy("match_id", "team_id").agg(
        F.avg(distance(F.col("x"), F.col("y"))).alias("avg_shot_distance"), F.count(F.lit(1)).alias("shots_for"),
        F.count_if("is_goal").alias("goals_for"), F.sum("xg").alias("xg_for"),
    )


def _style(spark, folder):
    e = events(spark, folder).withColumn("location_x", F.col("x"))
    return R.style_features(_event_sides(spark, folder), _event_possessions(spark, folder), e)


@register("possession_share", S.query(_STYLE, "select match_id, team_id, duration_seconds, possession_share from sr", ["duration_seconds", "possession_share"]))
def possession_share(spark, folder):
    return R.possession_share(_event_possessions(spark, folder))


@register("style_features", S.query(_STYLE, f"select match_id, team_id, {', '.join(R.STYLE_FEATURES)} from st", R.STYLE_FEATURES))
def style_features(spark, folder):
    return _style(spark, folder).select("match_id", "team_id", *R.STYLE_FEATURES)


@register("median_imputation", S.query("", """
select quantile_cont(l_quantity, 0.5) as l_quantity, quantile_cont(l_discount, 0.5) as l_discount, quantile_cont(l_extendedprice, 0.5) as l_extendedprice from lineitem""",
    ["l_quantity", "l_discount", "l_extendedprice"]))
def median_imputation(spark, folder):
    from touchline.sources.projections import table

    return medians(table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])


def _log(num: str, den: str) -> str:
    return _logit(f"{num}/nullif({den}, 0)")


@register("style_cluster_bias", S.query(_FORM, f"""
, cl as (select *, team_id%6 as style_cluster from form),
cs as (select style_cluster, {_log('sum(goals_for)', 'sum(shots_for)')} - {_log('sum(xg_for)', 'sum(shots_for)')} as style_att_bias,
    {_log('sum(goals_against)', 'sum(shots_against)')} - {_log('sum(xg_against)', 'sum(shots_against)')} as style_def_bias
  from cl where season <> 1999 group by 1)
select match_id, team_id, style_cluster, style_att_bias, style_def_bias, greatest(0, least(1, match_number/4.0::double)) as style_reliability
from cl join cs using (style_cluster)""", ["style_att_bias", "style_def_bias", "style_reliability"]))
def style_cluster_bias(spark, folder):
    form = _form(spark, folder).withColumn("style_cluster", F.col("team_id") % 6)
    train = F.year("match_date") != 1999
    return R.style_bias(form, train).select(
        "match_id", "team_id", "style_cluster", "style_att_bias", "style_def_bias", "style_reliability"
    )


_PRIOR = _FORM + f"""
, cs as (select team_id%6 as style_cluster, {_log('sum(goals_for)', 'sum(shots_for)')} - {_log('sum(xg_for)', 'sum(shots_for)')} as a,
    {_log('sum(goals_against)', 'sum(shots_against)')} - {_log('sum(xg_against)', 'sum(shots_against)')} as d from form group by 1),
{_PLAYER[_PLAYER.index('pf as'):]},
co as (select bias.match_id, bias.team_id, is_home, match_date, cs.a*greatest(0, least(1, match_number/4.0::double)) as style_att_component,
    cs.d*greatest(0, least(1, match_number/4.0::double)) as style_def_component, coalesce(player_bias_top3*player_reliability, 0) as player_component,
    att_rolling_component, def_rolling_component
  from bias join cs on cs.style_cluster = bias.team_id%6 left join pt on pt.match_id = bias.match_id and pt.team_id = bias.team_id),
pr as (select *, greatest(-3, least(3, 0.55::double*att_rolling_component + 0.25::double*style_att_component + 0.20::double*player_component)) as finishing_bias_logit,
    greatest(-3, least(3, 0.65::double*def_rolling_component + 0.35::double*style_def_component)) as concession_bias_logit from co)"""


def _priors(spark, folder):
    form = R.rolling_bias(_form(spark, folder)).withColumn("style_cluster", F.col("team_id") % 6)
    style = R.style_bias(form, F.lit(True))
    return R.combine_priors(form.drop("style_cluster"), style, R.player_sides(_player_form(spark, folder)))


@register("finishing_priors", S.query(_PRIOR, """
select match_id, strftime(match_date, '%Y-%m-%d') as match_date, is_home, finishing_bias_logit, exp(finishing_bias_logit) as finishing_bias_multiplier from pr""",
    ["finishing_bias_logit", "finishing_bias_multiplier"]))
def finishing_priors(spark, folder):
    return R.finishing_prior_table(_priors(spark, folder)).select(
        "match_id", "match_date", "is_home", "finishing_bias_logit", "finishing_bias_multiplier"
    )


@register("concession_priors", S.query(_PRIOR, """
select match_id, is_home, concession_bias_logit, exp(concession_bias_logit) as concession_bias_multiplier from pr""",
    ["concession_bias_logit", "concession_bias_multiplier"]))
def concession_priors(spark, folder):
    return R.concession_prior_table(_priors(spark, folder)).select(
        "match_id", "is_home", "concession_bias_logit", "concession_bias_multiplier"
    )


@register("prior_summary", S.query(_PRIOR, """
select count(*) as total_rows, avg(finishing_bias_logit) as finishing_bias_logit_mean, avg(concession_bias_logit) as concession_bias_logit_mean,
  avg((abs(player_component) > 1e-6)::int) as player_coverage, 0 as excluded_rows from pr""",
    ["finishing_bias_logit_mean", "concession_bias_logit_mean", "player_coverage"]))
def prior_summary(spark, folder):
    return R.prior_summary(_priors(spark, folder))


@register("bucket_summary", S.query(S.L, """
, g as (select set_piece_category, body_part, count(*) as shots, count(*) filter (is_goal) as goals, sum(xg) as xg_total, avg(xg/2) as modeled_prob
  from l group by 1, 2 having count(*) >= 1000)
select *, goals/shots as goal_rate, xg_total/shots as xg_per_shot, goals/shots - xg_total/shots as lift_vs_xg, goals/shots - modeled_prob as lift_vs_model,
  case when body_part = 'Head' then 0 else 0.25::double end as bucket_logit, exp(case when body_part = 'Head' then 0 else 0.25::double end) as odds_multiplier from g""",
    ["xg_total", "modeled_prob", "goal_rate", "xg_per_shot", "lift_vs_xg", "lift_vs_model", "bucket_logit", "odds_multiplier"]))
def bucket_summary(spark, folder):
    rows = shots(spark, folder).withColumn("modeled_prob", F.col("xg") / 2)
    effects = rows.where("body_part <> 'Head'").select(
        F.concat_ws("|", "set_piece_category", "body_part").alias("bucket"), F.lit(0.25).alias("bucket_logit")
    ).distinct()
    return bucket_table(rows, ["set_piece_category", "body_part"], effects, xg="xg", min_shots=1000)


# ---- filters and splits -----------------------------------------------------------------------------------------


def _audit_rows(spark, folder):
    return located_shots(spark, folder).select(
        "shot_id", "match_id", F.when(F.col("player_id") % 17 != 0, F.col("shot_distance")).alias("shot_distance"), "shot_angle",
        F.when(F.col("minute") % 13 != 0, F.col("location_x")).alias("location_x"), "location_y",
        F.when(F.col("second") % 19 != 0, F.col("xg")).alias("statsbomb_xg"), "set_piece_category",
        F.when(F.col("player_id") % 23 == 0, "Own Goal").otherwise(F.col("outcome")).alias("shot_outcome"),
    )


_RULES = S.LG + """,
r as (select shot_id, case when player_id%17 = 0 then 'g' when minute%13 = 0 then 'l' when second%19 = 0 then 'x' when set_piece_category = 'Penalty' then 'p'
  when player_id%23 = 0 then 'o' when match_id not in (select o_orderkey from orders where o_orderpriority < '3') then 's' else 'k' end as rule from lg)"""


def _allowed(spark, folder):
    from touchline.sources.projections import table

    return table(spark, folder, "orders").where("o_orderpriority < '3'").select(F.col("o_orderkey").alias("match_id"))


@register("filter_audit", S.query(_RULES, """
select count(*) as total_rows, count(*) filter (rule = 'g') as removed_missing_geometry, count(*) filter (rule = 'l') as removed_missing_location,
  count(*) filter (rule = 'x') as removed_missing_xg, count(*) filter (rule = 'p') as removed_penalties, count(*) filter (rule = 'o') as removed_own_goals,
  count(*) filter (rule = 's') as removed_out_of_scope, count(*) filter (rule = 'k') as total_after from r"""))
def filter_audit_query(spark, folder):
    return filter_audit(_audit_rows(spark, folder), _allowed(spark, folder))


@register("filtered_shots", S.query(_RULES, "select shot_id from r where rule = 'k'"))
def filtered_shots(spark, folder):
    return apply_modelling_filters(_audit_rows(spark, folder), _allowed(spark, folder)).select("shot_id")


@register("empty_feature_drop", S.query("", "select 'l_quantity' as feature union all select 'l_tax'"))
def empty_feature_drop(spark, folder):
    from touchline.sources.projections import table

    rows = table(spark, folder, "lineitem").withColumn("blank", F.lit(None).cast("double"))
    kept = drop_empty_features(rows, ["l_quantity", "blank", "absent", "l_tax"])
    return spark.createDataFrame([(k,) for k in kept], "feature string")


@register("time_splits", S.query("", """
select case when o_orderdate < timestamp '1998-06-01' then 'train' when o_orderdate <= timestamp '2000-01-01' then 'validation' else 'test' end as split,
  case when o_orderstatus in ('F') then 'train' when o_orderstatus = 'O' then 'test' end as status_split, count(*) as n from orders group by 1, 2"""))
def time_splits(spark, folder):
    from touchline.sources.projections import table

    return table(spark, folder, "orders").select(
        time_split(F.col("o_orderdate"), "1998-06-01", "2000-01-01").alias("split"),
        competition_split(F.col("o_orderstatus"), {"train": ["F"], "test": ["O"]}).alias("status_split"),
    ).groupBy("split", "status_split").agg(F.count(F.lit(1)).alias("n"))


# ---- tables -----------------------------------------------------------------------------------------------------


def _scored(spark, folder):
    return shots(spark, folder).withColumns({"statsbomb_xg": F.col("xg"), "cxg_prediction": F.col("xg") * 0.9, "neutral": F.col("xg") * 0.8})


_MT = S.L + """,
mt as (select match_id, team_id, opponent_team_id, sum(xg*0.9::double) as cxg_total, count(*) filter (is_goal) as goals, sum(xg) as provider_xg, count(*) as shots,
  count(*) filter (is_goal) - sum(xg*0.9::double) as cxg_delta, count(*) filter (is_goal) - sum(xg) as provider_delta from l group by 1, 2, 3),
tf as (select team_id, count(distinct match_id) as matches, sum(shots) as shots_for, sum(cxg_total) as cxg_for, sum(provider_xg) as provider_xg_for, sum(goals) as goals_for from mt group by 1),
ta as (select opponent_team_id as team_id, sum(shots) as shots_against, sum(cxg_total) as cxg_against, sum(provider_xg) as provider_xg_against, sum(goals) as goals_against from mt group by 1),
tt as (select tf.*, coalesce(shots_against, 0) as shots_against, coalesce(cxg_against, 0) as cxg_against, coalesce(provider_xg_against, 0) as provider_xg_against,
  coalesce(goals_against, 0) as goals_against, cxg_for - coalesce(cxg_against, 0) as cxg_diff, goals_for - cxg_for as goals_minus_cxg,
  goals_for - coalesce(goals_against, 0) as goal_diff from tf left join ta using (team_id))"""


@register("match_table", S.query(_MT, "select * from mt", ["cxg_total", "provider_xg", "cxg_delta", "provider_delta"]))
def match_table_query(spark, folder):
    return match_table(_scored(spark, folder))


@register("season_table", S.query(_MT, "select * from tt",
    ["cxg_for", "provider_xg_for", "cxg_against", "provider_xg_against", "cxg_diff", "goals_minus_cxg"],
    ["shots_for", "goals_for", "shots_against", "goals_against", "goal_diff"]))
def season_table_query(spark, folder):
    return season_table(match_table(_scored(spark, folder)))


@register("finishing_delta", S.query(_MT, "select team_id, goals_for, cxg_for, goals_for - cxg_for as finishing_delta from tt",
                                     ["cxg_for", "finishing_delta"], ["goals_for"]))
def finishing_delta_query(spark, folder):
    return finishing_delta(season_table(match_table(_scored(spark, folder))))


_AGG = ["summed_cxg", "summed_neutral_cxg", "summed_diff", "avg_diff"]


def _entity(name: str, key: str):
    @register(name, S.query(S.L, f"""
select {key}, count(*) as shots_count, sum(xg*0.9::double) as summed_cxg, sum(xg*0.8::double) as summed_neutral_cxg, sum(xg*0.1::double) as summed_diff,
  avg(xg*0.1::double) as avg_diff from l group by 1""", _AGG))
    def run(spark, folder):
        return entity_aggregates(_scored(spark, folder), key, "cxg_prediction", "neutral")

    return run


_entity("player_aggregates", "player_id")
_entity("team_aggregates", "team_id")


@register("top_players", S.query(S.L, """
select player_id, count(*) as shots_count, sum(xg*0.9::double) as summed_cxg from l group by 1 order by round(sum(xg*0.9::double), 9) desc, player_id limit 20""", ["summed_cxg"]))
def top_players(spark, folder):
    agg = entity_aggregates(_scored(spark, folder), "player_id", "cxg_prediction", "neutral")
    return top_entities(agg.withColumn("summed_cxg", F.round("summed_cxg", 9)), "player_id", 20).select("player_id", "shots_count", "summed_cxg")


@register("error_report", S.query(_MT, """
select 'match' as level, avg(abs(cxg_total - goals)) as mae, sqrt(avg(pow(cxg_total - goals, 2))) as rmse, avg(cxg_total - goals) as bias from mt
union all select 'team', avg(abs(cxg_for - goals_for)), sqrt(avg(pow(cxg_for - goals_for, 2))), avg(cxg_for - goals_for) from tt""", ["mae", "rmse", "bias"]))
def error_report_query(spark, folder):
    games = match_table(_scored(spark, folder))
    teams = season_table(games)
    return error_report(games, "cxg_total", "goals").withColumn("level", F.lit("match")).unionByName(
        error_report(teams, "cxg_for", "goals_for").withColumn("level", F.lit("team"))
    )


@register("context_season_table", S.query(S.context(TEST_TOLERANCE), """
select team_id, count(distinct match_id) as matches, count(*) as shots_for, sum(xg) as provider_xg_for, count(*) filter (goal) as goals_for from cx group by 1""",
    ["provider_xg_for"]))
def context_season_table(spark, folder):
    rows = context(spark, folder).withColumn("cxg_prediction", F.col("statsbomb_xg"))
    return season_table(match_table(rows)).select("team_id", "matches", "shots_for", "provider_xg_for", "goals_for")
