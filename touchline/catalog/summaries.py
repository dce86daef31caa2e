"""Grouped summaries over the shot context and the order shots."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from touchline import config as C
from touchline.catalog import sql as S
from touchline.catalog.common import TEST_TOLERANCE, context, events, located_shots, register, shots
from touchline.functions import labels as L
from touchline.functions.numeric import linspace
from touchline.operators import lift as G
from touchline.operators.quantiles import exact_quantiles
from touchline.operators.ratings import opponent_profile
from touchline.operators.reports import distinct_values, shot_profile_summary, team_style, with_shot_profile
from touchline.sources.projections import table

CX = S.context(TEST_TOLERANCE)


def _values(items) -> str:
    return ", ".join(f"('{i}')" for i in items)


def _spine(column: str, items) -> str:
    return f"(select * from (values {_values(items)}) as d({column}))"


def _lift_sql(keys: str, where: str = "", having: str = "", extra: str = "") -> str:
    n = len(keys.split(","))
    group = ", ".join(str(i + 1) for i in range(n))
    return f"select {keys}, {S.lift()}{extra} from cx {where} group by {group} {having}"


def _filled_sql(observed: str, column: str, items, where: str = "") -> str:
    """Every observed value of one column times the levels of the other."""
    return f"""
select o.{observed}, d.{column}, coalesce(g.shots, 0) as shots, coalesce(g.goals, 0) as goals, g.mean_xg,
  coalesce(g.goals, 0)/greatest(coalesce(g.shots, 0), 1) as goal_rate,
  coalesce(g.goals, 0)/greatest(coalesce(g.shots, 0), 1) - coalesce(g.mean_xg, 0) as lift
from (select distinct {observed} from cx {where}) o cross join {_spine(column, items)} d
left join (select {observed}, {column}, count(*) as shots, sum(case when goal then 1 else 0 end) as goals, avg(xg) as mean_xg
  from cx {where} group by 1, 2) g on g.{observed} = o.{observed} and g.{column} = d.{column}"""


def _ctx(spark, folder):
    return context(spark, folder)


# ---- chains and game state --------------------------------------------------------------------------------------


@register("lift_by_possession_trigger", S.query(CX, _lift_sql("possession_label", extra=", avg(pos_gap) as avg_gap"),
                                                [*S.LIFT_DOUBLES, "avg_gap"], S.LIFT_LONGS))
def lift_by_possession_trigger(spark, folder):
    return G.lift_summary(_ctx(spark, folder), ["possession_label"], extra={"avg_gap": F.avg("seconds_since_possession_event")})


@register("lift_by_opponent", S.query(CX, """
select opponent_team_id, count(*) as shots, sum(case when goal then 1 else 0 end) as goals, avg(xg) as mean_xg,
  sum(case when goal then 1 else 0 end)/count(*) as goal_rate, sum(xg) as xg_total, avg(gap) as avg_gap from cx group by 1""",
    ["mean_xg", "goal_rate", "xg_total", "avg_gap"], S.LIFT_LONGS))
def lift_by_opponent(spark, folder):
    return G.lift_summary(_ctx(spark, folder), ["opponent_team_id"], with_lift=False, extra={
        "xg_total": F.sum("statsbomb_xg"), "avg_gap": F.avg("seconds_since_def_action"),
    })


@register("lift_by_chain", S.query(CX, _lift_sql("chain_label"), S.LIFT_DOUBLES, S.LIFT_LONGS))
def lift_by_chain(spark, folder):
    return G.lift_summary(_ctx(spark, folder), ["chain_label"])


_STATES = [*C.SCORE_STATES, C.UNKNOWN]
_MINUTES = [*C.MINUTE_LABELS, C.UNKNOWN]


@register("lift_zero_filled", S.query(CX, f"""
select *, shots/greatest(sum(shots) over (partition by score_state), 1) as state_share,
  shots/greatest(sum(shots) over (partition by chain_label), 1) as chain_share
from ({_filled_sql('chain_label', 'score_state', _STATES)}) q""",
    [*S.LIFT_DOUBLES, "state_share", "chain_share"], S.LIFT_LONGS))
def lift_zero_filled(spark, folder):
    out = G.lift_summary(_ctx(spark, folder), ["chain_label", "score_state"], domains={"score_state": _STATES})
    return G.add_share(G.add_share(out, "state_share", ["score_state"]), "chain_share", ["chain_label"])


@register("lift_chain_minute", S.query(CX, f"""
select *, shots/greatest(sum(shots) over (partition by minute_bucket_label), 1) as bucket_share
from ({_filled_sql('chain_label', 'minute_bucket_label', _MINUTES)}) q""", [*S.LIFT_DOUBLES, "bucket_share"], S.LIFT_LONGS))
def lift_chain_minute(spark, folder):
    out = G.lift_summary(_ctx(spark, folder), ["chain_label", "minute_bucket_label"], domains={"minute_bucket_label": _MINUTES})
    return G.add_share(out, "bucket_share", ["minute_bucket_label"])


@register("team_simple_state", S.query(CX, _lift_sql("team_id, simple_state"), S.LIFT_DOUBLES, S.LIFT_LONGS))
def team_simple_state(spark, folder):
    return G.lift_summary(_ctx(spark, folder), ["team_id", "simple_state"])


@register("team_delta", S.query(CX, """
select team_id, max(case when simple_state = 'Leading' then r end) as "Leading", max(case when simple_state = 'Trailing' then r end) as "Trailing",
  max(case when simple_state = 'Leading' then r end) - max(case when simple_state = 'Trailing' then r end) as delta
from (select team_id, simple_state, avg(case when goal then 1 else 0 end) as r from cx group by 1, 2) q group by 1
having count(*) filter (simple_state = 'Leading') > 0 and count(*) filter (simple_state = 'Trailing') > 0""",
    ['"Leading"', '"Trailing"', "delta"]))
def team_delta(spark, folder):
    return G.state_delta(G.lift_summary(_ctx(spark, folder), ["team_id", "simple_state"]), "team_id")


@register("lift_state_minute", S.query(CX, """
select score_state, minute_bucket_label, count(*) as shots, sum(case when goal then 1 else 0 end) as goals,
  sum(case when goal then 1 else 0 end)/count(*) as goal_rate from cx
where score_state <> 'Unknown' and minute_bucket_label <> 'Unknown' group by 1, 2""", ["goal_rate"], S.LIFT_LONGS))
def lift_state_minute(spark, folder):
    rows = _ctx(spark, folder).where("score_state <> 'Unknown' and minute_bucket_label <> 'Unknown'")
    return G.lift_summary(rows, ["score_state", "minute_bucket_label"], xg=None)


@register("outcome_mix", S.query(CX, """
select chain_label, avg((g = 'Goal')::int) as "Goal", avg((g = 'On Target')::int) as "On Target", avg((g = 'Blocked')::int) as "Blocked",
  avg((g = 'Off Target')::int) as "Off Target", avg((g = 'Other')::int) as "Other"
from (select chain_label, case when shot_outcome = 'Goal' then 'Goal' when shot_outcome in ('Saved', 'Post', 'Saved To Post') then 'On Target'
  when shot_outcome = 'Blocked' then 'Blocked' when shot_outcome in ('Off T', 'Wayward') then 'Off Target' else 'Other' end as g from cx) q group by 1""",
    ['"Goal"', '"On Target"', '"Blocked"', '"Off Target"', '"Other"']))
def outcome_mix(spark, folder):
    return G.outcome_mix(_ctx(spark, folder), "chain_label", "outcome", C.OUTCOME_GROUP_DOMAIN)


@register("outcome_groups", S.query(S.L, """
select shot_id, case outcome when 'Goal' then 'Goal' when 'Saved' then 'On Target' when 'Blocked' then 'Blocked' else 'Off Target' end as outcome_group from l"""))
def outcome_groups(spark, folder):
    return shots(spark, folder).select("shot_id", L.outcome_group(F.col("outcome")).alias("outcome_group"))


@register("chain_timeline", S.query(CX, f"""
select o.chain_label, d.minute_bucket, coalesce(g.n, 0) as shots from (select distinct chain_label from cx) o
cross join {_spine('minute_bucket', C.MINUTE_LABELS)} d
left join (select chain_label, minute_bucket, count(*) as n from cx group by 1, 2) g using (chain_label, minute_bucket)"""))
def chain_timeline(spark, folder):
    rows = _ctx(spark, folder).where(F.col("minute_bucket") != C.UNKNOWN)
    counts = rows.groupBy("chain_label", "minute_bucket").agg(F.count(F.lit(1)).alias("shots"))
    return G.zero_filled(counts, ["chain_label", "minute_bucket"], {"minute_bucket": C.MINUTE_LABELS}, ["shots"])


@register("top_k_with_baseline", S.query(CX, """
select * from (select chain_label, count(*) as shots from cx where chain_label <> 'Unassisted' group by 1 order by 2 desc, 1 limit 4) q
union all select chain_label, count(*) from cx where chain_label = 'Unassisted' group by 1"""))
def top_k_with_baseline(spark, folder):
    return G.top_with_baseline(
        G.lift_summary(_ctx(spark, folder), ["chain_label"]).select("chain_label", "shots"), "chain_label", 4, baseline="Unassisted"
    )


@register("top_chains_by_total", S.query(CX, "select chain_label, count(*) as shots from cx group by 1 order by 2 desc, 1 limit 6"))
def top_chains_by_total(spark, folder):
    return G.top_with_baseline(G.lift_summary(_ctx(spark, folder), ["chain_label"]).select("chain_label", "shots"), "chain_label", 6)


_DIST_EDGES = linspace(0.0, 40.0, 21)
_ANGLE_EDGES = linspace(0.0, math.pi, 21)


def _hist_sql(value: str, width: str, upper: str) -> str:
    return f"""
select assisted, least(cast(floor({value}/({width})) as bigint), 19) as bin, count(*) as n,
  count(*)/sum(count(*)) over (partition by assisted)/({width}) as density
from (select *, chain_label <> 'Unassisted' as assisted from cx) q where {value} >= 0 and {value} <= {upper} group by 1, 2"""


@register("assisted_distance_histogram", S.query(CX, _hist_sql("shot_distance", "2.0::double", "40"), ["density"]))
def assisted_distance_histogram(spark, folder):
    rows = _ctx(spark, folder).withColumn("assisted", F.col("chain_label") != "Unassisted")
    return G.histogram(rows, "shot_distance", _DIST_EDGES, ["assisted"])


@register("assisted_angle_histogram", S.query(CX, _hist_sql("shot_angle", "pi()/20", "pi()"), ["density"]))
def assisted_angle_histogram(spark, folder):
    rows = _ctx(spark, folder).withColumn("assisted", F.col("chain_label") != "Unassisted")
    return G.histogram(rows, "shot_angle", _ANGLE_EDGES, ["assisted"])


@register("unassisted_body_parts", S.query(CX, """
select body_part, count(*) as shots from cx where chain_label = 'Unassisted' group by 1 order by 2 desc, 1 limit 5"""))
def unassisted_body_parts(spark, folder):
    rows = _ctx(spark, folder).where(F.col("chain_label") == "Unassisted")
    counts = rows.groupBy(F.coalesce("body_part", F.lit(C.UNKNOWN)).alias("body_part")).agg(F.count(F.lit(1)).alias("shots"))
    return G.top_with_baseline(counts, "body_part", 5)


@register("unassisted_pressure_share", S.query(CX, """
select pressure_state, count(*) as shots, count(*)/sum(count(*)) over () as share from cx where chain_label = 'Unassisted' group by 1""", ["share"]))
def unassisted_pressure_share(spark, folder):
    rows = _ctx(spark, folder).where(F.col("chain_label") == "Unassisted")
    counts = rows.groupBy("pressure_state").agg(F.count(F.lit(1)).alias("shots"))
    return counts.withColumn("share", F.col("shots") / counts.agg(F.sum("shots")).scalar())


@register("xg_quantiles_by_chain", S.query(CX, """
select chain_label, quantile_cont(xg, 0) as low, quantile_cont(xg, 0.25) as q1, quantile_cont(xg, 0.5) as median, quantile_cont(xg, 0.75) as q3,
  quantile_cont(xg, 1) as high, avg(xg) as mean_xg, count(xg) as shots from cx group by 1 having count(xg) >= 5""",
    ["low", "q1", "median", "q3", "high", "mean_xg"]))
def xg_quantiles_by_chain(spark, folder):
    rows = _ctx(spark, folder).where(F.col("statsbomb_xg").isNotNull())
    cuts = exact_quantiles(rows, ["chain_label"], "statsbomb_xg", [0, 0.25, 0.5, 0.75, 1], ["low", "q1", "median", "q3", "high"])
    means = rows.groupBy("chain_label").agg(F.avg("statsbomb_xg").alias("mean_xg"), F.count("statsbomb_xg").alias("shots"))
    return cuts.join(means.where("shots >= 5"), "chain_label")


@register("gap_histogram", S.query(CX, """
select bin, count(*) as n from (select case when gap >= 0 and gap < 2 then 0 when gap >= 2 and gap < 4 then 1 when gap >= 4 and gap <= 6 then 2 end as bin from cx) q
where bin is not null group by 1"""))
def gap_histogram(spark, folder):
    return G.histogram(_ctx(spark, folder), "seconds_since_def_action", [0, 2, 4, 6]).drop("density")


# ---- set pieces -------------------------------------------------------------------------------------------------

_SP = [c for c in C.SET_PIECE_DOMAIN if c != C.OPEN_PLAY]


def _set_pieces(spark, folder):
    return _ctx(spark, folder).where(F.col("set_piece_category") != C.OPEN_PLAY)


@register("set_piece_summary", S.query(CX, f"""
select d.set_piece_category, coalesce(g.shots, 0) as shots, coalesce(g.goals, 0) as goals, g.mean_xg,
  coalesce(g.goals, 0)/greatest(coalesce(g.shots, 0), 1) as goal_rate,
  coalesce(g.goals, 0)/greatest(coalesce(g.shots, 0), 1) - coalesce(g.mean_xg, 0) as lift
from {_spine('set_piece_category', _SP)} d left join (select set_piece_category, count(*) as shots,
  sum(case when goal then 1 else 0 end) as goals, avg(xg) as mean_xg from cx group by 1) g using (set_piece_category)""",
    S.LIFT_DOUBLES, S.LIFT_LONGS))
def set_piece_summary(spark, folder):
    out = G.lift_summary(_ctx(spark, folder), ["set_piece_category"], domains={"set_piece_category": C.SET_PIECE_DOMAIN})
    return out.where(F.col("set_piece_category") != C.OPEN_PLAY)


@register("set_piece_team", S.query(CX, _filled_sql("team_id", "set_piece_category", C.SET_PIECE_DOMAIN, "where set_piece_category <> 'Open Play'"),
                                    S.LIFT_DOUBLES, S.LIFT_LONGS))
def set_piece_team(spark, folder):
    return G.lift_summary(_set_pieces(spark, folder), ["team_id", "set_piece_category"], domains={"set_piece_category": C.SET_PIECE_DOMAIN})


@register("set_piece_team_totals", S.query(CX, """
select team_id, shots, goals, mean_xg, total_shots, total_goals, goals/shots as goal_rate, total_goals/total_shots as overall_goal_rate,
  shots/total_shots as set_piece_share, goals/shots - total_goals/total_shots as lift_vs_team_avg
from (select team_id, count(*) filter (set_piece_category <> 'Open Play') as shots,
    count(*) filter (set_piece_category <> 'Open Play' and goal) as goals, avg(xg) filter (set_piece_category <> 'Open Play') as mean_xg,
    count(*) as total_shots, count(*) filter (goal) as total_goals from cx group by 1) q where shots > 0""",
    ["mean_xg", "goal_rate", "overall_goal_rate", "set_piece_share", "lift_vs_team_avg"]))
def set_piece_team_totals(spark, folder):
    return G.team_set_piece_totals(_ctx(spark, folder), ["team_id"], F.col("is_set_piece"))


@register("set_piece_score", S.query(CX, f"""
select c.set_piece_category, d.score_state, coalesce(g.shots, 0) as shots, coalesce(g.goals, 0) as goals, g.mean_xg,
  coalesce(g.goals, 0)/greatest(coalesce(g.shots, 0), 1) as goal_rate,
  coalesce(g.goals, 0)/greatest(coalesce(g.shots, 0), 1) - coalesce(g.mean_xg, 0) as lift
from {_spine('set_piece_category', C.SET_PIECE_DOMAIN)} c cross join {_spine('score_state', _STATES)} d
left join (select set_piece_category, score_state, count(*) as shots, sum(case when goal then 1 else 0 end) as goals, avg(xg) as mean_xg
  from cx where set_piece_category <> 'Open Play' and score_state <> 'Unknown' group by 1, 2) g using (set_piece_category, score_state)""",
    S.LIFT_DOUBLES, S.LIFT_LONGS))
def set_piece_score(spark, folder):
    rows = _set_pieces(spark, folder).where(F.col("score_state") != C.UNKNOWN)
    return G.lift_summary(rows, ["set_piece_category", "score_state"],
                          domains={"set_piece_category": C.SET_PIECE_DOMAIN, "score_state": _STATES})


@register("set_piece_phase", S.query(CX, f"""
select *, shots/greatest(sum(shots) over (partition by set_piece_category), 1) as shot_share from (
select c.set_piece_category, d.set_piece_phase, coalesce(g.shots, 0) as shots, coalesce(g.goals, 0) as goals,
  coalesce(g.goals, 0)/greatest(coalesce(g.shots, 0), 1) as goal_rate
from {_spine('set_piece_category', C.SET_PIECE_DOMAIN)} c cross join {_spine('set_piece_phase', C.SET_PIECE_PHASES)} d
left join (select set_piece_category, set_piece_phase, count(*) as shots, sum(case when goal then 1 else 0 end) as goals
  from cx where set_piece_category <> 'Open Play' group by 1, 2) g using (set_piece_category, set_piece_phase)) q""",
    ["goal_rate", "shot_share"], S.LIFT_LONGS))
def set_piece_phase(spark, folder):
    out = G.lift_summary(_set_pieces(spark, folder), ["set_piece_category", "set_piece_phase"], xg=None,
                         domains={"set_piece_category": C.SET_PIECE_DOMAIN, "set_piece_phase": C.SET_PIECE_PHASES})
    return G.add_share(out, "shot_share", ["set_piece_category"])


@register("set_piece_conceded", S.query(CX, f"""
select opponent_team_id, {S.lift()} from cx where set_piece_category <> 'Open Play' group by 1""", S.LIFT_DOUBLES, S.LIFT_LONGS))
def set_piece_conceded(spark, folder):
    return G.lift_summary(_set_pieces(spark, folder), ["opponent_team_id"])


@register("set_piece_minute", S.query(CX, f"""
select c.set_piece_category, d.minute_bucket, coalesce(g.shots, 0) as shots, coalesce(g.goals, 0) as goals,
  coalesce(g.goals, 0)/greatest(coalesce(g.shots, 0), 1) as goal_rate
from {_spine('set_piece_category', C.SET_PIECE_DOMAIN)} c cross join {_spine('minute_bucket', _MINUTES)} d
left join (select set_piece_category, minute_bucket, count(*) as shots, sum(case when goal then 1 else 0 end) as goals
  from cx where set_piece_category <> 'Open Play' and minute_bucket <> 'Unknown' group by 1, 2) g using (set_piece_category, minute_bucket)""",
    ["goal_rate"], S.LIFT_LONGS))
def set_piece_minute(spark, folder):
    rows = _set_pieces(spark, folder).where(F.col("minute_bucket") != C.UNKNOWN)
    return G.lift_summary(rows, ["set_piece_category", "minute_bucket"], xg=None,
                          domains={"set_piece_category": C.SET_PIECE_DOMAIN, "minute_bucket": _MINUTES})


# ---- assists ----------------------------------------------------------------------------------------------------


@register("assist_summary", S.query(CX, """
select assist_category, count(*) as shots, count(*) filter (goal) as goals, avg(xg) as mean_xg, count(*) filter (goal)/count(*) as goal_rate,
  avg(shot_distance) as avg_distance, avg(shot_angle) as avg_angle from cx group by 1""",
    ["mean_xg", "goal_rate", "avg_distance", "avg_angle"]))
def assist_summary(spark, folder):
    return G.lift_summary(_ctx(spark, folder), ["assist_category"], with_lift=False, extra={
        "avg_distance": F.avg("shot_distance"), "avg_angle": F.avg("shot_angle"),
    })


def _assist_split(column: str):
    @register(f"assist_by_{column}", S.query(CX, f"""
select assist_category, {column}, count(*) as shots, count(*) filter (goal) as goals, avg(xg) as mean_xg,
  count(*) filter (goal)/count(*) as goal_rate from cx group by 1, 2""", ["mean_xg", "goal_rate"]))
    def run(spark, folder):
        return G.lift_summary(_ctx(spark, folder), ["assist_category", column], with_lift=False)

    return run


for _column in ("pressure_state", "foot_finish_group", "recipient_zone"):
    _assist_split(_column)


@register("top_assist_categories", S.query(CX, """
select assist_category, count(*) as shots from cx where assist_category not in ('Unassisted', 'Assist (unspecified)')
group by 1 having count(*) >= 30 order by 2 desc, 1 limit 3"""))
def top_assist_categories(spark, folder):
    summary = G.lift_summary(_ctx(spark, folder), ["assist_category"]).select("assist_category", "shots")
    return G.top_with_baseline(summary, "assist_category", 3, exclude=["Unassisted", "Assist (unspecified)"], min_shots=30)


# ---- sub-model summaries with a minimum size --------------------------------------------------------------------

_BIAS = {
    "team_bias": ("team_id", 0), "opponent_bias": ("opponent_team_id", 0), "set_piece_phase_bias": ("set_piece_category, set_piece_phase", 10),
    "assist_bias": ("assist_category, pass_style", 25), "pressure_bias": ("pressure_state", 30), "trigger_bias": ("def_label", 25),
}


def _bias(name: str, keys: str, least: int):
    sql_keys = keys.replace("pass_style", "p_style as pass_style")

    @register(name, S.query(CX, _lift_sql(sql_keys, having=f"having count(*) >= {least}"), S.LIFT_DOUBLES, S.LIFT_LONGS))
    def run(spark, folder):
        return G.lift_summary(_ctx(spark, folder), keys.split(", "), min_shots=least)

    return run


for _name, (_keys, _least) in _BIAS.items():
    _bias(_name, _keys, _least)


@register("goal_rate_by_column", S.query(S.L, f"""
select body_part, {S.lift('is_goal')} from l group by 1 having count(*) >= 30""", S.LIFT_DOUBLES, S.LIFT_LONGS))
def goal_rate_by_column(spark, folder):
    return G.lift_summary(shots(spark, folder), ["body_part"], xg="xg", min_shots=30)


# ---- bins and grids ---------------------------------------------------------------------------------------------


def _bins_sql(value: str, width: str, bins: int, upper: str, mid: str) -> str:
    return f"""
select cast(b.i as bigint) as bin, coalesce(g.shots, 0) as shots, coalesce(g.goals, 0) as goals, g.mean_xg, g.goals/g.shots as goal_rate,
  (b.i + 0.5)*{width} as {mid}
from (select unnest(range({bins})) as i) b left join (
  select cast(floor({value}/({width})) as bigint) as i, count(*) as shots, count(*) filter (is_goal) as goals, avg(xg) as mean_xg
  from lg where {value} >= 0 and {value} < {upper} group by 1) g on g.i = b.i"""


@register("distance_bins", S.query(S.LG, _bins_sql("shot_distance", "5.0::double", 8, "40", "distance_mid"), ["mean_xg", "goal_rate", "distance_mid"]))
def distance_bins(spark, folder):
    return G.binned_rate(located_shots(spark, folder), "shot_distance", linspace(0.0, 40.0, 9), "distance_mid", xg="xg")


@register("angle_bins", S.query(S.LG, _bins_sql("shot_angle", "pi()/10", 10, "pi()", "angle_mid"), ["mean_xg", "goal_rate", "angle_mid"]))
def angle_bins(spark, folder):
    return G.binned_rate(located_shots(spark, folder), "shot_angle", linspace(0.0, math.pi, 11), "angle_mid", xg="xg")


@register("pitch_grid", S.query(S.LG, """
select cast(bx.i as bigint) as x_bin, cast("by".i as bigint) as y_bin, coalesce(g.shots, 0) as shots, coalesce(g.goals, 0) as goals,
  coalesce(g.goals, 0)/greatest(coalesce(g.shots, 0), 1) as goal_rate
from (select unnest(range(24)) as i) bx cross join (select unnest(range(16)) as i) "by" left join (
  select least(cast(floor(location_x/5.0::double) as bigint), 23) as i, least(cast(floor(location_y/5.0::double) as bigint), 15) as j,
    count(*) as shots, count(*) filter (is_goal) as goals from lg
  where location_x between 0 and 120 and location_y between 0 and 80 group by 1, 2) g on g.i = bx.i and g.j = "by".i""", ["goal_rate"]))
def pitch_grid(spark, folder):
    return G.goal_rate_grid(shots(spark, folder), "location_x", "location_y")


@register("distance_angle_grid", S.query(S.LG, """
select least(cast(floor(shot_distance/(40/24.0::double)) as bigint), 23) as x_bin, least(cast(floor(shot_angle/(pi()/24)) as bigint), 23) as y_bin,
  count(*) as shots, avg(case when is_goal then 1 else 0 end) as goal_rate from lg
where shot_distance between 0 and 40 and shot_angle between 0 and pi() group by 1, 2""", ["goal_rate"]))
def distance_angle_grid(spark, folder):
    return G.grid(located_shots(spark, folder), "shot_distance", "shot_angle", (0.0, 40.0, 24), (0.0, math.pi, 24), {
        "shots": F.count(F.lit(1)), "goal_rate": F.avg(F.col("is_goal").cast("int")),
    })


@register("density_grid", S.query(S.LG, """
select x_bin, y_bin, n, n/max(n) over () as density from (
  select least(cast(floor(location_x/4.0::double) as bigint), 29) as x_bin, least(cast(floor(location_y/4.0::double) as bigint), 19) as y_bin, count(*) as n
  from lg where location_x between 0 and 120 and location_y between 0 and 80 group by 1, 2) q""", ["density"]))
def density_grid(spark, folder):
    return G.density_grid(shots(spark, folder), "location_x", "location_y")


# ---- ratings, styles, profiles ----------------------------------------------------------------------------------


@register("opponent_profile", S.query(S.LG, f"""
, z as (select *, {S.zone('shot_distance', 'centrality')} as zone_id, outcome = 'Blocked' as is_blocked from lg),
g as (select opponent_team_id as team_id, avg(xg) as m, avg(is_blocked::int) as b, count(*) as n from z group by 1),
q as (select opponent_team_id as team_id, zone_id, avg(xg) as m, avg(is_blocked::int) as b, count(*) as n from z group by 1, 2)
select team_id, cast(null as varchar) as zone_id, -m as global_rating, cast(null as double) as zone_rating, b as block_rate, n as shots_sample from g
union all
select g.team_id, d.zone_id, null, case when coalesce(q.n, 0) = 0 then -g.m else -(q.n*q.m + 50*g.m)/(q.n + 50) end, coalesce(q.b, g.b), coalesce(q.n, 0)
from g cross join (values ('A'), ('B'), ('C'), ('D'), ('E'), ('F')) d(zone_id) left join q on q.team_id = g.team_id and q.zone_id = d.zone_id""",
    ["global_rating", "zone_rating", "block_rate"]))
def opponent_profile_query(spark, folder):
    rows = located_shots(spark, folder).withColumn("is_blocked", F.col("outcome") == "Blocked")
    return opponent_profile(rows, xg="xg")


def _style_rows(spark, folder):
    """Context shots with stand-in style components, functions of the team, so that every rule of the archetypes is met."""
    t = F.col("team_id")
    return _ctx(spark, folder).withColumns(
        {
            "style_att_component": (t % 7 - 3) * F.lit(0.05), "style_def_component": (t % 5 - 2) * F.lit(0.08),
            "finishing_bias_logit": (t % 11 - 5) * F.lit(0.02),
        }
    )


_ARCH = """
, st as (select team_id, round_even(avg((team_id%7 - 3)*0.05::double), 4) as style_attack, round_even(avg((team_id%5 - 2)*0.08::double), 4) as style_defense,
    round_even(avg((team_id%11 - 5)*0.02::double), 4) as finishing_bias, round_even(avg(shot_distance), 4) as avg_distance,
    count(*) filter (goal) as goals, count(*) as shots, round_even(avg(goal::int), 4) as goal_rate, round_even(sum(xg), 4) as total_xg,
    round_even(avg(xg), 4) as avg_xg, avg((chain_label like '%Through Ball%')::int) as through_ball_rate,
    avg((chain_label like '%Cross%')::int) as cross_rate, avg((chain_label like '%Cutback%')::int) as cutback_rate from cx group by 1),
sa as (select *, case when style_attack > 0.05 then 'high_press' when style_attack < -0.1 and through_ball_rate > 0.05 then 'counter'
    when cross_rate > 0.25 or avg_distance > 18 then 'direct' when style_defense < -0.1 then 'defensive'
    when abs(style_attack) < 0.05 and abs(style_defense) < 0.05 then 'balanced' else 'possession' end as archetype from st)
select *, case archetype when 'high_press' then 'High Press' when 'counter' then 'Counter-Attack' when 'direct' then 'Direct'
  when 'defensive' then 'Defensive' when 'balanced' then 'Balanced' else 'Possession' end as archetype_name from sa"""


@register("team_style_rates", S.query(CX, _ARCH, ["through_ball_rate", "cross_rate", "cutback_rate"]))
def team_style_rates(spark, folder):
    return team_style(_style_rows(spark, folder))


_PROFILE = """
, sp as (select *, case when body_part = 'Head' then 'aerial' when set_piece_category in ('Corner', 'Indirect Free Kick', 'Direct Free Kick', 'Penalty') then 'set_piece'
    when shot_distance > 22 then 'long_range' when shot_distance < 10 and (chain_label like '%Cutback%' or assist_category like '%Cutback%') then 'poacher'
    when chain_label like '%Through Ball%' or assist_category like '%Through Ball%' then 'counter_shot' when shot_distance < 12 then 'poacher'
    else 'creator' end as shot_profile from cx)"""


def _profiled(spark, folder):
    return with_shot_profile(_ctx(spark, folder).withColumn("shot_body_part", F.col("body_part")))


@register("shot_profiles", S.query(CX, _PROFILE + "select shot_id, shot_profile from sp"))
def shot_profiles(spark, folder):
    return _profiled(spark, folder).select("shot_id", "shot_profile")


@register("shot_profile_summary", S.query(CX, _PROFILE + """
select shot_profile, count(*) filter (goal) as goals, count(*) as shots, round_even(avg(goal::int), 3) as goal_rate, round_even(sum(xg), 3) as total_xg,
  round_even(avg(xg), 3) as avg_xg, round_even(avg(shot_distance), 3) as avg_distance from sp group by 1"""))
def shot_profile_summary_query(spark, folder):
    return shot_profile_summary(_profiled(spark, folder)).drop("name", "description")


@register("distinct_labels", S.query(CX, "select distinct assist_category from cx where assist_category is not null"))
def distinct_labels(spark, folder):
    return distinct_values(_ctx(spark, folder), "assist_category")


@register("team_names", S.query("", """
select s_suppkey, s_nationkey, coalesce(n_name, 'Team ' || s_nationkey) as team_name
from supplier left join (select * from nation where n_regionkey <> 2) n on n_nationkey = s_nationkey"""))
def team_names(spark, folder):
    names = table(spark, folder, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    joined = table(spark, folder, "supplier").join(names, "s_nationkey", "left")
    return joined.select("s_suppkey", "s_nationkey", L.team_label(F.col("n_name"), F.col("s_nationkey")).alias("team_name"))


@register("event_type_counts", S.query(S.E, "select type, count(*) as events, count(distinct match_id) as matches from e group by 1"))
def event_type_counts(spark, folder):
    return events(spark, folder).groupBy("type").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("match_id").alias("matches")
    )
