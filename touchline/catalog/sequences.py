"""Queries over single events: geometry, clocks, running score, as-of look-ups, context labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline import config as C
from touchline.catalog import sql as S
from touchline.catalog.common import (
    TEST_TOLERANCE, context, documents, event_shots, events, fresh_context, register, shots,
)
from touchline.functions import labels as L
from touchline.functions.geometry import geometry_columns
from touchline.functions.numeric import pressure_proxy
from touchline.functions.timing import clock_seconds, minute_bucket_closed_left, minute_bucket_closed_right, timestamp_seconds
from touchline.operators.asof import asof_backward
from touchline.operators.lift import lift_summary
from touchline.operators.sequences import dominant_foot, first_rows, possession_features, possessions, running_score
from touchline.plans.context import key_passes


@register("geometry_features", S.query(S.E, f"""
select event_id, {S.distance('x', 'y')} as shot_distance, {S.angle('x', 'y')} as shot_angle, abs(y - 40) as centrality,
  120 - x as distance_to_goal_line, {S.zone(S.distance('x', 'y'), 'abs(y - 40)')} as zone_id
from e where type = 'Shot'""", ["shot_distance", "shot_angle", "centrality", "distance_to_goal_line"]))
def geometry_features(spark, folder):
    names = geometry_columns(F.col("x"), F.col("y"))
    return event_shots(spark, folder).select("event_id", *[v.alias(k) for k, v in names.items()])


@register("geometry_features_orders", S.query(S.LG, f"""
select shot_id, shot_distance, shot_angle, {S.zone('shot_distance', 'centrality')} as zone_id from lg""",
    ["shot_distance", "shot_angle"]))
def geometry_features_orders(spark, folder):
    names = geometry_columns(F.col("location_x"), F.col("location_y"))
    keep = {k: names[k] for k in ("shot_distance", "shot_angle", "zone_id")}
    return shots(spark, folder).select("shot_id", *[v.alias(k) for k, v in keep.items()])


@register("timestamp_parts", S.query(S.N, """
select 'e' || event_id as event_id, (minute%60)*60 + second + k/1000.0::double as seconds,
  minute*60 + second as clock from n""", ["seconds"]))
def timestamp_parts(spark, folder):
    return documents(spark, folder).select(
        F.col("id").alias("event_id"), timestamp_seconds(F.col("timestamp")).alias("seconds"),
        clock_seconds(F.col("minute"), F.col("second")).alias("clock"),
    )


@register("minute_buckets", S.query(S.E, f"""
select event_id, {S.closed_right('minute')} as closed_right, {S.closed_left('minute')} as closed_left,
  {S.closed_left('minute - 5', S.closed_right('minute'))} as with_fallback from e"""))
def minute_buckets(spark, folder):
    m = F.col("minute")
    return events(spark, folder).select(
        "event_id", minute_bucket_closed_right(m).alias("closed_right"), minute_bucket_closed_left(m).alias("closed_left"),
        minute_bucket_closed_left(m - 5, minute_bucket_closed_right(m)).alias("with_fallback"),
    )


_SCORE = """,
s as (select *, cast(2*coalesce(sum(case when is_goal then 1 else 0 end) over (partition by match_id, team_id order by sec, event_id
    rows between unbounded preceding and 1 preceding), 0) - coalesce(sum(case when is_goal then 1 else 0 end) over (partition by match_id
    order by sec, event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as score_diff_at_shot
  from e where type = 'Shot')"""


def _scored(spark, folder):
    return running_score(event_shots(spark, folder), "match_id", "team_id", ["sec", "event_id"], F.col("is_goal"))


@register("running_score", S.query(S.E + _SCORE, """
select event_id, score_diff_at_shot, score_diff_at_shot > 0 as is_leading, score_diff_at_shot < 0 as is_trailing,
  score_diff_at_shot = 0 as is_drawing from s"""))
def running_score_query(spark, folder):
    return _scored(spark, folder).select("event_id", "score_diff_at_shot", "is_leading", "is_trailing", "is_drawing")


@register("score_states", S.query(S.E + _SCORE, f"""
select event_id, {S.score_state('score_diff_at_shot')} as score_state, {S.simple_state('score_diff_at_shot')} as simple_state from s"""))
def score_states(spark, folder):
    return _scored(spark, folder).select(
        "event_id", L.score_state(F.col("score_diff_at_shot")).alias("score_state"),
        L.simple_state(F.col("is_leading"), F.col("is_trailing"), F.col("is_drawing")).alias("simple_state"),
    )


# ---- as-of look-ups ---------------------------------------------------------------------------------------------

_ASOF = """,
t as (select * from e where type in ('Pressure', 'Duel', 'Carry')),
a as (select s.event_id, s.match_id, s.sec, arg_max(t.event_id, t.sec*100000000::bigint + t.event_id) as seq
  from e s join t on t.match_id = s.match_id and t.sec <= s.sec{extra} where s.type = 'Shot' group by 1, 2, 3),
j as (select s.event_id, s.team_id, s.opponent_team_id, t.event_id as def_event_id, t.type as def_type, t.team_id as def_team, s.sec - t.sec as gap
  from e s left join a using (event_id) left join t on t.event_id = a.seq where s.type = 'Shot')"""


def _asof(spark, folder, within=(), **options):
    e = events(spark, folder)
    triggers = e.where(F.col("type").isin(C.TRIGGER_TYPES))
    return asof_backward(
        e.where(F.col("type") == "Shot"), triggers, ["match_id"], "sec", "sec", "event_id", "event_id",
        ["event_id", "type", "team_id"], prefix="def_", within=within, gap="gap", **options,
    )


@register("last_trigger_asof", S.query(S.E + _ASOF.format(extra=""), "select event_id, def_event_id, def_type, gap from j"))
def last_trigger_asof(spark, folder):
    return _asof(spark, folder).select("event_id", "def_event_id", "def_type", "gap")


@register("last_trigger_tolerance", S.query(S.E + _ASOF.format(extra=""), f"""
select event_id, gap, case when gap <= {TEST_TOLERANCE} then def_event_id end as def_event_id,
  case when gap <= {TEST_TOLERANCE} then case when def_team = team_id then 'Own' when def_team = opponent_team_id then 'Opponent' else 'Other' end end as role,
  case when gap <= {TEST_TOLERANCE} then case when def_team = team_id then '' when def_team = opponent_team_id then 'Opponent ' else 'Other ' end || def_type
    else 'No immediate defensive trigger' end as def_label from j"""))
def last_trigger_tolerance(spark, folder):
    joined = _asof(spark, folder, tolerance=TEST_TOLERANCE)
    role = L.event_role(F.col("def_team_id"), F.col("team_id"), F.col("opponent_team_id"))
    return joined.select(
        "event_id", "gap", "def_event_id", role.alias("role"),
        L.trigger_label(F.col("def_type"), role, [], C.NO_IMMEDIATE_TRIGGER).alias("def_label"),
    )


@register("possession_trigger_asof", S.query(S.E + _ASOF.format(extra=" and t.possession = s.possession"),
                                             "select event_id, def_event_id, def_type, gap from j"))
def possession_trigger_asof(spark, folder):
    return _asof(spark, folder, within=["possession"]).select("event_id", "def_event_id", "def_type", "gap")


@register("strict_asof", S.query(S.E + _ASOF.format(extra=" and t.sec < s.sec"), "select event_id, def_event_id, gap from j"))
def strict_asof(spark, folder):
    return _asof(spark, folder, strict=True).select("event_id", "def_event_id", "gap")


# ---- possession features ----------------------------------------------------------------------------------------

_POSS = """,
p as (select event_id, sec, under_pressure, row_number() over w as possession_sequence_length,
    cast(sec - first(sec) over w as double) as possession_duration,
    cast(coalesce(sec - lag(sec) over w, 0) as double) as previous_action_gap,
    coalesce(sum(case when type in ('Pressure', 'Duel') then 1 else 0 end) over (partition by match_id, possession order by sec, event_id
      rows between 5 preceding and 1 preceding), 0) as recent_def_actions_count
  from e window w as (partition by match_id, possession order by sec, event_id))"""


def _possession(spark, folder):
    return possession_features(events(spark, folder), ["match_id", "possession"], ["sec", "event_id"], "sec", "type")


@register("possession_features", S.query(S.E + _POSS, """
select event_id, possession_sequence_length, possession_duration, previous_action_gap from p""",
    ["possession_duration", "previous_action_gap"]))
def possession_features_query(spark, folder):
    return _possession(spark, folder).select(
        "event_id", "possession_sequence_length", "possession_duration", "previous_action_gap"
    )


@register("recent_def_actions", S.query(S.E + _POSS, "select event_id, recent_def_actions_count from p",
                                        longs=["recent_def_actions_count"]))
def recent_def_actions(spark, folder):
    return _possession(spark, folder).select("event_id", "recent_def_actions_count")


@register("pressure_proxy", S.query(S.E + _POSS, """
select event_id, 0.5*(case when under_pressure then 1 else 0 end) + 0.3*(recent_def_actions_count - 1.0)
  + 0.2*(1.0::double/(1 + possession_duration) - 1.0::double/6)/(3.0::double/25) as pressure_proxy_score from p""", ["pressure_proxy_score"]))
def pressure_proxy_query(spark, folder):
    score = pressure_proxy(F.col("under_pressure"), F.col("recent_def_actions_count"), F.col("possession_duration"))
    return _possession(spark, folder).select("event_id", score.alias("pressure_proxy_score"))


@register("possession_table", S.query(S.E, """
select match_id, possession, arg_min(team_id, sec*100000000::bigint + event_id) as team_id, min(sec) as start_seconds,
  max(sec) as end_seconds, count(*) as event_count, cast(max(sec) - min(sec) as double) as duration_seconds
from e group by 1, 2""", ["duration_seconds"]))
def possession_table(spark, folder):
    return possessions(events(spark, folder), "match_id", "possession", "team_id", "sec", "event_id")


@register("dominant_foot", S.query(S.N, """
select player_id, count(*) filter (body_part = 'Left Foot') as left_shots, count(*) filter (body_part = 'Right Foot') as right_shots,
  case when count(*) filter (body_part = 'Left Foot') > count(*) filter (body_part = 'Right Foot') then 'Left Foot'
    when count(*) filter (body_part = 'Right Foot') > count(*) filter (body_part = 'Left Foot') then 'Right Foot' end as preferred_foot
from n where type = 'Shot' and player_id is not null group by 1"""))
def dominant_foot_query(spark, folder):
    d = documents(spark, folder).where(F.col("type.name") == "Shot").select(
        F.col("player.id").alias("player_id"), F.col("shot.body_part.name").alias("body_part")
    )
    return dominant_foot(d, "player_id", "body_part")


@register("dedupe_first", S.query("", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_quantity) = 1"""))
def dedupe_first(spark, folder):
    from touchline.sources.projections import table

    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return first_rows(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]).drop(
        "l_shipdate", "l_quantity"
    )


# ---- labels on documents ----------------------------------------------------------------------------------------


@register("pass_styles", S.query(S.N, "select 'e' || event_id as event_id, style as pass_style from n where type = 'Pass'"))
def pass_styles(spark, folder):
    return key_passes(documents(spark, folder)).select(F.col("__pass_id").alias("event_id"), "pass_style")


@register("json_props_extract", S.query(S.N, """
select 'e' || event_id as event_id, type, case when type = 'Pass' then height end as height,
  case when type = 'Pass' then recipient_id end as recipient_id, case when type = 'Shot' then xg end as xg from n""", ["xg"]))
def json_props_extract(spark, folder):
    return documents(spark, folder).select(
        F.col("id").alias("event_id"), F.col("type.name").alias("type"), F.col("pass.height.name").alias("height"),
        F.col("pass.recipient.id").alias("recipient_id"), F.col("shot.statsbomb_xg").alias("xg"),
    )


@register("chain_asof", S.query(S.context(TEST_TOLERANCE), "select shot_id, prev_type as chain_prev_type, p_style as pass_style, chain_label from cx"))
def chain_asof(spark, folder):
    return context(spark, folder).select("shot_id", "chain_prev_type", "pass_style", "chain_label")


@register("assist_categories", S.query(S.context(TEST_TOLERANCE), """
select shot_id, assist_category, pressure_state, foot_finish_group, recipient_zone from cx"""))
def assist_categories(spark, folder):
    return context(spark, folder).select(
        "shot_id", "assist_category", "pressure_state", "foot_finish_group", "recipient_zone"
    )


@register("set_piece_labels", S.query(S.context(TEST_TOLERANCE), """
select shot_id, set_piece_category, set_piece_group, set_piece_phase from cx"""))
def set_piece_labels(spark, folder):
    return context(spark, folder).select("shot_id", "set_piece_category", "set_piece_group", "set_piece_phase")


@register("trigger_labels", S.query(S.context(TEST_TOLERANCE), """
select shot_id, gap as seconds_since_def_action, def_label, pos_gap as seconds_since_possession_event, possession_label,
  possession_alignment, 'e' || d_seq as def_event_id, 'e' || q_seq as pos_event_id from cx"""))
def trigger_labels(spark, folder):
    return context(spark, folder).select(
        "shot_id", "seconds_since_def_action", "def_label", "seconds_since_possession_event", "possession_label",
        "possession_alignment", "def_event_id", "pos_event_id",
    )


@register("shot_context", S.query(S.context(TEST_TOLERANCE), """
select shot_id, match_id, team_id, opponent_team_id, xg as statsbomb_xg, goal as is_goal, diff as score_diff_at_shot, score_state,
  simple_state, feature_minute_bucket, minute_bucket_label, chain_label, p_style as pass_style, assist_category, pressure_state,
  set_piece_category, set_piece_phase, def_label, shot_distance, shot_angle from cx""",
    ["statsbomb_xg", "shot_distance", "shot_angle"]))
def shot_context_query(spark, folder):
    return fresh_context(spark, folder, foot_finish=False).select(
        "shot_id", "match_id", "team_id", "opponent_team_id", "statsbomb_xg", "is_goal", "score_diff_at_shot", "score_state",
        "simple_state", "feature_minute_bucket", "minute_bucket_label", "chain_label", "pass_style", "assist_category",
        "pressure_state", "set_piece_category", "set_piece_phase", "def_label", "shot_distance", "shot_angle",
    )


@register("lift_by_trigger", S.query(S.context(TEST_TOLERANCE), f"""
select def_label, {S.lift()}, avg(gap) as avg_gap, avg(case when possession_alignment then 1 else 0 end) as possession_match
from cx group by 1""", [*S.LIFT_DOUBLES, "avg_gap", "possession_match"], S.LIFT_LONGS))
def lift_by_trigger(spark, folder):
    return trigger_lift(context(spark, folder))


def trigger_lift(df):
    """What happened just before the shot: goal rate against expectation per trigger label."""
    return lift_summary(df, ["def_label"], extra={
        "avg_gap": F.avg("seconds_since_def_action"),
        "possession_match": F.avg(F.col("possession_alignment").cast("int")),
    })
