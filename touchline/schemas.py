"""Explicit schemas of the nested source documents and of the tables written from them."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_NAMED = _struct(id=_L, name=_S)
_XY = T.ArrayType(_D)

COMPETITION_DOC = _struct(
    competition_id=_L, season_id=_L, competition_name=_S, season_name=_S, country_name=_S, competition_gender=_S
)

_TEAM_BLOCK = _struct(id=_L, name=_S, country=_struct(id=_L, name=_S))
_HOME = _struct(home_team_id=_L, home_team_name=_S, id=_L, name=_S, country=_struct(id=_L, name=_S))
_AWAY = _struct(away_team_id=_L, away_team_name=_S, id=_L, name=_S, country=_struct(id=_L, name=_S))
MATCH_DOC = _struct(
    match_id=_L, match_date=_S, kick_off=_S, home_team=_HOME, away_team=_AWAY, home_score=_I, away_score=_I,
    competition=_struct(competition_id=_L, competition_name=_S), season=_struct(season_id=_L, season_name=_S),
)

EVENT_DOC = _struct(
    id=_S,
    type=_NAMED,
    period=_I,
    minute=_I,
    second=_I,
    timestamp=_S,
    possession=_I,
    location=_XY,
    under_pressure=_B,
    play_pattern=_NAMED,
    team=_NAMED,
    player=_NAMED,
    **{
        "pass": _struct(
            length=_D, angle=_D, end_location=_XY, height=_NAMED, type=_NAMED, body_part=_NAMED, outcome=_NAMED,
            recipient=_NAMED, cross=_B, through_ball=_B, cut_back=_B, switch=_B,
        )
    },
    shot=_struct(
        statsbomb_xg=_D, outcome=_NAMED, body_part=_NAMED, technique=_NAMED, type=_NAMED, first_time=_B, key_pass_id=_S,
    ),
    dribble=_struct(outcome=_NAMED, overrun=_B, nutmeg=_B),
    carry=_struct(end_location=_XY),
    clearance=_struct(body_part=_NAMED, outcome=_NAMED),
    duel=_struct(type=_NAMED, outcome=_NAMED),
    block=_struct(deflection=_B, save_block=_B),
    interception=_struct(outcome=_NAMED),
    pressure=_struct(duration=_D),
    ball_receipt=_struct(clean_receipt=_B),
)

# ---- tables. Keys are natural: match_id + event_id identifies an event everywhere ---------------------------------

COMPETITIONS = _struct(competition_id=_L, season_id=_L, competition_name=_S, season=_S)
TEAMS = _struct(team_id=_L, name=_S, country=_S)
PLAYERS = _struct(player_id=_L, name=_S)
MATCHES = _struct(
    match_id=_L, competition_id=_L, season_id=_L, season=_S, home_team_id=_L, away_team_id=_L,
    match_date=T.TimestampNTZType(), kickoff_time=T.TimestampNTZType(),
)
EVENTS = _struct(
    match_id=_L, event_seq=_I, event_id=_S, team_id=_L, player_id=_L, type=_S, period=_I, minute=_I, second=_I,
    timestamp=_S, possession=_I, location_x=_D, location_y=_D, under_pressure=_B, outcome=_S,
)
PASSES = _struct(
    match_id=_L, event_id=_S, length=_D, angle=_D, pass_height=_S, pass_type=_S, body_part=_S, outcome=_S,
    recipient_player_id=_L, is_cross=_B, is_through_ball=_B,
)
DRIBBLES = _struct(match_id=_L, event_id=_S, outcome=_S, overrun=_B, nutmeg=_B)
CARRIES = _struct(match_id=_L, event_id=_S, start_x=_D, start_y=_D, end_x=_D, end_y=_D, length=_D)
CLEARANCES = _struct(match_id=_L, event_id=_S, body_part=_S, outcome=_S, under_pressure=_B)
DUELS = _struct(match_id=_L, event_id=_S, duel_type=_S, outcome=_S, is_success=_B)
BLOCKS = _struct(match_id=_L, event_id=_S, block_type=_S, is_deflection=_B, is_save_block=_B)
INTERCEPTIONS = _struct(match_id=_L, event_id=_S, outcome=_S, is_success=_B)
PRESSURES = _struct(match_id=_L, event_id=_S, duration_seconds=_D)
BALL_RECEIPTS = _struct(match_id=_L, event_id=_S, clean_receipt=_B)
SHOTS = _struct(
    match_id=_L, event_seq=_I, event_id=_S, shot_id=_S, team_id=_L, opponent_team_id=_L, player_id=_L, period=_I,
    minute=_I, second=_I, possession=_I, location_x=_D, location_y=_D, under_pressure=_B, play_pattern=_S,
    statsbomb_xg=_D, body_part=_S, technique=_S, shot_type=_S, outcome=_S, first_time=_B, key_pass_id=_S, is_blocked=_B,
)
POSSESSIONS = _struct(
    match_id=_L, possession=_I, team_id=_L, start_seconds=_I, end_seconds=_I, event_count=_L, duration_seconds=_D
)
SHOT_FEATURES = _struct(
    match_id=_L, shot_id=_S, version_tag=_S, shot_distance=_D, shot_angle=_D, centrality=_D, distance_to_goal_line=_D,
    zone_id=_S, minute_bucket=_S, score_diff_at_shot=_I, is_leading=_B, is_trailing=_B, is_drawing=_B,
    possession_sequence_length=_L, possession_duration=_D, previous_action_gap=_D, recent_def_actions_count=_L,
    pressure_proxy_score=_D,
)
OPPONENT_PROFILES = _struct(
    team_id=_L, version_tag=_S, zone_id=_S, global_rating=_D, zone_rating=_D, block_rate=_D, shots_sample=_L
)
MODEL_REGISTRY = _struct(
    model_id=_L, model_name=_S, version=_S, created_at=T.TimestampNTZType(), hyperparams=_S, calibration_metrics=_S
)
SHOT_PREDICTIONS = _struct(
    shot_id=_S, model_id=_L, raw_probability=_D, neutral_probability=_D, opponent_adjusted_diff=_D,
    opponent_adjusted_ratio=_D, is_neutralized=_B,
)
ENTITY_AGGREGATES = _struct(
    entity_id=_L, model_id=_L, shots_count=_L, summed_cxg=_D, summed_neutral_cxg=_D, summed_diff=_D, avg_diff=_D
)
EVALUATION_METRICS = _struct(model_id=_L, metric=_S, slice=_S, value=_D)
