"""Constants and label vocabularies shared by every operator.

All literals here are fixed values: they must equal the published definitions for results to agree.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PitchConfig:
    """Pitch geometry in provider units."""

    length: float = 120.0
    width: float = 80.0
    goal_x: float = 120.0
    goal_y: float = 40.0
    left_post_y: float = 36.8
    right_post_y: float = 43.2
    near_distance: float = 12.0
    mid_distance: float = 20.0
    central_band: float = 10.0


PITCH = PitchConfig()


@dataclass(frozen=True)
class NeutralContext:
    """Reference context used to strip situational effects from a prediction."""

    score_diff_at_shot: int = 0
    minute: int = 55
    minute_bucket: str = "46-60"
    under_pressure: bool = False
    opponent_def_rating_global: float = 0.0
    opponent_def_zone_rating: float = 0.0


NEUTRAL = NeutralContext()

# --- fixed values: default competition scope (competition id, season id) ---
DEFAULT_SCOPE = [
    {"competition_id": 2, "season_id": 27},
    {"competition_id": 43, "season_id": 3},
    {"competition_id": 43, "season_id": 106},
    {"competition_id": 55, "season_id": 43},
    {"competition_id": 55, "season_id": 282},
]

# --- fixed values: zones ---
ZONES = ["A", "B", "C", "D", "E", "F"]

# --- fixed values: minute buckets. Two definitions coexist and share some labels (see README) ---
MINUTES_CLOSED_RIGHT = [(15, "0-15"), (30, "16-30"), (45, "31-45"), (60, "46-60"), (75, "61-75"), (90, "76-90")]
MINUTES_CLOSED_RIGHT_LAST = "90+"
MINUTE_EDGES = [0, 15, 30, 45, 60, 75, 90, 121]
MINUTE_LABELS = ["0-15", "15-30", "30-45", "45-60", "60-75", "75-90", "90+"]

# --- fixed values: score states ---
SCORE_STATES = ["Trailing 2+", "Trailing 1", "Level", "Leading 1", "Leading 2+"]
SIMPLE_STATES = ["Leading", "Trailing", "Drawing", "Unknown"]
UNKNOWN = "Unknown"

# --- fixed values: event type groups ---
DEFENSIVE_ACTIONS = ["Pressure", "Block", "Interception", "Clearance", "Duel", "Tackle", "Foul Committed", "Shield"]
RECENT_DEFENSIVE_TYPES = ["Pressure", "Block", "Interception", "Clearance", "Duel", "Tackle"]
STYLE_DEFENSIVE_TYPES = ["Pressure", "Duel", "Tackle", "Interception", "Block", "Clearance"]
TRIGGER_TYPES = ["Pressure", "Interception", "Ball Recovery", "Tackle", "Block", "Duel", "Carry", "Dribble"]
PRECEDING_TYPES = ["Carry", "Dribble", "Duel"]

# --- fixed values: defensive trigger labels ---
TRIGGER_TOLERANCE_SECONDS = 5
NO_IMMEDIATE_TRIGGER = "No immediate defensive trigger"
NO_POSSESSION_TRIGGER = "No possession defensive trigger"

# --- fixed values: shot outcome groups ---
OUTCOME_GROUPS = {
    "Goal": "Goal",
    "Saved": "On Target",
    "Blocked": "Blocked",
    "Off T": "Off Target",
    "Wayward": "Off Target",
    "Post": "On Target",
    "Saved To Post": "On Target",
}
OUTCOME_GROUP_DOMAIN = ["Goal", "On Target", "Blocked", "Off Target", "Other"]

# --- fixed values: set pieces ---
SET_PIECE_BY_SHOT_TYPE = {"Penalty": "Penalty", "Free Kick": "Direct Free Kick"}
SET_PIECE_BY_PATTERN = {
    "From Corner": "Corner",
    "From Free Kick": "Indirect Free Kick",
    "From Throw In": "Throw In",
    "From Goal Kick": "Goal Kick",
    "From Kick Off": "Kick Off",
}
OTHER_RESTART = "Other Restart"
OPEN_PLAY = "Open Play"
SET_PIECE_DOMAIN = [
    "Penalty",
    "Direct Free Kick",
    "Indirect Free Kick",
    "Corner",
    "Throw In",
    "Goal Kick",
    "Kick Off",
    "Other Restart",
    "Open Play",
]
SET_PIECE_GROUPS = {
    "Penalty": "Direct",
    "Direct Free Kick": "Direct",
    "Indirect Free Kick": "Restart",
    "Corner": "Restart",
    "Throw In": "Restart",
    "Goal Kick": "Restart",
    "Kick Off": "Restart",
    "Other Restart": "Restart",
}
SET_PIECE_PHASES = ["Direct", "First Phase", "Second Phase"]

# --- fixed values: assist context ---
ASSIST_SET_PIECE_PATTERNS = ["From Corner", "From Free Kick", "From Throw In", "From Goal Kick"]
COUNTER_PATTERN = "From Counter"
UNDER_PRESSURE = "Under pressure"
NOT_UNDER_PRESSURE = "Not under pressure"

# --- fixed values: bucket edges of the sub-models ---
PRESSURE_DISTANCE_EDGES = [0.0, 12.0, 18.0, 24.0, None]
PRESSURE_DISTANCE_LABELS = ["0-12", "12-18", "18-24", "24+"]
PRESSURE_ANGLE_EDGES = [0.0, 20.0, 40.0, None]
PRESSURE_ANGLE_LABELS = ["0-20", "20-40", "40+"]
TIME_GAP_EDGES = [0.0, 2.0, 5.0, 10.0, 30.0, None]
TIME_GAP_LABELS = ["0-2s", "2-5s", "5-10s", "10-30s", "30s+"]

SET_PIECE_BUCKET = ["set_piece_category", "set_piece_phase", "score_state", "minute_bucket_label"]
ASSIST_BUCKET = ["assist_category", "pass_style", "pressure_state"]
PRESSURE_BUCKET = ["pressure_state", "distance_bin", "angle_bin"]
TRIGGER_BUCKET = ["def_label", "time_gap_bucket", "possession_state"]

# --- fixed values: finishing and concession priors ---
ROLLING_WINDOWS = (3, 5, 8)
SHOTS_PER_MATCH = 6.0
PLAYER_WINDOW = 35
PLAYER_TOP_N = 3
STYLE_CLUSTERS = 6
STYLE_FULL_MATCHES = 4
MATCH_MINUTES = 95.0
MAX_LOGIT = 3.0
LOGIT_EPS = 1e-4
FINISHING_WEIGHTS = {"rolling": 0.55, "style": 0.25, "player": 0.20}
CONCESSION_WEIGHTS = {"rolling": 0.65, "style": 0.35}
RATING_PRIOR_SHOTS = 50.0

# --- fixed values: contextual model feature contract ---
NUMERIC_FEATURES = [
    "shot_distance",
    "shot_angle",
    "statsbomb_xg",
    "score_diff_at_shot",
    "minute",
    "time_gap_seconds",
    "finishing_bias_logit",
    "finishing_bias_multiplier",
    "concession_bias_logit",
    "concession_bias_multiplier",
    "set_piece_logit",
    "set_piece_multiplier",
    "set_piece_modeled_prob",
    "assist_quality_logit",
    "assist_quality_multiplier",
    "assist_quality_modeled_prob",
    "pressure_logit",
    "pressure_multiplier",
    "pressure_modeled_prob",
    "def_trigger_logit",
    "def_trigger_multiplier",
    "def_trigger_modeled_prob",
]
BINARY_FEATURES = ["is_leading", "is_trailing", "is_drawing", "possession_match"]
CATEGORICAL_FEATURES = [
    "chain_label",
    "pass_style",
    "score_state",
    "simple_state",
    "minute_bucket_label",
    "assist_category",
    "pressure_state",
    "set_piece_category",
    "set_piece_phase",
    "def_label",
]

# --- fixed values: columns of the modelling dataset ---
DATASET_COLUMNS = [
    "shot_id",
    "match_id",
    "team_id",
    "opponent_team_id",
    "player_id",
    "is_home",
    "match_date",
    "competition_id",
    "competition_name",
    "competition_season",
    "competition_statsbomb_id",
    "statsbomb_xg",
    "is_goal",
    "shot_distance",
    "shot_angle",
    "location_x",
    "location_y",
    "shot_body_part",
    "shot_outcome",
    "score_diff_at_shot",
    "is_leading",
    "is_trailing",
    "is_drawing",
    "minute",
    "feature_minute_bucket",
    "score_state",
    "simple_state",
    "minute_bucket_label",
    "chain_label",
    "pass_style",
    "assist_category",
    "pressure_state",
    "set_piece_category",
    "set_piece_phase",
    "def_label",
    "time_gap_seconds",
    "possession_match",
]

# --- fixed values: dashboard archetypes ---
TEAM_ARCHETYPES = {
    "high_press": "High Press",
    "possession": "Possession",
    "counter": "Counter-Attack",
    "balanced": "Balanced",
    "defensive": "Defensive",
    "direct": "Direct",
}
SHOT_PROFILES = {
    "poacher": ("Poacher", "Close range, cutbacks, tap-ins"),
    "long_range": ("Long Range", "Distance shots, set pieces"),
    "aerial": ("Aerial", "Headers, crosses"),
    "counter_shot": ("Counter", "Fast transitions, through balls"),
    "set_piece": ("Set Piece", "Corners, free kicks"),
    "creator": ("Creator", "Cutbacks, wide positions"),
}
PROFILE_SET_PIECES = ["Corner", "Indirect Free Kick", "Direct Free Kick", "Penalty"]

# --- fixed values: acceptance gates ---
GATES = {"brier_gain": 0.002, "ece_overall": 0.06, "ece_pressure": 0.05, "ece_slice": 0.08, "auc": 0.70, "mean_diff": 0.005}
MIN_SLICE_ROWS = 100
