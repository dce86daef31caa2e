"""The central table: one row per shot with score state, chain, assist, set-piece and defensive-trigger labels.

Only shots, key passes and candidate preceding events leave the scan, with the few columns each step needs. The group sizes
are looked at once, on the event table, and the decision is shared by all windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions import labels as L
from touchline.functions.geometry import geometry_columns
from touchline.functions.timing import clock_seconds, minute_bucket_closed_left, minute_bucket_closed_right
from touchline.operators.asof import asof_backward
from touchline.operators.blocks import DEFAULT_POLICY, OrderedScan, SplitDecision, SplitPolicy, decide
from touchline.operators.joins import broadcast_if_small, salted_join
from touchline.operators.normalise import point, shot_rows
from touchline.operators.sequences import counts_as_goal, dominant_foot, running_score


def scored_shots(raw: DataFrame, matches: DataFrame, policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Shots with opponent, geometry and the score before each shot."""
    shots = shot_rows(raw, matches, policy)
    order = ["period", "minute", "second", "event_seq"]
    scored = running_score(shots, "match_id", "team_id", order, counts_as_goal(F.col("outcome")), policy)
    return scored.withColumns(geometry_columns(F.col("location_x"), F.col("location_y"))).withColumns(
        {
            "is_goal": L.is_goal(F.col("outcome")),
            "feature_minute_bucket": minute_bucket_closed_right(F.col("minute")),
        }
    )


def base_shots(shots: DataFrame, features: DataFrame, matches: DataFrame, competitions: DataFrame,
               teams: DataFrame | None = None, version: str = "v1",
               policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """The stored shot table with its features of one version, match and competition, and both team names.

    Shots meet their features on the shot id; matches on the match id, with hot matches spread; the rest are dimensions
    whose size is checked before they are broadcast.
    """
    wanted = features.where(F.col("version_tag") == version).drop("version_tag")
    joined = shots.join(wanted, ["match_id", "shot_id"])
    games = matches.select("match_id", "competition_id", "season_id", "season", "match_date", "home_team_id")
    joined = salted_join(joined, games, ["match_id"], "inner", ["shot_id"], policy=policy)
    names = competitions.select("competition_id", "season_id", "competition_name")
    joined = joined.join(broadcast_if_small(names), ["competition_id", "season_id"]).withColumn(
        "is_home", F.col("team_id") == F.col("home_team_id")
    ).drop("home_team_id")
    if teams is None:
        return joined
    for key, name in (("team_id", "team_name"), ("opponent_team_id", "opponent_name")):
        table = teams.select(F.col("team_id").alias(key), F.col("name").alias(name))
        joined = joined.join(broadcast_if_small(table), key, "left").withColumn(name, L.team_label(F.col(name), F.col(key)))
    return joined


def key_passes(raw: DataFrame) -> DataFrame:
    """Pass fields a shot may refer to."""
    p = "pass"
    style = L.pass_style(
        F.col(p).isNotNull(), F.col(f"{p}.cut_back"), F.col(f"{p}.through_ball"), F.col(f"{p}.switch"), F.col(f"{p}.cross"),
        F.col(f"{p}.height.name"), F.col(f"{p}.type.name"),
    )
    end_x, end_y = point(F.col(f"{p}.end_location"))
    return raw.where(F.col("type.name") == "Pass").select(
        "match_id", F.col("id").alias("__pass_id"), F.col("event_seq").alias("pass_seq"), F.col("team.id").alias("pass_team_id"),
        F.col("possession").alias("pass_possession"), style.alias("pass_style"),
        F.col(f"{p}.height.name").alias("pass_height"), F.col(f"{p}.cross").alias("pass_is_cross"),
        F.col(f"{p}.through_ball").alias("pass_is_through_ball"), F.col(f"{p}.cut_back").alias("pass_cut_back"),
        end_x.alias("pass_end_x"), end_y.alias("pass_end_y"),
    )


def with_key_pass(shots: DataFrame, passes: DataFrame, policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Left join on (match, pass id). Unassisted shots get a key of their own, so they do not pile up on null."""
    own = F.concat(F.lit("none:"), F.col("shot_id").cast("string"))
    keyed = shots.withColumn("__pass_id", F.coalesce("key_pass_id", own))
    return keyed.join(passes, ["match_id", "__pass_id"], "left").drop("__pass_id")


def with_chain(shots: DataFrame, raw: DataFrame, policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Chain label from the last carry, dribble or duel of the passing team before the key pass, in the same possession."""
    found = F.col("pass_seq").isNotNull()
    left = shots.withColumns(
        {
            "chain_team_id": F.coalesce("pass_team_id", "team_id"),
            "chain_possession": F.when(found, F.coalesce("pass_possession", "possession")),
        }
    )
    right = raw.where(F.col("type.name").isin(C.PRECEDING_TYPES)).select(
        "match_id", F.col("team.id").alias("chain_team_id"), F.col("possession").alias("chain_possession"), "event_seq",
        F.col("type.name").alias("type"),
    )
    joined = asof_backward(
        left, right, ["match_id"], "pass_seq", "event_seq", "event_seq", "event_seq", ["type"], prefix="chain_prev_",
        within=["chain_possession", "chain_team_id"], policy=policy,
    )
    label = L.chain_label(F.col("key_pass_id"), F.col("pass_style"), F.col("chain_prev_type"))
    return joined.withColumn("chain_label", label).drop("chain_team_id", "chain_possession")


def trigger_events(raw: DataFrame) -> DataFrame:
    """Candidate triggers with their subtype fields; the details come from the event itself, so no join is needed."""
    x, y = point(F.col("location"))
    kind = F.col("type.name")
    outcome = F.when(kind == "Duel", F.col("duel.outcome.name")).when(kind == "Interception", F.col("interception.outcome.name"))
    return raw.where(kind.isin(C.TRIGGER_TYPES)).select(
        "match_id", "period", "event_seq", "possession", clock_seconds(F.col("minute"), F.col("second")).alias("seconds"),
        F.col("id").alias("event_id"), F.coalesce("team.id", F.lit(0)).alias("team_id"), kind.alias("event_type"),
        F.col("duel.type.name").alias("duel_type"),
        F.when(F.col("block.deflection"), "Deflection").alias("block_type"),
        F.col("interception.outcome.name").alias("interception_outcome"), outcome.alias("event_outcome"),
        x.alias("location_x"), y.alias("location_y"),
    )


_PAYLOAD = [
    "event_id", "team_id", "event_type", "duel_type", "block_type", "interception_outcome", "event_outcome", "possession",
    "seconds", "location_x", "location_y",
]


def with_triggers(shots: DataFrame, triggers: DataFrame, tolerance: int = C.TRIGGER_TOLERANCE_SECONDS,
                  role_prefix: bool = False, use_period: bool = False, teams: DataFrame | None = None,
                  policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Last trigger before each shot, in the match and in the possession, with labels.

    Both look-ups share one ordering by match clock and one exchange. A trigger further away than the tolerance loses its
    fields but keeps its gap. The match-level label has no role prefix unless asked for; the possession label has it.
    ``teams`` restricts the triggers to those teams.
    """
    by = ["match_id", "period"] if use_period else ["match_id"]
    if teams is not None:
        triggers = triggers.join(broadcast_if_small(teams.select("team_id")), "team_id", "left_semi")
    columns = shots.columns
    left = shots.withColumns(
        {
            "__left": F.lit(True),
            "__k": clock_seconds(F.col("minute"), F.col("second")),
            "__side": F.lit(1),
            "__tie": F.col("event_seq"),
            "__possession": F.col("possession"),
        }
    )
    right = triggers.select(
        *by, F.col("seconds").alias("__k"), F.lit(0).alias("__side"), F.col("event_seq").alias("__tie"),
        F.col("possession").alias("__possession"), F.struct(*_PAYLOAD).alias("__payload"),
    )
    stacked = left.unionByName(right, allowMissingColumns=True)
    scan = (
        OrderedScan(stacked, by, ["__k", "__side", "__tie"], policy)
        .last_seen("d", F.col("__payload"))
        .last_seen("p", F.when(F.col("__possession").isNotNull(), F.col("__payload")), within=["__possession"])
        .result()
        .where("__left")
    )
    gap = F.col("__k") - F.col("d.seconds")
    near = F.coalesce(gap <= tolerance, F.lit(False))
    masked = scan.select(
        *columns,
        gap.alias("seconds_since_def_action"),
        F.when(near, F.col("d")).alias("d"),
        (F.col("__k") - F.col("p.seconds")).alias("seconds_since_possession_event"),
        "p",
    )
    d_role = L.event_role(F.col("d.team_id"), F.col("team_id"), F.col("opponent_team_id"))
    p_role = L.event_role(F.col("p.team_id"), F.col("team_id"), F.col("opponent_team_id"))

    def label(s: str, role, missing: str):
        parts = [F.col(f"{s}.{c}") for c in ("duel_type", "block_type", "interception_outcome", "event_outcome")]
        return L.trigger_label(F.col(f"{s}.event_type"), role, parts, missing)

    return masked.select(
        *columns,
        "seconds_since_def_action",
        "seconds_since_possession_event",
        F.col("d.event_id").alias("def_event_id"),
        F.col("d.event_type").alias("def_event_type"),
        F.col("d.location_x").alias("def_location_x"),
        F.col("d.location_y").alias("def_location_y"),
        d_role.alias("def_event_role"),
        label("d", d_role if role_prefix else None, C.NO_IMMEDIATE_TRIGGER).alias("def_label"),
        F.col("p.event_id").alias("pos_event_id"),
        p_role.alias("pos_event_role"),
        label("p", p_role, C.NO_POSSESSION_TRIGGER).alias("possession_label"),
        F.coalesce(F.col("possession") == F.col("d.possession"), F.lit(False)).alias("possession_alignment"),
    )


def with_labels(shots: DataFrame) -> DataFrame:
    """State, set-piece and assist labels from columns that are already there."""
    category = L.set_piece_category(F.col("shot_type"), F.col("play_pattern"))
    return shots.withColumns(
        {
            "score_state": L.score_state(F.col("score_diff_at_shot")),
            "simple_state": L.simple_state(F.col("is_leading"), F.col("is_trailing"), F.col("is_drawing")),
            "minute_bucket_label": minute_bucket_closed_left(F.col("minute"), F.col("feature_minute_bucket")),
            "minute_bucket": minute_bucket_closed_left(F.col("minute")),
            "set_piece_category": category,
            "is_set_piece": category != C.OPEN_PLAY,
            "set_piece_group": L.set_piece_group(category),
            "set_piece_phase": L.set_piece_phase(category, F.col("key_pass_id")),
            "assist_category": L.assist_category(
                F.col("play_pattern"), F.col("key_pass_id"), F.col("pass_is_through_ball"), F.col("pass_cut_back"),
                F.col("pass_is_cross"), F.col("pass_height"),
            ),
            "pressure_state": L.pressure_state(F.col("under_pressure")),
            "recipient_zone": L.recipient_zone(
                F.col("pass_end_x"), F.col("pass_end_y"), F.col("location_x"), F.col("location_y")
            ),
        }
    )


def with_foot_finish(shots: DataFrame, feet: DataFrame, policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Strong or weak foot against the player's own majority. Shots without a player get distinct keys that match nothing."""
    nobody = -1 - F.pmod(F.xxhash64("shot_id"), F.lit(1_000_003))
    keyed = shots.withColumn("__player", F.coalesce("player_id", nobody))
    table = feet.select(F.col("player_id").alias("__player"), "preferred_foot")
    joined = salted_join(keyed, table, ["__player"], "left", ["shot_id"], policy=policy)
    return joined.withColumn("foot_finish_group", L.foot_finish(F.col("body_part"), F.col("preferred_foot"))).select(
        *shots.columns, "foot_finish_group"
    )


def shot_context(raw: DataFrame, matches: DataFrame, foot_finish: bool = True, tolerance: int = C.TRIGGER_TOLERANCE_SECONDS,
                 policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Everything known about each shot. ``raw`` are event documents, one row per (match, event)."""
    located = raw.where(F.col("type.name").isin(["Shot", *C.TRIGGER_TYPES]))
    shared = decide(located, ["match_id"], policy)
    shots = scored_shots(raw, matches, shared)
    shots = with_key_pass(shots, key_passes(raw), shared)
    shots = with_chain(shots, raw, shared)
    shooting = raw.where(F.col("type.name") == "Shot").select(F.coalesce("team.id", F.lit(0)).alias("team_id")).distinct()
    shots = with_triggers(shots, trigger_events(raw), tolerance, teams=shooting, policy=shared)
    shots = with_labels(shots)
    if not foot_finish:
        return shots
    finishes = raw.where(F.col("type.name") == "Shot").select(
        F.col("player.id").alias("player_id"), F.col("shot.body_part.name").alias("body_part")
    )
    by_player = decide(finishes.where(F.col("player_id").isNotNull()), ["player_id"], policy)
    return with_foot_finish(shots, dominant_foot(finishes, "player_id", "body_part"), by_player)


def modelling_dataset(context: DataFrame, matches: DataFrame, competitions: DataFrame | None = None,
                      policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """The dataset columns of the models, with match and competition attributes."""
    info = matches.select(
        "match_id", "match_date", "competition_id", F.col("season").alias("competition_season"),
        F.col("competition_id").alias("competition_statsbomb_id"), "season_id",
    )
    if competitions is not None:
        names = competitions.select("competition_id", "season_id", "competition_name")
        info = info.join(names, ["competition_id", "season_id"], "left")
    else:
        info = info.withColumn("competition_name", F.lit(None).cast("string"))
    joined = salted_join(context, info.drop("season_id"), ["match_id"], "left", ["shot_id"], policy=policy)
    renamed = joined.withColumns(
        {
            "shot_body_part": F.col("body_part"),
            "shot_outcome": F.col("outcome"),
            "time_gap_seconds": F.col("seconds_since_def_action").cast("double"),
            "possession_match": F.col("possession_alignment"),
        }
    )
    return renamed.select(*C.DATASET_COLUMNS)
