"""From nested event documents to typed tables. Every function is a pure projection, so a rescan is idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.geometry import geometry_columns
from touchline.functions.numeric import pressure_proxy
from touchline.functions.timing import clock_seconds, minute_bucket_closed_right
from touchline.operators.blocks import DEFAULT_POLICY, SplitDecision, SplitPolicy
from touchline.operators.joins import broadcast_if_small, first_per_key, first_rows, salted_join
from touchline.operators.sequences import counts_as_goal, possession_features, running_score

_KEY = ["match_id", "event_id"]


def _flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def point(location: Column) -> tuple[Column, Column]:
    """x and y of an array with at least two elements, else nulls."""
    whole = F.size(location) >= 2
    return F.when(whole, F.try_element_at(location, F.lit(1))), F.when(whole, F.try_element_at(location, F.lit(2)))


# ---- dimensions -------------------------------------------------------------------------------------------------


def competition_rows(docs: DataFrame) -> DataFrame:
    order = [c for c in ("doc_seq",) if c in docs.columns]
    rows = docs.select(*order, "competition_id", "season_id", "competition_name", F.col("season_name").alias("season"))
    return first_per_key(rows, ["competition_id", "season"], order).select("competition_id", "season_id", "competition_name", "season")


def team_rows(matches: DataFrame) -> DataFrame:
    """Team names from both sides of the match documents; the last seen name wins. Rows without id or name are dropped."""
    order = F.struct("match_id", F.col("doc_seq"))
    sides = [
        matches.select(
            F.coalesce(F.col(f"{s}_team.{s}_team_id"), F.col(f"{s}_team.id")).alias("team_id"),
            F.coalesce(F.col(f"{s}_team.{s}_team_name"), F.col(f"{s}_team.name")).alias("name"),
            F.col(f"{s}_team.country.name").alias("country"),
            order.alias("seen"),
        )
        for s in ("home", "away")
    ]
    both = sides[0].unionByName(sides[1]).where(F.col("team_id").isNotNull() & F.col("name").isNotNull())
    return both.groupBy("team_id").agg(F.max_by("name", "seen").alias("name"), F.max_by("country", "seen").alias("country"))


def match_rows(matches: DataFrame) -> DataFrame:
    """Match table: one row per id, the first of the documents; dates parse leniently, the kick-off time lands on 1970-01-01."""
    clock = F.when(F.col("kick_off").rlike(r"^\d{1,2}:\d{2}$"), F.concat("kick_off", F.lit(":00"))).otherwise(F.col("kick_off"))
    kickoff = F.when(clock.rlike(r"^\d{1,2}:\d{2}:\d{2}"), F.concat(F.lit("1970-01-01 "), clock).try_cast("timestamp_ntz"))
    # whole ISO dates or date-times; text with anything else behind is no date
    date = F.when(F.col("match_date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.col("match_date").try_cast("timestamp_ntz"))
    return first_per_key(matches, ["match_id"], [c for c in ("competition_id", "season_id", "doc_seq") if c in matches.columns]).select(
        "match_id", "competition_id", "season_id", F.col("season.season_name").alias("season"),
        F.coalesce(F.col("home_team.home_team_id"), F.col("home_team.id")).alias("home_team_id"),
        F.coalesce(F.col("away_team.away_team_id"), F.col("away_team.id")).alias("away_team_id"),
        date.alias("match_date"), kickoff.alias("kickoff_time"),
    )


def missing_competitions(matches: DataFrame, competitions: DataFrame) -> DataFrame:
    """Competition rows that match documents refer to but the table lacks."""
    seen = matches.select(
        "competition_id", "season_id",
        F.col("competition.competition_name").alias("competition_name"), F.col("season.season_name").alias("season"),
    )
    return first_per_key(seen, ["competition_id", "season"]).join(competitions.select("competition_id", "season"), ["competition_id", "season"], "left_anti")


def player_rows(raw: DataFrame) -> DataFrame:
    """Players from events and pass recipients: first seen name, else "Player <id>"."""
    actor = raw.select("player.id", "player.name", F.struct("match_id", "event_seq", F.lit(0)).alias("seen"))
    receiver = raw.select("pass.recipient.id", "pass.recipient.name", F.struct("match_id", "event_seq", F.lit(1)).alias("seen"))
    both = actor.union(receiver).where(F.col("id").isNotNull())
    first = F.min_by("name", "seen")
    return both.groupBy(F.col("id").alias("player_id")).agg(
        F.coalesce(first, F.concat(F.lit("Player "), F.col("player_id").cast("string"))).alias("name")
    )


# ---- events -----------------------------------------------------------------------------------------------------


def raw_event_rows(docs: DataFrame) -> DataFrame:
    """Raw events with defaults, one per (match, event id): the first position wins. Only rows of repeated ids move whole."""
    filled = docs.where(F.col("id").isNotNull()).withColumns(
        {
            "type": F.struct(F.col("type.id").alias("id"), F.coalesce("type.name", F.lit("Unknown")).alias("name")),
            "period": F.coalesce("period", F.lit(0)),
            "minute": F.coalesce("minute", F.lit(0)),
            "second": F.coalesce("second", F.lit(0)),
        }
    )
    return first_rows(filled, ["match_id", "id"], ["event_seq"])


def event_outcome(kind: Column) -> Column:
    """Outcome name of the event types that carry one."""
    chain: Column | None = None
    for name, block in (("Pass", "pass"), ("Shot", "shot"), ("Clearance", "clearance"), ("Duel", "duel"), ("Interception", "interception")):
        value = F.col(f"{block}.outcome.name")
        chain = F.when(kind == name, value) if chain is None else chain.when(kind == name, value)
    return chain


def event_rows(raw: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """Base event projection. With a team table, an unknown team becomes 0."""
    x, y = point(F.col("location"))
    kind = F.col("type.name")
    out = raw.select(
        "match_id", "event_seq", F.col("id").alias("event_id"), F.col("team.id").alias("team_id"),
        F.col("player.id").alias("player_id"), kind.alias("type"), "period", "minute", "second", "timestamp", "possession",
        x.alias("location_x"), y.alias("location_y"), _flag(F.col("under_pressure")).alias("under_pressure"),
        event_outcome(kind).alias("outcome"),
    )
    if teams is not None:
        known = teams.select("team_id", F.lit(True).alias("__known"))
        out = out.join(broadcast_if_small(known), "team_id", "left").withColumn(
            "team_id", F.when(F.col("__known"), F.col("team_id")).otherwise(F.lit(0))
        ).drop("__known")
    return out.withColumn("team_id", F.coalesce("team_id", F.lit(0)))


def backlog(raw: DataFrame, events: DataFrame, from_match: int | None = None, limit: int | None = None) -> DataFrame:
    """Raw events without a normalised row, optionally from a match id on and at most ``limit`` of them."""
    done = events.select("match_id", F.col("event_id").alias("id"))
    rows = raw if from_match is None else raw.where(F.col("match_id") >= from_match)
    left = rows.join(done, ["match_id", "id"], "left_anti")
    return left if limit is None else left.orderBy("match_id", "event_seq").limit(limit)


def _detail(raw: DataFrame, types: list[str], **columns: Column) -> DataFrame:
    rows = raw.where(F.col("type.name").isin(types))
    return rows.select("match_id", F.col("id").alias("event_id"), *[v.alias(k) for k, v in columns.items()])


def pass_rows(raw: DataFrame) -> DataFrame:
    p = "pass"
    return _detail(
        raw, ["Pass"], length=F.col(f"{p}.length"), angle=F.col(f"{p}.angle"), pass_height=F.col(f"{p}.height.name"),
        pass_type=F.col(f"{p}.type.name"), body_part=F.col(f"{p}.body_part.name"), outcome=F.col(f"{p}.outcome.name"),
        recipient_player_id=F.col(f"{p}.recipient.id"), is_cross=_flag(F.col(f"{p}.cross")),
        is_through_ball=_flag(F.col(f"{p}.through_ball")),
    )


def dribble_rows(raw: DataFrame) -> DataFrame:
    return _detail(
        raw, ["Dribble"], outcome=F.col("dribble.outcome.name"), overrun=_flag(F.col("dribble.overrun")),
        nutmeg=_flag(F.col("dribble.nutmeg")),
    )


def carry_rows(raw: DataFrame) -> DataFrame:
    sx, sy = point(F.col("location"))
    ex, ey = point(F.col("carry.end_location"))
    length = F.sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy))
    return _detail(raw, ["Carry"], start_x=sx, start_y=sy, end_x=ex, end_y=ey, length=length)


def clearance_rows(raw: DataFrame) -> DataFrame:
    return _detail(
        raw, ["Clearance"], body_part=F.col("clearance.body_part.name"), outcome=F.col("clearance.outcome.name"),
        under_pressure=_flag(F.col("under_pressure")),
    )


def duel_rows(raw: DataFrame) -> DataFrame:
    outcome = F.col("duel.outcome.name")
    return _detail(raw, ["Duel"], duel_type=F.col("duel.type.name"), outcome=outcome, is_success=_flag(outcome == "Won"))


def block_rows(raw: DataFrame) -> DataFrame:
    deflected = _flag(F.col("block.deflection"))
    return _detail(
        raw, ["Block"], block_type=F.when(deflected, "Deflection"), is_deflection=deflected,
        is_save_block=_flag(F.col("block.save_block")),
    )


def interception_rows(raw: DataFrame) -> DataFrame:
    outcome = F.col("interception.outcome.name")
    return _detail(raw, ["Interception"], outcome=outcome, is_success=_flag(outcome == "Won"))


def pressure_rows(raw: DataFrame) -> DataFrame:
    return _detail(raw, ["Pressure"], duration_seconds=F.col("pressure.duration"))


def ball_receipt_rows(raw: DataFrame) -> DataFrame:
    return _detail(raw, ["Ball Receipt", "Ball Receipt*"], clean_receipt=_flag(F.col("ball_receipt.clean_receipt")))


DETAIL_TABLES = {
    "passes": pass_rows,
    "dribbles": dribble_rows,
    "carries": carry_rows,
    "clearances": clearance_rows,
    "duels": duel_rows,
    "blocks": block_rows,
    "interceptions": interception_rows,
    "pressures": pressure_rows,
    "ball_receipts": ball_receipt_rows,
}


def events_with_details(events: DataFrame, duels: DataFrame, blocks: DataFrame, interceptions: DataFrame,
                        pressures: DataFrame) -> DataFrame:
    """Events with the fields of their one-to-one detail rows, where they have one."""
    out = events
    for table, columns in (
        (duels, {"duel_type": "duel_type", "outcome": "duel_outcome"}),
        (blocks, {"block_type": "block_type"}),
        (interceptions, {"outcome": "interception_outcome"}),
        (pressures, {"duration_seconds": "pressure_duration"}),
    ):
        out = out.join(table.select(*_KEY, *[F.col(c).alias(n) for c, n in columns.items()]), _KEY, "left")
    return out


def missing_details(raw: DataFrame, existing: DataFrame, table: str) -> DataFrame:
    """Detail rows of a table that are not stored yet."""
    return DETAIL_TABLES[table](raw).join(existing.select(*_KEY), _KEY, "left_anti")


def shot_rows(raw: DataFrame, matches: DataFrame | None = None,
              policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Shot table. With the match table the opponent is the other side; an unknown side gives 0."""
    x, y = point(F.col("location"))
    outcome = F.coalesce("shot.outcome.name", F.lit("Unknown"))
    key_pass = F.col("shot.key_pass_id")
    rows = raw.where(F.col("type.name") == "Shot").select(
        "match_id", "event_seq", F.col("id").alias("event_id"), F.col("id").alias("shot_id"),
        F.coalesce("team.id", F.lit(0)).alias("team_id"), F.col("player.id").alias("player_id"), "period", "minute", "second",
        "possession", x.alias("location_x"), y.alias("location_y"), _flag(F.col("under_pressure")).alias("under_pressure"),
        F.col("play_pattern.name").alias("play_pattern"), F.col("shot.statsbomb_xg").alias("statsbomb_xg"),
        F.col("shot.body_part.name").alias("body_part"), F.col("shot.technique.name").alias("technique"),
        F.col("shot.type.name").alias("shot_type"), outcome.alias("outcome"),
        _flag(F.col("shot.first_time")).alias("first_time"), F.when(F.length(key_pass) > 0, key_pass).alias("key_pass_id"),
        (outcome == "Blocked").alias("is_blocked"),
    )
    return rows if matches is None else with_opponent(rows, matches, policy)


def with_opponent(rows: DataFrame, matches: DataFrame, policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    sides = matches.select("match_id", F.col("home_team_id").alias("__home"), F.col("away_team_id").alias("__away"))
    joined = salted_join(rows, sides, ["match_id"], "left", ["event_seq"], policy=policy)
    team = F.col("team_id")
    other = F.when(team == F.col("__home"), F.col("__away")).when(team == F.col("__away"), F.col("__home"))
    return joined.withColumns(
        {"opponent_team_id": F.coalesce(other, F.lit(0)), "is_home": F.coalesce(team == F.col("__home"), F.lit(False))}
    ).drop("__home", "__away")


def shot_feature_rows(shots: DataFrame, events: DataFrame, version: str = "v1",
                      policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Geometry, running score and possession features per shot. Shots without a location get no row."""
    scored = running_score(
        shots, "match_id", "team_id", ["period", "minute", "second", "event_seq"], counts_as_goal(F.col("outcome")), policy
    )
    located = scored.where(F.col("location_x").isNotNull() & F.col("location_y").isNotNull())
    clocked = events.where(F.col("possession").isNotNull()).withColumn("__clock", clock_seconds(F.col("minute"), F.col("second")))
    in_possession = possession_features(
        clocked.select("match_id", "event_id", "event_seq", "possession", "type", "__clock"),
        ["match_id", "possession"], ["event_seq"], "__clock", "type", policy=policy,
    ).where(F.col("type") == "Shot").select(
        "match_id", "event_id", "possession_sequence_length", "possession_duration", "previous_action_gap",
        "recent_def_actions_count",
    )
    joined = located.withColumns(geometry_columns(F.col("location_x"), F.col("location_y"))).join(
        in_possession, ["match_id", "event_id"], "left"
    )
    return joined.select(
        "match_id", "shot_id", F.lit(version).alias("version_tag"), "shot_distance", "shot_angle", "centrality",
        "distance_to_goal_line", "zone_id", minute_bucket_closed_right(F.col("minute")).alias("minute_bucket"),
        "score_diff_at_shot", "is_leading", "is_trailing", "is_drawing", "possession_sequence_length",
        "possession_duration", "previous_action_gap", "recent_def_actions_count",
        pressure_proxy(
            F.col("under_pressure"), F.coalesce("recent_def_actions_count", F.lit(0)),
            F.coalesce("possession_duration", F.lit(0.0)),
        ).alias("pressure_proxy_score"),
    )


def missing_features(features: DataFrame, existing: DataFrame) -> DataFrame:
    """Feature rows whose (shot, version) is not stored yet."""
    keys = ["match_id", "shot_id", "version_tag"]
    return features.join(existing.select(*keys), keys, "left_anti")
