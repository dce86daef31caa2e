"""Rule-based labels. Every rule is a CASE over columns, so it stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import config as C


def _null() -> Column:
    return F.lit(None).cast("string")


def _true(flag: Column) -> Column:
    """Three-valued to two-valued: null counts as false."""
    return F.coalesce(flag, F.lit(False))


def lookup(value: Column, mapping: dict[str, str]) -> Column:
    """Dictionary lookup as a CASE; null when the key is absent."""
    chain: Column | None = None
    for key, label in mapping.items():
        hit = value == F.lit(key)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain


# ---- game state -------------------------------------------------------------------------------------------------


def state_flags(score_diff: Column) -> dict[str, Column]:
    return {
        "is_leading": score_diff > 0,
        "is_trailing": score_diff < 0,
        "is_drawing": score_diff == 0,
    }


def score_state(score_diff: Column) -> Column:
    behind, close_behind, level, close_ahead, ahead = C.SCORE_STATES
    d = score_diff.cast("int")
    return (
        F.when(d.between(-99, -2), behind)
        .when(d == -1, close_behind)
        .when(d == 0, level)
        .when(d == 1, close_ahead)
        .when(d.between(2, 99), ahead)
        .otherwise(C.UNKNOWN)
    )


def simple_state(leading: Column, trailing: Column, drawing: Column) -> Column:
    return (
        F.when(_true(leading), "Leading").when(_true(trailing), "Trailing").when(_true(drawing), "Drawing")
        .otherwise(C.UNKNOWN)
    )


def pressure_state(under_pressure: Column) -> Column:
    return F.when(_true(under_pressure), C.UNDER_PRESSURE).otherwise(C.NOT_UNDER_PRESSURE)


# ---- passes and chains ------------------------------------------------------------------------------------------


def pass_style(has_block: Column, cut_back: Column, through_ball: Column, switch: Column, cross: Column,
               height: Column, pass_type: Column) -> Column:
    return (
        F.when(~_true(has_block), "Assist Unknown")
        .when(_true(cut_back), "Cutback")
        .when(_true(through_ball), "Through Ball")
        .when(_true(switch), "Switch")
        .when(_true(cross), "Cross")
        .when(height == "High Pass", "High Pass")
        .when(height.isin("Ground Pass", "Low Pass"), "Ground Pass")
        .when(F.length(pass_type) > 0, pass_type)
        .otherwise("Other Pass")
    )


def chain_label(key_pass_id: Column, style: Column, previous_type: Column) -> Column:
    named = F.coalesce(style, F.lit("Assist Unknown"))
    lead = F.when(previous_type == "Duel", "Duel Win").when(F.length(previous_type) > 0, previous_type)
    return F.when(~_true(F.length(key_pass_id) > 0), "Unassisted").otherwise(
        F.concat(F.coalesce(lead, F.lit("Direct")), F.lit(" + "), named)
    )


def assist_category(play_pattern: Column, key_pass_id: Column, through_ball: Column, cut_back: Column,
                    cross: Column, height: Column) -> Column:
    pattern = F.trim(F.coalesce(play_pattern, F.lit("")))
    counter = pattern == C.COUNTER_PATTERN
    return (
        F.when(pattern.isin(C.ASSIST_SET_PIECE_PATTERNS), "Set Piece")
        .when(key_pass_id.isNull(), F.when(counter, "Counter (solo)").otherwise("Unassisted"))
        .when(counter, F.when(_true(through_ball), "Counter Through Ball").otherwise("Counter Attack"))
        .when(_true(cut_back), "Cutback")
        .when(_true(cross), "Cross")
        .when(_true(through_ball), "Through Ball")
        .when(height == "High Pass", "High Pass")
        .when(height.isin("Low Pass", "Ground Pass"), "Ground Pass")
        .when(height.isNull(), "Assist (unspecified)")
        .otherwise("Other Pass")
    )


def foot_finish(body_part: Column, preferred_foot: Column) -> Column:
    part = F.trim(F.when(F.length(body_part) > 0, body_part).otherwise(F.lit(C.UNKNOWN)))
    return (
        F.when(
            part.isin("Left Foot", "Right Foot"),
            F.when(preferred_foot.isNull(), "Footed shot (unknown preference)")
            .when(part == preferred_foot, "Strong Foot")
            .otherwise("Weak Foot"),
        )
        .when(F.lower(part).contains("head"), "Header")
        .when((part == C.UNKNOWN) | (part == ""), "Unknown body part")
        .otherwise(part)
    )


def recipient_zone(end_x: Column, end_y: Column, shot_x: Column, shot_y: Column,
                   pitch: C.PitchConfig = C.PITCH) -> Column:
    """Third and lane of the pass end; without a complete pass end, of the shot itself."""
    has_end = end_x.isNotNull() & end_y.isNotNull()
    x = F.when(has_end, end_x).otherwise(shot_x)
    y = F.when(has_end, end_y).otherwise(shot_y)
    half, lane = pitch.width / 2, pitch.width / 3
    third = F.when(x >= 80, "Final third").when(x >= 40, "Middle third").otherwise("Build-up third")
    side = F.when(y < lane, "Left").when(y > 2 * lane, "Right").otherwise("Central")
    return (
        F.when(x.isNull() | y.isNull(), "Unknown zone")
        .when((x >= pitch.length - 18) & y.between(half - 10.5, half + 10.5), "Penalty area")
        .otherwise(F.concat(third, F.lit(" - "), side))
    )


# ---- set pieces -------------------------------------------------------------------------------------------------


def set_piece_category(shot_type: Column, play_pattern: Column) -> Column:
    pattern = F.trim(F.coalesce(play_pattern, F.lit("")))
    return F.coalesce(
        lookup(F.trim(shot_type), C.SET_PIECE_BY_SHOT_TYPE),
        lookup(pattern, C.SET_PIECE_BY_PATTERN),
        F.when(pattern.startswith("From "), C.OTHER_RESTART),
        F.lit(C.OPEN_PLAY),
    )


def set_piece_group(category: Column) -> Column:
    return F.coalesce(lookup(category, C.SET_PIECE_GROUPS), F.lit(C.OPEN_PLAY))


def set_piece_phase(category: Column, key_pass_id: Column) -> Column:
    return (
        F.when(category.isin("Penalty", "Direct Free Kick"), "Direct")
        .when(category == C.OPEN_PLAY, C.OPEN_PLAY)
        .when(_true(F.length(key_pass_id) > 0), "First Phase")
        .otherwise("Second Phase")
    )


# ---- defensive triggers -----------------------------------------------------------------------------------------


def event_role(event_team: Column, shot_team: Column, opponent_team: Column) -> Column:
    return (
        F.when(event_team.isNull(), _null())
        .when(event_team == shot_team, "Own")
        .when(event_team == opponent_team, "Opponent")
        .otherwise("Other")
    )


def trigger_label(event_type: Column, role: Column | None, subtypes: list[Column], missing: str) -> Column:
    """"<role> <type> – <subtype>"; the role shows only for the other side, a null subtype adds nothing."""
    prefix = F.lit("")
    if role is not None:
        prefix = F.when(role == "Opponent", "Opponent ").when(role == "Other", "Other ").otherwise("")
    filled = [F.when(F.length(F.trim(s)) > 0, F.trim(s)) for s in subtypes]
    suffix = F.coalesce(*[F.concat(F.lit(" – "), s) for s in filled], F.lit("")) if filled else F.lit("")
    return F.when(~_true(F.length(event_type) > 0), missing).otherwise(F.concat(prefix, event_type, suffix))


def is_defensive_action(event_type: Column) -> Column:
    return _true(event_type.isin(C.DEFENSIVE_ACTIONS))


# ---- outcomes, keys, names --------------------------------------------------------------------------------------


def outcome_group(outcome: Column) -> Column:
    return F.coalesce(lookup(outcome, C.OUTCOME_GROUPS), F.lit("Other"))


def is_goal(outcome: Column) -> Column:
    return _true(F.lower(outcome) == "goal")


def season_key(season: Column) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(season, F.lit("")))), "- ", "/")


def is_holdout(competition_id: Column, season: Column, holdout_competition: int = 2,
               holdout_seasons: tuple[str, ...] = ("2015/2016", "2015/16")) -> Column:
    return _true((competition_id == holdout_competition) & season_key(season).isin(list(holdout_seasons)))


def home_flag(value: Column) -> Column:
    """Accepts booleans, "True"/"False" strings and 0/1; anything else is away."""
    return _true(F.lower(value.cast("string")).isin("true", "1", "1.0"))


def bucket_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit(C.UNKNOWN)) for p in parts])


def possession_state(same: Column) -> Column:
    return F.when(same.isNull(), C.UNKNOWN).when(same, "Same").otherwise("Different")


def slug(value: Column) -> Column:
    dashed = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "[^a-zA-Z0-9_-]+", "-")
    return F.lower(F.trim(dashed, F.lit("-")))


def team_label(name: Column, team_id: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("Team "), team_id.cast("string")))


# ---- dashboard archetypes ---------------------------------------------------------------------------------------


def team_archetype(style_attack: Column, style_defence: Column, avg_distance: Column, through_rate: Column,
                   cross_rate: Column) -> Column:
    att, dfc = F.coalesce(style_attack, F.lit(0.0)), F.coalesce(style_defence, F.lit(0.0))
    through, cross = F.coalesce(through_rate, F.lit(0.0)), F.coalesce(cross_rate, F.lit(0.0))
    return (
        F.when(att > 0.05, "high_press")
        .when((att < -0.1) & (through > 0.05), "counter")
        .when((cross > 0.25) | _true(avg_distance > 18), "direct")
        .when(dfc < -0.1, "defensive")
        .when((F.abs(att) < 0.05) & (F.abs(dfc) < 0.05), "balanced")
        .otherwise("possession")
    )


def shot_profile(dist: Column, body_part: Column, chain: Column, set_piece: Column, assist: Column) -> Column:
    def mentions(word: str) -> Column:
        return _true(chain.contains(word)) | _true(assist.contains(word))

    return (
        F.when(body_part == "Head", "aerial")
        .when(set_piece.isin(C.PROFILE_SET_PIECES), "set_piece")
        .when(dist > 22, "long_range")
        .when((dist < 10) & mentions("Cutback"), "poacher")
        .when(mentions("Through Ball"), "counter_shot")
        .when(dist < 12, "poacher")
        .otherwise("creator")
    )
