"""Per-match and per-possession sequence features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.config import RECENT_DEFENSIVE_TYPES
from touchline.functions.labels import is_goal, state_flags
from touchline.operators.blocks import DEFAULT_POLICY, OrderedScan, SplitDecision, SplitPolicy


def running_score(shots: DataFrame, match: str, team: str, order: Sequence[str], goal: Column,
                  policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Score difference from the shooting team's view just before each shot, with the state flags.

    A match has two teams, so the difference is twice the own goals minus all goals so far.
    """
    scored = F.when(goal, F.lit(1)).otherwise(F.lit(0)).cast("long")
    scan = (
        OrderedScan(shots, [match], order, policy)
        .running_sum("__own", scored, within=[team])
        .running_sum("__all", scored)
        .result()
    )
    diff = (F.lit(2) * F.col("__own") - F.col("__all")).cast("int")
    return scan.withColumn("score_diff_at_shot", diff).drop("__own", "__all").withColumns(
        state_flags(F.col("score_diff_at_shot"))
    )


def counts_as_goal(outcome: Column, event_type: Column | None = None, period: Column | None = None,
                   include_own_goals: bool = False, exclude_shootout: bool = False) -> Column:
    """Goal rule for the running score. By default only a shot outcome "Goal" counts, in any period."""
    goal = is_goal(outcome)
    if include_own_goals and event_type is not None:
        goal = goal | F.coalesce(event_type == "Own Goal For", F.lit(False))
    if exclude_shootout and period is not None:
        goal = goal & ~F.coalesce(period == 5, F.lit(False))
    return goal


def possession_features(events: DataFrame, keys: Sequence[str], order: Sequence[str], clock: str,
                        event_type: str, lookback: int = 5, recent_types: Sequence[str] = RECENT_DEFENSIVE_TYPES,
                        policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Sequence length, elapsed time, gap to the previous action and recent defensive actions in the possession."""
    action = F.when(F.col(event_type).isin(list(recent_types)), 1).otherwise(0).cast("long")
    scan = (
        OrderedScan(events, keys, order, policy)
        .row_number("possession_sequence_length")
        .first_seen("__start", F.col(clock))
        .last_seen("__before", F.col(clock), inclusive=False)
        .previous_rows("__recent", "sum", action, lookback)
        .result()
    )
    zero = F.lit(0)
    return scan.withColumns(
        {
            "possession_duration": F.greatest(zero, F.col(clock) - F.col("__start")).cast("double"),
            "previous_action_gap": F.greatest(zero, F.coalesce(F.col(clock) - F.col("__before"), zero)).cast("double"),
            "recent_def_actions_count": F.coalesce(F.col("__recent"), zero).cast("long"),
        }
    ).drop("__start", "__before", "__recent")


def possessions(events: DataFrame, match: str, possession: str, team: str, clock: str, seq: str) -> DataFrame:
    """One row per possession: owning team (of the first event), span, duration and number of events."""
    first = F.min_by(F.col(team), F.struct(clock, seq))
    return (
        events.where(F.col(possession).isNotNull())
        .groupBy(match, possession)
        .agg(
            first.alias(team),
            F.min(clock).alias("start_seconds"),
            F.max(clock).alias("end_seconds"),
            F.count(F.lit(1)).alias("event_count"),
        )
        .withColumn("duration_seconds", (F.col("end_seconds") - F.col("start_seconds")).cast("double"))
    )


def dominant_foot(shots: DataFrame, player: str, body_part: str) -> DataFrame:
    """Strict majority of left against right per player; a tie or no footed shot gives null."""
    left, right = F.count_if(F.col(body_part) == "Left Foot"), F.count_if(F.col(body_part) == "Right Foot")
    return (
        shots.where(F.col(player).isNotNull())
        .groupBy(player)
        .agg(left.alias("left_shots"), right.alias("right_shots"))
        .withColumn(
            "preferred_foot",
            F.when(F.col("left_shots") > F.col("right_shots"), "Left Foot").when(
                F.col("right_shots") > F.col("left_shots"), "Right Foot"
            ),
        )
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key. An aggregate with partial results, so a hot key never meets in one task unreduced."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    return (
        df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(*df.columns)
    )
