"""Modelling filters with their audit, and the evaluation slices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.joins import first_rows, salted_join

KEPT = "kept"


def modelling_rules(columns: Sequence[str], drop_penalties: bool = True, require_geometry: bool = True,
                    require_location: bool = True, require_xg: bool = True,
                    in_scope: Column | None = None) -> dict[str, Column]:
    """Removal rules in the order they apply. Rules over absent columns are left out."""
    def missing(*names: str) -> Column:
        cond = F.lit(False)
        for n in names:
            cond = cond | F.col(n).isNull()
        return cond

    rules: dict[str, Column] = {}
    if require_geometry:
        rules["removed_missing_geometry"] = missing("shot_distance", "shot_angle")
    if require_location:
        rules["removed_missing_location"] = missing("location_x", "location_y")
    if require_xg and "statsbomb_xg" in columns:
        rules["removed_missing_xg"] = missing("statsbomb_xg")
    if drop_penalties and "set_piece_category" in columns:
        rules["removed_penalties"] = F.col("set_piece_category") == "Penalty"
    if "shot_outcome" in columns:
        rules["removed_own_goals"] = F.lower("shot_outcome") == "own goal"
    if in_scope is not None:
        rules["removed_out_of_scope"] = ~F.coalesce(in_scope, F.lit(False))
    return rules


def with_first_failure(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Name of the first rule a row fails, or "kept": sequential counts in one pass."""
    chain: Column | None = None
    for name, cond in rules.items():
        hit = F.coalesce(cond, F.lit(False))
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return df.withColumn("filter_rule", chain.otherwise(F.lit(KEPT)) if chain is not None else F.lit(KEPT))


def with_scope_flag(df: DataFrame, allowed: DataFrame, key: str = "match_id", spread: str = "shot_id") -> DataFrame:
    flags = allowed.select(key).distinct().withColumn("__in_scope", F.lit(True))
    return salted_join(df, flags, [key], "left", [spread]).withColumn("__in_scope", F.coalesce("__in_scope", F.lit(False)))


def apply_modelling_filters(df: DataFrame, allowed: DataFrame | None = None, key: str = "shot_id", order: Sequence[str] = (),
                            **options: bool) -> DataFrame:
    """Rows that pass every rule, one per shot: the first by ``order``, then the same one in every run."""
    scoped = df if allowed is None else with_scope_flag(df, allowed)
    in_scope = None if allowed is None else F.col("__in_scope")
    marked = with_first_failure(scoped, modelling_rules(df.columns, in_scope=in_scope, **options))
    return marked.where(F.col("filter_rule") == KEPT).select(*df.columns).transform(first_rows, [key], order)


def filter_audit(df: DataFrame, allowed: DataFrame | None = None, **options: bool) -> DataFrame:
    """Row counts per rule, with totals before and after."""
    scoped = df if allowed is None else with_scope_flag(df, allowed)
    in_scope = None if allowed is None else F.col("__in_scope")
    rules = modelling_rules(df.columns, in_scope=in_scope, **options)
    marked = with_first_failure(scoped, rules)
    names = [
        "removed_missing_geometry", "removed_missing_location", "removed_missing_xg",
        "removed_penalties", "removed_own_goals", "removed_out_of_scope",
    ]
    return marked.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col("filter_rule") == n).alias(n) for n in names],
        F.count_if(F.col("filter_rule") == KEPT).alias("total_after"),
    )


def evaluation_slices() -> dict[str, tuple[str, Column]]:
    """Slice name -> (description, predicate). Nulls: minute and score count as 0, distance as far and near at once
    (infinite for the close slice, 0 for the long one), and a missing category counts as a set piece."""
    state = F.lower(F.coalesce(F.col("pressure_state"), F.lit("")))
    diff = F.coalesce(F.col("score_diff_at_shot"), F.lit(0))
    minute = F.coalesce(F.col("minute"), F.lit(0))
    dist = F.col("shot_distance")
    open_play = F.coalesce(F.lower("set_piece_category") == "open play", F.lit(False))
    return {
        "overall": ("All shots", F.lit(True)),
        "under_pressure": ("Shots under pressure", state == "under pressure"),
        "not_under_pressure": ("Shots not under pressure", state == "not under pressure"),
        "leading": ("Team leading", diff > 0),
        "trailing": ("Team trailing", diff < 0),
        "drawing": ("Score level", diff == 0),
        "first_half": ("Minutes 0-45", minute < 46),
        "second_half": ("Minutes 46+", minute >= 46),
        "close_range": ("Shot distance ≤ 12m", F.coalesce(dist <= 12.0, F.lit(False))),
        "long_range": ("Shot distance ≥ 20m", F.coalesce(dist >= 20.0, F.lit(False))),
        "set_piece": ("Set piece phases", ~open_play),
        "open_play": ("Open play shots", open_play),
    }


def slice_names(slices: Mapping[str, tuple[str, Column]] | None = None) -> Column:
    """The names of the slices that a row is in, as an array."""
    slices = evaluation_slices() if slices is None else slices
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, (_, cond) in slices.items()]))


def explode_slices(df: DataFrame, slices: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """One row per (row, slice it belongs to), keeping only the slices that apply."""
    return df.withColumn("slice", F.explode(slice_names(slices)))


def drop_empty_features(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the given columns that exist and hold at least one value: one aggregation, one result row."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return []
    seen = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in present]).first()
    return [c for c in present if seen[c]]


def time_split(date: Column, train_until: str = "2022-06-01", validate_until: str = "2022-12-01") -> Column:
    """Train before the first date, validate up to the second (inclusive), test after it."""
    day = F.to_date(date)
    return (
        F.when(day < F.lit(train_until).cast("date"), "train")
        .when(day <= F.lit(validate_until).cast("date"), "validation")
        .when(day.isNotNull(), "test")
    )


def competition_split(name: Column, assignment: Mapping[str, Sequence]) -> Column:
    """Split by competition; competitions not named are left out (null)."""
    chain: Column | None = None
    for split, values in assignment.items():
        hit = name.isin(list(values))
        chain = F.when(hit, F.lit(split)) if chain is None else chain.when(hit, F.lit(split))
    return chain
