"""Match, season, player and team tables, and the dashboard summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.labels import lookup, shot_profile, team_archetype
from touchline.operators.joins import require_columns


def match_table(scored: DataFrame, prediction: str = "cxg_prediction", xg: str = "statsbomb_xg",
                goal: str = "is_goal") -> DataFrame:
    """Totals per match side."""
    require_columns(scored, ["match_id", "team_id", "opponent_team_id", goal, prediction, xg])
    out = scored.groupBy("match_id", "team_id", "opponent_team_id").agg(
        F.sum(prediction).alias("cxg_total"),
        F.sum(F.col(goal).cast("long")).alias("goals"),
        F.sum(xg).alias("provider_xg"),
        F.count(F.lit(1)).alias("shots"),
    )
    return out.withColumns(
        {"cxg_delta": F.col("goals") - F.col("cxg_total"), "provider_delta": F.col("goals") - F.col("provider_xg")}
    )


def season_table(matches: DataFrame) -> DataFrame:
    """Team totals for and against over the matches of ``match_table``."""
    scored = matches.groupBy("team_id").agg(
        F.countDistinct("match_id").alias("matches"),
        F.sum("shots").alias("shots_for"),
        F.sum("cxg_total").alias("cxg_for"),
        F.sum("provider_xg").alias("provider_xg_for"),
        F.sum("goals").alias("goals_for"),
    )
    allowed = matches.groupBy(F.col("opponent_team_id").alias("team_id")).agg(
        F.sum("shots").alias("shots_against"),
        F.sum("cxg_total").alias("cxg_against"),
        F.sum("provider_xg").alias("provider_xg_against"),
        F.sum("goals").alias("goals_against"),
    )
    joined = scored.join(allowed, "team_id", "left").fillna(
        0, subset=["shots_against", "cxg_against", "provider_xg_against", "goals_against"]
    )
    return joined.withColumns(
        {
            "cxg_diff": F.col("cxg_for") - F.col("cxg_against"),
            "goals_minus_cxg": F.col("goals_for") - F.col("cxg_for"),
            "goal_diff": F.col("goals_for") - F.col("goals_against"),
        }
    )


def finishing_delta(season: DataFrame) -> DataFrame:
    """Teams by goals minus expected goals, best first."""
    return season.select(
        "team_id", "goals_for", "cxg_for", (F.col("goals_for") - F.col("cxg_for")).alias("finishing_delta")
    ).orderBy(F.col("finishing_delta").desc(), "team_id")


def entity_aggregates(scored: DataFrame, key: str, prediction: str, neutral: str) -> DataFrame:
    """Player or team totals of raw and neutral predictions."""
    diff = F.col(prediction) - F.col(neutral)
    return scored.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("shots_count"),
        F.sum(prediction).alias("summed_cxg"),
        F.sum(neutral).alias("summed_neutral_cxg"),
        F.sum(diff).alias("summed_diff"),
        F.avg(diff).alias("avg_diff"),
    )


def top_entities(aggregates: DataFrame, key: str, k: int, names: DataFrame | None = None) -> DataFrame:
    """The k entities with the largest summed value, with names when a name table is given."""
    top = aggregates.orderBy(F.col("summed_cxg").desc(), key).limit(k)
    return top if names is None else top.join(names, key, "left")


def shot_predictions(predictions: DataFrame, shots: DataFrame, model: DataFrame, only_neutral: bool | None = None) -> DataFrame:
    """Shots with the predictions of one model of the registry."""
    rows = predictions.join(model.select("model_id"), "model_id", "left_semi")
    if only_neutral is not None:
        rows = rows.where(F.col("is_neutralized") == only_neutral)
    return shots.join(rows, "shot_id")


def team_style(shots: DataFrame, chain: str | None = "chain_label", goal: str = "is_goal",
               xg: str = "statsbomb_xg") -> DataFrame:
    """Team means, totals and chain-type rates, with the archetype decided on values rounded half-even to 4."""
    aggs = [
        F.bround(F.avg("style_att_component"), 4).alias("style_attack"),
        F.bround(F.avg("style_def_component"), 4).alias("style_defense"),
        F.bround(F.avg("finishing_bias_logit"), 4).alias("finishing_bias"),
        F.bround(F.avg("shot_distance"), 4).alias("avg_distance"),
        F.sum(F.col(goal).cast("long")).alias("goals"),
        F.count(F.lit(1)).alias("shots"),
        F.bround(F.avg(F.col(goal).cast("int")), 4).alias("goal_rate"),
        F.bround(F.sum(xg), 4).alias("total_xg"),
        F.bround(F.avg(xg), 4).alias("avg_xg"),
    ]
    for name, word in (("through_ball_rate", "Through Ball"), ("cross_rate", "Cross"), ("cutback_rate", "Cutback")):
        if chain is None:
            aggs.append(F.lit(0.0).alias(name))
        else:
            aggs.append(F.avg(F.col(chain).contains(word).cast("int")).alias(name))
    stats = shots.groupBy("team_id").agg(*aggs)
    kind = team_archetype(
        F.col("style_attack"), F.col("style_defense"), F.col("avg_distance"), F.col("through_ball_rate"), F.col("cross_rate")
    )
    return stats.withColumn("archetype", kind).withColumn("archetype_name", lookup(F.col("archetype"), C.TEAM_ARCHETYPES))


def with_shot_profile(shots: DataFrame) -> DataFrame:
    kind = shot_profile(
        F.col("shot_distance"), F.col("shot_body_part"), F.col("chain_label"), F.col("set_piece_category"), F.col("assist_category")
    )
    return shots.withColumn("shot_profile", kind).withColumn(
        "profile_name", lookup(F.col("shot_profile"), {k: n for k, (n, _) in C.SHOT_PROFILES.items()})
    )


def shot_profile_summary(shots: DataFrame, goal: str = "is_goal", xg: str = "statsbomb_xg") -> DataFrame:
    stats = shots.groupBy("shot_profile").agg(
        F.sum(F.col(goal).cast("long")).alias("goals"),
        F.count(F.lit(1)).alias("shots"),
        F.bround(F.avg(F.col(goal).cast("int")), 3).alias("goal_rate"),
        F.bround(F.sum(xg), 3).alias("total_xg"),
        F.bround(F.avg(xg), 3).alias("avg_xg"),
        F.bround(F.avg("shot_distance"), 3).alias("avg_distance"),
    )
    return stats.withColumns(
        {
            "name": lookup(F.col("shot_profile"), {k: n for k, (n, _) in C.SHOT_PROFILES.items()}),
            "description": lookup(F.col("shot_profile"), {k: d for k, (_, d) in C.SHOT_PROFILES.items()}),
        }
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def row_counts(tables: dict[str, DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Lineage report: rows per table."""
    frames = [t.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name)) for name, t in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
