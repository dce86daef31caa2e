"""Opponent defensive ratings with shrinkage towards the team's overall level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.config import RATING_PRIOR_SHOTS, ZONES
from touchline.functions.numeric import shrink


def opponent_profile(shots: DataFrame, team: str = "opponent_team_id", xg: str = "statsbomb_xg",
                     blocked: str = "is_blocked", zone: str = "zone_id",
                     prior: float = RATING_PRIOR_SHOTS) -> DataFrame:
    """One overall row (zone null) and six zone rows per defending team.

    One aggregation by (team, zone) feeds both levels: the overall row is the roll-up of its zone rows, so the shot table
    is shuffled once and only after partial aggregation.
    """
    block = F.when(F.col(blocked), 1).otherwise(0)
    cells = (
        shots.where(F.col(team).isNotNull() & F.col(xg).isNotNull())
        .groupBy(F.col(team).alias("team_id"), F.col(zone).alias("zone_id"))
        .agg(F.sum(xg).alias("sxg"), F.count(F.lit(1)).alias("n"), F.sum(block).alias("blocks"))
    )
    by_zone = [
        F.map_from_entries(F.collect_list(F.when(F.col("zone_id").isNotNull(), F.struct("zone_id", F.struct("sxg", "n", "blocks"))))).alias("z")
    ]
    teams = cells.groupBy("team_id").agg(
        F.sum("sxg").alias("sxg"), F.sum("n").alias("n"), F.sum("blocks").alias("blocks"), *by_zone
    )
    mean = F.col("sxg") / F.col("n")
    rate = F.col("blocks") / F.col("n")
    rows = teams.select(
        "team_id", mean.alias("mean"), rate.alias("rate"), F.col("n").alias("total"), "z",
        F.explode(F.array(F.lit(None).cast("string"), *[F.lit(z) for z in ZONES])).alias("zone_id"),
    ).withColumn("cell", F.when(F.col("zone_id").isNotNull(), F.try_element_at("z", F.col("zone_id"))))
    n_zone = F.coalesce(F.col("cell.n"), F.lit(0))
    zone_mean = F.when(n_zone > 0, F.col("cell.sxg") / F.col("cell.n")).otherwise(F.col("mean"))
    overall = F.col("zone_id").isNull()
    return rows.select(
        "team_id",
        "zone_id",
        F.when(overall, -F.col("mean")).alias("global_rating"),
        F.when(~overall, -shrink(n_zone, zone_mean, F.col("mean"), prior)).alias("zone_rating"),
        F.when(overall | (n_zone == 0), F.col("rate")).otherwise(F.col("cell.blocks") / F.col("cell.n")).alias("block_rate"),
        F.when(overall, F.col("total")).otherwise(n_zone).cast("long").alias("shots_sample"),
    )
