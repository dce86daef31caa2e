"""Leakage-aware priors: rolling team form, playing style, player form, and their combination into log-odds offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.labels import is_holdout
from touchline.functions.numeric import clip, logit, safe_ratio
from touchline.operators.clusters import Clusters
from touchline.operators.blocks import DEFAULT_POLICY, OrderedScan, SplitDecision, SplitPolicy, decide
from touchline.operators.joins import require_columns
from touchline.operators.quantiles import medians
from touchline.operators.sequences import first_rows
from touchline.plans.staging import written

_MEASURES = {"goals": "goals", "shots": "shots", "xg": "xg"}


def match_sides(shots: DataFrame) -> DataFrame:
    """One row per match side with volume, conversion and shot profile. Null keys form their own groups."""
    keys = [
        "match_id", "team_id", "opponent_team_id", "match_date", "is_home",
        "competition_id", "competition_season", "competition_statsbomb_id",
    ]
    require_columns(shots, [*keys, "statsbomb_xg", "is_goal", "shot_distance", "pressure_state", "set_piece_category"])
    pressed = F.coalesce(F.col("pressure_state") == C.UNDER_PRESSURE, F.lit(False))
    dead_ball = F.coalesce(F.col("set_piece_category"), F.lit(C.OPEN_PLAY)) != C.OPEN_PLAY
    out = shots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("shots_for"),
        F.sum(F.col("is_goal").cast("long")).alias("goals_for"),
        F.sum("statsbomb_xg").alias("xg_for"),
        F.avg("shot_distance").alias("avg_shot_distance"),
        F.avg(pressed.cast("int")).alias("under_pressure_rate"),
        F.avg(dead_ball.cast("int")).alias("set_piece_share"),
    )
    out = out.withColumns(
        {
            "is_home": F.coalesce("is_home", F.lit(False)),
            "competition_season": F.coalesce("competition_season", F.lit(C.UNKNOWN)),
            "competition_statsbomb_id": F.coalesce("competition_statsbomb_id", F.lit(-1)).cast("int"),
        }
    )
    return out.withColumns(
        {
            "competition_season_key": F.concat_ws("-", F.col("competition_statsbomb_id").cast("string"), "competition_season"),
            "is_holdout": is_holdout(F.col("competition_statsbomb_id"), F.col("competition_season")),
        }
    )


def with_against(sides: DataFrame) -> DataFrame:
    """Attach the opponent's volume in the same match; null when the opponent has no shot."""
    other = sides.select(
        "match_id",
        F.col("team_id").alias("opponent_team_id"),
        F.col("shots_for").alias("shots_against"),
        F.col("goals_for").alias("goals_against"),
        F.col("xg_for").alias("xg_against"),
    )
    return sides.join(other, ["match_id", "opponent_team_id"], "left")


def rolling_form(sides: DataFrame, windows: Sequence[int] = C.ROLLING_WINDOWS,
                 policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Match number in the season and sums over the previous matches, for and against. Only earlier matches count.

    ``sides`` are the rows of ``match_sides``; they are written once, for their group sizes are read before the join with the opponent's rows.
    """
    sides = written(sides)
    key = ["competition_season_key", "team_id"]
    decision = decide(sides, key, policy)
    dated = with_against(sides).withColumn("__undated", F.col("match_date").isNull())
    scan = OrderedScan(
        dated, key, ["__undated", "match_date", "match_id", "opponent_team_id"], decision
    ).running_sum("match_number", F.lit(1).cast("long"))
    for w in windows:
        for prefix, suffix in (("att", "for"), ("def", "against")):
            for m in _MEASURES:
                scan = scan.previous_rows(f"{prefix}_{m}_window_{w}", "sum", F.col(f"{m}_{suffix}"), w)
    return scan.result().drop("__undated")


def rolling_bias(form: DataFrame, windows: Sequence[int] = C.ROLLING_WINDOWS) -> DataFrame:
    """Log-odds gap between actual and expected conversion per window, combined by sample size."""
    cols: dict[str, Column] = {}
    for prefix in ("att", "def"):
        for w in windows:
            goals, shots, xg = (F.col(f"{prefix}_{m}_window_{w}") for m in ("goals", "shots", "xg"))
            actual = F.coalesce(safe_ratio(goals, shots), F.lit(0.0))
            expected = F.coalesce(safe_ratio(xg, shots), F.lit(0.0))
            cols[f"{prefix}_delta_{w}"] = logit(actual) - logit(expected)
            cols[f"{prefix}_weight_{w}"] = F.coalesce(clip(shots / F.lit(w * C.SHOTS_PER_MATCH), 0.0, 1.0), F.lit(0.0))
    out = form.withColumns(cols)
    combined: dict[str, Column] = {}
    for prefix in ("att", "def"):
        weight = sum((F.col(f"{prefix}_weight_{w}") for w in windows), F.lit(0.0))
        weighted = sum((F.col(f"{prefix}_delta_{w}") * F.col(f"{prefix}_weight_{w}") for w in windows), F.lit(0.0))
        value = F.when(weight > 0, weighted / weight).otherwise(F.lit(0.0))
        combined[f"{prefix}_rolling_component"] = clip(value, -C.MAX_LOGIT, C.MAX_LOGIT)
        combined[f"{prefix}_rolling_reliability"] = clip(weight / F.lit(float(len(windows))), 0.0, 1.0)
    return out.withColumns(combined)


# ---- style ------------------------------------------------------------------------------------------------------


def possession_share(possessions: DataFrame) -> DataFrame:
    """Share of the summed possession time per match side; null when a match has none."""
    side = possessions.groupBy("match_id", "team_id").agg(
        F.sum(F.coalesce("duration_seconds", F.lit(0.0))).alias("duration_seconds")
    )
    total = F.sum("duration_seconds").over(W.partitionBy("match_id"))
    share = F.when(total > 0, F.col("duration_seconds") / total)
    return side.withColumn("possession_share", share)


def defensive_style(events: DataFrame) -> DataFrame:
    """Pressing volume and height and the height of the defensive line, per match side."""
    press = F.col("type") == "Pressure"
    return (
        events.where(F.col("type").isin(C.STYLE_DEFENSIVE_TYPES))
        .groupBy("match_id", "team_id")
        .agg(
            F.count_if(press).alias("pressure_events"),
            F.avg(F.when(press, F.col("location_x"))).alias("pressure_location"),
            F.avg("location_x").alias("def_line_location"),
        )
    )


STYLE_FEATURES = ["possession_share", "press_intensity", "avg_shot_distance", "def_line_height", "press_height"]


def style_features(sides: DataFrame, possessions: DataFrame, events: DataFrame) -> DataFrame:
    """Five style features per match side. Gaps take the exact median, then a constant."""
    middle = F.lit(C.PITCH.length / 2)
    joined = sides.join(
        possession_share(possessions).select("match_id", "team_id", "possession_share"), ["match_id", "team_id"], "left"
    ).join(defensive_style(events), ["match_id", "team_id"], "left")
    raw = joined.withColumns(
        {
            "press_intensity": F.coalesce("pressure_events", F.lit(0)) / F.lit(C.MATCH_MINUTES),
            "press_height": F.coalesce("pressure_location", middle) / F.lit(C.PITCH.length),
            "def_line_height": F.coalesce("def_line_location", middle) / F.lit(C.PITCH.length),
        }
    )
    mid = medians(raw, ["possession_share", "avg_shot_distance"])
    return raw.withColumns(
        {
            "possession_share": F.coalesce("possession_share", mid.select("possession_share").scalar(), F.lit(0.5)),
            "avg_shot_distance": F.coalesce("avg_shot_distance", mid.select("avg_shot_distance").scalar(), F.lit(18.0)),
        }
    ).drop("pressure_events", "pressure_location", "def_line_location")


def style_bias(clustered: DataFrame, train: Column, cluster: str = "style_cluster") -> DataFrame:
    """Attack and defence bias of each style cluster, from its training rows, attached to every row."""
    def sums(kind: str, side: str) -> list[Column]:
        return [F.sum(F.when(train, F.col(f"{m}_{side}"))).alias(f"{kind}_{m}") for m in ("goals", "shots", "xg")]

    stats = clustered.groupBy(cluster).agg(*sums("att", "for"), *sums("def", "against"))

    def bias(kind: str) -> Column:
        rate = F.coalesce(safe_ratio(F.col(f"{kind}_goals"), F.col(f"{kind}_shots")), F.lit(0.0))
        expected = F.coalesce(safe_ratio(F.col(f"{kind}_xg"), F.col(f"{kind}_shots")), F.lit(0.0))
        return F.when(F.col("att_shots").isNull(), F.lit(0.0)).otherwise(logit(rate) - logit(expected))

    table = stats.select(cluster, bias("att").alias("style_att_bias"), bias("def").alias("style_def_bias"))
    # one row per cluster, at most STYLE_CLUSTERS of them
    return clustered.join(F.broadcast(table), cluster, "left").withColumn(
        "style_reliability", clip(F.col("match_number") / F.lit(C.STYLE_FULL_MATCHES), 0.0, 1.0)
    )


# ---- players ----------------------------------------------------------------------------------------------------


def player_form(shots: DataFrame, window: int = C.PLAYER_WINDOW,
                policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Goal and xG rate over the player's previous shots; overall means before the first one."""
    overall = shots.agg(F.avg(F.col("is_goal").cast("int")).alias("g"), F.avg("statsbomb_xg").alias("x"))
    base = shots.where(F.col("player_id").isNotNull()).select(
        "shot_id", "match_id", "team_id", "player_id", "match_date", "statsbomb_xg", "is_goal"
    ).withColumn("__undated", F.col("match_date").isNull())
    scan = (
        OrderedScan(base, ["player_id"], ["__undated", "match_date", "match_id", "shot_id"], policy)
        .previous_rows("__goal", "avg", F.col("is_goal").cast("int"), window)
        .previous_rows("__xg", "avg", F.col("statsbomb_xg"), window)
        .previous_rows("__n", "count", F.col("shot_id"), window)
        .result()
    )
    return scan.select(
        "shot_id", "match_id", "team_id", "player_id",
        F.coalesce("__goal", overall.select("g").scalar()).alias("player_goal_rate"),
        F.coalesce("__xg", overall.select("x").scalar()).alias("player_xg_rate"),
        F.coalesce("__n", F.lit(0)).cast("double").alias("player_shot_volume"),
    ).withColumn("player_lift", F.col("player_goal_rate") - F.col("player_xg_rate"))


def player_sides(form: DataFrame, top: int = C.PLAYER_TOP_N, window: int = C.PLAYER_WINDOW) -> DataFrame:
    """Match-side player component: mean of the best players' lift, scaled by how much is known about them.

    Each player enters with their first shot of the match. Ranking keeps only the top rows before the shuffle.
    """
    snapshot = first_rows(form, ["match_id", "team_id", "player_id"], ["shot_id"])
    sides = snapshot.groupBy("match_id", "team_id").agg(F.sum("player_shot_volume").alias("player_volume"))
    best = W.partitionBy("match_id", "team_id").orderBy(F.col("player_lift").desc(), "player_id")
    leaders = (
        snapshot.withColumn("__rank", F.row_number().over(best))
        .where(F.col("__rank") <= top)
        .groupBy("match_id", "team_id")
        .agg(F.avg("player_lift").alias("player_bias_top3"))
    )
    reliability = clip(F.col("player_volume") / F.lit(float(window * top)), 0.0, 1.0)
    return sides.join(leaders, ["match_id", "team_id"]).withColumn("player_reliability", reliability).withColumn(
        "player_component", F.col("player_bias_top3") * F.col("player_reliability")
    )


# ---- combination ------------------------------------------------------------------------------------------------


def combine_priors(form: DataFrame, style: DataFrame, players: DataFrame) -> DataFrame:
    """Weighted sum of the components on the log-odds scale, clipped, with its multiplier."""
    keys = ["match_id", "team_id"]
    joined = (
        form.join(style.select(*keys, "style_cluster", "style_att_bias", "style_def_bias", "style_reliability"), keys, "left")
        .join(players.select(*keys, "player_component", "player_reliability"), keys, "left")
        .fillna(0.0, subset=["player_component", "player_reliability", "style_att_bias", "style_def_bias", "style_reliability"])
    )
    joined = joined.withColumns(
        {
            "style_att_component": F.col("style_att_bias") * F.col("style_reliability"),
            "style_def_component": F.col("style_def_bias") * F.col("style_reliability"),
        }
    )
    fw, cw = C.FINISHING_WEIGHTS, C.CONCESSION_WEIGHTS
    finishing = (
        F.lit(fw["rolling"]) * F.coalesce("att_rolling_component", F.lit(0.0))
        + F.lit(fw["style"]) * F.col("style_att_component")
        + F.lit(fw["player"]) * F.col("player_component")
    )
    concession = (
        F.lit(cw["rolling"]) * F.coalesce("def_rolling_component", F.lit(0.0))
        + F.lit(cw["style"]) * F.col("style_def_component")
    )
    return joined.withColumns(
        {
            "finishing_bias_logit": clip(finishing, -C.MAX_LOGIT, C.MAX_LOGIT),
            "concession_bias_logit": clip(concession, -C.MAX_LOGIT, C.MAX_LOGIT),
        }
    ).withColumns(
        {
            "finishing_bias_multiplier": F.exp("finishing_bias_logit"),
            "concession_bias_multiplier": F.exp("concession_bias_logit"),
        }
    )


_PRIOR_KEYS = ["match_id", "match_date", "is_home", "competition_season_key", "competition_statsbomb_id", "competition_season"]


def finishing_prior_table(context: DataFrame) -> DataFrame:
    return context.select(
        *_PRIOR_KEYS, "att_rolling_component", "style_att_component", "player_component",
        "finishing_bias_logit", "finishing_bias_multiplier",
    ).withColumn("match_date", F.date_format("match_date", "yyyy-MM-dd"))


def concession_prior_table(context: DataFrame) -> DataFrame:
    return context.select(
        *_PRIOR_KEYS, "def_rolling_component", "style_def_component", "concession_bias_logit", "concession_bias_multiplier",
    ).withColumn("match_date", F.date_format("match_date", "yyyy-MM-dd"))


def prior_summary(context: DataFrame, clusters: Clusters | None = None) -> DataFrame:
    """One row about the priors of all sides; with ``clusters`` also how many there are and their inertia."""
    summary = _prior_summary(context)
    if clusters is None:
        return summary
    return summary.withColumns({"cluster_count": F.lit(clusters.count).cast("long"), "inertia": F.lit(clusters.inertia)})


def _prior_summary(context: DataFrame) -> DataFrame:
    return context.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.avg("finishing_bias_logit").alias("finishing_bias_logit_mean"),
        F.avg("concession_bias_logit").alias("concession_bias_logit_mean"),
        F.avg((F.abs("player_component") > 1e-6).cast("int")).alias("player_coverage"),
        F.count_if("is_holdout").alias("excluded_rows"),
    )
