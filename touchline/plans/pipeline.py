"""From the modelling dataset to priors, enriched shots, fitted models, scored tables and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions import labels as L
from touchline.functions.numeric import bin_left_closed
from touchline.operators import priors as R
from touchline.operators.blocks import DEFAULT_POLICY, SplitDecision, SplitPolicy
from touchline.operators.filters import apply_modelling_filters
from touchline.operators.joins import attach_bucket_prior, attach_side_prior
from touchline.operators.metrics import provider_prediction, slice_metrics, with_slice_description
from touchline.operators.model import BucketSpec, FittedModel, cluster_styles, fit_bucket_models
from touchline.operators.reports import match_table, season_table
from touchline.plans.staging import written

Policy = SplitPolicy | SplitDecision


# ---- buckets ----------------------------------------------------------------------------------------------------


def pressure_buckets(df: DataFrame, angle_unit: str = "radians") -> DataFrame:
    """Distance and angle bins. The angle edges are 20 and 40; with radians, as published, every shot is in the first."""
    angle = F.degrees("shot_angle") if angle_unit == "degrees" else F.col("shot_angle")
    return df.withColumns(
        {
            "distance_bin": bin_left_closed(F.col("shot_distance"), C.PRESSURE_DISTANCE_EDGES, C.PRESSURE_DISTANCE_LABELS, C.UNKNOWN),
            "angle_bin": bin_left_closed(angle, C.PRESSURE_ANGLE_EDGES, C.PRESSURE_ANGLE_LABELS, C.UNKNOWN),
        }
    )


def trigger_buckets(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "time_gap_bucket": bin_left_closed(F.col("time_gap_seconds"), C.TIME_GAP_EDGES, C.TIME_GAP_LABELS, C.UNKNOWN),
            "possession_state": L.possession_state(F.col("possession_match")),
        }
    )


# ---- sub-models -------------------------------------------------------------------------------------------------


BUCKET_SPECS = [
    BucketSpec("set_piece", C.SET_PIECE_BUCKET, 15, ["set_piece_category"]),
    BucketSpec("assist_quality", C.ASSIST_BUCKET, 25, []),
    BucketSpec("pressure", C.PRESSURE_BUCKET, 25, ["pressure_state", "shot_distance", "shot_angle"]),
    BucketSpec("def_trigger", C.TRIGGER_BUCKET, 25, ["def_label", "time_gap_seconds", "possession_match"]),
]


def bucket_priors(dataset: DataFrame, angle_unit: str = "radians") -> dict[str, DataFrame]:
    """The four bucket tables, fitted side by side from one scan of the dataset and written once: every later use reads a few rows."""
    tables, _ = fit_bucket_models(trigger_buckets(pressure_buckets(dataset, angle_unit)), BUCKET_SPECS)
    return {name: written(table) for name, table in tables.items()}


def side_priors(dataset: DataFrame, possessions: DataFrame, events: DataFrame, include_holdout: bool = False,
                policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Finishing and concession priors per match side. The holdout season is kept out of the style fit by default."""
    form = R.rolling_bias(R.rolling_form(R.match_sides(dataset), policy=policy))
    style = R.style_features(form, possessions, events)
    train = F.lit(True) if include_holdout else ~F.col("is_holdout")
    clustered = cluster_styles(style, R.STYLE_FEATURES, train)
    biased = R.style_bias(clustered, train)
    players = R.player_sides(R.player_form(dataset, policy=policy))
    return R.combine_priors(form, biased, players)


def enrich(dataset: DataFrame, sides: DataFrame | None, buckets: dict[str, DataFrame], angle_unit: str = "radians",
           policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Attach all priors. A prior that is absent leaves the neutral values."""
    out = attach_side_prior(dataset, sides, "finishing_bias", policy=policy)
    out = attach_side_prior(out, sides, "concession_bias", opponent=True, policy=policy)
    out = trigger_buckets(pressure_buckets(out, angle_unit))
    for spec in BUCKET_SPECS:
        key = L.bucket_key(*[F.col(c) for c in spec.columns])
        out = attach_bucket_prior(out, buckets.get(spec.name), key, spec.columns, spec.name)
    return out


def enrich_out_of_fold(dataset: DataFrame, sides: DataFrame | None, k: int = 5, fold: str = "fold",
                       angle_unit: str = "radians") -> DataFrame:
    """Bucket priors without target leakage: the rows of a fold get the priors fitted on the other folds. All folds' models are
    fitted side by side from one scan of the dataset."""
    tables, _ = fit_bucket_models(trigger_buckets(pressure_buckets(dataset, angle_unit)), BUCKET_SPECS, folds=k, fold=fold)
    tables = {name: written(table) for name, table in tables.items()}
    parts = [
        enrich(dataset.where(F.col(fold) == i), sides, {n: t.where(F.col("held") == i).drop("held") for n, t in tables.items()}, angle_unit)
        for i in range(k)
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- scoring and evaluation -------------------------------------------------------------------------------------


def predict(model: FittedModel, dataset: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored shots, match table and season table."""
    scored = model.score(dataset)
    games = match_table(scored)
    return scored, games, season_table(games)


def evaluate(dataset: DataFrame, models: dict[str, FittedModel], in_sample: bool = True) -> DataFrame:
    """Slice metrics of the provider's probability and of each model, on one stacked table."""
    keep = ["is_goal", "pressure_state", "score_diff_at_shot", "minute", "shot_distance", "set_piece_category", "model", "prediction"]
    frames = [provider_prediction(dataset).select(*keep)]
    for name, model in models.items():
        scored = model.score(dataset.where(F.col("is_goal").isNotNull()), "prediction").withColumn("model", F.lit(name))
        frames.append(scored.select(*keep))
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f)
    return with_slice_description(slice_metrics(stacked, ["model"])).withColumn("in_sample", F.lit(in_sample))


def filtered(dataset: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    return apply_modelling_filters(dataset, allowed)
