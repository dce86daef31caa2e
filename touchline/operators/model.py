"""Goal-probability models on Spark: geometry baseline, contextual model, bucket sub-models, style clusters.

Fitting is the only eager step. The linear models are fitted side by side in ``newton``; bucket models on counted cells, here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import config as C
from touchline.functions.labels import bucket_key
from touchline.operators.blocks import DEFAULT_POLICY, OrderedScan, SplitDecision, SplitPolicy
from touchline.operators.boosted import BoostedTrees
from touchline.operators.boosted import fit as boosted_trees
from touchline.operators.clusters import fit_clusters
from touchline.operators.isotonic import Isotonic
from touchline.operators.isotonic import fit_isotonic as isotonic_steps
from touchline.operators.metrics import brier_term, full_metrics, log_loss_term
from touchline.operators.newton import MAX_STEPS, SMALL_STEP, FeatureContract, FittedModel, ModelSpec, fit_models, probability
from touchline.plans.staging import written


def baseline_spec(df: DataFrame | None = None, c: float = 1.0, where: Column | None = None) -> ModelSpec:
    contract = FeatureContract("baseline_geometry", numeric=["shot_distance", "shot_angle"])
    known = _has(contract.numeric)
    return ModelSpec(contract, c, where=known if where is None else known & where)


def fit_baseline(df: DataFrame, target: str = "is_goal", c: float = 1.0) -> FittedModel:
    """Logistic model on distance and angle, fitted on the shots that have both."""
    return fit_models(df, [baseline_spec(c=c)], target)[0]


def contextual_spec(df: DataFrame, c: float = 0.5, where: Column | None = None, numeric: Sequence[str] = C.NUMERIC_FEATURES,
                    binary: Sequence[str] = C.BINARY_FEATURES, categorical: Sequence[str] = C.CATEGORICAL_FEATURES) -> ModelSpec:
    present = [[n for n in names if n in df.columns] for names in (numeric, binary, categorical)]
    return ModelSpec(FeatureContract("contextual_logistic", *present), c, where=where, skip_empty=True)


def fit_contextual(df: DataFrame, target: str = "is_goal", c: float = 0.5, numeric: Sequence[str] = C.NUMERIC_FEATURES,
                   binary: Sequence[str] = C.BINARY_FEATURES,
                   categorical: Sequence[str] = C.CATEGORICAL_FEATURES) -> FittedModel:
    """Contextual model: median-imputed scaled numerics, mode-imputed flags, mode-imputed one-hot categories.

    Columns that are absent or entirely null are left out.
    """
    return fit_models(df, [contextual_spec(df, c, None, numeric, binary, categorical)], target)[0]


def _has(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


# ---- cross validation -------------------------------------------------------------------------------------------


def _fill_levels(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal groups each fold receives when every group goes to the lightest fold."""
    k = len(loads)
    low, high = min(loads), max(loads) + size * count
    while low < high:
        level = (low + high) // 2
        if sum(max(0, -(-(level - v) // size)) for v in loads) >= count:
            high = level
        else:
            low = level + 1
    level = low - 1
    given = [max(0, -(-(level - v) // size)) for v in loads]
    rest = count - sum(given)
    for f in sorted(range(k), key=lambda i: (loads[i] + given[i] * size, i))[:rest]:
        given[f] += 1
    return given


def assign_folds(df: DataFrame, group: str = "match_id", k: int = 5, method: str = "hash",
                 policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Add a ``fold`` column that keeps each group together.

    "hash" needs no shuffle. "balanced" gives the fold sizes of the greedy rule (largest group first, to the lightest
    fold): groups of equal size are interchangeable, so the driver only sees how many groups have each size.
    """
    if method == "hash":
        return df.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(k)).cast("int"))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    histogram = sizes.groupBy("__size").agg(F.count(F.lit(1)).alias("m")).orderBy(F.col("__size").desc())
    loads, plan = [0] * k, []
    for row in histogram.toLocalIterator():  # distinct sizes only: at most the square root of twice the row count
        given = _fill_levels(loads, row["__size"], row["m"])
        upto = 0
        for f in range(k):
            if given[f]:
                plan.append((row["__size"], f, upto + 1, upto + given[f]))
            upto += given[f]
            loads[f] += given[f] * row["__size"]
    spark = df.sparkSession
    table = spark.createDataFrame(plan, "__size long, fold int, __from long, __to long").groupBy("__size").agg(
        F.collect_list(F.struct("__to", "fold")).alias("__plan")
    )
    numbered = OrderedScan(sizes, ["__size"], [group], policy).row_number("__rn").result()
    chosen = F.element_at(F.filter(F.sort_array("__plan"), lambda e: e["__to"] >= F.col("__rn")), 1)["fold"]
    folds = numbered.join(table, "__size").select(group, chosen.alias("fold"))
    return df.join(folds, group, "left")


def cross_validate(df: DataFrame, fit: Callable[[DataFrame], FittedModel] = fit_baseline, k: int = 5, target: str = "is_goal",
                   fold: str = "fold", output: str = "prediction") -> DataFrame:
    """Out-of-fold predictions. For the linear models of this module the models of all folds are fitted side by side, each on the other
    folds' rows, and score in one pass; any other ``fit`` is called once a fold."""
    spec = {fit_baseline: baseline_spec, fit_contextual: contextual_spec}.get(fit)
    if spec is None:
        parts = [fit(df.where(F.col(fold) != i)).score(df.where(F.col(fold) == i), output) for i in range(k)]
        return reduce(DataFrame.unionByName, parts)
    models = fit_models(df, [spec(df, where=F.col(fold) != i) for i in range(k)], target)
    chosen = F.coalesce(*[F.when(F.col(fold) == i, probability(m.margin())) for i, m in enumerate(models)])
    return df.where(F.col(fold).between(0, k - 1)).withColumn(output, chosen)


def fold_metrics(out_of_fold: DataFrame, target: str = "is_goal", fold: str = "fold",
                 prediction: str = "prediction") -> DataFrame:
    return full_metrics(out_of_fold, [fold], target, prediction)


# ---- bucket sub-models ------------------------------------------------------------------------------------------


@dataclass
class BucketSpec:
    """A bucket model: the columns that make a bucket, those that may not be null, and the least shots of a reported bucket."""

    name: str
    columns: list[str]
    min_shots: int = 25
    required: list[str] = field(default_factory=list)
    c: float = 1.0


def bucket_cells(df: DataFrame, specs: Sequence[BucketSpec], xg: str = "statsbomb_xg", target: str = "is_goal", fold: str | None = None) -> DataFrame:
    """The rows of all bucket models as counted cells (fold, model, bucket, xg, goal, shots), by one pass of grouping sets. Nothing is
    lost: a model sees its rows through these values alone."""
    keys = [f"__b{k}" for k in range(len(specs))]
    labels = [F.to_json(F.array(*[F.coalesce(F.col(b).cast("string"), F.lit(C.UNKNOWN)) for b in s.columns])) for s in specs]
    rows = df.where(F.col(xg).isNotNull() & F.col(target).isNotNull()).select(
        (F.col(fold) if fold else F.lit(-2)).cast("int").alias("fold"), F.col(xg).cast("double").alias("xg"), F.col(target).cast("double").alias("goal"),
        *[F.when(_has(s.required), label).alias(key) for s, label, key in zip(specs, labels, keys, strict=True)],
    )
    sets = [[F.col("fold"), F.col("xg"), F.col("goal"), F.col(key)] for key in keys]
    cells = rows.groupingSets(sets, "fold", "xg", "goal", *keys).agg(F.count(F.lit(1)).cast("double").alias("shots"))
    model = F.coalesce(*[F.when(F.col(key).isNotNull(), F.lit(k)) for k, key in enumerate(keys)])
    # a row that a model leaves out has no bucket there
    return cells.select("fold", model.alias("model"), F.coalesce(*keys).alias("bucket"), "xg", "goal", "shots").where(F.col("model").isNotNull())


def fit_bucket_models(df: DataFrame, specs: Sequence[BucketSpec], xg: str = "statsbomb_xg", target: str = "is_goal", folds: int = 0,
                      fold: str = "fold") -> tuple[dict[str, DataFrame], DataFrame]:
    """Bucket effects next to xG of all ``specs``: (a bucket table for each, a row of fit metrics for each model).

    The cells are written once. A Newton step sums them by model and bucket; the system is an arrow (xG and intercept beside one independent
    effect a bucket), so it is solved by eliminating the buckets. What reaches the driver are a few sums a bucket, a label vocabulary.
    With ``folds`` there is a model for each held-out fold as well, named in the column ``held``, fitted on the cells of the other folds.
    """
    spark = df.sparkSession
    cells = written(bucket_cells(df, specs, xg, target, fold if folds else None))
    held = F.filter(F.array(*[F.lit(i) for i in range(folds)]), lambda i: i != F.col("fold")) if folds else F.array(F.lit(-1))
    cells = cells.withColumn("held", F.explode(held))
    key = ["held", "model", "bucket"]
    names = [tuple(r) for r in cells.select(*key).distinct().orderBy(*key).collect()]
    base = {(h, m): np.zeros(2) for h, m, _ in names}
    effects = dict.fromkeys(names, 0.0)

    def scored() -> DataFrame:
        rows = [(h, m, b, float(base[h, m][0] + v), float(base[h, m][1])) for (h, m, b), v in effects.items()]
        table = spark.createDataFrame(rows, "held int, model int, bucket string, __a double, __s double")
        return cells.join(F.broadcast(table), key).withColumn("p", probability(F.col("__a") + F.col("__s") * F.col("xg")))

    w, gap, x = F.col("shots") * F.col("p") * (1 - F.col("p")), F.col("shots") * (F.col("p") - F.col("goal")), F.col("xg")
    for _ in range(MAX_STEPS if names else 0):
        sums = scored().groupBy(*key).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.sum(gap).alias("g"), F.sum(gap * x).alias("gx")).collect()
        own: dict[tuple[int, int], list] = {}
        for r in sums:
            own.setdefault((r["held"], r["model"]), []).append(r)
        move = 0.0
        for (h, m), rows in own.items():
            ridge = 1.0 / specs[m].c
            cross = sum(r["wx"] for r in rows)
            curve = np.array([[sum(r["w"] for r in rows), cross], [cross, sum(r["wxx"] for r in rows) + ridge]])
            slope = np.array([sum(r["g"] for r in rows), sum(r["gx"] for r in rows) + ridge * base[h, m][1]])
            for r in rows:
                arm, pivot = np.array([r["w"], r["wx"]]), r["w"] + ridge
                curve -= np.outer(arm, arm) / pivot
                slope -= arm * (r["g"] + ridge * effects[h, m, r["bucket"]]) / pivot
            step = -np.linalg.lstsq(curve, slope, rcond=None)[0]
            for r in rows:
                old = effects[h, m, r["bucket"]]
                change = -(r["g"] + ridge * old + r["w"] * step[0] + r["wx"] * step[1]) / (r["w"] + ridge)
                effects[h, m, r["bucket"]] = old + change
                move = max(move, abs(change))
            base[h, m] = base[h, m] + step
            move = max(move, *np.abs(step).tolist())
        if move < SMALL_STEP:
            break
    sums = written(scored().groupBy(*key).agg(
        F.sum("shots").cast("long").alias("shots"), F.sum(F.col("shots") * F.col("goal")).cast("long").alias("goals"), F.sum(F.col("shots") * x).alias("xg_total"),
        (F.sum(F.col("shots") * F.col("p")) / F.sum("shots")).alias("modeled_prob"),
        F.sum(F.col("shots") * brier_term(F.col("goal"), F.col("p"))).alias("brier"), F.sum(F.col("shots") * log_loss_term(F.col("goal"), F.col("p"))).alias("log_loss"),
    ))
    logits = spark.createDataFrame([(*n, float(v)) for n, v in effects.items()], "held int, model int, bucket string, bucket_logit double")
    shown = sums.join(F.broadcast(logits), key)
    tables = {}
    for k, s in enumerate(specs):
        labels = F.from_json("bucket", "array<string>")
        rows = shown.where((F.col("model") == k) & (F.col("shots") >= s.min_shots)).withColumns({c: labels[i] for i, c in enumerate(s.columns)})
        tables[s.name] = _effects(rows, [*(["held"] if folds else []), *s.columns])
    shots = F.sum("shots")
    metrics = sums.groupBy("held", "model").agg(
        shots.cast("long").alias("samples"), (F.sum("brier") / shots).alias("brier"), (F.sum("log_loss") / shots).alias("log_loss"),
        (F.sum("goals") / shots).alias("goal_rate"), (F.sum(F.col("shots") * F.col("modeled_prob")) / shots).alias("mean_prediction"),
    )
    name = F.element_at(F.array(*[F.lit(s.name) for s in specs]), F.col("model") + 1)
    return tables, metrics.withColumn("model", name) if folds else metrics.withColumn("model", name).drop("held")


def _effects(grouped: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = grouped.withColumns({"goal_rate": F.col("goals") / F.col("shots"), "xg_per_shot": F.col("xg_total") / F.col("shots")})
    out = out.withColumns({"lift_vs_xg": F.col("goal_rate") - F.col("xg_per_shot"), "lift_vs_model": F.col("goal_rate") - F.col("modeled_prob"), "odds_multiplier": F.exp("bucket_logit")})
    return out.select(*columns, "shots", "goals", "xg_total", "modeled_prob", "goal_rate", "xg_per_shot", "lift_vs_xg", "lift_vs_model", "bucket_logit", "odds_multiplier")


def fit_bucket_model(df: DataFrame, bucket_columns: Sequence[str], xg: str = "statsbomb_xg", target: str = "is_goal",
                     min_shots: int = 25, c: float = 1.0, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Bucket effect next to xG: (bucket table, one row of fit metrics).

    The coefficient of a bucket is its log-odds offset and its exponential the odds multiplier.
    """
    tables, metrics = fit_bucket_models(df, [BucketSpec("bucket", list(bucket_columns), min_shots, list(required), c)], xg, target)
    return tables["bucket"], metrics.drop("model")


def bucket_table(scored: DataFrame, bucket_columns: Sequence[str], effects: DataFrame, xg: str = "statsbomb_xg",
                 target: str = "is_goal", min_shots: int = 25) -> DataFrame:
    """Observed, provider and modelled rates per bucket, with the bucket effect; small buckets are left out."""
    grouped = scored.groupBy(*bucket_columns).agg(
        F.count(F.lit(1)).alias("shots"),
        F.sum(F.col(target).cast("long")).alias("goals"),
        F.sum(xg).alias("xg_total"),
        F.avg("modeled_prob").alias("modeled_prob"),
    ).where(F.col("shots") >= min_shots)
    out = grouped.withColumns(
        {
            "bucket": bucket_key(*[F.col(b) for b in bucket_columns]),
            "goal_rate": F.col("goals") / F.col("shots"),
            "xg_per_shot": F.col("xg_total") / F.col("shots"),
        }
    ).withColumns(
        {
            "lift_vs_xg": F.col("goal_rate") - F.col("xg_per_shot"),
            "lift_vs_model": F.col("goal_rate") - F.col("modeled_prob"),
        }
    )
    return (
        out.join(effects, "bucket", "left")
        .drop("bucket")
        .fillna({"bucket_logit": 0.0})
        .withColumn("odds_multiplier", F.exp("bucket_logit"))
    )


# ---- clusters, calibration, neutral scores ----------------------------------------------------------------------


def cluster_styles(df: DataFrame, features: Sequence[str], train: Column, k: int = C.STYLE_CLUSTERS, output: str = "style_cluster") -> DataFrame:
    """k-means on scaled features: fitted on the training rows, assigned to all. Too few rows give one cluster."""
    return fit_clusters(df, features, train, k).assign(df, output)


def _rounded(score: str, decimals: int | None):
    return F.col(score) if decimals is None else F.round(score, decimals)


def fit_isotonic(df: DataFrame, prediction: str, target: str = "is_goal", decimals: int | None = None) -> Isotonic:
    """Isotonic calibration fitted on distinct scores: rows of one score are summed first. ``decimals`` rounds scores, at the fit and
    where it is applied."""
    return isotonic_steps(df.select(_rounded(prediction, decimals).alias("__p"), F.col(target).cast("double").alias("__y")), "__p", F.col("__y"))


def apply_isotonic(model: Isotonic, df: DataFrame, prediction: str, output: str = "calibrated", decimals: int | None = None) -> DataFrame:
    return model.transform(df.withColumn("__p", _rounded(prediction, decimals)), "__p", output).drop("__p")


def fit_boosted(df: DataFrame, features: Sequence[str], target: str = "is_goal", rounds: int = 20, depth: int = 5,
                step: float = 0.05, seed: int = 42) -> BoostedTrees | PipelineModel:
    """Gradient-boosted trees as an alternative learner: on counted cells, or on the rows where features have too many bins together."""
    rows = df.select(F.col(target).cast("double").alias("__label"), *[F.col(f).cast("double").alias(f) for f in features])
    model = boosted_trees(rows, features, "__label", rounds, depth, step, seed)
    if model:
        return model
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="skip"),
        GBTClassifier(featuresCol="__features", labelCol="__label", predictionCol="__class", maxIter=rounds,
                      maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=seed)
        .setProbabilityCol("__probability").setRawPredictionCol("__margin"),
    ]
    return Pipeline(stages=stages).fit(rows)


def score_boosted(model: BoostedTrees | PipelineModel, df: DataFrame, output: str = "boosted") -> DataFrame:
    if isinstance(model, BoostedTrees):
        return model.score(df, output)
    return model.transform(df).select(*df.columns, vector_to_array("__probability")[1].alias(output))


NEUTRAL_OVERRIDES: dict[str, object] = {
    "score_diff_at_shot": C.NEUTRAL.score_diff_at_shot,
    "is_leading": False,
    "is_trailing": False,
    "is_drawing": True,
    "score_state": "Level",
    "simple_state": "Drawing",
    "minute": C.NEUTRAL.minute,
    "minute_bucket_label": "45-60",
    "feature_minute_bucket": C.NEUTRAL.minute_bucket,
    "pressure_state": C.NOT_UNDER_PRESSURE,
    "under_pressure": C.NEUTRAL.under_pressure,
    "opponent_def_rating_global": C.NEUTRAL.opponent_def_rating_global,
    "opponent_def_zone_rating": C.NEUTRAL.opponent_def_zone_rating,
    "concession_bias_logit": 0.0,
    "concession_bias_multiplier": 1.0,
    "pressure_logit": 0.0,
    "pressure_multiplier": 1.0,
}


def neutral_scores(model: FittedModel, df: DataFrame, overrides: Mapping[str, object] | None = None,
                   output: str = "cxg_prediction", neutral: str = "neutral_cxg") -> DataFrame:
    """Raw and neutral prediction of every row, with difference and ratio.

    The context columns are replaced by the reference context for a second scoring pass over the same rows: no join.
    """
    values = {k: v for k, v in (overrides or NEUTRAL_OVERRIDES).items() if k in model.contract.columns}
    kept = model.score(df, output).withColumns({f"__keep_{k}": F.col(k) for k in values})
    moved = kept.withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in values.items()})
    scored = model.score(moved, neutral)
    restored = scored.withColumns({k: F.col(f"__keep_{k}") for k in values}).drop(*[f"__keep_{k}" for k in values])
    return restored.withColumns(
        {
            "opponent_adjusted_diff": F.col(output) - F.col(neutral),
            "opponent_adjusted_ratio": F.try_divide(F.col(output), F.col(neutral)),
        }
    )
