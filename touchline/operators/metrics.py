"""Discrimination and calibration metrics as distributed aggregates, per model, slice or any other key."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline import config as C
from touchline.functions.numeric import clip, edge_bin, linspace
from touchline.operators.blocks import DEFAULT_POLICY, OrderedScan, SplitDecision, SplitPolicy, decide_reduced
from touchline.operators.filters import evaluation_slices, slice_names
from touchline.operators.joins import with_group_row
from touchline.operators.lift import zero_filled
from touchline.operators.quantiles import exact_quantiles

_ALL = "__all"
LOSS_EPS = 2.220446049250313e-16


def _target(target: str) -> Column:
    return F.col(target).cast("int")


def brier_term(target: Column, p: Column) -> Column:
    return (p - target) * (p - target)


def log_loss_term(target: Column, p: Column, eps: float = LOSS_EPS) -> Column:
    bounded = clip(p, eps, 1.0 - eps)
    return -(target * F.ln(bounded) + (1 - target) * F.ln(1 - bounded))


def probability_metrics(df: DataFrame, by: Sequence[str] = (), target: str = "is_goal",
                        prediction: str = "prediction") -> DataFrame:
    """Rows, Brier score and log loss, plus goal rate and mean prediction."""
    y, p = _target(target), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(brier_term(y, p)).alias("brier"),
        F.avg(log_loss_term(y, p)).alias("log_loss"),
        F.avg(y).alias("goal_rate"),
        F.avg(p).alias("mean_prediction"),
    )


def score_table(df: DataFrame, by: Sequence[str], target: str, prediction: str,
                policy: SplitPolicy | SplitDecision = DEFAULT_POLICY, weight: Column | None = None) -> DataFrame:
    """Positives and negatives per distinct score, with the counts below it."""
    w = F.lit(1).cast("long") if weight is None else weight
    y = _target(target)
    counts = df.groupBy(*by, F.col(prediction).alias("score")).agg(
        F.coalesce(F.sum(F.when(y == 1, w)), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(y == 0, w)), F.lit(0)).alias("neg"),
    )
    return (
        OrderedScan(counts, by, ["score"], decide_reduced(df, counts, by, policy))
        .running_sum("neg_below", F.col("neg"))
        .running_sum("pos_below", F.col("pos"))
        .result()
    )


def auc(df: DataFrame, by: Sequence[str] = (), target: str = "is_goal", prediction: str = "prediction",
        policy: SplitPolicy | SplitDecision = DEFAULT_POLICY, weight: Column | None = None) -> DataFrame:
    """Exact ROC AUC with half credit for ties; null when a group has one class only.

    Rows collapse to distinct scores first; the cumulative count runs per group and is cut into blocks if one group has
    very many distinct scores.
    """
    keys = [*by] or [_ALL]
    rows = df if by else df.withColumn(_ALL, F.lit(0))
    table = score_table(rows, keys, target, prediction, policy, weight)
    credit = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    out = table.groupBy(*keys).agg(
        F.try_divide(credit, F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )
    return out if by else out.drop(_ALL)


def pr_auc(df: DataFrame, by: Sequence[str] = (), target: str = "is_goal", prediction: str = "prediction",
           policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Average precision: precision at each distinct score, weighted by the recall gained there."""
    keys = [*by] or [_ALL]
    rows = df if by else df.withColumn(_ALL, F.lit(0))
    table = score_table(rows, keys, target, prediction, policy)
    totals = table.groupBy(*keys).agg(F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"))
    joined = with_group_row(table, totals, by, [] if by else [_ALL], ["score"], policy)
    hits = F.col("p_all") - F.col("pos_below")
    flagged = hits + F.col("n_all") - F.col("neg_below")
    out = joined.groupBy(*keys).agg(
        F.sum(F.try_divide(F.col("pos") * hits, flagged.cast("double") * F.col("p_all"))).alias("pr_auc")
    )
    return out if by else out.drop(_ALL)


# ---- calibration ------------------------------------------------------------------------------------------------


def calibration_bins(df: DataFrame, by: Sequence[str] = (), target: str = "is_goal", prediction: str = "prediction",
                     bins: int = 10, clip_top: bool = False) -> DataFrame:
    """Counts, mean prediction and observed rate per equal-width bin (empty bins absent).

    Bins follow the literal linspace edges. A prediction of exactly 1 falls past the last bin and is dropped, unless
    ``clip_top`` puts it into the last one.
    """
    p = F.col(prediction)
    binned = df.withColumn("bin", edge_bin(p, linspace(0.0, 1.0, bins + 1), last_closed=clip_top))
    return binned.where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean_prediction"), F.avg(_target(target)).alias("observed")
    )


def ece(df: DataFrame, by: Sequence[str] = (), target: str = "is_goal", prediction: str = "prediction",
        bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins, weighted by the share of all rows."""
    p, edges = F.col(prediction), linspace(0.0, 1.0, bins + 1)
    cells = df.groupBy(*by, edge_bin(p, edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(_target(target)).alias("mean_y")
    )
    gap = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("mean_y") - F.col("mean_p")))
    return cells.groupBy(*by).agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("ece"))


def reliability_curve(df: DataFrame, by: Sequence[str] = (), target: str = "is_goal", prediction: str = "prediction",
                      bins: int = 10, clip_top: bool = False, keep_empty: bool = True) -> DataFrame:
    """Equal-width reliability curve: bin centre, observed rate and count. Empty bins stay with a null rate."""
    clipped = df.withColumn("__p", clip(F.col(prediction), 0.0, 1.0))
    cells = calibration_bins(clipped, by, target, "__p", bins, clip_top)
    if keep_empty:
        cells = zero_filled(cells, [*by, "bin"], {"bin": list(range(bins))}, ["count"])
    edges = linspace(0.0, 1.0, bins + 1)
    centres = F.array(*[F.lit(0.5 * (edges[i] + edges[i + 1])) for i in range(bins)])
    return cells.withColumn("bin_center", centres[F.col("bin")])


def reliability_quantile(df: DataFrame, by: Sequence[str] = (), target: str = "is_goal",
                         prediction: str = "prediction", bins: int = 10) -> DataFrame:
    """Equal-frequency reliability curve. Edges are exact quantiles; a bin is the number of inner edges below p."""
    inner = [i / bins for i in range(1, bins)]
    names = [f"__q{i}" for i in range(1, bins)]
    keys = [*by] or [_ALL]
    rows = df if by else df.withColumn(_ALL, F.lit(0))
    edges = exact_quantiles(rows, keys, prediction, inner, names)
    below = sum((F.when(F.col(n) < F.col(prediction), 1).otherwise(0) for n in names), F.lit(0))
    joined = with_group_row(rows, edges, by, [] if by else [_ALL], [prediction])
    binned = joined.withColumn("bin", below)
    out = binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(prediction).alias("mean_prediction"),
        F.avg(_target(target)).alias("observed"),
    )
    return out if by else out.drop(_ALL)


# ---- slices, comparison, gates ----------------------------------------------------------------------------------


def full_metrics(df: DataFrame, by: Sequence[str], target: str = "is_goal", prediction: str = "prediction",
                 policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Count, Brier, log loss, AUC and ECE per group.

    Everything derives from one table of distinct (group, score) counts, so the rows are shuffled once, pre-aggregated.
    """
    y = _target(target)
    counts = df.groupBy(*by, F.col(prediction).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    return _metrics_of_counts(df, counts, by, policy)


def _metrics_of_counts(df: DataFrame, counts: DataFrame, by: Sequence[str], policy: SplitPolicy | SplitDecision) -> DataFrame:
    """All metrics from the positives and negatives (``pos``, ``neg``) of each distinct score; ``df`` is what was counted."""
    decision = decide_reduced(df, counts, by, policy)
    table = OrderedScan(counts, by, ["score"], decision).running_sum("neg_below", F.col("neg")).result()
    p, n = F.col("score"), F.col("pos") + F.col("neg")
    bounded = clip(p, LOSS_EPS, 1.0 - LOSS_EPS)
    bins = linspace(0.0, 1.0, 11)
    cells = table.withColumn("bin", edge_bin(p, bins)).groupBy(*by, "bin").agg(
        F.sum(n).alias("n"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p).alias("sq"),
        F.sum(-F.col("pos") * F.ln(bounded) - F.col("neg") * F.ln(1 - bounded)).alias("nll"),
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("credit"),
        F.sum(n * p).alias("sp"),
    )
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("pos") - F.col("sp")))
    return cells.groupBy(*by).agg(
        F.sum("n").alias("count"),
        (F.sum("sq") / F.sum("n")).alias("brier"),
        (F.sum("nll") / F.sum("n")).alias("log_loss"),
        F.try_divide(F.sum("credit"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
        (F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("n")).alias("ece"),
    )


def slice_metrics(df: DataFrame, by: Sequence[str] = ("model",), target: str = "is_goal",
                  prediction: str = "prediction", slices: Mapping[str, tuple[str, Column]] | None = None,
                  min_rows: int = C.MIN_SLICE_ROWS, policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Metrics per model and slice; slices below ``min_rows`` are left out. Rows are counted by score and by the slices they are in, so
    they meet in one shuffle; only these counts are then handed to each slice."""
    y, keys = _target(target), [*by, "slice"]
    cells = df.select(*by, slice_names(slices).alias("__slices"), F.col(prediction).alias("score"), y.alias("__y")).groupBy(
        *by, "__slices", "score"
    ).agg(F.count_if(F.col("__y") == 1).alias("pos"), F.count_if(F.col("__y") == 0).alias("neg"))
    cells = cells.select(*by, F.explode("__slices").alias("slice"), "score", "pos", "neg")
    counts = cells.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _metrics_of_counts(cells, counts, keys, policy).where(F.col("count") >= min_rows)


def with_slice_description(metrics: DataFrame) -> DataFrame:
    from touchline.functions.labels import lookup

    return metrics.withColumn(
        "slice_description", lookup(F.col("slice"), {k: d for k, (d, _) in evaluation_slices().items()})
    )


def overall_summary(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("slice") == "overall").orderBy("brier")


def provider_prediction(df: DataFrame, xg: str = "statsbomb_xg", target: str = "is_goal") -> DataFrame:
    """The provider's own probability as a model: rows with a target and a value, clipped to [0, 1]."""
    return df.where(F.col(xg).isNotNull() & F.col(target).isNotNull()).withColumns(
        {"model": F.lit("provider_xg"), "prediction": clip(F.col(xg).cast("double"), 0.0, 1.0)}
    )


def metrics_long(metrics: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    return metrics.unpivot(list(keys), [F.col(n).cast("double").alias(n) for n in names], "metric", "value")


def comparison_table(long: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Wide comparison of models from long (model, metric, value) rows."""
    return long.groupBy(key).pivot("metric", list(names)).agg(F.first("value"))


def fold_summary(per_fold: DataFrame, names: Sequence[str] = ("brier", "log_loss", "auc")) -> DataFrame:
    """Mean and population deviation of fold metrics."""
    aggs = []
    for n in names:
        aggs += [F.avg(n).alias(f"{n}_mean"), F.stddev_pop(n).alias(f"{n}_std")]
    return per_fold.agg(*aggs)


def quartile_slices(df: DataFrame, value: str, low: str, high: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows below the first and above the third quartile, labelled; rows in between are not part of a slice."""
    keys = [*by] or [_ALL]
    rows = df if by else df.withColumn(_ALL, F.lit(0))
    cuts = exact_quantiles(rows, keys, value, [0.25, 0.75], ["__q1", "__q3"])
    label = F.when(F.col(value) > F.col("__q3"), high).when(F.col(value) < F.col("__q1"), low)
    joined = with_group_row(rows, cuts, by, [] if by else [_ALL], [value])
    out = joined.withColumn("slice", label).where(F.col("slice").isNotNull()).drop("__q1", "__q3")
    return out if by else out.drop(_ALL)


def acceptance_gates(overall: DataFrame, pressure: DataFrame, slices: DataFrame, baseline: DataFrame,
                     neutral: DataFrame, gates: Mapping[str, float] | None = None) -> DataFrame:
    """One row of pass/fail flags. Every input is a metric table of one or a few rows.

    ``overall``/``baseline`` hold brier, ece, auc; ``pressure`` the ece of the under-pressure slice; ``slices`` count and
    ece per slice; ``neutral`` the mean adjustment ``mean_diff``.
    """
    g = {**C.GATES, **(gates or {})}
    worst = slices.where(F.col("count") >= C.MIN_SLICE_ROWS).agg(F.max("ece")).scalar()
    return overall.select(
        ((baseline.select("brier").scalar() - F.col("brier")) >= g["brier_gain"]).alias("brier_gate"),
        (F.col("ece") <= g["ece_overall"]).alias("ece_gate"),
        (pressure.select("ece").scalar() <= g["ece_pressure"]).alias("pressure_ece_gate"),
        (F.abs(neutral.select("mean_diff").scalar()) <= g["mean_diff"]).alias("neutral_gate"),
        (F.col("auc") > g["auc"]).alias("auc_gate"),
        (worst <= g["ece_slice"]).alias("slice_ece_gate"),
    )


def neutral_checks(scored: DataFrame, diff: str, rating: str, pressure: str) -> DataFrame:
    """Mean adjustment and its correlation with opponent strength and pressure."""
    return scored.agg(
        F.avg(diff).alias("mean_diff"),
        F.corr(rating, diff).alias("rating_corr"),
        F.corr(pressure, diff).alias("pressure_corr"),
    )


def error_report(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and bias of totals, e.g. of a match or season table."""
    err = F.col(predicted) - F.col(actual)
    return df.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias")
    )


# ---- monitoring and resampling ----------------------------------------------------------------------------------


def monthly_ece(df: DataFrame, date: str, target: str = "is_goal", prediction: str = "prediction") -> DataFrame:
    return ece(df.withColumn("month", F.date_format(date, "yyyy-MM")), ["month"], target, prediction)


def ks_distance(df: DataFrame, value: str, group: str, first: object, second: object, by: Sequence[str] = (),
                policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Largest gap between the cumulative shares of two groups, over distinct values."""
    keys = [*by] or [_ALL]
    rows = df if by else df.withColumn(_ALL, F.lit(0))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count_if(F.col(group) == F.lit(first)).alias("a"), F.count_if(F.col(group) == F.lit(second)).alias("b")
    )
    decision = decide_reduced(rows, counts, keys, policy)
    scan = (
        OrderedScan(counts, keys, [value], decision)
        .running_sum("ca", F.col("a"), inclusive=True)
        .running_sum("cb", F.col("b"), inclusive=True)
        .result()
    )
    totals = counts.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.abs(F.try_divide(F.col("ca").cast("double"), F.col("na")) - F.try_divide(F.col("cb").cast("double"), F.col("nb")))
    out = with_group_row(scan, totals, by, [] if by else [_ALL], [value], decision).groupBy(*keys).agg(F.max(gap).alias("ks"))
    return out if by else out.drop(_ALL)


DRAW_PRIME = 2_147_483_647
#: groups whose draws are held at once
DRAW_ROWS = 128


def draw_seed(group: Column, kind: T.DataType) -> Column:
    """An integer that stands for a group in its draws: itself, or a checksum of what is not an integer."""
    value = group if isinstance(kind, T.IntegralType) else F.crc32(group.cast("string"))
    return F.coalesce(F.pmod(value.cast("long"), F.lit(DRAW_PRIME)), F.lit(0).cast("long"))


def poisson_weight(group: Column, *parts: Column) -> Column:
    """Deterministic Poisson(1) draw for integers, by inverting the distribution function. The uniform number comes from three rounds of a
    linear and a quadratic map over a prime, plain arithmetic that any engine repeats."""
    import math

    group = F.pmod(group.cast("long"), F.lit(DRAW_PRIME))
    h = group
    for k, part in enumerate([*parts, F.lit(97), F.lit(1009)]):
        h = (h * F.lit([48271, 69621, 40692][k % 3]) + part.cast("long")) % F.lit(DRAW_PRIME)
        h = (h * h + group) % F.lit(DRAW_PRIME)
    uniform = h / F.lit(float(DRAW_PRIME))
    chain, cumulative = None, 0.0
    for k in range(16):
        cumulative += math.exp(-1.0) / math.factorial(k)
        hit = uniform < cumulative
        chain = F.when(hit, F.lit(k)) if chain is None else chain.when(hit, F.lit(k))
    return chain.otherwise(F.lit(16))


def bootstrap_difference(df: DataFrame, group: str, first: str, second: str, target: str = "is_goal",
                         replicates: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Confidence interval of Brier(first) - Brier(second), resampling whole groups (matches).

    Groups reduce to sums first; each replicate then weights them by a Poisson(1) draw, so no row is ever copied or moved.
    The number of groups per replicate is folded by partial aggregation.
    """
    y = _target(target)
    per_group = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(brier_term(y, F.col(first)) - brier_term(y, F.col(second))).alias("d"),
    )
    draws = per_group.select(
        draw_seed(F.col(group), df.schema[group].dataType).alias("__g"), "n", "d", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    ).withColumn("w", poisson_weight(F.col("__g"), F.col("replicate"), F.lit(seed)))
    stats = draws.groupBy("replicate").agg(
        F.try_divide(F.sum(F.col("w") * F.col("d")), F.sum(F.col("w") * F.col("n"))).alias("difference")
    )
    point = per_group.agg((F.sum("d") / F.sum("n")).alias("estimate"))
    interval = exact_quantiles(stats, [], "difference", [alpha / 2, 1 - alpha / 2], ["low", "high"])
    return interval.select(point.scalar().alias("estimate"), "low", "high")


def _poisson_thresholds() -> list[int]:
    """The least numbers under the prime whose draw is at least 1, 2, ... 16: those that reach each step of the distribution function."""
    import math

    out, cumulative = [], 0.0
    for k in range(16):
        cumulative += math.exp(-1.0) / math.factorial(k)
        least = int(cumulative * DRAW_PRIME)
        while least and (least - 1) / float(DRAW_PRIME) >= cumulative:
            least -= 1
        while least / float(DRAW_PRIME) < cumulative:
            least += 1
        out.append(least)
    return out


def _poisson_draws(groups: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """``poisson_weight`` of (group, replicate, seed) for replicates from 1 on: a row for each group, numbers in 64 bits as Spark computes them."""
    group, thresholds = groups[:, None], _poisson_thresholds()
    h = group
    for k, part in enumerate((np.arange(1, replicates + 1), seed, 97, 1009)):
        h = h * [48271, 69621, 40692][k % 3] + part
        # a remainder has the sign of what is divided; only a seed may be under zero, and the division by a constant is the faster one
        h = np.fmod(h, DRAW_PRIME) if k == 1 and seed < 0 else h - h // DRAW_PRIME * DRAW_PRIME
        h = h * h + group
        h -= h // DRAW_PRIME * DRAW_PRIME
    out = np.zeros(h.shape, np.int64)
    for least in thresholds:
        hit = h >= least
        if not hit.any():
            break
        out += hit
    return out


_SEGMENT = "segment int, score string, replicate int, pos bigint, neg bigint, twice bigint"


def _ranked_segments(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Sums of one range of scores, a row for each replicate: its lowest score (segment 0), its highest (2), which a neighbouring range may share,
    and all between them (1) with ``twice`` the credit that they give each other. The counts come in order of their score."""
    names = [n.split()[0] for n in _SEGMENT.split(", ")]
    number = np.arange(1, replicates + 1, dtype=np.int32)
    first: tuple | None = None
    last: tuple | None = None
    middle = np.zeros((3, replicates), np.int64)

    def segment(k: int, score: str | None, pos: np.ndarray, neg: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        values = [np.full(replicates, k, np.int32), [score] * replicates, number, pos, neg, twice]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=names)

    def close(score: str, pos: np.ndarray, neg: np.ndarray) -> None:
        nonlocal first
        if first is None:
            first = (score, pos, neg)
            return
        middle[2] += pos * (2 * middle[1] + neg)
        middle[0] += pos
        middle[1] += neg

    for batch in batches:
        scores = batch.column(0).to_pylist()
        groups, pos, neg = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        for at in range(0, batch.num_rows, DRAW_ROWS):
            part = slice(at, at + DRAW_ROWS)
            some = scores[part]
            begins = [i for i, s in enumerate(some) if i == 0 or s != some[i - 1]]
            w = _poisson_draws(groups[part], replicates, seed)
            sums = [np.add.reduceat(w * n[part][:, None], begins, axis=0) for n in (pos, neg)]
            for i, begin in enumerate(begins):
                if last is not None and last[0] == some[begin]:
                    last = (last[0], last[1] + sums[0][i], last[2] + sums[1][i])
                else:
                    if last is not None:
                        close(*last)
                    last = (some[begin], sums[0][i], sums[1][i])
    zero = np.zeros(replicates, np.int64)
    if first is not None:
        yield segment(0, *first, zero)
        yield segment(1, None, *middle)
    if last is not None:
        yield segment(2, *last, zero)


def _replicate_aucs(df: DataFrame, group: str, score: str, target: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, auc), with the groups of a replicate weighted by its draws. Counts per score and group are dealt by ranges of the score, a
    score of many groups over several; tasks draw and rank their range for all replicates, and only sums of ranges meet by replicate."""
    y = _target(target)
    seeds = draw_seed(F.col(group), df.schema[group].dataType)
    counts = df.groupBy(F.col(score).alias("score"), seeds.alias("g")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    ranges = counts.repartitionByRange("score", "g").sortWithinPartitions("score", "g").select(
        F.coalesce(F.col("score").cast("string"), F.lit("")).alias("score"), "g", "pos", "neg", F.spark_partition_id().alias("range")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: list[int] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    place[:] = [batch.column(4)[0].as_py()]
                    yield batch

        for out in _ranked_segments(noted(), replicates, seed):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(out.num_rows, place[0], np.int32)), *out.columns], names=["range", *out.schema.names])

    segments = ranges.mapInArrow(work, f"range int, {_SEGMENT}")
    # a score that ranges share is one score
    key = F.coalesce("score", F.concat(F.lit("range "), F.col("range").cast("string")))
    whole = segments.groupBy("replicate", key.alias("key")).agg(
        F.min(F.struct("range", "segment")).alias("at"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        (F.sum("twice") + F.when(F.max("score").isNotNull(), F.sum("pos") * F.sum("neg")).otherwise(0)).alias("twice"),
    )
    below = W.partitionBy("replicate").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    ranked = whole.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    credit = F.sum(F.col("pos").cast("double") * F.col("below") + F.col("twice") / 2)
    return ranked.groupBy("replicate").agg(F.try_divide(credit, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def bootstrap_auc_difference(df: DataFrame, group: str, first: str, second: str, target: str = "is_goal",
                             replicates: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """The same interval for AUC(first) - AUC(second). Each replicate has its own ranking; no count is copied for a replicate, all replicates of
    a range of scores are ranked where its counts are."""
    a, b = (_replicate_aucs(df, group, score, target, replicates, seed).withColumnRenamed("auc", name) for score, name in ((first, "a"), (second, "b")))
    diffs = a.join(b, "replicate").select((F.col("a") - F.col("b")).alias("difference"))
    return exact_quantiles(diffs, [], "difference", [alpha / 2, 0.5, 1 - alpha / 2], ["low", "median", "high"])
