"""Exact interpolated quantiles without pulling a group into one task.

Values are counted first, cumulative counts are taken over the distinct values, and a plain aggregate picks the values at
the two ranks around each quantile. Spark's own exact ``percentile`` keeps a whole group in one buffer instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.blocks import DEFAULT_POLICY, OrderedScan, SplitDecision, SplitPolicy, decide_reduced
from touchline.operators.joins import with_group_row

_ALL = "__all"


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str],
                    policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """One row per group with a column per probability (linear interpolation); null values and keys are ignored."""
    rows = df.where(F.col(value).isNotNull()).withColumn(_ALL, F.lit(0))
    group = [*by, _ALL]
    counts = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    decision = decide_reduced(rows, counts, group, policy)
    cumulative = OrderedScan(counts, group, [value], decision).running_sum("__below", F.col("__n")).result()
    totals = counts.groupBy(*group).agg(F.sum("__n").alias("__total"))
    ranked = with_group_row(cumulative, totals, by, [_ALL], [value], decision)
    aggs = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("__total") - 1)
        low = F.floor(position)
        for side, rank in (("lo", low), ("hi", F.least(low + 1, F.col("__total") - 1))):
            holds = (F.col("__below") <= rank) & (rank < F.col("__below") + F.col("__n"))
            aggs.append(F.max(F.when(holds, F.col(value).cast("double"))).alias(f"__{side}{i}"))
        aggs.append(F.max(position - low).alias(f"__f{i}"))
    picked = ranked.groupBy(*group).agg(*aggs)
    out = [
        (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(name)
        for i, name in enumerate(names)
    ]
    return picked.select(*by, *out)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median of several columns as one row: the columns are stacked, then share one quantile pass."""
    stacked = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
        .alias("s")
    ).select("s.column", "s.v")
    per_column = exact_quantiles(stacked, ["column"], "v", [0.5], ["median"])
    return per_column.agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns])
