"""Grouped conversion summaries: shots, goals, mean xG, goal rate and lift, with optional zero-filled groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.config import PITCH
from touchline.functions.labels import outcome_group
from touchline.functions.numeric import even_bin


def spine(groups: DataFrame, keys: Sequence[str], domains: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the domain values with the observed values of the remaining keys.

    Domains are short literal lists, so they are exploded onto each observed row instead of joined.
    """
    observed = [k for k in keys if k not in domains]
    base = groups.select(*observed).distinct() if observed else groups.sparkSession.range(1).select()
    for name, values in domains.items():
        base = base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return base.select(*keys)


def zero_filled(groups: DataFrame, keys: Sequence[str], domains: Mapping[str, Sequence],
                zero_columns: Sequence[str]) -> DataFrame:
    """Add the missing key combinations with zero counts; other measures stay null.

    ``groups`` is already aggregated. The missing rows are appended and merged by one more small aggregation, so the
    keys need no join and values outside a domain are kept.
    """
    measures = [c for c in groups.columns if c not in keys]
    filled = groups.unionByName(spine(groups, keys, domains), allowMissingColumns=True)
    aggs = [F.max(c).alias(c) for c in measures]
    merged = filled.groupBy(*keys).agg(*aggs)
    return merged.fillna(0, subset=list(zero_columns)) if zero_columns else merged


def lift_summary(df: DataFrame, keys: Sequence[str], goal: str = "is_goal", xg: str | None = "statsbomb_xg",
                 domains: Mapping[str, Sequence] | None = None, min_shots: int | None = None,
                 extra: Mapping[str, Column] | None = None, with_lift: bool = True) -> DataFrame:
    """Shots, goals, mean xG, goal rate and lift per group.

    ``domains`` lists the levels of categorical keys whose empty groups must appear. ``min_shots`` keeps larger groups.
    """
    aggs = [
        F.count(F.lit(1)).alias("shots"),
        F.coalesce(F.sum(F.col(goal).cast("long")), F.lit(0)).alias("goals"),
    ]
    if xg is not None:
        aggs.append(F.avg(xg).alias("mean_xg"))
    aggs += [expr.alias(name) for name, expr in (extra or {}).items()]
    out = df.groupBy(*keys).agg(*aggs)
    if domains:
        out = zero_filled(out, keys, domains, ["shots", "goals"])
    if min_shots is not None:
        out = out.where(F.col("shots") >= min_shots)
    out = out.withColumn("goal_rate", F.col("goals") / F.greatest(F.col("shots"), F.lit(1)))
    if with_lift and xg is not None:
        out = out.withColumn("lift", F.col("goal_rate") - F.coalesce(F.col("mean_xg"), F.lit(0.0)))
    return out


def add_share(summary: DataFrame, name: str, within: Sequence[str], value: str = "shots") -> DataFrame:
    """Share of the value inside the given keys; zero totals give zero. For summaries, which are small."""
    total = F.sum(value).over(W.partitionBy(*within))
    return summary.withColumn(name, F.col(value) / F.greatest(total, F.lit(1)))


def team_set_piece_totals(df: DataFrame, keys: Sequence[str], is_set_piece: Column, goal: str = "is_goal",
                          xg: str = "statsbomb_xg") -> DataFrame:
    """Set-piece volume and conversion against the team's own average, in one pass."""
    goals = F.col(goal).cast("long")
    out = df.groupBy(*keys).agg(
        F.count_if(is_set_piece).alias("shots"),
        F.coalesce(F.sum(F.when(is_set_piece, goals)), F.lit(0)).alias("goals"),
        F.avg(F.when(is_set_piece, F.col(xg))).alias("mean_xg"),
        F.count(F.lit(1)).alias("total_shots"),
        F.coalesce(F.sum(goals), F.lit(0)).alias("total_goals"),
    ).where(F.col("shots") > 0)
    out = out.withColumns(
        {
            "goal_rate": F.col("goals") / F.col("shots"),
            "overall_goal_rate": F.col("total_goals") / F.col("total_shots"),
            "set_piece_share": F.col("shots") / F.col("total_shots"),
        }
    )
    return out.withColumn("lift_vs_team_avg", F.col("goal_rate") - F.col("overall_goal_rate"))


def state_delta(summary: DataFrame, key: str, state: str = "simple_state", value: str = "goal_rate",
                first: str = "Leading", second: str = "Trailing") -> DataFrame:
    """Difference between two states per key, for keys that have both."""
    wide = summary.groupBy(key).pivot(state, [first, second]).agg(F.first(value))
    return wide.where(F.col(first).isNotNull() & F.col(second).isNotNull()).withColumn(
        "delta", F.col(first) - F.col(second)
    )


def outcome_mix(df: DataFrame, key: str, outcome: str, domain: Sequence[str]) -> DataFrame:
    """Row-normalised crosstab of a key against outcome groups."""
    counted = df.groupBy(key).agg(
        *[F.count_if(outcome_group(F.col(outcome)) == label).alias(label) for label in domain]
    )
    total = reduce(lambda a, b: a + b, [F.col(label) for label in domain])
    return counted.select(key, *[(F.col(label) / total).alias(label) for label in domain])


# ---- bins and grids ---------------------------------------------------------------------------------------------


def binned_rate(df: DataFrame, value: str, edges: Sequence[float], mid: str, goal: str = "is_goal",
                xg: str = "statsbomb_xg") -> DataFrame:
    """Goal rate and mean xG per [low, high) bin of a value; empty bins are kept with zero counts.

    Few bins: the bin is found by comparing with the literal edges.
    """
    from touchline.functions.numeric import edge_bin

    bins = len(edges) - 1
    grouped = (
        df.withColumn("bin", edge_bin(F.col(value), edges))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("shots"),
            F.coalesce(F.sum(F.col(goal).cast("long")), F.lit(0)).alias("goals"),
            F.avg(xg).alias("mean_xg"),
        )
    )
    out = zero_filled(grouped, ["bin"], {"bin": list(range(bins))}, ["shots", "goals"])
    mids = F.array(*[F.lit((edges[i] + edges[i + 1]) / 2) for i in range(bins)])
    rate = F.when(F.col("shots") > 0, F.col("goals") / F.col("shots"))
    return out.withColumns({"goal_rate": rate, mid: mids[F.col("bin")]})


def grid(df: DataFrame, x: str, y: str, x_range: tuple[float, float, int], y_range: tuple[float, float, int],
         aggs: Mapping[str, Column], clip: bool = False) -> DataFrame:
    """Long-form 2-D grid: one row per non-empty cell. The last bin of each axis includes its upper edge.

    ``clip`` first moves outside points onto the range, as the pitch grids do.
    """
    def coordinate(name: str, low: float, high: float) -> Column:
        bounded = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(name)))
        return F.when(F.col(name).isNotNull(), bounded) if clip else F.col(name)

    cells = df.withColumns(
        {
            "x_bin": even_bin(coordinate(x, *x_range[:2]), *x_range),
            "y_bin": even_bin(coordinate(y, *y_range[:2]), *y_range),
        }
    ).where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
    return cells.groupBy("x_bin", "y_bin").agg(*[expr.alias(name) for name, expr in aggs.items()])


def complete_grid(cells: DataFrame, x_bins: int, y_bins: int, fill: Mapping[str, float]) -> DataFrame:
    """Add the empty cells of a grid."""
    measures = [c for c in cells.columns if c not in ("x_bin", "y_bin")]
    full = zero_filled(cells, ["x_bin", "y_bin"], {"x_bin": list(range(x_bins)), "y_bin": list(range(y_bins))}, [])
    return full.fillna(dict(fill)).select("x_bin", "y_bin", *measures)


def goal_rate_grid(df: DataFrame, x: str, y: str, x_bins: int = 24, y_bins: int = 16,
                   goal: str = "is_goal") -> DataFrame:
    """Goal rate over the whole pitch; empty cells are zero."""
    goals = F.coalesce(F.sum(F.col(goal).cast("long")), F.lit(0))
    cells = grid(df, x, y, (0.0, PITCH.length, x_bins), (0.0, PITCH.width, y_bins),
                 {"shots": F.count(F.lit(1)), "goals": goals})
    full = complete_grid(cells, x_bins, y_bins, {"shots": 0, "goals": 0})
    return full.withColumn("goal_rate", F.col("goals") / F.greatest(F.col("shots"), F.lit(1)))


def density_grid(df: DataFrame, x: str, y: str, x_bins: int = 30, y_bins: int = 20) -> DataFrame:
    """Counts per cell relative to the fullest cell."""
    cells = grid(df, x, y, (0.0, PITCH.length, x_bins), (0.0, PITCH.width, y_bins), {"n": F.count(F.lit(1))})
    peak = cells.agg(F.max("n")).scalar()
    return cells.withColumn("density", F.col("n") / peak)


def histogram(df: DataFrame, value: str, edges: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Counts and densities per bin (last bin closed), per key. Empty bins are left out."""
    from touchline.functions.numeric import edge_bin

    bins = (
        df.withColumn("bin", edge_bin(F.col(value), edges, last_closed=True))
        .where(F.col("bin").isNotNull())
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    widths = F.array(*[F.lit(edges[i + 1] - edges[i]) for i in range(len(edges) - 1)])
    total = F.sum("n").over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0)))
    return bins.withColumn("density", F.col("n") / total / widths[F.col("bin")])


# ---- top-k ------------------------------------------------------------------------------------------------------


def top_with_baseline(summary: DataFrame, label: str, k: int, baseline: str | None = None,
                      exclude: Sequence[str] = (), min_shots: int | None = None, value: str = "shots") -> DataFrame:
    """The k largest labels, plus the baseline label when it exists. Ties go to the smaller label."""
    pool = summary if min_shots is None else summary.where(F.col(value) >= min_shots)
    left_out = [*exclude, *([baseline] if baseline else [])]
    ranked = pool.where(~F.col(label).isin(left_out)) if left_out else pool
    top = ranked.orderBy(F.col(value).desc(), F.col(label)).limit(k)
    return top.unionByName(summary.where(F.col(label) == baseline)) if baseline else top


def top_abs(df: DataFrame, value: str, k: int, tie: str) -> DataFrame:
    """The k rows with the largest absolute value."""
    return df.orderBy(F.abs(F.col(value)).desc(), F.col(tie)).limit(k)
