"""Numeric helpers: bins, ratios, log-odds, shrinkage and the pressure proxy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.config import LOGIT_EPS, RATING_PRIOR_SHOTS


def clip(value: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; a null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def logit(p: Column, eps: float = LOGIT_EPS) -> Column:
    bounded = clip(p, eps, 1.0 - eps)
    return F.ln(bounded / (F.lit(1.0) - bounded))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is zero or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def shrink(n: Column, mean: Column, overall: Column, prior: float = RATING_PRIOR_SHOTS) -> Column:
    """Weighted pull of a group mean towards the overall mean; an empty group takes the overall mean."""
    blended = (n * mean + F.lit(prior) * overall) / (n + F.lit(prior))
    return F.when(F.coalesce(n, F.lit(0)) > 0, blended).otherwise(overall)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def bin_left_closed(value: Column, edges: Sequence[float | None], labels: Sequence[str],
                    outside: str | None = None, last_closed: bool = False) -> Column:
    """Label of the [low, high) interval holding the value. A last edge of None is unbounded.

    ``outside`` labels nulls and out-of-range values; ``last_closed`` lets the final interval include its upper edge.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("edges must be one longer than labels")
    chain: Column | None = None
    for i, label in enumerate(labels):
        low, high = edges[i], edges[i + 1]
        inside = value >= F.lit(low)
        if high is not None:
            closed = last_closed and i == len(labels) - 1
            inside = inside & ((value <= F.lit(high)) if closed else (value < F.lit(high)))
        chain = F.when(inside, F.lit(label)) if chain is None else chain.when(inside, F.lit(label))
    return chain.otherwise(F.lit(outside).cast("string"))


def linspace(low: float, high: float, count: int) -> list[float]:
    """Evenly spaced doubles, end points included, computed the way numpy does it."""
    import numpy as np

    return [float(v) for v in np.linspace(low, high, count)]


def edge_bin(value: Column, edges: Sequence[float], last_closed: bool = False) -> Column:
    """0-based bin against literal edges: the number of edges not above the value, minus one.

    Values below the first or above the last edge get null. A value equal to the last edge gets null as well unless
    ``last_closed``. Comparing with the literal doubles avoids the rounding of an arithmetic bin formula.
    """
    n = len(edges) - 1
    width = (edges[-1] - edges[0]) / n
    if any(abs(edges[i] - edges[0] - i * width) > 1e-9 * max(1.0, abs(width)) for i in range(n + 1)):
        raise ValueError("edges must be evenly spaced")
    # an arithmetic guess lands at most one bin off; the literal edges on both sides settle it
    table = F.array(*[F.lit(float(e)) for e in edges])
    guess = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((value - F.lit(edges[0])) / F.lit(width)).cast("int")))
    settled = guess + F.when(value < table[guess], -1).when(value >= table[guess + 1], 1).otherwise(0)
    inside = (value >= F.lit(float(edges[0]))) & (value < F.lit(float(edges[-1])))
    result = F.when(inside, settled)
    return result.when(value == F.lit(float(edges[-1])), F.lit(n - 1)) if last_closed else result


def even_bin(value: Column, low: float, high: float, bins: int, last_closed: bool = True) -> Column:
    """0-based equal-width bin over [low, high], null outside. Suits the wide grids, where a chain would be long."""
    width = (high - low) / bins
    raw = F.floor((value - F.lit(low)) / F.lit(width)).cast("int")
    inside = (value >= F.lit(low)) & (value < F.lit(high))
    result = F.when(inside, F.least(raw, F.lit(bins - 1)))
    return result.when(value == F.lit(high), F.lit(bins - 1)) if last_closed else result


def pressure_proxy(under_pressure: Column, recent_actions: Column, duration: Column,
                   mean_actions: float = 1.0, std_actions: float = 1.0,
                   mean_duration: float = 5.0, std_duration: float = 3.0) -> Column:
    """Weighted score of pressure flag, recent defensive actions and (inverse) possession length."""
    flag = F.when(under_pressure, F.lit(1.0)).otherwise(F.lit(0.0))
    actions_z = (recent_actions - F.lit(mean_actions)) / F.lit(std_actions) if std_actions > 0 else F.lit(0.0)
    duration_z: Column = F.lit(0.0)
    if std_duration > 0:
        scale = std_duration / (mean_duration * mean_duration)
        duration_z = (F.lit(1.0) / (F.lit(1.0) + duration) - F.lit(1.0 / (1.0 + mean_duration))) / F.lit(scale)
    return F.lit(0.5) * flag + F.lit(0.3) * actions_z + F.lit(0.2) * duration_z
