"""Backward as-of join: for each left row, the latest right row at or before it in the same group.

Both sides are stacked and ordered, and a running "last payload" answers every left row in one pass: linear work, no range
join. Hot groups are cut into blocks by ``OrderedScan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.blocks import DEFAULT_POLICY, OrderedScan, SplitDecision, SplitPolicy

_MATCH = "__match"


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
                  left_id: str, right_id: str, payload: Sequence[str], prefix: str = "prev_",
                  within: Sequence[str] = (), tolerance: float | None = None, gap: str | None = None,
                  strict: bool = False, policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
    """Attach the latest right row to every left row.

    ``by`` + ``within`` must be equal on both sides; ``by`` alone decides how rows are distributed. A null key never
    matches: right rows with one are dropped, left rows with one stay and find nothing.
    Of several right rows with the same key the one with the highest ``right_id`` wins. ``strict`` asks for a strictly
    earlier key. ``gap`` names a column for left key minus right key. With a ``tolerance`` the payload of a match further
    away is nulled while the gap stays.
    """
    keys = [*by, *within]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    fields = list(dict.fromkeys(payload))
    body = F.struct(F.col(right_on).alias("__key"), *[F.col(c).alias(f"__p_{c}") for c in fields])
    candidates = right.where(known).select(
        *keys, F.col(right_on).alias("__k"), F.lit(1 if strict else 0).alias("__side"),
        F.col(right_id).alias("__tie"), body.alias("__payload"),
    )
    columns = left.columns
    rows = left.select(
        *columns, F.col(left_on).alias("__k"), F.lit(0 if strict else 1).alias("__side"), F.col(left_id).alias("__tie"),
        F.lit(True).alias("__left"),
    )
    stacked = rows.unionByName(candidates, allowMissingColumns=True)
    matched = (
        OrderedScan(stacked, by, ["__k", "__side", "__tie"], policy)
        .last_seen(_MATCH, F.col("__payload"), within=within)
        .result()
        .where("__left")
    )
    distance = F.col(left_on) - F.col(f"{_MATCH}.__key")
    keep = F.lit(True) if tolerance is None else F.coalesce(distance <= F.lit(tolerance), F.lit(False))
    out = [F.when(keep, F.col(f"{_MATCH}.__p_{c}")).alias(f"{prefix}{c}") for c in fields]
    if gap is not None:
        out.append(distance.alias(gap))
    return matched.select(*columns, *out)
