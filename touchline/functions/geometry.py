"""Shot geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.config import PITCH, PitchConfig


def distance(x: Column, y: Column, target_x: float | None = None, target_y: float | None = None,
             pitch: PitchConfig = PITCH) -> Column:
    """Straight-line distance to a target point, the goal centre unless given."""
    dx = F.lit(pitch.goal_x if target_x is None else float(target_x)) - x
    dy = F.lit(pitch.goal_y if target_y is None else float(target_y)) - y
    return F.sqrt(dx * dx + dy * dy)


def shot_angle(x: Column, y: Column, pitch: PitchConfig = PITCH) -> Column:
    """Angle in radians between the lines to both posts; 0 on a post, null without a location."""
    dx = F.lit(pitch.goal_x) - x
    to_left = F.lit(pitch.left_post_y) - y
    to_right = F.lit(pitch.right_post_y) - y
    norm = F.sqrt(dx * dx + to_left * to_left) * F.sqrt(dx * dx + to_right * to_right)
    cosine = F.try_divide(dx * dx + to_left * to_right, norm)
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(norm == 0, F.lit(0.0)).otherwise(
        F.acos(bounded)
    )


def centrality(y: Column, pitch: PitchConfig = PITCH) -> Column:
    return F.abs(y - F.lit(pitch.goal_y))


def goal_line_distance(x: Column, pitch: PitchConfig = PITCH) -> Column:
    return F.lit(pitch.goal_x) - x


def zone(dist: Column, central: Column, pitch: PitchConfig = PITCH) -> Column:
    """Zone letter: three distance rings, each split into a central and a wide half. Both cuts are inclusive."""
    is_central = central <= pitch.central_band
    return (
        F.when(dist.isNull() | central.isNull(), F.lit(None).cast("string"))
        .when(dist <= pitch.near_distance, F.when(is_central, "A").otherwise("B"))
        .when(dist <= pitch.mid_distance, F.when(is_central, "C").otherwise("D"))
        .otherwise(F.when(is_central, "E").otherwise("F"))
    )


def geometry_columns(x: Column, y: Column, pitch: PitchConfig = PITCH) -> dict[str, Column]:
    """All geometry features, ready for ``DataFrame.withColumns``."""
    dist, central = distance(x, y, pitch=pitch), centrality(y, pitch)
    return {
        "shot_distance": dist,
        "shot_angle": shot_angle(x, y, pitch),
        "centrality": central,
        "distance_to_goal_line": goal_line_distance(x, pitch),
        "zone_id": zone(dist, central, pitch),
    }
