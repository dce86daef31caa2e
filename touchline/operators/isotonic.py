"""Isotonic regression without gathering the scores: blocks are pooled apart, then their borders.

The fit of a score is the slope of the greatest convex minorant of the running sums (weight, target) at that score. A point that lies on or
above a chord of others is no corner of it, whatever comes later, so blocks of consecutive points are reduced apart, each by one fold over its
points, and what is left is numbered and reduced again. Blocks are moved by half their size every other round; when two rounds in a row
remove nothing, each point is a corner between its neighbours, and so all of them are. A task never holds more than a block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.asof import asof_backward
from touchline.operators.blocks import DEFAULT_POLICY, OrderedScan, SplitDecision, SplitPolicy
from touchline.operators.joins import broadcast_if_small
from touchline.plans.staging import written

BLOCK = 512
_ALL = "__all"
_POINT = "struct<pos: bigint, score: double, w: double, s: double>"


def _corners(points: Column) -> Column:
    """Lower corners of points in order: a new point drops those that lie on or above the chord that reaches it."""
    def keep(stack: Column, p: Column):
        def corner(q: Column, k: Column) -> Column:
            a = F.element_at(stack, k)
            return F.when(k == 0, True).otherwise((q["s"] - a["s"]) * (p["w"] - a["w"]) < (p["s"] - a["s"]) * (q["w"] - a["w"]))

        return F.concat(F.filter(stack, corner), F.array(p))

    return F.aggregate(points, F.array().cast(f"array<{_POINT}>"), keep)


@dataclass
class Isotonic:
    """Steps of the fit: scores from ``start`` to ``upto`` have ``value``; between two steps it is interpolated, outside it is the nearest one."""

    steps: DataFrame
    last: float | None

    def transform(self, df: DataFrame, score: str, output: str, policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> DataFrame:
        if self.last is None:
            return df.withColumn(output, F.when(F.col(score).isNotNull(), F.lit(None).cast("double")))
        # the fit of each distinct score, however many rows have it; the rows themselves only meet it in a join
        scores = df.select(F.col(score).cast("double").alias("__iso_x")).where("__iso_x is not null and not isnan(__iso_x)").distinct()
        scores = written(scores).withColumns({_ALL: F.lit(0), "__iso_at": -F.col("__iso_x"), "__iso_id": F.lit(0).cast("long")})
        right = self.steps.select(F.lit(0).alias(_ALL), (-F.col("upto")).alias("__iso_upto"), F.lit(0).cast("long").alias("__iso_step"), "start", "value", "old_upto", "old_value")
        # the smallest upper end at or above a score is the latest step of the negated ones
        found = asof_backward(scores, right, [_ALL], "__iso_at", "__iso_upto", "__iso_id", "__iso_step", ["start", "value", "old_upto", "old_value"], prefix="__at_", policy=policy)
        x, start, value, old, low = F.col("__iso_x"), *[F.col(f"__at_{c}") for c in ("start", "value", "old_upto", "old_value")]
        between = low + (value - low) * (x - old) / (start - old)
        fitted = F.when(value.isNull(), F.lit(self.last)).when((x < start) & old.isNotNull(), between).otherwise(value)
        table = written(found.select("__iso_x", fitted.alias(output)))
        rows = df.withColumn("__iso_x", F.nullif(F.col(score).cast("double"), F.lit(float("nan"))))
        return rows.join(broadcast_if_small(table), "__iso_x", "left").select(*[F.col(f"`{c}`") for c in df.columns], output)


def fit_isotonic(df: DataFrame, score: str, target: Column, policy: SplitPolicy | SplitDecision = DEFAULT_POLICY) -> Isotonic:
    """Non-decreasing fit of ``target`` on ``score``, least squares; rows without either are left out."""
    rows = df.select(F.col(score).cast("double").alias("score"), target.cast("double").alias("y")).where("score is not null and not isnan(score) and y is not null")
    cells = rows.groupBy((F.col("score") + 0.0).alias("score")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("y"))
    cells = written(cells.withColumn(_ALL, F.lit(0)))
    scan = OrderedScan(cells, [_ALL], ["score"], policy).running_sum("w", F.col("n"), inclusive=True).running_sum("s", F.col("y"), inclusive=True)
    points = written(scan.row_number("pos").result().select(_ALL, "score", F.col("pos").cast("long").alias("pos"), F.col("w").cast("double").alias("w"), F.col("s").cast("double").alias("s")))
    total = points.count()
    spark = df.sparkSession
    if not total:
        return Isotonic(spark.createDataFrame([], "upto double, value double, start double, old_upto double, old_value double"), None)
    origin = spark.createDataFrame([(0, None, 0, 0.0, 0.0)], f"{_ALL} int, score double, pos long, w double, s double")
    corners, left, quiet, shift = points.unionByName(origin), total + 1, 0, 0
    while True:
        # points are numbered anew, so that blocks stay full
        numbered = OrderedScan(corners, [_ALL], ["pos"], policy).row_number("__n").result()
        blocks = numbered.groupBy(F.floor((F.col("__n") + shift) / BLOCK).alias("b")).agg(F.sort_array(F.collect_list(F.struct("pos", "score", "w", "s").cast(_POINT))).alias("p"))
        corners = written(blocks.select(F.explode(_corners(F.col("p"))).alias("p")).select(F.lit(0).alias(_ALL), "p.*"))
        now = corners.count()
        quiet = quiet + 1 if now == left else 0
        whole = left <= BLOCK - 1 and not shift
        left, shift = now, BLOCK // 2 - shift
        if quiet == 2 or whole:
            break
    before = OrderedScan(corners, [_ALL], ["pos"], policy).last_seen("a", F.struct("pos", "w", "s"), inclusive=False).result().where("pos > 0")
    steps = before.select(F.col("pos"), F.col("score").alias("upto"), ((F.col("s") - F.col("a.s")) / (F.col("w") - F.col("a.w"))).alias("value"), (F.col("a.pos") + 1).alias("first"))
    starts = points.select(F.col("pos").alias("first"), F.col("score").alias("start"))
    steps = written(steps.join(starts, "first").withColumn(_ALL, F.lit(0)))
    steps = OrderedScan(steps, [_ALL], ["pos"], policy).last_seen("old", F.struct("upto", "value"), inclusive=False).result()
    steps = written(steps.select("upto", "value", "start", F.col("old.upto").alias("old_upto"), F.col("old.value").alias("old_value")))
    return Isotonic(steps, steps.agg(F.max_by("value", "upto")).first()[0])
