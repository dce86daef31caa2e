"""Helpers of the query catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.functions.geometry import geometry_columns
from touchline.plans.context import shot_context
from touchline.plans.staging import stage
from touchline.sources import projections as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# the event view is sparse in time, so a minute is the window that splits its shots
TEST_TOLERANCE = 60


def register(name: str, oracle: str | None = None):
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: rounded(fn(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round doubles and widen integers, so that both engines print the same values. Nine digits keep clear of the ties that
    averages of two-decimal inputs have at six."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c, digits) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long").alias(f.name)
        out.append(c)
    return df.select(*out)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return P.match_events(spark, folder)


def event_shots(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).where(F.col("type") == "Shot")


def shots(spark: SparkSession, folder: str) -> DataFrame:
    return P.order_shots(spark, folder)


def located_shots(spark: SparkSession, folder: str) -> DataFrame:
    return shots(spark, folder).withColumns(geometry_columns(F.col("location_x"), F.col("location_y")))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Event documents, staged once per session: many queries start from them."""
    return stage(lambda: P.event_documents(spark, folder), spark, f"documents:{folder}")


def matches(spark: SparkSession, folder: str) -> DataFrame:
    return P.document_matches(spark, folder)


def fresh_context(spark: SparkSession, folder: str, foot_finish: bool = True) -> DataFrame:
    return shot_context(
        documents(spark, folder), matches(spark, folder), foot_finish=foot_finish, tolerance=TEST_TOLERANCE
    )


def context(spark: SparkSession, folder: str) -> DataFrame:
    """The shot context, staged once per session: the summaries read it as a table."""
    return stage(lambda: fresh_context(spark, folder), spark, f"context:{folder}")
