"""Versioned datasets, report tables and prediction runs on a shared file system."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: dataset names per version ---
VERSIONS = {"enriched": "cxg_dataset_enriched", "filtered": "cxg_dataset_filtered", "raw": "cxg_dataset"}
TRAINING_ORDER = ["enriched", "filtered", "raw"]
DEFAULT_ORDER = ["filtered", "raw"]


def _try_read(spark: SparkSession, path: str, kind: str, schema: T.StructType | None) -> DataFrame | None:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        if kind == "parquet":
            return reader.parquet(path)
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    except Exception as error:  # noqa: BLE001 - Spark reports a missing path only by its error class
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_dataset(spark: SparkSession, root: str, versions: Sequence[str] = DEFAULT_ORDER,
                 schema: T.StructType | None = None) -> tuple[DataFrame, str]:
    """First dataset that exists, trying parquet then csv for each version in order; returns it with its version."""
    for version in versions:
        for kind in ("parquet", "csv"):
            found = _try_read(spark, f"{root}/{VERSIONS[version]}.{kind}", kind, schema)
            if found is not None:
                return found, version
    raise FileNotFoundError(f"no dataset of versions {list(versions)} under {root}")


def write_dataset(df: DataFrame, root: str, version: str, csv: bool = False,
                  partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{root}/{VERSIONS[version]}.parquet")
    if csv:
        df.write.mode("overwrite").option("header", True).csv(f"{root}/{VERSIONS[version]}.csv")


def write_reports(tables: Mapping[str, DataFrame], root: str, kind: str = "csv") -> None:
    """Summary tables. They are small aggregates, so each is written as one file."""
    for name, table in tables.items():
        writer = table.coalesce(1).write.mode("overwrite")
        if kind == "csv":
            writer.option("header", True).csv(f"{root}/{name}")
        else:
            writer.json(f"{root}/{name}")


def read_report(spark: SparkSession, root: str, name: str, kind: str = "csv") -> DataFrame:
    reader = spark.read
    return reader.json(f"{root}/{name}") if kind == "json" else reader.option("header", True).option("inferSchema", True).csv(f"{root}/{name}")


def run_tag(tag: str | None = None) -> str:
    return tag or datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S")


def write_run(root: str, tag: str | None, scored: DataFrame, matches: DataFrame, teams: DataFrame) -> str:
    """Store a prediction run under ``run=<tag>`` partitions of three tables."""
    run = run_tag(tag)
    for name, table in (("scored_shots", scored), ("match_aggregates", matches), ("team_aggregates", teams)):
        table.write.mode("overwrite").parquet(f"{root}/{name}/run={run}")
    return run


def read_run(spark: SparkSession, root: str, table: str, run: str | None = None) -> DataFrame:
    """A table of one run, or of all runs with their tag; the filter prunes the other directories."""
    df = spark.read.parquet(f"{root}/{table}").withColumn("run", F.col("run").cast("string"))
    return df if run is None else df.where(F.col("run") == run)


def list_runs(spark: SparkSession, root: str, table: str = "team_aggregates") -> DataFrame:
    return spark.read.parquet(f"{root}/{table}").select(F.col("run").cast("string").alias("run")).distinct().orderBy("run")
