"""Write an intermediate table once and read it back, so that later steps neither replay its windows nor lose its columns'
pruning. Tables live under the checkpoint folder the cluster names, which executors share and which survives their loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset (tests, one machine) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="touchline-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: its size is then known, and later jobs do not rebuild it."""
    path = f"{shared_folder(df.sparkSession)}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stage(df_builder, spark: SparkSession, name: str) -> DataFrame:
    """Table ``name`` of this application, built and written on first use."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STAGED:
        path = f"{shared_folder(spark)}/staged/{uuid.uuid4().hex}"
        df_builder().write.parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])
