"""Documents to written tables, with counts taken while they are written and with a table of what could not be read."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.operators.normalise import raw_event_rows
from touchline.schemas import EVENT_DOC
from touchline.sources.documents import event_texts, tolerant_documents


def write_observed(df: DataFrame, path: str, counts: Mapping[str, Column], partitions: tuple[str, ...] = ()) -> dict[str, int]:
    """Write a table and return aggregates of its rows from the same job: no scan after it. The metrics sit right under the write, so a
    task that is run again counts once."""
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in counts.items()]).write.mode("overwrite").partitionBy(*partitions).parquet(path)
    return {name: seen.get[name] for name in counts}


def write_tables(tables: Mapping[str, DataFrame], root: str) -> DataFrame:
    """Write each table under ``root``; the lineage report (table, rows) costs no scan."""
    rows = [(name, write_observed(df, f"{root}/{name}", {"rows": F.count(F.lit(1))})["rows"]) for name, df in tables.items()]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table string, rows long")


def ingest_documents(texts: DataFrame, text: str, schema: T.StructType, position: str, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Parse once, write once: accepted documents, rejected ones (``position``, null for a whole text, and ``reject``, the text), and the
    number of both."""
    rows = tolerant_documents(texts, text, schema, position).withColumn("rejected", F.col("reject").isNotNull())
    counts = write_observed(rows, path, {"accepted": F.count_if(~F.col("rejected")), "rejected": F.count_if("rejected")}, ("rejected",))
    found = texts.sparkSession.read.schema(rows.schema).parquet(path)
    kept = [c for c in texts.columns if c != text]
    return found.where("not rejected").drop("rejected", "reject"), found.where("rejected").select(*kept, position, "reject"), counts


def ingest_events(spark: SparkSession, source: str, root: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Event files to raw events under ``root``: each file is parsed once, repeated ids are searched in the written table."""
    documents, rejects, counts = ingest_documents(event_texts(spark, source), "value", EVENT_DOC, "event_seq", f"{root}/documents")
    counts |= write_observed(raw_event_rows(documents), f"{root}/raw", {"raw": F.count(F.lit(1))})
    return spark.read.parquet(f"{root}/raw"), rejects, counts
