"""Readers of the nested JSON layout: competitions.json, matches/<competition>/<season>.json, events/<match>.json."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from touchline import config as C
from touchline.schemas import COMPETITION_DOC, EVENT_DOC, MATCH_DOC


def explode_documents(texts: DataFrame, text: str, schema: T.StructType, position: str) -> DataFrame:
    """Parse JSON arrays of documents and give each element its position in the array. A text that does not parse, or a field of another
    type, fails the job: a match that vanishes silently would falsify every count after it."""
    parsed = F.from_json(F.col(text), T.ArrayType(schema), {"mode": "FAILFAST"})
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.posexplode(parsed).alias(position, "__doc")).select(*keep, position, "__doc.*")


def tolerant_documents(texts: DataFrame, text: str, schema: T.StructType, position: str) -> DataFrame:
    """As ``explode_documents``, but nothing fails: a text that is no JSON array is one row without a position, an element that does not fit
    the schema one row without fields. ``reject`` holds the text of either and is null for documents that were read."""
    keep = [c for c in texts.columns if c != text]
    elements = texts.withColumn("__all", F.from_json(F.col(text), T.ArrayType(T.StringType())))
    whole = F.when(F.col("__all").isNull(), F.coalesce(F.col(text), F.lit("")))
    rows = elements.where("__all is null or size(__all) > 0").select(*keep, whole.alias("__text"), F.posexplode_outer("__all").alias(position, "__one"))
    marked = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    parsed = F.from_json("__one", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = rows.withColumn("__doc", parsed).withColumn(
        "reject", F.when(F.col("__text").isNotNull(), F.col("__text")).when(F.col("__one").isNull(), F.lit("null")).otherwise(F.col("__doc.__bad"))
    )
    fields = [F.when(F.col("reject").isNull(), F.col("__doc").getField(f.name)).alias(f.name) for f in schema.fields]
    return rows.select(*keep, position, "reject", *fields)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("__path", F.input_file_name())


def read_competitions(spark: SparkSession, root: str) -> DataFrame:
    """Competition documents; an absent file gives an empty table."""
    try:
        return explode_documents(spark.read.text(f"{root}/competitions.json", wholetext=True), "value", COMPETITION_DOC, "doc_seq")
    except Exception as error:  # noqa: BLE001 - Spark reports a missing path only by its error class
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("doc_seq", T.IntegerType()), *COMPETITION_DOC.fields]))


def read_matches(spark: SparkSession, root: str) -> DataFrame:
    """Match documents with the competition and season id taken from the file name."""
    files = _files(spark, f"{root}/matches/*/*.json")
    ids = [F.regexp_extract("__path", r"matches/(\d+)/(\d+)\.json", i).cast("long") for i in (1, 2)]
    return explode_documents(
        files.select("value", ids[0].alias("competition_id"), ids[1].alias("season_id")), "value", MATCH_DOC, "doc_seq"
    )


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """Event documents with match id and position. One file is one match, the unit of parallelism of this layout."""
    return explode_documents(event_texts(spark, root), "value", EVENT_DOC, "event_seq")


def event_texts(spark: SparkSession, root: str) -> DataFrame:
    """Event files as (value, match_id)."""
    match_id = F.regexp_extract("__path", r"events/(\d+)\.json", 1).cast("long")
    return _files(spark, f"{root}/events/*.json").select("value", match_id.alias("match_id"))


def stream_events(spark: SparkSession, root: str) -> DataFrame:
    """The same reader as a stream over newly arriving files."""
    files = spark.readStream.format("text").option("wholetext", True).load(f"{root}/events/")
    match_id = F.regexp_extract(F.input_file_name(), r"(\d+)\.json", 1).cast("long")
    return explode_documents(files.select("value", match_id.alias("match_id")), "value", EVENT_DOC, "event_seq")


def _matches_filter(rule: Mapping[str, object], ids: tuple[str, str], names: tuple[str, str]) -> Column:
    """An exact id pair, else substrings of both names."""
    if rule.get("competition_id") is not None and rule.get("season_id") is not None:
        return (F.col(ids[0]) == rule["competition_id"]) & (F.col(ids[1]) == rule["season_id"])
    return F.col(names[0]).contains(str(rule.get("name", ""))) & F.col(names[1]).contains(str(rule.get("season", "")))


def discover_competitions(competitions: DataFrame, filters: Iterable[Mapping[str, object]] | None = None,
                          ids: tuple[str, str] = ("competition_id", "season_id"),
                          names: tuple[str, str] = ("competition_name", "season_name")) -> DataFrame:
    """Competitions that satisfy at least one filter, each once. The filters become one pushed-down predicate."""
    cond = F.lit(False)
    for rule in C.DEFAULT_SCOPE if filters is None else filters:
        cond = cond | F.coalesce(_matches_filter(rule, ids, names), F.lit(False))
    return competitions.where(cond)


def discover_matches(matches: DataFrame, selected: DataFrame, ids: tuple[str, str] = ("competition_id", "season_id"),
                     names: tuple[str, str] = ("competition_name", "season_name")) -> DataFrame:
    """Matches of the selected competitions, decorated with the competition and season names."""
    columns = [c for c in matches.columns if c not in names]
    return matches.select(*columns).join(selected.select(*ids, *names).distinct(), list(ids))
