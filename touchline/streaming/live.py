"""Live ingest and scoring as Structured Streaming jobs.

Each micro-batch runs the batch operators and adds the state left by the batches before it. State is a versioned table in the
shared folder: batch N reads version N-1 and overwrites version N, so a retry after a lost executor gives the same result,
and a busy match is split inside the batch like any other hot group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline import config as C
from touchline.operators.blocks import DEFAULT_POLICY, OrderedScan, SplitPolicy, decide
from touchline.operators.joins import salted_join
from touchline.operators.normalise import event_rows


def deduplicated(docs: DataFrame, delay: str = "2 hours", clock: str = "ingested_at") -> DataFrame:
    """Event documents once per (match, event id), remembering ids for the watermark delay."""
    stamped = docs if clock in docs.columns else docs.withColumn(clock, F.current_timestamp())
    return stamped.withWatermark(clock, delay).dropDuplicatesWithinWatermark(["match_id", "id"])


def ingest_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Normalise arriving documents and append them to the event table."""
    rows = event_rows(deduplicated(docs).drop("ingested_at"))
    return (
        rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start(path)
    )


_STATE = (
    "match_id long, team_id long, goals long, clock long, seq long, "
    "trigger struct<clock:long, seq:long, type:string, team_id:long>, touched long"
)


@dataclass
class LiveScorer:
    """Scores the shots of a stream: score before the shot, last trigger, lateness, and optional enrichment.

    Input columns: match_id, team_id, seq (total order inside a second), clock (match seconds), type, is_goal. A shot before
    the latest clock already processed is flagged late and gets no context: what the state holds may lie after it.
    Nothing is forgotten unless ``keep_batches`` is given: then matches without an event for that many batches are.
    """

    root: str
    enrich: Callable[[DataFrame], DataFrame] | None = None
    keep_batches: int | None = None
    policy: SplitPolicy = DEFAULT_POLICY

    def _state_path(self, batch_id: int) -> str:
        return f"{self.root}/state/batch={batch_id}"

    def _state(self, spark: SparkSession, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return spark.createDataFrame([], _STATE)
        return spark.read.schema(_STATE).parquet(self._state_path(batch_id - 1))

    def score(self, events: DataFrame, state: DataFrame) -> DataFrame:
        """Shots of one batch, continued from the state."""
        seen = events.where((F.col("type") == "Shot") | F.col("type").isin(C.TRIGGER_TYPES))
        scored = F.when((F.col("type") == "Shot") & F.col("is_goal"), 1).otherwise(0).cast("long")
        trigger = F.when(
            F.col("type").isin(C.TRIGGER_TYPES),
            F.struct(F.col("clock").cast("long").alias("clock"), F.col("seq").cast("long").alias("seq"), "type",
                     F.col("team_id").cast("long").alias("team_id")),
        )
        decision = decide(seen, ["match_id"], self.policy)
        # triggers sort before shots of the same second
        shots = (
            OrderedScan(seen.withColumn("__shot", (F.col("type") == "Shot").cast("int")), ["match_id"],
                        ["clock", "__shot", "seq"], decision)
            .running_sum("__own", scored, within=["team_id"])
            .running_sum("__all", scored)
            .last_seen("__trigger", trigger)
            .result()
            .where(F.col("type") == "Shot")
        )
        own = state.where(F.col("team_id").isNotNull()).select("match_id", "team_id", F.col("goals").alias("__own0"))
        whole = state.groupBy("match_id").agg(
            F.sum("goals").alias("__all0"), F.max("clock").alias("__clock0"), F.max("trigger").alias("__trigger0")
        )
        spread = ["seq"]
        joined = salted_join(shots, whole, ["match_id"], "left", spread, policy=decision)
        joined = salted_join(joined, own, ["match_id", "team_id"], "left", spread, policy=decision)
        zero = F.lit(0)
        mine = F.col("__own") + F.coalesce("__own0", zero)
        every = F.col("__all") + F.coalesce("__all0", zero)
        # both sides compare as (clock, seq, ...)
        last = F.greatest("__trigger", "__trigger0")
        late = F.coalesce(F.col("clock") < F.col("__clock0"), F.lit(False))
        out = joined.withColumns(
            {
                "score_diff_at_shot": F.when(~late, (2 * mine - every).cast("long")),
                "late": late,
                "def_event_type": F.when(~late, last["type"]),
                "def_team_id": F.when(~late, last["team_id"]),
                "seconds_since_def_action": F.when(~late, F.col("clock") - last["clock"]),
            }
        )
        return out.drop(*[c for c in out.columns if c.startswith("__")])

    def next_state(self, events: DataFrame, state: DataFrame, batch_id: int) -> DataFrame:
        """Goals per (match, team), latest clock and trigger; one aggregation over the batch and the old state."""
        is_trigger = F.col("type").isin(C.TRIGGER_TYPES)
        fresh = events.select(
            F.col("match_id").cast("long").alias("match_id"), F.col("team_id").cast("long").alias("team_id"),
            F.when((F.col("type") == "Shot") & F.col("is_goal"), 1).otherwise(0).cast("long").alias("goals"),
            F.col("clock").cast("long").alias("clock"), F.col("seq").cast("long").alias("seq"),
            F.when(is_trigger, F.struct(F.col("clock").cast("long").alias("clock"), F.col("seq").cast("long").alias("seq"),
                                        "type", F.col("team_id").cast("long").alias("team_id"))).alias("trigger"),
            F.lit(batch_id).cast("long").alias("touched"),
        )
        kept = state if self.keep_batches is None else state.where(F.col("touched") >= batch_id - self.keep_batches)
        return kept.unionByName(fresh).groupBy("match_id", "team_id").agg(
            F.sum("goals").alias("goals"), F.max("clock").alias("clock"), F.max("seq").alias("seq"),
            F.max("trigger").alias("trigger"), F.max("touched").alias("touched"),
        )

    def process(self, events: DataFrame, batch_id: int) -> None:
        """One micro-batch. Output and state are overwritten under their batch number, so a replay changes nothing."""
        spark = events.sparkSession
        state = self._state(spark, batch_id)
        shots = self.score(events, state)
        if self.enrich is not None:
            shots = self.enrich(shots)
        shots.write.mode("overwrite").parquet(f"{self.root}/shots/batch={batch_id}")
        self.next_state(events, state, batch_id).write.mode("overwrite").parquet(self._state_path(batch_id))

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            events.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    def shots(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/shots")
