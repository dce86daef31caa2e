"""Best-fit packing of token sequences, in bulk-synchronous steps.

Documents become pieces of at most ``most`` ids. Pieces are range-sorted by length, longest first, gaps (open sequences) by what they
still take. One step serves all pieces of one length at once: each asks for its successor, the smallest gap that takes it; pieces that
ask for one gap are ordered by rank, those that get nothing open sequences of their own, gaps are updated, and the next length follows.
Steps therefore number at most ``most``.

What a step decides depends on how many pieces have a length, not on which. So ranks and counts are made by distributed aggregates, a
step works on runs of equal gaps, and its decision (ranks a..b of this length go to sequences from c on) is applied to all pieces by a
lookup inside the row. The state of runs is bounded by ``most``, whatever the number of documents, and no piece passes through the driver.
Pieces that carry their ids are not moved for their ranks: the task that makes them numbers those of each length, and what the parts before
it have of that length is added inside the row (``most`` numbers a part go to all tasks).

Defined cases: a null or empty text is the end id alone; a document longer than ``most`` is cut, others never; equal keys and rows that
repeat are packed each for itself, in any order among themselves; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.shared import written
from touchline.llm.tokens import read_tokenizer, shared_encoder

MOST = 2048
#: pieces of one length that one task ranks at once
RANKED = 100_000
STEPS = "length bigint, _steps array<struct<rank: bigint, sequence: bigint, each: bigint, offset: bigint>>"


def token_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", most: int = MOST, end_id: int = 0, numbered: bool = False) -> DataFrame:
    """(key, piece, start, length, ids) of each piece; ``ids`` are little-endian unsigned 32-bit numbers. If ``numbered``, also the part that
    a piece is made in and its number, from 0, among those of its length there: the result is then to be written before it is used."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    rows = docs.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = shared_encoder(shared.value), TaskContext.get()
        part, seen = task.partitionId() if task else 0, [0] * (most + 1)
        for batch in batches:
            found = encode.each(batch.column(1))
            for at in range(0, batch.num_rows, 512):
                who, piece, length, out, number = [], [], [], [], []
                for i, ids in enumerate(islice(found, 512), at):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, a in enumerate(range(0, len(ids), most)):
                        some = ids[a : a + most]
                        who.append(i)
                        piece.append(k)
                        length.append(len(some))
                        out.append(some.tobytes())
                        number.append(seen[len(some)])
                        seen[len(some)] += 1
                piece = np.array(piece, np.int32)
                columns = [batch.column(0).take(pa.array(who, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * most), pa.array(length, pa.int64()), pa.array(out, pa.binary())]
                if numbered:
                    columns += [pa.array(np.full(len(piece), part, np.int32)), pa.array(number, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType())]
    kinds += [("_part", T.IntegerType()), ("_number", T.LongType())] if numbered else []
    names = [key, *[n for n, _ in kinds]]
    return rows.mapInArrow(work, T.StructType([rows.schema[0], *[T.StructField(n, k) for n, k in kinds]]))


@dataclass
class Decisions:
    """Ranks from ``rank`` on, of one length, go to sequences from ``sequence`` on, ``each`` to one, from place ``offset`` on."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)

    def add(self, *row: int) -> None:
        for column, value in zip((self.length, self.rank, self.sequence, self.each, self.offset), row, strict=True):
            column.append(value)


def best_fit(counts: dict[int, int], most: int = MOST) -> Decisions:
    """The steps over runs of equal gaps: ``gaps[g]`` lists (first sequence, number) of open sequences that still take ``g`` ids."""
    out, opened = Decisions(), 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for gap in sorted(g for g in gaps if g >= length):
            each, after = gap // length, []
            for first, number in gaps.pop(gap):
                full = min(number, left // each)
                if full:
                    out.add(length, rank, first, each, most - gap)
                    after.append((gap - each * length, first, full))
                    rank, left = rank + full * each, left - full * each
                if full < number and left:  # fewer pieces are left than one gap takes
                    out.add(length, rank, first + full, each, most - gap)
                    after.append((gap - left * length, first + full, 1))
                    rank, left, full = rank + left, 0, full + 1
                if full < number:
                    after.append((gap, first + full, number - full))
            for g, first, number in after:
                if g:
                    gaps.setdefault(g, []).append((first, number))
            if not left:
                break
        if left:
            each = most // length
            out.add(length, rank, opened, each, 0)
            full, rest = divmod(left, each)
            for number, used in ((full, each * length), (1 if rest else 0, rest * length)):
                if number and used < most:
                    gaps.setdefault(most - used, []).append((opened, number))
                opened += number
    return out


def ranked(pieces: DataFrame, order: list[str]) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0, without gaps. Pieces of one length are dealt to buckets that one task can
    sort, and the buckets' counts shift their ranks."""
    total = pieces.count()
    buckets = max(1, -(-total // RANKED))
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    shift = counts.select("length", "_bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")).alias("_shift"))
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)))
    return rows.join(shift, ["length", "_bucket"]).withColumn("rank", F.col("_shift") + F.col("_in") - 1).drop("_bucket", "_in", "_shift")


def ranked_by_part(pieces: DataFrame, most: int = MOST) -> DataFrame:
    """The same ``rank`` of written, numbered pieces, in the order of their parts. Rows stay where they are: each part's row of how many pieces
    of a length the parts before it have goes to all tasks."""
    counts = pieces.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = counts.withColumn("n", F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n"))
    held = before.groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("length", "n"))).alias("_m"))
    shifts = held.select("_part", F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.coalesce(F.col("_m")[k.cast("long")], F.lit(0))).alias("_shifts"))
    rows = pieces.join(F.broadcast(shifts), "_part")
    return rows.withColumn("rank", F.element_at("_shifts", F.col("length").cast("int")) + F.col("_number")).drop("_part", "_number", "_shifts")


def packed_pieces(pieces: DataFrame, key: str = "doc_id", most: int = MOST) -> DataFrame:
    """``pieces`` (with ``piece`` and ``length``) and the sequence and place that each one gets."""
    pieces = written(pieces)
    return _placed(pieces, ranked(pieces, [key, "piece"]), most)


def _placed(pieces: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """``rows``, the pieces with their ranks, with ``sequence_id`` and ``offset`` in place of ``rank``."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit(counts, most)
    steps: dict[int, list[tuple[int, ...]]] = {}
    for length, *step in zip(plan.length, plan.rank, plan.sequence, plan.each, plan.offset, strict=True):
        steps.setdefault(length, []).append(tuple(step))
    table = pieces.sparkSession.createDataFrame([(length, sorted(some)) for length, some in steps.items()], STEPS)
    names = [c for c in rows.columns if c != "rank"]
    # rows keep their ids where they are: the last decision of the length that starts at this rank or before is found inside the row
    rows = rows.join(F.broadcast(table), "length")
    rows = rows.withColumn("_step", F.element_at(F.filter("_steps", lambda s: s["rank"] <= F.col("rank")), -1)).withColumn("_k", F.col("rank") - F.col("_step.rank"))
    each = F.col("_step.each")
    return rows.select(
        *names, (F.col("_step.sequence") + F.floor(F.col("_k") / each)).cast("long").alias("sequence_id"),
        (F.col("_step.offset") + F.col("_k") % each * F.col("length")).cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", most: int = MOST, end_id: int = 0) -> DataFrame:
    """Pieces with their ids and their places."""
    pieces = written(token_pieces(docs, tokenizer, key, text, most, end_id, numbered=True))
    columns = [c for c in pieces.columns if c not in ("_part", "_number")]
    # ``length`` first, as ``packed_pieces`` has it
    columns.sort(key=lambda c: c != "length")
    return _placed(pieces, ranked_by_part(pieces, most).select(*columns, "rank"), most)
