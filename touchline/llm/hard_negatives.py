"""Hard negatives by a BOND vertical scan over columnar blocks.

Rows are laid out once as blocks: one array for each dimension, the ids, the labels and each dimension's least and greatest value. An anchor
reads the dimensions of a block in descending order of its own magnitudes. After each few dimensions every candidate's score lies between
its partial sum plus the least and plus the greatest that the unread dimensions can add; candidates that cannot reach the anchor's
best so far, or its windows, leave the bitmap. What is left is read to the end, so windows are decided on exact integers.

Two scans follow each other. The first finds each anchor's best rows of its own label (the positives), the second the best rows of
other labels in the window of each distinct positive score. Anchors are a stated query set: they go through the blocks in groups of at most
``GROUP_BYTES`` of components, one job a group and scan, so neither the driver nor a task ever holds more anchors than that, or more rows than
a block. A task keeps the best few of each anchor and window over all its blocks; what is shuffled are these.

Defined cases. Rows with a null id, label or vector, or a null or non-finite component, take no part; neither do rows whose squared length,
after scaling, is 2^52 or more, as their sums could leave the exact range. Vectors of different length are compared on the
dimensions both have. Repeated rows are candidates each time; an anchor that is repeated whole is one anchor; a row is never its own
positive, nor is another row of its id. Ties go to the smaller id. An anchor without positives, or a window without rows, gives no row.
An empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.plans.staging import written

BLOCK_ROWS, BLOCK_BYTES = 4096, 4_000_000
GROUP_BYTES = 16_000_000
STEP = 8
LEAST_BATCH = 64

_BLOCK = "n int, d int, ids binary, labels binary, columns binary, least binary, most binary"


def clean_rows(vectors: DataFrame, label: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``_id``, ``_label`` and ``_v``, the components as floor(scale * x), of the rows that take part."""
    good = F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("_id"), label.cast("long").alias("_label"), F.col(f"`{vector}`").cast("array<double>").alias("_x"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_x").isNotNull()).where(good)
    # 2^26 is compared before a component becomes a long, so that none is out of range
    square = F.aggregate("_x", F.lit(0.0), lambda s, x: s + F.floor(x * float(scale)).cast("double") * F.floor(x * float(scale)).cast("double"))
    small = F.forall("_x", lambda x: F.abs(x * float(scale)) < float(1 << 26))
    return rows.where(small).where(square < float(1 << 52)).select("_id", "_label", F.transform("_x", lambda x: F.floor(x * float(scale)).cast("long")).alias("_v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix; a shorter row ends in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        values = _matrix(rows["_v"].chunk(0))
        columns = np.ascontiguousarray(values.T)
        # components are below 2^26, so four bytes hold them
        parts = [rows["_id"].to_numpy(), rows["_label"].to_numpy(), columns.astype(np.int32), columns.min(axis=1), columns.max(axis=1)]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([len(values)], pa.int32()), pa.array([values.shape[1]], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
            names=["n", "d", "ids", "labels", "columns", "least", "most"],
        )

    for batch in batches:
        while batch.num_rows:
            widest = max(1, pc.max(batch.column(2).value_lengths()).as_py())
            room = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * widest)) - size)
            held.append(batch.slice(0, room))
            size += held[-1].num_rows
            batch = batch.slice(room)
            if size >= min(BLOCK_ROWS, max(1, BLOCK_BYTES // (4 * widest))):
                yield block()
                size = 0
    if held:
        yield block()


def blocks_of(rows: DataFrame) -> DataFrame:
    """The columnar layout, written once to the shared folder."""
    return written(rows.select("_id", "_label", "_v").mapInArrow(_to_blocks, _BLOCK))


class Block:
    def __init__(self, row: dict) -> None:
        self.n, self.d = row["n"], row["d"]
        self.ids, self.labels, self.least, self.most = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "least", "most"))
        self.columns = np.frombuffer(row["columns"], np.int32).reshape(self.d, self.n)


class Best:
    """The best ``k`` rows seen: score descending, id ascending."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> int | None:
        """What a row must reach at least, once ``k`` are known; a row equal to it may still win by its id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        if len(scores) > self.k:
            # the k-th score by partition, so that many ties are sorted by id alone and once
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= cut
            scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def scan(block: Block, vector: np.ndarray, alive: np.ndarray, windows: list[tuple[int | None, int | None, Best]]) -> None:
    """Add the rows ``alive`` of a block (places) to the best of each window ``[low, high]`` that they fall into."""
    d = min(block.d, len(vector))
    order = np.argsort(-np.abs(vector[:d]), kind="stable")
    q = vector[order]
    low_end, high_end = q * block.least[order], q * block.most[order]
    # what the dimensions from the k-th on can add at least and at most
    rest_low = np.concatenate((np.cumsum(np.minimum(low_end, high_end)[::-1])[::-1], [0]))
    rest_high = np.concatenate((np.cumsum(np.maximum(low_end, high_end)[::-1])[::-1], [0]))
    partial = np.zeros(len(alive), np.int64)
    read = 0
    while True:
        fit = np.zeros(len(alive), bool)
        for low, high, best in windows:
            lower, upper = partial + rest_low[read], partial + rest_high[read]
            inside = np.ones(len(alive), bool)
            if low is not None:
                inside &= upper >= low
            if high is not None:
                inside &= lower <= high
            floor = best.floor()
            if read < d and len(alive) > best.k:
                # rows certain to lie in the window bound the k-th best from below
                sure = lower[(inside if low is None else inside & (lower >= low)) & (True if high is None else upper <= high)]
                if len(sure) >= best.k:
                    kth = int(np.partition(sure, len(sure) - best.k)[len(sure) - best.k])
                    floor = kth if floor is None else max(floor, kth)
            if floor is not None:
                inside &= upper >= floor
            fit |= inside
        if not fit.all():
            alive, partial = alive[fit], partial[fit]
        if read == d or not len(alive):
            break
        # few rows left: the rest is read in one go
        step = order[read : read + STEP] if len(alive) > LEAST_BATCH else order[read:]
        for k in step:
            partial += vector[k] * block.columns[k][alive]
        read += len(step)
    for low, high, best in windows:
        inside = np.ones(len(alive), bool)
        if low is not None:
            inside &= partial >= low
        if high is not None:
            inside &= partial <= high
        if inside.any():
            best.add(partial[inside], block.ids[alive[inside]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.slice(i, 1).to_pylist()[0])


_FOUND = "anchor int, wanted bigint, id bigint, score bigint"


def _positives(anchors, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = anchors.value
        best = [Best(k) for _ in ids]
        by_label = defaultdict(list)
        for a, label in enumerate(labels.tolist()):
            by_label[label].append(a)
        for block in _blocks(batches):
            for label in np.unique(block.labels).tolist():
                places = np.flatnonzero(block.labels == label)
                for a in by_label.get(label, ()):
                    scan(block, vectors[a], places[block.ids[places] != ids[a]], [(None, None, best[a])])
        yield _found([(a, 0, b) for a, b in enumerate(best)])

    return work


def _negatives(anchors, windows):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, labels, vectors = anchors.value
        edges, k = windows.value
        best = {a: {score: Best(k) for score, _, _ in some} for a, some in edges.items()}
        for block in _blocks(batches):
            others = {label: np.flatnonzero(block.labels != label) for label in np.unique(labels).tolist()}
            for a, some in edges.items():
                scan(block, vectors[a], others[int(labels[a])], [(low, high, best[a][score]) for score, low, high in some])
        yield _found([(a, score, b) for a, found in best.items() for score, b in found.items()])

    return work


def _found(rows: list[tuple[int, int, Best]]) -> pa.RecordBatch:
    sizes = [len(b.ids) for _, _, b in rows]
    none = [np.empty(0, np.int64)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat([a for a, _, _ in rows], sizes).astype(np.int32) if rows else [], pa.int32()),
            pa.array(np.repeat([w for _, w, _ in rows], sizes).astype(np.int64) if rows else [], pa.int64()),
            pa.array(np.concatenate(none + [b.ids for _, _, b in rows]), pa.int64()),
            pa.array(np.concatenate(none + [b.scores for _, _, b in rows]), pa.int64()),
        ],
        names=["anchor", "wanted", "id", "score"],
    )


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and window of what the tasks kept; a task sends ``k`` of each at most."""
    w = Window.partitionBy("anchor", "wanted").orderBy(F.col("score").desc(), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


_RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(
    vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    key: str = "vec_id", vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score
    s meets low * p <= 100 * s <= high * p, p being the positive's score. ``is_anchor`` is an expression on ``_id``."""
    spark = vectors.sparkSession
    rows = clean_rows(vectors, label, key, vector, scale)
    blocks = blocks_of(rows)
    anchors = written(rows.where(is_anchor).distinct())
    total, width = anchors.agg(F.count("*"), F.max(F.size("_v"))).first()
    groups = -(-total * 8 * max(1, width or 1) // GROUP_BYTES)
    results = []
    for g in range(groups):
        # anchors are distinct rows, so their hashes spread evenly and a group has its share of them
        some = anchors.where(F.pmod(F.xxhash64("_id", "_label", "_v"), F.lit(groups)) == g).orderBy("_id", "_label", "_v").toArrow().combine_chunks()
        if not some.num_rows:
            continue
        ids, labels = some["_id"].to_numpy(), some["_label"].to_numpy()
        sent = spark.sparkContext.broadcast((ids, labels, _matrix(some["_v"].chunk(0))))
        near = _first(blocks.mapInArrow(_positives(sent, positives), _FOUND), positives).toArrow()
        near = written(spark.createDataFrame(near)) if near.num_rows else None
        if near is None:
            continue
        edges: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for r in near.select("anchor", "score").distinct().orderBy("anchor", "score").toArrow().to_pylist():
            s = r["score"]
            # the integers n with low * s <= 100 * n <= high * s
            first, last = -(-low * s // 100), high * s // 100
            if first <= last:
                edges[r["anchor"]].append((s, first, last))
        windows = spark.sparkContext.broadcast((dict(edges), negatives))
        far = _first(blocks.mapInArrow(_negatives(sent, windows), _FOUND), negatives)
        names = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(len(ids)), pa.int32()), "anchor_id": pa.array(ids, pa.int64())}))
        results.append(written(
            near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            .join(far.select("anchor", F.col("wanted").alias("positive_score"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "place"), ["anchor", "positive_score"])
            .join(F.broadcast(names), "anchor")
            .select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        ))
    if not results:
        return spark.createDataFrame([], _RESULT)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
