"""Token ids in binary files, compressed by a Re-Pair grammar that lets any document be decoded alone.

Documents are range-partitioned by key and sorted, so files follow the order of keys. A task cuts its documents into shards. In a shard,
frequent pairs of symbols are replaced by new ones, many disjoint pairs in each round, until too few are left; no pair spans two documents.
A shard's file holds the rules, how long each rule's expansion is, the symbols in 16 bits and as many planes of single bits as they need, and where documents begin.
Shards are binary values of a table in the shared folder, which any store that Spark writes to can hold; a lost task writes its part again.

Layout, little-endian unsigned: magic ``RPG1``; counts of documents, rules, symbols and planes, and the number of the first rule's symbol (32 bits each); left and right
symbol of each rule (32); length of each rule's expansion (32); first symbol of each document and the end (64); ids before each document
and the end (64); the symbols' low 16 bits; each higher bit of all symbols, packed. In a rule, symbols under ``BASE`` are ids, symbol
``BASE + k`` is rule ``k``.

Defined cases: a null or empty text is the end id alone; repeated keys follow each other, ordered by text; a null key comes first; an
empty table writes no shard and gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.tokens import read_tokenizer, shared_encoder
from touchline.plans.staging import shared_folder

SHARD_IDS = 1 << 19
BASE = 1 << 17
ROUNDS, RULES_A_ROUND, LEAST_COUNT = 3, 4096, 12
TABLE = 1 << 18
_MAGIC = b"RPG1"


def _hashed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) >> np.uint32(14)


def repair(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, symbols, end marks): ``ends`` marks the last id of each document. Pairs are counted in a hashed table of which each slot
    serves one pair, the last that fell into it; others wait for a later round."""
    symbols, rules = ids.astype(np.uint32), np.empty((0, 2), np.uint32)
    for _ in range(ROUNDS):
        if len(symbols) < 2:
            break
        left, right = symbols[:-1], symbols[1:]
        slot = _hashed(left, right)
        held_left, held_right = np.zeros(TABLE, np.uint32), np.zeros(TABLE, np.uint32)
        held_left[slot], held_right[slot] = left, right
        same = np.flatnonzero((held_left[slot] == left) & (held_right[slot] == right) & ~ends[:-1])
        count = np.bincount(slot[same], minlength=TABLE)
        top = np.flatnonzero(count >= LEAST_COUNT)
        top = top[np.argsort(-count[top], kind="stable")[:RULES_A_ROUND]]
        if not len(top):
            break
        rank = np.full(TABLE, -1, np.int32)
        rank[top] = np.arange(len(top))
        chosen = rank[slot[same]]
        at, chosen = same[chosen >= 0], chosen[chosen >= 0]
        # in a run of overlapping pairs every second one is replaced
        first = np.concatenate([[True], np.diff(at) > 1])
        begin = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - begin) % 2 == 0
        at, chosen = at[keep], chosen[keep]
        symbols[at] = BASE + len(rules) + chosen
        ends[at] = ends[at + 1]
        rules = np.concatenate([rules, np.stack([held_left[top], held_right[top]], axis=1)])
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, ends = symbols[stay], ends[stay]
    return rules, symbols, ends


def expansions(rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each rule's expansion in one row of ids, and that row. A rule only names earlier rules."""
    parts: list[bytes] = []
    for left, right in rules.tolist():
        a = parts[left - BASE] if left >= BASE else left.to_bytes(4, "little")
        parts.append(a + (parts[right - BASE] if right >= BASE else right.to_bytes(4, "little")))
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=starts[1:])
    return starts, np.frombuffer(b"".join(parts), "<u4")


def encode_shard(documents: list[np.ndarray]) -> bytes:
    ids = np.concatenate(documents)
    sizes = np.array([len(d) for d in documents], np.int64)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(sizes) - 1] = True
    rules, symbols, ends = repair(ids, ends)
    starts, _ = expansions(rules)
    # rules are numbered after the largest id, so a symbol needs no more bits than there are symbols
    dense = int(ids.max()) + 1
    flat = np.where(symbols >= BASE, symbols - BASE + dense, symbols)
    planes = max(0, int(flat.max()).bit_length() - 16)
    firsts = np.concatenate([[0], np.flatnonzero(ends) + 1])
    return b"".join(
        [
            _MAGIC, np.array([len(documents), len(rules), len(symbols), planes, dense], "<u4").tobytes(), rules.astype("<u4").tobytes(),
            np.diff(starts).astype("<u4").tobytes(), firsts.astype("<u8").tobytes(), np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes(),
            (flat & 0xFFFF).astype("<u2").tobytes(), *[np.packbits((flat >> (16 + k)) & 1, bitorder="little").tobytes() for k in range(planes)],
        ]
    )


class Shard:
    """A shard's file. ``document`` decodes one document from its own symbols alone; ``all`` decodes every one."""

    def __init__(self, blob: bytes) -> None:
        if blob[:4] != _MAGIC:
            raise ValueError("not a shard of token ids")
        self.count, rules, self.symbols, planes, self.dense = (int(x) for x in np.frombuffer(blob, "<u4", 5, 4))
        at = 24
        self.rules = np.frombuffer(blob, "<u4", 2 * rules, at).reshape(rules, 2)
        at += 8 * rules
        self.lengths = np.frombuffer(blob, "<u4", rules, at).astype(np.int64)
        at += 4 * rules
        self.firsts = np.frombuffer(blob, "<u8", self.count + 1, at).astype(np.int64)
        at += 8 * (self.count + 1)
        self.before = np.frombuffer(blob, "<u8", self.count + 1, at).astype(np.int64)
        at += 8 * (self.count + 1)
        self._low, wide = np.frombuffer(blob, "<u2", self.symbols, at), -(-self.symbols // 8)
        at += 2 * self.symbols
        self._high = [np.frombuffer(blob, np.uint8, wide, at + k * wide) for k in range(planes)]
        self._starts, self._row = expansions(self.rules)

    def _ids(self, low: int, high: int) -> np.ndarray:
        """Ids of symbols ``low`` to ``high``."""
        flat = self._low[low:high].astype(np.int32)
        for k, plane in enumerate(self._high):
            bits = np.unpackbits(plane[low // 8 : -(-high // 8)], bitorder="little")[low % 8 :][: high - low]
            flat |= bits.astype(np.int32) << (16 + k)
        rule = flat - self.dense
        is_rule = rule >= 0
        size = np.ones(len(flat), np.int32)
        size[is_rule] = self.lengths[rule[is_rule]]
        begin = np.cumsum(size) - size
        source = np.concatenate([self._row, flat.astype(np.uint32)])
        origin = np.arange(len(flat)) + len(self._row)
        origin[is_rule] = self._starts[rule[is_rule]]
        return source[np.repeat(origin - begin, size) + np.arange(int(size.sum()))].astype("<u4")

    def document(self, k: int) -> np.ndarray:
        return self._ids(int(self.firsts[k]), int(self.firsts[k + 1]))

    def all(self) -> list[np.ndarray]:
        return np.split(self._ids(0, self.symbols), self.before[1:-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Shards of all documents, in the order of keys: (part, shard, keys, blob) in ``path``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(parts, "k").sortWithinPartitions("k", "t")
    keys_type = T.ArrayType(rows.schema["k"].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = shared_encoder(shared.value), TaskContext.get().partitionId(), 0
        keys, held, total = [], [], 0

        def shard():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([total], pa.int64()), pa.array([keys]), pa.array([encode_shard(held)], pa.binary())],
                names=["part", "shard", "ids", "keys", "blob"],
            )

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), encode.each(batch.column(1)), strict=True):
                keys.append(k)
                held.append(np.append(ids, np.uint32(end_id)))
                total += len(held[-1])
                if total >= SHARD_IDS:
                    yield shard()
                    keys, held, total, number = [], [], 0, number + 1
        if held:
            yield shard()

    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("ids", T.LongType()), T.StructField("keys", keys_type), T.StructField("blob", T.BinaryType())]
    )
    rows.mapInArrow(work, schema).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of each document, from the files alone: ``start`` ids stand before it in all files."""
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "shard", "ids")
    # one row for each part meets in one task, then one for each shard of a part
    whole = sizes.groupBy("part").agg(F.sum("ids").alias("n"))
    whole = whole.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("ids")
    placed = sizes.withColumn("inside", inside).join(whole, "part").select("part", "shard", (F.col("inside") + F.col("before")).alias("start"))
    kind = shards.schema["keys"].dataType.elementType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, keys, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard = Shard(blob)
                ids = shard.all()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array([number] * len(ids), pa.int32()), pa.array(keys, batch.schema.field(2).type.value_type),
                     pa.array(shard.before[:-1]), pa.array([len(d) for d in ids], pa.int64()), pa.array([d.tobytes() for d in ids], pa.binary())],
                    names=["part", "shard", key, "inside", "n_tokens", "ids"],
                )

    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField(key, kind), T.StructField("inside", T.LongType()),
         T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    rows = shards.select("part", "shard", "keys", "blob").mapInArrow(work, schema)
    rows = rows.select("part", "shard", key, "inside", "n_tokens", F.crc32("ids").alias("ids_crc32"), "ids")
    return rows.join(placed, ["part", "shard"]).select(key, (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **names) -> str:
    """Write all documents' shards under ``folder``, or under the cluster's shared one; gives the path."""
    path = f"{folder or shared_folder(docs.sparkSession)}/tokens/{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, **names)
    return path

