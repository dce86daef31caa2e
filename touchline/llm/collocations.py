"""Phrase collocations by partitioned mining: frequent in a shard first, counted exactly everywhere afterwards.

Texts are lower-cased, cut into pieces at sentence marks and line ends, and the pieces into words. Everything is counted per language.

1. Rows are dealt to ``SHARDS`` shards by a hash of their text; a shard's support is the whole support times its share of all words. A phrase
   that reaches it in no shard cannot reach the whole support.
2. Each shard is mined completely: tasks turn the words of a few megabytes of text into 64-bit hashes, combine equal phrases and send
   sorted 32-bit remainders to the bucket of their first bits. A bucket sees all shards, counts each by itself, and unites what is locally
   frequent; of these it keeps those whose hash reaches the support over all shards. Different phrases of one hash can only add candidates.
3. The candidates come back as a bit table of a fixed size (``MOST_BITS`` at most). A second pass over all texts counts every phrase whose
   bit is set, as words, exactly; bits set by others cost shuffled rows, never a wrong count. Beyond some billions of candidates the table fills
   and the second pass sends nearly all phrases: slower, still right.
4. Scores, containment and ranks are joins and windows over the frequent phrases, in exact decimals.

Defined cases. A null or empty text has no words; a null language is ``und``. Repeated rows count each time. A text of any length is read
whole, in cuts at places outside words; a piece may be as long as the text. Ties are decided by score, then count, then the phrase's bytes.
Keys and other columns are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.text import LOWER, UPPER, mix
from touchline.operators.joins import salted_join
from touchline.plans.staging import written

SHARDS = 4
SUPPORT = 10
LONGEST = 3
TOP = 2000
BUFFER_BYTES = 8_000_000
PIECE_BYTES = 1_000_000
BUCKET_PHRASES = 3_000_000
MOST_BITS = 28
TOP_BUCKET = 50_000
LEAST_BUCKETS = 16
ROWS_SENT = 50_000
UNKNOWN = "und"

_WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
_NO_WORD = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_BLANK, _MARK, _LETTER = 0, 1, 2
_KIND = np.full(256, _LETTER, np.uint8)
_KIND[[9, 32]] = _BLANK
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[np.frombuffer(UPPER.encode(), np.uint8)] = np.frombuffer(LOWER.encode(), np.uint8)
_CODES = mix(_LOWER.astype(np.uint64), 11)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _cuts(raw: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts of about ``BUFFER_BYTES``, cut outside words. A part begins with the last words of the one before it, and says
    how many: phrases that end in one of them were counted there."""
    at, end, again = 0, 0, 0
    while len(raw) - at > BUFFER_BYTES:
        found = _NO_WORD.search(raw, max(at + BUFFER_BYTES, end + 1))
        if found is None:
            break
        end = found.start()
        yield raw[at:end], again
        start, again = end, 0
        while again < longest - 1 and start > at:
            while start > at and _KIND[raw[start - 1]] != _LETTER:
                start -= 1
            inside = start
            while start > at and _KIND[raw[start - 1]] == _LETTER:
                start -= 1
            again += start < inside
        at = start
    yield raw[at:], again


class Part:
    """The words of some rows: their places in the lower-cased bytes, hashes, rows, and the unit (piece of a row) each lies in."""

    def __init__(self, raws: list[bytes], seeds: np.ndarray, again: np.ndarray) -> None:
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        row_starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(raws), np.uint8)
        kind, head = _KIND[data], np.zeros(len(data) + 1, bool)
        head[row_starts] = True
        hashes, starts, ends, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        while at < len(data):
            end = min(at + PIECE_BYTES, len(data))
            while end < len(data) and kind[end] == _LETTER and not head[end]:
                end += 1
            for found, value in zip((hashes, starts, ends), self._words(data[at:end], kind[at:end], head[at:end], at), strict=True):
                found.append(value)
            at = end
        self.text = _LOWER[data].tobytes()
        self.starts, self.ends, words = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        breaks = np.sort(np.concatenate((np.flatnonzero(kind == _MARK), row_starts)))
        self._unit = np.searchsorted(breaks, self.starts, side="right")
        self.row = np.searchsorted(row_starts, self.starts, side="right") - 1
        with np.errstate(over="ignore"):
            self._words_hash, self._seed = words, seeds[self.row] if len(raws) else np.empty(0, np.uint64)
        first = np.searchsorted(self.row, np.arange(len(raws)))
        self._fresh = np.arange(len(self.row)) - first[self.row] >= again[self.row]

    @staticmethod
    def _words(data: np.ndarray, kind: np.ndarray, head: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = kind == _LETTER
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | head[1:]
        last[:-1] &= ~inside[1:] | head[1:]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_CODES[data] * _powers(_PRIME, len(data)), out=sums[1:])
            return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts], 12), starts + base, ends + base

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the phrases of ``n`` words, and the word each begins with."""
        if len(self.row) < n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        last = len(self.row) - n + 1
        at = np.flatnonzero((self._unit[n - 1 :] == self._unit[:last]) & self._fresh[n - 1 :])
        with np.errstate(over="ignore"):
            value = self._seed[at] + np.uint64(n)
            for k in range(n):
                value = mix(value + self._words_hash[at + k], 13 + k)
        return value, at


def _parts(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Part, list[str], np.ndarray]]:
    """Batches of (text, language, shard) as parts of a few megabytes, with the language and shard of each of their rows."""
    seeds: dict[str, int] = {}
    raws, langs, shards, again, size = [], [], [], [], 0

    def part() -> tuple[Part, list[str], np.ndarray]:
        for lang in set(langs) - seeds.keys():
            seeds[lang] = int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        out = Part(raws, np.array([seeds[x] for x in langs], np.uint64), np.array(again, np.int64)), list(langs), np.array(shards, np.int64)
        for held in (raws, langs, shards, again):
            held.clear()
        return out

    for batch in batches:
        for row in range(batch.num_rows):
            raw = batch.column(0)[row].as_buffer()
            raw = raw.to_pybytes() if raw is not None else b""
            for some, known in _cuts(raw, longest) if len(raw) > BUFFER_BYTES else ((raw, 0),):
                if raws and size + len(some) > BUFFER_BYTES:
                    yield part()
                    size = 0
                raws.append(some)
                langs.append(batch.column(1)[row].as_py())
                shards.append(batch.column(2)[row].as_py())
                again.append(known)
                size += len(some)
    if raws:
        yield part()


_SENT = "bucket int, shard int, once binary, often binary, counts binary"


def _send(bits: int, longest: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, shards in _parts(batches, longest):
            values, owners = [], []
            for n in range(1, longest + 1):
                value, at = part.phrases(n)
                values.append(value)
                owners.append(shards[part.row[at]].astype(np.int8))
            value, owner = np.concatenate(values), np.concatenate(owners)
            del values, owners
            for shard in np.unique(owner).tolist():
                keys, counts = np.unique(value[owner == shard], return_counts=True)
                cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                rest = (keys >> np.uint64(32 - bits)).astype(np.uint32)
                found = [(b, k, c) for b, (k, c) in enumerate(zip(np.split(rest, cuts), np.split(counts, cuts), strict=True)) if len(k)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in found], pa.int32()), pa.array([shard] * len(found), pa.int32()),
                        pa.array([k[c == 1].tobytes() for _, k, c in found], pa.binary()), pa.array([k[c > 1].tobytes() for _, k, c in found], pa.binary()),
                        pa.array([c[c > 1].astype(np.int64).tobytes() for _, _, c in found], pa.binary()),
                    ],
                    names=["bucket", "shard", "once", "often", "counts"],
                )

    return work


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _mine(lowered: dict[int, int], support: int, width: int):
    """A bucket's candidates as the ``2 ** width`` bits of its part of the table."""

    def work(table: pa.Table) -> pa.Table:
        local = {}
        shard = table["shard"].to_numpy()
        for s in np.unique(shard).tolist():
            keys, counts = [], []
            for i in np.flatnonzero(shard == s).tolist():
                once, often, c = (np.frombuffer(table[name][i].as_buffer(), kind) for name, kind in (("once", np.uint32), ("often", np.uint32), ("counts", np.int64)))
                keys += [once, often]
                counts += [np.ones(len(once), np.int64), c]
            local[s] = _summed(np.concatenate(keys), np.concatenate(counts))
        candidates = np.unique(np.concatenate([k[c >= lowered[s]] for s, (k, c) in local.items()]))
        whole = np.zeros(len(candidates), np.int64)
        for k, c in local.values():
            at = np.minimum(np.searchsorted(k, candidates), len(k) - 1)
            whole += np.where(k[at] == candidates, c[at], 0)
        bits = np.zeros(1 << width, bool)
        bits[candidates[whole >= support] >> np.uint32(32 - width)] = True
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return work


def _count(candidates, bits: int, longest: int):
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())

    def phrase_rows(part: Part, langs: list[str], n: int, first: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        words = [[part.text[a:b] for a, b in zip(part.starts[first + k].tolist(), part.ends[first + k].tolist(), strict=True)] for k in range(n)]
        phrases = [b" ".join(phrase).decode("utf-8", "surrogatepass") for phrase in zip(*words, strict=True)]
        columns = ([langs[r] for r in part.row[first].tolist()], [n] * len(first), phrases, counts)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["lang", "n", "phrase", "f"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(candidates.value, np.uint8)
        for part, langs, _ in _parts(batches, longest):
            for n in range(1, longest + 1):
                value, at = part.phrases(n)
                place = value >> np.uint64(64 - bits)
                marked = (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                value, at = value[marked], at[marked]
                _, first, counts = np.unique(value, return_index=True, return_counts=True)
                for some in range(0, len(first), ROWS_SENT):
                    yield phrase_rows(part, langs, n, at[first[some : some + ROWS_SENT]], counts[some : some + ROWS_SENT])

    return work


def frequent_phrases(rows: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """``(phrases, totals)`` of rows with ``_text`` and ``_lang``: all phrases of 1 to ``longest`` words with at least ``support``
    occurrences in their language (lang, n, phrase, f), and all words of each language (lang, total)."""
    spark = rows.sparkSession
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_text"), F.lit(SHARDS)).cast("int"))
    words = written(rows.groupBy("_lang", "_shard").agg(F.sum(F.regexp_count("_text", F.lit(_WORD))).cast("long").alias("words")))
    totals = words.groupBy(F.col("_lang").alias("lang")).agg(F.sum("words").alias("total"))
    share = {r["_shard"]: r["words"] for r in words.groupBy("_shard").agg(F.sum("words").alias("words")).collect()}
    whole = sum(share.values())
    lowered = {s: max(1, -(-support * n // max(1, whole))) for s, n in share.items()}
    bucket_bits = min(20, max(1, math.ceil(math.log2(1 + whole * longest / BUCKET_PHRASES))))
    bits = min(MOST_BITS, max(bucket_bits + 3, math.ceil(math.log2(1 + whole / 8))))
    texts = rows.select(F.col("_text").cast("binary"), "_lang", "_shard")
    parts = texts.mapInArrow(_send(bucket_bits, longest), _SENT).groupBy("bucket").applyInArrow(_mine(lowered, support, bits - bucket_bits), "bucket int, bits binary")
    table = bytearray((1 << bits) // 8)
    size = len(table) >> bucket_bits
    for row in parts.toArrow().to_pylist():
        table[row["bucket"] * size : (row["bucket"] + 1) * size] = row["bits"]
    candidates = spark.sparkContext.broadcast(bytes(table))
    found = texts.mapInArrow(_count(candidates, bits, longest), "lang string, n int, phrase string, f bigint")
    return written(found.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= support)), totals


def collocations(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, inside: int = 50, top: int = TOP, text: str = "text", lang: str = "lang",
) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``longest`` words: ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of
    its lowest-scoring cut, ``n`` all words of the language, ``score`` floor(1000000 * a * a / (l * r)). A phrase goes if a longer frequent one that
    contains it has at least ``inside`` percent of its count."""
    rows = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN)).alias("_lang"))
    phrases, totals = frequent_phrases(rows, support, longest)
    words = F.split("phrase", " ")
    several = phrases.where("n > 1")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "n", "k", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("n")), " ").alias("rest"),
    )
    counts = phrases.select("lang", "phrase", "f")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = salted_join(cuts, counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part], "inner", ["phrase", "k"])

    def big(c: str):
        return F.col(c).cast("decimal(18,0)")

    # the product of two counts has up to 37 digits, that of a million and a square of counts below 10^15 as well; div is exact
    cuts = cuts.withColumn("square", (F.lit(1_000_000).cast("decimal(7,0)") * (big("a") * big("a")).cast("decimal(30,0)")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("product", (big("l") * big("r")).cast("decimal(37,0)")).withColumn("score", F.expr("square div product"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.where("n > 2")
    sub = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("n") - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))))
    around = longer.select("lang", F.explode(F.array_distinct(sub)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < inside * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    # a language is ranked in two steps, so that no task sorts more than a bucket or the firsts of all buckets
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    kept = written(kept)
    buckets = max(LEAST_BUCKETS, kept.count() // TOP_BUCKET)
    kept = kept.withColumn("_bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    kept = kept.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_bucket").orderBy(*order))).where(F.col("_place") <= top)
    # written, so that the buckets are not dealt by language alone
    kept = written(kept)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
