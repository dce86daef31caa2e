"""Benchmark decontamination: an FM-index over each shard of training words, searched backwards for every test phrase.

A shard is the documents a task has read, up to ``SHARD`` words at a time, so memory is bounded whatever the input. Words that occur in
no phrase cannot be part of an occurrence: they end runs, and only runs that could hold the shortest phrase enter the index. Phrases are
found by backward search through the ranks of a wavelet matrix, located by walking to sampled suffix positions, and their spans merged.

Test items reach the tasks in blocks of bounded size, one pass over the documents for each; passes add to the same spans. Documents are
never shuffled.

Defined cases: a null text or a null item has no words; an item of fewer words than a phrase is one phrase; equal items count one by one;
an item with a null key is searched for, but not named; other columns pass through; empty tables give no hits or no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.text import packed

PHRASE = 10
SHARD = 1 << 20
SAMPLE = 8
#: characters of test items that go to the tasks at once
BLOCK_CHARS = 50_000_000

_KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def plain_words(text: str | None) -> bytes:
    """UTF-8 of a text, ASCII letters in lower case, a blank for every other ASCII character but digits. Offsets stay."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEPT)


class WaveletMatrix:
    """Ranks over a sequence of codes, a bit plane for each bit of a code."""

    def __init__(self, codes: np.ndarray, bits: int) -> None:
        self.ones, self.zeros, self.bits = [], [], bits
        for level in reversed(range(bits)):
            bit = (codes >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(codes) - self.ones[-1][-1]))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``code`` stands before position ``at``, for arrays of both."""
        start = np.zeros_like(at)
        for k, level in enumerate(reversed(range(self.bits))):
            one = ((code >> level) & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            a, s = ones[at], ones[start]
            at, start = np.where(one, zeros + a, at - a), np.where(one, zeros + s, start - s)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k in range(self.bits):
            ones, zeros = self.ones[k], self.zeros[k]
            a = ones[at]
            one = ones[at + 1] > a
            out = (out << 1) | one
            at = np.where(one, zeros + a, at - a)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling. A zero ends a run: zeros differ by their places, so no comparison passes one."""
    n = len(text)
    zero = text == 0
    rank = text.astype(np.int64) + n
    rank[zero] = np.arange(n)[zero]
    rank = np.unique(rank, return_inverse=True)[1]
    width = 1
    while True:
        after = np.concatenate([rank[width:] + 1, np.zeros(min(width, n), np.int64)])
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, largest: int) -> None:
        order = suffix_array(text)
        last = text[order - 1]  # of the suffix at 0 this is the text's end, which is a zero
        bits = max(1, int(largest).bit_length())
        self.tree = WaveletMatrix(last.astype(np.int64), bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))])
        self.size = len(text)
        # sampled positions; the start of each run is one, so that no walk passes a zero
        self.kept = (order % SAMPLE == 0) | (last == 0)
        self.place, self.order = np.cumsum(self.kept) - 1, order[self.kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase. ``phrases``: codes, one row each, filled up on the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1]):
            on = np.flatnonzero((lengths > k) & (low < high))
            if len(on) == 0:
                break
            code = phrases[on, phrases.shape[1] - 1 - k]
            low[on] = self.first[code] + self.tree.rank(code, low[on])
            high[on] = self.first[code] + self.tree.rank(code, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, walked, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        on = np.arange(len(rows))
        while len(on):
            here = rows[on]
            done = self.kept[here]
            out[on[done]] = self.order[self.place[here[done]]] + walked[on[done]]
            on = on[~done]
            code = self.tree.access(rows[on])
            rows[on] = self.first[code] + self.tree.rank(code, rows[on])
            walked[on] += 1
        return out


class Phrases:
    """The phrases of a block of test items, coded by the words that occur in them."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = PHRASE) -> None:
        self.codes: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.names: list[str | None] = []
        for name, text in items:
            words = [self.codes.setdefault(w, len(self.codes) + 1) for w in plain_words(text).split()]
            self.names.append(name)
            for i in range(max(1, len(words) - size + 1) if words else 0):
                found.setdefault(tuple(words[i : i + size]), set()).add(len(self.names) - 1)
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.width = int(self.lengths.max(initial=0))
        self.shortest = int(self.lengths.min(initial=1 << 40))
        self.table = np.zeros((len(found), self.width), np.int64)
        for i, p in enumerate(found):
            self.table[i, self.width - len(p) :] = p
        self.items = list(found.values())

    def occurrences(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """For each text, its word spans inside phrases, merged, and the numbers of the items they come from."""
        out: list[tuple[list[tuple[int, int]], set[int]]] = [([], set()) for _ in texts]
        get = self.codes.get
        coded = [np.array([get(w, 0) for w in t] + [0], np.int64) for t in texts]
        if not coded or not len(self.table):
            return out
        starts = np.cumsum([0] + [len(c) for c in coded])
        codes = np.concatenate(coded)
        edges = np.diff(np.concatenate([[0], (codes != 0).astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long_enough = end - begin >= self.shortest
        begin, end = begin[long_enough], end[long_enough] + 1  # with the zero behind it
        if not len(begin):
            return out
        sizes = end - begin
        origin = np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        index = FMIndex(codes[origin], len(self.codes))
        low, high = index.search(self.table, self.lengths)
        hits = np.flatnonzero(low < high)
        counts = (high - low)[hits]
        rows = np.arange(counts.sum()) + np.repeat(low[hits] - (np.cumsum(counts) - counts), counts)
        phrase, at = np.repeat(hits, counts), origin[index.locate(rows)]
        doc = np.searchsorted(starts, at, side="right") - 1
        at = at - starts[doc]
        order = np.lexsort((at, doc))
        for k in order:
            spans, items = out[doc[k]]
            a, b = int(at[k]), int(at[k] + self.lengths[phrase[k]])
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
            items |= self.items[phrase[k]]
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shards(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches of up to ``SHARD`` words, or of one text, with their words."""
    for batch in batches:
        words, begin, total = [], 0, 0
        for i, t in enumerate(batch.column(text).to_pylist()):
            words.append(plain_words(t).split())
            total += len(words[-1]) + 1
            if total >= SHARD:
                yield batch.slice(begin, i + 1 - begin), words
                words, begin, total = [], i + 1, 0
        if words:
            yield batch.slice(begin), words


def _blocks(items: DataFrame, key: str, text: str, size: int) -> list[Phrases]:
    items = items.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null")
    chars = items.agg(F.sum(F.length("t") + F.lit(1))).first()[0] or 0
    count = -(-chars // BLOCK_CHARS)
    dealt = items.withColumn("b", F.pmod(F.xxhash64("k", "t"), F.lit(max(1, count))))
    return [Phrases([(r.k, r.t) for r in dealt.where(F.col("b") == b).select("k", "t").collect()], size) for b in range(count)]


_FOUND = T.StructType(
    [
        T.StructField("_words", T.LongType()),
        T.StructField("_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("_items", T.ArrayType(T.StringType())),
    ]
)


def phrase_hits(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", size: int = PHRASE) -> DataFrame:
    """Each document as ``_row`` with ``_words`` (their number), ``_spans`` (merged, in words) and ``_items`` (keys, as strings)."""
    rows = packed(docs, text).withColumns(
        {"_words": F.lit(0).cast("long"), "_spans": F.array().cast(_FOUND["_spans"].dataType), "_items": F.array().cast("array<string>")}
    )
    spark = docs.sparkSession
    for phrases in _blocks(items, item_key, item_text, size) or [Phrases([], size)]:
        rows = rows.mapInArrow(_pass(spark.sparkContext.broadcast(phrases)), rows.schema)
    return rows


def _pass(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch, words in _shards(batches, 1):
            found = phrases.occurrences(words)
            spans, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, (more, numbers) in enumerate(found):
                if more:
                    spans[i] = [{"start": a, "end": b} for a, b in _merged([(s["start"], s["end"]) for s in spans[i]] + more)]
                    items[i] = items[i] + [phrases.names[k] for k in numbers if phrases.names[k] is not None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()),
                 pa.array(spans, batch.schema.field(3).type), pa.array(items, batch.schema.field(4).type)],
                schema=batch.schema,
            )

    return work


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", **names) -> DataFrame:
    """A row for each document: words, words hit, items met, their keys as a digest, spans, and whether it is contaminated."""
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    keys = F.array_distinct("_items")  # items that repeat a key count once
    return phrase_hits(docs, items, **names).select(
        F.col("_row")[key].alias(key), F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size(keys).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(keys), ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"),
        F.array_join(F.transform("_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in _WORD.finditer(plain_words(text))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def without_phrases(docs: DataFrame, items: DataFrame, text: str = "text", chars: str = "n_chars", **names) -> DataFrame:
    """The documents with every phrase cut out, until none is left; those without a word left go. ``chars``, where there is such a
    column, gets the new length. Documents without a phrase come back as they were."""
    rows = phrase_hits(docs, items, text, **names)
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in _blocks(items, names.get("item_key", "item_id"), names.get("item_text", "text"), names.get("size", PHRASE))]

    def clean(texts: list[str], spans: list[list[tuple[int, int]]]) -> list[str]:
        open_at = list(range(len(texts)))
        while open_at:
            for i, s in zip(open_at, spans, strict=True):
                texts[i] = cut(texts[i], s)
            found = [[] for _ in open_at]
            for b in blocks:
                for k, (s, _) in enumerate(b.value.occurrences([plain_words(texts[i]).split() for i in open_at])):
                    found[k] += s
            left = [k for k, s in enumerate(found) if s]
            open_at, spans = [open_at[k] for k in left], [_merged(found[k]) for k in left]
        return texts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            hit = [i for i, s in enumerate(spans) if s]
            for i, t in zip(hit, clean([texts[i] for i in hit], [[(s["start"], s["end"]) for s in spans[i]] for i in hit]), strict=True):
                texts[i] = t
            gone = np.array([bool(spans[i]) and not plain_words(texts[i]).split() for i in range(len(texts))], bool)
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([bool(s) for s in spans], pa.bool_())], names=["_row", "_text", "_cut"]
            )
            yield out.filter(pa.array(~gone))

    schema = T.StructType([rows.schema["_row"], T.StructField("_text", T.StringType()), T.StructField("_cut", T.BooleanType())])
    rows = rows.mapInArrow(work, schema)
    changed = {text: F.col("_text")} | ({chars: F.length("_text").cast(docs.schema[chars].dataType)} if chars in docs.columns else {})
    return rows.select(
        *[(F.when(F.col("_cut"), changed[c]).otherwise(F.col("_row")[c]) if c in changed else F.col("_row")[c]).alias(c) for c in docs.columns]
    )


