"""Token counts of whole texts under a byte-level BPE file, by rank-synchronous merging of arrays.

A text is cut into pre-tokens; those not met before are held together as one ragged numpy array of symbols. A round finds each sequence's
lowest-rank pair and replaces all its occurrences, in every sequence at once; sequences without a pair of the table leave. What is counted
are the symbols left. A merge can only open pairs of higher rank than its own (``Merges`` refuses a file where that does not hold), so one
round for each rank gives what merging one pair at a time gives. Pre-tokens of over ``LONG`` bytes keep the places of each rank in a queue,
so that a round touches its own pairs only.

Defined cases. A null or empty text has no bytes and no tokens. A special string of the file inside a text is one token, as the library's
default has it. Very long texts are cut lazily, ``CHUNK`` pre-tokens at a time, and never shortened. A repeated row gives a row each time; the
key may be null; other columns are not read, so their names cannot clash. An empty table gives an empty result.
Texts with a character outside the blocks on which the pattern and the library agree are cut by the library, whose tables of letters
are older.

Nothing is shuffled: each task counts its own rows, and a lost task is counted anew. A worker remembers ``KNOWN`` pre-tokens twice over.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from touchline.llm.tokens import _byte_letters, read_tokenizer

LIMIT = 1024
LONG = 2048
CHUNK = 200_000
KNOWN = 400_000
_NEVER = np.int64(1 << 40)

# fixed values: the published pattern of this kind of vocabulary, and blocks of characters whose classes have not changed
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER_BLOCKS = r"[^\u0000-\u0557\u2000-\u206F\u20A0-\u20BF\u3000-\u9FEF\uAC00-\uD7A3\U0001F300-\U0001F64F]"


def _places(flags: np.ndarray) -> np.ndarray:
    """Of neighbouring places in a run, the first, third and so on: a pair of two equal symbols may not overlap itself."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at
    fresh = np.concatenate(([True], np.diff(at) != 1))
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - first) % 2 == 0]


class Merges:
    """The merge table of a tokenizer file: bytes are symbols 0 to 255, the result of rank r is symbol 256 + r."""

    def __init__(self, spec: dict) -> None:
        model, cut = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("only plain byte-level BPE files are counted")
        symbol = {letter: byte for byte, letter in _byte_letters().items()}
        pairs = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            # a part that is not yet a symbol would be made by a later rank: rounds would then not be the library's
            if left not in symbol or right not in symbol or left + right in symbol:
                raise ValueError(f"merge {rank} is out of order")
            pairs.append((symbol[left], symbol[right]))
            symbol[left + right] = 256 + rank
        self.width = 256 + len(pairs)
        self.left, self.right = np.array(pairs, np.int64).reshape(-1, 2).T
        keys = self.left * self.width + self.right
        self._order = np.argsort(keys).astype(np.int64)
        self._keys = keys[self._order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self._keys, keys), max(0, len(self._keys) - 1))
        return np.where(self._keys[at] == keys, self._order[at], _NEVER) if len(self._keys) else np.full(len(keys), _NEVER)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word."""
        out = np.zeros(len(words), np.int64)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._one(w)
            elif w:
                short.append(i)
        if short:
            out[short] = self._ragged([words[i] for i in short])
        return out

    def _ragged(self, words: list[bytes]) -> np.ndarray:
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out, who = np.zeros(len(words), np.int64), np.arange(len(words))
        while len(who):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            ranks = np.full(len(symbols), _NEVER)
            if len(symbols) > 1:
                ranks[:-1] = self.ranks(symbols[:-1], symbols[1:])
            ranks[ends - 1] = _NEVER
            lowest = np.minimum.reduceat(ranks, starts)
            seq = np.repeat(np.arange(len(who)), lengths)
            at = _places((ranks == lowest[seq]) & (ranks != _NEVER))
            symbols[at] = 256 + ranks[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            lengths = lengths - np.bincount(seq[at], minlength=len(who))
            done = lowest == _NEVER
            out[who[done]] = lengths[done]
            symbols = symbols[stay & ~done[seq]]
            who, lengths = who[~done], lengths[~done]
        return out

    def _one(self, word: bytes) -> int:
        """One long word: places of each rank wait in a queue, lowest rank first."""
        symbols = np.frombuffer(word, np.uint8).astype(np.int64)
        n = len(symbols)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(places: np.ndarray) -> None:
            places = places[after[places] < n]
            ranks = self.ranks(symbols[places], symbols[after[places]])
            known = ranks != _NEVER
            places, ranks = places[known], ranks[known]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, some in zip(ranks[np.concatenate(([0], cuts))].tolist() if len(ranks) else [], np.split(places, cuts), strict=False):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(queue, rank)
                waiting[rank].append(some)

        add(np.arange(n - 1))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at] & (symbols[at] == self.left[rank])]
            at = at[after[at] < n]
            at = at[symbols[after[at]] == self.right[rank]]
            if self.left[rank] == self.right[rank] and len(at) > 1:
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                first = np.maximum.accumulate(np.where(~chained, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            symbols[at], alive[gone], after[at] = 256 + rank, False, after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            add(np.unique(np.concatenate((at, before[at][before[at] >= 0]))))
        return int(alive.sum())


class Counter:
    """Tokens of texts under the file ``json_text``."""

    def __init__(self, json_text: str, known: int = KNOWN) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(json_text)
        self._merges, self._bound = Merges(spec), known
        added = spec["added_tokens"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError("special strings that take what stands beside them are not counted")
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self._word, self._other = regex.compile(PRE_TOKEN), regex.compile(OTHER_BLOCKS)
        self._library = Tokenizer.from_str(json_text).pre_tokenizer
        self._lately: dict[str, int] = {}
        self._before: dict[str, int] = {}

    def _pre_tokens(self, text: str) -> Iterator[str]:
        if self._other.search(text):
            return (text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text))
        return (m.group() for m in self._word.finditer(text))

    def _learn(self, words: set[str]) -> None:
        if len(self._lately) + len(words) > self._bound + CHUNK:
            self._before, self._lately = self._lately, {}
        lately, before = self._lately, self._before
        words = {w for w in words if w not in lately}
        lately.update((w, before[w]) for w in words if w in before)
        new = [w for w in words if w not in lately]
        lately.update(zip(new, self._merges.counts([w.encode("utf-8", "surrogatepass") for w in new]).tolist(), strict=True))

    def __call__(self, texts: list[str]) -> list[int]:
        """Tokens of each text; texts are looked up together, so that unknown words of all of them are merged in one array."""
        out = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            self._learn({w for _, words in held for w in words})
            for i, words in held:
                out[i] += sum(map(self._lately.__getitem__, words))
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            parts = [text]
            if self._special and text:
                parts = self._special.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                words = self._pre_tokens(part)
                while some := list(islice(words, CHUNK)):
                    held.append((i, some))
                    size += len(some)
                    if size >= CHUNK:
                        settle()
        settle()
        return out


_WORKER: dict[int, Counter] = {}


def _counter(json_text: str) -> Counter:
    """One counter for each file and worker process, so that later tasks find the words of earlier ones."""
    key = hash(json_text)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Counter(json_text)
    return _WORKER[key]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row. ``tokenizer`` is the path
    of the file on the driver; executors get its text."""
    rows = docs.select(docs[f"`{key}`"].alias("_key"), docs[f"`{text}`"].cast("string").alias("_text"))
    file = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def count(batches):
        counter = _counter(file.value)
        for batch in batches:
            column = batch.column(1)
            sizes = [0 if v is None else v for v in pc.binary_length(column).to_pylist()]
            tokens: list[int] = []
            at = 0
            while at < len(sizes):
                # texts of some megabytes together, a longer one alone
                end, held = at + 1, sizes[at]
                while end < len(sizes) and held + sizes[end] <= 4_000_000:
                    held += sizes[end]
                    end += 1
                tokens += counter([t or "" for t in column.slice(at, end - at).to_pylist()])
                at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                names=["_key", "n_bytes", "n_tokens", "over_limit"],
            )

    return rows.mapInArrow(count, schema).withColumnRenamed("_key", key)
