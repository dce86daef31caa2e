"""URL filters: rules decide where one fits; elsewhere naive Bayes over the words of host and path.

Host names run words together. They are split by a unigram Viterbi search, with word counts from the text of all pages. Multinomial naive
Bayes learns from the addresses that a rule decides; its counts live in ``BUCKETS`` hashed buckets, so what is summed over partitions has
a fixed size.

Defined cases: a null address, or one without ``://``, has an empty host and path and gets the method's verdict; ties of the method go to
"allow"; without addresses of both verdicts the method says "allow"; equal rules count once, of equally long rules the first in the list
wins; repeated pages are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.quality_classifier import summed
from touchline.llm.shared import most_frequent
from touchline.llm.text import UPPER, LOWER

DICTIONARY = 50_000
LONGEST_WORD = 24
BUCKETS = 1 << 15
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>")
_LETTERS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[a-z]+|[^\W_a-z]+|\d+")


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


class Rules:
    """Rules by host: an address is looked up once for each label of its host."""

    def __init__(self, rules) -> None:
        self.by_host: dict[str, list[UrlRule]] = {}
        for r in rules:
            self.by_host.setdefault(r.host, []).append(r)

    def __call__(self, host: str, path: str) -> UrlRule | None:
        best, at = None, 0
        while True:
            for r in self.by_host.get(host[at:], ()):
                if path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
                    best = r
            at = host.find(".", at) + 1
            if not at:
                return best


class Segmenter:
    """Best split of a name into words: the sum of log shares is greatest. A letter no word explains costs more than any word."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) + 1
        self.cost = {w: math.log(total / c) for w, c in counts.items() if 0 < len(w) <= LONGEST_WORD}
        self.strange = math.log(total) + 2
        self.split = lru_cache(100_000)(self._split)

    def __reduce__(self):
        return _segmenter, (self.cost, self.strange)

    def _split(self, name: str) -> tuple[str, ...]:
        best, start = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = [(best[end - 1] + self.strange, end - 1)]
            for at in range(max(0, end - LONGEST_WORD), end):
                cost = self.cost.get(name[at:end])
                if cost is not None:
                    options.append((best[at] + cost, at))
            cost, at = min(options)
            best.append(cost)
            start.append(at)
        out, end = [], len(name)
        while end:
            out.append(name[start[end] : end])
            end = start[end]
        return tuple(reversed(out))


def _segmenter(cost: dict[str, float], strange: float) -> Segmenter:
    out = Segmenter({})
    out.cost, out.strange = cost, strange
    return out


def url_tokens(host: str, path: str, segment: Segmenter) -> list[str]:
    """Words of the host's labels, marked by the kind of place, and of the path; numbers are one token."""
    labels = host.split(".") if host else []
    out = [f"top:{labels[-1]}"] if labels else []
    for label in labels[:-1]:
        for part in re.split(r"[-_]", label):
            out += [f"host:{w}" for w in (segment.split(part) if part else ())]
    for part in _PARTS.findall(path.lower()):
        out.append("path:0" if part.isdigit() else f"path:{part}")
    return out


def _buckets(tokens: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in tokens], np.int64)


def address(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path."""
    host = F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def page_words(pages: DataFrame, html: str = "html", most: int = DICTIONARY) -> dict[str, int]:
    """The ``most`` frequent words of the pages' text, which bounds the dictionary; counts are over all pages."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for t in batch.column(0).to_pylist():
                counts.update(_LETTERS.findall(_TAGS.sub(" ", t or "").lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    words = pages.select(F.col(f"`{html}`").cast("string").alias("t")).mapInArrow(work, "word string, c bigint")
    return {r.word: r.c for r in most_frequent(words.groupBy("word").agg(F.sum("c").alias("c")), most)}


def url_verdicts(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict, score) of each page; ``score`` is the method's log odds for "allow"."""
    segment, decide = Segmenter(page_words(pages, html)), Rules(rules)
    shared = pages.sparkSession.sparkContext.broadcast((segment, decide))
    host, path = address(F.col(f"`{url}`").cast("string"))
    rows = pages.select(F.col(f"`{key}`"), host.alias("host"), path.alias("path"))

    def counts(batch):
        segment, decide = shared.value
        out = np.zeros((2, BUCKETS + 1))
        for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if rule := decide(h, p):
                row = out[int(rule.verdict == "allow")]
                np.add.at(row, _buckets(url_tokens(h, p, segment)), 1)
                row[-1] += 1
        return out.ravel()

    total = summed(rows.select("host", "path"), 2 * (BUCKETS + 1), counts).reshape(2, BUCKETS + 1)
    seen = total[:, :-1].sum(axis=0) > 0
    odds = np.zeros(BUCKETS)
    prior = 0.0
    if total[:, -1].all():
        smooth = total[:, :-1] + 1
        logs = np.log(smooth / (total[:, :-1].sum(axis=1) + seen.sum() + 1)[:, None])
        odds, prior = np.where(seen, logs[1] - logs[0], 0), float(np.log(total[1, -1] / total[0, -1]))
    model = pages.sparkSession.sparkContext.broadcast((odds, prior))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (segment, decide), (odds, prior) = shared.value, model.value
        for batch in batches:
            names, verdicts, scores = [], [], []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rule = decide(h, p)
                score = prior + float(odds[_buckets(url_tokens(h, p, segment))].sum())
                names.append(rule.text if rule else None)
                verdicts.append(rule.verdict if rule else "allow" if score >= 0 else "block")
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())],
                names=[key, "host", "path", "rule", "verdict", "score"],
            )

    more = [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, *more]))
