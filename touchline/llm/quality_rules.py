"""Quality rules: a table of thresholds compiled into one projection over counts of a text.

Every count is an integer and every rule compares whole numbers (``100 * count`` against ``percent * base``), so the verdict does
not depend on rounding. All work is done by built-in functions inside the row: nothing is exploded and nothing is shuffled.

Defined cases: a null text counts as an empty one and fails the length rule; white space alone has no word; repeated rows are judged
one by one; other columns, whatever their names, pass through ``keep_documents`` unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.text import packed, unpacked, words_column

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
# Common short words of the languages the rules know; a text of running prose always holds some.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das dem den der die ein eine für im ist mit nicht sich und von zu "
    "con de del el en la las los para por que se una un y "
    "au avec dans des du est et le les pas pour une qui sur"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if ``100 * count`` is under ``low`` or over ``high`` percent of ``base``; without a base, the bare count counts."""

    name: str
    count: str
    base: str | None = None
    low: int | None = None
    high: int | None = None

    def failed(self, counts: dict[str, Column]) -> Column:
        value = counts[self.count] * (100 if self.base else 1)
        base = counts[self.base] if self.base else F.lit(1)
        tests = [value < base * self.low] if self.low is not None else []
        tests += [value > base * self.high] if self.high is not None else []
        return reduce(lambda a, b: a | b, tests)


BASE_RULES = (
    Rule("length", "n_words", low=20),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=30),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=20),
    Rule("stop_words", "n_stop_words", "n_words", low=3),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=50),
    Rule("shouted_words", "n_shouted", "n_words", high=50),
    Rule("stuttered_words", "n_stuttered", "n_words", high=30),
)


def _count(array: Column, test) -> Column:
    return F.size(F.filter(array, test)).cast("long")


def _measured(rows: DataFrame) -> DataFrame:
    """``_text`` into a struct of counts ``_q``. The arrays are columns of their own, so that lambdas read them instead of building
    them again for every element."""
    rows = rows.withColumn("_text", F.coalesce("_text", F.lit(""))).withColumns(
        {"_words": words_column(F.col("_text")), "_lines": F.filter(F.split("_text", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))}
    )
    words, n = F.col("_words"), F.size("_words")
    # a 64-bit hash stands for the words of a window; it covers their boundaries too
    windows = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumns({"_joined": F.array_join("_words", ""), "_windows": windows})
    windows = F.col("_windows")
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn(
        "_ordered",
        F.when(F.size(F.array_distinct(windows)) < F.size(windows), ordered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    ordered = F.col("_ordered")
    again = F.filter(
        ordered,
        lambda s, k: F.coalesce(F.get(ordered, k - 1)["h"] == s["h"], F.lit(False))
        | F.coalesce(F.get(ordered, k + 1)["h"] == s["h"], F.lit(False)),
    )
    rows = rows.withColumn("_starts", F.array_sort(F.transform(again, lambda s: s["i"])))
    starts = F.col("_starts")
    covered = F.aggregate(
        F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, step: total + step,
    )
    counts = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length("_joined").cast("long"),
        "n_symbols": (F.length("_joined") - F.length(F.regexp_replace("_joined", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered,
        "n_stop_words": _count(words, lambda w: w.isin(*STOP_WORDS)),
        "n_shouted": _count(words, lambda w: w.rlike("[A-Z]") & ~w.rlike("[a-z]")),
        "n_stuttered": _count(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False))),
    }
    return rows.select("_row", F.struct(*[c.alias(k) for k, c in counts.items()]).alias("_q"))


def _judged(docs: DataFrame, text: str, base_rules, rules) -> DataFrame:
    rows = _measured(packed(docs, text))
    counts = {c: F.col("_q")[c] for c in rows.schema["_q"].dataType.names}
    base = reduce(lambda a, b: a | b, [r.failed(counts) for r in base_rules], F.lit(False))
    reasons = F.array_compact(F.array(*[F.when(r.failed(counts), F.lit(r.name)) for r in (*base_rules, *rules)]))
    return rows.withColumns({"_base_failed": base, "_reasons": reasons})


def quality_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", base_rules=BASE_RULES, rules=RULES) -> DataFrame:
    """A row for each document: its key, all counts, ``base_failed``, ``kept`` and the names of the rules it fails."""
    rows = _judged(docs, text, base_rules, rules)
    return rows.select(
        F.col("_row")[key].alias(key), "_q.*", F.col("_base_failed").alias("base_failed"),
        (F.size("_reasons") == 0).alias("kept"), F.array_join("_reasons", ",").alias("failed_rules"),
    )


def keep_documents(docs: DataFrame, text: str = "text", base_rules=BASE_RULES, rules=RULES) -> DataFrame:
    """The documents that pass every rule, with the columns they came with."""
    # the row number keeps the filter above the counts: pushed below them it would count again inside every lambda
    rows = _judged(docs, text, base_rules, rules).withColumn("_at", F.monotonically_increasing_id())
    return unpacked(rows.where((F.size("_reasons") == 0) & (F.col("_at") >= 0)), docs.columns)
