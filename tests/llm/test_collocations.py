"""Phrase mining against brute force on small tables, and its defined cases."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from touchline.llm import collocations as N


def brute(rows, support=10, longest=3, inside=50, top=2000):
    f, totals = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        totals[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + n])) for n in range(1, longest + 1) for i in range(len(ws) - n + 1))
    f = {k: v for k, v in f.items() if v >= support}
    kept = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        if any(len(q) > len(p) and other == lang and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in f.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        kept[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, totals[lang], -s) for lang, found in kept.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    return sorted(tuple(r) for r in N.collocations(df, **more).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["The", "of", "é", "na", "to-do", "x", "(y)", "Ünder", "zo", "日本"]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "  "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]))
            for _ in range(n)]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_against_brute_force(spark, longest):
    rows = corpus(longest, 120)
    got = found(spark, rows, longest=longest)
    assert got == brute(rows, longest=longest)
    assert len({r[0] for r in got}) > 1


def test_small_parts_cuts_and_ranks(spark, monkeypatch):
    """Texts cut into parts, several buckets, and ranks over several buckets give the same."""
    for name, value in (("BUFFER_BYTES", 40), ("PIECE_BYTES", 16), ("BUCKET_PHRASES", 500), ("TOP_BUCKET", 5)):
        monkeypatch.setattr(N, name, value)
    rows = corpus(8, 100)
    assert [(len(r), n) for r, n in N._cuts(b"a bb " * 30, 3)][1][1] == 2
    # tasks are other processes and keep the usual sizes, so parts are compared here
    want, got = collections.Counter(), collections.Counter()
    for cut in (True, False):
        for text, _ in rows:
            raw = text.encode()
            for some, again in N._cuts(raw, 3) if cut else [(raw, 0)]:
                part = N.Part([some], N.np.zeros(1, N.np.uint64), N.np.array([again]))
                for n in (1, 2, 3):
                    (got if cut else want).update(part.phrases(n)[0].tolist())
    assert got == want and max(want.values()) > 10
    assert found(spark, rows, top=7) == brute(rows, top=7)


def test_hot_phrase_and_local_support(spark):
    rows = [("hot pair hot pair. " * 50, "en")] * 40 + [(f"w{i} pair", "en") for i in range(300)] + [(f"rare couple {i}", "en") for i in range(10)]
    rows += [(f"nine times {i}", "en") for i in range(9)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert "rare couple" in {r[2] for r in got} and "nine times" not in {r[2] for r in got}


def test_counts_beyond_64_bits_stay_exact(spark):
    phrases = spark.createDataFrame([("en", 1, "a", 5_000_000_000), ("en", 1, "b", 7_000_000_001), ("en", 2, "a b", 4_999_999_999)], "lang string, n int, phrase string, f bigint")
    totals = spark.createDataFrame([("en", 20_000_000_000)], "lang string, total bigint")
    before = N.frequent_phrases
    N.frequent_phrases = lambda *_: (phrases, totals)
    try:
        row = N.collocations(spark.createDataFrame([("x", "en")], "text string, lang string")).first()
    finally:
        N.frequent_phrases = before
    assert row.score == 1_000_000 * 4_999_999_999**2 // (5_000_000_000 * 7_000_000_001)


def test_defined_cases(spark):
    rows = [(None, "en"), ("", None), (" .,; \n", "en"), ("one two " * 12, None), ("one two", "und"), ("A" * 100_000 + " b", "en"), ("q r s t " * 20_000, "xx")]
    assert found(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit(1)).withColumn("_shard", F.lit("x")).withColumn("a.b", F.lit(1))
    assert sorted(tuple(r) for r in N.collocations(df).collect()) == brute(rows)
    assert N.collocations(df.limit(0)).count() == 0
    assert found(spark, [(None, None)]) == []
