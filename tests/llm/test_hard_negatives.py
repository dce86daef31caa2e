"""Hard negatives against brute force on small tables, and their defined cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    v = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v.append((i, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for a in sorted({(i, label, tuple(q)) for i, label, q in v if i % 10 == 0}):
        def score(b):
            return sum(x * y for x, y in zip(a[2], b[2], strict=False))
        near = sorted(((-score(b), b[0]) for b in v if b[1] == a[1] and b[0] != a[0]))[:positives]
        for minus, p in near:
            far = sorted((-score(b), b[0]) for b in v if b[1] != a[1] and low * -minus <= 100 * score(b) <= high * -minus)[:negatives]
            out += [(a[0], p, r, n, -minus, -s) for r, (s, n) in enumerate(far, 1)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in H.hard_negatives(df, F.col("label"), F.col("_id") % 10 == 0, **more).collect())


def clustered(seed, n, d, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels * 2, d))
    return [(int(i), [float(x) for x in (centres[k] + 0.4 * rng.normal(size=d)) / math.sqrt(d)], int(k % labels)) for i, k in enumerate(rng.integers(0, labels * 2, n))]


@pytest.mark.parametrize("rows_a_block", [7, 50, 4096])
def test_against_all_pairs(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(H, "BLOCK_ROWS", rows_a_block)
    rows = clustered(rows_a_block, 300, 24)
    assert found(spark, rows) == brute(rows)


def test_groups_of_anchors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(H, "GROUP_BYTES", 8 * 6 * 4)
    rng = np.random.default_rng(2)
    # few distinct vectors: many equal scores, decided by id
    rows = [(int(i), [float(x) for x in rng.integers(-1, 2, 6)], int(rng.integers(0, 3))) for i in range(160)]
    assert found(spark, rows) == brute(rows)


def test_one_vector_in_a_third_of_the_rows(spark):
    rows = clustered(9, 200, 12)
    rows = [(i, rows[0][1] if i % 3 == 0 else x, label) for i, x, label in rows]
    assert found(spark, rows) == brute(rows)


def test_defined_cases(spark):
    base = clustered(4, 60, 8)
    rows = [*base, (None, base[0][1], 1), (70, None, 1), (80, base[1][1], None), (90, [1.0, None] + [0.0] * 6, 1), (100, [float("nan")] + [0.0] * 7, 1),
            (110, [float("inf")] + [0.0] * 7, 1), (120, [], 2), (130, base[2][1][:3], 2), base[10], base[20], (140, [0.0] * 8, 0), (20, base[21][1], 3)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(0, [3.4e38], 1), (1, [1.0], 1), (2, [0.5], 2)]) == []
    df = spark.createDataFrame(base, SCHEMA).withColumn("score", F.lit("x")).withColumn("anchor", F.lit(1)).withColumn("_v", F.lit(0)).withColumn("a.b", F.lit(0))
    assert sorted(tuple(r) for r in H.hard_negatives(df, F.col("label"), F.col("_id") % 10 == 0).collect()) == brute(base)
    assert H.hard_negatives(df.limit(0), F.col("label"), F.col("_id") % 10 == 0).count() == 0
    assert found(spark, [(10, [1.0], 1)]) == []


def test_candidates_leave_the_bitmap():
    rng = np.random.default_rng(1)
    values = np.clip((rng.normal(size=(2000, 64)) * 60).astype(np.int64), -300, 300)
    values[:20, :4] += 3000
    reads = []

    class Columns(list):
        def __getitem__(self, k):
            column = list.__getitem__(self, k)

            class Watched:
                def __getitem__(self, alive):
                    reads.append(len(alive))
                    return column[alive]

            return Watched()

    block = H.Block.__new__(H.Block)
    block.n, block.d, block.ids = 2000, 64, np.arange(2000)
    block.least, block.most = values.min(axis=0), values.max(axis=0)
    block.columns = Columns(values.T)
    best = H.Best(5)
    query = values[0]
    H.scan(block, query, np.arange(2000), [(None, None, best)])
    scores = values @ query
    assert best.scores.tolist() == sorted(scores.tolist(), reverse=True)[:5]
    assert sum(reads) < 2000 * 64 / 4
