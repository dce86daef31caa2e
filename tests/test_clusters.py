"""k-means by aggregates against a plain one on the driver."""

import numpy as np
from pyspark.sql import functions as F

from touchline.operators import clusters as CL
from touchline.operators.priors import prior_summary


def plain(z, train, k):
    t, centres = z[train], []
    for _ in range(k):
        d = ((t[:, None] - np.array(centres or [np.zeros(z.shape[1])])[None]) ** 2).sum(-1).min(1)
        i = max(range(len(t)), key=lambda i: (d[i], *t[i]))
        if centres and d[i] <= 0:
            break
        centres.append(t[i])
    c = np.array(centres)
    for _ in range(CL.STEPS):
        j = ((t[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        new = np.array([t[j == i].mean(0) if (j == i).any() else c[i] for i in range(len(c))])
        moved, c = ((new - c) ** 2).sum(), new
        if moved <= CL.STILL:
            break
    return c, ((t[:, None] - c[None]) ** 2).sum(-1).min(1).sum(), ((z[:, None] - c[None]) ** 2).sum(-1).argmin(1)


def test_against_a_plain_one(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (60, 3)) for c in ((0, 0, 0), (6, 1, 0), (0, 7, 3), (5, 5, 9))])
    train = rng.random(len(x)) < 0.8
    df = spark.createDataFrame([(int(i), *map(float, r), bool(t)) for i, (r, t) in enumerate(zip(x, train, strict=True))], "i int, a double, b double, c double, train boolean")
    found = CL.fit_clusters(df, ["a", "b", "c"], F.col("train"), 4)
    centres, inertia, nearest = plain((x - x.mean(0)) / x.std(0), train, 4)
    assert np.allclose(found.centres, centres, atol=1e-9) and np.isclose(found.inertia, inertia) and sum(found.sizes) == train.sum()
    got = {r["i"]: r["cluster"] for r in found.assign(df, "cluster").collect()}
    assert [got[i] for i in range(len(x))] == nearest.tolist()


def test_defined_cases(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, None), (2.0, 5.0)], "a double, b double")
    found = CL.fit_clusters(df, ["a", "b"], F.lit(True), 6)
    assert found.count == 2 and found.sizes == [1, 2] or found.sizes == [2, 1]
    assert found.inertia == 0.0
    none = CL.fit_clusters(df, ["a"], F.lit(False), 3)
    assert none.count == 1 and {r["c"] for r in none.assign(df, "c").collect()} == {0}
    empty = CL.fit_clusters(df.limit(0), ["a", "b"], F.lit(True), 3)
    assert empty.count == 1 and empty.inertia == 0.0
    priors = spark.createDataFrame([(0.1, 0.2, 0.3, True)], "finishing_bias_logit double, concession_bias_logit double, player_component double, is_holdout boolean")
    assert prior_summary(priors, found).first()["cluster_count"] == 2
