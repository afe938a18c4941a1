"""Nearest neighbours, exact and by the index."""

import numpy as np
from pyspark.sql import functions as F

from tidewheel.operators import vectors


def table(spark, n, width=16, clumps=30, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clumps, width))
    own = rng.choice(clumps, n, p=[0.34, *[0.66 / (clumps - 1)] * (clumps - 1)])  # a clump holds a third of all
    points = centres[own] + 0.4 * rng.normal(size=(n, width))
    rows = [(i, points[i].tolist()) for i in range(n)] + [(n, None), (n + 1, points[0].tolist())]
    return spark.createDataFrame(rows, "id long, v array<double>").repartition(5), points


def brute(points, ids, k):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    return {q: sorted((-round(float(s), 9), i) for i, s in enumerate(unit @ unit[q]))[:k] for q in ids}


def test_nearest_in_blocks_and_index(spark):
    df, points = table(spark, 3000)
    points = np.vstack([points, np.full((1, 16), np.nan), points[:1]])
    queries = df.filter("id % 100 = 0").select(F.col("id").alias("q"), F.col("v").alias("w"))
    want = {q: [i for _, i in v] for q, v in brute(np.nan_to_num(points, nan=1e-12), range(0, 3000, 100), 5).items()}
    for size in (32 << 20, 700):  # one block, and several
        got = vectors.nearest(df, "id", "v", queries, "q", "w", 5, size).orderBy("q", "rank").collect()
        assert all([r.id for r in got if r.q == q] == want[q] for q in want) and len(got) == 150
    centres = vectors.fit_cells(df, "v", cells=40, sample=1000)
    found = vectors.search(df, "id", "v", queries, "q", "w", 5, centres, probes=6, group=100).collect()
    hit = {q: {r.id for r in found if r.q == q} for q in want}
    recall = np.mean([len(hit[q] & set(want[q])) / 5 for q in want])
    assert recall >= 0.9
    whole = vectors.search(df, "id", "v", queries, "q", "w", 5, centres, probes=40, group=100).orderBy("q", "rank").collect()
    assert all([r.id for r in whole if r.q == q] == want[q] for q in want)
    assert vectors.search(df.limit(0), "id", "v", queries, "q", "w").collect() == []
    assert vectors.nearest(df, "id", "v", queries.limit(0), "q", "w").collect() == []
