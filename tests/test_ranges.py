"""Scans by ranges: automata, growing forecasts, sliding windows, ARIMA."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import automata, timeseries, windows
from tidewheel.operators.ranges import Ranged


def single_partition(df):
    return "SinglePartition" in df._jdf.queryExecution().executedPlan().toString()


def accepts(symbols, counts):
    """Whether the symbols are the pattern's, by all ways to split them."""
    if not counts:
        return not symbols
    (bit, least, most), rest = counts[0], counts[1:]
    for k in range(len(symbols) + 1):
        if k > 0 and not symbols[k - 1] >> bit & 1:
            return False
        if most is not None and k > most:
            return False
        if k >= least and accepts(symbols[k:], rest):
            return True
    return False


def brute(symbols, counts):
    """The first match to be complete, of those the first to begin; then on from the row after it."""
    out, begin = [], 0
    end = 0
    while end < len(symbols):
        start = next((s for s in range(begin, end + 1) if accepts(symbols[s : end + 1], counts)), None)
        if start is not None:
            out.append((start, end))
            begin = end + 1
        end += 1
    return out


PATTERNS = [
    [(1, 1), (1, 1), (1, 1)],
    [(1, 1), (1, None), (1, 1)],
    [(0, 1), (1, None), (2, 3)],
    [(2, None), (0, None), (1, 1)],
    [(1, 1), (0, 2), (1, 2), (0, None)],
]


@pytest.mark.parametrize("seed", range(5))
def test_automaton_against_brute_force(spark, seed):
    rng = random.Random(seed)
    counts = PATTERNS[seed]
    rows = []
    for key in [None, 1, 2, 3]:
        for i in range(400 if key == 2 else 40):
            rows.append((key, i, rng.choice([0, 1, 2, 3, 5, 6, 7]) & (1 << len(counts)) - 1, f"r{i}"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, s int, symbol string")
    pattern = [(F.col("s").bitwiseAND(1 << j) != 0, least, most) for j, (least, most) in enumerate(counts)]
    got = automata.matches(df, ["k"], ["i"], pattern, ["symbol"], partitions=9)
    got = sorted((tuple(r) for r in got.select("k", "first_i", "last_i", "first_symbol", "last_symbol").collect()), key=str)
    want = []
    for key in [None, 1, 2, 3]:
        own = [s for _, s in sorted((i, s) for k, i, s, _ in rows if k == key)]
        want += [(key, a, b, f"r{a}", f"r{b}") for a, b in brute(own, [(j, *c) for j, c in enumerate(counts)])]
    assert got == sorted(want, key=str) != []


def test_automaton_over_the_whole_table(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("vvcccp")) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, s string").repartition(5)
    pattern = [(F.col("s") == "v", 1, 1), (F.col("s") == "c", 1, None), (F.col("s") == "p", 1, 1)]
    out = automata.matches(df, [], ["i"], pattern, partitions=11)
    text = "".join(s for _, s in rows)
    import re

    assert sorted((r.first_i, r.last_i) for r in out.collect()) == [(m.start(), m.end() - 1) for m in re.finditer("vc+p", text)]
    assert not single_partition(out)
    long = automata.matches(spark.range(3000).withColumn("s", F.when(F.col("id") == 0, 1).when(F.col("id") == 2999, 3).otherwise(2)), [], ["id"], [(F.col("s") == 1, 1, 1), (F.col("s") == 2, 0, None), (F.col("s") == 3, 1, 1)], partitions=13)
    assert [(r.first_id, r.last_id) for r in long.collect()] == [(0, 2999)]
    with pytest.raises(ValueError):
        automata.Automaton([(0, 1), (0, None)])
    assert automata.matches(df.limit(0), [], ["i"], pattern).collect() == []


def test_ranged_lag_and_sums(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, 2]), i, rng.choice([None, rng.randrange(9)])) for i in range(500)]
    ranged = Ranged(spark.createDataFrame(rows, "k int, i int, task int"), ["k"], ["i"], 12)
    ranged.lag("task", "before")
    ranged.sums({"total": F.col("task"), "n": F.lit(1)})
    got = {(r.k, r.i): (r.before, r.total, r.n) for r in ranged.rows.collect()}
    for key in (None, 1, 2):
        own = sorted((i, v) for k, i, v in rows if k == key)
        for j, (i, _) in enumerate(own):
            assert got[key, i] == (own[j - 1][1] if j else None, sum(v or 0 for _, v in own[:j]), j)


def test_growing_forms_equal_the_windows(spark):
    rng = random.Random(5)
    rows = [(k, i, float(rng.randrange(100)), 7) for k in (1, 2) for i in range(300 if k == 1 else 20)]
    df = spark.createDataFrame(rows, "k int, i int, v double, x int")
    plain = timeseries.anomalies(df, ["k"], ["i"], "v", digits=6)
    for keys, want in ((["k"], plain), ([], timeseries.anomalies(df, [], ["k", "i"], "v", digits=6))):
        got = timeseries.growing_anomalies(df, keys, ["i"] if keys else ["k", "i"], "v", digits=6, partitions=7)
        assert got.columns == want.columns and not single_partition(got)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_arima_against_least_squares(spark):
    rng = np.random.default_rng(6)
    rows, series = [], {}
    for key, phi in (("a", [0.6, -0.3]), ("b", [0.0]), ("c", [0.9])):
        z = [0.0] * 5
        for _ in range(400):
            z.append(0.5 + sum(p * v for p, v in zip(phi, reversed(z), strict=False)) + rng.normal())
        y = np.cumsum(z)
        series[key] = y
        rows += [(key, i, float(v)) for i, v in enumerate(y)]
    rows += [("short", 0, 1.0), ("flat", 0, 2.0)] + [("flat", i, 2.0) for i in range(1, 30)]
    got = {r.k: r for r in timeseries.arima(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], ["i"], "v", lags=4, steps=3, digits=6).collect()}
    for key, y in series.items():
        z, best = np.diff(y), None
        for p in range(5):
            a = np.array([[1.0, *z[t - p : t][::-1]] for t in range(4, len(z))])
            c, *_ = np.linalg.lstsq(a, z[4:], rcond=None)
            error = float(np.mean((z[4:] - a @ c) ** 2))
            aic = len(a) * np.log(error) + 2 * (p + 2)
            if best is None or aic < best[0]:
                best = (aic, p, c, error)
        aic, p, c, error = best
        assert (got[key].p, got[key].n) == (p, len(z) - 4)
        assert np.allclose(got[key].coefficients, c, atol=1e-5) and abs(got[key].aic - aic) < 1e-3 and abs(got[key].sigma - error**0.5) < 1e-5
        now, last = list(z), y[-1]
        for f in got[key].forecasts:
            now.append(c[0] + sum(k * v for k, v in zip(c[1:], reversed(now), strict=False)))
            last += now[-1]
            assert abs(f - last) < 1e-3
    assert got["short"].p is None and got["flat"].p == 0 and got["flat"].forecasts == [2.0] * 3


def test_sliding_windows_by_sweep(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 5 + ["b", None]), rng.randrange(3000), rng.choice([None, round(rng.uniform(-9, 9), 2)])) for _ in range(600)]
    got = windows.sliding(spark.createDataFrame(rows, "k string, t long, v double"), "t", "k", "v", 50, partitions=9)
    want = set()
    for key in ("hot", "b"):
        own = [(t, v) for k, t, v in rows if k == key]
        for start in {s for t, _ in own for s in (t - 50, t + 1)}:
            inside = [v for t, v in own if start <= t <= start + 50]
            known = [v for v in inside if v is not None]
            if inside:
                want.add((key, start, start + 50, len(inside), round(sum(known) / len(known), 2) if known else None))
    found = {tuple(r)[:4]: r.average for r in got.collect()}
    assert set(found) == {w[:4] for w in want} and len(found) == len(want)
    assert all((found[w[:4]] is None) == (w[4] is None) and abs((found[w[:4]] or 0) - (w[4] or 0)) < 0.011 for w in want)
