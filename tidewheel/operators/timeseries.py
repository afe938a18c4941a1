"""Forecasts and anomalies from autoregressions, in closed form over sums.

First order: y(t) = a + b y(t-1), fitted by least squares over the rows so far (or the last n). All sums are Spark window aggregates, so keys
are independent and nothing iterates; the forms that take all rows so far also come as scans by ranges (``growing_...``), for
a long key or a table without one.

Higher order: a differenced series of lags up to p, from the normal equations, whose sums are one aggregate of lagged products (``arima``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import fresh
from .ranges import Ranged

#: Two-sided normal quantiles.
Z = {0.9: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}


class _Line:
    """Names of the lagged value and of the six sums, and what follows from them."""

    def __init__(self, df: DataFrame, value: str):
        self.value = value
        self.names = fresh(df, *"x n sx sy sxy sxx syy".split())
        self.lag = self.names[0]
        self.n, self.sx, self.sy, self.sxy, self.sxx, self.syy = map(F.col, self.names[1:])

    def parts(self) -> dict[str, Column]:
        """What a row that has a row before it adds to each sum."""
        x, y = F.col(self.lag), F.col(self.value)
        return {n: F.when(x.isNotNull(), c) for n, c in zip(self.names[1:], (F.lit(1.0), x, y, x * y, x * x, y * y), strict=True)}

    def fitted(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], frame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(self.lag, F.lag(self.value).over(w)).withColumns({n: F.sum(c).over(frame(w)) for n, c in self.parts().items()})

    def growing(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], inclusive: bool, partitions: int | None) -> DataFrame:
        ranged = Ranged(df, keys, order, partitions, self.names)
        ranged.lag(self.value, self.lag)
        ranged.sums(self.parts(), inclusive)
        return ranged.rows.drop(ranged.task)

    @property
    def slope(self) -> Column:
        d = self.n * self.sxx - self.sx * self.sx
        return F.when(d > 0, (self.n * self.sxy - self.sx * self.sy) / d)

    @property
    def start(self) -> Column:
        return (self.sy - self.slope * self.sx) / self.n

    def judged(self, fitted: DataFrame, least: int, confidence: float, digits: int) -> DataFrame:
        f, s = fresh(fitted, "f", "s")
        error = self.syy - self.start * self.sy - self.slope * self.sxy
        sigma = F.sqrt(F.greatest(error, F.lit(0.0)) / F.greatest(self.n - 2, F.lit(1.0)))
        ready = self.n >= least
        out = fitted.withColumn(f, F.when(ready, self.start + self.slope * F.col(self.lag))).withColumn(s, F.when(ready, sigma) * Z[confidence])
        low, high = F.col(f) - F.col(s), F.col(f) + F.col(s)
        judged = out.withColumns({"forecast": F.round(f, digits), "low": F.round(low, digits), "high": F.round(high, digits), "is_anomaly": (F.col(self.value) < low) | (F.col(self.value) > high)})
        return judged.drop(*self.names, f, s)


def forecast(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, training: int = 16, digits: int = 4) -> DataFrame:
    """Each row with the ``forecast`` of the next value from the last ``training`` rows; null until there are as many."""
    line = _Line(df, value)
    w = Window.partitionBy(*keys).orderBy(*order)
    fitted = line.fitted(df, keys, order, lambda w: w.rowsBetween(1 - training, 0))
    (place,) = fresh(fitted, "rows")
    fitted = fitted.withColumn(place, F.row_number().over(w))
    return fitted.withColumn("forecast", F.when(F.col(place) >= training, F.round(line.start + line.slope * F.col(value), digits))).drop(*line.names, place)


def anomalies(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, least: int = 16, confidence: float = 0.99, digits: int = 4) -> DataFrame:
    """Each row with the forecast made from all rows before it, its interval, and whether the value lies outside; null until ``least`` rows."""
    line = _Line(df, value)
    return line.judged(line.fitted(df, keys, order, lambda w: w.rowsBetween(Window.unboundedPreceding, -1)), least, confidence, digits)


def growing_anomalies(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, least: int = 16, confidence: float = 0.99, digits: int = 4, partitions: int | None = None) -> DataFrame:
    """``anomalies`` as a scan by ranges: a key's rows, or with no ``keys`` the whole table's, are judged by many tasks. ``order`` must tell rows apart."""
    line = _Line(df, value)
    return line.judged(line.growing(df, keys, order, False, partitions), least, confidence, digits)


def growing_forecast(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, least: int = 16, digits: int = 4, partitions: int | None = None) -> DataFrame:
    """Each row with the ``forecast`` of the next value from all rows up to it, null before ``least`` steps: a scan by ranges, as above."""
    line = _Line(df, value)
    fitted = line.growing(df, keys, order, True, partitions)
    return fitted.withColumn("forecast", F.when(line.n >= least, F.round(line.start + line.slope * F.col(value), digits))).drop(*line.names)


def arima(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: int = 4, differences: int = 1, steps: int = 1, digits: int = 4) -> DataFrame:
    """For each key an ARIMA(p, d, 0) fitted to all its rows, and forecasts: keys, n, p, d, aic, sigma, coefficients, forecasts.

    Every order p from 0 to ``lags`` is fitted to the same rows of the series differenced ``differences`` times, and the one with the least
    Akaike information criterion is taken, the smaller among equals. One window gives each row its lags, one aggregate a key's sums of all
    products of lags, (lags + 2)^2 / 2 numbers whatever the key's length; the equations of each key are solved from those. ``coefficients`` are the
    constant and the p lags, nearest first; ``forecasts`` the next ``steps`` values. A key with fewer than lags + 3 rows to fit, or
    a constant series beyond order 0, gets what orders can be solved, or nulls. Rows without a value are left out.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    y, place, rows = fresh(df, "y", "place", "rows")
    series = df.filter(F.col(value).isNotNull()).select(*keys, *[c for c in order if c not in keys], F.col(value).cast("double").alias(y))
    last = [y]
    for d in range(1, differences + 1):
        (name,) = fresh(series, f"d{d}")
        series = series.withColumn(name, F.col(last[-1]) - F.lag(last[-1]).over(w))
        last.append(name)
    now = last[-1]
    lagged = fresh(series, *[f"l{k}" for k in range(1, lags + 1)])
    series = series.withColumns({n: F.lag(now, k).over(w) for k, n in enumerate(lagged, 1)}).withColumn(place, F.row_number().over(w)).withColumn(rows, F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])))
    terms = [F.lit(1.0), *map(F.col, lagged), F.col(now)]
    use = F.col(place) > lags + differences
    products = [F.coalesce(F.sum(F.when(use, terms[i] * terms[j])), F.lit(0.0)) for i in range(len(terms)) for j in range(i, len(terms))]
    # The last values of the series and of its lags, from which forecasts go on: those of the key's last row.
    ends = [F.max(F.when(F.col(rows) == 1, F.col(c))) for c in (*last, *lagged)]
    summed = series.groupBy(*keys).agg(F.array(*products).alias("_products"), F.array(*ends).alias("_ends"))
    schema = T.StructType([*[summed.schema[k] for k in keys]] + T._parse_datatype_string("n long, p int, d int, aic double, sigma double, coefficients array<double>, forecasts array<double>").fields)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [solved(np.array(p, float), list(e), lags, differences, steps, digits) for p, e in zip(pdf["_products"], pdf["_ends"], strict=True)]
            out = pdf[list(keys)].copy()
            for k, name in enumerate(("n", "p", "d", "aic", "sigma", "coefficients", "forecasts")):
                out[name] = pd.Series([f[k] for f in found], index=out.index, dtype=object)
            yield out

    return summed.mapInPandas(solve, schema)


def solved(products: np.ndarray, ends: list, lags: int, differences: int, steps: int, digits: int) -> tuple:
    """n, p, d, aic, sigma, coefficients and forecasts from a key's sums of products and last values."""
    m = np.zeros((lags + 2, lags + 2))
    m[np.triu_indices(lags + 2)] = products
    m = m + np.triu(m, 1).T
    n, best = int(m[0, 0]), None
    for p in range(lags + 1):
        a, b = m[: p + 1, : p + 1], m[: p + 1, -1]
        if n < p + 3 or np.linalg.matrix_rank(a) < p + 1:
            continue
        c = np.linalg.solve(a, b)
        error = max(float(m[-1, -1] - c @ b), 0.0) / n
        aic = n * float(np.log(max(error, 1e-300))) + 2 * (p + 2)
        if best is None or aic < best[0] - 1e-9:
            best = (aic, p, c, error)
    if best is None:
        return n, None, differences, None, None, None, None
    aic, p, c, error = best
    tails, recent = [float(v) for v in ends[: differences + 1]], [float(v) for v in (ends[differences], *ends[differences + 1 :]) if v is not None]
    out = []
    for _ in range(steps):
        new = float(c[0] + sum(k * v for k, v in zip(c[1:], recent, strict=False)))
        recent = [new, *recent]
        tails[differences] = new
        for d in range(differences - 1, -1, -1):
            tails[d] += tails[d + 1]
        out.append(round(tails[0], digits))
    return n, p, differences, round(aic, digits), round(error**0.5, digits), [round(float(v), digits) for v in c], out
