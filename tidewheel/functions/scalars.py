"""Scalar functions under plain names; all are expressions that stay in generated code, but for the prime test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Radius of the earth.
RADIUS = {"miles": 3959.0, "km": 6371.0}


def parse_timestamp(text: Column, pattern: str | None = None, failure: str = "null") -> Column:
    """A time from text. ``failure``: "null", or "epoch" for 1970-01-01 where it cannot be read."""
    parsed = F.try_to_timestamp(text, F.lit(pattern)) if pattern else F.try_to_timestamp(text)
    return F.coalesce(parsed, F.timestamp_seconds(F.lit(0))) if failure == "epoch" else parsed


def from_seconds(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.from_unixtime(seconds, pattern)


def from_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def to_seconds(text: Column, pattern: str) -> Column:
    return F.unix_timestamp(text, pattern)


def epoch(value: Column, precision: int) -> Column:
    """TO_TIMESTAMP_LTZ: seconds for 0, milliseconds for 3."""
    return {0: F.timestamp_seconds, 3: F.timestamp_millis}[precision](value)


def convert_zone(ts: Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), ts.cast("timestamp_ntz"))


def hours_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("HOUR", a, b)


def minutes_between_ms(a: Column, b: Column) -> Column:
    """Whole minutes from the time a to the time b, by milliseconds, truncating."""
    return F.call_function("div", F.unix_millis(b.cast("timestamp")) - F.unix_millis(a.cast("timestamp")), F.lit(60_000))


def day_name(date: Column) -> Column:
    """Sunday is day 1."""
    names = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
    return F.element_at(F.array(*map(F.lit, names)), F.dayofweek(date))


def format_time(ts: Column, pattern: str, zone: str | None = None) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone) if zone else ts, pattern)


def part(text: Column, delimiter: str, n: int) -> Column:
    """The n-th part, counted from 1; null beyond the last."""
    return F.get(F.split(text, "\\Q" + delimiter + "\\E"), F.lit(n - 1))


def json_field(text: Column, path: str, kind: str = "string") -> Column:
    return F.get_json_object(text, path).try_cast(kind)


def json_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def geo_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "km") -> Column:
    """Great-circle distance by the haversine formula."""
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(a), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(b), 2)
    return F.lit(2 * RADIUS[unit]) * F.asin(F.sqrt(h))


def decode_base64(text: Column) -> Column:
    return F.decode(F.unbase64(text), "UTF-8")


def map_value(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def text_to_map(text: Column, pairs: str = ",", values: str = "=") -> Column:
    return F.str_to_map(text, F.lit(pairs), F.lit(values))


def formatted(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


def composite_part(text: Column, delimiter: str = "-", length: int = 3) -> Column:
    """The first ``length`` letters after the delimiter."""
    return F.substring(F.substring_index(text, delimiter, -1), 1, length)


def vwap(bid: Column, bid_quantity: Column, ask: Column, ask_quantity: Column) -> Column:
    """Volume-weighted average price."""
    return (bid * bid_quantity + ask * ask_quantity) / (bid_quantity + ask_quantity)


def time_part(ts: Column, field: str) -> Column:
    return F.extract(F.lit(field), ts)


_SMALL_PRIMES = [p for p in range(2, 200) if all(p % d for d in range(2, p))]


@F.pandas_udf(T.BooleanType())
def is_prime(numbers: pd.Series) -> pd.Series:
    """Primes of 64 bits: division by small primes, a whole batch at a time, then Miller and Rabin's test, which these bases make exact."""
    x = numbers.fillna(0).astype("int64").to_numpy()
    out = x > 1
    for p in _SMALL_PRIMES:
        out &= (x == p) | (x % p != 0)
    for i in np.flatnonzero(out & (x > _SMALL_PRIMES[-1] ** 2)):
        out[i] = _passes(int(x[i]))
    return pd.Series(out)


def _passes(n: int) -> bool:
    """Whether an odd n passes for every prime base up to 37: below 3 * 10^24 only primes do."""
    twos = ((n - 1) & (1 - n)).bit_length() - 1
    for base in _SMALL_PRIMES[:12]:
        x = pow(base, (n - 1) >> twos, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def register(spark: SparkSession) -> None:
    """Make ``vwap`` and ``sum_integers`` callable from SQL, as SQL functions that Spark inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vwap(bid DOUBLE, bid_qty INT, ask DOUBLE, ask_qty INT) RETURNS DOUBLE RETURN (bid * bid_qty + ask * ask_qty) / (bid_qty + ask_qty)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sum_integers(a INT, b INT) RETURNS INT RETURN a + b")


def extracted_time(df: DataFrame, millis: Column, name: str) -> DataFrame:
    """Add ``name``, the event time that an extractor gives in milliseconds; rows for which it gives a negative number, or null, are dropped."""
    return df.withColumn(name, F.timestamp_millis(millis)).filter(F.coalesce(millis, F.lit(-1)) >= 0)
