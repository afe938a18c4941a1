"""Helper names that the input has too, large primes, broadcast bounds, lists since a deletion, and sources without a query."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewheel.functions import scalars
from tidewheel.operators import analytic, joins, patterns, relational, timeseries, windows
from tidewheel.sources import readers
from tidewheel.streaming import stateful

HELPERS = "x n sx sy sxy sxx syy f s rows at range place halo new run chunk size first last b c k t apart symbol task side start m n_all m_all s_all turn".split()


def clashing(df):
    """All helper names as columns, each with one and two underscores, too."""
    taken = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(7) for h in HELPERS for n in (h, f"_{h}") if n.lower() not in taken})


def test_helper_names_in_the_input(spark):
    rng = random.Random(1)
    rows = [(k, i, float(rng.randrange(50)), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for k in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "key int, i int, v double, ts timestamp_ntz")
    v = F.col("v")
    forms = {
        "forecast": lambda d: timeseries.forecast(d, ["key"], ["i"], "v"),
        "anomalies": lambda d: timeseries.anomalies(d, ["key"], ["i"], "v"),
        "growing": lambda d: timeseries.growing_anomalies(d, ["key"], ["i"], "v", partitions=3),
        "average": lambda d: analytic.average_over_rows(d, ["ts", "key"], "v", 3, "mean", partitions=3),
        "first": lambda d: analytic.first_per_key(d, ["key"], ["i"]),
        "rising": lambda d: patterns.rising_runs(d, "key", ["i"], "v", 2),
        "abc": lambda d: patterns.sequence_abc(d, "key", ["i"], v > 20, v < 30, v > 10),
        "own": lambda d: joins.with_own_count(d.withColumn("ms", F.col("i") * 1000), "key", ["i"], "ms", 3000),
        "interval": lambda d: joins.interval_join(d.select(*df.columns, *[c for c in d.columns if c not in df.columns][:8]), df.select(F.col("key").alias("key2"), F.col("ts").alias("ts2")), [("key", "key2")], "ts", "ts2", "-2 minutes", "1 minutes", 600),
        "since": lambda d: relational._since_delete(d, "key", "i", v > 45),
        "islands": lambda d: stateful.dedup_islands(d, "key", "ts", "1 minutes"),
        "sliding": lambda d: windows.sliding(d.withColumn("ms", F.col("i") * 1000), "ms", "key", "v", 3000),
    }
    for name, form in forms.items():
        want = form(df)
        got = form(clashing(df))
        same = [c for c in want.columns if c in got.columns]
        assert same == want.columns, name
        assert sorted(map(str, got.select(*same).collect())) == sorted(map(str, want.collect())), name
        if name in ("forecast", "anomalies", "growing", "average", "first", "abc", "own", "since", "islands"):
            assert set(clashing(df).columns) <= set(got.columns), name
            assert {r["_n"] for r in got.select("_n").collect()} == {7}, name


def test_primes_of_64_bits(spark):
    known = {2: True, 199: True, 39601: False, 40009: True, 2**31 - 1: True, (2**31 - 1) * 3: False, 10**18 + 9: True, 10**18 + 11: False, 2**63 - 25: True, 2**63 - 1: False, 3215031751: False, 341550071728321: False, -7: False}
    got = spark.createDataFrame([(n,) for n in known], "n long").select("n", scalars.is_prime("n").alias("p")).collect()
    assert {r.n: r.p for r in got} == known


def test_small_is_bounded_by_rows_and_bytes(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(joins.small(spark.range(10)))
    assert not hinted(joins.small(spark.range(11), 10))
    assert not hinted(joins.small(spark.range(3).select(F.repeat(F.lit("x"), 1000).alias("t")), 10, 1000))
    assert hinted(joins.small(spark.range(0)))


def test_lists_since_a_deletion(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, None), ("a", 4, "z"), ("a", 5, "w"), ("b", 1, "q"), ("b", 2, None), ("c", 1, "r")]
    df = spark.createDataFrame(rows, "k string, i int, v string")
    got = {r.k: r["values"] for r in relational.collected(df, "k", "v", "i", F.col("v").isNull()).collect()}
    assert got == {"a": ["z", "w"], "c": ["r"]}
    counts = relational.cogrouped_rollup([df.select("k", "v"), df.select("k", "v")], "k", "v").filter("v is not null")
    assert {r.k: r.counts for r in relational.rollup_maps(counts, "k", "v").collect()}["c"] == {"r": 2}


def test_literal_rows_and_timestamps_to_drop(spark):
    df = readers.literal_rows(spark, [(1, "a"), (2, None)], "id int, name string")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "a"), (2, None)]
    timed = readers.literal_rows(spark, [(1, 1_700_000_000_000), (2, -1), (3, None), (4, 0)], "id int, ms long")
    got = scalars.extracted_time(timed, F.col("ms"), "ts").orderBy("id").collect()
    assert [(r.id, r.ts) for r in got] == [(1, dt.datetime(2023, 11, 14, 22, 13, 20)), (4, dt.datetime(1970, 1, 1))]
