import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.operators import analytic, joins, patterns, relational, timeseries, vectors, windows


def ts(text):
    return dt.datetime.fromisoformat(text)


def values(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_cumulating_golden(spark):
    rows = [(0, 2, 6.98, "02:02:30"), (1, 2, 9.99, "02:08:00"), (2, 1, 9.99, "02:19:30"), (3, 1, 8.10, "02:22:30"), (4, 3, 6.19, "02:23:20"), (5, 3, 6.98, "02:25:30"), (6, 2, 6.98, "02:25:49"), (7, 4, 8.00, "02:34:30")]
    df = spark.createDataFrame([(i, q, p, ts(f"2023-01-15 {t}")) for i, q, p, t in rows], "id int, quantity int, price double, ts timestamp_ntz")
    got = windows.cumulating_sum(df, "ts", 300, 600, F.col("quantity") * F.col("price"), "revenue", digits=2)
    want = [("02:00", "02:05", 13.96), ("02:00", "02:10", 33.94), ("02:10", "02:20", 9.99), ("02:20", "02:25", 26.67), ("02:20", "02:30", 61.57), ("02:30", "02:35", 32.0), ("02:30", "02:40", 32.0)]
    assert values(got, "window_start", "window_end", "revenue") == [(ts(f"2023-01-15 {a}"), ts(f"2023-01-15 {b}"), v) for a, b, v in want]


def test_session_golden(spark):
    rows = [("/jeep", "2023-07-09 01:00:00"), ("/chickens", "2023-07-09 02:00:10"), ("/chickens", "2023-07-09 02:00:20"), ("/chickens", "2023-07-09 02:01:00"), ("/jeep", "2023-07-09 01:00:30"), ("/jeep", "2023-07-09 01:01:00"), ("/movies", "2023-07-09 09:00:00"), ("/trips", "2023-07-09 12:00:00"), ("/movies", "2023-07-09 09:00:30"), ("/tractors", "2023-07-09 02:30:00"), ("/tractors", "2023-07-10 02:31:00")]
    df = spark.createDataFrame([(u, ts(t)) for u, t in rows], "url string, ts timestamp_ntz")
    got = windows.session(df, "ts", "2 minutes", ["url"], n=F.count("*"))
    want = [("/chickens", 3, "2023-07-09 02:00:10", "2023-07-09 02:03:00"), ("/jeep", 3, "2023-07-09 01:00:00", "2023-07-09 01:03:00"), ("/movies", 2, "2023-07-09 09:00:00", "2023-07-09 09:02:30"), ("/tractors", 1, "2023-07-09 02:30:00", "2023-07-09 02:32:00"), ("/tractors", 1, "2023-07-10 02:31:00", "2023-07-10 02:33:00"), ("/trips", 1, "2023-07-09 12:00:00", "2023-07-09 12:02:00")]
    assert values(got, "url", "n", "window_start", "window_end") == [(u, n, ts(a), ts(b)) for u, n, a, b in want]
    last = windows.session(df, "ts", "2 minutes", ["url"], end="last", n=F.count("*"))
    assert ("/jeep", 60_000) in values(last, "url", "length_ms")


READINGS = [(0, 55), (1, 40), (2, 59), (0, 50), (1, 42), (2, 57), (0, 52), (1, 43), (2, 56), (0, 49), (1, 45), (2, 55), (0, 53), (1, 47), (2, 53)]


@pytest.fixture(scope="module")
def readings(spark):
    return spark.createDataFrame([(s, float(t), ts("2023-04-03 02:00:00") + dt.timedelta(seconds=i)) for i, (s, t) in enumerate(READINGS)], "sensor int, temperature double, ts timestamp_ntz")


def test_pattern_goldens(readings):
    up = patterns.rising_runs(readings, "sensor", ["ts"], "temperature", 5)
    assert values(up) == [(1, ts("2023-04-03 02:00:01"), 40.0, ts("2023-04-03 02:00:13"), 47.0)]
    both = patterns.rising_or_falling(readings, "sensor", ["ts"], "temperature", 5)
    want = [(1, ts("2023-04-03 02:00:01"), 40.0, ts("2023-04-03 02:00:13"), 47.0), (2, ts("2023-04-03 02:00:02"), 59.0, ts("2023-04-03 02:00:14"), 53.0)]
    assert values(both) == want
    assert values(patterns.same_direction(readings, "sensor", ["ts"], "temperature", 5)) == want
    t = F.col("temperature")
    abc = patterns.sequence_abc(readings, "sensor", ["ts"], t > 51, t < 51, t > 51)
    assert values(abc, "sensor", "ts") == [(0, ts("2023-04-03 02:00:00"))]


def test_hot_keys_are_not_collected(spark):
    rng = random.Random(4)
    # A key of one monotone stretch after another.
    rows = [(1, i, float(abs(i % 14 - 7))) for i in range(30_000)] + [(2, i, float(rng.randrange(6))) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    want = []
    for k in (1, 2):
        own = [(i, v) for kk, i, v in rows if kk == k]
        want += [(k, own[a][0], own[a][1], own[b][0], own[b][1]) for a, b in patterns.scan_same_direction([v for _, v in own], 4)]
    got = patterns.same_direction(df, "k", ["i"], "v", 4)
    assert values(got) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "Python" not in plan
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "gone"), (1, 3, "a"), (1, 4, None), (2, 5, "a"), (2, 6, "gone")], "k int, i long, what string")
    got = relational.totals_since_delete(df, "k", "i", "i", F.col("what") == "gone", "n", "ids")
    assert values(got, "k", "n", "ids") == [(1, 2, 7)] and "collect_list" not in got._jdf.queryExecution().toString()


def test_patterns_like_brute_force(spark):
    rng = random.Random(3)
    rows = [(i % 3, i, float(rng.randrange(6))) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    by = {k: [(i, v) for kk, i, v in rows if kk == k] for k in range(3)}
    for n in (2, 3, 4, 5):
        want = []
        for k, own in by.items():
            for a, b in patterns.scan_same_direction([v for _, v in own], n):
                want.append((k, own[a][0], own[a][1], own[b][0], own[b][1]))
        got = patterns.same_direction(df, "k", ["i"], "v", n)
        assert values(got) == sorted(want)
    want = []
    for k, own in by.items():
        n = 0
        while n + 2 < len(own):
            if own[n][1] > 2 and own[n + 1][1] < 3 and own[n + 2][1] > 1:
                want.append((k, own[n][0], own[n + 2][0]))
                n += 3
            else:
                n += 1
    v = F.col("v")
    abc = patterns.sequence_abc(df, "k", ["i"], v > 2, v < 3, v > 1)
    assert values(abc.select("k", "i", F.col("third.i"))) == sorted(want)


def test_average_over_rows_needs_no_single_task(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(100))) for i in range(300)] + [(1000, 5.0), (5000, 7.0)]
    want = sorted((i, round(sum(v for _, v in rows[max(0, k - 5) : k + 1]) / len(rows[max(0, k - 5) : k + 1]), 6)) for k, (i, _) in enumerate(rows))
    for partitions in (1, 7, 150):
        assert values(analytic.average_over_rows(spark.createDataFrame(rows, "i int, v double"), ["i"], "v", 5, "a", 6, partitions), "i", "a") == want


def test_as_of_golden(spark):
    now = 1_700_000_000
    words = [("one", "peanut butter and", "jelly", "sardines", 50), ("two", "ham and", "cheese", "an old tire", 40), ("three", "cheese and", "crackers", "fish eyes", 30)]
    stream = spark.createDataFrame([(k, s, dt.datetime.fromtimestamp(now - d, dt.UTC).replace(tzinfo=None)) for k, s, _, _, d in words], "key string, value string, ts timestamp_ntz")
    table = spark.createDataFrame([(k, v, dt.datetime.fromtimestamp(now + sign * d, dt.UTC).replace(tzinfo=None)) for k, _, a, b, d in words for v, sign in ((a, -1), (b, 1))], "key string, other string, at timestamp_ntz")
    got = joins.as_of(stream, table, ["key"], "ts", "at", ["other"], retention="10 minutes", how="inner")
    assert values(got, "key", "value", "other") == [("one", "peanut butter and", "jelly"), ("three", "cheese and", "crackers"), ("two", "ham and", "cheese")]


def test_interval_join_buckets_change_nothing(spark):
    rng = random.Random(4)
    make = lambda n, name: spark.createDataFrame([(i, rng.randrange(3), ts("2024-01-01 00:00:00") + dt.timedelta(seconds=rng.randrange(5000))) for i in range(n)], f"{name} int, k int, {name}_ts timestamp_ntz")
    a, b = make(80, "a"), make(80, "b")
    plain = joins.interval_join(a, b, [("k", "k")], "a_ts", "b_ts", "-60 seconds", "300 seconds")
    spread = joins.interval_join(a, b, [("k", "k")], "a_ts", "b_ts", "-60 seconds", "300 seconds", bucket_seconds=400)
    assert values(plain, "a", "b") == values(spread, "a", "b") != []


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(S.geo_distance(*map(F.lit, (37.7749, -122.4194, 37.7749, -122.4194)), "km")) == 0
    assert get(S.vwap(*map(F.lit, (25.0, 100, 26.0, 300)))) == 25.75
    assert get(S.decode_base64(F.lit("aGVsbG8="))) == "hello"
    assert get(S.part(F.lit("a::b"), "::", 2)) == "b" and get(S.part(F.lit("a"), "::", 2)) is None
    assert get(S.to_seconds(F.lit("2009-02-13 23:31:30"), "yyyy-MM-dd HH:mm:ss")) == 1234567890
    assert get(S.day_name(F.lit("2024-01-07").cast("date"))) == "Sunday"
    assert get(S.parse_timestamp(F.lit("bad"), failure="epoch")).year == 1970 and get(S.parse_timestamp(F.lit("bad"))) is None
    assert get(S.map_value(S.text_to_map(F.lit("a=1,b=2")), "c")) is None
    assert get(S.composite_part(F.lit("12-QUA00001"))) == "QUA"
    assert [r.p for r in spark.range(-1, 12).select(S.is_prime("id").alias("p"), "id").orderBy("id").collect()] == [False, False, False, True, True, False, True, False, True, False, False, False, True]
    S.register(spark)
    assert spark.sql("SELECT sum_integers(2, 3) AS x, vwap(25.0D, 100, 26.0D, 300) AS y").first() == (5, 25.75)


def test_relational(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, "y")], "id int, k string, v string")
    assert values(relational.branch(df, [("first", F.col("k") == "a"), ("any", F.col("id") > 0)]), "id", "branch") == [(1, "first"), (2, "any"), (3, "any")]
    parts = relational.split_by(df, {"not_a": F.col("k") != "a"})
    assert values(parts["not_a"], "id") == [(2,)]
    assert values(relational.mask(df.select("id", F.lit("Ab 1").alias("m")), "m"), "m")[0] == ("Xx-n",)
    titles = spark.createDataFrame([("Tree of Life::2011",), ("Bad::x",), ("None",)], "t string")
    assert values(relational.split_title(titles, "t", "title", "year", errors="bad"), "title", "bad") == [("Bad", "Bad::x"), ("None", "None"), ("Tree of Life", None)]
    changes = spark.createDataFrame([("a", 1, "v1"), ("a", 2, "v2"), ("b", 1, "w"), ("b", 3, None)], "k string, o int, v string")
    assert values(relational.latest(changes, "k", ["o"], F.col("v").isNull())) == [("a", 2, "v2")]
    log = analytic.changelog(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, o int"), "k", ["o"])
    assert values(log, "k", "n", "kind") == [("a", 1, "+I"), ("a", 1, "-U"), ("a", 2, "+U"), ("b", 1, "+I")]


def test_models(spark):
    df = spark.createDataFrame([(i, 2.0 + (10 if i == 40 else 0) + i % 2) for i in range(50)], "i int, v double")
    found = timeseries.anomalies(df.withColumn("k", F.lit(1)), ["k"], ["i"], "v", least=16)
    flagged = [r.i for r in found.collect() if r.is_anomaly]
    assert 40 in flagged and all(r.forecast is None for r in found.collect() if r.i < 16)
    texts = spark.createDataFrame([(0, "spark streams"), (1, "spark stream"), (2, "cooking pasta"), (3, None)], "id long, t string")
    e = vectors.embed(texts, "t").cache()
    near = vectors.nearest(e.filter("t is not null"), "id", "vector", e.filter("id = 0").select(F.col("id").alias("q"), "vector"), "q", "vector", 2)
    assert values(near, "q", "id", "rank") == [(0, 0, 1), (0, 1, 2)]
    done = vectors.complete(texts, F.col("t"), lambda prompts: [p.upper() for p in prompts])
    assert values(done.filter("id < 3"), "completion") == [("COOKING PASTA",), ("SPARK STREAM",), ("SPARK STREAMS",)]


def test_sliding_windows_like_brute_force(spark):
    rng = random.Random(2)
    rows = [("d", rng.randrange(3000), float(rng.randrange(50))) for _ in range(60)]
    got = windows.sliding(spark.createDataFrame(rows, "d string, t long, v double"), "t", "d", "v", 500)
    starts = {x for _, t, _ in rows for x in (t - 500, t + 1)}
    want = [("d", s, len(own)) for s in starts if (own := [v for _, t, v in rows if s <= t <= s + 500])]
    assert values(got, "d", "window_start", "n") == sorted(want)


def test_leader_at_ticks_golden(spark):
    """Five logins, two seconds apart, and a tick each five seconds: at each the user with the largest total so far."""
    from tidewheel.operators import analytic

    logins = [(u, 2000 * i, 5) for i, u in enumerate(["user-1", "user-2", "user-1", "user-3", "user-2"])]
    got = analytic.leader_at_ticks(spark.createDataFrame(logins, "user string, t long, spent int"), "user", "t", "spent", 5000)
    assert values(got) == [(5000, "user-1", 10)]
    more = logins + [("user-2", 11_000, 5), ("user-0", 30_000, 15), ("user-9", 36_000, 1)]
    got = analytic.leader_at_ticks(spark.createDataFrame(more, "user string, t long, spent int"), "user", "t", "spent", 5000)
    assert values(got) == [(5000, "user-1", 10), (10_000, "user-1", 10), (15_000, "user-2", 15), (35_000, "user-0", 15)]


def test_frames_of_an_interval_like_brute_force(spark):
    import datetime as dt

    from tidewheel.operators import analytic

    rng = random.Random(8)
    base = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(2), base + dt.timedelta(milliseconds=rng.randrange(200_000)), i, 1) for i in range(400)] + [(0, None, 900, 1), (0, None, 901, 1)]
    got = analytic.count_over_range(spark.createDataFrame(rows, "k int, ts timestamp_ntz, i int, range int"), "k", "ts", 3_000_000).select("i", "n").collect()
    near = lambda a, b: (a is None and b is None) or (a is not None and b is not None and dt.timedelta(0) <= a - b <= dt.timedelta(seconds=3))
    assert sorted(map(tuple, got)) == sorted((i, sum(kk == k and near(ts, other) for kk, other, *_ in rows)) for k, ts, i, _ in rows)


def test_interval_frames_are_running_sums_and_nothing_is_taken_off(spark, capsys):
    import datetime as dt

    from tidewheel.operators import analytic, windows

    rng = random.Random(9)
    base = dt.datetime(1969, 12, 31, 23, 59)  # blocks on both sides of zero
    value = lambda i: rng.choice([None, rng.randrange(1000) / 100, 1e17 if i % 40 == 0 else 0.5, float("nan") if i % 90 == 7 else 0.25])
    rows = [(rng.choice(["a", "b", None]), base + dt.timedelta(milliseconds=250 * rng.randrange(700)), i, value(i)) for i in range(500)] + [("a", None, 900, 2.5), ("a", None, 901, 1.5)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, i int, average double")
    near = lambda a, b: (a is None and b is None) or (a is not None and b is not None and dt.timedelta(0) <= a - b <= dt.timedelta(seconds=3))
    of = {i: [v for kk, other, _, v in rows if kk == k and near(ts, other)] for k, ts, i, _ in rows}
    counted = analytic.count_over_range(df, "k", "ts", 3_000_000)
    assert counted.columns == [*df.columns, "n"]
    assert {r.i: r.n for r in counted.collect()} == {i: len(vs) for i, vs in of.items()}
    got = {r.i: r.mean for r in windows.trailing_average(df, "ts", "k", "average", 3000, "mean", 4).collect()}
    for i, vs in of.items():
        known = [v for v in vs if v is not None]
        assert (got[i] is None) if not known else got[i] == pytest.approx(sum(known) / len(known), abs=1e-4, rel=1e-12, nan_ok=True)
    # A frame with a moving start is added up anew for every row: as many additions as rows times rows in an interval.
    windows.trailing_average(df, "ts", "k", "average", 3000, "mean").explain()
    plan = capsys.readouterr().out
    frames = plan.count("specifiedwindowframe")
    assert frames and plan.count("unboundedpreceding$(), currentrow$()") == frames


def test_count_over_range_adds_up_from_the_first_row_only(spark, capsys):
    from tidewheel.plans import catalog

    catalog.queries()["over_range_1h"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("unboundedpreceding$(), currentrow$()") == plan.count("specifiedwindowframe") > 0
