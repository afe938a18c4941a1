import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import windows
from tidewheel.sources import generators, readers, sinks
from tidewheel.streaming import replay, stateful


def at(text):
    return dt.datetime.fromisoformat(text)


def stream(spark, tmp_path, rows, schema, batches=3):
    """The rows in order as a stream of files, one a micro-batch."""
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{k:05d}")
    df = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path))
    return df


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_final_windows_only(spark, tmp_path):
    times = ["05:30:01", "05:30:02", "05:30:03", "05:45:01", "05:45:03", "05:55:10", "05:55:40"]
    df = stream(spark, tmp_path, [("101" if i < 6 else "XXX", at(f"2025-09-15 {t}")) for i, t in enumerate(times)], "id string, ts timestamp", 4)
    final = windows.tumbling(replay.event_time(df, "ts", "20 seconds"), "ts", "10 seconds", ["id"], n=F.count("*"))
    got = rows_of(replay.drain(final), "id", "n")
    # The watermark ends 20 s before the last row, at 05:55:20: the window that ends then is closed, that of the last row is not.
    assert got == [("101", 1), ("101", 2), ("101", 3)]
    with pytest.raises(TypeError):
        replay.event_time(df.withColumn("ms", F.lit(1).cast("long")), "ms")


STEPS = {
    "median": (stateful.median_step("k", "t", "v", 3), "k long, t long, v long, median double"),
    "accumulate": (stateful.accumulate_step("k", "t", "v", 50), "k long, tick_ms long, total long"),
    "ttl_list": (stateful.ttl_list_step("k", "t", "v", 30), "k long, t long, items string"),
    "changes": (stateful.changelog_join_step("k", "t", "v", "side"), "k long, t long, left long, right long"),
    "ttl_join": (stateful.ttl_join_step("k", "t", "v", "side", 40), "k long, t long, left long, right long"),
}


@pytest.mark.parametrize("name", STEPS)
def test_scan_on_stream_like_batch(spark, tmp_path, name):
    rng = random.Random(5)
    rows = [(rng.randrange(4), 7 * i, rng.randrange(50), rng.randrange(2)) for i in range(90)]
    schema = "k long, t long, v long, side int"
    step, out = STEPS[name]
    names = [c.split(" ")[0] for c in out.split(", ")]
    batch = stateful.scan(spark.createDataFrame(rows, schema), "k", ["t"], {}, step, out)
    streamed = replay.drain(stateful.scan(stream(spark, tmp_path, rows, schema), "k", ["t"], {}, step, out))
    assert sorted(map(str, batch.select(*names).collect())) == sorted(map(str, streamed.select(*names).collect())) != []


def test_ttl_join_golden(spark):
    rows = [("alice", 5, "a", 0), ("bobby", 10, "b", 0), ("alice", 10, "11", 1), ("bobby", 15, "21", 1), ("alice", 30, "12", 1), ("freddy", 65000, "f", 0), ("alice", 70006, "13", 1), ("bobby", 70016, "22", 1)]
    df = spark.createDataFrame(rows, "k string, t long, v string, side int")
    got = stateful.scan(df, "k", ["t", "side"], {}, stateful.ttl_join_step("k", "t", "v", "side", 10_000), "k string, t long, left string, right string")
    assert rows_of(got, "t", "left", "right") == [(10, "11", "a"), (15, "21", "b"), (30, "12", "a"), (70006, "13", None), (70016, "22", None)]


def test_dedup_refreshes(spark):
    base = at("2024-09-16 14:53:00")
    rows = [("a", base + dt.timedelta(seconds=s)) for s in (0, 50, 100, 170, 171)] + [("b", base)]
    df = spark.createDataFrame(rows, "id string, ts timestamp_ntz")
    scanned = stateful.scan(df, "id", ["ts"], {}, stateful.dedup_step("id", "ts", 60_000, ["id", "ts"]), "id string, ts timestamp_ntz")
    want = [("a", base), ("a", base + dt.timedelta(seconds=170)), ("b", base)]
    assert rows_of(scanned, "id", "ts") == want
    assert rows_of(stateful.dedup_islands(df.unionByName(df.limit(1).withColumn("id", F.lit(None).cast("string"))), "id", "ts", "60 seconds").filter("id is not null"), "id", "ts") == want


def test_reorder_on_stream(spark, tmp_path):
    order = "ABCDEFGHIJKL"
    times = ["03 23:00", "04 01:05", "04 01:10", "04 01:40", "04 02:25", "04 01:20", "04 02:45", "04 02:00", "04 03:00", "04 02:40", "04 02:20", "05 00:00"]
    rows = [(1, n, at(f"2021-11-{t}:00")) for n, t in zip(order, times, strict=True)]
    df = replay.event_time(stream(spark, tmp_path, rows, "k long, name string, ts timestamp", 12), "ts", "3 hours")
    out = replay.drain(stateful.reorder(df, "k", "ts", 10 * 3_600_000))
    got = [r.name for r in out.orderBy("_batch", "ts").collect()]
    assert "".join(got) == "ABCFDHKEJGI"
    place = stateful.reorder(spark.createDataFrame(rows, "k long, name string, ts timestamp_ntz"), "k", "ts", 36_000_000)
    assert "".join(r.name for r in place.orderBy("place").collect()) == "ABCFDHKEJGIL"


def test_reorder_keeps_the_first_of_equal_times_and_microseconds(spark, tmp_path):
    base = at("2024-01-01 00:00:01")
    rows = [(1, "a", base), (1, "b", base), (1, "c", base + dt.timedelta(microseconds=800)), (1, "d", at("2024-01-02 00:00:00")), (1, "e", at("2024-01-03 00:00:00"))]
    schema = "k long, name string, ts timestamp"
    out = replay.drain(stateful.reorder(replay.event_time(stream(spark, tmp_path, rows, schema, 5), "ts"), "k", "ts", 1000)).orderBy("_batch", "ts").collect()
    assert [r.name for r in out] == ["a", "c", "d"]
    offsets = spark.createDataFrame([(*r, 9 - i) for i, r in enumerate(rows)], "k long, name string, ts timestamp_ntz, offset int")
    assert [r.name for r in stateful.reorder(offsets, "k", "ts", 1000, "offset").orderBy("place").collect()] == ["b", "c", "d", "e"]


def test_tombstones_evict_idle_keys(spark, tmp_path):
    s = lambda n: at("2024-01-01 00:00:00") + dt.timedelta(seconds=n)
    rows = [("a", s(0), 1), ("b", s(1), 1), ("a", s(5), 2), ("c", s(6), 1), ("c", s(7), None), ("d", s(30), 1), ("d", s(31), 2), ("d", s(60), 3)]
    df = replay.event_time(stream(spark, tmp_path, rows, "k string, ts timestamp, v int", 8), "ts")
    got = replay.without_zone(replay.drain(stateful.tombstones(df, "k", "ts", "v", 10_000)))
    want = [("a", s(15)), ("b", s(11)), ("d", s(41))]
    assert rows_of(got, "k", "ts") == want
    assert rows_of(stateful.tombstones(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v int"), "k", "ts", "v", 10_000), "k", "ts") == want


def test_state_of_idle_keys_expires(spark, tmp_path):
    rows = [(1, i, float(i)) for i in range(4)]
    df = stream(spark, tmp_path, rows, "k long, t long, v double", 2)
    step = stateful.lag_step("k", "t", "v")
    got = replay.drain(stateful.scan(df, "k", ["t"], {}, step, "k long, t long, v double, previous double", idle_ms=86_400_000), empty_batches=False)
    assert rows_of(got, "t", "previous") == [(0, None), (1, 0.0), (2, 1.0), (3, 2.0)]
    folder = tmp_path / "again"
    for k, r in enumerate(rows[:2]):
        spark.createDataFrame([r], "k long, t long, v double").coalesce(1).write.parquet(f"{folder}/{k}")
    slow = spark.readStream.schema("k long, t long, v double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    short = replay.drain(stateful.scan(slow, "k", ["t"], {}, step, "k long, t long, v double, previous double", idle_ms=1), empty_batches=False)
    assert [p for _, p in rows_of(short, "t", "previous")] == [None, None]


class Handle:
    """Stands for the handle that Spark gives to a processor: one value and its timers."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_wall_clock_resets_totals(spark, tmp_path):
    df = stream(spark, tmp_path, [("a", 5.0), ("b", 5.0), ("a", 5.0), ("c", 5.0), ("b", 5.0)], "k string, v double", 3)
    steady = replay.drain(stateful.reset_totals(df, "k", "v", 3_600_000), "update", empty_batches=False)
    assert rows_of(replay.last_state(steady, ["k"]), "k", "total") == [("a", 10.0), ("b", 10.0), ("c", 5.0)]
    # A timer that is due again at once would keep the stream going for ever, so the reset itself is driven by hand.
    handle, totals = Handle(), stateful._WallClock("v", 20_000, ["k", "total"])
    totals.init(handle)
    rows = pd.DataFrame({"k": ["a", "a"], "v": [5.0, 5.0]})
    assert [f.values.tolist() for f in totals.handleInputRows(("a",), iter([rows]), Clock(1000))] == [[["a", 10.0]]]
    assert [f.values.tolist() for f in totals.handleExpiredTimer(("a",), Clock(21_000), None)] == [[["a", 0.0]]]
    assert handle.timers == [21_000, 41_000]
    assert [f.values.tolist() for f in totals.handleInputRows(("a",), iter([rows]), Clock(22_000))] == [[["a", 10.0]]]


def test_joins_and_windows_on_streams(spark, tmp_path):
    from tidewheel.operators import joins

    s = lambda n: at("2024-01-01 00:00:00") + dt.timedelta(seconds=n)
    orders = [(1, s(0), 10), (2, s(100), 11), (3, s(200), 12), (4, s(5000), 13)]
    ships = [(11, 1, s(50)), (12, 2, s(5000)), (13, 3, s(250)), (14, 4, s(9000))]
    left = replay.event_time(stream(spark, tmp_path / "o", orders, "order_id long, ts timestamp, item int"), "ts")
    right = replay.event_time(stream(spark, tmp_path / "s", ships, "ship_id long, oid long, ship_ts timestamp"), "ship_ts")
    met = joins.interval_join(left, right, [("order_id", "oid")], "ts", "ship_ts", "0 seconds", "600 seconds")
    assert rows_of(replay.drain(met), "order_id", "ship_id") == [(1, 11), (3, 13)]
    items = spark.createDataFrame([(10, "x"), (12, "y")], "item int, name string")
    assert rows_of(replay.drain(joins.table_join(left, items, ["item"])), "order_id", "name") == [(1, "x"), (3, "y")]
    assert rows_of(replay.drain(joins.table_join(left, items, ["item"], "left")), "order_id", "name") == [(1, "x"), (2, None), (3, "y"), (4, None)]
    hops = replay.last_state(replay.drain(windows.hopping(left, "ts", "200 seconds", "100 seconds", n=F.count("*")), "update"), ["window_start", "window_end"])
    batch = windows.hopping(spark.createDataFrame(orders, "order_id long, ts timestamp, item int"), "ts", "200 seconds", "100 seconds", n=F.count("*"))
    assert rows_of(hops, "window_start", "n") == rows_of(batch, "window_start", "n")
    sessions = replay.drain(windows.session(left.withColumn("k", F.lit(1)), "ts", "150 seconds", ["k"], n=F.count("*")))
    assert rows_of(sessions, "window_start", "n") == [(s(0), 3)]


def test_undecodable_keys_are_dead_letters_and_the_rest_is_routed(spark):
    from tidewheel.functions import scalars
    from tidewheel.operators import relational

    df = spark.createDataFrame([(b"\x00\x00\x00\x05", 1), (b"\x00\x00\x00\x04", 2), (b"\x01", 3), (None, 4)], "key binary, id int")
    good, dead = sinks.dead_letters(df.withColumn("n", readers.integer_from_bytes(F.col("key"), 4)), {"key": F.col("n").isNotNull()})
    routed = relational.branch(good.withColumn("p", scalars.is_prime("n")), [("primes", F.col("p"))], "composites", "route")
    assert rows_of(routed, "id", "route") == [(1, "primes"), (2, "composites")] and rows_of(dead, "id", "error") == [(3, "key"), (4, "key")]


def test_counter_source(spark):
    generators.register(spark)
    assert spark.read.format("counter").option("tasks", 2).option("most", 5).load().count() == 10
    got = replay.drain(spark.readStream.format("counter").option("tasks", 2).option("step", 4).option("most", 4).load())
    assert rows_of(got, "task", "n") == [(t, n) for t in range(2) for n in range(4)]
    a, b = (rows_of(spark.read.format("readings").option("rows", 5).load(), "trap", "plate", "speed") for _ in range(2))
    assert a == b and len(a) == 20


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(b"\x00\x00\x00\x05", 1), (b"\xff\xff\xff\xfb", 2), (b"\x01", 3), (None, 4)], "b binary, id int")
    assert rows_of(df.select("id", readers.integer_from_bytes(F.col("b"), 4).alias("n")), "id", "n") == [(1, 5), (2, -5), (3, None), (4, None)]
    framed = spark.createDataFrame([(7, "x")], "s int, t string").select(readers.frame(F.col("s"), F.col("t").cast("binary")).alias("v"))
    (row,) = readers.wire_format(framed.unionByName(spark.createDataFrame([(b"\x01abc",)], "v binary")), "v").filter("schema_id is not null").collect()
    assert (row.schema_id, bytes(row.body)) == (7, b"x")
    js = spark.createDataFrame([('{"a": 1}', 1), ("{oops", 2)], "v string, id int")
    good, dead = sinks.dead_letters(readers.decode_json(js, "v", "a int", ["id"]), {"json": F.col("_corrupt").isNull()})
    assert rows_of(good, "id", "a") == [(1, 1)] and rows_of(dead, "id", "error") == [(2, "json")]
    v1, v2 = spark.createDataFrame([("d1", 1.5)], "id string, t float"), spark.createDataFrame([("d2", 2.5, "f")], "id string, t double, f string")
    assert rows_of(readers.evolved_union([v1, v2], {"t": "double"}, {"f": "N/A"}), "id", "t", "f") == [("d1", 1.5, "N/A"), ("d2", 2.5, "f")]
    sinks.write_routes(v2.withColumn("route", F.lit("special")), "route", f"{tmp_path}/routes")
    assert spark.read.parquet(f"{tmp_path}/routes").first().route == "special"
    sinks.convert(v2, f"{tmp_path}/json", "json")
    assert spark.read.json(f"{tmp_path}/json").count() == 1
    log = spark.createDataFrame([(("bad", "cause", "aGk="),)], "e struct<errorMessage:string,cause:string,recordB64:string>").select(F.struct(F.col("e").alias("deserializationError")).alias("message"))
    assert tuple(sinks.error_log(log).first()) == ("bad", "cause", "hi")
    failures = spark.createDataFrame([(at("2024-01-01 23:50:00"),), (at("2024-01-02 00:10:00"),), (at("2024-01-02 00:20:00"),), (at("2024-01-03 00:00:00"),)], "ts timestamp_ntz")
    assert rows_of(sinks.failure_budget(failures, "ts", F.lit(True), 3, "1 hour"), "last", "failures") == [(at("2024-01-02 00:20:00"), 3)]
    with pytest.raises(RuntimeError):
        sinks.check_budget(failures, "ts", F.lit(True), 3, "1 hour")


def test_restarts():
    class Query:
        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self):
            if self.fails:
                raise ValueError

    plan = iter([True, True, False])
    clock = iter(range(0, 100_000, 5000))
    assert sinks.run_with_restarts(lambda: Query(next(plan)), 3, 3600, lambda: next(clock)) == 2
    with pytest.raises(ValueError):
        sinks.run_with_restarts(lambda: Query(True), 3, 3600, lambda: 0)


def test_dead_letters_from_a_stream(spark, tmp_path):
    df = stream(spark, tmp_path / "in", [(i, i % 3) for i in range(9)], "id long, v long")
    write = sinks.write_both(f"{tmp_path}/good", f"{tmp_path}/dead", {"v": F.col("v") > 0})
    df.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good").count() == 6 and spark.read.parquet(f"{tmp_path}/dead").count() == 3
