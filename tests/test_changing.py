"""Changing tables on streams, with typed state."""

import datetime as dt
import decimal
import os
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_streaming import at, rows_of, stream
from tidewheel.operators import joins, windows
from tidewheel.sources import sinks
from tidewheel.streaming import changing, replay, stateful


def test_versioned_table_golden(spark, tmp_path):
    now = at("2024-05-01 12:00:00")
    ago = lambda s: now - dt.timedelta(seconds=s)
    keys = ["one", "two", "three", "four", "five"]
    original = ["jelly", "cheese", "crackers", "biscuits", "cream"]
    later = ["sardines", "an old tire", "fish eyes", "moldy bread", "lots of salt"]
    asked = ["peanut butter and", "ham and", "cheese and", "tea and", "coffee with"]
    versions = [(k, v, ago(50 - 10 * i)) for i, (k, v) in enumerate(zip(keys, original, strict=True))]
    versions += [(k, v, now + dt.timedelta(seconds=s)) for k, v, s in zip(keys, later, (50, 40, 30, 30, 30), strict=True)]
    table = stream(spark, tmp_path / "t", versions, "k string, with string, at timestamp", 2)
    left = stream(spark, tmp_path / "s", [(k, v, ago(50 - 10 * i)) for i, (k, v) in enumerate(zip(keys, asked, strict=True))], "k string, item string, ts timestamp", 5)
    out = replay.drain(changing.as_of(left, table, ["k"], "ts", "at", ["with"], how="inner", lateness="2 minutes"))
    # The watermark ends 2 minutes before the last version: nothing is due yet.
    assert out.count() == 0
    left = stream(spark, tmp_path / "s2", [(k, v, ago(50 - 10 * i)) for i, (k, v) in enumerate(zip(keys, asked, strict=True))], "k string, item string, ts timestamp", 5)
    table, end = replay.ended(table, "at", "2024-06-01 00:00:00")
    out = replay.drain(changing.as_of(left, table, ["k"], "ts", "at", ["with"], how="inner", lateness="2 minutes"), end=end)
    assert {r.k: f"{r.item} {r['with']}" for r in out.collect()} == {"one": "peanut butter and jelly", "two": "ham and cheese", "three": "cheese and crackers", "four": "tea and biscuits", "five": "coffee with cream"}


@pytest.mark.parametrize("retention", [None, 40])
def test_stream_as_of_equals_batch_with_late_versions(spark, tmp_path, retention):
    rng = random.Random(8)
    base = at("2024-01-01 00:00:00")
    when = lambda s: base + dt.timedelta(seconds=s, microseconds=s)
    # Each side is up to 30 s out of order; times are unique within a key.
    places = lambda n: sorted(rng.sample(range(400), n), key=lambda s: s + rng.randrange(30))
    versions = [(k, when(s), f"{k}{s}", decimal.Decimal(s), when(s).date()) for k in ("a", "b") for s in places(60)]
    versions.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(30)))
    left = [(i, k, when(s), None if s % 7 else dt.date(2024, 1, 1)) for i, (k, s) in enumerate((k, s) for k in ("a", "b", "c") for s in places(50))]
    left.sort(key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(30)))
    names, types = ["name", "price", "day"], "k string, at timestamp, name string, price decimal(10,2), day date"
    ltypes = "id long, k string, ts timestamp, day1 date"
    table, end = replay.ended(stream(spark, tmp_path / "t", versions, types, 6), "at", "2030-01-01 00:00:00")
    out = replay.drain(changing.as_of(stream(spark, tmp_path / "s", left, ltypes, 6), table, ["k"], "ts", "at", names, retention_us=retention and retention * 1_000_000, lateness="10 minutes"), end=end)
    want = joins.as_of(spark.createDataFrame(left, ltypes), spark.createDataFrame(versions, types), ["k"], "ts", "at", names, retention=f"{retention} seconds" if retention else None)
    assert rows_of(out.fillna("-", ["name"]), "id", "k", "ts", "name") == rows_of(want.fillna("-", ["name"]), "id", "k", "ts", "name")
    assert sorted(map(str, out.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_versions_leave_the_store(spark, tmp_path):
    base = at("2024-01-01 00:00:00")
    rows = [("a", base + dt.timedelta(minutes=i), i) for i in range(60)]
    versions = stream(spark, tmp_path / "t", rows, "k string, at timestamp, v int", 6)
    left = stream(spark, tmp_path / "s", [("a", base + dt.timedelta(minutes=i, seconds=1)) for i in range(60)], "k string, ts timestamp", 6)
    folder = replay.shared_folder(spark)
    out = replay.drain(changing.as_of(left, versions, ["k"], "ts", "at", ["v"]), checkpoint=folder)
    assert rows_of(out, "v") == [(i,) for i in range(59)]
    held = spark.read.format("statestore").option("stateVarName", "versions").load(folder).count()
    assert held <= 2


class Counted:
    """A store of lists that counts the calls of it, as each goes to another process and back."""

    def __init__(self):
        self.calls, self.timers, self.lists = 0, set(), {}

    def getListState(self, name, schema):
        held, store = self.lists.setdefault(name, []), self

        class State:
            def appendList(self, rows):
                store.calls += 1
                held.extend(rows)

            def get(self):
                store.calls += 1
                return iter(list(held))

            def clear(self):
                store.calls += 1
                held.clear()

        return State()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def getCurrentWatermarkInMs(self):
        return 600


def test_as_of_calls_the_store_by_key_and_not_by_row(spark):
    field = T.StructType([T.StructField("v", T.LongType())])
    row = lambda i, side: {"_us": 1000 * i, "_row": (i,) if side else None, "_version": None if side else (i,)}
    store, calls = Counted(), {}
    for n in (10, 1000):
        processor, store = changing._AsOf(field, field, ["a", "b"], None, False), Counted()
        processor.init(store)
        list(processor.handleInputRows((1,), iter([row(i, side) for i in range(n) for side in (0, 1)]), None))
        assert store.timers == {1}
        out = list(processor.handleExpiredTimer((1,), store, None))
        assert [tuple(r) for r in out] == [(i, i) for i in range(min(n, 600))]
        calls[n] = store.calls
    assert calls[1000] <= calls[10] + 3
    assert store.timers == {1, 601} and len(store.lists["waiting"]) == 400 and len(store.lists["versions"]) == 401


def test_stream_as_of_query_with_files_out_of_order_of_time(spark, tmp_path):
    from tidewheel.plans import catalog

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(6, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    got, want = (catalog.queries()[q](spark, str(tmp_path)) for q in ("stream_asof", "asof_join"))
    assert rows_of(got.fillna(-1), "event_id", "signup_id") == rows_of(want.fillna(-1), "event_id", "signup_id") != []


ALBUMS = [("5", "Rock", "Led Zeppelin"), ("6", "Rock", "AC/DC"), ("7", "Hip hop", "LL Cool J"), ("8", "Rap rock", "Run-D.M.C")]
TRACKS = [("100", "Houses Of The Holy", "5"), ("101", "King Of Rock", "8"), ("102", "Shot Down In Flames", "6"), ("103", "Rock The Bells", "7"), ("104", "Can You Rock It Like This", "8"), ("105", "Highway To Hell", "6"), ("106", "Kashmir", "5")]


def test_foreign_key_golden(spark, tmp_path):
    albums = stream(spark, tmp_path / "a", [(*a, 1) for a in ALBUMS], "id string, genre string, artist string, at int", 2)
    tracks = stream(spark, tmp_path / "t", [(*t, 1) for t in TRACKS], "id string, title string, album string, at int", 4)
    out = replay.drain(changing.foreign_key_join(tracks, albums, "id", "album", ["title"], "id", ["genre", "artist"], "at", "at"))
    got = [(f"{r.album}-{r.id}", r.genre, r.artist) for r in changing.current(out, "id").collect()]
    of = {a[0]: a[1:] for a in ALBUMS}
    assert sorted(got) == sorted((f"{t[2]}-{t[0]}", *of[t[2]]) for t in TRACKS)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("seed", [1, 2])
def test_foreign_key_with_moves_and_deletes(spark, tmp_path, seed, how):
    rng = random.Random(seed)
    children = [(rng.randrange(8), t, rng.choice([None, 1, 2, 3, 4]), f"c{t}", rng.random() < 0.2) for t in range(60)]
    parents = [(rng.randrange(1, 5), t, dt.date(2024, 1, 1 + t % 28), decimal.Decimal(t), rng.random() < 0.3) for t in range(30)]
    c = stream(spark, tmp_path / "c", children, "cid long, t int, ref long, name string, gone boolean", 5)
    p = stream(spark, tmp_path / "p", parents, "pid long, t int, day date, price decimal(9,1), gone boolean", 3)
    out = replay.drain(changing.foreign_key_join(c, p, "cid", "ref", ["name"], "pid", ["day", "price"], "t", "t", F.col("gone"), F.col("gone"), how))
    got = sorted(map(tuple, changing.current(out, "cid").select("cid", "ref", "name", "day").collect()), key=str)
    last = lambda rows: {r[0]: r for r in rows if True}
    now = {k: r for k, r in last(parents).items() if not r[4]}
    want = []
    for cid, _, ref, name, gone in last(children).values():
        if not gone and ref is not None and (ref in now or how == "left"):
            want.append((cid, ref, name, now[ref][2] if ref in now else None))
    assert got == sorted(want, key=str)


def test_foreign_key_join_runs_no_python_by_row(spark, tmp_path, capsys):
    # The child moves with an order that it had before, and its old parent changes afterwards: neither may bring the old row back.
    child = stream(spark, tmp_path / "c", [(1, 5, "a", "x"), (1, 5, "b", "y"), (2, 5, "a", "z")], "cid int, t int, ref string, name string", 3)
    parent = stream(spark, tmp_path / "p", [("a", 1, 10), ("b", 1, 20), ("a", 2, 11)], "pid string, t int, v int", 3)
    joined = changing.foreign_key_join(child, parent, "cid", "ref", ["name"], "pid", ["v"], "t", "t")
    joined.explain()
    plan = capsys.readouterr().out
    assert "StreamingSymmetricHashJoin" in plan and "TransformWithState" not in plan and "Python" not in plan
    assert rows_of(changing.current(replay.drain(joined), "cid"), "cid", "ref", "name", "v") == [(1, "b", "y", 20), (2, "a", "z", 11)]


MOVIES = [
    (123, "The Dark Knight", "Action", 100240), (456, "Avengers: Endgame", "Action", 200010), (789, "Inception", "Sci-Fi", 150000), (147, "Joker", "Drama", 120304),
    (258, "The Godfather", "Crime", 300202), (369, "Casablanca", "Romance", 400400), (321, "The Shawshank Redemption", "Drama", 500056), (654, "Forrest Gump", "Drama", 350345),
    (987, "Fight Club", "Drama", 250250), (135, "Pulp Fiction", "Crime", 160160), (246, "The Godfather: Part II", "Crime", 170170), (357, "The Departed", "Crime", 180180),
]


def test_top_n_golden(spark, tmp_path):
    rows = [(i, *m) for i, m in enumerate(MOVIES)]
    df = stream(spark, tmp_path, rows, "at int, id int, title string, genre string, views long", 3)
    out = replay.drain(changing.top_n(df, ["genre"], "title", "views", 3, "at"))
    changes = [(r.kind, r.title, r.rank) for r in out.filter("genre = 'Drama'").orderBy("_batch", "seq").collect()]
    assert changes == [
        ("+I", "Joker", 1), ("-U", "Joker", 1), ("+U", "The Shawshank Redemption", 1), ("+I", "Joker", 2), ("-U", "Joker", 2), ("+U", "Forrest Gump", 2),
        ("+I", "Joker", 3), ("-U", "Joker", 3), ("+U", "Fight Club", 3),
    ]
    crime = [(r.kind, r.title, r.rank) for r in out.filter("genre = 'Crime'").orderBy("_batch", "seq").collect()]
    assert crime == [
        ("+I", "The Godfather", 1), ("+I", "Pulp Fiction", 2), ("-U", "Pulp Fiction", 2), ("+U", "The Godfather: Part II", 2), ("+I", "Pulp Fiction", 3),
        ("-U", "The Godfather: Part II", 2), ("+U", "The Departed", 2), ("-U", "Pulp Fiction", 3), ("+U", "The Godfather: Part II", 3),
    ]


def test_top_n_with_falls_and_deletes(spark, tmp_path):
    rng = random.Random(9)
    rows = [(t, rng.choice("ab"), rng.randrange(12), rng.choice([None, *range(20)]), rng.random() < 0.15) for t in range(300)]
    df = stream(spark, tmp_path, rows, "t int, g string, m int, s int, gone boolean", 5)
    changes = replay.drain(changing.top_n(df, ["g"], "m", "s", 3, "t", F.col("gone")))
    got = sorted(map(tuple, changing.replayed(changes, ["g"]).select("g", "m", "s", "rank").collect()))
    want = []
    for g in "ab":
        last = {m: (s, gone) for _, g_, m, s, gone in rows if g_ == g}
        order = sorted((m for m in last if not last[m][1]), key=lambda m: (last[m][0] is None, -(last[m][0] or 0), m))
        want += [(g, m, last[m][0], k + 1) for k, m in enumerate(order[:3])]
    assert got == sorted(want)
    # A replay of every row of the log, not only its last ones, gives the same.
    held = {}
    for r in changes.orderBy("g", "seq").collect():
        if r.kind in ("-U", "-D"):
            assert held.pop((r.g, r["rank"])) == (r.m, r.s)
        else:
            held[r.g, r["rank"]] = (r.m, r.s)
    assert sorted((g, *v, k) for (g, k), v in held.items()) == got


def test_reorder_and_scan_keep_types(spark, tmp_path):
    base = at("2024-01-01 00:00:00")
    rows = [(1, base + dt.timedelta(seconds=s), base + dt.timedelta(days=s), dt.date(2024, 1, 1 + s) if s else None, decimal.Decimal("1.50"), bytearray(b"x")) for s in (2, 0, 1, 9)]
    schema = "k long, ts timestamp, other timestamp, day date, d decimal(5,2), b binary"
    df = stream(spark, tmp_path, rows, schema, 2)
    out = replay.drain(stateful.reorder(replay.event_time(df, "ts", "5 seconds"), "k", "ts", 1000))
    assert [tuple(r)[:6] for r in out.orderBy("ts").collect()] == sorted(rows)[:3]
    step = stateful.lag_step("k", "ts", "other")
    out = replay.drain(stateful.scan(stream(spark, tmp_path / "2", rows, schema, 4), "k", ["ts"], {}, step, "k long, ts timestamp, other timestamp, previous timestamp"))
    assert [r.previous for r in out.orderBy("_batch").collect()] == [None, *[r[2] for r in rows[:-1]]]


def test_sliding_average_golden(spark, tmp_path):
    rows = [("device-1", 1000, v, i) for i, v in enumerate((80.0, 90.0, 95.0, 100.0))]
    out = replay.drain(stateful.scan(stream(spark, tmp_path, rows, "k string, t long, v double, i int", 4), "k", ["t", "i"], {}, stateful.sliding_step("k", "t", "v", 500), "k string, t long, average double"))
    assert [r.average for r in out.orderBy("_batch").collect()] == [80.0, 85.0, 88.33, 91.25]


def test_cumulating_golden_on_stream(spark, tmp_path):
    orders = [(2, 6.98, "02:02:30"), (2, 9.99, "02:08:00"), (1, 9.99, "02:19:30"), (1, 8.10, "02:22:30"), (3, 6.19, "02:23:20"), (3, 6.98, "02:25:30"), (2, 6.98, "02:25:49"), (4, 8.00, "02:34:30")]
    rows = [(q, p, at(f"2023-01-15 {t}")) for q, p, t in orders]
    df, end = replay.ended(stream(spark, tmp_path, rows, "q int, p double, ts timestamp", 4), "ts", "2023-01-16 00:00:00")
    out = replay.drain(windows.cumulating_sum(replay.event_time(df, "ts"), "ts", 300, 600, F.col("q") * F.col("p"), "revenue", digits=2), end=end)
    got = [(r.revenue, f"{r.window_start:%H:%M}", f"{r.window_end:%H:%M}") for r in out.filter("revenue is not null").orderBy("window_start", "window_end").collect()]
    assert got == [(13.96, "02:00", "02:05"), (33.94, "02:00", "02:10"), (9.99, "02:10", "02:20"), (26.67, "02:20", "02:25"), (61.57, "02:20", "02:30"), (32.0, "02:30", "02:35"), (32.0, "02:30", "02:40")]


def test_upsert_sink(spark, tmp_path):
    rng = random.Random(10)
    rows = [(rng.choice([None, *range(20)]), t, rng.randrange(100), rng.random() < 0.2) for t in range(200)]
    rng.shuffle(rows)  # also older rows after newer ones
    path = str(tmp_path / "table")
    write = sinks.upsert_sink(path, ["k"], "t", 6, F.col("dead"))
    schema = "k int, t int, v int, dead boolean"
    parts = [spark.createDataFrame(rows[i : i + 50], schema) for i in range(0, 200, 50)]
    for n, part in enumerate(parts):
        write(part, n)
        write(part, n)
    write(parts[1], 1)
    last = {}
    for r in sorted(rows, key=lambda r: r[1]):
        last[r[0]] = r
    want = sorted((r for r in last.values() if not r[3]), key=str)
    assert sorted(map(tuple, sinks.upserted(spark, path).select("k", "t", "v", "dead").collect()), key=str) == want
    # Only the bucket that a batch touches is written again.
    times = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "table").rglob("*.parquet"))}
    write(spark.createDataFrame([(3, 1000, 7, False)], schema), 9)
    after = {p: os.stat(p).st_mtime_ns for p in map(str, (tmp_path / "table").rglob("*.parquet"))}
    assert len({p.rsplit("/", 2)[1] for p in set(times) ^ set(after)}) == 1
    df = stream(spark, tmp_path / "in", [(k, 2000 + k, k, False) for k in range(5)], schema, 2)
    df.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r.k: r.v for r in sinks.upserted(spark, path).collect()}.items() >= {k: k for k in range(5)}.items()
    write(spark.createDataFrame([], schema), 10)


def test_progress_and_state_and_an_edited_query(spark, tmp_path):
    rows = [(k % 3, k, at("2024-01-01 00:00:00") + dt.timedelta(minutes=k)) for k in range(60)]
    schema = "k int, v int, ts timestamp"
    progress = replay.Progress()
    spark.streams.addListener(progress)
    folder, source = replay.shared_folder(spark), tmp_path / "in"
    count = lambda df: df.groupBy("k").agg(F.count("*").alias("n"))
    replay.drain(count(stream(spark, source, rows[:30], schema, 2)), "update", "the_count", folder)
    assert {tuple(r) for r in replay.state_table(spark, folder).select("key.k", "value.count").collect()} == {(0, 10), (1, 10), (2, 10)}
    # More input, and a filter that was not there before: the kept counts go on.
    spark.createDataFrame(rows[30:], schema).coalesce(1).write.parquet(f"{source}/99999")
    df = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
    out = replay.drain(count(df.filter("k <> 2")), "update", "the_count", folder)
    assert {(r.k, r.n) for r in out.collect()} == {(0, 20), (1, 20)}
    assert {tuple(r) for r in replay.state_table(spark, folder).select("key.k", "value.count").collect()} == {(0, 20), (1, 20), (2, 10)}
    deadline = time.monotonic() + 20
    while sum(r[3] for r in progress.rows if r[0] == "the_count") < 60 and time.monotonic() < deadline:
        time.sleep(0.2)
    spark.streams.removeListener(progress)
    seen = progress.table(spark).filter("name = 'the_count'")
    assert seen.agg(F.sum("input_rows"), F.max("state_rows")).first()[0:2] == (60, 3)


def test_own_count_over_batches(spark, tmp_path):
    rng = random.Random(14)
    rows = [(rng.choice("ab"), i, i * 10 + rng.randrange(5)) for i in range(80)]
    step = stateful.own_count_step("k", "t", "i", 60)
    out = replay.drain(stateful.scan(stream(spark, tmp_path, rows, "k string, i int, t long", 5), "k", ["t"], {}, step, "k string, i int, count long"))
    want = joins.with_own_count(spark.createDataFrame(rows, "k string, i int, t long"), "k", ["t"], "t", 60)
    assert rows_of(out, "k", "i", "count") == rows_of(want, "k", "i", "count")
