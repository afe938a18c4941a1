"""Goldens of windows, temporal joins of several tables, and distances."""

import datetime as dt

from pyspark.sql import functions as F

from tests.test_streaming import at, stream
from tidewheel.functions import scalars
from tidewheel.operators import windows
from tidewheel.streaming import changing, replay


def clock(t):
    return f"{t:%H:%M}"


def test_hopping_golden_batch_and_stream(spark, tmp_path):
    rows = [(0, float(v), at(f"2023-01-15 {t}:30")) for v, t in zip((55, 50, 45, 40, 45, 50, 55, 60), ("02:15", "02:20", "02:25", "02:30", "02:35", "02:40", "02:45", "02:50"), strict=True)]
    want = [(55.0, "02:10"), (52.5, "02:15"), (47.5, "02:20"), (42.5, "02:25"), (42.5, "02:30"), (47.5, "02:35"), (52.5, "02:40"), (57.5, "02:45"), (60.0, "02:50")]
    hop = lambda df: windows.hopping(df, "ts", "10 minutes", "5 minutes", ["id"], average=F.avg("v"))
    schema = "id int, v double, ts timestamp"
    got = [(r.average, clock(r.window_start)) for r in hop(spark.createDataFrame(rows, schema)).orderBy("window_start").collect()]
    assert got == want
    df, end = replay.ended(stream(spark, tmp_path, rows, schema, 4), "ts", "2023-01-16 00:00:00")
    out = replay.drain(hop(replay.event_time(df, "ts")), end=end).filter("id = 0").orderBy("window_start")
    assert [(r.average, clock(r.window_start)) for r in out.collect()] == want


def test_windowed_top_golden(spark):
    views = [
        ("Action", "19:04"), ("Action", "22:01"), ("Sci-Fi", "20:24"), ("Drama", "22:56"), ("Crime", "19:13"), ("Romance", "20:26"), ("Drama", "20:20"), ("Drama", "21:54"), ("Crime", "22:09"),
        ("Crime", "19:28"), ("Animation", "23:12"), ("Animation", "22:17"), ("Animation", "22:28"), ("Sci-Fi", "20:42"), ("Sci-Fi", "19:25"), ("Sci-Fi", "20:14"), ("Romance", "20:25"),
    ]
    df = spark.createDataFrame([(g, at(f"2024-04-23 {t}:00")) for g, t in views], "genre string, ts timestamp_ntz")
    got = windows.windowed_top(df, "ts", "1 hour", "genre", 1).orderBy("window_start").collect()
    assert [(clock(r.window_start), r.genre, r.n, r["rank"]) for r in got] == [("19:00", "Crime", 2, 1), ("20:00", "Sci-Fi", 3, 1), ("21:00", "Drama", 1, 1), ("22:00", "Animation", 2, 1), ("23:00", "Animation", 1, 1)]


def test_temporal_multi_join_golden(spark, tmp_path):
    """Orders with the customer and the product as they were then: two joins as of a time, one after the other's output."""
    t = lambda s: at("2024-01-01 00:00:00") + dt.timedelta(seconds=s)
    customers = [(1288, "Phyllis Ackerman", t(0)), (1827, "Janis Smithson", t(0)), (1270, "William Schnaube", t(0)), (1372, "Jane Roberts", t(50))]
    products = [(9182, "GripMax Tennis Shoes", t(1)), (9811, "Air Elite Sneakers", t(1)), (9811, "Air Elite Basketball Sneakers", t(50))]
    orders = [(1, 1288, 9182, t(10)), (2, 1827, 9811, t(11)), (3, 1270, 9182, t(12)), (4, 1372, 9811, t(60))]
    left = stream(spark, tmp_path / "o", orders, "order_id int, customer_id int, product_id int, ts timestamp", 2)
    first, end = replay.ended(stream(spark, tmp_path / "c", customers, "customer_id int, name string, at timestamp", 2), "at", "2025-01-01 00:00:00")
    named = replay.drain(changing.as_of(left, first, ["customer_id"], "ts", "at", ["name"]), end=end)
    named.drop("_batch").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "named"))
    again = spark.readStream.schema(spark.read.parquet(str(tmp_path / "named")).schema).parquet(str(tmp_path / "named"))
    second, end = replay.ended(stream(spark, tmp_path / "p", products, "product_id int, product string, at timestamp", 2), "at", "2025-01-01 00:00:00")
    got = replay.drain(changing.as_of(again, second, ["product_id"], "ts", "at", ["product"]), end=end)
    assert sorted((r.order_id, r.name, r.product) for r in got.collect()) == [
        (1, "Phyllis Ackerman", "GripMax Tennis Shoes"), (2, "Janis Smithson", "Air Elite Sneakers"), (3, "William Schnaube", "GripMax Tennis Shoes"), (4, "Jane Roberts", "Air Elite Basketball Sneakers"),
    ]


def test_geo_distance_golden(spark):
    rows = [("Lindsey", -33.85995, 151.25664), ("Debbie", -33.89640, 151.24504)]
    df = spark.createDataFrame(rows, "name string, lat double, lon double")
    got = {r.name: r.miles for r in df.select("name", scalars.geo_distance(F.col("lat"), F.col("lon"), F.lit(-33.863), F.lit(151.1169), "miles").alias("miles")).collect()}
    assert abs(got["Lindsey"] - 8.020734621148486) < 1e-9 and abs(got["Debbie"] - 7.704588172240076) < 1e-9
