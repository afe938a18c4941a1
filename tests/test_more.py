import uuid

from pyspark.sql import functions as F

from tidewheel.operators import joins, relational
from tidewheel.sources import readers, sinks
from tidewheel.streaming import replay


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_mixed_event_types(spark):
    df = spark.createDataFrame([("purchase", ("pen", 1.5), None), ("pageview", None, ("/a", True))], "kind string, purchase struct<item:string,amount:double>, pageview struct<url:string,special:boolean>")
    parts = readers.variants(df, "kind", {"purchase": ["purchase.item", "purchase.amount"], "pageview": ["pageview.url"]})
    assert rows_of(parts["purchase"], "item", "amount") == [("pen", 1.5)] and rows_of(parts["pageview"], "url") == [("/a",)]


def test_keys_and_fields(spark):
    df = spark.createDataFrame([((1,), (1, "x"))], "k struct<id:int>, v struct<id:int,name:string>")
    assert rows_of(readers.with_key_fields(df, "k", "v", ["id"], False), "id", "name") == [(1, "x")]
    assert rows_of(readers.with_key_fields(df, "k", "v", ["id"], True), "id", "name") == [(1, "x")]
    assert rows_of(readers.key_from_column(spark.createDataFrame([(7, "a")], "id int, n string"), "id"), "key", "value.n") == [(7, "a")]
    nested = spark.createDataFrame([(1, (("c",),))], "id int, a struct<b:struct<city:string>>")
    assert relational.flatten(nested).columns == ["id", "a_b_city"]


def test_continuous_table_goes_on_from_its_checkpoint(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex[:8]}"
    schema = "id long"
    read = lambda: readers.stream_files(spark, f"{tmp_path}/in", schema)
    try:
        for k in range(2):
            spark.createDataFrame([(k,)], schema).write.mode("append").parquet(f"{tmp_path}/in")
            sinks.continuous_table(read().withColumn("twice", F.col("id") * 2), name, f"{tmp_path}/c").awaitTermination()
        assert rows_of(spark.table(name), "id", "twice") == [(0, 0), (1, 2)]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_new_checkpoint_starts_over(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(f"{tmp_path}/in")
    read = lambda: readers.stream_files(spark, f"{tmp_path}/in", "id long")
    assert replay.drain(read(), checkpoint=f"{tmp_path}/c", name="named").count() == 2
    assert replay.drain(read(), checkpoint=f"{tmp_path}/c").count() == 0
    assert replay.drain(read(), checkpoint=f"{tmp_path}/other").count() == 2


def test_ordered_parallel_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(k, o) for o in range(20) for k in range(3)], "k int, o int").repartition(5)
    out = sinks.ordered_parallel(df, "k", "o", 2, lambda pdf: pdf.assign(ok=pdf.groupby("k")["o"].diff().fillna(1) > 0), "k int, o int, ok boolean")
    assert out.count() == 60 and out.filter("not ok").count() == 0
    sinks.repartitioned_copy(df, "k", 2, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 60


def test_small_is_checked(spark):
    assert joins.small(spark.range(10), 5)._jdf.queryExecution().logical().toString().count("ResolvedHint") == 0
    assert "hint" in joins.small(spark.range(5), 5)._jdf.queryExecution().logical().toString().lower()


def test_lateral_and_rows_that_drop(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "id int, t string")
    out = joins.lateral(df, lambda pdf: pdf.assign(w=pdf["t"].str.split()).explode("w").dropna()[["id", "w"]], "id int, w string")
    assert rows_of(out, "id", "w") == [(1, "a"), (1, "b")]
    assert relational.transform_rows(df, lambda pdf: pdf[pdf["t"] != ""], df.schema).count() == 1
    assert rows_of(relational.custom_aggregate(spark.createDataFrame([(1, 2.0), (1, 4.0)], "k int, v double"), "k", "v", lambda v: float(v.max() - v.min()), "double", "spread"), "spread") == [(2.0,)]
