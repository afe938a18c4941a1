"""Queries over the driver's tables, one for each operator or variant, with the SQL they are checked against.

A query is registered with its SQL by ``@query(sql)``; those that SQL cannot express have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import analytic as A
from ..operators import automata
from ..operators import joins as J
from ..operators import patterns as P
from ..operators import relational as R
from ..operators import timeseries as M
from ..operators import vectors as V
from ..operators import windows as W
from ..sources import readers, sinks
from ..streaming import changing, replay, stateful

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

Tables = Callable[[str], DataFrame]


def query(sql: str | None = None):
    def wrap(f: Callable[[Tables], DataFrame]):
        _queries[f.__name__] = lambda spark, sf_dir: f(lambda name: readers.tables(spark, sf_dir, name))
        if sql:
            _sql[f.__name__] = sql
        return f

    return wrap


def streamed(t: Tables, name: str = "events") -> DataFrame:
    """The same table as a stream of files."""
    spark = t(name).sparkSession
    path = t(name).inputFiles()[0]
    folder = path.rsplit("/", 1)[0]
    schema = t(name).schema
    if folder.endswith(".parquet"):
        return readers.stream_files(spark, folder, schema, 2)
    return readers.stream_files(spark, f"{folder}/{name}.parque[t]", schema, 2)


# --- projection, filters, branches ------------------------------------------------------------------------------


@query("SELECT * FROM events WHERE event_type = 'purchase'")
def filter_eq(t):
    return R.where_equal(t("events"), "event_type", "purchase")


@query("SELECT event_id, user_id, value FROM events WHERE value >= 50")
def filter_range(t):
    return R.where_at_least(t("events"), "value", 50, ["event_id", "user_id", "value"])


@query("SELECT l_orderkey, l_linenumber, l_extendedprice - l_quantity AS gap FROM lineitem")
def column_difference(t):
    return R.difference(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity", "gap").select("l_orderkey", "l_linenumber", "gap")


@query("SELECT o_orderkey, 'order ' || o_orderkey::VARCHAR || ' of ' || o_custkey::VARCHAR || ' is ' || o_orderstatus AS summary FROM orders")
def concat_summary(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.concatenated(o, "summary", F.lit("order "), F.col("o_orderkey"), F.lit(" of "), F.col("o_custkey"), F.lit(" is "), F.col("o_orderstatus")).select("o_orderkey", "summary")


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'sales' WHEN value > 100 THEN 'large' ELSE 'other' END AS branch FROM events")
def branch_split(t):
    return R.branch(t("events"), [("sales", F.col("event_type") == "purchase"), ("large", F.col("value") > 100)], "other").select("event_id", "branch")


@query("SELECT 'not_click' AS rule, count(*)::BIGINT AS n FROM events WHERE event_type <> 'click' UNION ALL SELECT 'not_view', count(*)::BIGINT FROM events WHERE event_type <> 'view'")
def branch_independent(t):
    parts = R.split_by(t("events"), {"not_click": F.col("event_type") != "click", "not_view": F.col("event_type") != "view"})
    return R.union_all(*[R.tagged(R.count_all(f), "rule", n) for n, f in parts.items()]).select("rule", "n")


@query("SELECT o_orderkey, dayname(o_orderdate) AS day FROM orders")
def case_dow(t):
    return t("orders").select("o_orderkey", S.day_name(F.to_date("o_orderdate")).alias("day"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS kind, try_cast(split_part(c_name, '#', 2) AS INTEGER) AS number FROM customer")
def transform_split(t):
    return R.split_title(t("customer").select("c_custkey", "c_name"), "c_name", "kind", "number", "#").select("c_custkey", "kind", "number")


@query("SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(c_name, '[^a-zA-Z0-9]', '-', 'g'), '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g') AS c_name FROM customer")
def mask_pii(t):
    return R.mask(t("customer").select("c_custkey", "c_name"), "c_name")


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events")
def json_extract(t):
    return t("events").select("event_id", S.json_field(F.col("props"), "$.k", "int").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS missing FROM events")
def map_access(t):
    m = F.from_json("props", "map<string,string>")
    return t("events").select("event_id", S.map_value(m, "k").alias("k"), S.map_value(m, "none").alias("missing"))


@query("SELECT event_id, event_type AS a, user_id::VARCHAR AS b FROM events")
def str_to_map(t):
    m = S.text_to_map(F.concat(F.lit("type="), "event_type", F.lit(",user="), F.col("user_id").cast("string")))
    return t("events").select("event_id", S.map_value(m, "type").alias("a"), S.map_value(m, "user").alias("b"))


@query("SELECT o_orderkey AS id, o_custkey AS who_key, o_orderstatus AS who_state_status, o_totalprice AS total FROM orders")
def flatten_struct(t):
    nested = t("orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status")).alias("state")).alias("who"), F.col("o_totalprice").alias("total"))
    return R.flatten(nested)


@query("SELECT c_custkey, upper(c_mktsegment) AS segment FROM customer")
def uppercase(t):
    return t("customer").select("c_custkey", F.upper("c_mktsegment").alias("segment"))


# --- aggregates and set operations ----------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def count_by_key(t):
    return R.count_by(t("events"), "event_type")


@query("SELECT user_id, count(CASE WHEN value > 10 THEN value END) AS n FROM events GROUP BY ALL")
def count_col(t):
    return R.count_by(t("events").withColumn("big", F.when(F.col("value") > 10, F.col("value"))), "user_id", column="big")


@query("SELECT count(*) AS n FROM lineitem")
def count_all(t):
    return R.count_all(t("lineitem"))


@query("SELECT l_suppkey, sum(l_linenumber)::BIGINT AS total FROM lineitem GROUP BY ALL")
def sum_by_key(t):
    return R.sum_by(t("lineitem"), "l_suppkey", "l_linenumber", "total")


@query("SELECT year(o_orderdate) AS y, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL")
def minmax_by_year(t):
    return R.min_max_by(t("orders").select(F.year("o_orderdate").cast("long").alias("y"), "o_totalprice"), "y", "o_totalprice", "low", "high")


@query("SELECT user_id, count(value) AS count, round(sum(value), 2) AS sum, round(avg(value), 4) AS average FROM events GROUP BY ALL")
def running_average(t):
    return R.running_average(t("events"), "user_id", "value").withColumns({"sum": F.round("sum", 2), "average": F.round("average", 4)})


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def group_by_expr(t):
    return R.count_by(t("events").select(S.json_field(F.col("props"), "$.k").alias("k")), "k")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 12")
def having_count(t):
    return R.having(t("orders"), ["o_custkey"], 12)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY ALL")
def latest_per_key(t):
    return R.latest(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_per_key(t):
    return A.first_per_key(t("events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])


@query("SELECT user_id, arg_min(ts, event_id) AS first_ts FROM events GROUP BY ALL")
def earliest_by_offset(t):
    return R.earliest_value(t("events"), "user_id", "ts", ["event_id"], "first_ts")


@query("SELECT event_type AS app, user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY ALL")
def cogroup_rollup(t):
    parts = R.split_by(t("events").select(F.col("event_type").alias("app"), "user_id"), {k: F.col("app") == k for k in ("click", "view", "purchase")})
    return R.cogrouped_rollup(list(parts.values()), "app", "user_id")


@query("SELECT l_suppkey, (sum(l_linenumber) // count(l_linenumber))::BIGINT AS average FROM lineitem GROUP BY ALL")
def integer_avg(t):
    return R.integer_average(t("lineitem"), "l_suppkey", "l_linenumber", "average")


@query("""WITH e AS (SELECT *, event_type = 'error' AS gone FROM events),
r AS (SELECT *, sum(gone::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e),
l AS (SELECT *, max(run) OVER (PARTITION BY user_id) AS last FROM r)
SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM l WHERE run = last AND NOT gone GROUP BY ALL""")
def collect_since_delete(t):
    return R.totals_since_delete(t("events"), "user_id", "event_id", "event_id", F.col("event_type") == "error", "n", "ids")


@query("SELECT event_id, 'click' AS kind FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'view' FROM events WHERE event_type = 'view'")
def union_all(t):
    return R.union_all(*[R.tagged(R.where_equal(t("events"), "event_type", k).select("event_id"), "kind", k) for k in ("click", "view")])


@query("SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'view'")
def union_distinct(t):
    return R.union_distinct(*[R.where_equal(t("events"), "event_type", k).select("user_id") for k in ("click", "view")])


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id")
def order_by_ts(t):
    return t("events").select("event_id", "ts").orderBy("ts", "event_id")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t):
    return R.top(t("orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.col("o_orderkey"))


# --- time windows ---------------------------------------------------------------------------------------------------

_TUMBLE = "SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS window_start, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS AS window_end, count(*) AS n, sum(round(value * 100)::BIGINT)::DOUBLE / count(*) AS average FROM events GROUP BY ALL"


def _tumble(events: DataFrame) -> DataFrame:
    return W.tumbling(events, "ts", "6 hours", ["event_type"], n=F.count("*"), average=F.sum(F.round(F.col("value") * 100).cast("long")) / F.count("*"))


@query(_TUMBLE)
def tumble_6h(t):
    return _tumble(t("events"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM events GROUP BY ALL")
def tumble_global(t):
    return W.tumbling(t("events"), "ts", "1 hour", n=F.count("*"))


@query("""WITH h AS (SELECT event_type, value, time_bucket(INTERVAL 5 MINUTES, ts) - d * INTERVAL 5 MINUTES AS window_start FROM events, (SELECT unnest([0, 1]) AS d))
SELECT event_type, window_start, window_start + INTERVAL 10 MINUTES AS window_end, round(avg(value), 6) AS average FROM h GROUP BY ALL""")
def hop_10m_5m(t):
    return W.hopping(t("events"), "ts", "10 minutes", "5 minutes", ["event_type"], average=F.round(F.avg("value"), 6))


@query("""WITH b AS (SELECT value, time_bucket(INTERVAL 60 MINUTES, ts) AS base, (epoch(ts)::BIGINT // 900 - epoch(time_bucket(INTERVAL 60 MINUTES, ts))::BIGINT // 900) + 1 AS k FROM (SELECT value, date_trunc('second', ts) AS ts FROM events)),
c AS (SELECT base, unnest(range(k, 5)) AS k, value FROM b)
SELECT base AS window_start, base + k * INTERVAL 15 MINUTES AS window_end, round(sum(value), 2) AS total FROM c GROUP BY base, k""")
def cumulate(t):
    return W.cumulating_sum(t("events"), "ts", 900, 3600, F.col("value"), "total", digits=2)


_SESSIONS = """WITH m AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
"""


@query(_SESSIONS + "SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 2 HOURS AS window_end, count(*) AS n FROM s GROUP BY user_id, k")
def session_gap(t):
    return W.session(t("events"), "ts", "2 hours", ["user_id"], n=F.count("*"))


@query(_SESSIONS + "SELECT user_id, min(ts) AS window_start, max(ts) AS window_end, count(*) AS n, (epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000)::BIGINT AS length_ms FROM s GROUP BY user_id, k")
def session_last(t):
    return W.session(t("events"), "ts", "2 hours", ["user_id"], end="last", n=F.count("*"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW), 6) AS average FROM events")
def sliding_range(t):
    return W.trailing_average(t("events"), "ts", "event_type", "value", 3_600_000, "average", 6).select("event_id", "average")


@query("""WITH e AS (SELECT event_type, (epoch_us(ts) // 1000) AS t, value FROM events),
s AS (SELECT DISTINCT event_type, unnest([t - 600000, t + 1]) AS ws FROM e)
SELECT s.event_type, ws AS window_start, ws + 600000 AS window_end, count(*) AS n, round(avg(value), 6) AS average FROM s JOIN e ON s.event_type = e.event_type AND t BETWEEN ws AND ws + 600000 GROUP BY ALL""")
def sliding_windows(t):
    e = t("events").select("event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "value")
    return W.sliding(e, "t", "event_type", "value", 600_000, 6)


@query("SELECT user_id, strftime(time_bucket(INTERVAL 24 HOURS, ts), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(time_bucket(INTERVAL 24 HOURS, ts) + INTERVAL 24 HOURS, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n FROM events GROUP BY ALL")
def window_text(t):
    return W.bounds_as_text(W.tumbling(t("events"), "ts", "24 hours", ["user_id"], n=F.count("*")))


# --- ranking, lag, frames, patterns -----------------------------------------------------------------------------------


@query("SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def top_n_per_group(t):
    return A.top_n(t("part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3)


@query("""WITH c AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, event_type) AS rank FROM c)
SELECT event_type, window_start, window_start + INTERVAL 6 HOURS AS window_end, n, rank FROM r WHERE rank <= 2""")
def windowed_top_n(t):
    return W.windowed_top(t("events"), "ts", "6 hours", "event_type", 2)


_DEDUP = """SELECT user_id, event_type, event_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1"""


def _dedup(events: DataFrame) -> DataFrame:
    return W.first_in_window(events.select("user_id", "event_type", "ts", "event_id"), "ts", "1 hour", ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "window_start")


@query(_DEDUP)
def dedup_windowed(t):
    return _dedup(t("events"))


_LAG = "SELECT user_id, event_id, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE value > previous"


@query(_LAG)
def lag_rising(t):
    return A.rising(t("events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "value", "previous")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def over_range_1h(t):
    return A.count_over_range(t("events"), "event_type", "ts", 3_600_000_000).select("event_id", "n")


@query("SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS average FROM events")
def over_rows_5(t):
    return A.average_over_rows(t("events"), ["ts", "event_id"], "value", 5, "average", 6).select("event_id", "average")


@query("SELECT event_id, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS median FROM events")
def trailing_median(t):
    return A.trailing_median(t("events"), "user_id", ["ts", "event_id"], "value", 3).select("event_id", "median")


@query("""WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT user_id, event_id, n, CASE WHEN n = 1 THEN '+I' ELSE '+U' END AS kind FROM c UNION ALL SELECT user_id, event_id, n - 1, '-U' FROM c WHERE n > 1""")
def changelog_count(t):
    return A.changelog(t("events"), "user_id", ["event_id"])


@query("""WITH RECURSIVE p AS (SELECT user_id, event_id, row_number() OVER w AS i, value > 20 AND lead(value) OVER w < 20 AND lead(value, 2) OVER w > 20 AS ok, lead(event_id, 2) OVER w AS third
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT user_id, event_id, third, i FROM p WHERE ok),
m AS (SELECT user_id, min(i) AS i FROM c GROUP BY user_id UNION ALL SELECT m.user_id, (SELECT min(c.i) FROM c WHERE c.user_id = m.user_id AND c.i >= m.i + 3) FROM m WHERE m.i IS NOT NULL)
SELECT user_id, event_id, third FROM c JOIN m USING (user_id, i)""")
def pattern_abc(t):
    v = F.col("value")
    out = automata.matches(t("events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], [(v > 20, 1, 1), (v < 20, 1, 1), (v > 20, 1, 1)])
    return out.select("user_id", F.col("first_event_id").alias("event_id"), F.col("last_event_id").alias("third"))


@query("""WITH o AS (SELECT event_id, ts, event_type, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT *, max(CASE WHEN event_type <> 'click' THEN i END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)
SELECT v.event_id AS first_id, p.event_id AS last_id FROM p JOIN o v ON v.i = p.before WHERE p.event_type = 'purchase' AND v.event_type = 'view' AND p.i - p.before >= 2""")
def pattern_quantified(t):
    kind = F.col("event_type")
    pattern = [(kind == "view", 1, 1), (kind == "click", 1, None), (kind == "purchase", 1, 1)]
    out = automata.matches(t("events").select("ts", "event_id", "event_type"), [], ["ts", "event_id"], pattern)
    return out.select(F.col("first_event_id").alias("first_id"), F.col("last_event_id").alias("last_id"))


def _up_sql(op: str) -> str:
    return f"""SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM (
SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // 3 AS chunk FROM (
SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
SELECT *, CASE WHEN value {op} lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events)))
GROUP BY user_id, run, chunk HAVING count(*) = 3"""


@query(_up_sql(">"))
def pattern_up3(t):
    return P.rising_runs(t("events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 3).select("user_id", F.col("first_event_id").alias("first_id"), F.col("last_event_id").alias("last_id"))


@query(f"{_up_sql('>')} UNION {_up_sql('<')}")
def pattern_up_or_down_union(t):
    return P.rising_or_falling(t("events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 3).select("user_id", F.col("first_event_id").alias("first_id"), F.col("last_event_id").alias("last_id"))


@query("""WITH RECURSIVE p AS (SELECT user_id, event_id, ts, value, row_number() OVER w AS i, lead(value) OVER w AS b, lead(value, 2) OVER w AS c, lead(value, 3) OVER w AS d,
lead(event_id, 3) OVER w AS last_event_id, lead(ts, 3) OVER w AS last_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT * FROM p WHERE (value < b AND b < c AND c < d) OR (value > b AND b > c AND c > d)),
m AS (SELECT user_id, min(i) AS i FROM c GROUP BY user_id UNION ALL SELECT m.user_id, (SELECT min(c.i) FROM c WHERE c.user_id = m.user_id AND c.i >= m.i + 4) FROM m WHERE m.i IS NOT NULL)
SELECT user_id, ts AS first_ts, event_id AS first_event_id, value AS first_value, last_ts, last_event_id, d AS last_value FROM c JOIN m USING (user_id, i)""")
def pattern_same_direction(t):
    return P.same_direction(t("events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 4)


# --- joins ---------------------------------------------------------------------------------------------------------


def _types(t, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    e = t("events")
    left = R.where_equal(e, "event_type", a).select(F.col("event_id").alias("left_id"), F.col("user_id").alias("left_user"), F.col("ts").alias("left_ts"))
    return left, R.where_equal(e, "event_type", b).select(F.col("event_id").alias("right_id"), "user_id", F.col("ts").alias("right_ts"))


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOURS WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def interval_join(t):
    return J.interval_join(*_types(t, "view", "purchase"), [("left_user", "user_id")], "left_ts", "right_ts", "0 seconds", "6 hours", bucket_seconds=21_600).select("left_id", "right_id")


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'click' AND b.event_type = 'error'")
def window_join_symmetric(t):
    return J.symmetric_join(*_types(t, "click", "error"), [("left_user", "user_id")], "left_ts", "right_ts", "1 hour", bucket_seconds=7_200).select("left_id", "right_id")


@query("SELECT a.o_orderkey, l.l_linenumber FROM orders a JOIN lineitem l ON a.o_orderkey = l.l_orderkey AND l.l_shipdate >= a.o_orderdate")
def theta_join(t):
    o, li = t("orders"), t("lineitem")
    return J.theta_join(o, li, ("o_orderkey", "l_orderkey"), li["l_shipdate"] >= o["o_orderdate"]).select("o_orderkey", "l_linenumber")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def star_broadcast(t):
    c = J.replicated_join(t("customer"), t("nation"), F.col("c_nationkey"), "n_nationkey")
    return J.replicated_join(c, t("region"), F.col("n_regionkey"), "r_regionkey").select("c_custkey", "n_name", "r_name")


@query("SELECT concat_ws('-', c_custkey, o_orderkey) AS id, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def fk_join(t):
    return J.foreign_key_join(t("orders"), t("customer"), "o_custkey", "c_custkey", "o_orderkey").select("id", "c_name")


@query("SELECT l_orderkey, l_linenumber, s_name, p_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey")
def multi_left_join(t):
    li = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    return J.left_joins(li, (t("supplier").select("s_suppkey", "s_name"), "s_suppkey"), (t("part").select("p_partkey", "p_name"), "p_partkey")).select("l_orderkey", "l_linenumber", "s_name", "p_name")


@query("""WITH l AS (SELECT user_id, arg_max(event_id, event_id) AS click FROM events WHERE event_type = 'click' GROUP BY ALL), r AS (SELECT user_id, arg_max(event_id, event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, click, purchase FROM l JOIN r USING (user_id)""")
def table_table_join(t):
    e = t("events").select("user_id", "event_id", "event_type")
    side = lambda k: R.latest(R.where_equal(e, "event_type", k), "user_id", ["event_id"]).select("user_id", F.col("event_id").alias(k))
    return J.table_join(side("click"), side("purchase"), ["user_id"])


@query("SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)")
def unnest_tokens(t):
    return J.unnest(t("documents").withColumn("words", F.split("text", " ")), "words", "word", ["doc_id"])


@query("SELECT user_id, time_bucket(INTERVAL 24 HOURS, ts) AS window_start, time_bucket(INTERVAL 24 HOURS, ts) + INTERVAL 24 HOURS AS window_end, count(*) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000) GROUP BY ALL HAVING count(*) > 3")
def watchlist_having(t):
    listed = t("customer").filter("c_acctbal < 1000").select("c_custkey")
    return J.watch_list(t("events"), listed, "user_id", "c_custkey", "ts", "24 hours", 3)


_ASOF = """SELECT p.event_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts"""


def _purchases(t) -> tuple[DataFrame, DataFrame]:
    e = t("events")
    versions = R.where_equal(e, "event_type", "signup").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("signup_id"))
    return R.where_equal(e, "event_type", "purchase").select("event_id", "user_id", "ts"), versions


@query(_ASOF)
def asof_join(t):
    return J.as_of(*_purchases(t), ["user_id"], "ts", "at", ["signup_id"]).select("event_id", "signup_id")


@query("""SELECT event_id, signup_id FROM (SELECT p.event_id, s.event_id AS signup_id, p.ts AS pts, s.ts AS sts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts) WHERE sts >= pts - INTERVAL 1 DAY""")
def asof_bounded(t):
    return J.as_of(*_purchases(t), ["user_id"], "ts", "at", ["signup_id"], retention="1 day", how="inner").select("event_id", "signup_id")


@query("""WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS count FROM events)
SELECT a.event_id, b.count FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 600000""")
def own_count_join(t):
    e = t("events").select("user_id", "event_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return J.with_own_count(e, "user_id", ["ts", "event_id"], "t", 600_000).select("event_id", "count")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank FROM q, embeddings e)
SELECT query_id, vec_id, rank FROM s WHERE rank <= 3""")
def knn_top3(t):
    e = t("embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return V.nearest(e, "vec_id", "embedding", q, "query_id", "vector", 3).select("query_id", "vec_id", "rank")


@query()
def knn_index(t):
    """By the index: what it misses is measured in tests, so there is no SQL."""
    e = t("embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return V.search(e, "vec_id", "embedding", q, "query_id", "vector", 3).select("query_id", "vec_id", "rank")


# --- scalars, models, sources, robustness ---------------------------------------------------------------------------------


@query("""SELECT s_suppkey, round(2 * 3959.0 * asin(sqrt(pow(sin(radians(n_nationkey * 3 - s_nationkey) / 2), 2)
+ cos(radians(s_nationkey)) * cos(radians(n_nationkey * 3)) * pow(sin(radians(n_regionkey * 10 - s_suppkey % 90) / 2), 2))), 6) AS miles FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def geo_distance(t):
    s = J.replicated_join(t("supplier"), t("nation"), F.col("s_nationkey"), "n_nationkey")
    d = S.geo_distance(F.col("s_nationkey"), F.col("s_suppkey") % 90, F.col("n_nationkey") * 3, F.col("n_regionkey") * 10, "miles")
    return s.select("s_suppkey", F.round(d, 6).alias("miles"))


@query("SELECT l_orderkey, l_linenumber, (l_extendedprice * l_quantity + l_tax * l_linenumber) / (l_quantity + l_linenumber) AS vwap FROM lineitem")
def vwap(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", S.vwap(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax"), F.col("l_linenumber")).alias("vwap"))


@query("SELECT p_partkey, CASE WHEN p_partkey > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 20000) d(d) WHERE d * d <= p_partkey AND p_partkey % d = 0) THEN 'primes' ELSE 'composites' END AS route FROM part")
def prime_router(t):
    return R.branch(t("part").select("p_partkey").withColumn("p", S.is_prime("p_partkey")), [("primes", F.col("p"))], "composites", "route").select("p_partkey", "route")


@query("""SELECT event_id, strftime(ts - INTERVAL 5 HOURS, '%Y-%m-%d %H:%M:%S') AS eastern, hour(ts) AS h, strftime(make_timestamp((event_id * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') AS as_time,
(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts)) // 3600)::BIGINT AS hours FROM events""")
def time_functions(t):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ts = F.col("ts")
    return t("events").select("event_id", F.date_format(S.convert_zone(ts, "UTC", "America/New_York"), "yyyy-MM-dd HH:mm:ss").alias("eastern"), F.hour(ts).cast("long").alias("h"), S.from_seconds(F.col("event_id")).alias("as_time"), S.hours_between(start, ts).alias("hours"))


_AR = """WITH x AS (SELECT event_id, user_id, ts, value AS y, lag(value) OVER w AS x, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
"""


@query(_AR + """f AS (SELECT event_id, y, k, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN k >= 16 THEN round(a + b * y, 4) END AS forecast FROM f""")
def forecast_ar1(t):
    return M.forecast(t("events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "forecast")


@query(_AR + """f AS (SELECT event_id, y, x, (regr_count(y, x) OVER w)::BIGINT AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a, regr_syy(y, x) OVER w AS syy, regr_sxy(y, x) OVER w AS sxy
FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, a + b * x AS f, 2.5758293035489004 * sqrt(greatest(syy - b * sxy, 0) / greatest(n - 2, 1)) AS s FROM f)
SELECT event_id, CASE WHEN n >= 16 THEN round(f, 4) END AS forecast, CASE WHEN n >= 16 THEN y < f - s OR y > f + s END AS is_anomaly FROM g""")
def anomaly_ar1(t):
    return M.anomalies(t("events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "forecast", "is_anomaly")


@query(_AR.replace("PARTITION BY user_id ", "") + """f AS (SELECT event_id, y, x, (regr_count(y, x) OVER w)::BIGINT AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a, regr_syy(y, x) OVER w AS syy, regr_sxy(y, x) OVER w AS sxy
FROM x WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, a + b * x AS f, 2.5758293035489004 * sqrt(greatest(syy - b * sxy, 0) / greatest(n - 2, 1)) AS s FROM f)
SELECT event_id, CASE WHEN n >= 16 THEN round(f, 4) END AS forecast, CASE WHEN n >= 16 THEN y < f - s OR y > f + s END AS is_anomaly FROM g""")
def anomaly_all(t):
    return M.growing_anomalies(t("events").select("event_id", "ts", "value"), [], ["ts", "event_id"], "value").select("event_id", "forecast", "is_anomaly")


@query(_AR.replace("PARTITION BY user_id ", "") + """f AS (SELECT event_id, y, k, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a FROM x WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN k > 16 THEN round(a + b * y, 4) END AS forecast FROM f""")
def forecast_all(t):
    return M.growing_forecast(t("events").select("event_id", "ts", "value"), [], ["ts", "event_id"], "value").select("event_id", "forecast")


@query("""WITH d AS (SELECT event_type, ts, event_id, value AS v, value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS y FROM events),
l AS (SELECT event_type, v, y, lag(y) OVER w AS x, row_number() OVER w AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM d WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
f AS (SELECT event_type, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l WHERE k > 2 GROUP BY event_type)
SELECT event_type, n, round(b, 3) AS slope, round(v + a + b * y, 3) AS next FROM f JOIN l USING (event_type) WHERE back = 1""")
def arima_110(t):
    out = M.arima(t("events").select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"], "value", lags=1, differences=1, digits=8)
    return out.select("event_type", "n", F.round(F.col("coefficients")[1], 3).alias("slope"), F.round(F.col("forecasts")[0], 3).alias("next"))


@query()
def embed_text(t):
    return V.embed(t("documents").select("doc_id", "text"), "text").select("doc_id", "vector")


@query("SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'json' WHEN value <= 1 THEN 'value' END AS error FROM events")
def dlq_split(t):
    bad = t("events").withColumn("props", F.when(F.col("event_id") % 10 == 3, F.lit("{broken")).otherwise(F.col("props")))
    good, dead = sinks.dead_letters(bad, {"json": F.get_json_object("props", "$.k").isNotNull(), "value": F.col("value") > 1})
    return good.select("event_id", F.lit(None).cast("string").alias("error")).unionByName(dead.select("event_id", "error"))


@query("SELECT event_id, value::DOUBLE AS value, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'N/A' END AS factory FROM events")
def evolve_union(t):
    e = t("events")
    v1, v2 = e.filter("event_id % 2 = 1").select("event_id", "value"), e.filter("event_id % 2 = 0").select("event_id", "value", F.col("event_type").alias("factory"))
    return readers.evolved_union([v1, v2], {"value": "double"}, {"factory": "N/A"})


@query("SELECT event_id, (event_id % 7)::INTEGER AS schema_id, event_type AS body FROM events")
def wire_format(t):
    framed = t("events").select("event_id", readers.frame(F.col("event_id") % 7, F.col("event_type").cast("binary")).alias("value"))
    return readers.wire_format(framed, "value").select("event_id", "schema_id", F.col("body").cast("string").alias("body"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS key FROM part")
def rekey(t):
    return sinks.rekeyed(t("part").select("p_partkey", "p_name"), S.part(F.col("p_name"), " ", 1)).select("p_partkey", "key")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%-URG%' OR o_orderpriority LIKE '%-HIG%' THEN 'special' ELSE 'regular' END AS route FROM orders")
def route(t):
    return sinks.routed(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-", ["URG", "HIG"], "special", "regular").select("o_orderkey", "route")


@query("""WITH s AS (SELECT date_trunc('second', ts) AS second, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY 1),
r AS (SELECT last, sum(n) OVER (ORDER BY second RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)::BIGINT AS failures FROM s) SELECT * FROM r WHERE failures >= 3""")
def failure_budget(t):
    return sinks.failure_budget(t("events"), "ts", F.col("event_type") == "error", 3, "1 hour")


@query("SELECT event_id, user_id, value FROM events WHERE user_id % 4 = 1 AND event_id >= 100")
def read_from_offset(t):
    e = t("events").select("event_id", "user_id", "value", (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"))
    return readers.from_offset(e, 1, 100).drop("partition", "offset")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100")
def incremental_read(t):
    return readers.after(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100)


@query("""SELECT user_id, event_id, max(ts) OVER w AS watermark, coalesce(ts < max(ts) OVER w, false) AS late FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def watermark_audit(t):
    e = t("events").select("user_id", "event_id", "ts", F.struct("value", "event_id").alias("offset"))
    return replay.watermark_audit(e, "ts", "user_id", "offset").select("user_id", "event_id", "watermark", "late")


# --- streams, against the SQL of their batch forms ------------------------------------------------------------------------------


@query(_ASOF)
def stream_asof(t):
    e = streamed(t)
    versions = R.where_equal(e, "event_type", "signup").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("signup_id"))
    purchases = R.where_equal(e, "event_type", "purchase").select("event_id", "user_id", "ts")
    # Files may come in any order of time: nothing is late, or decided, before the last one is read.
    versions, end = replay.ended(versions, "at", "9999-01-01 00:00:00")
    joined = changing.as_of(purchases, versions, ["user_id"], "ts", "at", ["signup_id"], lateness="1460000 days")
    return replay.drain(joined, end=end).select("event_id", "signup_id")


@query("SELECT concat_ws('-', c_custkey, o_orderkey) AS id, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def stream_fk(t):
    joined = changing.foreign_key_join(streamed(t, "orders"), streamed(t, "customer"), "o_orderkey", "o_custkey", ["o_orderstatus"], "c_custkey", ["c_name"], "o_orderdate", "c_custkey")
    now = changing.current(replay.drain(joined), "o_orderkey")
    return now.select(F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("id"), "c_name")


@query("SELECT p_brand, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def stream_top_n(t):
    changes = changing.top_n(streamed(t, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_partkey", "p_retailprice", 3, "p_partkey")
    return changing.replayed(replay.drain(changes), ["p_brand"])


@query("""WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS count FROM events)
SELECT a.event_id, b.count FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 600000""")
def stream_own_count(t):
    e = streamed(t).select("user_id", "event_id", "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    step = stateful.own_count_step("user_id", "t", "event_id", 600_000)
    return replay.drain(stateful.scan(e, "user_id", ["ts", "event_id"], {}, step, "user_id long, event_id long, count long")).select("event_id", "count")


@query(_TUMBLE)
def stream_tumble(t):
    drained = replay.drain(_tumble(replay.event_time(streamed(t), "ts")), "update")
    return replay.without_zone(replay.last_state(drained, ["event_type", "window_start", "window_end"]))


@query(_DEDUP)
def stream_dedup(t):
    drained = replay.drain(_dedup(replay.event_time(streamed(t), "ts")), "update")
    return replay.without_zone(replay.last_state(drained, ["user_id", "event_type", "window_start"])).select("user_id", "event_type", "event_id", "window_start")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_count(t):
    return replay.last_state(replay.drain(R.count_by(streamed(t), "event_type"), "update"), ["event_type"])


@query("SELECT user_id, event_id, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)")
def stream_lag(t):
    step = stateful.lag_step("user_id", "event_id", "value")
    return replay.drain(stateful.scan(streamed(t), "user_id", ["event_id"], {}, step, "user_id long, event_id long, value double, previous double")).drop("_batch")


_MEDIAN = "SELECT user_id, event_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS median FROM events"
_MEDIAN_SCHEMA = "user_id long, event_id long, value double, median double"


@query(_MEDIAN)
def stream_median(t):
    return replay.drain(stateful.scan(streamed(t), "user_id", ["event_id"], {}, stateful.median_step("user_id", "event_id", "value", 3), _MEDIAN_SCHEMA)).drop("_batch")


@query(_MEDIAN)
def scan_median(t):
    return A.trailing_median(t("events"), "user_id", ["event_id"], "value", 3).select("user_id", "event_id", "value", "median")


@query("""SELECT user_id, event_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts - before > INTERVAL 1 HOUR""")
def dedup_islands(t):
    return stateful.dedup_islands(t("events").select("user_id", "event_id", "ts"), "user_id", "ts", "1 hour").drop("ts")


def _sided(events: DataFrame) -> DataFrame:
    return events.filter("event_type in ('signup', 'purchase')").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("v"), (F.col("event_type") == "purchase").cast("int").alias("side"))


_TTL = """SELECT user_id, (epoch_us(p.ts) // 1000) AS t, p.event_id AS "left", CASE WHEN (epoch_us(p.ts) // 1000) - (epoch_us(s.ts) // 1000) <= 86400000 THEN s.event_id END AS "right" FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id AS u, ts, event_id FROM events WHERE event_type = 'signup') s ON p.user_id = s.u AND p.ts >= s.ts"""


@query(_TTL)
def ttl_join(t):
    return J.lookup_with_ttl(_sided(t("events")), "user_id", "t", "v", "side", 86_400_000)


@query(_TTL)
def stream_ttl_join(t):
    step = stateful.ttl_join_step("user_id", "t", "v", "side", 86_400_000)
    return replay.drain(stateful.scan(_sided(streamed(t)), "user_id", ["t", "side"], {}, step, "user_id long, t long, left long, right long")).drop("_batch")


@query("""WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t, (epoch_us(ts) // 1000) // 21600000 AS k FROM events),
s AS (SELECT *, sum(event_id) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS total, lag(k) OVER (PARTITION BY user_id ORDER BY t, event_id) AS before FROM e)
SELECT user_id, ((before + 1) * 21600000)::BIGINT AS tick_ms, total FROM s WHERE before IS NOT NULL AND k > before""")
def keyed_accumulate(t):
    e = t("events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return A.totals_at_ticks(e, "user_id", ["t", "event_id"], "t", "event_id", 21_600_000)


@query("""WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t FROM events), b AS (SELECT DISTINCT t // 21600000 AS k FROM e),
ticks AS (SELECT (k + 1) * 21600000 AS tick_ms FROM b WHERE k < (SELECT max(k) FROM b)),
totals AS (SELECT tick_ms, user_id, sum(event_id) AS total FROM ticks JOIN e ON t < tick_ms GROUP BY ALL)
SELECT tick_ms::BIGINT AS tick_ms, user_id, total::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY tick_ms ORDER BY total DESC, user_id) AS r FROM totals) WHERE r = 1""")
def punctuate(t):
    e = t("events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return A.leader_at_ticks(e, "user_id", "t", "event_id", 21_600_000)


@query("SELECT user_id, event_id, ((epoch_us(ts) // 1000) // 36000000)::BIGINT AS interval, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS place FROM events")
def reorder(t):
    return stateful.reorder(t("events").select("user_id", "event_id", "ts"), "user_id", "ts", 36_000_000).drop("ts")


# --- the rest of the surveyed functions and sources --------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 10 MINUTES, ts) - INTERVAL 5 MINUTES * k AS window_start, time_bucket(INTERVAL 10 MINUTES, ts) - INTERVAL 5 MINUTES * k + INTERVAL 10 MINUTES AS window_end, count(*) AS n FROM (SELECT * FROM events, (VALUES (-1), (0), (1)) v(k)) WHERE ts >= time_bucket(INTERVAL 10 MINUTES, ts) - INTERVAL 5 MINUTES * k AND ts < time_bucket(INTERVAL 10 MINUTES, ts) - INTERVAL 5 MINUTES * k + INTERVAL 10 MINUTES GROUP BY ALL")
def hop_global(t):
    return W.hopping(t("events"), "ts", "10 minutes", "5 minutes", n=F.count("*"))


@query("SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN (SELECT c_custkey AS o_custkey, c_name FROM customer WHERE c_custkey % 3 = 0) c USING (o_custkey)")
def left_join_table(t):
    customers = t("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return J.table_join(t("orders").select("o_orderkey", "o_custkey"), customers, ["o_custkey"], "left").select("o_orderkey", "o_custkey", "c_name")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS code FROM events")
def case_map(t):
    return R.mapped(t("events"), "event_type", {"view": 1, "purchase": 2}, "code", 0).select("event_id", "code")


@query("SELECT event_id, v IS NULL AS missing FROM (SELECT event_id, CASE WHEN value > 10 THEN value END AS v FROM events)")
def null_filters(t):
    e = t("events").select("event_id", F.when(F.col("value") > 10, F.col("value")).alias("v"))
    return R.known(e, "v").withColumn("missing", F.lit(False)).unionByName(R.unknown(e, "v").withColumn("missing", F.lit(True))).drop("v")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def computed_column(t):
    return R.computed(t("lineitem"), net=F.col("l_extendedprice") * (1 - F.col("l_discount"))).select("l_orderkey", "l_linenumber", "net")


@query("SELECT event_id, 'events.parquet' AS file FROM events")
def file_metadata(t):
    return readers.with_file_metadata(t("events")).select("event_id", F.regexp_extract("file_path", "(events.parquet)", 1).alias("file"))


@query("SELECT event_id, (event_id - 500)::INTEGER AS small, (event_id * -3000000000)::BIGINT AS large FROM events")
def keys_from_bytes(t):
    raw = lambda c, n: F.unhex(F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 17 - 2 * n, 2 * n))
    small, large = F.col("event_id") - 500, F.col("event_id") * F.lit(-3_000_000_000)
    return t("events").select("event_id", readers.integer_from_bytes(raw(small, 4), 4).alias("small"), readers.integer_from_bytes(raw(large, 8), 8).alias("large"))


@query("SELECT event_id, event_type, CASE WHEN event_type = 'purchase' THEN value END AS amount, CASE WHEN event_type = 'view' THEN user_id END AS viewer FROM events WHERE event_type IN ('purchase', 'view')")
def mixed_types(t):
    e = t("events").withColumns({"bought": F.when(F.col("event_type") == "purchase", F.struct("value")), "seen": F.when(F.col("event_type") == "view", F.struct("user_id"))})
    parts = readers.variants(e, "event_type", {"purchase": ["event_id", "event_type", "bought.value"], "view": ["event_id", "event_type", "seen.user_id"]})
    bought = parts["purchase"].withColumnRenamed("value", "amount").withColumn("viewer", F.lit(None).cast("long"))
    return bought.unionByName(parts["view"].withColumnRenamed("user_id", "viewer").withColumn("amount", F.lit(None).cast("double")))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'dead' WHEN value > 20 THEN 'high' ELSE 'low' END AS route FROM events")
def dead_or_routed(t):
    raw = F.when(F.col("event_id") % 9 == 0, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lpad(F.hex("event_id"), 8, "0")))
    good, dead = sinks.dead_letters(t("events").select("event_id", "value", readers.integer_from_bytes(raw, 4).alias("key")), {"key": F.col("key").isNotNull()})
    return R.branch(good, [("high", F.col("value") > 20)], "low", "route").select("event_id", "route").unionByName(dead.select("event_id", F.lit("dead").alias("route")))


@query("""SELECT event_id, date_trunc('second', ts) AS parsed, TIMESTAMP '1970-01-01 00:00:00' AS failed, make_timestamp(event_id * 1000) AS by_millis, (epoch_us(ts) // 1000000)::BIGINT AS seconds,
make_timestamp(event_id * 1000000) AS epoch_0, make_timestamp(event_id * 1000) AS epoch_3, strftime(ts - INTERVAL 5 HOURS, '%H:%M') AS eastern, ((epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-01 00:00:00') // 1000) // 60000)::BIGINT AS minutes,
year(ts)::BIGINT AS y, minute(ts)::BIGINT AS m FROM events""")
def more_time_functions(t):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    plain = lambda c: c.cast("timestamp_ntz")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return t("events").select(
        "event_id",
        plain(S.parse_timestamp(text, "yyyy-MM-dd HH:mm:ss")).alias("parsed"),
        plain(S.parse_timestamp(F.lit("no time"), "yyyy-MM-dd HH:mm:ss", "epoch")).alias("failed"),
        plain(S.from_millis(F.col("event_id"))).alias("by_millis"),
        S.to_seconds(text, "yyyy-MM-dd HH:mm:ss").alias("seconds"),
        plain(S.epoch(F.col("event_id"), 0)).alias("epoch_0"),
        plain(S.epoch(F.col("event_id"), 3)).alias("epoch_3"),
        S.format_time(F.col("ts").cast("timestamp"), "HH:mm", "America/New_York").alias("eastern"),
        S.minutes_between_ms(start, F.col("ts")).alias("minutes"),
        S.time_part(F.col("ts"), "YEAR").cast("long").alias("y"),
        S.time_part(F.col("ts"), "MINUTE").cast("long").alias("m"),
    )


@query("""SELECT p_partkey, '{"id":' || p_partkey || ',"brand":"' || p_brand || '"}' AS json, p_name AS decoded, printf('%05d|%s', p_partkey, p_brand) AS line, (p_partkey + p_size)::INTEGER AS total FROM part""")
def more_text_functions(t):
    p = t("part")
    S.register(p.sparkSession)
    return p.select(
        "p_partkey",
        S.json_object(id=F.col("p_partkey"), brand=F.col("p_brand")).alias("json"),
        S.decode_base64(F.base64(F.col("p_name").cast("binary"))).alias("decoded"),
        S.formatted("%05d|%s", F.col("p_partkey"), F.col("p_brand")).alias("line"),
        F.expr("sum_integers(cast(p_partkey as int), cast(p_size as int))").alias("total"),
    )


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0")
def upsert_source(t):
    c = t("customer").select("c_custkey", "c_name")
    changes = c.select("c_custkey", F.lit("old").alias("c_name"), F.lit(1).alias("offset"), F.lit(False).alias("gone"))
    changes = changes.unionByName(c.select("c_custkey", "c_name", F.lit(2).alias("offset"), (F.col("c_custkey") % 5 == 0).alias("gone")))
    return readers.upserted(changes, ["c_custkey"], ["offset"], F.col("gone")).select("c_custkey", "c_name")


def entry(spark: SparkSession) -> DataFrame:
    return _queries["tumble_6h"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
