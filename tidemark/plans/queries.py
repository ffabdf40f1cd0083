"""Queries over the test tables, each with its SQL.

``events`` is the metric stream: series are event_type and user_id, the member
of a federation is event_id modulo 3, and the grid is an hour or a day.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import buckets as B
from tidemark.functions import durations as D
from tidemark.functions import points as P
from tidemark.functions import rules as R
from tidemark.operators import histogram, intervals, merge, meta, rank
from tidemark.sources import tables as T
from tidemark.sources import wire
from tidemark.streaming import rollup

QUERIES, SQL = {}, {}
DAY = 86400


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def members(spark, d):
    """Daily sums, counts and bounds of each member and event type, as its shard would answer."""
    e = table(spark, d, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.groupBy((F.col("event_id") % 3).alias("src_order"), F.col("event_type").alias("series"), ((at - F.pmod(at, F.lit(DAY))) * P.NS).alias("epoch_ns")).agg(
        F.sum("value").alias("s"), F.count("value").cast("double").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"),
    )


def daily(spark, d):
    """One value per user, event type and day."""
    e = table(spark, d, "events")
    return e.groupBy("event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))


DAY_NS = "CAST(epoch(date_trunc('day', ts)) AS BIGINT) * 1000000000"
PER_DAY = f"SELECT event_type AS series, {DAY_NS} AS epoch_ns, {{}} FROM events GROUP BY 1, 2"
MEMBERS = f"WITH m AS (SELECT event_id % 3 AS src, event_type AS series, {DAY_NS} AS epoch_ns, sum(value) AS s, count(value) AS n, min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM events GROUP BY 1, 2, 3) "
DAILY = "WITH p AS (SELECT event_type, user_id, strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 6) AS v FROM events GROUP BY 1, 2, 3) "


# -- buckets --------------------------------------------------------------------


def _bucket_query(name, column, sql_bucket):
    def f(spark, d):
        e = table(spark, d, "events")
        return e.groupBy(column(F.col("ts")).alias("t"), "event_type").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("value"), 4).alias("total"))

    f.__name__ = name
    query(f"SELECT {sql_bucket} AS t, event_type, count(*) AS cnt, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(f)


for _n, _s in B.NAMED.items():
    _bucket_query(f"bucket_{_n}", lambda c, s=_s: B.bucket(c, s, "second"), f"CAST(make_timestamp(CAST(floor(epoch(ts) / {_s}) AS BIGINT) * {_s} * 1000000) AS TIMESTAMP)")
_bucket_query("bucket_monday", B.monday, "CAST(date_trunc('week', ts) AS TIMESTAMP)")
_bucket_query("bucket_2_weeks", lambda c: B.bucket(c, 2, "week"), "CAST(make_timestamp((CAST(floor((epoch(ts) - 345600) / 1209600) AS BIGINT) * 1209600 + 345600) * 1000000) AS TIMESTAMP)")
_bucket_query("bucket_int_div_ms", lambda c: B.int_div(c, 300, 1000), "CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 * 1000")


@query("SELECT date_trunc('hour', ts) AS t, event_type, count(*) AS cnt FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def range_hour_count(spark, d):
    e = table(spark, d, "events").filter(B.in_range(F.col("ts"), "2024-01-05", "2024-01-20"))
    return e.groupBy(B.bucket(F.col("ts"), 1, "hour").alias("t"), "event_type").agg(F.count(F.lit(1)).alias("cnt"))


@query("SELECT event_type, date_trunc('day', ts) AS t, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS big, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def sum_if_and_distinct(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("t")).agg(F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("big"), F.countDistinct("user_id").alias("users"))


@query("SELECT date_trunc('week', o_orderdate) AS t, o_orderpriority, count(*) AS cnt, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def orders_by_week(spark, d):
    return table(spark, d, "orders").groupBy(B.monday(F.col("o_orderdate")).alias("t"), "o_orderpriority").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT date_trunc('day', l_shipdate) AS t, l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS cnt FROM lineitem GROUP BY 1, 2")
def lineitem_daily_revenue(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(B.bucket(F.col("l_shipdate"), 1, "day").alias("t"), "l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("cnt"))


# -- merging members -----------------------------------------------------------


def _merge_query(name, column, how, expression, digits=6):
    def f(spark, d):
        m = members(spark, d).withColumn("v", F.col(column))
        return merge.merge(m, how).select("series", "epoch_ns", F.round("v", digits).alias("v"))

    f.__name__ = name
    query(f"{MEMBERS}SELECT series, epoch_ns, round({expression}, {digits}) AS v FROM m GROUP BY 1, 2")(f)


_merge_query("merge_sum", "s", "sum", "sum(s)")
_merge_query("merge_min", "lo", "min", "min(lo)")
_merge_query("merge_max", "hi", "max", "max(hi)")
_merge_query("merge_count", "s", "count", "CAST(count(*) AS DOUBLE)")
_merge_query("merge_avg", "mean", "avg", "avg(mean)")
_merge_query("merge_dedup_last", "s", "dedup", "arg_max(s, src)")
_merge_query("merge_scalar_first", "s", "scalar", "arg_min(s, src)")


@query(MEMBERS + "SELECT series, epoch_ns, round(sum(s) / 3, 6) AS v FROM m GROUP BY 1, 2")
def merge_avg_over_members(spark, d):
    return merge.average_over_members(members(spark, d).withColumn("v", F.col("s")), 3).select("series", "epoch_ns", F.round("v", 6).alias("v"))


@query(PER_DAY.format("round(avg(value), 6) AS v"))
def agg_avg_by(spark, d):
    return merge.ratio(members(spark, d), "s", "n").select("series", "epoch_ns", F.round("v", 6).alias("v"))


@query(PER_DAY.format("round(var_pop(value), 3) AS v"))
def agg_stdvar_pooled(spark, d):
    return merge.pooled_variance(members(spark, d)).select("series", "epoch_ns", F.round("v", 3).alias("v"))


@query(PER_DAY.format("round(stddev_pop(value), 4) AS v"))
def agg_stddev_pooled(spark, d):
    return merge.pooled_variance(members(spark, d)).select("series", "epoch_ns", F.round(F.sqrt("v"), 4).alias("v"))


@query(DAILY + "SELECT event_type, day, round(var_pop(v), 3) AS v FROM p GROUP BY 1, 2")
def agg_stdvar_central(spark, d):
    return merge.variance_of(daily(spark, d), ("event_type", "day")).withColumn("v", F.round("v", 3))


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, 1.0::DOUBLE AS v FROM events GROUP BY 1, 2")
def agg_group(spark, d):
    return merge.group(table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ("event_type", "day"))


@query("SELECT event_type, CAST(floor(value) AS BIGINT) AS bin, count(*) AS cnt FROM events GROUP BY 1, 2")
def agg_count_values(spark, d):
    return merge.count_values(table(spark, d, "events"), ("event_type",), F.floor("value"), "bin").withColumnRenamed("count", "cnt")


@query(DAILY + "SELECT event_type, day, round(quantile_cont(v, 0.9), 5) AS v FROM p GROUP BY 1, 2")
def agg_quantile_90(spark, d):
    return rank.quantile(daily(spark, d), 0.9, ["event_type", "day"]).select("event_type", "day", F.round("v", 5).alias("v"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 5) AS v FROM events GROUP BY 1")
def agg_median(spark, d):
    return rank.quantile(table(spark, d, "events").withColumn("v", F.col("value")), 0.5, ["event_type"]).select("event_type", F.round("v", 5).alias("v"))


# -- selections -----------------------------------------------------------------


def _top_query(name, k, largest):
    def f(spark, d):
        p = daily(spark, d).withColumn("series", F.col("user_id").cast("string"))
        return rank.top(p, k, ["event_type", "day"], largest).select("event_type", "day", "user_id", "v")

    f.__name__ = name
    way = "DESC" if largest else "ASC"
    query(f"{DAILY}SELECT event_type, day, user_id, v FROM (SELECT *, row_number() OVER (PARTITION BY event_type, day ORDER BY v {way}, CAST(user_id AS VARCHAR)) AS r FROM p) WHERE r <= {k}")(f)


_top_query("topk_per_day", 3, True)
_top_query("bottomk_per_day", 3, False)


@query(DAILY + "SELECT event_type, day, user_id, v FROM (SELECT *, dense_rank() OVER (PARTITION BY event_type, day ORDER BY CAST(user_id AS VARCHAR)) AS r FROM p) WHERE r <= 2")
def limitk_per_day(spark, d):
    p = daily(spark, d).withColumn("series", F.col("user_id").cast("string"))
    return rank.first_series(p, 2, ["event_type", "day"]).select("event_type", "day", "user_id", "v")


@query()
def limit_ratio(spark, d):
    """A third of the series by their label hash; SQL has no such hash, tests hold it against known vectors."""
    p = daily(spark, d).withColumn("tags", P.tags_of("event_type", "user_id"))
    return rank.hash_sample(p, 1 / 3).select("event_type", "user_id", "day", "v")


@query("SELECT user_id, round(sum(value), 4) AS v FROM events GROUP BY 1 ORDER BY v DESC, CAST(user_id AS VARCHAR)")
def instant_sort_desc(spark, d):
    p = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("v")).withColumn("series", F.col("user_id").cast("string"))
    return rank.instant_sort(p, True).select("user_id", "v")


@query("SELECT user_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def newest_per_user(spark, d):
    e = table(spark, d, "events").withColumn("status", F.lit(200))
    return rank.newest(e, ["user_id"], "ts", "status", "event_id").select("user_id", "event_type", "ts", "value")


@query("SELECT user_id, event_type AS first_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type <> 'error') WHERE r = 1")
def first_good_per_user(spark, d):
    e = table(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "error", 500).otherwise(200))
    return rank.first_good(e, ["user_id"], "status", "event_id").select("user_id", F.col("event_type").alias("first_type"))


@query("WITH s AS (SELECT user_id, CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 204 WHEN 'view' THEN 404 ELSE 302 END AS st FROM events) SELECT user_id, coalesce(min(CASE WHEN st BETWEEN 200 AND 299 THEN st END), max(st)) AS status FROM s GROUP BY 1")
def merged_status_per_user(spark, d):
    t = F.col("event_type")
    e = table(spark, d, "events").withColumn("status", F.when(t == "error", 500).when(t == "click", 204).when(t == "view", 404).otherwise(302))
    return rank.merged_status(e, ["user_id"], "status")


# -- replicas and joins ------------------------------------------------------------


def _replicas(spark, d):
    """Two replicas: the second has all rows with another value, the first lacks every fifth."""
    e = table(spark, d, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("epoch_ns"), F.col("value").alias("v"))
    return e.filter(F.col("epoch_ns") % 5 != 0).withColumn("replica_order", F.lit(0)).unionByName(e.withColumn("v", F.col("v") + 1).withColumn("replica_order", F.lit(1)))


@query("SELECT event_type AS series, event_id AS epoch_ns, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS v FROM events")
def replica_coalesce(spark, d):
    return merge.coalesce_replicas(_replicas(spark, d)).select("series", "epoch_ns", "v")


@query("SELECT event_type AS series, event_id AS epoch_ns FROM events WHERE event_id % 5 <> 0")
def replica_conflicts(spark, d):
    return merge.conflicts(_replicas(spark, d))


@query(f"SELECT event_id % 3 AS member, event_type AS series, {DAY_NS} AS epoch_ns, count(*) AS rows FROM events WHERE event_type <> 'error' GROUP BY 1, 2, 3")
def complete_variants(spark, d):
    m = members(spark, d).select(F.col("src_order").alias("member"), "series", "epoch_ns", F.col("n").cast("long").alias("rows"))
    # Errors lack the second variant.
    both = m.withColumn("variant", F.lit("sum")).unionByName(m.filter("series <> 'error'").withColumn("variant", F.lit("count")))
    return merge.complete_points(both, 2).filter("variant = 'sum'").drop("variant")


@query("SELECT event_id AS epoch_ns, event_type AS series, value AS v FROM events WHERE event_id % 7 <> 0")
def drop_mixed_kinds(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("epoch_ns"), F.col("event_type").alias("series"), F.col("value").alias("v"), F.lit("value").alias("kind"))
    both = e.unionByName(e.filter("epoch_ns % 7 = 0").withColumn("kind", F.lit("histogram")))
    return merge.drop_mixed(both).filter("kind = 'value'").select("epoch_ns", "series", "v")


@query("""WITH RECURSIVE p AS (SELECT event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_ns, min_by(value, event_id) AS v FROM events GROUP BY 1, 2),
s AS (SELECT series, min(epoch_ns) AS epoch_ns FROM p GROUP BY 1
UNION ALL SELECT s.series, (SELECT min(p.epoch_ns) FROM p WHERE p.series = s.series AND p.epoch_ns > s.epoch_ns + 3600) FROM s WHERE s.epoch_ns IS NOT NULL)
SELECT s.series, s.epoch_ns, p.v FROM s JOIN p USING (series, epoch_ns)""")
def dedup_within_tolerance(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("series"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch_ns"), F.col("value").alias("v"), F.col("event_id").alias("src_order"))
    return merge.dedup_within(e, 3600, 7 * DAY)


# -- intervals -------------------------------------------------------------------


def _active_days(spark, d):
    e = table(spark, d, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("key"), (at - F.pmod(at, F.lit(DAY))).alias("at")).distinct()


ISLANDS = """WITH a AS (SELECT DISTINCT user_id AS key, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS pt FROM events),
i AS (SELECT key, min(pt) AS start, max(pt) AS "end" FROM (SELECT *, pt - 86400 * row_number() OVER (PARTITION BY key ORDER BY pt) AS g FROM a) GROUP BY key, g)
"""


@query(ISLANDS + 'SELECT key, start, "end" FROM i')
def extents_compress(spark, d):
    return intervals.from_points(_active_days(spark, d), DAY)


@query(ISLANDS + "SELECT key, CAST(sum((\"end\" - start) / 86400 + 1) AS BIGINT) AS timestamps FROM i GROUP BY 1")
def extents_timestamp_count(spark, d):
    return intervals.timestamp_count(intervals.from_points(_active_days(spark, d), DAY), DAY)


def _month(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("key")).distinct().withColumn("start", F.lit(1704067200).cast("long")).withColumn("end", F.lit(1704067200 + 30 * DAY).cast("long"))


@query("""WITH a AS (SELECT DISTINCT user_id AS key, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS pt FROM events),
g AS (SELECT k.key, 1704067200 + 86400 * r.n AS pt FROM (SELECT DISTINCT key FROM a) k, (SELECT unnest(range(0, 31)) AS n) r),
m AS (SELECT g.key, g.pt FROM g LEFT JOIN a ON a.key = g.key AND a.pt = g.pt WHERE a.pt IS NULL)
SELECT key, CAST(min(pt) AS BIGINT) AS start, CAST(max(pt) AS BIGINT) AS "end" FROM (SELECT *, pt - 86400 * row_number() OVER (PARTITION BY key ORDER BY pt) AS i FROM m) GROUP BY key, i""")
def extents_missing(spark, d):
    return intervals.subtract(_month(spark, d), intervals.from_points(_active_days(spark, d), DAY), DAY)


@query(ISLANDS + 'SELECT key, greatest(start, 1704672000) AS start, least("end", 1705536000) AS "end" FROM i WHERE greatest(start, 1704672000) <= least("end", 1705536000)')
def extents_crop(spark, d):
    return intervals.crop(intervals.from_points(_active_days(spark, d), DAY), 1704672000, 1705536000)


@query("SELECT DISTINCT user_id AS key, CAST(1704067200 + 86400 * 7 * n AS BIGINT) AS start, CAST(least(1704067200 + 86400 * 7 * n + 86400 * 6, 1704067200 + 86400 * 30) AS BIGINT) AS \"end\" FROM events, (SELECT unnest(range(0, 5)) AS n)")
def extents_splice(spark, d):
    return intervals.splice(_month(spark, d), DAY, 7)


@query("SELECT event_id, user_id FROM events e WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = e.user_id AND ((o.o_orderkey % 20) * 86400 + 1704067200) <= epoch(e.ts) AND epoch(e.ts) <= ((o.o_orderkey % 20) * 86400 + 1704067200 + 86400))")
def points_in_extents(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id"), F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("at"))
    start = (F.col("o_orderkey") % 20) * DAY + 1704067200
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), start.alias("start"), (start + DAY).alias("end")).distinct()
    return intervals.points_in(e, x, DAY, 10 * DAY).select("event_id", "user_id")


@query("""WITH a AS (SELECT DISTINCT user_id AS key, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS pt FROM events),
n AS (SELECT key, sum(CASE WHEN pt BETWEEN 1704067200 AND 1704067200 + 9 * 86400 THEN 1 ELSE 0 END) AS c FROM a GROUP BY 1)
SELECT key, CASE WHEN c = 10 THEN 'hit' WHEN c = 0 THEN 'rmiss' ELSE 'phit' END AS status FROM n""")
def cache_status(spark, d):
    days = _active_days(spark, d)
    wanted = days.select("key").distinct().withColumn("start", F.lit(1704067200).cast("long")).withColumn("end", F.lit(1704067200 + 9 * DAY).cast("long"))
    return rollup.status(wanted, intervals.from_points(days, DAY), DAY)


# -- rollups -----------------------------------------------------------------------


@query("SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS bucket, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def rollup_refreshed(spark, d):
    """A rollup whose middle was missing and is computed anew."""
    e = table(spark, d, "events")
    a, b = 1704067200 + 10 * DAY, 1704067200 + 12 * DAY
    stored = rollup.partials(e, 3600, ["event_type"]).filter(~F.col("bucket").between(a, b))
    return rollup.refresh(spark, e, stored, [(a, b)], 3600, ["event_type"]).withColumn("total", F.round("total", 4))


@query("SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS bucket, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def rollup_of_rollup(spark, d):
    hours = rollup.partials(table(spark, d, "events"), 3600, ["event_type"])
    return rollup.combine(hours.withColumn("bucket", F.col("bucket") - F.pmod("bucket", F.lit(DAY))), []).withColumn("total", F.round("total", 4))


@query("WITH b AS (SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1) SELECT bucket, n FROM b WHERE bucket BETWEEN 1704067200 + 20 * 86400 AND 1704067200 + 30 * 86400")
def rollup_retained(spark, d):
    return rollup.retain(rollup.partials(table(spark, d, "events"), DAY, []), 1704067200 + 30 * DAY, DAY, 10).select("bucket", "n")


# -- metadata, rules, labels ---------------------------------------------------------


@query("SELECT DISTINCT event_type FROM events ORDER BY 1")
def label_values(spark, d):
    return meta.label_values(table(spark, d, "events"), "event_type")


@query("SELECT DISTINCT '{\"event_type\":\"' || event_type || '\",\"user_id\":\"' || user_id || '\"}' AS series FROM events")
def series_sets(spark, d):
    return meta.label_sets(table(spark, d, "events").select(P.tags_json(P.tags_of("user_id", "event_type")).alias("series")))


@query("SELECT count(DISTINCT event_type || ':' || user_id) AS series_count, count(*) AS point_count, count(DISTINCT ts) AS timestamp_count, count(event_id) AS value_count, CAST(sum(length(CAST(event_id AS VARCHAR)) + 16) AS BIGINT) AS size FROM events")
def result_counters(spark, d):
    e = table(spark, d, "events")
    return meta.counters(e.select(P.tags_json(P.tags_of("event_type", "user_id")).alias("series"), P.epoch_ns(F.col("ts")).alias("epoch_ns"), F.col("event_id").alias("v")))


@query("SELECT user_id, state, value FROM (SELECT user_id, value, CASE WHEN value > 90 THEN 'firing' WHEN value > 60 THEN 'pending' ELSE 'inactive' END AS state, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value > 90 THEN 2 WHEN value > 60 THEN 1 ELSE 0 END DESC, event_id) AS r FROM events) WHERE r = 1")
def alerts_most_severe(spark, d):
    v = F.col("value")
    e = table(spark, d, "events").withColumn("state", F.when(v > 90, "firing").when(v > 60, "pending").otherwise("inactive"))
    return meta.alerts(e, ["user_id"], "event_id").select("user_id", "state", "value")


@query("SELECT n_name, CASE r_name WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'west' ELSE 'other' END AS route FROM nation JOIN region ON n_regionkey = r_regionkey")
def routed_nations(spark, d):
    routes = spark.createDataFrame([("ASIA", "east"), ("EUROPE", "west")], "r_name string, route string")
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return meta.route(rows, routes, "r_name", "other").select("n_name", "route")


@query("SELECT event_id, event_id % 4 AS member FROM events")
def round_robin_members(spark, d):
    return meta.round_robin(table(spark, d, "events"), "event_id", 4).select("event_id", "member")


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%a%' THEN 'true' ELSE 'false' END AS has_a, CASE WHEN p_type NOT LIKE 'S%' THEN 'true' ELSE 'false' END AS not_s,
CASE WHEN p_size BETWEEN 10 AND 20 THEN 'true' ELSE 'false' END AS mid, CAST(p_size % 7 AS VARCHAR) AS m7, md5(p_name) AS digest,
CASE WHEN regexp_matches(p_brand, '[0-9]') THEN 'true' ELSE 'false' END AS numbered FROM part""")
def rule_predicates(spark, d):
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select(
        "p_partkey", R.string_rule("contains", F.col("p_name"), "a").alias("has_a"), R.string_rule("prefix", F.col("p_type"), "S", True).alias("not_s"), R.number_rule("bt", size, "10-20").alias("mid"),
        R.number_rule("modulo", size, "7").alias("m7"), R.string_rule("md5", F.col("p_name"), "").alias("digest"), R.string_rule("rmatch", F.col("p_brand"), "[0-9]").alias("numbered"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'rest' END AS kind FROM orders")
def rule_cases(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.decide(F.col("o_orderstatus"), [("O", "open"), ("F", "final")], "rest").alias("kind"))


@query(r"""SELECT page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host,
regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS params FROM pages""")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", *[R.url_part(u, n).alias(n) for n in ("scheme", "host", "path", "params")])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_search(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def strip_and_regroup(spark, d):
    """Injected and stripped labels leave the groups as they were."""
    tags = P.strip_tags(P.inject_tags(P.tags_of("event_type", "user_id"), region="x"), "region", "event_type")
    e = table(spark, d, "events").select(P.group_tags(tags, ["user_id"])["user_id"].cast("long").alias("user_id"), "value")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# -- histograms and wire formats -------------------------------------------------------


@query("""WITH b AS (SELECT event_type AS series, CAST(floor(value / 10) AS BIGINT) AS i, count(*) AS c FROM events GROUP BY 1, 2)
SELECT series, i * 10.0::DOUBLE AS lower, (i + 1) * 10.0::DOUBLE AS upper, CAST(c AS DOUBLE) AS count FROM b""")
def histogram_sum(spark, d):
    e = table(spark, d, "events")
    i = F.floor(F.col("value") / 10)
    per_member = e.groupBy((F.col("event_id") % 3).alias("m"), F.col("event_type").alias("series"), (i * 10.0).alias("lower"), ((i + 1) * 10.0).alias("upper")).agg(F.count(F.lit(1)).cast("double").alias("count"))
    return histogram.add(per_member.withColumn("epoch_ns", F.lit(1).cast("long"))).select("series", "lower", "upper", "count")


@query("SELECT event_type, event_id, value AS v FROM events")
def matrix_round_trip(spark, d):
    """Points written as JSON and read again."""
    e = table(spark, d, "events").select(P.tags_json(P.tags_of("event_type")).alias("series"), (F.col("event_id") * 1_000_000 + 1_000_000).alias("epoch_ns"), F.col("value").cast("string").alias("v_raw"))
    docs = wire.write_matrix(e, 1_000_000).select(F.concat(F.lit('{"status":"success","data":{"resultType":"matrix","result":['), "json", F.lit("]}}")).alias("doc"))
    back = wire.read_matrix(docs)
    return back.select(F.col("tags")["event_type"].alias("event_type"), (F.col("epoch_ns") / 1_000_000 - 1).cast("long").alias("event_id"), "v")


@query("SELECT event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, count(*) AS n FROM events GROUP BY 1, 2")
def typed_rows_round_trip(spark, d):
    """Points written as tab-separated lines and read again."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"), "event_type", "value")
    back = T.read_typed_rows(T.write_typed_rows(e), ["t", "event_type", "value"], "t", ["event_type"])
    return back.groupBy(F.col("tags")["event_type"].alias("event_type"), P.whole(F.col("epoch_ns"), P.NS).alias("s")).agg(F.count(F.lit(1)).alias("n"))
