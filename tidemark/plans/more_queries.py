"""More queries over the test tables: wire formats, histograms, federation accounting, extents, rules and parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import buckets as B
from tidemark.functions import durations as D
from tidemark.functions import points as P
from tidemark.functions import rules as R
from tidemark.operators import histogram, intervals, merge, meta, order, rank
from tidemark.plans.queries import DAY, DAY_NS, ISLANDS, MEMBERS, _active_days, _month, members, query, table
from tidemark.sources import tables as T
from tidemark.sources import wire
from tidemark.streaming import rollup

SERIES = "'{\"event_type\":\"' || event_type || '\"}'"


def _points(spark, d):
    """Events as points: series, tags, epoch_ns (their id in milliseconds), v_raw, v."""
    e = table(spark, d, "events")
    tags = P.tags_of("event_type")
    return e.select(tags.alias("tags"), P.tags_json(tags).alias("series"), ((F.col("event_id") + 1) * 1_000_000).alias("epoch_ns"), F.col("value").cast("string").alias("v_raw"), F.col("value").alias("v"), "event_id")


# -- wire formats ---------------------------------------------------------------


@query(f"""WITH h AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS i, CAST(count(*) AS DOUBLE) AS c FROM events GROUP BY 1, 2)
SELECT {SERIES} AS series, i * 10.0::DOUBLE AS lower, (i + 1) * 10.0::DOUBLE AS upper, 2 * c AS count, false AS lower_in, true AS upper_in FROM h""")
def histogram_wire_round_trip(spark, d):
    """Histograms of two members written as JSON documents beside values, read again, parsed and added."""
    e = table(spark, d, "events").withColumn("series", P.tags_json(P.tags_of("event_type"))).withColumn("i", F.floor(F.col("value") / 10))
    b = e.groupBy("series", F.lit(5_000_000_000).alias("epoch_ns"), (F.col("i") * 10.0).alias("lower"), ((F.col("i") + 1) * 10.0).alias("upper")).agg(F.count(F.lit(1)).cast("double").alias("count"))
    b = b.withColumn("lower_in", F.lit(False)).withColumn("upper_in", F.lit(True))
    sums = e.groupBy("series", F.lit(5_000_000_000).alias("epoch_ns")).agg(F.count(F.lit(1)).cast("double").alias("total_count"), F.round(F.sum("value"), 3).alias("total_sum"))
    written = histogram.write(b, sums).withColumn("kind", F.lit("histogram"))
    values = sums.select("series", "epoch_ns", F.lit("1").alias("v_raw"), F.lit("value").alias("kind"))
    docs = wire.write_matrix(written.unionByName(values)).select(wire.envelope(wire.result(F.col("json"), "matrix")).alias("doc"))
    back = wire.read_results(docs.unionByName(docs)).filter("kind = 'histogram'")
    return histogram.add(histogram.rows_of(histogram.parse(back))).drop("epoch_ns")


@query(f"SELECT {SERIES} AS series, 'vector' AS result_type, min(event_id + 1) * 1000000 AS epoch_ns, arg_min(value, event_id) AS v FROM events GROUP BY 1")
def vector_round_trip(spark, d):
    docs = wire.write_vector(_points(spark, d)).select(wire.envelope(wire.result(F.col("json"), "vector"), warnings=["partial"]).alias("doc"))
    return wire.read_results(docs).select("series", "result_type", "epoch_ns", "v")


@query("SELECT 'scalar' AS result_type, min(event_id + 1) * 1000000 AS epoch_ns, arg_min(value, event_id) AS v FROM events")
def scalar_round_trip(spark, d):
    docs = wire.write_scalar(_points(spark, d)).select(wire.envelope(wire.result(F.col("json"), "scalar")).alias("doc"))
    return wire.read_results(docs).select("result_type", "epoch_ns", "v")


@query("SELECT r_name, '{\"status\":\"error\",\"error\":\"no \\\"data\\\"\",\"errorType\":\"bad\",\"warnings\":[\"w\"]}' AS failed, '{\"status\":\"success\",\"data\":[\"' || r_name || '\"]}' AS good FROM region".replace('\\\\"', '\\"'))
def envelopes(spark, d):
    data = F.concat(F.lit('["'), F.col("r_name"), F.lit('"]'))
    return table(spark, d, "region").select("r_name", wire.envelope(F.lit(None).cast("string"), "error", 'no "data"', "bad", ["w"]).alias("failed"), wire.envelope(data).alias("good"))


def _nations(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", F.concat(F.col("n_name"), F.lit(', "q"')).alias("note"))


NOTE = "n_name || ', \"q\"'"


@query(f"""SELECT -2 AS nth, 'n_nationkey,n_name,note' AS value UNION ALL SELECT 0, n_nationkey || ',' || n_name || ',"' || replace({NOTE}, '"', '""') || '"' FROM nation""")
def csv_with_names(spark, d):
    return T.write_rows(_nations(spark, d), 2)


@query(f"SELECT -2 AS nth, 'n_nationkey\tn_name\tnote' AS value UNION ALL SELECT -1, 'Int32\tString\tString' UNION ALL SELECT 0, n_nationkey || chr(9) || n_name || chr(9) || {NOTE} FROM nation")
def tsv_with_names_and_types(spark, d):
    return T.write_rows(_nations(spark, d).withColumn("n_nationkey", F.col("n_nationkey").cast("int")), 5)


@query(f"""SELECT -1 AS nth, '[{{"name":"n_nationkey","type":"Int32"}},{{"name":"n_name","type":"String"}},{{"name":"note","type":"String"}}]' AS value
UNION ALL SELECT 0, '{{"n_nationkey":"' || n_nationkey || '","n_name":"' || n_name || '","note":"' || replace({NOTE}, '"', '\\"') || '"}}' FROM nation""")
def sql_json_rows(spark, d):
    return T.write_rows(_nations(spark, d).withColumn("n_nationkey", F.col("n_nationkey").cast("int")), 0)


@query("SELECT event_type, epoch_ns, field, type, v FROM (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 AS epoch_ns, user_id, value FROM events), LATERAL (VALUES ('user_id', 'long', CAST(user_id AS DOUBLE)), ('value', 'double', value)) x(field, type, v)")
def names_and_types_round_trip(spark, d):
    """Rows as documents with their two header lines, read again by them; a document is an hour of one event type."""
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t"), "event_type", F.col("user_id").cast("bigint").alias("user_id"), "value")
    head = "t\tevent_type\tuser_id\tvalue\nDateTime\tString\tInt64\tFloat64"
    lines = e.select("event_type", F.substr("t", F.lit(1), F.lit(13)).alias("hour"), F.concat_ws("\t", *e.columns).alias("line"))
    docs = lines.groupBy("event_type", "hour").agg(F.concat(F.lit(head + "\n"), F.array_join(F.collect_list("line"), "\n")).alias("doc"))
    back = T.read_names_and_types(docs, "t", ["event_type"])
    return back.select(F.col("tags")["event_type"].alias("event_type"), "epoch_ns", "field", "type", "v")


@query("SELECT '_result' AS result, event_type, CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 AS epoch_ns, '_value' AS field, 'double' AS type, min_by(value, event_id) AS v FROM events GROUP BY ALL")
def annotated_csv_round_trip(spark, d):
    """Points as annotated CSV, and read again by its annotations; a document is a day of one series."""
    e = table(spark, d, "events").groupBy("event_type", (F.unix_seconds(F.col("ts").cast("timestamp")) * P.NS).alias("epoch_ns")).agg(F.min_by("value", "event_id").alias("v"))
    lines = T.write_annotated(T.labelled(e, event_type="event_type"), ["event_type"], 0, P.NS)
    head = lines.filter("nth < 0").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]), "\n").alias("head"))
    body = lines.filter("nth = 0").groupBy("table", F.floor(F.col("epoch_ns") / (DAY * P.NS)).alias("day")).agg(F.array_join(F.collect_list("value"), "\n").alias("body"))
    docs = body.join(F.broadcast(head)).select(F.concat_ws("\n", "head", "body").alias("doc"))
    back = T.read_annotated(docs)
    return back.select("result", F.col("tags")["event_type"].alias("event_type"), "epoch_ns", "field", "type", "v")


@query("SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS \"table\", count(*) AS n FROM events GROUP BY 1")
def annotated_json_tables(spark, d):
    """Records written as JSON tables, and counted by their tables."""
    e = table(spark, d, "events").select("event_type", (F.col("event_id") * P.NS).alias("epoch_ns"), F.col("value").alias("v"))
    rows = T.write_tables_json(T.labelled(e, event_type="event_type"), ["event_type"], P.NS)
    records = F.from_json("json", "struct<records:array<struct<values:struct<event_type:string,table:bigint>>>>")["records"]
    return rows.select(F.explode(records).alias("r")).groupBy(F.col("r.values.event_type").alias("event_type"), F.col("r.values.table").alias("table")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 AS epoch_ns, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def influx_round_trip(spark, d):
    e = table(spark, d, "events").select(P.tags_json(P.tags_of("event_type")).alias("series"), (F.unix_seconds(F.col("ts").cast("timestamp")) * P.NS).alias("epoch_ns"), F.col("value").alias("v"))
    rows = wire.write_influx(e, None, P.NS, 86400)
    docs = rows.select(F.concat(F.lit('{"results":[{"statement_id":0,"series":['), F.col("json"), F.lit("]}]}")).alias("doc"))
    back = wire.read_influx(docs)
    return back.groupBy(F.col("tags")["event_type"].alias("event_type"), "epoch_ns").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))


@query("SELECT * FROM (VALUES ('GET', '', '', 'influxql-get'), ('POST', 'application/x-www-form-urlencoded', '', 'influxql-post'), ('POST', 'application/json', 'application/json', 'flux-json-json'), ('POST', 'application/json; charset=utf-8', '', 'flux-json-csv'), ('POST', 'application/vnd.flux', '', 'flux-raw-csv'), ('PUT', '', '', 'unknown')) t(method, content_type, accept, format)")
def request_formats(spark, d):
    asked = [("GET", "", ""), ("POST", "application/x-www-form-urlencoded", ""), ("POST", "application/json", "application/json"), ("POST", "application/json; charset=utf-8", ""), ("POST", "application/vnd.flux", ""), ("PUT", "", "")]
    return spark.createDataFrame([(*a, wire.detect(*a)) for a in asked], "method string, content_type string, accept string, format string")


@query(f"""WITH p AS (SELECT DISTINCT event_type, event_id // 1000 AS pt FROM events), i AS (SELECT event_type, pt - row_number() OVER (PARTITION BY event_type ORDER BY pt) AS g, pt FROM p)
SELECT {SERIES} AS key, min(pt) * 1000 AS start, max(pt) * 1000 AS "end" FROM i GROUP BY event_type, g""")
def chunk_extents(spark, d):
    p = _points(spark, d).withColumn("epoch_ns", F.col("event_id") - F.pmod("event_id", F.lit(1000)))
    return wire.chunk_extents(p.select("series", "epoch_ns"), 1000)


# -- histograms ------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 AS a, p_size % 7 AS b FROM part)
SELECT p_partkey, lower, upper, CAST(count AS DOUBLE) AS count, lower_in, upper_in FROM p, LATERAL (VALUES
 (-0.5::DOUBLE, 0.5::DOUBLE, a, true, true), (1.0::DOUBLE, 2.0::DOUBLE, b, false, true), (2.0::DOUBLE, 4.0::DOUBLE, b + a, false, true), (16.0::DOUBLE, 32.0::DOUBLE, b + a - 1, false, true), (-4.0::DOUBLE, -2.0::DOUBLE, a + 1, true, false)
) x(lower, upper, count, lower_in, upper_in) WHERE count <> 0""")
def histogram_spans(spark, d):
    """Native histograms by spans and deltas of both signs and a zero bucket."""
    a, b = F.col("p_partkey") % 5, F.col("p_size") % 7
    text = F.concat(
        F.lit('{"count":"9","sum":"1.5","schema":0,"zero_threshold":0.5,"zero_count":"'), a, F.lit('","positive_spans":[{"offset":1,"length":2},{"offset":2,"length":1}],"positive_deltas":['), b, F.lit(","), a,
        F.lit(',-1],"negative_spans":[{"offset":2,"length":1}],"negative_counts":["'), a + 1, F.lit('"]}'),
    )
    return histogram.rows_of(histogram.parse(table(spark, d, "part").select("p_partkey", text.alias("v_raw")))).select("p_partkey", "lower", "upper", "count", "lower_in", "upper_in")


@query("SELECT p_partkey, lower, upper, CAST(count AS DOUBLE) / 4 AS count FROM part, LATERAL (VALUES ('-Infinity'::DOUBLE, 1.5::DOUBLE, p_size), (1.5::DOUBLE, 2.5::DOUBLE, 3), (2.5::DOUBLE, 'Infinity'::DOUBLE, 5)) x(lower, upper, count) WHERE p_size <> 0")
def histogram_custom_divided(spark, d):
    """Histograms of custom bounds, divided by four."""
    text = F.concat(F.lit('{"count":"9","sum":"1","schema":-53,"custom_values":[1.5,2.5],"positive_spans":[{"offset":0,"length":3}],"positive_counts":["'), F.col("p_size"), F.lit('","3","5"]}'))
    return histogram.divide(histogram.rows_of(histogram.parse(table(spark, d, "part").filter("p_size <> 0").select("p_partkey", text.alias("v_raw")))), 4).select("p_partkey", "lower", "upper", "count")


@query("SELECT event_type AS series, CAST(count(*) AS DOUBLE) AS count FROM events GROUP BY 1")
def histogram_totals(spark, d):
    e = table(spark, d, "events")
    b = e.groupBy(F.col("event_type").alias("series"), F.lit(1).alias("epoch_ns"), F.floor("value").alias("lower")).agg(F.count(F.lit(1)).cast("double").alias("count"))
    return histogram.totals(b).drop("epoch_ns")


# -- federation --------------------------------------------------------------------


def _halves(spark, d):
    """Sums of all days, counts of those with an even number and none of errors."""
    m = members(spark, d)
    even = (F.col("epoch_ns") / (DAY * P.NS)) % 2 == 0
    return m.withColumn("v", F.col("s")), m.filter(even & (F.col("series") != "error")).withColumn("v", F.col("n"))


@query(f"SELECT event_type AS series, {DAY_NS} AS epoch_ns, round(avg(value), 6) AS v FROM events WHERE event_type <> 'error' AND CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 % 2 = 0 GROUP BY 1, 2")
def average_paired(spark, d):
    return merge.weighted_average(*_halves(spark, d)).select("series", "epoch_ns", F.round("v", 6).alias("v"))


@query("WITH p AS (SELECT DISTINCT event_type, CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 AS day FROM events) SELECT event_type AS series, count(*) AS dropped, event_type = 'error' AS no_count FROM p WHERE event_type = 'error' OR day % 2 = 1 GROUP BY 1")
def average_dropped(spark, d):
    return merge.unaveraged(*_halves(spark, d))


@query(MEMBERS + "SELECT 'kept' AS side, series, count(*) AS n FROM m WHERE series <> 'error' GROUP BY 2 UNION ALL SELECT DISTINCT 'dropped', series, 0 FROM m WHERE series = 'error'")
def average_series_pruned(spark, d):
    kept, dropped = merge.prune_series(*_halves(spark, d))
    return kept.groupBy(F.lit("kept").alias("side"), "series").agg(F.count(F.lit(1)).alias("n")).unionByName(dropped.select(F.lit("dropped").alias("side"), "series", F.lit(0).cast("long").alias("n")))


def _variants(spark, d):
    """Counts, means and variances of members; clicks lack the mean, views have two counts, and one member's counts of errors are no counts."""
    m = members(spark, d).withColumn("member", F.col("src_order"))
    keys = ["member", "series", "epoch_ns"]
    count = m.select(*keys, F.lit("count").alias("variant"), F.when((F.col("series") == "error") & (F.col("member") == 1), 0.5).otherwise(F.col("n")).alias("v"))
    again = m.filter("series = 'view'").select(*keys, F.lit("count").alias("variant"), (F.col("n") + 1).alias("v"))
    mean = m.filter("series <> 'click'").select(*keys, F.lit("mean").alias("variant"), F.col("mean").alias("v"))
    var = m.select(*keys, F.lit("variance").alias("variant"), F.col("var").alias("v"))
    return count.unionByName(again).unionByName(mean).unionByName(var)


@query(f"SELECT event_type AS series, {DAY_NS} AS epoch_ns, round(var_pop(value), 3) AS v FROM events WHERE event_type NOT IN ('click', 'view') AND (event_type <> 'error' OR event_id % 3 <> 1) GROUP BY 1, 2")
def variance_paired(spark, d):
    states, _ = merge.pair_states(_variants(spark, d))
    return merge.pooled_variance(states).select("series", "epoch_ns", F.round("v", 3).alias("v"))


@query(MEMBERS + "SELECT src AS member, count(*) AS dropped FROM m WHERE series IN ('click', 'view') OR (series = 'error' AND src = 1) GROUP BY 1")
def variance_dropped(spark, d):
    return merge.pair_states(_variants(spark, d))[1]


@query(MEMBERS + "SELECT src AS member, count(*) AS n FROM m WHERE src <> 2 GROUP BY 1")
def complete_members(spark, d):
    m = members(spark, d).select(F.col("src_order").alias("member"), "series", "epoch_ns")
    both = m.withColumn("variant", F.lit("sum")).unionByName(m.filter("member <> 2").withColumn("variant", F.lit("count")))
    return merge.complete_members(both, 2).filter("variant = 'sum'").groupBy("member").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, CASE WHEN bool_or(o_orderstatus <> 'P') THEN 'success' ELSE 'error' END AS status FROM orders GROUP BY 1")
def envelopes_merged(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("src_order"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("success").alias("status"), F.when(F.col("o_orderstatus") == "P", "down").alias("error"), F.array().cast("array<string>").alias("warnings"))
    return meta.merge_envelopes(o, ["o_custkey"]).select("o_custkey", "status")


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS o, o_orderstatus AS st, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders),
f AS (SELECT k, arg_min(st, o) AS t FROM o WHERE st <> 'P' GROUP BY 1), s AS (SELECT o.k, coalesce(min(CASE WHEN v IS NOT NULL THEN o END), min(o)) AS o FROM o JOIN f USING (k) WHERE f.t = 'F' AND o.st = 'F' GROUP BY 1)
SELECT k, o FROM s UNION ALL SELECT o.k, o.o FROM o JOIN f USING (k) WHERE f.t = 'O' AND o.st = 'O' UNION ALL SELECT k, min(o) FROM o WHERE k NOT IN (SELECT k FROM f) GROUP BY 1""")
def instant_answers(spark, d):
    """Orders as members' answers: pending ones are errors, final ones scalars (every third no number), open ones vectors."""
    st = F.col("o_orderstatus")
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.when(st == "P", "error").otherwise("success").alias("status"), F.when(st == "F", "scalar").when(st == "O", "vector").alias("result_type"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("v"))
    return meta.instant_merge(a, ["k"], "o").select("k", "o")


@query("SELECT n_regionkey AS k, n_nationkey AS o FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END, n_nationkey) AS r FROM nation WHERE n_nationkey % 5 <> 0) WHERE r = 1")
def winners(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("o"), F.when(F.col("n_nationkey") % 5 == 0, None).when(F.col("n_nationkey") % 2 == 0, 200).otherwise(503).alias("st"))
    return rank.pick_winner(n, ["k"], "st", "o").select("k", "o")


@query("SELECT DISTINCT o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus <> 'P')")
def all_failed(spark, d):
    return meta.all_failed(table(spark, d, "orders").withColumn("status_code", F.when(F.col("o_orderstatus") == "P", 503).otherwise(200)), ["o_custkey"])


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'P'")
def usable_answers(spark, d):
    return meta.usable(table(spark, d, "orders").withColumn("status_code", F.when(F.col("o_orderstatus") == "P", 503).otherwise(200))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE 'r' || n_regionkey END AS group_id, string_agg(n_name, ',' ORDER BY n_nationkey) AS members, CAST(min(n_nationkey) AS BIGINT) AS first FROM nation GROUP BY 1")
def replica_topology(spark, d):
    m = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("order"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("r"), F.col("n_regionkey"))).alias("replica_group"))
    return meta.replica_groups(m).withColumn("members", F.array_join("members", ","))


@query("SELECT event_id, CASE WHEN event_id % 6 < 3 THEN 0 WHEN event_id % 6 < 5 THEN 1 ELSE 2 END AS member FROM events")
def weighted_members(spark, d):
    return meta.weighted_round_robin(table(spark, d, "events"), "event_id", [3, 2, 1]).select("event_id", "member")


@query("SELECT name FROM (VALUES ('event_type'), ('region'), ('user_id')) t(name) ORDER BY 1")
def label_names_injected(spark, d):
    return meta.label_names(table(spark, d, "events").select(P.tags_of("event_type", "user_id").alias("tags")), inject={"region": "x"})


@query("SELECT event_type FROM (SELECT event_type FROM events UNION SELECT 'zz') ORDER BY 1")
def label_values_injected(spark, d):
    return meta.label_values(table(spark, d, "events"), "event_type", "zz")


@query("SELECT * FROM (VALUES ('cell'), ('region'), ('zone')) t(name)")
def strip_key_union(spark, d):
    r = table(spark, d, "region")
    injected = F.when(F.col("r_regionkey") == 0, F.create_map(F.lit("region"), F.col("r_name"))).when(F.col("r_regionkey") == 1, F.create_map(F.lit("zone"), F.lit("a"), F.lit("cell"), F.lit("b")))
    return meta.stripped_labels(r.select(injected.alias("injected")))


@query("SELECT n_name AS name, '{\"r\":\"' || n_regionkey || '\"}' AS series FROM nation ORDER BY series, name")
def series_by_tags(spark, d):
    return rank.by_tags(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit('{"r":"'), F.col("n_regionkey"), F.lit('"}')).alias("series")))


@query("SELECT user_id, event_id FROM events")
def range_sort(spark, d):
    """A range result is no vector, so sorting leaves it as it is."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("v"))
    return rank.instant_sort(rank.range_sort(e)[0], tie="user_id", at="event_id").select("user_id", "event_id")


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'left' ELSE 'right' END AS side FROM events WHERE (event_id % 10 = 0) <> (event_id % 15 = 0)")
def points_that_differ(spark, d):
    e = table(spark, d, "events").select("event_id", "value")
    return meta.different_points(e.filter("event_id % 15 <> 0"), e.filter("event_id % 10 <> 0")).select("event_id", "side")


@query("SELECT DISTINCT event_type AS series FROM events ORDER BY 1")
def result_series(spark, d):
    return meta.series_keys(table(spark, d, "events").select(F.col("event_type").alias("series")))


@query("SELECT DISTINCT '{\"n\":\"' || n_name || '\"}' AS json FROM nation")
def series_documents(spark, d):
    return meta.series_json(table(spark, d, "nation").select(F.create_map(F.lit("n"), F.col("n_name")).alias("tags")))


@query("SELECT '\"' || r_name || '\"' AS json FROM region ORDER BY r_name")
def label_documents(spark, d):
    return meta.labels_json(table(spark, d, "region"), "r_name")


@query("SELECT '{\"labels\":{\"n\":\"' || n_name || '\"},\"annotations\":{\"r\":\"' || n_regionkey || '\"},\"state\":\"' || CASE WHEN n_nationkey % 2 = 0 THEN 'firing' ELSE 'pending' END || '\",\"value\":\"' || n_nationkey || '\"}' AS json FROM nation")
def alert_documents(spark, d):
    n = table(spark, d, "nation")
    return meta.alert_json(n.select(F.create_map(F.lit("n"), F.col("n_name")).alias("labels"), F.create_map(F.lit("r"), F.col("n_regionkey").cast("string")).alias("annotations"), F.when(F.col("n_nationkey") % 2 == 0, "firing").otherwise("pending").alias("state"), F.col("n_nationkey").cast("string").alias("value")))


@query("SELECT event_id, 'event_type=' || event_type || ';user_id=' || user_id AS text, 'event_type,region,user_id' AS keys, 'b' AS region, coalesce(event_type, '') || chr(31) || '{\"user_id\":\"' || user_id || '\"}' AS pair FROM events")
def tag_texts(spark, d):
    tags = P.tags_of("event_type", "user_id")
    merged = P.merge_tags(P.inject_tags(tags, region="a"), F.create_map(F.lit("region"), F.lit("b")))
    return table(spark, d, "events").select("event_id", P.tags_text(tags).alias("text"), F.array_join(P.tag_keys(merged), ",").alias("keys"), merged["region"].alias("region"), P.pairing_key(F.col("event_type"), P.strip_tags(tags, "event_type")).alias("pair"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) || '' AS s, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS rfc, CAST(floor(epoch(ts)) AS BIGINT) // 60 * 60 AS start_minute, (CAST(floor(epoch(ts)) AS BIGINT) + 59) // 60 * 60 AS end_minute, CAST(floor(epoch(ts)) AS BIGINT) // 15 * 15 AS instant FROM events")
def epoch_formats(spark, d):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    ns = at * P.NS
    a, b = D.minutes(at, at)
    return table(spark, d, "events").select("event_id", P.format_epoch(ns, "s").alias("s"), P.format_epoch(ns, "date").alias("day"), P.rfc3339(ns).alias("rfc"), a.alias("start_minute"), b.alias("end_minute"), D.instant(at).alias("instant"))


@query("SELECT event_id, event_id - event_id % 10 AS low, (event_id + 9) // 10 * 10 AS high FROM events WHERE event_id BETWEEN 100 AND 2000")
def cropped_points(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("epoch_ns"))
    return P.crop(e, 100, 2000).select("event_id", B.floor_to(F.col("event_id"), 10).alias("low"), B.ceil_to(F.col("event_id"), 10).alias("high"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '{\"r\":\"' || n_regionkey || '\"}' ELSE '{\"n\":\"' || n_name || '\",\"r\":\"' || n_regionkey || '\"}' END AS g, '{\"n\":\"' || n_name || '\"}' AS w FROM nation")
def rank_groups(spark, d):
    tags = P.tags_of("n", "r")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("n"), F.col("n_regionkey").alias("r"))
    return n.select("n_nationkey", P.tags_json(F.when(F.col("n_nationkey") % 2 == 0, P.rank_tags(tags, ["r"])).otherwise(P.rank_tags(tags, [], True))).alias("g"), P.tags_json(P.rank_tags(tags, ["r"], True)).alias("w"))


# -- extents -------------------------------------------------------------------------


@query(ISLANDS + 'SELECT key, min(start) <= 1704672000 AND max("end") >= 1705536000 AS encompasses, min(start) >= 1704672000 AND max("end") <= 1705536000 AS encompassed, max("end") < 1704672000 OR min(start) > 1705536000 AS outside FROM i GROUP BY 1')
def extents_bounds_test(spark, d):
    return intervals.bounds_test(intervals.from_points(_active_days(spark, d), DAY), 1704672000, 1705536000)


@query("""SELECT DISTINCT user_id AS key, s AS start, e AS "end" FROM events, (VALUES (1704067200, 1704067200 + 9 * 86400), (1704067200 + 15 * 86400, 1704067200 + 30 * 86400)) x(s, e)""")
def extents_removed(spark, d):
    """A month without its tenth to fourteenth day."""
    gone = _month(spark, d).withColumn("start", F.lit(1704067200 + 10 * DAY).cast("long")).withColumn("end", F.lit(1704067200 + 14 * DAY).cast("long"))
    return intervals.remove(_month(spark, d), gone, DAY)


@query('SELECT DISTINCT user_id AS key, CAST(1704067200 + 86400 * 7 * n AS BIGINT) AS start, CAST(least(1704067200 + 86400 * 7 * n + 86400 * 6, 1704067200 + 86400 * 30) AS BIGINT) AS "end" FROM events, (SELECT unnest(range(0, 5)) AS n)')
def extents_spliced_by_time(spark, d):
    return intervals.splice_any(_month(spark, d), DAY, 7 * DAY)


@query("""SELECT DISTINCT user_id AS key, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM events, (SELECT 1704067200 AS s, 1704067200 + 2 * 86400 AS e
UNION ALL SELECT 1704067200 + (3 + 10 * n) * 86400, least(1704067200 + (12 + 10 * n) * 86400, 1704067200 + 30 * 86400) FROM (SELECT unnest(range(0, 3)) AS n))""")
def extents_spliced_aligned(spark, d):
    """Pieces of ten days from the next multiple of ten days since 1970 on: 2024-01-01 is day 19,723."""
    shifted = intervals.splice_any(_month(spark, d).withColumn("start", F.col("start") + 4 * DAY).withColumn("end", F.col("end") + 4 * DAY), DAY, 10 * DAY, 10 * DAY)
    return shifted.withColumn("start", F.col("start") - 4 * DAY).withColumn("end", F.col("end") - 4 * DAY)


@query("SELECT DISTINCT user_id AS key, CAST(1704067200 AS BIGINT) AS start, CAST(1704067200 + 86400 * 30 AS BIGINT) AS \"end\" FROM events")
def extents_too_many_pieces(spark, d):
    """A list of too many pieces stays whole."""
    return intervals.splice_any(_month(spark, d), DAY, DAY, cap=10)


@query("""SELECT DISTINCT user_id AS key, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(u AS BIGINT) AS last_used FROM events, (VALUES
(1704067200, 1704067200 + 4 * 86400, 7), (1704067200 + 5 * 86400, 1704067200 + 9 * 86400, 99), (1704067200 + 10 * 86400, 1704067200 + 30 * 86400, 7)) x(s, e, u)""")
def extents_marked_used(spark, d):
    return intervals.mark_used(_month(spark, d).withColumn("last_used", F.lit(7).cast("long")), 1704067200 + 5 * DAY, 1704067200 + 9 * DAY, 99, DAY)


@query(ISLANDS + """, n AS (SELECT *, (start // 86400 * 7919) % 101 AS last_used, ("end" - start) // 86400 + 1 AS c, ("end" >= 1704672000 AND start <= 1704758400) OR start > 1706400000 AS fixed FROM i),
h AS (SELECT *, sum(c) OVER (PARTITION BY key) AS total, coalesce(sum(c) OVER (PARTITION BY key, fixed ORDER BY last_used, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM n)
SELECT key, start, "end" FROM h WHERE fixed OR total - gone <= 5""")
def extents_evicted(spark, d):
    x = intervals.from_points(_active_days(spark, d), DAY).withColumn("last_used", (F.floor(F.col("start") / DAY) * 7919) % 101)
    return intervals.evict(x, 5, DAY, 1706400000, (1704672000, 1704758400)).select("key", "start", "end")


@query("SELECT DISTINCT user_id AS key, CAST(1704067200 AS BIGINT) AS start, CAST(1704067200 + 86400 * 20 AS BIGINT) AS \"end\" FROM events")
def extents_normalized(spark, d):
    raw = _month(spark, d).withColumn("start", F.col("start") + 4000).withColumn("end", F.col("end") + 4000)
    return intervals.normalize(raw, DAY, 0, 1704067200 + 20 * DAY + 500)


@query(ISLANDS + "SELECT key, string_agg(start || '-' || \"end\", ';' ORDER BY start) AS text FROM i GROUP BY 1")
def extents_text(spark, d):
    return intervals.as_text(intervals.from_points(_active_days(spark, d), DAY))


@query(ISLANDS + "SELECT key, string_agg(start || '-' || \"end\" || ':' || (start // 86400 % 7), ',' ORDER BY start // 86400 % 7, start) AS text FROM i GROUP BY 1")
def extents_lru_text(spark, d):
    return intervals.as_lru_text(intervals.from_points(_active_days(spark, d), DAY).withColumn("last_used", F.floor(F.col("start") / DAY) % 7))


@query(ISLANDS + 'SELECT key, start, "end" FROM i ORDER BY start, "end", key')
def extents_sorted(spark, d):
    return intervals.by_start(intervals.from_points(_active_days(spark, d), DAY))


@query(ISLANDS + 'SELECT key, start, "end" FROM i ORDER BY start // 86400 % 7, start, "end", key')
def extents_by_last_use(spark, d):
    return intervals.by_last_use(intervals.from_points(_active_days(spark, d), DAY).withColumn("last_used", F.floor(F.col("start") / DAY) % 7)).drop("last_used")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def record_limit(spark, d):
    return rank.record_limit(table(spark, d, "events").select("event_id", "value"), 100, [F.desc("value"), F.asc("event_id")])


# -- rules and parameters ----------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN 'true' ELSE 'false' END AS gt, '' AS neg, sha1(p_name) AS sha, to_base64(encode(p_name)) AS b64, p_name AS back, split_part(p_name, ' ', 2) AS second, 'true' AS yes, '' AS broken FROM part")
def rule_numbers_and_codes(spark, d):
    size = F.col("p_size").cast("string")
    b64 = R.string_rule("base64", F.col("p_name"), "")
    return table(spark, d, "part").select(
        "p_partkey", R.number_rule("gt", size, "10").alias("gt"), R.number_rule("bt", size, "-5-10").alias("neg"), R.string_rule("sha1", F.col("p_name"), "").alias("sha"), b64.alias("b64"), R.from_base64(b64).alias("back"),
        R.part(F.col("p_name"), " ", 1).alias("second"), R.bool_rule(F.lit("true"), "true").alias("yes"), R.from_base64(F.lit("%%")).alias("broken"),
    )


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS tier FROM orders")
def rule_case_arguments(spark, d):
    p = F.col("o_totalprice").cast("string")
    return table(spark, d, "orders").select("o_orderkey", R.decide_each(p, [(R.number_rule("ge", p, "100000"), "mid"), (R.number_rule("ge", p, "200000"), "high")], "low").alias("tier"))


@query(r"SELECT o_orderkey, regexp_extract(o_orderpriority, '^([0-9])-(.*)$', 2) || '/' || regexp_extract(o_orderpriority, '^([0-9])-(.*)$', 1) || '/${x}' AS route FROM orders")
def rule_captures(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.expand("${word}/${1}/${x}", F.col("o_orderpriority"), r"^(?P<rank>[0-9])-(?P<word>.*)$").alias("route"))


def _urls(spark, d):
    """A URL of each part, dealt out anew: the table is few bytes, so its file is read by one or two tasks."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return table(spark, d, "part").select("p_partkey", "p_size").repartition(tasks, "p_partkey").select("p_partkey", F.concat(F.lit("http://h"), F.col("p_size"), F.lit(".example:80/a/"), F.col("p_partkey"), F.lit("/c?x=1&y="), F.col("p_size")).alias("url"))


@query("""SELECT p_partkey, 'https://h' || p_size || '.example:443/a/' || p_partkey || '/c?x=1&y=' || p_size AS secure, 'http://other:8080/z/' || p_partkey || '/c?y=' || p_size || '&x=2' AS moved,
'http://h' || p_size || '.example/b/' || p_partkey || '/c' AS bare, 'http://h' || p_size || '.example:80/a/new/c?x=1&y=' || p_size || '&x=3' AS deep FROM part""")
def url_rewrites(spark, d):
    u = F.col("url")
    return _urls(spark, d).select(
        "p_partkey",
        R.rewrite_all(u, [("scheme", "set", "https"), ("port", "replace", "80", "443")]).alias("secure"),
        R.rewrite_all(u, [("host", "set", "other:8080"), ("path", "replace", "a", "z", "0"), ("param", "set", "x", "2")]).alias("moved"),
        R.rewrite_all(u, [("port", "delete"), ("path", "replace", "/a/", "/b/"), ("params", "delete")]).alias("bare"),
        R.rewrite_all(u, [("path", "set", "new", "1"), ("param", "append", "x", "3")]).alias("deep"),
    )


@query("SELECT p_partkey, 'h' || p_size || '.example' AS hostname, '80' AS port, '' || p_size AS y, 'http://h' || p_size || '.example:80/a/' || p_partkey || '/c' AS plain, 'a, b' AS joined, '' AS gone FROM part")
def url_sources(spark, d):
    u, h = F.col("url"), F.create_map(F.lit("X-A"), F.lit("a"))
    return _urls(spark, d).select(
        "p_partkey", R.url_part(u, "hostname").alias("hostname"), R.url_part(u, "port").alias("port"), R.url_part(u, "param", "y").alias("y"), R.url_part(u, "url_no_params").alias("plain"),
        R.header(R.rewrite_header(h, "append", "x-a", "b"), "X-A").alias("joined"), R.header(R.rewrite_header(h, "delete", "x-a"), "x-a").alias("gone"),
    )


@query("SELECT * FROM (VALUES ('1h30m', 5400000000000), ('2d', 172800000000000), ('-5m', -300000000000), ('1.5h', 5400000000000), ('1mo', 2628000000000000), ('1w2d', 777600000000000), ('10us', 10000), ('5x', 0), ('1', 0)) t(text, ns)")
def durations(spark, d):
    def parsed(text):
        try:
            return D.parse_duration(text)
        except ValueError:
            return 0

    return spark.createDataFrame([(t, parsed(t)) for t in ("1h30m", "2d", "-5m", "1.5h", "1mo", "1w2d", "10us", "5x", "1")], "text string, ns long")


@query("SELECT * FROM (VALUES ('15.9', 15000000000), ('1d', 86400000000000)) t(step, ns)")
def steps(spark, d):
    return spark.createDataFrame([(t, D.parse_step(t)) for t in ("15.9", "1d")], "step string, ns long")


@query("SELECT * FROM (VALUES ('1700000000.1234', 1700000000123000000), ('2024-01-01T00:00:00Z', 1704067200000000000)) t(time, ns)")
def times(spark, d):
    return spark.createDataFrame([(t, D.parse_time(t)) for t in ("1700000000.1234", "2024-01-01T00:00:00Z")], "time string, ns long")


@query("SELECT * FROM (VALUES ('-Inf', '-Infinity'::DOUBLE), ('0x1F', 31.0::DOUBLE), ('017', 15.0::DOUBLE), ('1e3', 1000.0::DOUBLE), ('5m', 300.0::DOUBLE), ('0b1', NULL), ('x', NULL)) t(text, v)")
def scalar_literals(spark, d):
    return spark.createDataFrame([(t, D.scalar_literal(t)) for t in ("-Inf", "0x1F", "017", "1e3", "5m", "0b1", "x")], "text string, v double")


@query("SELECT DISTINCT user_id AS key, CAST(1704067200 + 86400 * n AS BIGINT) AS at FROM events, (SELECT unnest(range(0, 31)) AS n)")
def evaluation_grid(spark, d):
    return D.grid(_month(spark, d), DAY).select("key", "at")


@query("""WITH g AS (SELECT CAST(1704067200 + 86400 * n AS BIGINT) AS time FROM (SELECT unnest(range(0, 31)) AS n)),
p AS (SELECT event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) AS pt, max(value) AS v FROM events GROUP BY 1, 2)
SELECT series, time, arg_max(v, pt) AS v FROM p, g WHERE pt <= time AND pt > time - 21600 GROUP BY 1, 2""")
def evaluated_range(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")).agg(F.max("value").alias("v"))
    return D.evaluate(e, 1704067200, 1704067200 + 30 * DAY, DAY, 21600)


@query("SELECT DISTINCT user_id AS key, user_id % 2 = 0 AS allowed FROM events")
def range_guard(spark, d):
    r = _month(spark, d).withColumn("end", F.when(F.col("key") % 2 == 0, F.col("start") + 7 * DAY).otherwise(F.col("end")))
    return D.checked(r, 7 * DAY).select("key", "allowed")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20 13:00:00'")
def synthetic_upper_bound(spark, d):
    return D.bounded(table(spark, d, "events"), "ts", 1705755600 + 1234, 3600).select("event_id")


# -- delta evaluation --------------------------------------------------------------------


@query("""SELECT DISTINCT user_id AS key, CAST(1704067200 + s * 86400 AS BIGINT) AS start, CAST(1704067200 + e * 86400 AS BIGINT) AS "end" FROM events, (VALUES (0, 4), (25, 30)) x(s, e) WHERE user_id % 2 = 0""")
def refetched_volatile(spark, d):
    """Even users miss the first five days, so their volatile days, the last six, are fetched as well; odd users miss nothing."""
    want = _month(spark, d)
    done = want.withColumn("start", F.when(F.col("key") % 2 == 0, F.col("start") + 5 * DAY).otherwise(F.col("start")))
    volatile = want.withColumn("start", F.lit(1704067200 + 25 * DAY).cast("long"))
    return rollup.missing_with_volatile(want, done, volatile, DAY)


@query("""SELECT DISTINCT user_id AS key, CAST(1704067200 + 27 * 86400 AS BIGINT) AS start, CAST(1704067200 + 30 * 86400 AS BIGINT) AS "end" FROM events""")
def volatile_ranges(spark, d):
    want = _month(spark, d)
    volatile = want.withColumn("start", F.lit(1704067200 + 20 * DAY).cast("long")).withColumn("end", F.lit(1704067200 + 22 * DAY).cast("long"))
    return rollup.volatile_after(volatile, want, volatile, DAY, 1704067200 + 30 * DAY, rollup.backfill_tolerance(DAY, DAY, 3))


@query("WITH b AS (SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1) SELECT bucket, n FROM b WHERE bucket <= 1704067200 + 20 * 86400 UNION ALL SELECT 1704067200 + 20 * 86400 + 3600, -1")
def fast_forward(spark, d):
    last = 1704067200 + 20 * DAY
    p = rollup.partials(table(spark, d, "events"), DAY, []).filter(F.col("bucket") <= last).select("bucket", "n")
    fresh = spark.createDataFrame([(last + 3600, -1), (last, -2)], "bucket long, n long")
    return rollup.fast_forward(p, fresh, last, last, DAY, 15)


@query("""SELECT DISTINCT user_id AS key, CAST(1704067200 + 27 * 86400 AS BIGINT) AS start, CAST(1704067200 + 30 * 86400 AS BIGINT) AS "end" FROM events""")
def missing_mutable_tail(spark, d):
    """All is done, but the last days may still change."""
    want = _month(spark, d)
    return rollup.missing(want, want, DAY, 1704067200 + 30 * DAY, 3 * DAY)


@query("SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS nth FROM events")
def numbered_points(spark, d):
    return order.numbered(table(spark, d, "events").select("event_id", "value"), [F.col("value"), F.col("event_id")]).select("event_id", "nth")
