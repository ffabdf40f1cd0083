"""Operators on values the tables don't have: NaN, ties, empty inputs, streams."""

import json
import math
import random
import re
import tempfile

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.functions import durations as D
from tidemark.functions import points as P
from tidemark.functions import rules as R
from tidemark.operators import histogram, intervals, merge, meta, order, rank
from tidemark.plans import registry
from tidemark.sources import formats, tables, wire
from tidemark.streaming import rollup

NAN = float("nan")


def points(spark, rows):
    return spark.createDataFrame(rows, "series string, epoch_ns long, v double, src_order int")


@pytest.mark.parametrize("how, want", [("sum", 3.0), ("min", 1.0), ("max", 2.0), ("avg", 1.0), ("count", 3.0), ("scalar", 1.0), ("dedup", 2.0)])
def test_nan_is_skipped(spark, how, want):
    assert merge.merge(points(spark, [("a", 1, NAN, 0), ("a", 1, 1.0, 1), ("a", 1, 2.0, 2)]), how).first()["v"] == want


def test_only_nan_stays_nan(spark):
    assert all(math.isnan(merge.merge(points(spark, [("a", 1, NAN, 0)]), how).first()["v"]) for how in ("sum", "min", "max", "scalar"))


def test_dedup_compares_with_the_last_kept(spark):
    p = points(spark, [("a", e, float(e), 0) for e in (0, 4, 8, 9, 20)])
    for slab in (3, 10, 1000):
        assert sorted(r["epoch_ns"] for r in merge.dedup_within(p, 5, slab).collect()) == [0, 8, 20]


def test_dedup_gathers_no_series(spark):
    rows = [(s, 3 * i + (i * i) % 2, float(i), 0) for s in "ab" for i in range(300)] + [("b", 5000, 1.0, 0), ("b", 5001, 2.0, 0)]
    want, last = [], {}
    for s, e, v, _ in sorted(rows):
        if s not in last or e - last[s] > 7:
            want.append((s, e, v))
            last[s] = e
    got = merge.dedup_within(points(spark, rows), 7, 50)
    assert sorted(map(tuple, got.collect())) == want
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_dedup_doubles_over_slabs_alone(spark, monkeypatch):
    calls, settle = [], merge.settle
    monkeypatch.setattr(merge, "settle", lambda df: calls.append(1) or settle(df))
    r = random.Random(4)
    rows = [(s, e, float(e), 0) for s in "abc" for e in sorted(r.sample(range(-900, 900), 300))]
    want, last = [], {}
    for s, e, v, _ in rows:
        if s not in last or e - last[s] > 7:
            want.append((s, e, v))
            last[s] = e
    assert sorted(map(tuple, merge.dedup_within(points(spark, rows), 7, 2000).collect())) == want
    # Two slabs: the path of some 180 points takes no round for each doubling of its length.
    assert len(calls) <= 8


def test_pooled_variance(spark):
    d = spark.createDataFrame([("a", 1, 2.0, 1.5, 0.25), ("a", 1, 1.0, 4.0, 0.0), ("b", 1, 1.0, NAN, 0.0)], "series string, epoch_ns long, n double, mean double, var double")
    got = {r["series"]: r["v"] for r in merge.pooled_variance(d).collect()}
    assert got["a"] == pytest.approx(14 / 9) and math.isnan(got["b"])


def test_top_puts_nan_last_and_breaks_ties(spark):
    p = points(spark, [("b", 1, 5.0, 0), ("a", 1, 5.0, 0), ("c", 1, NAN, 0), ("d", 1, 1.0, 0)])
    assert [r["series"] for r in rank.top(p, 1, ["epoch_ns"]).collect()] == ["a"]
    assert sorted(r["series"] for r in rank.top(p, 3, ["epoch_ns"], False).collect()) == ["a", "b", "d"]
    assert rank.top(p, 0, ["epoch_ns"]).count() == 0


@pytest.mark.parametrize("phi, want", [(0.9, 3.6), (0.0, 1.0), (1.0, 4.0), (-1.0, -math.inf), (2.0, math.inf)])
def test_quantile(spark, phi, want):
    p = points(spark, [("a", 1, v, 0) for v in (1.0, 2.0, 4.0)])
    assert rank.quantile(p, phi, ["epoch_ns"]).first()["v"] == pytest.approx(want)


@pytest.mark.parametrize("tags", [{}, {"a": "b"}, {"job": "x" * 300, "instance": "h:9090"}, {"b": "é", "a": ""}])
def test_limit_hash_is_seed_zero(spark, tags):
    # XXH64 with seed 0 of the sorted labels, each behind its length: a byte, or 0xFF and three bytes.
    prefixed = lambda s: (bytes([len(s)]) if len(s) < 255 else b"\xff" + len(s).to_bytes(3, "little")) + s
    data = b"".join(prefixed(k.encode()) + prefixed(v.encode()) for k, v in sorted(tags.items()))
    share = spark.createDataFrame([(tags,)], "t map<string,string>").select(P.limit_hash(F.col("t")).alias("h")).first()["h"]
    assert share == pytest.approx(xxhash.xxh64_intdigest(data) / 2**64)


def test_subtract(spark):
    need = spark.createDataFrame([("k", 0, 100)], "key string, start long, end long")
    have = lambda *x: spark.createDataFrame([("k", a, b) for a, b in x] or [("z", 0, 0)], "key string, start long, end long")
    gaps = lambda h: sorted((r["start"], r["end"]) for r in intervals.subtract(need, h, 10).collect())
    assert gaps(have()) == [(0, 100)] and gaps(have((0, 100))) == [] and gaps(have((20, 30), (40, 50), (90, 200))) == [(0, 10), (60, 80)]
    assert gaps(have((-50, 0))) == [(10, 100)] and intervals.subtract(need, have(), 0).count() == 0


def test_histograms_of_two_layouts(spark):
    d = spark.createDataFrame([("a", 1, 0.0, 1.0, 2.0), ("a", 1, 0.0, 2.0, 3.0), ("a", 1, 2.0, 3.0, 1.0)], "series string, epoch_ns long, lower double, upper double, count double")
    assert sorted(tuple(r)[2:] for r in histogram.add(d).select("series", "epoch_ns", "lower", "upper", "count").collect()) == [(0.0, 2.0, 5.0), (2.0, 3.0, 1.0)]


def test_rules(spark):
    d = spark.createDataFrame([("12",), ("x",)], "v string")
    got = d.select(R.number_rule("bt", F.col("v"), "10-20"), R.number_rule("modulo", F.col("v"), "5"), R.string_rule("rmatch", F.col("v"), "("), R.string_rule("modulo", F.col("v"), "7")).collect()
    assert [tuple(r) for r in got] == [("true", "2", "false", str((49 + 50) % 7)), ("", None, "false", str(120 % 7))]


def test_wire_influx(spark):
    doc = '{"results":[{"statement_id":0,"series":[{"name":"m","tags":{"a":"b"},"columns":["time","x"],"values":[[1704067200000,1.5],[null,2]]}]}]}'
    got = wire.read_influx(spark.createDataFrame([(doc,)], "doc string")).collect()
    assert [(r["epoch_ns"], r["field"], r["value"]) for r in got] == [(1704067200 * P.NS, "x", "1.5")]


def test_writers_bound_their_objects(spark):
    p = spark.createDataFrame([('{"a":"b"}', e * P.NS, str(e), float(e)) for e in range(1, 100)], "series string, epoch_ns long, v_raw string, v double")
    docs = wire.write_matrix(p, P.NS, 10)
    assert docs.count() == 10 == wire.write_influx(p, "ms", P.NS, 10).count()
    back = wire.read_matrix(docs.select(F.concat(F.lit('{"data":{"result":['), "json", F.lit("]}}")).alias("doc")))
    assert sorted((r["series"], r["epoch_ns"], r["v"]) for r in back.collect()) == [('{"a":"b"}', e * P.NS, float(e)) for e in range(1, 100)]


def test_subtract_equals_grid(spark):
    r = random.Random(1)
    ranges = lambda n: [(k, a, a + 10 * r.randint(0, 6)) for k in "ab" for a in (10 * r.randint(0, 60) for _ in range(n))]
    needs, haves = [("a", 0, 200), ("a", 300, 500), ("b", 100, 400), ("c", 0, 50)], ranges(12)
    frame = lambda rows: spark.createDataFrame(rows, "key string, start long, end long")
    there = {(k, x) for k, a, b in haves for x in range(a, b + 1, 10)}
    want = {(k, x) for k, a, b in needs for x in range(a, b + 1, 10)} - there
    got = intervals.subtract(frame(needs), frame(haves), 10).collect()
    assert sorted((g["key"], x) for g in got for x in range(g["start"], g["end"] + 1, 10)) == sorted(want)


def test_splice_covers_each_range_once(spark):
    r = random.Random(2)
    rows = [(str(i), a, a + 10 * r.randint(0, 40)) for i, a in enumerate(10 * r.randint(0, 50) for _ in range(60))]
    frame = spark.createDataFrame(rows, "key string, start long, end long")
    for kw in ({"most": 70}, {"most": 120, "cadence": 120}, {"points": 5}):
        got = intervals.splice_any(frame, 10, **kw).collect()
        assert sorted((g["key"], x) for g in got for x in range(g["start"], g["end"] + 1, 10)) == sorted((k, x) for k, a, b in rows for x in range(a, b + 1, 10))
        assert all(g["end"] - g["start"] <= kw.get("most", 40) for g in got)
        assert all(g["start"] // 120 == g["end"] // 120 for g in got if "cadence" in kw)


def test_quantile_of_many_values(spark):
    r = np.random.default_rng(3)
    rows = [(g, 1, float(v), 0) for g, n in (("a", 3000), ("b", 7)) for v in r.normal(size=n).round(2)]
    got = {x["series"]: x["v"] for x in rank.quantile(points(spark, rows), 0.37, ["series"]).collect()}
    assert all(got[g] == pytest.approx(np.quantile([x[2] for x in rows if x[0] == g], 0.37)) for g in "ab")


def test_numbered(spark):
    rows = [(i, (i * 7919) % 1000) for i in range(1000)]
    got = order.numbered(spark.createDataFrame(rows, "i int, k int"), [F.col("k")]).collect()
    assert all(x["nth"] == x["k"] for x in got)


def test_conflicts_by_bits(spark):
    p = points(spark, [("a", 1, 0.0, 0), ("a", 1, -0.0, 1), ("b", 1, NAN, 0), ("b", 1, NAN, 1)])
    assert [x["series"] for x in merge.conflicts(p).collect()] == ["a"]


def test_envelopes_in_order(spark):
    rows = [(1, 0, "error", "first", ["w0"]), (1, 1, "success", None, ["w1"]), (1, 2, "error", "late", None), (2, 0, "error", "x", None), (2, 1, "error", "y", None)]
    d = spark.createDataFrame(rows, "k int, src_order int, status string, error string, warnings array<string>")
    got = {x["k"]: (x["status"], x["error"], x["warnings"]) for x in meta.merge_envelopes(d, ["k"]).collect()}
    assert got == {1: ("success", "", ["w0", "w1", "first", "late"]), 2: ("error", "x", ["y"])}


def test_instant_sort_needs_a_vector(spark):
    two = points(spark, [("a", 1, 2.0, 0), ("b", 1, 1.0, 0)])
    assert [x["series"] for x in rank.instant_sort(two, at="epoch_ns").collect()] == ["b", "a"]
    kinds = two.withColumn("kind", F.when(F.col("series") == "a", "histogram").otherwise("value"))
    assert [x["series"] for x in rank.instant_sort(kinds).collect()] == ["b"]
    assert not rank.is_vector(points(spark, [("a", 1, 2.0, 0), ("a", 2, 1.0, 0)]), "series", "epoch_ns")


def test_histograms_that_touch(spark):
    rows = [("a", 1, -1.0, 1.0, 2.0, True, True), ("a", 1, 1.0, 2.0, 3.0, True, False), ("a", 1, 2.0, 4.0, 1.0, True, True)]
    d = spark.createDataFrame(rows, "series string, epoch_ns long, lower double, upper double, count double, lower_in boolean, upper_in boolean")
    assert sorted(tuple(x)[2:] for x in histogram.add(d).collect()) == [(-1.0, 2.0, 5.0, True, False), (2.0, 4.0, 1.0, True, True)]
    assert histogram.divide(d, 0).count() == 0


def test_histograms_that_are_none(spark):
    bad = ['{"count":"x","sum":"1"}', '{"count":"1","sum":"1","schema":9}', '{"count":"1","sum":"1","positive_spans":[{"offset":0,"length":2}],"positive_deltas":[1]}', '{"count":"1","sum":"1","buckets":[[0,"2","1","1"]]}', None]
    good = ['{"count":"1","sum":"1","buckets":[[3,"-1","1","1"]]}', '{"count":"0","sum":"0"}', '{"count":"1","sum":"1","schema":-1,"positive_spans":[{"offset":1,"length":1}],"positive_deltas":[1]}']
    got = histogram.parse(spark.createDataFrame([(x,) for x in bad + good], "v_raw string")).collect()
    assert [x["v_raw"] for x in got] == good
    assert [tuple(b) for b in got[2]["buckets"]] == [(1.0, 4.0, 1.0, False, True)] and [tuple(b) for b in got[0]["buckets"]] == [(-1.0, 1.0, 1.0, True, True)]


def test_histograms_are_read_once(spark):
    d = spark.createDataFrame([('{"count":"1","sum":"1","schema":-53,"custom_values":[1.5],"positive_spans":[{"offset":0,"length":2}],"positive_counts":["4","8"]}',)], "v_raw string")
    got = histogram.divide(histogram.rows_of(histogram.parse(d)), 4)
    assert [(x["lower"], x["upper"], x["count"]) for x in got.collect()] == [(-math.inf, 1.5, 1.0), (1.5, math.inf, 2.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_numbers_of_histograms(spark):
    d = spark.createDataFrame([(x,) for x in (1.0, 0.1, 1e21, 1e-7, math.inf, -2.5, 0.0)], "x double")
    assert [r[0] for r in d.select(histogram.number_text(F.col("x"))).collect()] == ["1", "0.1", "1e+21", "1e-07", "+Inf", "-2.5", "0"]


def test_influx_json_has_no_nan(spark):
    p = spark.createDataFrame([("{}", 1, NAN), ("{}", 1_500_000_000, 1.5)], "series string, epoch_ns long, v double")
    assert [json.loads(r["json"])["values"] for r in wire.write_influx(p, None).collect()] == [[["1970-01-01T00:00:00.000000001Z", None], ["1970-01-01T00:00:01.5Z", 1.5]]]


def test_results_of_all_types(spark):
    docs = ['{"status":"success","data":{"resultType":"scalar","result":[5,"1.5"]}}', '{"data":{"resultType":"vector","result":[{"metric":{"a":"b"},"value":[5,"2"]},{"metric":{},"histogram":[6,{"count":"1"}]}]}}',
            '{"data":{"resultType":"matrix","result":[{"metric":{"a":"b"},"values":[[0,"1"],[7.5,"NaN"]],"histograms":[[8,{"sum":"2"}]]}]}}', "{", '{"status":"error","error":"x"}']
    got = sorted((r["result_type"], r["kind"], r["epoch_ns"], r["v_raw"]) for r in wire.read_results(spark.createDataFrame([(x,) for x in docs], "doc string")).collect())
    assert got == [("matrix", "histogram", 8 * P.NS, '{"sum":"2"}'), ("matrix", "value", 7_500_000_000, "NaN"), ("scalar", "value", 5 * P.NS, "1.5"), ("vector", "histogram", 6 * P.NS, '{"count":"1"}'), ("vector", "value", 5 * P.NS, "2")]
    both = spark.createDataFrame([("{}", 5 * P.NS, "2", "value"), ("{}", 5 * P.NS, '{"a":1}', "histogram")], "series string, epoch_ns long, v_raw string, kind string")
    assert wire.write_vector(both).first()["json"] == '{"metric":{},"histogram":[5,{"a":1}]}' and wire.write_matrix(both).first()["json"] == '{"metric":{},"values":[[5,"2"]],"histograms":[[5,{"a":1}]]}'
    assert wire.write_scalar(both.limit(0)).first()["json"] == "[]"


def test_annotated_tables(spark):
    doc = '#datatype,string,long,dateTime:RFC3339,double,string\n#group,false,false,false,false,true\n#default,_result,,,7,\n,result,table,_time,_value,host\n,,0,2024-01-01T00:00:00Z,1.5,"a,""b"""\n,,0,2024-01-01T00:00:01.5Z,,x\n,,0,broken\n\n#datatype,string,long,dateTime:RFC3339,long\n#group,false,false,false,false\n#default,_r,,,\n,result,table,_time,n\n,,1,2024-01-01T00:00:02Z,3\n'
    got = sorted((r["result"], r["series"], r["epoch_ns"], r["field"], r["v"]) for r in tables.read_annotated(spark.createDataFrame([(doc,)], "doc string")).collect())
    t = 1704067200 * P.NS
    assert got == [("_r", "{}", t + 2 * P.NS, "n", 3.0), ("_result", '{"host":"a,\\"b\\""}', t, "_value", 1.5), ("_result", '{"host":"x"}', t + 1_500_000_000, "_value", 7.0)]
    assert formats.of("annotated").read is tables.read_annotated
    with pytest.raises(ValueError):
        formats.of("none")


def test_rewrites(spark):
    d = spark.createDataFrame([("http://a.b:80/x/y?k=1&z=2&k=3",), ("nothing",)], "u string")
    u = F.col("u")
    got = d.select(R.rewrite(u, "param", "delete", "k", "1"), R.rewrite(u, "param", "replace", "k", "3", "4"), R.rewrite(u, "hostname", "replace", "a", "c"), R.expand("${0}!", u, "^n")).collect()
    assert tuple(got[0]) == ("http://a.b:80/x/y?z=2&k=3", "http://a.b:80/x/y?k=1&z=2&k=4", "http://c.b:80/x/y?k=1&z=2&k=3", "${0}!") and tuple(got[1]) == ("nothing",) * 3 + ("n!",)


def test_annotated_lines_are_read_once(spark):
    doc = '#datatype,string,long,dateTime:RFC3339,double,string\n#group,false,false,false,false,true\n#default,_r,,,,\n,result,table,_time,_value,host\n,,0,2024-01-01T00:00:00Z,1.5,x\n,,0,none,2.5,x\n'
    got = tables.read_annotated(spark.createDataFrame([(doc,)], "doc string"))
    assert [(x["result"], x["series"], x["v"]) for x in got.collect()] == [("_r", '{"host":"x"}', 1.5)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(line") <= 2


def test_chains_of_rewrites_stay_small(spark):
    d = spark.createDataFrame([("http://a.b:80/x/y?k=1",)], "u string")
    steps = [("port", "delete"), ("path", "replace", "/x/", "/z/"), ("params", "delete")]
    size = lambda n: d.select(R.rewrite_all(F.col("u"), steps * n))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract")
    assert d.select(R.rewrite_all(F.col("u"), steps * 2)).first()[0] == "http://a.b/z/y" and size(2) == 2 * size(1)


def test_rewrites_split_urls_as_one_pattern_does(spark):
    whole = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#:]*)(:[0-9]+)?([^?#]*)(\?[^#]*)?")
    r, some = random.Random(5), ["http", "s", "://", ":", "80", "/", "/", "a", "b.c", "?", "&", "x=1", "#", "é", "\n", "", "+", "-"]
    urls = ["".join(r.choice(some) for _ in range(r.randint(0, 9))) for _ in range(400)] + ["http://" + "".join(r.choice(some) for _ in range(r.randint(0, 9))) for _ in range(1200)] + [None]
    u = F.col("u")
    d = spark.createDataFrame([(x,) for x in urls], "u string").select("u", R.rewrite(u, "scheme", "set", "x").alias("scheme"), R.rewrite(u, "hostname", "set", "H").alias("host"), R.rewrite(u, "port", "set", "9").alias("port"), R.rewrite(u, "path", "set", "/P").alias("path"), R.rewrite(u, "params", "set", "q").alias("params"), R.rewrite(u, "host", "replace", "b", "B").alias("both"))
    for row in d.collect():
        m = whole.match(row.u or "")
        if not m:
            assert tuple(row) == (row.u,) * 7
            continue
        scheme, host, port, path, query = ((g or "") for g in m.groups())
        join = lambda s=scheme, h=host, p=port, a=path, q=query: s + "://" + h + p + a + (q if q != "?" else "")
        assert tuple(row)[1:] == (join(s="x"), join(h="H"), join(p=":9"), join(a="/P"), join(q="?q"), join(h=host.replace("b", "B"))), row.u


def test_rewrites_match_few_patterns_and_are_spread(spark):
    plan = spark.createDataFrame([("http://a.b:80/x/y?k=1",)], "u string").select(R.rewrite(F.col("u"), "port", "delete").alias("x"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract") + plan.count("rlike") <= 2
    assert registry.queries()["url_rewrites"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_range_guard_and_union():
    D.check_range(0, 10, 10)
    D.check_range(0, 10, 0)
    with pytest.raises(D.QueryRangeExceeded):
        D.check_range(0, 11, 10)


def test_tolerance():
    assert [merge.tolerance_ns(x) for x in (-5, 3, 1 << 62)] == [0, 3_000_000, (1 << 63) - 1]


def test_union_of_members(spark):
    both = merge.union_all([points(spark, [("a", 1, 1.0, 0)]), points(spark, [("a", 1, 2.0, 1)]).drop("src_order")])
    assert both.count() == 2 and both.filter("src_order IS NULL").count() == 1


def test_chunks(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/c"
    wire.write_chunks(points(spark, [("a", e, 1.0, 0) for e in range(0, 1000, 10)]), path, 10, 7)
    assert wire.read_chunks(spark, path, 10, 95, 300, 7).count() == 21


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "k", float(i)) for i in range(60)], "i int, t string, k string, value double").withColumn("ts", F.to_timestamp("t"))
    rows.repartition(3).write.parquet(f"{base}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    rollup.start_upsert(rollup.stream(source, 600, ["k"], "1 day"), f"{base}/out", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, rollup.latest(spark, f"{base}/out", ["k"]).collect()))
    assert got == sorted(map(tuple, rollup.partials(rows, 600, ["k"]).collect()))
