"""Dashboard wire formats as DataFrames of points, and back.

Readers take a DataFrame of documents (column ``doc``); writers give rows of
text, so that Spark's own sources and sinks do the reading and writing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.points import NS, parse_epoch, parse_value, rfc3339, tags_json, whole
from tidemark.operators import intervals

ENVELOPE = "struct<status:string,error:string,errorType:string,warnings:array<string>,data:struct<resultType:string,result:string>>"
SERIES = "array<struct<metric:map<string,string>,values:array<array<string>>,histograms:array<array<string>>,value:array<string>,histogram:array<string>>>"
INFLUX = "struct<results:array<struct<statement_id:int,series:array<struct<name:string,tags:map<string,string>,columns:array<string>,values:array<array<string>>>>>>>"


def read_results(docs: DataFrame) -> DataFrame:
    """Points of matrix, vector and scalar documents: result_type, tags, series, kind ('value' or 'histogram'), epoch_ns, v_raw, v.

    A series with values and histograms gives rows of both kinds; v_raw of a
    histogram is its JSON, v is null. Points at or before the epoch, or
    malformed, are dropped.
    """
    parsed = docs.select(F.from_json("doc", ENVELOPE).alias("d")).select(F.coalesce("d.data.resultType", F.lit("matrix")).alias("result_type"), F.col("d.data.result").alias("result"))
    pair = lambda kind, p: F.struct(F.lit(kind).alias("kind"), p.alias("p"))
    none = F.array().cast("array<array<string>>")
    one = lambda p: F.when(F.size(p) == 2, F.array(p)).otherwise(none)
    listed = parsed.filter("result_type <> 'scalar'").select("result_type", F.explode(F.from_json("result", SERIES)).alias("r"))
    values = F.coalesce("r.values", one(F.col("r.value")), none)
    histograms = F.coalesce("r.histograms", one(F.col("r.histogram")), none)
    series = listed.select("result_type", F.col("r.metric").alias("tags"), F.explode(F.concat(F.transform(values, lambda p: pair("value", p)), F.transform(histograms, lambda p: pair("histogram", p)))).alias("x"))
    no_tags = F.create_map().cast("map<string,string>")
    scalars = parsed.filter("result_type = 'scalar'").select("result_type", no_tags.alias("tags"), pair("value", F.from_json("result", "array<string>")).alias("x"))
    rows = series.unionByName(scalars).select("result_type", F.coalesce("tags", no_tags).alias("tags"), "x.kind", "x.p").filter(F.size("p") == 2)
    at = F.round(F.get("p", F.lit(0)).try_cast("double") * 1000).cast("long") * 1_000_000
    points = rows.select("result_type", "tags", tags_json(F.col("tags")).alias("series"), "kind", at.alias("epoch_ns"), F.get("p", F.lit(1)).alias("v_raw"))
    return points.withColumn("v", F.when(F.col("kind") == "value", parse_value(F.col("v_raw")))).filter("epoch_ns > 0 AND v_raw IS NOT NULL")


def read_matrix(docs: DataFrame) -> DataFrame:
    """The values alone of ``read_results``: tags, series, epoch_ns, v_raw, v."""
    return read_results(docs).filter("kind = 'value'").select("tags", "series", "epoch_ns", "v_raw", "v")


def envelope(data: Column, status: str = "success", error: str = "", error_type: str = "", warnings: list[str] | None = None) -> Column:
    """A whole response around ``data`` (JSON); empty parts aren't written."""
    head = {"status": status} | ({"error": error} if error else {}) | ({"errorType": error_type} if error_type else {}) | ({"warnings": warnings} if warnings else {})
    return F.concat(F.lit(json.dumps(head, ensure_ascii=False, separators=(",", ":"))[:-1]), F.when(data.isNotNull(), F.concat(F.lit(',"data":'), data)).otherwise(""), F.lit("}"))


def result(objects: Column, result_type: str) -> Column:
    """The data part of a response that holds ``objects``."""
    open_, close = ("[", "]") if result_type != "scalar" else ("", "")
    return F.concat(F.lit(f'{{"resultType":"{result_type}","result":{open_}'), objects, F.lit(f"{close}}}"))


def _chunk(step_ns: int, factor: int):
    """The aligned chunk of ``factor`` steps that a point is in."""
    return F.floor(F.col("epoch_ns") / (step_ns * factor)).alias("chunk")


def _seconds() -> Column:
    return F.regexp_replace((F.col("epoch_ns").cast("decimal(20,0)") / NS).cast("decimal(20,9)").cast("string"), r"\.?0+$", "")


def _pair() -> Column:
    """[seconds, value]; a histogram's JSON as it is, a value as a string."""
    is_value = F.col("kind") == "value"
    mark = F.when(is_value, F.lit('"')).otherwise("")
    return F.concat(F.lit("["), _seconds(), F.lit(","), mark, F.col("v_raw"), mark, F.lit("]"))


def _kinds(points: DataFrame) -> DataFrame:
    return points if "kind" in points.columns else points.withColumn("kind", F.lit("value"))


def write_matrix(points: DataFrame, step_ns: int = NS, factor: int = 420) -> DataFrame:
    """One JSON object per series and aligned chunk of ``factor`` steps: metric, values and histograms, each in time order."""
    pair = F.struct("epoch_ns", _pair().alias("p"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, pair))).alias(kind)
    grouped = _kinds(points).groupBy("series", _chunk(step_ns, factor)).agg(of("value"), of("histogram"))
    body = lambda kind, name: F.when(F.size(kind) > 0, F.concat(F.lit(f',"{name}":['), F.array_join(F.transform(kind, lambda x: x["p"]), ","), F.lit("]"))).otherwise("")
    return grouped.select("series", F.concat(F.lit('{"metric":'), F.col("series"), body("value", "values"), body("histogram", "histograms"), F.lit("}")).alias("json"))


def write_vector(points: DataFrame) -> DataFrame:
    """One JSON object per series with its first point; of a value and a histogram the histogram is written."""
    first = F.min(F.struct((F.col("kind") == "value").alias("late"), F.col("epoch_ns"), F.when(F.col("kind") == "value", "value").otherwise("histogram").alias("name"), _pair().alias("p"))).alias("x")
    return _kinds(points).groupBy("series").agg(first).select("series", F.concat(F.lit('{"metric":'), F.col("series"), F.lit(',"'), F.col("x.name"), F.lit('":'), F.col("x.p"), F.lit("}")).alias("json"))


def write_scalar(points: DataFrame) -> DataFrame:
    """One row: the first point as [seconds, "value"], or [] of no points."""
    first = _kinds(points).agg(F.min(F.struct("epoch_ns", _pair().alias("p"))).alias("x"))
    return first.select(F.coalesce("x.p", F.lit("[]")).alias("json"))


def read_influx(docs: DataFrame) -> DataFrame:
    """Long rows (statement, name, tags, epoch_ns, field, value) of multi-statement results."""
    series = docs.select(F.from_json("doc", INFLUX).alias("d")).select(F.explode("d.results").alias("r")).select("r.statement_id", F.explode("r.series").alias("s"))
    rows = series.select("statement_id", "s.name", "s.tags", "s.columns", F.explode("s.values").alias("row"))
    at = F.greatest(F.array_position("columns", "time"), F.array_position("columns", "_time"))
    timed = rows.filter((at > 0) & (F.size("columns") > 1)).withColumn("epoch_ns", parse_epoch(F.get("row", (at - 1).cast("int"))))
    cells = timed.select("statement_id", "name", "tags", "epoch_ns", F.explode(F.arrays_zip("columns", "row")).alias("c")).filter("c.columns NOT IN ('time', '_time')")
    return cells.filter("epoch_ns IS NOT NULL").select("statement_id", "name", "tags", "epoch_ns", F.col("c.columns").alias("field"), F.col("c.row").alias("value"))


def write_influx(points: DataFrame, unit: str | None = "ms", step_ns: int = NS, factor: int = 420) -> DataFrame:
    """One JSON object per series and aligned chunk of ``factor`` steps: columns, tags, values.

    Times are whole numbers of ``unit``, or RFC 3339 without one. What JSON has
    no number for (NaN, infinities) is null.
    """
    at = F.concat(F.lit('"'), rfc3339(F.col("epoch_ns")), F.lit('"')) if unit is None else whole(F.col("epoch_ns"), NS // {"s": 1, "ms": 1000, "us": 10**6, "ns": NS}[unit]).cast("string")
    v = F.col("v")
    number = F.when(F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull(), "null").otherwise(v.cast("string"))
    pair = F.struct("epoch_ns", F.concat(F.lit("["), at, F.lit(","), number, F.lit("]")).alias("p"))
    grouped = points.groupBy("series", _chunk(step_ns, factor)).agg(F.array_sort(F.collect_list(pair)).alias("ps"))
    return grouped.select("series", F.concat(F.lit('{"columns":["time","value"],"tags":'), F.col("series"), F.lit(',"values":['), F.array_join(F.transform("ps", lambda x: x["p"]), ","), F.lit("]}")).alias("json"))


def detect(method: str, content_type: str = "", accept: str = "") -> str:
    """Format of a request: influxql-get, influxql-post, flux-json-json, flux-json-csv, flux-raw-json, flux-raw-csv or unknown."""
    if method.upper() != "POST":
        return "influxql-get" if method.upper() == "GET" else "unknown"
    kind, out = content_type.split(";")[0].strip().lower(), "json" if "application/json" in accept.lower() else "csv"
    return {"application/x-www-form-urlencoded": "influxql-post", "application/json": f"flux-json-{out}", "application/vnd.flux": f"flux-raw-{out}"}.get(kind, "unknown")


def write_chunks(points: DataFrame, path: str, step_ns: int, factor: int = 420) -> None:
    """Parquet partitioned by aligned chunks of ``factor`` steps, so that a range reads its chunks only."""
    width = step_ns * factor
    points.withColumn("chunk", F.col("epoch_ns") - F.pmod("epoch_ns", F.lit(width))).write.mode("append").partitionBy("chunk").parquet(path)


def chunk_extents(points: DataFrame, step_ns: int) -> DataFrame:
    """(key, start, end) of the ranges that stored points cover, those of neighbouring chunks joined."""
    return intervals.from_points(points.select(F.col("series").alias("key"), F.col("epoch_ns").alias("at")), step_ns)


def read_chunks(spark, path: str, step_ns: int, start_ns: int, end_ns: int, factor: int = 420) -> DataFrame:
    width = step_ns * factor
    rows = spark.read.parquet(path).filter(F.col("chunk").between(start_ns // width * width, end_ns // width * width))
    return rows.filter(F.col("epoch_ns").between(start_ns, end_ns)).drop("chunk")
