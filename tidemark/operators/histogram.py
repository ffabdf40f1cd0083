"""Histograms as rows of buckets (series, epoch_ns, lower, upper, count): parsing, adding, scaling, coarsening, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.once import once

KEY = ["series", "epoch_ns"]
#: Fields of a native histogram on the wire, the schema of custom bounds, and the range of the exponential ones.
WIRE = """struct<count:string,sum:string,schema:int,zero_threshold:double,zero_count:string,
negative_spans:array<struct<offset:int,length:int>>,negative_deltas:array<bigint>,negative_counts:array<string>,
positive_spans:array<struct<offset:int,length:int>>,positive_deltas:array<bigint>,positive_counts:array<string>,
buckets:array<array<string>>,custom_values:array<double>>"""
CUSTOM, COARSEST, FINEST = -53, -4, 8
BUCKET = "struct<lower:double,upper:double,count:double,lower_in:boolean,upper_in:boolean>"
_INF = float("inf")


def _bucket(lower: Column, upper: Column, count: Column, lower_in: Column, upper_in: Column) -> Column:
    return F.struct(lower.cast("double").alias("lower"), upper.cast("double").alias("upper"), count.cast("double").alias("count"), lower_in.alias("lower_in"), upper_in.alias("upper_in"))


def _none() -> Column:
    return F.array().cast(f"array<{BUCKET}>")


def _bound(index: Column, h: Column) -> Column:
    """Upper bound of the bucket with this index by the histogram's schema."""
    schema, custom = h["schema"], h["custom_values"]
    listed = F.when(index == -1, F.lit(-_INF)).when(index == F.size(custom), F.lit(_INF)).otherwise(F.get(custom, index))
    power = F.pow(F.lit(2.0), index.cast("double") * F.pow(F.lit(2.0), -schema.cast("double")))
    # The bucket that would end at 2^1024 ends at the largest double.
    return F.when(schema == CUSTOM, listed).otherwise(F.when(power == _INF, F.lit(1.7976931348623157e308)).otherwise(power))


def _span_buckets(h: Column, sign: str) -> Column:
    """Buckets of one sign: spans give the indices, counts or running sums of deltas the counts; null where they don't fit together."""
    spans, deltas, counts = (F.coalesce(h[f"{sign}_{x}"], F.array().cast(t)) for x, t in (("spans", "array<struct<offset:int,length:int>>"), ("deltas", "array<bigint>"), ("counts", "array<string>")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    ints = lambda a, n: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (a + i).cast("int"))).otherwise(F.array().cast("array<int>"))
    step = lambda acc, s: F.struct((acc["at"] + s["offset"] + s["length"]).cast("int").alias("at"), F.concat(acc["out"], ints(acc["at"] + s["offset"], s["length"])).alias("out"))
    index = F.aggregate(spans, start, step)["out"]
    begun = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("out"))
    running = F.aggregate(deltas, begun, lambda a, d: F.struct((a["n"] + d).alias("n"), F.concat(a["out"], F.array((a["n"] + d).cast("double"))).alias("out")))["out"]
    given = F.when(F.size(counts) > 0, F.transform(counts, lambda c: c.try_cast("double"))).otherwise(running)
    positive = sign == "positive"

    def made(pair: Column) -> Column:
        i = pair["i"]
        low, high = _bound(i - 1, h), _bound(i, h)
        if positive:
            return _bucket(low, high, pair["c"], (h["schema"] == CUSTOM) & (i == 0), F.lit(True))
        return _bucket(-high, -low, pair["c"], F.lit(True), F.lit(False))

    def fitted(index: Column, given: Column) -> Column:
        pairs = F.filter(F.zip_with(index, given, lambda i, c: F.struct(i.alias("i"), c.alias("c"))), lambda p: p["c"] != 0)
        return F.when(F.size(index) == F.size(given), F.transform(pairs, made))

    return once(index, lambda i: once(given, lambda g: fitted(i, g)))


def _histogram(h: Column) -> Column:
    """total_count, total_sum and buckets of a histogram as it is on the wire."""
    num = lambda c: h[c].try_cast("double")
    mode = lambda b: F.get(b, F.lit(0)).try_cast("int")
    at = lambda b, i: F.get(b, F.lit(i)).try_cast("double")
    listed = F.transform(h["buckets"], lambda b: _bucket(at(b, 1), at(b, 2), at(b, 3), mode(b).isin(1, 3), mode(b).isin(0, 3)))
    listed_good = F.forall(h["buckets"], lambda b: (F.size(b) == 4) & mode(b).between(0, 3) & ~F.isnan(at(b, 1)) & (at(b, 1) <= at(b, 2)) & at(b, 3).isNotNull())
    zero = F.coalesce(F.when(h["zero_count"] != "", num("zero_count")), F.lit(0.0))
    width = F.coalesce(h["zero_threshold"], F.lit(0.0))
    middle = F.when(zero != 0, F.array(_bucket(-width, width, zero, F.lit(True), F.lit(True)))).otherwise(_none())
    spans = F.concat(middle, _span_buckets(h, "negative"), _span_buckets(h, "positive"))
    kept_out = F.transform(
        spans,
        lambda b: _bucket(
            F.when((b["lower"] > 0) & (b["lower"] < width), width).otherwise(b["lower"]),
            F.when((b["upper"] < 0) & (b["upper"] > -width), -width).otherwise(b["upper"]), b["count"], b["lower_in"], b["upper_in"],
        ),
    )
    explicit = F.size(F.coalesce(h["buckets"], F.array())) > 0
    schema_fits = (h["schema"] == CUSTOM) | F.coalesce(h["schema"], F.lit(0)).between(COARSEST, FINEST)
    buckets = F.when(explicit, F.when(listed_good, listed)).otherwise(F.when(schema_fits, kept_out))
    return F.struct(num("count").alias("total_count"), num("sum").alias("total_sum"), F.sort_array(buckets).alias("buckets"))


def parse(rows: DataFrame, column: str = "v_raw") -> DataFrame:
    """``rows`` with total_count, total_sum and buckets (sorted) of histograms written as JSON.

    Explicit buckets count before spans; the zero bucket is as wide as its
    threshold, and no other reaches into it. Rows that make no histogram
    (numbers that aren't, spans and counts that don't fit together, a schema
    out of range, bounds the wrong way round) are left out. A text is read
    once: what tests and what shows its buckets comes out of one generator,
    which no filter is pushed through.
    """
    whole = lambda x: x["total_count"].isNotNull() & x["total_sum"].isNotNull() & x["buckets"].isNotNull() & ~F.exists(x["buckets"], lambda b: b["lower"].isNull() | b["upper"].isNull())
    read = F.filter(F.transform(F.array(F.from_json(column, WIRE)), _histogram), whole)
    kept = [c for c in rows.columns if c not in ("total_count", "total_sum", "buckets")]
    return rows.select(*kept, F.explode(read).alias("_h")).select(*kept, "_h.*")


def rows_of(histograms: DataFrame) -> DataFrame:
    """One row per bucket of parsed histograms."""
    return histograms.select(*[c for c in histograms.columns if c != "buckets"], F.explode("buckets").alias("b")).select("*", "b.*").drop("b")


def add(buckets: DataFrame) -> DataFrame:
    """The sum over members. Buckets of different layouts are joined where they overlap; empty ones go.

    Buckets may tell whether their bounds belong to them (lower_in, upper_in);
    those that touch in a bound of both overlap.
    """
    told = buckets if "lower_in" in buckets.columns else buckets.withColumn("lower_in", F.lit(False)).withColumn("upper_in", F.lit(True))
    equal = told.groupBy(*KEY, "lower", "upper").agg(F.sum("count").alias("count"), F.max("lower_in").alias("lower_in"), F.max("upper_in").alias("upper_in"))
    order = Window.partitionBy(*KEY).orderBy("lower", "upper").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.struct("upper", "upper_in")).over(order)
    meets = (F.col("lower") < reach["upper"]) | ((F.col("lower") == reach["upper"]) & reach["upper_in"] & F.col("lower_in"))
    run = F.sum("_new").over(Window.partitionBy(*KEY).orderBy("lower", "upper"))
    joined = equal.withColumn("_new", F.when(meets, 0).otherwise(1)).withColumn("_run", run).groupBy(*KEY, "_run").agg(
        F.min("lower").alias("lower"), F.max("upper").alias("upper"), F.sum("count").alias("count"),
        F.min(F.struct("lower", (~F.col("lower_in")).alias("out"))).alias("_l"), F.max(F.struct("upper", "upper_in")).alias("_u"),
    )
    out = joined.filter("count <> 0").select(*KEY, "lower", "upper", "count", (~F.col("_l.out")).alias("lower_in"), F.col("_u.upper_in").alias("upper_in"))
    return out if "lower_in" in buckets.columns else out.drop("lower_in", "upper_in")


def divide(buckets: DataFrame, by: float) -> DataFrame:
    """Counts (and totals, where there are any) by a number; dividing by 0 gives no rows."""
    if by == 0:
        return buckets.limit(0)
    cut = buckets
    for c in ("count", "total_count", "total_sum"):
        cut = cut.withColumn(c, F.col(c) / F.lit(float(by))) if c in buckets.columns else cut
    return cut


def totals(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy(*KEY).agg(F.sum("count").alias("count"))


def number_text(x: Column) -> Column:
    """Shortest decimal of a number; without an exponent from 1e-6 up to 1e21."""
    plain = F.regexp_replace(x.cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
    whole = F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(plain)
    parts = x.cast("string")
    exponent = F.regexp_extract(parts, "E(-?)([0-9]+)", 2)
    sign = F.when(F.regexp_extract(parts, "E(-?)([0-9]+)", 1) == "-", "-").otherwise("+")
    scientific = F.concat(F.regexp_replace(F.substring_index(parts, "E", 1), r"\.0$", ""), F.lit("e"), sign, F.when(F.length(exponent) < 2, F.concat(F.lit("0"), exponent)).otherwise(exponent))
    size = F.abs(x)
    return F.when(F.isnan(x), "NaN").when(x == _INF, "+Inf").when(x == -_INF, "-Inf").when((size != 0) & ((size < 1e-6) | (size >= 1e21)), scientific).otherwise(whole)


def write(buckets: DataFrame, sums: DataFrame) -> DataFrame:
    """One JSON histogram (column v_raw) per series and epoch, of its buckets and of total_count and total_sum in ``sums``; empty buckets aren't written."""
    mode = F.when(F.col("lower_in") & F.col("upper_in"), 3).when(F.col("lower_in"), 1).when(F.col("upper_in"), 0).otherwise(2)
    text = lambda c: F.concat(F.lit('"'), number_text(F.col(c)), F.lit('"'))
    each = F.concat(F.lit("["), F.concat_ws(",", mode.cast("string"), text("lower"), text("upper"), text("count")), F.lit("]"))
    listed = buckets.filter("count <> 0").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("lower", "upper", each.alias("j")))).alias("bs"))
    body = F.when(F.col("bs").isNotNull(), F.concat(F.lit(',"buckets":['), F.array_join(F.transform("bs", lambda b: b["j"]), ","), F.lit("]"))).otherwise("")
    joined = sums.join(listed, KEY, "left")
    return joined.select(*KEY, F.concat(F.lit('{"count":'), text("total_count"), F.lit(',"sum":'), text("total_sum"), body, F.lit("}")).alias("v_raw"))
