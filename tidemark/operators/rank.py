"""Selections per group and epoch: top k, first k label sets, hash samples, instant sorts, quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.points import NAN, limit_hash
from tidemark.operators.order import running_sum


def _value_order(v: str, largest: bool) -> list[Column]:
    """NaN last in both directions."""
    return [F.isnan(v).cast("int").asc(), F.col(v).desc() if largest else F.col(v).asc()]


def top(points: DataFrame, k: int, groups: list[str], largest: bool = True, value: str = "v", tie: str = "series") -> DataFrame:
    """The k largest (or smallest) per group; ties by label set. Groups are trimmed before the shuffle."""
    order = Window.partitionBy(*groups).orderBy(*_value_order(value, largest), F.col(tie))
    return points.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def first_series(points: DataFrame, k: int, groups: list[str], tie: str = "series") -> DataFrame:
    """Points of the k first label sets per group; a value and a histogram of one label set count once."""
    order = Window.partitionBy(*groups).orderBy(tie)
    return points.withColumn("_r", F.dense_rank().over(order)).filter(F.col("_r") <= k).drop("_r")


def hash_sample(points: DataFrame, ratio: float, tags: str = "tags") -> DataFrame:
    """Series whose label hash is below ``ratio``; a negative ratio takes the other end."""
    share = limit_hash(F.col(tags))
    return points.filter(share < ratio) if ratio >= 0 else points.filter(share >= 1 + ratio)


def instant_sort(points: DataFrame, largest: bool = False, value: str = "v", tie: str = "series", at: str | None = None) -> DataFrame:
    """A vector in order of value, without histograms.

    With the column ``at`` given, a table where a series has several points, or
    points are at several epochs, is no vector: it stays as it is.
    """
    only = points.filter("kind = 'value'") if "kind" in points.columns else points
    if at is not None and not is_vector(only, tie, at):
        return points
    return only.orderBy(*_value_order(value, largest), tie)


def is_vector(points: DataFrame, series: str, at: str) -> bool:
    """Whether each series has one point, all at one epoch."""
    told = points.groupBy(series).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("a"), F.max(at).alias("b")).agg(F.max("n"), F.min("a"), F.max("b")).first()
    return told[0] is None or (told[0] == 1 and told[1] == told[2])


def range_sort(points: DataFrame) -> tuple[DataFrame, list[str]]:
    """Sorting a range result does nothing but warn."""
    return points, ["sort is ineffective for range queries"]


def record_limit(points: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows in an order, as a query's record limit asks for; 0 is no limit."""
    return points.orderBy(*order).limit(n) if n else points.orderBy(*order)


def by_tags(points: DataFrame, series: str = "series", name: str = "name") -> DataFrame:
    """In order of the label set, then the name; nulls last."""
    return points.orderBy(F.col(series).asc_nulls_last(), F.col(name).asc_nulls_last())


def quantile(points: DataFrame, phi: float, groups: list[str], value: str = "v") -> DataFrame:
    """Exact quantile with linear interpolation. phi outside 0 to 1 gives an infinity; NaN values sort first.

    Distinct values are counted, range-partitioned and numbered, so a group of
    any size is in as many tasks as it needs; each group then takes the two
    values around its rank.
    """
    if phi != phi or phi < 0 or phi > 1:
        return points.groupBy(*groups).agg(F.lit(NAN if phi != phi else float("-inf") if phi < 0 else float("inf")).alias(value))
    counted = points.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    placed = running_sum(counted, groups, [(~F.isnan(value)).cast("int"), F.col(value)], "n", "upto", "all").withColumn("rank", F.lit(phi) * (F.col("all") - 1))
    has = lambda at: (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
    low, high = F.floor("rank"), F.ceil("rank")
    ends = placed.groupBy(*groups).agg(F.max(F.when(has(low), F.col(value))).alias("a"), F.max(F.when(has(high), F.col(value))).alias("b"), F.max(F.col("rank") - low).alias("w"))
    return ends.select(*groups, F.when(F.col("w") == 0, F.col("a")).otherwise(F.col("a") * (1 - F.col("w")) + F.col("b") * F.col("w")).alias(value))


def pick_winner(rows: DataFrame, keys: list[str], status: str, order: str) -> DataFrame:
    """Per key the first row with a 2xx status in configured order, else the first usable (one with a status)."""
    good = F.col(status).between(200, 299)
    by = Window.partitionBy(*keys).orderBy(good.desc(), F.col(order))
    return rows.filter(F.col(status).isNotNull()).withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def newest(rows: DataFrame, keys: list[str], modified: str, status: str, order: str) -> DataFrame:
    """Per key the row modified last (the first of equals), else the first good one, else the first."""
    good = F.col(status).between(200, 299)
    by = Window.partitionBy(*keys).orderBy(F.col(modified).desc_nulls_last(), good.desc(), F.col(order))
    return rows.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def first_good(rows: DataFrame, keys: list[str], status: str, arrival: str) -> DataFrame:
    """Per key the response that arrived first of those below 400."""
    by = Window.partitionBy(*keys).orderBy(arrival)
    return rows.filter(F.col(status) < 400).withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def merged_status(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """The smallest 2xx of a group, else its largest status."""
    s = F.col(status)
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(s.between(200, 299), s)), F.max(s)).alias(status))
