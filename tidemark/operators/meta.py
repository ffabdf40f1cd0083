"""Merging metadata of several members: labels, label sets, alerts; and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.points import sorted_tags, tags_json


def label_values(rows: DataFrame, column: str, inject: str | None = None) -> DataFrame:
    """Distinct values in order; an injected label's value is one of them."""
    found = rows.select(column).filter(F.col(column).isNotNull())
    if inject is not None:
        found = found.unionByName(rows.sparkSession.range(1).select(F.lit(inject).alias(column)))
    return found.distinct().orderBy(column)


def label_names(rows: DataFrame, tags: str = "tags", inject: dict[str, str] | None = None) -> DataFrame:
    """Distinct label names in order, injected ones among them."""
    found = rows.select(F.explode(F.map_keys(tags)).alias("name"))
    if inject:
        found = found.unionByName(rows.sparkSession.createDataFrame([(k,) for k in inject], "name string"))
    return found.distinct().orderBy("name")


def stripped_labels(members: DataFrame, tags: str = "injected") -> DataFrame:
    """Names of the labels that any member injects: those to strip before a merge."""
    return members.select(F.explode(F.map_keys(tags)).alias("name")).distinct()


def label_sets(rows: DataFrame, key: str = "series") -> DataFrame:
    return rows.dropDuplicates([key])


def alerts(rows: DataFrame, keys: list[str], order: str = "src_order") -> DataFrame:
    """Of equal alerts the most severe state (inactive < pending < firing) stays; the first of equals."""
    severity = F.when(F.col("state") == "firing", 2).when(F.col("state") == "pending", 1).otherwise(0)
    by = Window.partitionBy(*keys).orderBy(severity.desc(), F.col(order))
    return rows.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def counters(points: DataFrame) -> DataFrame:
    """Series, points, timestamps, values (points with one) and size (bytes of text and 16 a point) of a result."""
    size = F.sum(F.octet_length(F.col("v").cast("string")) + 16) if "v" in points.columns else F.count(F.lit(1)) * 16
    values = F.count("v") if "v" in points.columns else F.count(F.lit(1))
    return points.agg(
        F.countDistinct("series").alias("series_count"), F.count(F.lit(1)).alias("point_count"), F.countDistinct("epoch_ns").alias("timestamp_count"), values.alias("value_count"), size.cast("long").alias("size")
    )


def route(rows: DataFrame, routes: DataFrame, key: str, default: str) -> DataFrame:
    """A row's route by a table of routes, else the default."""
    return rows.join(routes, key, "left").withColumn("route", F.coalesce("route", F.lit(default)))


def round_robin(rows: DataFrame, order: str, members: int) -> DataFrame:
    """Member of each row, in turn along a dense integer order."""
    return rows.withColumn("member", F.pmod(F.col(order), F.lit(members)))


def weighted_round_robin(rows: DataFrame, order: str, weights: list[int]) -> DataFrame:
    """Member of each row, in turn along a dense integer order; a member comes as often in a row as its weight says."""
    turns = [member for member, w in enumerate(weights) for _ in range(w)]
    at = F.pmod(F.col(order), F.lit(len(turns))).cast("int")
    return rows.withColumn("member", F.element_at(F.array(*[F.lit(t) for t in turns]), at + 1))


def replica_groups(members: DataFrame) -> DataFrame:
    """(group_id, members, first): members (name, order) of each replica group in configured order.

    A member's group is the one it names, else its own name, else its place.
    """
    text = lambda c: F.when(F.trim(c) != "", F.col(c))
    group = F.coalesce(text("replica_group"), text("name"), F.concat(F.lit("member-"), F.col("order").cast("string")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("order", "name"))), lambda x: x["name"])
    return members.groupBy(group.alias("group_id")).agg(listed.alias("members"), F.min("order").alias("first"))


def merge_envelopes(rows: DataFrame, keys: list[str], order: str = "src_order") -> DataFrame:
    """One (status, error, warnings) of the members' envelopes: success if one succeeds, and errors of others become warnings.

    The envelopes of a key are as many as the federation has members.
    """
    kind = "struct<status:string,error:string,warnings:array<string>>"
    none = F.array().cast("array<string>")
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct("status", F.coalesce("error", F.lit("")).alias("error"), F.coalesce("warnings", none).alias("warnings")).cast(kind).alias("e"))))

    def fold(a: Column, x: Column) -> Column:
        e = x["e"]
        warnings = F.concat(a["warnings"], F.when(e["error"] != "", F.array(e["error"])).otherwise(none), e["warnings"])
        turns = (a["status"] == "error") & (e["status"] == "success")
        return F.struct(
            F.when(turns, F.lit("success")).otherwise(a["status"]).alias("status"),
            F.when(turns, F.lit("")).otherwise(a["error"]).alias("error"),
            F.when(turns, F.concat(warnings, F.array(a["error"]))).otherwise(warnings).alias("warnings"),
        ).cast(kind)

    listed = rows.groupBy(*keys).agg(each.alias("all"))
    merged = F.aggregate(F.slice("all", 2, 1 << 30), F.get("all", F.lit(0))["e"], fold)
    return listed.select(*keys, merged.alias("m")).select(*keys, "m.*")


def instant_merge(answers: DataFrame, keys: list[str], order: str = "src_order") -> DataFrame:
    """Of members' instant answers (status, result_type, v), which take part: the vectors, or one scalar.

    Errors yield to anything. Where the first good answer is a scalar, the first
    scalar that is a number stands for all, else the first; otherwise all
    vectors go on to be merged. If all are errors, the first stays.
    """
    bad = F.col("status") == "error"
    per_key = Window.partitionBy(*keys)
    scalar = ~bad & (F.col("result_type") == "scalar")
    first_type = F.min(F.when(~bad, F.struct(F.col(order), F.col("result_type")))).over(per_key)["result_type"]
    best = F.min(F.when(scalar, F.struct(F.isnan("v").cast("int"), F.col(order)))).over(per_key)
    seen = answers.withColumn("_type", first_type).withColumn("_best", best).withColumn("_first", F.min(order).over(per_key))
    is_best = scalar & (F.col("_best") == F.struct(F.isnan("v").cast("int"), F.col(order)))
    keep = F.when(F.col("_type").isNull(), F.col(order) == F.col("_first")).when(F.col("_type") == "scalar", is_best).otherwise(~bad & (F.col("result_type") != "scalar"))
    return seen.filter(keep).drop("_type", "_best", "_first")


def usable(answers: DataFrame, status: str = "status_code") -> DataFrame:
    """Answers that can contribute: those that came at all, with a status under 400."""
    return answers.filter(F.col(status) < 400)


def all_failed(answers: DataFrame, keys: list[str], status: str = "status_code") -> DataFrame:
    """Keys of which no answer is usable."""
    return answers.groupBy(*keys).agg(F.max(F.coalesce(F.col(status) < 400, F.lit(False))).alias("_ok")).filter("NOT _ok").select(*keys)


def different_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """Points that one table has more often than the other; none if the tables are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def series_keys(points: DataFrame, series: str = "series") -> DataFrame:
    """The distinct series of a result, in order."""
    return points.select(series).distinct().orderBy(series)


def alert_json(rows: DataFrame) -> DataFrame:
    """One JSON object per alert (labels, annotations, state, value)."""
    return rows.select(F.to_json(F.struct(sorted_tags(F.col("labels")).alias("labels"), sorted_tags(F.col("annotations")).alias("annotations"), "state", "value")).alias("json"))


def series_json(rows: DataFrame, tags: str = "tags") -> DataFrame:
    """One JSON object per distinct label set."""
    return rows.select(tags_json(F.col(tags)).alias("json")).distinct()


def labels_json(rows: DataFrame, column: str) -> DataFrame:
    """One JSON string per distinct value, in order."""
    quoted = F.to_json(F.struct(F.col(column).alias("v")))
    return label_values(rows, column).select(column, F.substr(quoted, F.lit(6), F.length(quoted) - 6).alias("json")).orderBy(column).select("json")
