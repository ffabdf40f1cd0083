"""Merging series of several members point by point: one union, one aggregation."""

from __future__ import annotations

import tempfile
from collections import deque
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.points import NAN, whole

KEY = ("series", "epoch_ns")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def number(v: Column) -> Column:
    """``v`` where it is a number; NaN doesn't count."""
    return F.when(~F.isnan(v), v)


def _or_nan(c: Column) -> Column:
    return F.coalesce(c, F.lit(NAN))


def strategy(name: str, value: str = "v", order: str = "src_order") -> Column:
    """The aggregate of one strategy. NaN counts only where nothing else is there."""
    v, o = F.col(value), F.col(order)
    return {
        "sum": lambda: _or_nan(F.sum(number(v))),
        "min": lambda: _or_nan(F.min(number(v))),
        "max": lambda: _or_nan(F.max(number(v))),
        "avg": lambda: _or_nan(F.sum(number(v)) / F.count(v)),
        "count": lambda: F.count(v).cast("double"),
        "dedup": lambda: F.max_by(v, o),
        "scalar": lambda: F.coalesce(F.min_by(v, F.when(~F.isnan(v), o)), F.lit(NAN)),
    }[name]()


def merge(points: DataFrame, name: str, keys: tuple[str, ...] = KEY, value: str = "v", order: str = "src_order") -> DataFrame:
    """One row per key: ``value`` merged over members in ``order``. Hot keys combine before the shuffle."""
    return points.groupBy(*keys).agg(strategy(name, value, order).alias(value))


def average_over_members(points: DataFrame, members: int, keys: tuple[str, ...] = KEY, value: str = "v") -> DataFrame:
    """Sum over members by their number, also where a member lacks the point."""
    return merge(points, "sum", keys, value).withColumn(value, F.col(value) / F.lit(float(members)))


def settle(df: DataFrame) -> DataFrame:
    """``df`` behind a reliable checkpoint in ``spark.checkpoint.dir``; only a local session that names none gets a folder of its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def tolerance_ns(milliseconds: int) -> int:
    """A tolerance in nanoseconds: none below zero, and no more than a long holds."""
    return min(max(0, milliseconds) * 1_000_000, (1 << 63) - 1)


def dedup_within(points: DataFrame, tolerance_ns: int, slab_ns: int, value: str = "v") -> DataFrame:
    """Drop a point at most ``tolerance_ns`` after the last one kept; the first seen of equal epochs stays.

    The comparison is with the last survivor, so what is kept is a path from the
    series' first point. A path can enter a slab of ``slab_ns`` only up to the
    first point beyond the tolerance after the slab's start: one sorted scan
    tells where each such entry leaves the slab, pointer doubling over entries
    alone marks those the path takes, and a second scan walks each slab from its
    entry. Scans hold the entries of one slab, and no step gathers a series.
    """
    slab = lambda at: whole(at, slab_ns)
    first = points.filter("epoch_ns IS NOT NULL").groupBy("series", "epoch_ns").agg(F.min_by(value, "src_order").alias(value))
    first = settle(first.withColumn("slab", slab(F.col("epoch_ns"))).repartition("series", "slab").sortWithinPartitions("series", "slab", "epoch_ns"))
    series = first.schema["series"].dataType.simpleString()
    exits = settle(first.select("series", "slab", "epoch_ns").mapInArrow(_exits(tolerance_ns), f"series {series}, epoch_ns long, at long"))
    # Where a slab has no entry at or after the sought epoch, the next slab with points has it.
    slabs = exits.groupBy("series", slab(F.col("epoch_ns")).alias("slab")).agg(F.min("epoch_ns").alias("slab_start"))
    probes = exits.filter("at IS NOT NULL").select("series", "at", F.col("epoch_ns").alias("node"), F.lit(None).cast("long").alias("point"))
    own = exits.select("series", F.col("epoch_ns").alias("at"), F.lit(None).cast("long").alias("node"), F.col("epoch_ns").alias("point"))
    onward = Window.partitionBy("series", "slab").orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    sought = probes.unionByName(own).withColumn("slab", slab(F.col("at"))).withColumn("next", F.min("point").over(onward)).filter("node IS NOT NULL")
    # The first point of a later slab, for each slab that is probed: as many rows as slabs.
    probed = sought.filter("next IS NULL").select("series", "slab").distinct().withColumn("slab_start", F.lit(None).cast("long"))
    later = probed.unionByName(slabs).groupBy("series", "slab").agg(F.min("slab_start").alias("slab_start"))
    later = later.select("series", "slab", F.min("slab_start").over(Window.partitionBy("series").orderBy("slab").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    jump = settle(sought.join(later, ["series", "slab"], "left").select("series", F.col("node").alias("epoch_ns"), F.coalesce("next", "later").alias("next")).filter("next IS NOT NULL"))
    kept = settle(exits.groupBy("series").agg(F.min("epoch_ns").alias("epoch_ns")))
    # ``kept`` has a path's first 2^k entries, ``jump`` goes 2^k entries on; what is reached anew isn't in ``kept`` yet.
    while not jump.isEmpty():
        kept = settle(kept.unionByName(kept.join(jump, ["series", "epoch_ns"]).select("series", F.col("next").alias("epoch_ns"))).coalesce(kept.sparkSession.sparkContext.defaultParallelism))
        onto = jump.select("series", F.col("epoch_ns").alias("next"), F.col("next").alias("far"))
        jump = settle(jump.join(onto, ["series", "next"]).select("series", "epoch_ns", F.col("far").alias("next")))
    entries = kept.select("series", slab(F.col("epoch_ns")).alias("slab"), F.col("epoch_ns").alias("entry"))
    entered = first.join(entries, ["series", "slab"]).filter("epoch_ns >= entry").select("series", "epoch_ns", value, "slab")
    entered = entered.repartition("series", "slab").sortWithinPartitions("series", "slab", "epoch_ns")
    return entered.mapInArrow(_walk(tolerance_ns), entered.schema).drop("slab")


def _exits(tolerance: int):
    """Scan of sorted (series, slab, epoch_ns): each entry of a slab with the epoch sought after its path's last point there; null beyond what a long holds."""

    def scan(batches):
        # Paths by their last points, which ascend: those that a point is beyond the tolerance of go on from it as one.
        key, start, beyond, paths = None, 0, False, deque()

        def told(series, kind):
            rows = [(e, last + tolerance + 1) for last, entries in paths for e in entries]
            at = [x if x < 1 << 63 else None for _, x in rows]
            return pa.RecordBatch.from_arrays([pa.array([series] * len(rows), kind), pa.array([e for e, _ in rows], pa.int64()), pa.array(at, pa.int64())], ["series", "epoch_ns", "at"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("series").type
            for series, slab, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (series, slab) != key:
                    if paths:
                        yield told(key[0], kind)
                    key, start, beyond, paths = (series, slab), at, False, deque()
                moved = None
                while paths and at - paths[0][0] > tolerance:
                    entries = paths.popleft()[1]
                    small, moved = (entries, moved) if moved and len(moved) > len(entries) else (moved or [], entries)
                    moved.extend(small)
                if not beyond:
                    moved = [*(moved or []), at]
                    beyond = at - start > tolerance
                if moved:
                    paths.append((at, moved))
        if paths:
            yield told(key[0], kind)

    return scan


def _walk(tolerance: int):
    """Scan of sorted rows: those that are kept, from the first row of each series and slab."""

    def scan(batches):
        key, last = None, 0
        for batch in batches:
            kept = []
            for series, slab, at in zip(*(batch.column(c).to_pylist() for c in ("series", "slab", "epoch_ns")), strict=True):
                keep = (series, slab) != key or at - last > tolerance
                if keep:
                    key, last = (series, slab), at
                kept.append(keep)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return scan


def coalesce_replicas(points: DataFrame, order: str = "replica_order", keys: tuple[str, ...] = KEY) -> DataFrame:
    """Inside a replica group the first configured replica wins; later ones fill gaps."""
    rest = [c for c in points.columns if c not in keys]
    return points.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_")).select(*keys, "_.*")


def conflicts(points: DataFrame, keys: tuple[str, ...] = KEY, value: str = "v") -> DataFrame:
    """Keys whose replicas hold different values, told apart to the last bit: 0.0 and -0.0 differ, all NaN are one."""
    v = F.col(value).cast("string")
    return points.groupBy(*keys).agg(F.min(v).alias("lo"), F.max(v).alias("hi")).filter("lo <> hi").select(*keys)


def ratio(points: DataFrame, total: str, count: str, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Merged ``total`` by merged ``count`` of members that hold both, where the count isn't 0: one scan, one aggregation."""
    both = points.groupBy(*keys).agg(_or_nan(F.sum(number(F.col(total)))).alias("s"), F.sum(count).alias("n"))
    return both.filter("n <> 0").select(*keys, (F.col("s") / F.col("n")).alias("v"))


def _sides(sums: DataFrame, counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per key the merged sum and count of two results, and which of them have the key: one shuffle for both."""
    nothing = F.lit(None).cast("double")
    s = sums.select(*keys, F.col("v").alias("_s"), nothing.alias("_n"), F.lit(True).alias("_is_sum"))
    n = counts.select(*keys, nothing.alias("_s"), F.col("v").alias("_n"), F.lit(False).alias("_is_sum"))
    return s.unionByName(n).groupBy(*keys).agg(
        _or_nan(F.sum(number(F.col("_s")))).alias("s"), _or_nan(F.sum(number(F.col("_n")))).alias("n"),
        F.max(F.col("_is_sum")).alias("has_sum"), F.max(~F.col("_is_sum")).alias("has_count"),
    )


def weighted_average(sums: DataFrame, counts: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """sum / count where both are there and the count isn't 0."""
    return _sides(sums, counts, keys).filter("has_sum AND has_count AND n <> 0").select(*keys, (F.col("s") / F.col("n")).alias("v"))


def unaveraged(sums: DataFrame, counts: DataFrame, keys: tuple[str, ...] = KEY, series: str = "series") -> DataFrame:
    """Per series of ``sums`` the points that ``weighted_average`` leaves out, and whether the series has no count at all: its warnings."""
    lost = F.col("has_sum") & (~F.col("has_count") | (F.col("n") == 0))
    told = _sides(sums, counts, keys).groupBy(series).agg(F.count(F.when(lost, 1)).alias("dropped"), F.max("has_sum").alias("_s"), (~F.max("has_count")).alias("no_count"))
    return told.filter("_s AND dropped > 0").select(series, "dropped", "no_count")


def prune_series(sums: DataFrame, counts: DataFrame, series: str = "series") -> tuple[DataFrame, DataFrame]:
    """Points of series that the other side has as well, and the names of series that it lacks."""
    there = counts.select(series).distinct()
    return sums.join(there, series, "left_semi"), sums.select(series).distinct().join(there, series, "left_anti")


def pair_states(points: DataFrame, keys: tuple[str, ...] = KEY) -> tuple[DataFrame, DataFrame]:
    """(member, keys, n, mean, var) of points that a member has as count, mean and variance, and per member how many were dropped.

    ``points`` has member, variant ('count', 'mean', 'variance') and v. A point
    is dropped if a variant is missing, has two different values, or makes no
    state: counts must be whole and positive, variances not negative.
    """
    value = lambda name: F.when(F.col("variant") == name, F.col("v"))
    one = lambda name: F.min(value(name).cast("string")) == F.max(value(name).cast("string"))
    met = points.groupBy("member", *keys).agg(
        F.max(value("count")).alias("n"), F.max(value("mean")).alias("mean"), F.max(value("variance")).alias("var"), F.coalesce(one("count") & one("mean") & one("variance"), F.lit(False)).alias("paired")
    )
    n, var = F.col("n"), F.col("var")
    whole = ~F.isnan(n) & (n > 0) & (n < float("inf")) & (F.floor(n) == n)
    told = met.withColumn("good", F.col("paired") & whole & (F.isnan(var) | (var >= 0)))
    return told.filter("good").select("member", *keys, "n", "mean", "var"), told.filter("NOT good").groupBy("member").agg(F.count(F.lit(1)).alias("dropped"))


def pooled_variance(states: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """(n, mean, var) states of members into one population variance, by Chan's rule; NaN and infinity spread.

    One scan and one shuffle: a point's members are as few as the federation has.
    """
    n, m, v = F.col("n"), F.col("mean"), F.col("var")
    # Means are centred on one of them before squaring, which keeps the digits.
    centred = states.filter("n > 0").withColumn("_d", m - F.min(m).over(Window.partitionBy(*keys)))
    sums = centred.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(n * F.col("_d")).alias("d1"), F.sum(n * (v + F.col("_d") ** 2)).alias("d2"))
    variance = F.col("d2") / F.col("n") - (F.col("d1") / F.col("n")) ** 2
    return sums.select(*keys, F.when(F.isnan(variance), F.lit(NAN)).otherwise(F.greatest(variance, F.lit(0.0))).alias("v"))


def variance_of(points: DataFrame, keys: tuple[str, ...], value: str = "v") -> DataFrame:
    """Population variance of merged inner values; one value gives 0, NaN and infinity give NaN."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return points.groupBy(*keys).agg(F.when(F.min(finite), F.var_pop(value)).otherwise(F.lit(NAN)).alias(value))


def group(points: DataFrame, keys: tuple[str, ...], value: str = "v") -> DataFrame:
    """1 for each key that has a point."""
    return points.select(*keys).distinct().withColumn(value, F.lit(1.0))


def count_values(points: DataFrame, keys: tuple[str, ...], value: Column, label: str) -> DataFrame:
    """How many points of a key have each value, which becomes the label ``label``."""
    return points.groupBy(*keys, value.alias(label)).agg(F.count(F.lit(1)).alias("count"))


def complete_points(points: DataFrame, variants: int, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Points of members that have all variants of the point."""
    whole = points.groupBy("member", *keys).agg(F.countDistinct("variant").alias("c")).filter(F.col("c") == variants).drop("c")
    return points.join(whole, ["member", *keys], "left_semi")


def complete_members(points: DataFrame, variants: int) -> DataFrame:
    """Points of members that answered with all variants of the query."""
    whole = points.groupBy("member").agg(F.countDistinct("variant").alias("c")).filter(F.col("c") == variants).select("member")
    return points.join(whole, "member", "left_semi")


def drop_mixed(points: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Without points that are both a value and a histogram."""
    one = points.groupBy(*keys).agg(F.min("kind").alias("a"), F.max("kind").alias("b")).filter("a = b").select(*keys)
    return points.join(one, list(keys), "left_semi")
