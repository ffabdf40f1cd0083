"""Rollups that are kept up to date: by a stream with a watermark, or gap by gap in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import intervals

ROLLUP = "n long, total double, low double, high double"


def partials(points: DataFrame, step: int, keys: list[str], value: str = "value", ts: str = "ts") -> DataFrame:
    """Mergeable states per bucket: count, sum, min, max. ``step`` is in seconds."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    v = F.col(value)
    return points.groupBy(*keys, (at - F.pmod(at, F.lit(step))).alias("bucket")).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))


def combine(states: DataFrame, keys: list[str]) -> DataFrame:
    return states.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def stream(points: DataFrame, step: int, keys: list[str], late: str, value: str = "value", ts: str = "ts") -> DataFrame:
    """The rollup of a stream; events later than ``late`` behind the newest are dropped."""
    timed = points.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    v = F.col(value)
    rolled = timed.groupBy(F.window("_ts", f"{step} seconds"), *keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))
    return rolled.select(*keys, F.unix_seconds("window.start").alias("bucket"), "n", "total", "low", "high")


def missing(requested: DataFrame, done: DataFrame, step: int, now: int, tolerance: int = 0) -> DataFrame:
    """Ranges (key, start, end) to compute: requested, minus those done before the still changing tail."""
    stable = done.withColumn("end", F.least("end", F.lit((now - tolerance) // step * step - step))).filter("start <= end")
    return intervals.subtract(requested, stable, step)


def backfill_tolerance(default: int, step: int, points: int = 0, own: int | None = None) -> int:
    """Seconds in which buckets may still change: a query's own, none if that is negative, else the longer of the default and ``points`` steps."""
    if own:
        return max(0, own)
    return max(default, points * step)


def missing_with_volatile(requested: DataFrame, done: DataFrame, volatile: DataFrame, step: int) -> DataFrame:
    """Missing ranges and, of keys that miss something, those volatile ones that are requested: a full hit fetches nothing anew."""
    gaps = intervals.subtract(requested, done, step)
    asked = requested.select(F.col("key").alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    held = volatile.join(asked, F.col("key") == F.col("_k")).select("key", F.greatest("start", "_s").alias("start"), F.least("end", "_e").alias("end")).filter("start <= end")
    again = held.join(gaps.select("key").distinct(), "key", "left_semi")
    return intervals.compress(gaps.unionByName(again), step)


def volatile_after(volatile: DataFrame, requested: DataFrame, fetched: DataFrame, step: int, now: int, tolerance: int) -> DataFrame:
    """Volatile ranges after a fetch: what was fetched anew is settled, and the requested tail within the tolerance is volatile."""
    since = now - tolerance
    tail = requested.filter(F.col("end") > since).select("key", F.greatest("start", F.lit(since)).alias("start"), "end")
    return intervals.compress(intervals.remove(volatile.select("key", "start", "end"), fetched, step).unionByName(tail), step)


def fast_forward(points: DataFrame, freshest: DataFrame, requested_end: int, last: int, step: int, ttl: int, at: str = "bucket") -> DataFrame:
    """``points`` and the freshest ones, if the request is for the last whole step, they are newer than it, and steps are longer than ``ttl``."""
    if step <= ttl or requested_end != last:
        return points
    return points.unionByName(freshest.filter(F.col(at) > last))


def status(requested: DataFrame, done: DataFrame, step: int) -> DataFrame:
    """Per key: kmiss (nothing known), hit (all there), rmiss (nothing of the range), phit (a part)."""
    gaps = intervals.subtract(requested, done, step).groupBy("key").agg(F.sum((F.col("end") - F.col("start")) / step + 1).alias("gap"))
    need = requested.groupBy("key").agg(F.sum((F.col("end") - F.col("start")) / step + 1).alias("need"))
    known = done.select("key").distinct().withColumn("known", F.lit(True))
    said = F.when(F.col("known").isNull(), "kmiss").when(F.col("gap").isNull(), "hit").when(F.col("gap") == F.col("need"), "rmiss").otherwise("phit")
    return need.join(gaps, "key", "left").join(known, "key", "left").select("key", said.alias("status"))


def refresh(spark: SparkSession, points: DataFrame, stored: DataFrame | None, gaps: list[tuple[int, int]], step: int, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """The rollup with the gaps (closed ranges of bucket starts) computed anew; only their rows are scanned."""
    if not gaps:
        return stored
    raw = F.col(ts)
    wanted, inside = F.lit(False), F.lit(False)
    for start, end in gaps:
        edge = lambda s: F.timestamp_seconds(F.lit(s)).cast("timestamp_ntz")
        wanted = wanted | ((raw >= edge(start)) & (raw < edge(end + step)))
        inside = inside | F.col("bucket").between(start, end)
    new = partials(points.filter(wanted), step, keys, value, ts)
    return new if stored is None else stored.filter(~inside).unionByName(new)


def retain(states: DataFrame, now: int, step: int, points: int) -> DataFrame:
    """The newest ``points`` buckets before now."""
    return states.filter(F.col("bucket").between(now - step * points, now))


def start_upsert(rolled: DataFrame, path: str, checkpoint: str):
    """Write each batch's buckets in update mode to its own folder; ``latest`` reads the newest of each."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return rolled.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(f"{path}/batch=*")
    return rows.groupBy(*keys, "bucket").agg(F.max_by(F.struct("n", "total", "low", "high"), "batch").alias("_")).select(*keys, "bucket", "_.*")
