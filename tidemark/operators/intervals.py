"""Interval sets on a grid as DataFrames of closed ranges (key, start, end)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a list that would fall into more pieces than this isn't split.
MOST_PIECES = 1 << 20


def compress(extents: DataFrame, step: int, key: str = "key", *same: str) -> DataFrame:
    """Ranges that touch or are one step apart become one; ``same`` columns must agree for that."""
    order = Window.partitionBy(key, *same).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("start") > reach + step) | reach.isNull()
    marked = extents.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(order))
    return marked.groupBy(key, *same, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def from_points(points: DataFrame, step: int, key: str = "key", at: str = "at") -> DataFrame:
    """Ranges of consecutive grid points."""
    return compress(points.select(key, F.col(at).alias("start"), F.col(at).alias("end")).distinct(), step, key)


def crop(extents: DataFrame, start: int, end: int) -> DataFrame:
    cut = extents.withColumn("start", F.greatest("start", F.lit(start))).withColumn("end", F.least("end", F.lit(end)))
    return cut.filter("start <= end")


def subtract(needs: DataFrame, haves: DataFrame, step: int, key: str = "key") -> DataFrame:
    """What ``needs`` (disjoint ranges) has and ``haves`` (any ranges) has not. Without haves all is needed; a step of 0 needs none.

    A sweep: starts and ends of both are counted per place, and a stretch that
    is needed and not there is a gap. No range meets another.
    """
    if step == 0:
        return needs.limit(0).select(key, "start", "end")
    edge = lambda df, at, want, have: df.select(F.col(key).alias("_k"), at.alias("_at"), F.lit(want).alias("_w"), F.lit(have).alias("_h"))
    after = F.col("end") + step
    events = edge(needs, F.col("start"), 1, 0).unionByName(edge(needs, after, -1, 0)).unionByName(edge(haves, F.col("start"), 0, 1)).unionByName(edge(haves, after, 0, -1))
    places = events.groupBy("_k", "_at").agg(F.sum("_w").alias("_w"), F.sum("_h").alias("_h"))
    order = Window.partitionBy("_k").orderBy("_at")
    swept = places.select(F.col("_k").alias(key), F.col("_at").alias("start"), (F.lead("_at").over(order) - step).alias("end"), F.sum("_w").over(order).alias("_w"), F.sum("_h").over(order).alias("_h"))
    return swept.filter("_w > 0 AND _h = 0 AND start <= end").select(key, "start", "end")


def remove(extents: DataFrame, gone: DataFrame, step: int, key: str = "key") -> DataFrame:
    """``extents`` without ``gone``: what is left ends a step before it and goes on a step behind it."""
    return subtract(extents, gone, step, key)


def bounds_test(extents: DataFrame, start: int, end: int, key: str = "key") -> DataFrame:
    """Per key whether its ranges, by their first start and last end, encompass a range, are encompassed by it, or lie outside."""
    told = extents.groupBy(key).agg(F.min("start").alias("a"), F.max("end").alias("b"))
    s, e = F.lit(start), F.lit(end)
    return told.select(key, ((s >= F.col("a")) & (e <= F.col("b"))).alias("encompasses"), ((F.col("a") >= s) & (F.col("b") <= e)).alias("encompassed"), ((s > F.col("b")) | (F.col("a") > e)).alias("outside"))


def splice(extents: DataFrame, step: int, points: int) -> DataFrame:
    """Ranges of ``points`` grid points at most."""
    width = step * points
    pieces = extents.select("*", F.explode(F.sequence("start", "end", F.lit(width))).alias("_s"))
    return pieces.withColumn("end", F.least(F.col("_s") + width - step, F.col("end"))).withColumn("start", F.col("_s")).drop("_s")


def _floor(x: Column, step: int) -> Column:
    return x - F.pmod(x, F.lit(step))


def _piece(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("s"), end.cast("long").alias("e"))


def _chunks(start: Column, end: Column, step: int, most: int) -> Column:
    """Pieces no wider than ``most``, whose ends are on the grid of ``step``."""
    width = max(step, most // step * step)
    first = F.least(F.greatest(_floor(start + (most - step), step), start), end)
    rest = F.when(first + step <= end, F.transform(F.sequence(first + step, end, F.lit(width)), lambda s: _piece(s, F.least(s + (width - step), end))))
    return F.concat(F.array(_piece(start, first)), F.coalesce(rest, F.array().cast("array<struct<s:bigint,e:bigint>>")))


def _spliced(extents: DataFrame, pieces: Column) -> DataFrame:
    return extents.withColumn("_p", F.explode(pieces)).withColumn("start", F.col("_p.s")).withColumn("end", F.col("_p.e")).drop("_p")


def splice_by_time(extents: DataFrame, step: int, most: int) -> DataFrame:
    """Ranges no wider than ``most``, ends truncated to the step. Wide enough ones, and all without a step or width, stay whole."""
    if not step or not most:
        return extents
    start, end = F.col("start"), F.col("end")
    return _spliced(extents, F.when(end - start <= most, F.array(_piece(start, end))).otherwise(_chunks(start, end, step, most)))


def splice_aligned(extents: DataFrame, step: int, most: int, cadence: int) -> DataFrame:
    """As ``splice_by_time``, but the first piece ends before a multiple of ``cadence``."""
    if not step or not most or not cadence:
        return extents
    start, end = F.col("start"), F.col("end")
    fits = lambda a, b: (b - a <= most) & (_floor(a, cadence) == _floor(b, cadence))
    border = start + F.pmod(-start, F.lit(cadence))
    before = _floor(border, step)
    head_end = F.greatest(F.when(before >= border, before - step).otherwise(before), start)
    has_head = border > start
    onward = F.when(has_head, head_end + step).otherwise(start)
    head = F.when(has_head, F.array(_piece(start, head_end))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))
    rest = F.when(onward > end, F.array().cast("array<struct<s:bigint,e:bigint>>")).when(fits(onward, end), F.array(_piece(onward, end))).otherwise(_chunks(onward, end, step, most))
    return _spliced(extents, F.when(fits(start, end), F.array(_piece(start, end))).otherwise(F.concat(head, rest)))


def splice_any(extents: DataFrame, step: int, most: int = 0, cadence: int = 0, points: int = 0, key: str = "key", cap: int = MOST_PIECES) -> DataFrame:
    """Splits by points if given, else by time, aligned if a cadence is given; a key's list that would fall into more than ``cap`` pieces stays whole."""
    width = step * points if points else max(most, step)
    if not step or not width:
        return extents
    sized = extents.withColumn("_n", F.sum(F.floor((F.col("end") - F.col("start")) / width) + 2).over(Window.partitionBy(key)))
    few, many = sized.filter(F.col("_n") <= cap).drop("_n"), sized.filter(F.col("_n") > cap).drop("_n")
    done = splice(few, step, points) if points else splice_aligned(few, step, most, cadence) if cadence else splice_by_time(few, step, most)
    return done.unionByName(many)


def timestamp_count(extents: DataFrame, step: int, key: str = "key") -> DataFrame:
    return extents.groupBy(key).agg(F.sum((F.col("end") - F.col("start")) / step + 1).cast("long").alias("timestamps"))


def points_in(points: DataFrame, extents: DataFrame, step: int, chunk: int, key: str = "key", at: str = "at") -> DataFrame:
    """Points inside any range: an equi-join on (key, chunk), ranges cut at chunk borders first."""
    cut = extents.select(key, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor(F.col("end") / chunk))).alias("_c"))
    in_chunk = points.withColumn("_c", F.floor(F.col(at) / chunk))
    ranges = cut.select(F.col(key).alias("_k"), F.col("_c").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return in_chunk.join(ranges, (F.col(key) == F.col("_k")) & (F.col("_c") == F.col("_d")) & F.col(at).between(F.col("_s"), F.col("_e")), "left_semi").drop("_c")


def evict(extents: DataFrame, keep: int, step: int, before: int, used: tuple[int, int], key: str = "key") -> DataFrame:
    """What is left when the least recently used ranges go until ``keep`` timestamps remain.

    Ranges that overlap the running request ``used`` or start after ``before``
    never go, even where more than ``keep`` timestamps remain.
    """
    count = (F.col("end") - F.col("start")) / step + 1
    fixed = ((F.col("end") >= used[0]) & (F.col("start") <= used[1])) | (F.col("start") > before)
    order = Window.partitionBy(key, "_fixed").orderBy("last_used", "start").rowsBetween(Window.unboundedPreceding, -1)
    held = extents.withColumn("_fixed", fixed).withColumn("_all", F.sum(count).over(Window.partitionBy(key))).withColumn("_gone", F.coalesce(F.sum(count).over(order), F.lit(0)))
    return held.filter(F.col("_fixed") | (F.col("_all") - F.col("_gone") <= keep)).drop("_fixed", "_all", "_gone")


def mark_used(extents: DataFrame, start: int, end: int, now: int, step: int, key: str = "key") -> DataFrame:
    """Ranges split at the edges of a request, the part inside stamped with ``now``, and equal neighbours joined."""
    s, e = F.col("start"), F.col("end")
    part = lambda a, b, used: F.struct(a.cast("long").alias("s"), b.cast("long").alias("e"), used.cast("long").alias("u"))
    lo, hi = F.greatest(s, F.lit(start)), F.least(e, F.lit(end))
    before = F.when(s < start, part(s, lo - step, F.col("last_used")))
    after = F.when(e > end, part(hi + step, e, F.col("last_used")))
    pieces = F.when(lo > hi, F.array(part(s, e, F.col("last_used")))).otherwise(F.array(before, part(lo, hi, F.lit(now)), after))
    split = extents.select(key, F.explode(F.filter(pieces, lambda p: p.isNotNull())).alias("p")).select(key, F.col("p.s").alias("start"), F.col("p.e").alias("end"), F.col("p.u").alias("last_used"))
    return compress(split, step, key, "last_used").select(key, "start", "end", "last_used")


def normalize(requests: DataFrame, step: int, phase: int = 0, now: int | None = None, is_offset: bool = False) -> DataFrame:
    """Starts and ends on the grid; ends after ``now`` are cut to it unless the query looks back by an offset."""
    end = F.col("end") if is_offset or now is None else F.least("end", F.lit(now))
    grid = lambda x: x - F.pmod(x - phase, F.lit(step))
    return requests.withColumn("end", grid(end)).withColumn("start", grid(F.col("start")))


def as_text(extents: DataFrame, key: str = "key") -> DataFrame:
    """Per key 'start-end;start-end' in order of start; a key's list is one string."""
    pairs = F.array_sort(F.collect_list(F.struct("start", "end")))
    return extents.groupBy(key).agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ";").alias("text"))


def as_lru_text(extents: DataFrame, key: str = "key") -> DataFrame:
    """Per key 'start-end:used,start-end:used', least recently used first."""
    rows = F.array_sort(F.collect_list(F.struct("last_used", "start", "end")))
    return extents.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit(":"), x["last_used"].cast("string"))), ",").alias("text"))


def by_start(extents: DataFrame, key: str = "key") -> DataFrame:
    return extents.orderBy("start", "end", key)


def by_last_use(extents: DataFrame, key: str = "key") -> DataFrame:
    return extents.orderBy("last_used", "start", "end", key)
