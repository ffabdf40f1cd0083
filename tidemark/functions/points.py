"""The time-series model as columns: label maps, epochs and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NS = 1_000_000_000
NAN = float("nan")


def sorted_tags(tags: Column) -> Column:
    """The map with its keys in order, so that equal label sets have equal JSON."""
    return F.map_from_entries(F.array_sort(F.map_entries(tags)))


def tags_json(tags: Column) -> Column:
    return F.to_json(sorted_tags(tags))


def tags_of(*names: str) -> Column:
    """A label map of the named columns; empty and null values make no label."""
    both = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    return F.map_filter(both, lambda _, v: v.isNotNull() & (v != ""))


def inject_tags(tags: Column, **labels: str) -> Column:
    """Upsert constant labels."""
    kept = F.map_filter(tags, lambda k, _: ~k.isin(*labels)) if labels else tags
    return F.map_concat(kept, F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])) if labels else kept


def strip_tags(tags: Column, *names: str) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.isin(*names)) if names else tags


def group_tags(tags: Column, names: list[str], without: bool = False) -> Column:
    """Labels of an aggregation's groups: listed non-empty ones, or all but those and the metric name."""
    if without:
        return F.map_filter(tags, lambda k, _: ~k.isin(*names, "__name__"))
    return F.map_filter(tags, lambda k, v: k.isin(*names) & (v != "")) if names else F.map_filter(tags, lambda k, _: F.lit(False))


def rank_tags(tags: Column, names: list[str], without: bool = False) -> Column:
    """Labels of a ranking's groups; unlike ``group_tags``, ``without`` leaves the metric name."""
    if without:
        return F.map_filter(tags, lambda k, _: ~k.isin(*names)) if names else tags
    return group_tags(tags, names)


def parse_value(text: Column) -> Column:
    """A double of text; NaN where it isn't one."""
    return F.coalesce(text.try_cast("double"), F.lit(NAN))


def epoch_ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def whole(n: Column, by: int) -> Column:
    """Floor of n / by in whole numbers; a double can't hold nanoseconds."""
    return F.call_function("div", n - F.pmod(n, F.lit(by)), F.lit(by))


def format_epoch(ns: Column, form: str) -> Column:
    """Text of an epoch: unix seconds, milliseconds, nanoseconds, or SQL and RFC 3339 forms."""
    seconds = F.timestamp_micros(whole(ns, 1000))
    units = {"s": 1, "ms": 1000, "us": 10**6, "ns": NS}
    if form in units:
        return whole(ns, NS // units[form]).cast("string")
    return F.date_format(seconds, {"date": "yyyy-MM-dd", "time": "HH:mm:ss", "datetime": "yyyy-MM-dd HH:mm:ss", "rfc3339": "yyyy-MM-dd'T'HH:mm:ss'Z'"}[form])


def rfc3339(ns: Column) -> Column:
    """Time of an epoch in UTC with as many digits of a second as it has."""
    digits = F.regexp_replace(F.lpad(F.pmod(ns, F.lit(NS)).cast("string"), 9, "0"), "0+$", "")
    return F.concat(F.date_format(F.timestamp_seconds(whole(ns, NS)), "yyyy-MM-dd'T'HH:mm:ss"), F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""), F.lit("Z"))


def parse_epoch(text: Column) -> Column:
    """Nanoseconds of an integer, whose number of digits tells its unit, or of a SQL time in UTC."""
    n = text.try_cast("long")
    digits = F.length(F.abs(n).cast("string"))
    number = F.when(digits >= 19, n).when(digits >= 16, n * 1000).when(digits >= 13, n * 1_000_000).otherwise(n * NS)
    return F.coalesce(number, F.unix_micros(F.try_to_timestamp(text)) * 1000)


def crop(points: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Points in the closed range; the predicate reaches the scan."""
    return points.filter(F.col("epoch_ns").between(start_ns, end_ns))


def limit_hash(tags: Column) -> Column:
    """XXH64 with seed 0 of the sorted, length-prefixed labels, as an unsigned share of 2^64.

    Spark's xxhash64 starts from seed 42 and chains: hashing one fixed long
    first leaves seed 0 for what follows.
    """
    prefixed = lambda s: F.concat(F.when(F.octet_length(s) < 255, _byte(F.octet_length(s))).otherwise(F.concat(F.unhex(F.lit("FF")), _le3(F.octet_length(s)))), s.cast("binary"))
    parts = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(prefixed(e["key"]), prefixed(e["value"])))
    data = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p))
    h = F.xxhash64(F.lit(-365884300664092260), data).cast("decimal(20,0)")
    return F.when(h < 0, h + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(h).cast("double") / F.lit(float(1 << 64))


def _byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 2, "0"))


def _le3(n: Column) -> Column:
    return F.concat(_byte(n % 256), _byte(F.floor(n / 256) % 256), _byte(F.floor(n / 65536) % 256))


def tags_text(tags: Column, separator: str = ";") -> Column:
    """Sorted 'key=value' pairs."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws("=", e["key"], e["value"])), separator)


def tag_keys(tags: Column) -> Column:
    return F.array_sort(F.map_keys(tags))


def merge_tags(a: Column, b: Column) -> Column:
    """Both label maps; of a label in both, the second's value stays."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def pairing_key(name: Column, tags: Column, kind: Column | None = None) -> Column:
    """What pairs series of different queries: name and labels, without the query; with ``kind`` None values and histograms pair as well."""
    parts = [F.coalesce(name, F.lit("")), tags_json(tags)]
    return F.concat_ws("\u001f", *parts, *([kind] if kind is not None else []))
