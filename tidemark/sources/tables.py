"""Tabular wire formats: a SQL database's separated values and JSON, and annotated CSV, as DataFrames of points and back.

Readers take rows of whole documents (column ``doc``, a result or a part of one
with its header lines); writers give a row per line or object with the place
that sorts them (column ``nth``: headers negative, rows 0), so that Spark's own
sources and sinks read and write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.once import once
from tidemark.functions.points import parse_epoch, parse_value, rfc3339, sorted_tags, tags_json
from tidemark.operators.order import numbered

#: Kinds of the SQL database's types, without what is in parentheses.
KINDS = {
    "String": "string", "UUID": "string", "FixedString": "string",
    "Int8": "long", "Int16": "long", "Int32": "long", "Int64": "long", "UInt8": "unsigned", "UInt16": "unsigned", "UInt32": "unsigned", "UInt64": "unsigned",
    "Float32": "double", "Float64": "double", "Decimal": "double", "Decimal32": "double", "Decimal64": "double", "Decimal128": "double", "Decimal256": "double",
    "DateTime": "datetime", "DateTime64": "datetime", "Date": "date", "Nothing": "null",
}
#: Type names written for Spark's types, and for annotated CSV.
NAMES = {"bigint": "Int64", "int": "Int32", "double": "Float64", "string": "String", "timestamp": "DateTime", "timestamp_ntz": "DateTime", "date": "Date", "boolean": "Bool"}
ANNOTATED = {"bigint": "long", "int": "long", "double": "double", "string": "string", "boolean": "boolean"}
_TIMES, _UNTRACKED = ("_time", "time"), ("_start", "_stop", "table", "")


def _cells(line: Column, separator: str) -> Column:
    """Cells of a line; of commas those inside quotes don't split, and doubled quotes are one."""
    if separator != ",":
        return F.split(line, separator)
    quoted = F.transform(F.split(line, ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda c: F.when(c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    # Looking ahead from every comma is for lines with quotes alone.
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ","))


def kind_of(type_name: Column) -> Column:
    """Kind of a declared type; 'unknown' for those without one."""
    names = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(names, F.substring_index(type_name, "(", 1)), F.lit("unknown"))


def _named(rows: DataFrame, names: Column, cells: Column) -> DataFrame:
    """Columns names and cells as one map; rows of another width than the header are skipped."""
    return rows.filter(F.size(names) == F.size(cells)).withColumn("_m", F.map_from_arrays(names, cells))


def read_names_and_types(docs: DataFrame, time: str, tags: list[str], separator: str = "\t") -> DataFrame:
    """Points of documents with a line of names and one of types: tags, series, epoch_ns, field, type, value, v.

    ``time`` names the timestamp, ``tags`` the grouping columns; the rest are
    values. Empty tags make no label; lines of another width and rows without a
    time are skipped; values of unknown type, or none, are dropped, and v is
    null where a value doesn't parse as its type says.
    """
    lines = docs.select(F.split(F.rtrim("doc"), "\n").alias("l")).filter(F.size("l") >= 2)
    names, types = _cells(F.get("l", F.lit(0)), separator), _cells(F.get("l", F.lit(1)), separator)
    rows = lines.select(names.alias("names"), types.alias("types"), F.explode(F.slice("l", 3, 1 << 30)).alias("line")).withColumn("cells", _cells(F.col("line"), separator))
    named = _named(rows, F.col("names"), F.col("cells")).filter(F.size("types") == F.size("names")).withColumn("_t", F.map_from_arrays("names", "types"))
    labels = F.map_filter("_m", lambda k, v: k.isin(*tags) & (v != "")) if tags else F.create_map().cast("map<string,string>")
    fields = F.map_filter("_m", lambda k, _: ~k.isin(time, *tags))
    out = named.select(labels.alias("tags"), parse_epoch(F.element_at("_m", time)).alias("epoch_ns"), "_t", F.explode(fields).alias("field", "value")).filter("epoch_ns IS NOT NULL")
    out = out.withColumn("type", kind_of(F.element_at("_t", F.col("field")))).filter("type NOT IN ('unknown', 'null')").drop("_t")
    v = F.when(F.col("type").isin("long", "unsigned"), F.col("value").try_cast("decimal(20,0)").cast("double")).when(F.col("type") == "double", F.col("value").try_cast("double"))
    return out.withColumn("v", v).withColumn("series", tags_json(F.col("tags")))


def read_typed_rows(lines: DataFrame, names: list[str], time: str, tags: list[str]) -> DataFrame:
    """Points of tab-separated lines (column ``value``) without headers; empty labels make none, lines of another width are skipped."""
    cells = lines.select(F.split("value", "\t").alias("c")).filter(F.size("c") == len(names))
    at = {n: F.get("c", F.lit(i)) for i, n in enumerate(names)}
    labels = F.map_filter(F.create_map(*[x for t in tags for x in (F.lit(t), at[t])]), lambda _, v: v != "") if tags else F.create_map().cast("map<string,string>")
    fields = F.create_map(*[x for n in names if n != time and n not in tags for x in (F.lit(n), at[n])])
    rows = cells.select(labels.alias("tags"), parse_epoch(at[time]).alias("epoch_ns"), F.explode(fields).alias("field", "value"))
    return rows.filter("epoch_ns IS NOT NULL").withColumn("series", tags_json(F.col("tags")))


def header(rows: DataFrame, separator: str = "\t") -> list[str]:
    """The two header lines: names and types."""
    return [separator.join(rows.columns), separator.join(NAMES.get(t, "String") for _, t in rows.dtypes)]


def _cell(column: str, separator: str) -> Column:
    """Text of a cell. CSV quotes what needs it; in tab-separated values null is \\N."""
    text = F.col(f"`{column}`").cast("string")
    if separator == ",":
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.isNull(), "").when(text.rlike('[,"\\r\\n]|^ '), quoted).otherwise(text)
    return F.coalesce(text, F.lit("\\N"))


def write_typed_rows(rows: DataFrame, separator: str = "\t", names: bool = False, types: bool = False) -> DataFrame:
    """A line per row (value) with nth; header lines of names and types if asked for, which come with the types."""
    body = rows.select(F.lit(0).alias("nth"), F.concat_ws(separator, *[_cell(c, separator) for c in rows.columns]).alias("value"))
    heads = [(-2 + i, h) for i, h in enumerate(header(rows, separator)) if (names or types, types)[i]]
    return rows.sparkSession.createDataFrame(heads, "nth int, value string").unionByName(body) if heads else body


def write_json_rows(rows: DataFrame) -> DataFrame:
    """The JSON format in parts by nth: -1 the column descriptions, 0 a row's object, every value as a string."""
    quoted = lambda c: F.to_json(F.struct(c.alias("v")))
    text = lambda c: F.coalesce(F.substr(quoted(c), F.lit(6), F.length(quoted(c)) - 6), F.lit('""'))
    item = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(text(F.lit(c)), F.lit(":"), F.when(F.col(f"`{c}`").isNull(), '""').otherwise(text(F.col(f"`{c}`").cast("string")))) for c in rows.columns]), F.lit("}"))
    meta = "[" + ",".join(f'{{"name":"{c}","type":"{NAMES.get(t, "String")}"}}' for c, t in rows.dtypes) + "]"
    return rows.sparkSession.createDataFrame([(-1, meta)], "nth int, value string").unionByName(rows.select(F.lit(0).alias("nth"), item.alias("value")))


#: Output formats by their number.
WRITERS = {
    0: write_json_rows,
    1: lambda rows: write_typed_rows(rows, ","),
    2: lambda rows: write_typed_rows(rows, ",", names=True),
    3: write_typed_rows,
    4: lambda rows: write_typed_rows(rows, names=True),
    5: lambda rows: write_typed_rows(rows, names=True, types=True),
}


def write_rows(rows: DataFrame, output: int = 3) -> DataFrame:
    """Rows in the output format of a number: 0 JSON, 1 and 2 CSV (with names), 3 to 5 tab-separated (with names, and types)."""
    if output not in WRITERS:
        raise ValueError(f"unknown format {output}")
    return WRITERS[output](rows)


def read_annotated(docs: DataFrame) -> DataFrame:
    """Points of annotated CSV documents: result, tags, series, epoch_ns, field, type, value, v.

    Each table of a document (tables are apart by an empty line) has its lines
    of #datatype, #group and #default and its names. Columns marked as group
    are tags, _time is the timestamp, and _start, _stop and table are not kept.
    Empty cells have the column's default.
    """
    tables = F.transform(F.split(F.replace("doc", F.lit("\r"), F.lit("")), r"\n\n+"), lambda b: once(F.filter(F.split(b, "\n"), lambda x: F.trim(x) != ""), _table))
    blocks = docs.select(F.explode(tables).alias("t")).select("t.*").filter("size(types) = size(names) AND size(groups) = size(names)")
    lines = blocks.select("types", "groups", "defaults", "names", F.explode("lines").alias("line"))
    # A line's points come out of one generator, so no filter or column works out its cells again.
    return lines.select(F.explode(once(_cells(F.col("line"), ","), _line_points)).alias("p")).select("p.*")


def _table(lines: Column) -> Column:
    """Annotations, names and data lines of an annotated table."""
    head = lambda name: _cells(F.get(F.filter(lines, lambda x: x.startswith(name)), F.lit(0)), ",")
    of = lambda data: F.struct(
        head("#datatype").alias("types"), head("#group").alias("groups"), head("#default").alias("defaults"), _cells(F.get(data, F.lit(0)), ",").alias("names"), F.slice(data, 2, 1 << 30).alias("lines")
    )
    return once(F.filter(lines, lambda x: ~x.startswith("#")), of)


def _line_points(cells: Column) -> Column:
    """A point for each value of a line, whose table's types, groups, defaults and names are columns; null where widths differ or there is no time."""
    own = lambda i: F.when(F.get(cells, i) == "", F.get(F.coalesce("defaults", cells), i)).otherwise(F.get(cells, i))
    every = F.transform("names", lambda n, i: F.struct(n.alias("name"), F.get("types", i).alias("type"), F.get("groups", i).alias("group"), own(i).alias("cell")))
    is_tag = lambda x: (x["group"] == "true") & ~x["name"].isin(*_UNTRACKED, *_TIMES)
    entries = lambda a: F.map_from_entries(F.transform(a, lambda x: F.struct(x["name"], x["cell"])))

    def points(x: Column, named: Column) -> Column:
        time = F.coalesce(*[F.try_element_at(named, F.lit(t)) for t in _TIMES])
        at = once(time, lambda t: F.coalesce(F.unix_micros(F.try_to_timestamp(t)) * 1000, parse_epoch(t)))
        tags = entries(F.filter(x, lambda e: is_tag(e) & (e["cell"] != "")))
        line = once(tags, lambda t: F.struct(F.try_element_at(named, F.lit("result")).alias("result"), t.alias("tags"), tags_json(t).alias("series"), at.alias("epoch_ns")))
        fields = F.filter(x, lambda e: ~is_tag(e) & ~e["name"].isin("result", *_UNTRACKED, *_TIMES))
        value = lambda f: [f["name"].alias("field"), f["type"].alias("type"), f["cell"].alias("value"), parse_value(f["cell"]).alias("v")]
        return once(line, lambda r: F.when(r["epoch_ns"].isNotNull(), F.transform(fields, lambda f: F.struct(*[r[c].alias(c) for c in ("result", "tags", "series", "epoch_ns")], *value(f)))))

    return F.when(F.size(cells) == F.size("names"), once(F.filter(every, lambda x: x["name"] != ""), lambda x: once(entries(x), lambda named: points(x, named))))


def _tables(points: DataFrame) -> DataFrame:
    """``points`` with the number of their series' table, from 0 in order of the label set."""
    series = numbered(points.select("series").distinct(), [F.col("series")], "table")
    return points.join(series, "series")


def write_annotated(points: DataFrame, tags: list[str], start_ns: int, stop_ns: int, annotations: tuple[str, ...] = ("datatype", "group", "default"), names: bool = True, result: str = "_result") -> DataFrame:
    """Lines (nth, table, epoch_ns, value) of annotated CSV: asked-for annotations, names, then a row per point; sort by the first three.

    Columns are result, table, _start, _stop, _time, _value and ``tags``.
    """
    cols = ["result", "table", "_start", "_stop", "_time", "_value", *tags]
    kinds = ["string", "long", "dateTime:RFC3339", "dateTime:RFC3339", "dateTime:RFC3339", "double", *["string"] * len(tags)]
    groups = ["false", "false", "true", "true", "false", "false", *["true"] * len(tags)]
    defaults = [result, *[""] * (len(cols) - 1)]
    lines = {"datatype": kinds, "group": groups, "default": defaults}
    heads = [(-4 + i, f"#{a}," + ",".join(lines[a])) for i, a in enumerate(("datatype", "group", "default")) if a in annotations] + ([(-1, "," + ",".join(cols))] if names else [])
    spark = points.sparkSession
    none = F.lit(None).cast("long")
    top = spark.createDataFrame(heads, "nth int, value string").select("nth", none.alias("table"), none.alias("epoch_ns"), "value")
    times = [rfc3339(F.lit(start_ns)), rfc3339(F.lit(stop_ns)), rfc3339(F.col("epoch_ns"))]
    rows = _tables(points).select("*", *[F.coalesce(F.col("tags")[t], F.lit("")).alias(f"_tag{i}") for i, t in enumerate(tags)])
    value = F.coalesce(F.col("v").cast("string"), F.lit(""))
    line = F.concat(F.lit(",,"), F.concat_ws(",", F.col("table").cast("string"), *times, value, *[_cell(f"_tag{i}", ",") for i in range(len(tags))]))
    return top.unionByName(rows.select(F.lit(0).alias("nth"), "table", "epoch_ns", line.alias("value")))


def write_tables_json(points: DataFrame, tags: list[str], step_ns: int, factor: int = 420) -> DataFrame:
    """One JSON table (columns and records in time order) per series and aligned chunk of ``factor`` steps."""
    columns = [("table", "long"), ("_time", "dateTime:RFC3339"), ("_value", "double"), *[(t, "string") for t in tags]]
    head = '{"columns":[' + ",".join(f'{{"name":"{n}","datatype":"{t}"}}' for n, t in columns) + '],"records":['
    quoted = lambda c: F.substr(F.to_json(F.struct(c.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    v = F.col("v")
    number = F.when(F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull(), "null").otherwise(v.cast("string"))
    own = [F.concat(F.lit(f'"{t}":'), quoted(F.coalesce(F.col("tags")[t], F.lit("")))) for t in tags]
    record = F.concat(F.lit('{"values":{"table":'), F.col("table").cast("string"), F.lit(',"_time":"'), rfc3339(F.col("epoch_ns")), F.lit('","_value":'), number, *[x for o in own for x in (F.lit(","), o)], F.lit("}}"))
    chunk = F.floor(F.col("epoch_ns") / (step_ns * factor)).alias("chunk")
    grouped = _tables(points).groupBy("series", "table", chunk).agg(F.array_sort(F.collect_list(F.struct("epoch_ns", record.alias("r")))).alias("rs"))
    return grouped.select("series", "table", F.concat(F.lit(head), F.array_join(F.transform("rs", lambda r: r["r"]), ","), F.lit("]}")).alias("json"))


def labelled(points: DataFrame, **tags: str) -> DataFrame:
    """``points`` with the map column tags made of the named columns (label=column), and series from it."""
    both = F.create_map(*[x for label, column in tags.items() for x in (F.lit(label), F.col(column).cast("string"))])
    return points.withColumn("tags", sorted_tags(F.map_filter(both, lambda _, v: v.isNotNull()))).withColumn("series", tags_json(F.col("tags")))
