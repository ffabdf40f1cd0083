"""Places in a global order without gathering it: range partitions, their counts, and places inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.merge import settle


def running_sum(rows: DataFrame, keys: list[str], order: list[Column], size: str, name: str, total: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``size`` up to and with each row, per ``keys`` along ``order`` (columns that tell the rows of a key apart).

    Rows are range-partitioned by keys and order, so a key of any size is in as
    many tasks as it needs; what meets per key are the partitions' sums.
    ``total`` names a column for the key's sum.
    """
    named = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    cols = [f"_o{i}" for i in range(len(order))]
    dealt = rows.select("*", *named).repartitionByRange(*keys, *cols).sortWithinPartitions(*keys, *cols)
    dealt = settle(dealt.withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(size).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = sums.select(*keys, "_part", (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    inside = F.sum(size).over(Window.partitionBy(*keys, "_part").orderBy(*cols))
    out = dealt.withColumn("_in", inside).join(before, [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_in"))
    out = out.withColumn(total, F.col("_total")) if total else out
    return out.drop("_part", "_in", "_before", "_total", *cols)


def numbered(rows: DataFrame, order: list[Column], name: str = "nth") -> DataFrame:
    """``rows`` numbered from 0 along ``order``, which must tell them apart."""
    one = rows.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1).cast("long"))
    return running_sum(one, ["_all"], order, "_one", name).withColumn(name, F.col(name) - 1).drop("_all", "_one")
