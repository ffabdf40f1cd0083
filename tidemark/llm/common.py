"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session
    that names none, as in tests, gets a folder of its own; on a cluster that is
    an error. Whoever owns the folder empties it when the results are stored.
    """
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def store(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the checkpoint folder, for tables that are large beside their input."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n", share: int = 500) -> list[int]:
    """Hashes of the keys with more than a ``share``-th of all rows, by a table of counts: ``share`` of them at most, whatever the input's size."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.filter(F.col(n) * share > total).select(F.xxhash64(*keys)).collect()]


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], hot: list[int], by: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """``left`` joined to ``right``, which has one row a key, so that no hot key meets in one task.

    Rows of the keys in ``hot``, which comes from ``hot_keys``, are spread over
    ``salts`` tasks by a hash of the columns ``by``, and only their rows of
    ``right`` are copied. Null keys join nothing.
    """
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    dealt = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0))
    copies = right.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def hashed_share(id_col: str, share: Column, seed: int) -> Column:
    """True for about ``share`` of the ids, always the same ones."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < share * F.lit(1 << 30)


_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.float32(): "float", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}


def spark_type(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{spark_type(t.value_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ", ".join(f"{f.name}:{spark_type(f.type)}" for f in t) + ">"
    return _NAMES[t]


def map_columns(df: DataFrame, start, schema: pa.Schema) -> DataFrame:
    """mapInArrow over columns: ``start()`` runs once a task and gives a function from a batch to lists of values by name."""

    def run(batches):
        step = start()
        for batch in batches:
            made = step(batch)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type, from_pandas=False) for f in schema], schema=schema)

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {spark_type(f.type)}" for f in schema))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, as doc_id (long) and text (null counts as empty)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
