"""Exact dedup by skew-safe combining.

Texts are deduplicated inside each map task, merged per salted digest group,
and the salt winners are combined globally. Every merge groups by the digest
AND the whole normalised text, so a digest collision can't merge two texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hot_keys, join_spread, read_table, settle

#: Characters that don't count when texts are compared: space and 0x09-0x0D.
BLANKS = " \t\n\x0b\x0c\r"


def _strong_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _encode(n: Column, doc: Column) -> Column:
    """One number per row: more code points first, then the smaller id, null ids last."""
    big = lambda c: c.cast("decimal(20,0)")
    part = F.when(doc.isNull(), F.lit(0).cast("decimal(20,0)")).otherwise(F.lit("9223372036854775808").cast("decimal(20,0)") - big(doc))
    return (n.cast("decimal(11,0)") * F.lit("100000000000000000000").cast("decimal(21,0)") + part).cast("decimal(38,0)")


def _decode_id(code: Column) -> Column:
    part = code % F.lit("100000000000000000000").cast("decimal(21,0)")
    return F.when(part == 0, F.lit(None).cast("long")).otherwise((F.lit("9223372036854775808").cast("decimal(20,0)") - part).cast("long"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, digest=_strong_digest) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts form one group. Of equal texts
    the row with the most code points, then the smallest id stays (a null id
    last). Rows that repeat both id and text are counted each, and one of them
    is kept. Other columns, whatever their names, are not looked at. An empty
    table gives an empty result.

    ``salts`` splits the copies of one text over that many merge groups; where
    rows meet the row that stays, digests of many rows are spread as well.
    ``digest`` may be any function of the normalised text: texts with equal
    digests are told apart by content.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.length(text).alias("n"), F.translate(text, BLANKS, "").alias("norm"))
    rows = base.select("doc", "n", "norm", digest(F.col("norm")).alias("fp"))
    sha = F.col("fp") if digest is _strong_digest else _strong_digest(F.col("norm"))
    merged = (
        rows.select("fp", "norm", F.pmod(F.xxhash64("doc", "n"), F.lit(salts)).cast("int").alias("salt"), _encode(F.col("n"), F.col("doc")).alias("code"))
        .groupBy("fp", "norm", "salt").agg(F.max("code").alias("code"), F.count(F.lit(1)).alias("size"))
        .groupBy("fp", "norm").agg(F.max("code").alias("code"), F.sum("size").alias("size"))
    )
    owner = ["fp", _decode_id(F.col("code")).alias("keep"), "size"]
    winners = settle(merged.select(*owner))
    members = rows.select("doc", "fp", sha.alias("sha")).groupBy("doc", "fp", "sha").agg(F.count(F.lit(1)).alias("times"))
    shared = winners.groupBy("fp").count().filter("count > 1").select("fp")
    hot = hot_keys(winners, ["fp"], "size")
    if shared.isEmpty():
        joined = join_spread(members, winners, ["fp"], hot, ["doc"])
    else:
        # Different texts under one digest: their rows are joined by content as well.
        shared = settle(shared)
        texts = rows.join(shared, "fp", "left_semi").groupBy("doc", "fp", "norm").agg(F.count(F.lit(1)).alias("times"))
        owners = settle(merged.select(*owner, "norm").join(shared, "fp", "left_semi"))
        hard = join_spread(texts, owners, ["fp", "norm"], hot_keys(owners, ["fp", "norm"], "size"), ["doc"]).select("fp", "doc", _strong_digest(F.col("norm")).alias("sha"), "times", "keep", "size")
        joined = join_spread(members.join(shared, "fp", "left_anti"), winners.join(shared, "fp", "left_anti"), ["fp"], hot, ["doc"]).unionByName(hard.select("fp", "doc", "sha", "times", "keep", "size"))
    return joined.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth")).select(
        F.col("doc").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("doc").eqNullSafe(F.col("keep")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns."""
    key = lambda doc, sha: F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("null")), sha)
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(key(F.col(id_col), F.col("text_sha256")).alias("__key"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        key(F.col(id_col).cast("long"), F.sha2(F.translate(text, BLANKS, ""), 256)).alias("__key"),
        F.length(text).alias("__n"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
    )
    # Rows that share id and normalised text meet here; the longest alone goes on.
    return rows.join(kept, "__key", "left_semi").groupBy("__key").agg(F.max_by("__row", "__n").alias("__row")).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT norm, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT d.doc_id, w.keep_id, w.group_size, d.doc_id = w.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN w USING (norm)
"""
