"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A chunk ends where the hash of the last 32 bytes has its low bits zero, so an
insertion moves the cuts near it only. Equal chunks of different documents are
found by a 128-bit digest; runs of them that are long enough are repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hot_keys, id_and_text, join_spread, map_columns, read_table, settle, store

CHUNKS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("nth", pa.int32()), ("start", pa.int32()), ("size", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())])
#: Gear values: one 32-bit number for each byte, drawn from a fixed hash.
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=9) for b in range(256)], np.uint32)


def cuts(data: bytes, bits: int = 5, least: int = 16, most: int = 128) -> list[int]:
    """Ends of the chunks of UTF-8 bytes; never inside a character."""
    if not data:
        return []
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    for k in (1, 2, 4, 8, 16):  # sum over the last 2k bytes, each shifted by its age
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    # The high bits take in the whole window.
    good = (h >> np.uint32(32 - bits)) == 0
    good[:-1] &= (b[1:] & 0xC0) != 0x80
    out, last = [], 0
    for end in (np.flatnonzero(good) + 1).tolist():
        if end - last < least:
            continue
        while end - last > most:
            last += most
            while last < len(b) and b[last] & 0xC0 == 0x80:
                last += 1
            out.append(last)
        if end - last >= least:
            out.append(end)
            last = end
    while len(b) - last > most:
        last += most
        while last < len(b) and b[last] & 0xC0 == 0x80:
            last += 1
        out.append(last)
    if last < len(b):
        out.append(len(b))
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 5, least: int = 16, most: int = 128) -> DataFrame:
    """One row per chunk: doc_id, row, nth, start and size in code points, and a digest in two longs.

    ``row`` is a hash of the text, which tells rows apart that share an id. Null and empty text have no chunks.
    """

    def start():
        def step(batch):
            out = {f.name: [] for f in CHUNKS}
            digest = xxhash.xxh3_128_digest
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                ends = cuts(data, bits, least, most)
                n = len(ends)
                if not n:
                    continue
                pairs = np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]), "<i8")
                at = np.concatenate([[0], np.array(ends)])
                if len(data) != len(text):
                    at = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[at]
                out["doc_id"].append(pa.array([doc] * n, pa.int64()) if doc is None else np.full(n, doc))
                out["row"].append(np.full(n, row))
                out["nth"].append(np.arange(n))
                out["start"].append(at[:-1])
                out["size"].append(np.diff(at))
                out["hi"].append(pairs[0::2])
                out["lo"].append(pairs[1::2])
            join = lambda parts, t: pa.concat_arrays([pa.array(p, t) for p in parts]) if parts else pa.array([], t)
            return {f.name: join(out[f.name], f.type) for f in CHUNKS}

        return step

    rows = id_and_text(docs, id_col, text_col).withColumn("row", F.xxhash64("text"))
    return map_columns(rows.select("doc_id", "row", "text"), start, CHUNKS)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 120, bits: int = 5, least: int = 16, most: int = 128) -> DataFrame:
    """Spans of text that several documents share: doc_id, row, start, end, removed, first_doc_id, n_chunks.

    start and end are code points, end exclusive. A span is a run of chunks of
    one document that occur in other documents too, of ``least_chars`` at
    least. The document with the smallest id that has a chunk keeps it
    (removed is false there); elsewhere it is to be removed. Repeats inside
    one document alone are none. Documents without a repeat have no row, and
    so have null and empty texts; a null id takes no part. Rows that repeat an
    id and text are one document; rows that share an id alone are told apart by
    ``row``, a hash of the text. A very long text is cut by its worker and
    leaves it as rows, chunk by chunk. Other columns are not read.
    """
    rows = chunks(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, bits, least, most)
    # Stored once: the chunks are read for the counts and again for the spans.
    rows = store(rows)
    counted = rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = settle(counted.filter("first < last").select("hi", "lo", "first", "n"))
    hits = join_spread(rows, shared.drop("n"), ["hi", "lo"], hot_keys(shared, ["hi", "lo"]), ["doc_id", "row"]).dropDuplicates(["doc_id", "row", "nth"])
    hits = hits.withColumn("removed", F.col("doc_id") != F.col("first"))
    order = Window.partitionBy("doc_id", "row").orderBy("nth")
    new = F.coalesce((F.col("nth") != F.lag("nth").over(order) + 1) | (F.col("removed") != F.lag("removed").over(order)), F.lit(True))
    runs = hits.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    spans = runs.groupBy("doc_id", "row", "run").agg(
        F.min("start").cast("long").alias("start"), F.max(F.col("start") + F.col("size")).cast("long").alias("end"),
        F.first("removed").alias("removed"), F.min("first").alias("first_doc_id"), F.count(F.lit(1)).alias("n_chunks"),
    )
    return spans.filter(F.col("end") - F.col("start") >= least_chars).select("doc_id", "row", "start", "end", "removed", "first_doc_id", "n_chunks")


def remove_repeats(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with the removed spans of ``repeats`` cut out of the text; null text stays null.

    Cuts belong to an id and a text, so rows that share an id lose only what is
    their own; rows that repeat both are cut alike. Columns may have any name.
    """
    cutouts = spans.filter("removed").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    text = F.col(f"`{text_col}`")
    every = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*every).alias("all"), text.alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row"))
    state = F.aggregate(
        "cuts",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.struct(F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))).alias("out"), F.greatest(acc["at"], x["end"]).alias("at")),
    )
    left = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(state["out"], F.substr("text", (state["at"] + 1).cast("int"))))
    joined = rows.join(cutouts, ["doc_id", "row"], "left").withColumn("left", left)
    return joined.select(*[F.col("left").alias(c) if c == text_col else F.col(f"all.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read_table(spark, sf_dir, "documents")).drop("row")
