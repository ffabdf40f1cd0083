"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate rates and an L1 term leave few weights, which are broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_share, id_and_text, id_fold, map_columns, read_table, settle
from tidemark.llm.pieces import Memory

BITS = 20
_WORD = re.compile(r"[^\W\d_]+")
_HASH = Memory(lambda w: xxhash.xxh64_intdigest(w))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def features(text: str | None) -> np.ndarray:
    """Hashed 1-, 2- and 3-grams of the lower-cased words, and pairs that skip one word."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    grams = [
        h,
        h[:-1] * _MIX[0] + h[1:] * _MIX[1],
        h[:-2] * _MIX[2] + h[2:] * _MIX[3],
        h[:-2] * _MIX[0] + h[1:-1] * _MIX[1] + h[2:] * _MIX[2],
    ]
    mixed = np.concatenate(grams)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal on binary features; the last coordinate is the bias, without L1."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, most: int = 24000, shards: int = 4, passes: int = 5) -> dict[str, np.ndarray]:
    """Non-zero weights: arrays ``at`` and ``w``, and ``bias``.

    About ``most`` labelled documents are used (chosen by a hash of the id); a
    document with several labels counts as toxic if one says so, null labels
    don't count. Rows that share an id are each a document with its label, and
    so are thinned once more where they are many; rows that repeat id and text
    are one. The sample is split by a hash of the text over ``shards`` learners
    and the weights of those that had rows are averaged, so no task holds more
    than its share of the bounded sample.
    """
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = marks.count()
    chosen = marks.filter(hashed_share("doc_id", F.lit(min(1.0, most / max(1, total))), 5))
    # At most about ``most`` rows of two numbers: a proven bound for a broadcast.
    chosen = F.broadcast(settle(chosen))
    rows = docs.select("doc_id").join(chosen, "doc_id").count()
    thin = F.pmod(F.xxhash64("text", F.lit(6)), F.lit(1 << 30)) < F.lit(min(1.0, 2 * most / max(1, rows)) * (1 << 30))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").filter(thin).withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc_id", "text"])
        pdf = pdf.iloc[np.argsort([xxhash.xxh64_intdigest(f"{i} {t}") for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)], kind="stable")]
        x = [np.unique(features(t)) for t in pdf["text"]]
        model = Ftrl()
        for _ in range(passes):
            for at, y in zip(x, pdf["toxic"], strict=True):
                model.learn(at, int(y))
        w = model.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        # Place -1 counts the learners.
        return pd.DataFrame({"at": np.append(at, -1), "w": np.append(w[at], 1.0)})

    rows = sample.groupBy("shard").applyInPandas(learn, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).toPandas()
    rows["w"] /= max(1.0, float(rows.loc[rows["at"] == -1, "w"].sum()))
    rows = rows[rows["at"] >= 0]
    bias = float(rows.loc[rows["at"] == 1 << BITS, "w"].sum())
    rows = rows[rows["at"] < 1 << BITS].sort_values("at")
    return {"at": rows["at"].to_numpy(np.int64), "w": rows["w"].to_numpy(np.float64), "bias": bias}


def score(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row.

    Null, empty and wordless text get the bias alone. Repeated rows are scored
    each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[m["at"]] = m["w"]
        used = dense != 0

        def step(b):
            out = []
            for text in b.column("text").to_pylist():
                at = features(text)
                out.append(m["bias"] + float(dense[np.unique(at[used[at]])].sum()))
            return {"doc_id": b.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(np.array(out, float), -35, 35)))}

        return step

    return map_columns(id_and_text(docs, id_col, text_col), start, pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(id_fold("doc_id", 4) != 2))
    return score(docs, model).select("doc_id", (id_fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
