"""Language identification: script ranges narrow the candidates, then Viterbi over words.

A word's score for a language is the log-probability of its letter trigrams in
that language. The best labelling of a text's words, with a penalty for each
switch, gives spans of one language each.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_share, id_and_text, id_fold, map_columns, read_table

BUCKETS = 1 << 15
#: First code point of ranges of scripts, from Unicode's blocks; "" is any other.
SCRIPTS = [
    (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, ""),
    (0x900, "devanagari"), (0x980, "bengali"), (0xA00, ""), (0xB80, "tamil"), (0xC00, ""), (0xE00, "thai"), (0xE80, ""), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, ""), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"), (0x2C80, ""), (0x3040, "kana"), (0x3100, ""),
    (0x3400, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD800, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB10, ""), (0xFF21, "latin"), (0xFF60, ""), (0x20000, "han"), (0x30000, ""),
]
_FIRST = np.array([x for x, _ in SCRIPTS], np.int64)
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS], np.int64)
_TABLES: dict[str, np.ndarray] = {}
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN))])
COUNTS = pa.schema([("lang", pa.string()), ("at", pa.int32()), ("n", pa.int64())])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        every = range(0x110000)  # one character at a time: lists of all of them would stay in a worker's memory
        _TABLES["lower"] = np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in every), np.uint32, len(every))
        _TABLES["letter"] = np.fromiter((chr(i).isalpha() for i in every), bool, len(every))
    return _TABLES["lower"], _TABLES["letter"]


def words_of(text: str):
    """Per letter: trigram bucket and script; per word: its first letter (among the letters), start and end."""
    lower, letter = _tables()
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = np.zeros(len(cp) + 2, bool)
    is_letter[1:-1] = letter[cp]
    padded = np.zeros(len(cp) + 2, np.uint64)
    padded[1:-1] = np.where(is_letter[1:-1], lower[cp], 0)
    at = np.flatnonzero(is_letter)
    mixed = padded[at - 1] * np.uint64(0x9E3779B97F4A7C15) + padded[at] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[at + 1] * np.uint64(0x165667B19E3779F9)
    bucket = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)
    begins = ~is_letter[at - 1]
    ends = ~is_letter[at + 1]
    script = _SCRIPT[np.maximum(np.searchsorted(_FIRST, cp[at - 1], side="right") - 1, 0)]
    return bucket, script, np.flatnonzero(begins), at[begins] - 1, at[ends]


def fit(docs: DataFrame, per_lang: int = 2000, most_langs: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Trigram model of about ``per_lang`` whole documents of each language (null text or lang: not used).

    The sample is chosen by a hash of the id. Of more than ``most_langs`` values
    of the language, those with most documents are learned, which bounds the
    model. The counts, at most BUCKETS and a
    few scripts per language, are summed in Spark.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_langs).collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "table": np.zeros((BUCKETS, 0), np.float32), "scripts": np.zeros((len(_NAMES), 0), bool)}
    share = F.element_at(F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, per_lang / sizes[lang])))]), F.col(lang_col))
    sample = rows.filter(F.col(lang_col).isin(langs) & hashed_share(id_col, share, 8)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        sums = {lang: np.zeros(BUCKETS + len(_NAMES), np.int64) for lang in langs}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                bucket, script, *_ = words_of(text)
                sums[lang][:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                sums[lang][BUCKETS:] += np.bincount(script, minlength=len(_NAMES))
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], schema=COUNTS)

    counts = sample.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((BUCKETS + len(_NAMES), len(langs)))
    n[counts["at"].to_numpy(), [langs.index(x) for x in counts["lang"]]] = counts["n"]
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    prob = (grams + 0.1) / (grams.sum(axis=0) + 0.1 * BUCKETS)
    return {"langs": langs, "table": np.log(prob).astype(np.float32), "scripts": scripts >= 0.01 * np.maximum(1, scripts.sum(axis=0))}


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each row of ``scores`` where each change of label costs ``penalty``."""
    n, k = scores.shape
    total = scores.sum(axis=0, dtype=np.float64)
    top = int(total.argmax())
    if n == 0:
        return np.zeros(0, np.int64)
    gain = np.cumsum(scores.astype(np.float64) - scores[:, top : top + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros(k), gain[:-1]]), axis=0), 0)
    if (gain - low).max() <= penalty:  # no stretch of another label is worth one switch
        return np.full(n, top)
    best, back = scores[0].astype(np.float64), np.empty((n, k), np.int16)
    stay = np.arange(k)
    for t in range(1, n):
        lead = int(best.argmax())
        jump = best[lead] - penalty
        moved = best < jump
        back[t] = np.where(moved, lead, stay)
        best = np.where(moved, jump, best) + scores[t]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def label(model: dict, text: str | None, penalty: float = 8.0) -> tuple[str, float, list[tuple[int, int, str]]]:
    """Language with most letters, its share of the letters, and spans (start, end, language) in code points."""
    langs = model["langs"]
    if not text or not langs:
        return "und", 0.0, []
    bucket, script, first, start, end = words_of(text)
    if not len(first):
        return "und", 0.0, []
    scores = np.empty((len(first), len(langs)), np.float32)
    step = 1 << 16  # words at a time, so that very long texts need no more room
    for k in range(0, len(first), step):
        stop = first[k + step] if k + step < len(first) else len(bucket)
        rows = bucket[first[k] : stop]
        for j in range(len(langs)):
            scores[k : k + step, j] = np.add.reduceat(model["columns"][j][rows], first[k : k + step] - first[k])
    allowed = model["scripts"][script[first]]
    narrowed = allowed.any(axis=1)
    if not allowed[narrowed].all():
        scores[narrowed] = np.where(allowed[narrowed], scores[narrowed], -1e4)
    path = viterbi(scores, penalty)
    letters = np.bincount(path, weights=(end - start), minlength=len(langs))
    top = int(letters.argmax())
    cuts = np.flatnonzero(np.diff(path)) + 1
    spans = [(int(start[a]), int(end[b - 1]), langs[path[a]]) for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(path)], strict=True)]
    return langs[top], float(letters[top] / letters.sum()), spans


def ready(model: dict) -> dict:
    """The model with one contiguous column of scores per language."""
    return model | {"columns": [np.ascontiguousarray(model["table"][:, j]) for j in range(len(model["langs"]))]}


def identify(docs: DataFrame, model: dict, penalty: float = 8.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, spans of each row.

    Null text and text without a letter are ``und`` with score 0 and no spans,
    as is everything where nothing was learned. Ties go to the language first
    by name. Repeated rows are labelled each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m = ready(shared.value)

        def step(b):
            out = [label(m, t, penalty) for t in b.column("text").to_pylist()]
            spans = [[{"start": s, "end": e, "lang": name} for s, e, name in x[2]] for x in out]
            return {"doc_id": b.column("doc_id"), "lang_pred": [x[0] for x in out], "score": [x[1] for x in out], "spans": spans}

        return step

    return map_columns(id_and_text(docs, id_col, text_col), start, RESULT)


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(id_fold("doc_id", 5) != 0)


def keep_identified(docs: DataFrame, model: dict, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language for at least ``least`` of its letters.

    Null text and text without a letter have none. Rows may repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def ok(text: pd.Series) -> pd.Series:
        m = ready(shared.value)
        return pd.Series([x[0] != "und" and x[1] >= least for x in (label(m, t) for t in text)], dtype=bool)

    return docs.filter(ok(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, fit(train_rows(docs)))
    return found.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


