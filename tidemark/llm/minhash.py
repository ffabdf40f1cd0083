"""Near-dedup by ProbMinHash.

Each shingle of a document, weighted by how often it occurs there, is a Poisson
process whose rate is its weight; arrivals fall on random registers, and a
register keeps the shingle that reaches it first. Two documents agree on a
register with probability J_P, the probability Jaccard of their weighted
shingles. An element stops as soon as its next arrival is later than all
registers' first ones. Links are by the Jaccard of the sets, which repeats in
one text don't lower, so documents with repeats get a second signature with all
weights 1. Bands of registers of both give candidates; those are verified on
the whole texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hot_keys, id_and_text, join_spread, map_columns, read_table, settle, store
from tidemark.llm.components import components
from tidemark.llm.pieces import Memory

WIDTH, BANDS, ROWS = 5, 25, 5
REGISTERS = BANDS * ROWS
SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("sig", pa.binary()), ("flat", pa.binary())])
SHAPED = pa.schema([("doc_id", pa.int64()), ("sh", pa.binary())])
_WORD = Memory(lambda w: xxhash.xxh64_intdigest(w), 40_000)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    return text.lower().split()


def shingles(text_words: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles and their counts. Fewer words than ``width`` make one shingle; none make none."""
    h = np.fromiter(map(_WORD.__getitem__, text_words), np.uint64, len(text_words))
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int64)
    k = min(width, n)
    mixed = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        mixed = mixed * np.uint64(31) + h[j : n - k + 1 + j] * _ODD[j % 5]
    return np.unique(_mix(mixed), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """One row of ``registers`` shingle hashes (32 bits) per set; a set without elements has zeros."""
    doc = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    element = np.concatenate([s for s, _ in sets]) if sets else np.zeros(0, np.uint64)
    rate = np.concatenate([c for _, c in sets]).astype(float) if sets else np.zeros(0)
    first = np.full(len(sets) * registers, np.inf)
    owner = np.zeros(len(sets) * registers, np.uint64)
    at = np.zeros(len(element))
    turn = np.uint64(1)
    while len(element):
        random = _mix(element + np.array([turn]) * _ODD[0])
        at = at - np.log(((random >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / rate
        slot = doc * registers + (_mix(random + _ODD[1]) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        owner[slot[won]] = element[won]
        # An arrival after the last of the document's first ones ends its element.
        last = first.reshape(-1, registers).max(axis=1)
        live = at < last[doc]
        doc, element, rate, at = doc[live], element[live], rate[live], at[live]
        turn += np.uint64(1)
    return (_mix(owner) >> np.uint64(32)).astype(np.uint32).reshape(-1, registers)


def band_rows(sigs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, m, key) for each band of a document's signatures; equal keys mean equal registers of one band."""
    size = 4 * rows
    keys = lambda sig: F.array(*[F.xxhash64(F.lit(j), F.substring(sig, j * size + 1, size)) for j in range(bands)])
    every = F.when(F.col("flat").isNull(), keys("sig")).otherwise(F.array_union(keys("sig"), keys("flat")))
    return sigs.select("doc_id", F.col("n").alias("m"), F.explode(every).alias("key"))


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of weighted shingles, the quantity that signatures estimate; 0 for empty ones."""
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = a[1][ia].astype(float), b[1][ib].astype(float)
    # Elements by falling x/y; those of a alone are ahead of all, those of b alone behind.
    order = np.argsort(-(x / y), kind="stable")
    x, y = x[order], y[order]
    ahead = np.cumsum(x) + (a[1].sum() - x.sum())
    behind = np.cumsum(y[::-1])[::-1] - y + (b[1].sum() - y.sum())
    return float((1 / (ahead / x + behind / y)).sum())


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sets of distinct hashes; 0 for empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def start():
        def step(batch):
            out = {f.name: [] for f in SIGNED} | {"doc_id": batch.column("doc_id")}
            sets: list = []

            def flush():
                out["sig"] += [r.tobytes() for r in signatures(sets)]
                repeats = [len(c) > 0 and int(c.max()) > 1 for _, c in sets]
                flat = iter(signatures([(h, np.ones_like(c)) for (h, c), some in zip(sets, repeats, strict=True) if some]))
                out["flat"] += [next(flat).tobytes() if some else None for some in repeats]
                sets.clear()

            held = 0
            for text in batch.column("text").to_pylist():
                w = words(text)
                s = shingles(w)
                c = np.frombuffer(xxhash.xxh3_128_digest(" ".join(w)), "<i8")
                out["n"].append(len(s[0]))
                out["c1"].append(c[0])
                out["c2"].append(c[1])
                sets.append(s)
                held += len(s[0])
                if held > 300_000:
                    flush()
                    held = 0
            if sets:
                flush()
            return out

        return step

    return map_columns(id_and_text(docs, id_col, text_col), start, SIGNED)


def may_link(m: str, other: str, threshold: float) -> Column:
    """False where two documents' numbers of shingles rule out a Jaccard of ``threshold``."""
    return F.least(m, other) >= threshold * F.greatest(m, other) - 1e-6


def shapes(texts: DataFrame, used: DataFrame) -> DataFrame:
    """(doc_id, sh) of the documents in ``used``: the sorted hashes of a text's distinct shingles, 8 bytes each."""

    def start():
        return lambda batch: {"doc_id": batch.column("doc_id"), "sh": [shingles(words(t))[0].tobytes() for t in batch.column("text").to_pylist()]}

    return map_columns(texts.join(used, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), start, SHAPED)


def verified(pairs: DataFrame, shape: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of documents whose similarity is ``threshold`` or more, by the shingles of their whole texts."""
    hot = hot_keys(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), ["a"])
    both = join_spread(pairs, shape.select(F.col("doc_id").alias("a"), F.col("sh").alias("ha")), ["a"], hot, ["b"]).join(shape.select(F.col("doc_id").alias("b"), F.col("sh").alias("hb")), "b")

    def run(batches):
        for t in batches:
            keep = [jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= threshold for x, y in zip(t.column("ha"), t.column("hb"), strict=True)]
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def across(rest: DataFrame, shape: DataFrame, threshold: float, block: int = 1024, most: int = 500_000) -> DataFrame:
    """Links (a, b) between the classes of a bucket; ``rest`` has key, doc_id, root, and the bucket's documents n and shingles s.

    A bucket is dealt into blocks, and each pair of blocks is one group of at
    most 2 x ``block`` or so documents and 2 x ``most`` or so shingles. Inside, products of the blocks' shingle
    matrices give all intersections at once, exactly, and one link for each two
    classes leaves the group, never its pairs.
    """

    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("s") / most)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    dealt = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", "doc_id", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(shape.select("doc_id", "sh"), "doc_id")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(h, np.uint64) for h in pdf["sh"]]
        doc, root = pdf["doc_id"].to_numpy(), pdf["root"].to_numpy()
        names, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), [len(h) for h in sets])
        shared = seen[column] > 1  # the others are in no intersection
        order = np.cumsum(seen > 1) - 1
        r, c, width = row[shared], order[column[shared]], int((seen > 1).sum())
        size = np.array([len(h) for h in sets], np.float64)
        one, two = np.flatnonzero(pdf["own"].to_numpy() == pdf["i"].iloc[0]), np.flatnonzero(pdf["own"].to_numpy() == pdf["j"].iloc[0])
        common = np.zeros((len(one), len(two)), np.float32)
        for at in range(0, width, 1024):  # some columns at a time
            part = (c >= at) & (c < at + 1024)
            has = np.zeros((len(sets), min(1024, width - at)), np.float32)
            has[r[part], c[part] - at] = 1
            common += has[one] @ has[two].T
        # Whole hashes and exact counts: a pair that isn't a link must not stand for its two classes.
        common = common.astype(np.float64)
        good = common / (size[one][:, None] + size[two][None, :] - common) >= threshold
        x, y = np.nonzero(good & (root[one][:, None] != root[two][None, :]))
        x, y = one[x], two[y]
        ends = np.stack([np.minimum(root[x], root[y]), np.maximum(root[x], root[y])])
        first = np.unique(ends, axis=1, return_index=True)[1] if len(x) else np.zeros(0, int)
        x, y = x[first], y[first]
        return pd.DataFrame({"a": np.minimum(doc[x], doc[y]), "b": np.maximum(doc[x], doc[y])})

    return dealt.groupBy("key", "i", "j").applyInPandas(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", small: int = 12) -> DataFrame:
    """One row per input row: doc_id, class_id, kept.

    Documents whose shingles of five words are similar (Jaccard of their sets)
    to ``threshold`` are linked; a class is what links connect, class_id its
    smallest doc_id, and that document is kept. Words are what blanks separate,
    in lower case. Texts without words (null, empty, blank) are each a class of
    their own, as are rows without an id (class_id null). Rows that share an id
    are one document. Other columns are not read.

    Buckets of any size are handled whole: members are first compared with
    their bucket's first document, then all of them that are still in different
    classes with each other, so no link between classes is lost: in buckets of
    ``small`` members pair by pair, in larger ones block by block.
    """
    base = docs.filter(F.col(id_col).isNotNull())
    sigs = store(signed(base, id_col, text_col))
    worded = sigs.filter("n > 0")
    same = worded.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    same = settle(same)
    member = join_spread(worded.select("doc_id", "c1", "c2"), same.drop("n"), ["c1", "c2"], hot_keys(same, ["c1", "c2"]), ["doc_id"]).select("doc_id", "rep")
    # Signatures of the representatives: one document for each different text.
    firsts = same.select(F.col("rep").alias("doc_id"), "c1", "c2")
    reps = store(worded.join(firsts, ["doc_id", "c1", "c2"], "left_semi").dropDuplicates(["doc_id", "c1", "c2"]).select("doc_id", "n", "sig", "flat"))
    rows = band_rows(reps)
    buckets = rows.groupBy("key").agg(F.min(F.struct("doc_id", "m")).alias("first"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("n")).filter("first.doc_id < z").select("key", F.col("first.doc_id").alias("a"), F.col("first.m").alias("ma"), "n")
    buckets = settle(buckets)
    crowded = store(join_spread(rows, buckets.drop("n"), ["key"], hot_keys(buckets, ["key"]), ["doc_id"]))
    # From here on only documents that share a bucket: the shingles of their texts.
    used = settle(crowded.select("doc_id").distinct())
    shape = store(shapes(id_and_text(base, id_col, text_col), used))
    stars = settle(crowded.filter((F.col("doc_id") != F.col("a")) & may_link("m", "ma", threshold)).select("a", F.col("doc_id").alias("b")).distinct())
    links = settle(verified(stars, shape, threshold).distinct())
    found = settle(components(links, "a", "b"))
    # Buckets whose members are still in different classes.
    labelled = crowded.select("key", "doc_id", "m").join(found.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("key", "doc_id", "m", F.coalesce("root", "doc_id").alias("root"))
    # Buckets of several bands with the same members are one; of two members, the first comparison was all there is.
    mark = lambda seed: F.bit_xor(F.xxhash64("doc_id", F.lit(seed)))
    split = labelled.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n"), F.sum("m").alias("s"), mark(1).alias("x1"), mark(2).alias("x2"))
    split = settle(split.filter("r0 < r1 AND n > 2").groupBy("n", "s", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n", "s"))
    rest = store(join_spread(labelled, split, ["key"], hot_keys(split, ["key"]), ["doc_id"]))
    few = rest.filter(F.col("n") <= small)
    other = few.select("key", F.col("doc_id").alias("b"), F.col("root").alias("rb"), F.col("m").alias("mb"))
    pairs = few.select("key", F.col("doc_id").alias("a"), F.col("root").alias("ra"), "m").join(other, "key").filter("a < b AND ra <> rb").filter(may_link("m", "mb", threshold)).select("a", "b").distinct()
    blocks = across(rest.filter(F.col("n") > small), shape, threshold)
    more = settle(verified(settle(pairs), shape, threshold).unionByName(blocks).distinct())
    if not more.isEmpty():
        found = settle(components(links.unionByName(more), "a", "b"))
    linked = member.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"))
    out = linked.unionByName(sigs.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id")))
    nulls = docs.filter(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(nulls).select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that near_duplicates keeps; one of rows that share an id. Columns may have any name."""
    kept = near_duplicates(docs, 0.8, id_col, text_col).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), every.alias("all"))
    named = rows.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(rows.filter("doc_id IS NULL")).select(*[F.col(f"all.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
