"""Nearest neighbours by largest inner product over shifted Hilbert curves.

Vectors are lifted so that the largest inner product becomes the smallest
angle, and projected many times to a few dimensions, each time turned and
shifted otherwise; each projection has its Hilbert curve. A row lies on those
curves in whose projection it is longest, where it has few neighbours and most
of them near ones; a query reads those curves in the same way. Along each curve
the rows are range-partitioned, and a query meets a fixed number of rows before
and behind its own place, so the share of the table that it meets falls as the
table grows. The windows of all curves merge, and the best are ranked on the
original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_share, map_columns, read_table, settle, spark_type, store

KEYS = pa.schema([("part", pa.int64()), ("place", pa.int64()), ("q", pa.int32()), ("rid", pa.int64()), ("scale", pa.float32()), ("code", pa.binary())])
#: What a scan gives: kind 0, the best rows met by query a; kinds 1 and 2, the last and first rows of part a; kinds 3 and 4, query b that lacks ``need`` rows before or behind part a.
SCAN = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("need", pa.int32()), ("rids", pa.binary()), ("scores", pa.binary()), ("codes", pa.binary())])
MERGED = pa.schema([("query", pa.int64()), ("rid", pa.int64())])


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer ``cells`` (below 2**bits), by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


class Curves:
    """``count`` Hilbert curves over vectors of ``dim`` components and length ``longest`` at most."""

    def __init__(self, dim: int, longest: float, count: int, dims: int = 4, bits: int = 8, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.longest, self.bits, self.count, self.dims = longest, bits, count, min(dims, dim + 1)
        turns = [np.linalg.qr(rng.normal(size=(dim + 1, self.dims)))[0] for _ in range(count)]
        # A random row has about unit spread in each projected dimension.
        self.turn = (np.concatenate(turns, axis=1) * math.sqrt(dim + 1)).astype(np.float32)
        self.shift = rng.uniform(-0.5, 0.5, size=(count, self.dims)).astype(np.float32)

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rows of unit length; the added component makes up what a row lacks of the longest."""
        length = np.sqrt((x * x).sum(axis=1))
        if query:
            return np.hstack([x / length[:, None], np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(self.longest**2 - length**2, 0))[:, None]]) / self.longest

    def places(self, x: np.ndarray, rid: np.ndarray, query: bool, each: int) -> tuple[np.ndarray, np.ndarray]:
        """(curve, place) of each row on its ``each`` curves. The id breaks ties of the key, so no place is crowded."""
        each = min(each, self.count)
        curve, place = np.empty((len(x), each), np.int64), np.empty((len(x), each), np.int64)
        low = _mix(rid.astype(np.uint64)) >> np.uint64(32)
        for k in range(0, len(x), 1024):
            z = (self.lift(x[k : k + 1024], query).astype(np.float32) @ self.turn).reshape(-1, self.count, self.dims)
            far = np.argpartition(-np.einsum("ncd,ncd->nc", z, z), each - 1, axis=1)[:, :each]
            near = np.take_along_axis(z, far[:, :, None], axis=1) + self.shift[far]
            top = 1 << self.bits
            cells = np.clip((near + 4.5) / 9.0 * top, 0, top - 1).astype(np.int64).reshape(-1, self.dims)
            curve[k : k + 1024] = far
            place[k : k + 1024] = hilbert(cells, self.bits).reshape(-1, each)
        spare = 63 - self.bits * self.dims
        return curve, (place << spare) | (low >> np.uint64(max(0, 32 - spare))).astype(np.int64)[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def padded(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones end in zeros."""
    width = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (width == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(width), dim))
    out[np.arange(dim)[None, :] < width[:, None]] = flat
    return out


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight bits a component and a scale for each row; scores by them only choose what is ranked exactly."""
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def cut_places(sample: np.ndarray, curves: Curves, n: int, each: int, least: int) -> list[np.ndarray]:
    """For each curve the places where its parts end, so that a part has about ``least`` rows: quantiles of a sample."""
    if not len(sample):
        return [np.zeros(0, np.int64)] * curves.count
    curve, place = curves.places(sample, np.arange(len(sample)), False, each)
    order = np.lexsort((place.ravel(), curve.ravel()))
    curve, place = curve.ravel()[order], place.ravel()[order]
    ends = np.searchsorted(curve, np.arange(curves.count + 1))
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        parts = min(b - a, math.ceil((b - a) * n / len(sample) / least))
        at = a + (np.arange(1, parts) * (b - a)) // max(1, parts)
        out.append(np.unique(place[at]))
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec (array of double) of rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(f"`{id_col}`").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("vec"))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores of each row of ``scores``."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def meet(codes, scale, rids, asked_codes, asked_scale, at, reach: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of the ``k`` best rows among ``reach`` before and ``reach`` behind its place."""
    x, y = codes.astype(np.float32) * scale[:, None], asked_codes.astype(np.float32)
    scores = np.full((len(at), 2 * reach), -np.inf, np.float32)
    low, high = np.maximum(at - reach, 0), np.minimum(at + reach, len(rids))
    for i, (a, b, place) in enumerate(zip(low.tolist(), high.tolist(), at.tolist(), strict=True)):
        np.dot(x[a:b], y[i], out=scores[i, a - place + reach : b - place + reach])
    picks = best(scores, k)
    top = np.take_along_axis(scores, picks, axis=1)
    ids = rids[np.clip(at[:, None] - reach + picks, 0, len(rids) - 1)]
    return [(i[t > -np.inf], t[t > -np.inf] * s) for i, t, s in zip(ids, top, asked_scale, strict=True)]


def _rows(batch: pa.RecordBatch, dim: int):
    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(-1, dim)
    return [batch.column(c).to_numpy() for c in ("part", "place", "q", "rid", "scale")] + [codes]


def scan(dim: int, reach: int, k: int, last_part: np.ndarray):
    """Windows inside each part of a sorted stream of rows and queries, and what the next parts need."""

    def part_rows(part, place, q, rid, scale, codes):
        out = {f.name: [] for f in SCAN}

        def put(kind, a, b, need, rids=None, scores=None, held=None):
            for name, value in zip(SCAN.names, (kind, a, b, need, rids, scores, held), strict=True):
                out[name].append(value)

        own, ask = np.flatnonzero(q == 0), np.flatnonzero(q == 1)
        at = np.searchsorted(own, ask)  # rows before each query
        p = int(part[0])
        before, behind = p > 0 and not last_part[p - 1], not last_part[p]
        if len(own):
            for a in range(0, len(ask), 4096):
                some = ask[a : a + 4096]
                met = meet(codes[own], scale[own], rid[own], codes[some], scale[some], at[a : a + 4096], reach, k)
                for query, (i, s) in zip(rid[some].tolist(), met, strict=True):
                    put(0, query, 0, 0, i.astype("<i8").tobytes(), s.astype("<f4").tobytes())
            pack = lambda r: (rid[r].astype("<i8").tobytes(), scale[r].astype("<f4").tobytes(), codes[r].tobytes())
            if behind:
                put(1, p, 0, 0, *pack(own[-reach:]))
            if before:
                put(2, p, 0, 0, *pack(own[:reach]))
        for query, i, r in zip(rid[ask].tolist(), ask.tolist(), at.tolist(), strict=True):
            if before and r < reach:
                put(3, p, query, reach - r, None, scale[i : i + 1].astype("<f4").tobytes(), codes[i].tobytes())
            if behind and len(own) - r < reach:
                put(4, p, query, reach - (len(own) - r), None, scale[i : i + 1].astype("<f4").tobytes(), codes[i].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in SCAN], schema=SCAN)

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _rows(batch, dim)
            cuts = [0, *(np.flatnonzero(np.diff(rows[0])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0][0][0] != rows[0][a]:
                    yield part_rows(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                held.append([c[a:b] for c in rows])
        if held:
            yield part_rows(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def across_edges(dim: int, k: int):
    """Windows that reach into the next part; the stream is sorted so that a part's edge rows are ahead of the queries that need them."""

    def run(batches):
        edge, rows = None, None
        for batch in batches:
            out = {f.name: [] for f in SCAN}
            for r in batch.to_pylist():
                if r["edge"] != edge:
                    edge, rows = r["edge"], {}
                if r["kind"] < 3:
                    ids = np.frombuffer(r["rids"], "<i8")
                    rows[r["kind"]] = (ids, np.frombuffer(r["scores"], "<f4"), np.frombuffer(r["codes"], np.int8).reshape(-1, dim))
                    continue
                side = rows.get(1 if r["kind"] == 3 else 2)
                if side is None:
                    continue
                ids, scale, codes = (x[-r["need"] :] if r["kind"] == 3 else x[: r["need"]] for x in side)
                ((got, score),) = meet(codes, scale, ids, np.frombuffer(r["codes"], np.int8)[None, :], np.frombuffer(r["scores"], "<f4"), np.zeros(1, np.int64), len(ids), k)
                for name, value in zip(SCAN.names, (0, r["b"], 0, 0, got.astype("<i8").tobytes(), score.astype("<f4").tobytes(), None), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in SCAN], schema=SCAN)

    return run


def merged(k: int):
    """The ``k`` best different rows of each query; the stream is sorted by query."""

    def top(query, rids, scores):
        ids, s = np.frombuffer(b"".join(rids), "<i8"), np.frombuffer(b"".join(scores), "<f4")
        order = np.argsort(-s, kind="stable")
        first = np.unique(ids[order], return_index=True)[1]  # one of each, at its best
        ids = ids[order][np.sort(first)][:k]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), query)), pa.array(ids)], schema=MERGED)

    def run(batches):
        query, rids, scores = None, [], []
        for batch in batches:
            for q, r, s in zip(*(batch.column(c).to_pylist() for c in ("a", "rids", "scores")), strict=True):
                if q != query and rids:
                    yield top(query, rids, scores)
                    rids, scores = [], []
                query = q
                rids.append(r)
                scores.append(s)
        if rids:
            yield top(query, rids, scores)

    return run


def nearest(
    vectors: DataFrame, is_query, k: int = 20, curves: int = 512, rows_on: int = 24, queries_on: int = 72, reach: int = 104, part_rows: int = 16384, sample_rows: int = 10000,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Each query's ``k`` nearest found: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on the column vec_id. Every row is indexed: on
    the ``rows_on`` of ``curves`` curves where its projection is longest. A
    query meets ``reach`` rows before and behind its place on ``queries_on``
    curves, chosen likewise: at most 2 x reach x queries_on rows however many
    there are.

    Rows whose id or vector is null, or whose vector is all zero or has a null
    or non-finite component, take no part. Vectors shorter than the longest
    count as if zeros followed. Of rows with one id and vector, one counts; two
    vectors of one id are both searched and both found. Equal vectors are
    searched as one and each of the k + 1 smallest ids answers; equal queries
    are asked once. An empty table gives no rows. Other columns are not read.

    Parts of a curve end at quantiles of about ``sample_rows`` rows, chosen by
    a hash of the id; that bounds a task and doesn't change what is met, as
    windows go on in the next part.
    """
    rows = usable(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    told = rows.agg(F.max(F.size("vec")), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    if told[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, made = told[0], Curves(told[0], math.sqrt(told[1]), curves)
    # The k + 1 smallest ids of each vector; Spark limits the groups before it shuffles them.
    per_vector = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.dropDuplicates(["vec_id", "vec"]).withColumn("nth", F.row_number().over(per_vector)).filter(F.col("nth") <= k + 1)
    unique = settle(few.groupBy("vec").agg(F.min("vec_id").alias("rid"), F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.xxhash64("rid", "vec").alias("rid"), "ids", "vec"))
    n = unique.count()
    picked = unique.filter(hashed_share("rid", F.lit(min(1.0, sample_rows / n)), 2)).select("rid", "vec").toArrow()
    sample = padded(picked.column("vec").combine_chunks(), dim) if picked.num_rows else np.zeros((0, dim))
    ends = cut_places(sample, made, n, rows_on, part_rows)
    first_part = np.concatenate([[0], np.cumsum([len(e) + 1 for e in ends])])
    last_part = np.zeros(first_part[-1], bool)
    last_part[first_part[1:] - 1] = True
    # Bounded by the curves and the sample, not by the rows.
    shared = spark.sparkContext.broadcast((made, ends, first_part, last_part))

    def keyed(query: bool, each: int):
        def start():
            curves_, ends_, first_, _ = shared.value

            def step(b):
                x, rid = padded(b.column("vec"), dim), b.column("rid").to_numpy()
                curve, place = curves_.places(x, rid, query, each)
                code, scale = coded(x)
                many = curve.shape[1]
                part = np.empty(curve.shape, np.int64)
                for c in np.unique(curve):
                    on = curve == c
                    part[on] = first_[c] + np.searchsorted(ends_[c], place[on], side="right")
                packed = [r.tobytes() for r in code]
                return {
                    "part": part.ravel(), "place": place.ravel(), "q": np.full(curve.size, int(query), np.int32), "rid": np.repeat(rid, many), "scale": np.repeat(scale, many),
                    "code": [c for c in packed for _ in range(many)],
                }

            return step

        return start

    asked = rows.filter(is_query).dropDuplicates(["vec_id", "vec"])
    questions = settle(asked.groupBy("vec").agg(F.min("vec_id").alias("rid")).select(F.xxhash64("rid", "vec").alias("rid"), "vec"))
    along = map_columns(unique.select("rid", "vec"), keyed(False, rows_on), KEYS).unionByName(map_columns(questions, keyed(True, queries_on), KEYS))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = lambda schema: ", ".join(f"`{f.name}` {spark_type(f.type)}" for f in schema)

    def scan_all(batches):
        return scan(dim, reach, k + 1, shared.value[3])(batches)

    scanned = store(along.repartition(tasks, "part").sortWithinPartitions("part", "place", "q").mapInArrow(scan_all, text(SCAN)))
    # Edge p is between parts p and p + 1.
    edge = F.when(F.col("kind").isin(1, 4), F.col("a")).otherwise(F.col("a") - 1)
    edges = scanned.filter("kind > 0").withColumn("edge", edge).repartition(tasks, "edge").sortWithinPartitions("edge", "kind").mapInArrow(across_edges(dim, k + 1), text(SCAN))
    found = scanned.filter("kind = 0").unionByName(edges).select("a", "rids", "scores")
    top = found.repartition(tasks, "a").sortWithinPartitions("a").mapInArrow(merged(2 * k + 1), text(MERGED))
    # The measure itself on the original vectors; copies of a vector answer by their ids.
    product = F.aggregate(F.zip_with("qv", "vec", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    scored = top.join(unique, "rid").join(questions.select(F.col("rid").alias("query"), F.col("vec").alias("qv")), "query").select("query", "qv", "ids", product.alias("score"))
    each = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i")))
    answers = scored.groupBy("query").agg(F.first("qv").alias("vec"), F.array_sort(F.flatten(F.collect_list(each))).alias("near"))
    # Equal queries meet their answers in several tasks.
    salts = 8
    salted = answers.select("vec", F.slice("near", 1, k + 1).alias("near"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    told_to = asked.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")).join(salted, ["vec", "salt"])
    near = F.slice(F.filter("near", lambda x: x["i"] != F.col("vec_id")), 1, k)
    out = told_to.select(F.col("vec_id").alias("query_id"), F.posexplode(near).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
