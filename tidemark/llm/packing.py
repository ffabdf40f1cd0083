"""Best-fit packing after Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so an instance is a histogram with at
most ``capacity`` counts however many documents there are. The reduction and
best-fit decreasing run on those counts; the result is a table of bin shapes
(bounded by the capacity, not by the data). Documents are then ranked inside
their length and looked up in the shapes, which is a plain distributed map.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_alphabet
from tidemark.llm.common import id_and_text, map_columns, read_table, settle
from tidemark.llm.pieces import ODD, Memory, cut

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])


def _dominating_three(left: dict[int, int], order: list[int], j: int, room: int) -> tuple[int, ...] | None:
    """The set that dominates all others with j where at most two items fit beside it; None if there is none or three fit."""
    free = lambda s: left[s] - (s == j)
    small = [s for s in order[:4] for _ in range(min(3, free(s)))][:3]
    if len(small) == 3 and sum(small) <= room:
        return None
    sizes = [s for s in order[: bisect_left(order, room + 1)] if free(s)]
    if not sizes:
        return None
    i = sizes[-1]
    best, low, high = 0, 0, len(sizes) - 1
    while low <= high:  # the longest two that fit
        if sizes[low] + sizes[high] > room or (low == high and free(sizes[low]) < 2):
            high -= 1
            continue
        best = max(best, sizes[low] + sizes[high])
        low += 1
    if i >= best:
        return (j, i)
    beside = [s for s in sizes[: bisect_left(sizes, room - i + 1)] if free(s) > (s == i)]
    if not beside:
        return None
    h = beside[-1]
    longer = [s for s in sizes[bisect_left(sizes, h + 1) :] for _ in range(min(2, free(s)))][:2]
    if len(longer) == 2 and sum(longer) <= room:
        return None
    return (j, i, h)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], dict[int, int]]:
    """Bins fixed for good as (times, lengths), and the counts that are left.

    For the longest item j, Martello and Toth's criteria fix {j} where nothing
    fits beside it, {j, i} where i fills the bin exactly, {j, i} for the
    longest i that fits where no two items fit beside j, and, where two fit
    but not three, {j, i} if i is as long as any two that fit, or {j, i, h},
    h the longest that fits beside both, if every two that fit are no longer
    than i and h one by one.
    """
    left = {s: n for s, n in counts.items() if n}
    order = sorted(left)
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def take(sizes: tuple[int, ...], times: int) -> None:
        fixed.append((times, sizes))
        for s in sizes:
            left[s] -= times
        for s in set(sizes):
            if not left[s]:
                del left[s]
                order.pop(bisect_left(order, s))

    for j in sorted(left, reverse=True):
        while j in left:
            room = capacity - j
            own = left[j]
            if order[0] > room or (len(order) == 1 and own == 1):
                take((j,), own)
                continue
            if room in left and room != j:
                take((j, room), min(own, left[room]))
                continue
            if room == j:
                if own < 2:
                    break
                take((j, j), own // 2)
                continue
            smallest = [order[0]] * min(2, left[order[0]]) + ([order[1]] if left[order[0]] == 1 and len(order) > 1 else [])
            if smallest[0] == j and own < 2:
                break
            if len(smallest) > 1 and smallest[0] + smallest[1] <= room:
                found = _dominating_three(left, order, j, room)
                if found is None:
                    break
                times = min(left[s] // found.count(s) for s in set(found))
                take_one = len(set(found)) < len(found)
                take(found, 1 if take_one else times)
                continue
            i = order[bisect_left(order, room + 1) - 1]
            if i == j:
                if own < 2:
                    break
                take((j, j), own // 2)
            else:
                # As long as two other items can't fit beside j; counts only fall, so the rest holds.
                take((j, i), min(own, left[i]))
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on counts: bins as (times, lengths).

    Bins of one shape are held together; a length goes to the fullest bins that
    take it, and splits one group of bins at most.
    """
    open_bins: dict[int, list[list]] = defaultdict(list)  # room -> groups [times, lengths]
    rooms: list[int] = []

    def put(room: int, times: int, sizes: tuple[int, ...]) -> None:
        if not open_bins[room]:
            insort(rooms, room)
        open_bins[room].append([times, sizes])

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                each = min(capacity // s, n)
                put(capacity - s * each, n // each, (s,) * each)
                n -= n // each * each
                continue
            room = rooms[at]
            group = open_bins[room][-1]
            each = room // s
            if n >= each:
                times = min(group[0], n // each)
            else:
                each, times = n, 1
            group[0] -= times
            n -= times * each
            if not group[0]:
                open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(at)
            put(room - each * s, times, group[1] + (s,) * each)
    return [(times, sizes) for groups in open_bins.values() for times, sizes in groups]


def bin_shapes(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def assign(pieces: DataFrame, length_col: str = "length", capacity: int = 1024) -> DataFrame:
    """``pieces`` with sequence_id and offset; needs the columns ``part`` and ``ord``.

    ``part`` names the task that made a row and ``ord`` orders rows within it;
    both must be stored values, not recomputed. Lengths run from 1 to capacity.
    """
    per_part = pieces.groupBy("part", length_col).agg(F.count(F.lit(1)).alias("n"))
    # A length's parts in order: at most one row per (task, length).
    before = per_part.select("part", length_col, (F.sum("n").over(Window.partitionBy(length_col).orderBy("part")) - F.col("n")).alias("before"))
    shapes = bin_shapes({r[0]: r[1] for r in per_part.groupBy(length_col).agg(F.sum("n")).collect()}, capacity)
    # For each length: the rank at which each (shape, slot) starts.
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for times, sizes in shapes:
        at = 0
        for s in sizes:
            runs[s].append((used[s], first, at))
            used[s] += times
            at += s
        first += times
    table = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for s, rows in runs.items()}
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    ranked = pieces.withColumn("rn", F.row_number().over(Window.partitionBy("part", length_col).orderBy("ord"))).join(before, ["part", length_col])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rn") - 1).drop("before", "rn", "part", "ord")

    def place(batches):
        for b in batches:
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            rank, size = b["rank"].to_numpy(np.int64), b[length_col].to_numpy()
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                start, base, at = shared.value[int(s)]
                k = np.searchsorted(start, rank[rows], side="right") - 1
                seq[rows], off[rows] = base[k] + rank[rows] - start[k], at[k]
            yield b.drop(columns="rank").assign(sequence_id=seq, offset=off)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInPandas(place, f"{fields}, sequence_id long, offset long")


#: Letters and line ends, figures and marks that are sorted into pre-tokens here; pieces with others are left to the library.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(rf"[{_LETTERS}]+").fullmatch
_SORTED = re.compile(rf"[\n!-~{_LETTERS}]+").fullmatch
_PARTS = re.compile(rf"'(?:[sdmt]|ll|ve|re)|[{_LETTERS}]+|[0-9]+|[^\s0-9{_LETTERS}]+|\n+(?!\S)|\n+").findall


class Encoder:
    """text -> bytes of its ids (little-endian unsigned 32-bit), by the tokenizers library with a memory of pieces.

    What is surely one pre-token goes to the library's model alone, and a piece
    of several is put together from them; all others go the library's whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.four = [struct.pack("<I", i) for i in range(max(self.tok.get_vocab().values()) + 1)]
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or r"(?!)").search
        named = {byte: c for c, byte in byte_alphabet().items()}
        self.named = {c: "".join(named[x] for x in c.encode()) for c in map(chr, range(0x100))}
        self.head, self.tail = Memory(lambda p: self._make(p, self.head, ""), 60_000), Memory(lambda p: self._make(p, self.tail, " "))

    def _make(self, piece: str, own: Memory, before: str) -> bytes:
        if not self.added(piece):
            if _WORD(piece):
                return self._word(piece, before)
            # A leading quote may or may not begin an 's, by what is before it.
            if _SORTED(piece) and piece[0] not in "'\n":
                first, *rest = _PARTS(piece)
                return own[first] + b"".join(map(self.head.__getitem__, rest)) if rest else self._word(piece, before)
        return b"".join(map(self.four.__getitem__, self.tok.encode(before + piece, add_special_tokens=False).ids))

    def _word(self, word: str, before: str) -> bytes:
        word = before + word
        name = self.named[" "] + word[1:] if before and word.isascii() else word if word.isascii() else "".join(map(self.named.__getitem__, word))
        return b"".join([self.four[t.id] for t in self.model.tokenize(name)])

    def __call__(self, text: str) -> bytes:
        first, *rest = cut(text)
        return self.head[first] + b"".join(map(self.tail.__getitem__, rest))

    def ids_of_all(self, texts: pa.Array, end: bytes) -> tuple[bytes, list[int]]:
        """The ids of all texts, each with ``end`` behind it, and where each begins and the last ends, in ids.

        Each different piece is looked up once.
        """
        odd = pc.match_substring_regex(texts, ODD)
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        coded = split.flatten().dictionary_encode()
        at = split.offsets.to_numpy() - split.offsets[0].as_py()
        codes, words = coded.indices.to_numpy().copy(), coded.dictionary.to_pylist()
        made = list(map(self.tail.__getitem__, words))
        heads = [self(texts[i].as_py()) if o else self.head[words[k]] for i, (k, o) in enumerate(zip(codes[at[:-1]].tolist(), odd.to_pylist(), strict=True))]
        codes[at[:-1]] = np.arange(len(made), len(made) + len(heads))
        made += [*heads, end]
        codes = np.insert(codes, at[1:], len(made) - 1)
        width = np.fromiter(map(len, made), np.int64, len(made)) // 4
        starts, wide = np.cumsum(width) - width, width[codes]
        ends = np.cumsum(wide)
        ids = np.frombuffer(b"".join(made), "<u4")[np.repeat(starts[codes] - ends + wide, wide) + np.arange(ends[-1])]
        return ids.tobytes(), np.concatenate([[0], ends])[at + np.arange(len(at))].tolist()


_ENCODER = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODER:
        _ENCODER[path] = Encoder(path)
    return _ENCODER[path]


def slices(texts: pa.Array, most: int):
    """(first, count) of runs of texts of at most ``most`` bytes together, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to - at
        at = to


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, part, ord.

    Each document is its ids and then ``end_id``. Of a longer one all pieces
    but the first have ``capacity`` ids. Null text counts as empty, so it is
    one piece of one id. Repeated rows each make their pieces.
    """
    end = np.array([end_id], "<u4").tobytes()

    def start():
        encode = encoder(tokenizer)

        def step(b):
            out = []
            texts, names = b.column("text"), b.column("doc_id").to_pylist()
            for first, count in slices(texts, 2_000_000):
                ids, bounds = encode.ids_of_all(texts.slice(first, count), end)
                for doc, low, high in zip(names[first : first + count], bounds, bounds[1:]):  # noqa: B905
                    at, size = 0, (high - low - 1) % capacity + 1
                    k = 0
                    while low + at < high:
                        out.append((doc, k, at, size, zlib.crc32(ids[4 * (low + at) : 4 * (low + at + size)])))
                        at, size, k = at + size, capacity, k + 1
            return dict(zip(PIECES.names, zip(*out, strict=True), strict=True)) if out else dict.fromkeys(PIECES.names, [])

        return step

    rows = map_columns(id_and_text(docs, id_col, text_col), start, PIECES)
    return rows.withColumn("part", F.spark_partition_id()).withColumn("ord", F.monotonically_increasing_id())


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into few sequences of at most ``capacity`` ids; one row per piece.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Offsets in a
    sequence are gapless from 0. An empty table gives no rows; see
    ``token_pieces`` for nulls and repeated rows; other columns are not read.
    """
    pieces = settle(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    return assign(pieces, "length", capacity).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
