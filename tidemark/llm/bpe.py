"""BPE as a streaming transducer with bounded lookahead, and its inverse.

Whether a token at the end of the bytes read so far is final depends on what
may still follow. A merge (a, b) at its right end can only be undone by an
earlier merge that takes a right-hand part of b, that one by a still earlier
merge, and so on; the longest such chain in the merge list bounds how many
bytes to look ahead, for each token by itself. Tokens that have as many bytes
behind them are emitted, from the left.

A text is read in runs of a few ten thousand characters. Where a pre-token
ends, nothing behind it can reach back, so the transducer is flushed there; the
bytes it emits for short words are remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import id_and_text, map_columns, read_table
from tidemark.llm.pieces import Memory, Pieces, cut, runs

#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: Characters of a run, and bytes of a word that the transducer takes at once.
BLOCK, WORD = 1 << 16, 256


def byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 characters stand for themselves; the other bytes follow from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def lookaheads(merges: list[tuple[bytes, bytes]]) -> dict[bytes, int]:
    """For each token, the bytes to its right that can still change it, over all chains of ever earlier merges."""
    reach: dict[bytes, int] = {}  # token -> furthest that a merge with it on the left depends on
    ends: dict[bytes, tuple[bytes, ...]] = {}  # token -> the tokens down its right edge, itself first
    for a, b in merges:
        needs = len(b) + max((reach.get(part, 0) for part in ends.get(b, (b,))), default=0)
        reach[a] = max(reach.get(a, 0), needs)
        ends.setdefault(a + b, (a + b, *ends.get(b, (b,))))
    single = {bytes([x]): (bytes([x]),) for x in range(256)}
    return {t: max(reach.get(part, 0) for part in parts) for t, parts in (single | ends).items()}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda t: bytes(alphabet[c] for c in t)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.single = [vocab.get(bytes([b])) for b in range(256)]
        needs = lookaheads([(raw(a), raw(b)) for a, b in pairs])
        self.lookahead = max(needs.values())
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merge.setdefault((vocab[raw(a)], vocab[raw(b)]), (rank, vocab[raw(a) + raw(b)]))
        self.rank_of = {a << 20 | b: rank for (a, b), (rank, _) in self.merge.items()}
        self.made = [vocab[raw(a) + raw(b)] for a, b in pairs]
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.size_of = {i: len(t) for i, t in self.bytes_of.items()}
        self.needs_of = {i: needs.get(t, 0) for i, t in self.bytes_of.items()}
        self.split = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        flat, self.start, self.width = bytearray(), np.zeros(max(self.bytes_of) + 1, np.int64), np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, t in self.bytes_of.items():
            self.start[i], self.width[i] = len(flat), len(t)
            flat += t
        self.flat = np.frombuffer(bytes(flat), np.uint8)
        self._words = Memory(lambda w: self.encode_word(w.encode()))
        self._known = Pieces(self._piece, lambda *parts: (",".join(names for names, _ in parts), b"".join(packed for _, packed in parts)))

    # -- encoding -------------------------------------------------------------

    def _whole(self, data: bytes) -> list[int]:
        """The ids of bytes that are all there is of a word: merges in rank order, leftmost first."""
        ids = [self.single[b] for b in data]
        if len(ids) > 48:
            return self._whole_long(ids)
        rank_of, made, none = self.rank_of, self.made, len(self.made)
        ranks = [rank_of.get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            k = ranks.index(rank)
            ids[k] = new = made[rank]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank_of.get(ids[k - 1] << 20 | new, none)
            if k < len(ranks):
                ranks[k] = rank_of.get(new << 20 | ids[k + 1], none)
        return ids

    def _whole_long(self, ids: list[int]) -> list[int]:
        n, merge = len(ids), self.merge
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(*merge[p], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in merge]  # noqa: B905
        heap = [(rank, k, new, a, b) for rank, new, k, a, b in heap]
        heapq.heapify(heap)
        while heap:
            rank, k, new, a, b = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < n and (found := merge.get((ids[x], ids[after[x]]))):
                    heapq.heappush(heap, (found[0], x, found[1], ids[x], ids[after[x]]))
        return [i for i, x in zip(ids, alive, strict=True) if x]

    def stream_word(self, blocks):
        """Ids of one word that arrives in blocks of bytes; holds a block and the lookahead of its last tokens at most."""
        held = b""
        for block in blocks:
            if held:
                at = 0
                for i in self._whole(held + block):
                    if at + self.size_of[i] + self.needs_of[i] > len(held) + len(block):
                        break
                    at += self.size_of[i]
                    yield i
                held = (held + block)[at:]
            else:
                held = block
        yield from self._whole(held)

    def encode_word(self, data: bytes, block: int = WORD) -> list[int]:
        """Ids of a word; one that is no longer than ``block`` is all the transducer holds before it is flushed."""
        return list(self.stream_word(data[k : k + block] for k in range(0, len(data), block)))

    def _plain(self, text: str) -> list[int]:
        ids: list[int] = []
        for word in self.split.findall(text):
            ids += self._words[word]
        return ids

    def encode_text(self, text: str) -> list[int]:
        """Ids of a text, special tokens in it included."""
        if self.at_special is None or not self.at_special.search(text):
            return self._plain(text)
        return [i for part in self.at_special.split(text) if part for i in ([self.special[part]] if part in self.special else self._plain(part))]

    def _piece(self, piece: str) -> tuple[str, bytes]:
        ids = self.encode_text(piece)
        return ",".join(map(str, ids)), np.array(ids, "<u4").tobytes()

    def _long(self, piece: str):
        """The same for a piece of any length, a few ids at a time."""
        parts = self.at_special.split(piece) if self.at_special and self.at_special.search(piece) else [piece]
        held: list[int] = []
        for part in parts:
            words = (part[m.start() : m.end()] for m in self.split.finditer(part)) if part not in self.special else ()
            ids = (i for w in words for i in self.stream_word(w[k : k + WORD].encode("utf-8", "surrogatepass") for k in range(0, len(w), WORD)))
            for i in [self.special[part]] if part in self.special else ids:
                held.append(i)
                if len(held) == BLOCK:
                    yield ",".join(map(str, held)), np.array(held, "<u4").tobytes()
                    held = []
        if held:
            yield ",".join(map(str, held)), np.array(held, "<u4").tobytes()

    def stream(self, text: str):
        """(decimal ids joined by commas, packed ids) of one run of the text after the other."""
        for run in runs(text, BLOCK):
            first, *rest = cut(run)
            if len(run) > 4 * BLOCK:  # a run without a place to cut
                yield from self._long(run)
                continue
            if run is not text and rest and not first:
                names, packed = zip(*map(self._known.tail.__getitem__, rest), strict=True)
            else:
                names, packed = zip(*([self._known.head[first]] if first else []), *map(self._known.tail.__getitem__, rest), strict=True) if first or rest else ((), ())
            if names:
                yield ",".join(names), b"".join(packed)

    # -- decoding -------------------------------------------------------------

    def decoder(self) -> Decoder:
        return Decoder(self)

    def decode(self, ids) -> str:
        d = self.decoder()
        return d.feed(np.asarray(ids, "<u4").tobytes()) + d.end()


class Decoder:
    """Byte-to-text state machine: bytes that no character ends yet are held back."""

    def __init__(self, codec: Codec):
        self.codec, self.state = codec, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        c, ids = self.codec, np.frombuffer(packed, "<u4")
        width = c.width[ids]
        ends = np.cumsum(width)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(c.start[ids] - ends + width, width)
        return self.state.decode(c.flat[where].tobytes())

    def end(self) -> str:
        return self.state.decode(b"", True)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array) of each row. Null text has no ids; rows may repeat; other columns are not read."""

    def start():
        c = codec(tokenizer)
        ids = lambda t: np.frombuffer(b"".join(packed for _, packed in c.stream(t)), "<u4").astype("int32")
        return lambda b: {"doc_id": b.column("doc_id"), "ids": [ids(t) for t in b.column("text").to_pylist()]}

    return map_columns(id_and_text(docs, id_col, text_col), start, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give empty text."""

    def start():
        c = codec(tokenizer)
        return lambda b: {"doc_id": b.column("doc_id"), "text": [c.decode(i or []) for i in b.column("ids").to_pylist()]}

    return map_columns(encoded.select("doc_id", "ids"), start, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; the digests grow as ids are emitted, so a long text needs no more room than a run of it.

    Null and empty text have no tokens, and both digests are those of the empty string.
    """

    def start():
        c = codec(tokenizer)

        def step(b):
            out = {f.name: [] for f in RESULT} | {"doc_id": b.column("doc_id")}
            for text in b.column("text").to_pylist():
                names, plain, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, c.decoder()
                for text_ids, packed in c.stream(text):
                    if n and packed:
                        names.update(b",")
                    names.update(text_ids.encode())
                    n += len(packed) // 4
                    plain.update(decoder.feed(packed).encode("utf-8"))
                plain.update(decoder.end().encode("utf-8"))
                out["n_tokens"].append(n)
                out["ids_sha256"].append(names.hexdigest())
                out["decoded_sha256"].append(plain.hexdigest())
            return out

        return step

    return map_columns(id_and_text(docs, id_col, text_col), start, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
