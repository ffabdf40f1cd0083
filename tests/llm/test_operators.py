"""The corpus operators on small fixtures, against brute force."""

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import ann, bpe, chat, exact_dedup, langid, minhash, packing, pii, substring_dedup, toxicity

TOK = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
EDGE = [(1, None), (2, ""), (3, "  \n\t"), (4, "a b"), (5, "a  b "), (5, "a  b "), (None, "x"), (6, "word " * 30000), (7, "é🙂日本 'tis <|endoftext|> 12"), (8, "9" * 3000)]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en", "s", 0, "clash", 1) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, rank int")


@pytest.fixture(scope="module")
def none(edge):
    return edge.filter("false")


def test_empty_tables(spark, none):
    for f in (exact_dedup.exact_dedup, minhash.near_duplicates, pii.find_private, substring_dedup.repeats, exact_dedup.keep_first_copies, minhash.keep_one_of_each, pii.sanitise):
        assert f(none).count() == 0
    assert packing.pack(none, TOK).count() == 0 and bpe.round_trip(none, TOK).count() == 0
    assert langid.identify(none, langid.fit(none)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_exact_dedup_edges(edge):
    got = exact_dedup.exact_dedup(edge).collect()
    assert len(got) == len(EDGE)
    by = {(r.doc_id, r.keep_id, r.group_size) for r in got}
    assert (1, 3, 3) in by and (2, 3, 3) in by and (4, 5, 3) in by and (None, None, 1) in by
    assert sum(r.kept for r in got if r.doc_id == 5) == 1
    assert exact_dedup.keep_first_copies(edge).count() == sum(r.kept for r in got)


def test_exact_dedup_tells_colliding_digests_apart(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a ", "c", "bb", "b"])], "doc_id long, text string")
    weak = exact_dedup.exact_dedup(d, digest=lambda t: F.length(t).cast("string").cast("binary"))
    pick = lambda x: sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in x.collect())
    assert pick(weak) == pick(exact_dedup.exact_dedup(d))


def test_bpe_equals_library(edge):
    tok = Tokenizer.from_file(TOK)
    want = sorted((str(i), hashlib.sha256(",".join(map(str, tok.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest()) for i, t in EDGE)
    rows = bpe.round_trip(edge, TOK).collect()
    assert sorted((str(r.doc_id), r.ids_sha256) for r in rows) == want
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(bpe.encode(edge, TOK), TOK).collect()) == sorted((str(i), t or "") for i, t in EDGE)


def test_bpe_fuzz_and_long_words():
    c, tok, r = bpe.codec(TOK), Tokenizer.from_file(TOK), random.Random(1)
    some = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "日本", "🙂", "<|endoftext|>", "12", "!!", ",", ".", "ing", "\x1c", "\x85", "word.\nNext", "x,"]
    encode = packing.encoder(TOK)
    for _ in range(1500):
        s = "".join(r.choice(some) for _ in range(r.randint(0, 25)))
        want = tok.encode(s, add_special_tokens=False).ids
        assert c.encode_text(s) == want == np.frombuffer(b"".join(p for _, p in c.stream(s)), "<u4").tolist() == np.frombuffer(encode(s), "<u4").tolist()
        assert c.decode(want) == tok.decode(want, skip_special_tokens=False)
    s = "".join(r.choice(["tion", "the", "ing", "WASH", "a"]) for _ in range(4000))
    assert c.encode_word(s.encode()) == tok.encode(s, add_special_tokens=False).ids


def test_packing(edge):
    rows = packing.pack(edge, TOK).collect()
    tok = Tokenizer.from_file(TOK)
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in EDGE}
    bins = {}
    for r in rows:
        want = ids[r.doc_id][r.start : r.start + r.length]
        assert len(want) == r.length <= 1024 and zlib.crc32(np.array(want, "<u4").tobytes()) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) == sum(len(ids[i]) for i, _ in EDGE)


def test_packing_encodes_batches_as_the_library_does():
    tok, r = Tokenizer.from_file(TOK), random.Random(9)
    some = ["a", "the", " ", " ", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "''", "s", "'ll", "é", "Éß", "×", "ª", "²", "日本", "<|endoftext|>", "<|", "12", "!!", "%%%", ",", ".", "-", "\x1c", "\x85", "\xa0", "\u2003", "word.\nNext", "x,", "ing_", "\r\n"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 25))) for _ in range(4000)]
    encode = packing.Encoder(TOK)
    for first, count in packing.slices(pa.array(texts), 3000):
        ids, bounds = encode.ids_of_all(pa.array(texts).slice(first, count), b"\2\0\0\0")
        got = np.frombuffer(ids, "<u4")
        assert len(bounds) == count + 1
        for k in range(count):
            assert got[bounds[k] : bounds[k + 1]].tolist() == [*tok.encode(texts[first + k], add_special_tokens=False).ids, 2], texts[first + k]


def test_packing_sorts_plain_words_without_the_whole_library():
    encode = packing.Encoder(TOK)
    whole, calls = encode.tok, []

    class Counted:
        def encode(self, text, **how):
            calls.append(text)
            return whole.encode(text, **how)

    encode.tok = Counted()
    text = "Einmal übertrieb er's, dann%%% nicht.\nThe end, 1984; x-ray anne3b###"
    ids, _ = encode.ids_of_all(pa.array([text, text + " too"]), b"")
    want = [i for t in (text, text + " too") for i in whole.encode(t, add_special_tokens=False).ids]
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert calls and not [c for c in calls if any(x.isalpha() for x in c) and c != "'s"]


def test_bin_shapes_use_every_item_once_and_few_bins():
    r = random.Random(2)
    for _ in range(200):
        cap = r.choice([10, 17, 100])
        counts = {s: r.randint(1, 9) for s in r.sample(range(1, cap + 1), r.randint(1, min(10, cap)))}
        used = {}
        shapes = packing.bin_shapes(counts, cap)
        for times, sizes in shapes:
            assert times > 0 and sum(sizes) <= cap
            for s in sizes:
                used[s] = used.get(s, 0) + times
        assert used == counts
        assert sum(t for t, _ in shapes) <= 2 * -(-sum(s * n for s, n in counts.items()) // cap)  # no two bins are half empty


def test_minhash_estimates_and_links(spark, edge):
    r = random.Random(3)
    base = [f"w{r.randint(0, 9999)}" for _ in range(200)]
    near = [w if k not in (50, 150) else "changed" for k, w in enumerate(base)]
    far = [w if k % 9 else f"z{k}" for k, w in enumerate(base)]
    a, b = minhash.shingles(base), minhash.shingles(near)
    sig = minhash.signatures([a, b, (a[0], a[1] * 3)])
    assert abs((sig[0] == sig[1]).mean() - minhash.probability_jaccard(a, b)) < 0.15 and (sig[0] == sig[2]).mean() > 0.5
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base)), (5, None), (6, ""), (7, "one two"), (8, "One two"), (None, "x")], "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6, 7: 7, 8: 7, None: None}
    assert minhash.near_duplicates(edge).count() == len(EDGE)
    assert minhash.keep_one_of_each(edge).columns == edge.columns


def test_large_buckets_lose_no_link(spark):
    r = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        for k in r.sample(range(120), 2):
            w[k] = f"x{i}.{k}"
        texts.append(" ".join(w))
    sets = [set(minhash.shingles(minhash.words(t))[0].tolist()) for t in texts]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(60):
        for b in range(a):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in minhash.near_duplicates(docs, small=4).collect()} == {i: find(i) for i in range(60)}


def test_a_repeated_line_loses_no_link(spark):
    base = [f"w{k}" for k in range(200)]
    line = [f"v{k}" for k in range(10)]
    docs = spark.createDataFrame([(i * 10 + j, " ".join(f"{i}{w}" for w in base + line * (40 * j))) for i in range(6) for j in (0, 1)], "doc_id long, text string")
    for small in (12, 1):
        assert {x.doc_id: x.class_id for x in minhash.near_duplicates(docs, small=small).collect()} == {i * 10 + j: i * 10 for i in range(6) for j in (0, 1)}


def test_blocks_find_links_behind_borderline_pairs(spark):
    def text(*parts):
        return (np.concatenate([np.arange(a, b) for a, b in parts]).astype(np.uint64) << np.uint64(32)).tobytes()

    # Documents 1 and 3 have 163 of 204 shingles in common, just under 0.8; 2 and 4, of the same classes, have 190 of 200.
    shape = [(1, text((1, 164), (1000, 1020))), (2, text((2000, 2195))), (3, text((1, 164), (1100, 1121))), (4, text((2005, 2200)))]
    rest = spark.createDataFrame([(7, 1, 1, 4, 800), (7, 2, 1, 4, 800), (7, 3, 3, 4, 800), (7, 4, 3, 4, 800)], "key long, doc_id long, root long, n long, s long")
    assert [tuple(r) for r in minhash.across(rest, spark.createDataFrame(shape, "doc_id long, sh binary"), 0.8).collect()] == [(2, 4)]
    assert [tuple(r) for r in minhash.across(rest, spark.createDataFrame(shape, "doc_id long, sh binary"), 0.8, most=200).collect()] == [(2, 4)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and max(map(int, m.group().split("."))) <= 255, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_pii_base_spans(spark):
    r = random.Random(5)
    some = ["a", "b.", "..", "@", "x@y.z", ".", "1", "22", "4111 1111 1111 1111", "+", "+1 (555) 123-4567", " ", "-", "256", "1.2.3.4", "_", "é", "🙂", "", "", "\n", "@a.b", "a.b@c..d", ")"]
    rows = [(i, "".join(r.choice(some) for _ in range(r.randint(0, 12)))) for i in range(500)] + [(i + 1000, t) for i, t in enumerate([None, "", "1 " * 2000, "a" * 9000 + "@b.c"])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.s for x in pii.find_private(d).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()}
    assert got == {i: plain_spans(t) for i, t in rows}


def test_pii_disclosing_terms(spark):
    rows = [(i, f"zorblax mail bob@x.org about the plan {i}") for i in range(6)] + [(100 + i, "the plan about other mail") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in pii.sanitise(d).collect()}
    assert all("zorblax" not in got[i] and "[EMAIL]" in got[i] and "plan" in got[i] for i in range(6))
    assert all(got[100 + i] == "the plan about other mail" for i in range(60))


def test_pii_terms_of_rare_entities(spark):
    rows = [(1, "quorvath wrote from ann@x.org about the plan"), (2, "the plan of fennimore by eve@acme.io"), (3, "fennimore has the plan and joe@acme.io"), (4, "the lonely word")]
    rows += [(100 + i, "the plan wrote from about other mail of has and by") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in pii.sanitise(d).collect()}
    # A name beside an entity of one document, and one that goes with two addresses of a domain.
    assert got[1] == "[TERM] wrote from [EMAIL] about the plan"
    assert got[2] == "the plan of [TERM] by [EMAIL]" and got[3] == "[TERM] has the plan and [EMAIL]"
    assert all(got[i] == t for i, t in rows if i >= 4)


def test_language_spans_and_edges(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(langid.train_rows(docs))
    held = docs.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0")
    rows = langid.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.9
    got = langid.identify(edge, model).collect()
    assert len(got) == len(EDGE) and all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3, 8))
    r = random.Random(6)
    for _ in range(100):
        s = np.array([[r.gauss(0, 3) for _ in range(3)] for _ in range(r.randint(1, 6))])
        path = langid.viterbi(s, 2.0)
        value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023, B905
        import itertools

        assert value(path) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(s)))))


def test_toxicity_learns(spark, edge):
    docs = spark.createDataFrame([(i, f"word{i % 7} and {'idiot' if i % 3 == 0 else 'friend'} here {i}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(401, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 3 == 0) for i in range(420, 600))
    assert all(0 <= r.score <= 1 for r in toxicity.score(edge, model).collect())


def test_substring_repeats(spark):
    r = random.Random(7)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))
    passage = text(70)
    rows = [(1, f"{text(80)} {passage} {text(50)}"), (2, f"{text(33)} {passage}"), (3, text(200)), (4, None), (5, ""), (6, f"é {passage} {text(9)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = substring_dedup.repeats(docs)
    got = spans.collect()
    assert {x.doc_id for x in got} == {1, 2, 6} and {x.doc_id for x in got if x.removed} == {2, 6}
    for x in got:
        assert dict(rows)[x.doc_id][x.start : x.end] in passage + " " or x.n_chunks
    left = {x.doc_id: x.text for x in substring_dedup.remove_repeats(docs, spans).collect()}
    assert left[1] == rows[0][1] and len(left[2]) < len(rows[1][1]) - 150 and left[4] is None


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 16))
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(d, F.col("vec_id") % 20 == 0, k=10)
    hit = total = 0
    for q, g in got.toPandas().groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:10]
        hit, total = hit + len(set(want) & set(g["vec_id"])), total + 10
        assert list(g.sort_values("rank")["score"]) == sorted(g["score"], reverse=True)
    assert total == 200 and hit / total >= 0.9


def neighbours(x, q, k):
    s = x @ x[q]
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:k]


def test_nearest_neighbours_meet_few_rows(spark):
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(300, 16))[:, None, :] + 0.35 * rng.normal(size=(300, 20, 16))).reshape(-1, 16)
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    set_ = {"k": 10, "curves": 96, "rows_on": 24, "queries_on": 44, "reach": 20}
    assert 2 * set_["reach"] * set_["queries_on"] < 0.3 * len(x)
    ask = F.col("vec_id") % 40 == 0
    whole, parts = (sorted(map(tuple, ann.nearest(d, ask, part_rows=p, **set_).collect())) for p in (1 << 30, 64))
    assert whole == parts  # windows go on behind the end of a part
    hits = sum(v in set(neighbours(x, q, 10)) for q, _, v, _ in whole)
    assert hits / len(whole) >= 0.9


def test_nearest_neighbours_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0]), (3, [1.0, 0.0, 5.0]), (None, [1.0]), (4, [float("inf")])]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rank string, score int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(d, F.col("vec_id") == 2, k=3).collect()}
    assert got == {(2, 1): (1, 3.0), (2, 2): (3, 3.0), (2, 3): (1, 0.0)}


def chat_rows(spark, rows, schemas=()):
    s = spark.createDataFrame(list(schemas), "name string, arg string, type string, required boolean")
    d = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, status string, json string")
    return chat.link(d, s).orderBy("conv_id", "at_turn", "at_nth", "depth", "behind", "turn", "nth", "json").collect()


def test_chat_links(spark):
    rows = [
        (1, 0, "user", 'say "x"'), (1, 1, "assistant", '{"content":"hm","tool_calls":[{"id":"a","name":"f","arguments":{"y":2,"x":"7","n":{"q":2.50,"b":[1,{"z":null,"c":"é"}]}}},{"id":"b","function":{"name":"g","arguments":"{\\"k\\":1}"},"depends_on":["a"]}]}'),
        (1, 3, "tool", '{"tool_call_id":"a","content":{"v":1,"u":"42"}}'), (1, 0, "tool", '{"tool_call_id":"b","content":"early"}'), (1, 10**13, "tool", '{"tool_call_id":"zz","content":"?"}'), (None, None, None, None), (1, -5, "user", "first"),
    ]
    got = chat_rows(spark, rows, [("f", "x", "integer", True), ("f", "z", "string", True), ("f", "n", "object", False)])
    assert [(r.kind, r.call_id, r.status) for r in got if r.conv_id == 1] == [
        ("message", None, "ok"), ("message", None, "ok"), ("message", None, "ok"), ("call", "a", "invalid"), ("result", "a", "ok"), ("call", "b", "ok"), ("result", "b", "ok"), ("result", "zz", "orphan"),
    ]
    by = {(r.kind, r.call_id): r for r in got}
    assert by["call", "a"].errors == ["missing:z", "type:x", "unknown:y"]
    assert by["call", "a"].json == '{"arguments":{"n":{"b":[1,{"c":"é","z":null}],"q":2.5},"x":"7","y":2},"id":"a","name":"f","role":"assistant"}'
    assert by["call", "b"].json == '{"arguments":{"k":1},"depends_on":["a"],"id":"b","name":"g","role":"assistant"}'
    assert by["result", "a"].json == '{"content":{"u":"42","v":1},"id":"a","role":"tool"}'
    assert [r.json for r in got if r.conv_id is None] == ['{"content":"","role":null}'] and any(r.json == '{"content":"hm","role":"assistant"}' for r in got)


def test_chat_ties_repeats_and_circles(spark):
    call = lambda i, x, *on: json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": {"x": x}, "depends_on": list(on)}]})
    rows = [(1, 1, "assistant", call("a", 1)), (1, 1, "assistant", call("b", "no")), (1, 2, "assistant", call("a", 3)), (2, 1, "assistant", call("p", 1, "q")), (2, 2, "assistant", call("q", 1, "p")), (2, 3, "assistant", call("r", 1, "p"))]
    rows += [(3, 0, "user", "long " * 200_000), (3, 1, "tool", '{"tool_call_id":"s","content":"x"}'), (3, 1, "tool", '{"tool_call_id":"s","content":"x"}'), (3, 1, "assistant", '{"tool_calls":[{"id":"s","id":"t"}]}'), (4, 1, "assistant", call("u", 1, "gone"))]
    got = chat_rows(spark, rows, [("f", "x", "integer", True)])
    assert [(r.conv_id, r.call_id, r.status, r.errors) for r in got if r.kind != "message"] == [
        (1, "b", "invalid", ["type:x"]), (1, "a", "unanswered", []), (1, "a", "duplicate", []), (2, "p", "circular", []), (2, "q", "circular", []), (2, "r", "circular", []),
        (3, "s", "orphan", []), (3, "s", "orphan", []), (4, "u", "invalid", ["unlinked:gone"]),
    ]
    assert sum(r.kind == "message" for r in got) == 2 and max(len(r.json) for r in got) > 1_000_000


def test_chat_orders_chains(spark):
    r = random.Random(11)
    rows, needs = [], {}
    for i in range(40):
        on = [f"c{j}" for j in r.sample(range(i), min(i, r.randint(0, 2)))]
        needs[f"c{i}"] = on
        rows.append((1, r.randint(0, 9), "assistant", json.dumps({"tool_calls": [{"id": f"c{i}", "name": "f", "arguments": {}, "depends_on": on}]})))
        rows.append((1, r.randint(0, 9), "tool", json.dumps({"tool_call_id": f"c{i}", "content": i})))
    at = {(x.kind, x.call_id): n for n, x in enumerate(chat_rows(spark, rows))}
    assert len(at) == 80 and all(at["call", c] < at["result", c] for c in needs)
    assert all(at["result", o] < at["call", c] for c, on in needs.items() for o in on)


def plain_repeats(rows, least_chars=120):
    """Spans by chunks compared as text."""
    held, seen = {}, {}
    for i, t in rows:
        data, at, out = (t or "").encode(), 0, []
        for end in substring_dedup.cuts(data):
            piece = data[at:end].decode()
            out.append((len(data[:at].decode()), piece))
            seen.setdefault(piece, set()).add(i)
            at = end
        held[i, t] = out
    spans = set()
    for (i, _), out in held.items():
        run = []
        for start, piece in [*out, (0, "")]:
            owners = seen.get(piece, set())
            removed = min(owners) != i if len(owners) > 1 else None
            if run and (removed is None or removed != run[0][2]):
                if run[-1][0] + len(run[-1][1]) - run[0][0] >= least_chars:
                    spans.add((i, run[0][0], run[-1][0] + len(run[-1][1]), run[0][2]))
                run = []
            if removed is not None:
                run.append((start, piece, removed))
    return spans


def test_substring_repeats_equal_brute_force(spark):
    r = random.Random(12)
    text = lambda n: " ".join("".join(r.choice("abcdefghé日") for _ in range(r.randint(2, 8))) for _ in range(n))
    passages = [text(60) for _ in range(4)]
    rows = [(i, " ".join(x for _ in range(3) for x in (text(r.randint(0, 40)), r.choice(passages), text(2)))) for i in range(40)] + [(50, None), (51, ""), (52, passages[0] * 300), (53, text(3)), (53, text(3))]
    rows += rows[:3]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, start string")
    got = substring_dedup.repeats(docs)
    assert {(x.doc_id, x.start, x.end, x.removed) for x in got.collect()} == plain_repeats(rows)


def test_cuts_belong_to_id_and_text(spark):
    r = random.Random(13)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, other = text(80), text(150)
    docs = spark.createDataFrame([(1, passage, 0), (2, text(20) + passage, 0), (2, other, 0), (None, passage, 0)], "doc_id long, text string, `a.b` int")
    left = substring_dedup.remove_repeats(docs, substring_dedup.repeats(docs))
    assert left.columns == docs.columns
    texts = [(x.doc_id, x.text) for x in left.collect()]
    assert (2, other) in texts and (1, passage) in texts and (None, passage) in texts and min(len(t) for i, t in texts if i == 2) < 400


def test_exact_dedup_of_a_hot_text(spark):
    rows = [(i, "" if i % 3 == 0 else f"t{i % 50}") for i in range(3000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    texts = dict(rows)
    assert all((x.keep_id, x.group_size) == (min(groups[texts[x.doc_id]]), len(groups[texts[x.doc_id]])) for x in got)


def plain_ftrl(rows, passes, alpha=1.0, beta=1.0, l1=3.0):
    z, n = {}, {}
    bias = 1 << toxicity.BITS
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= (0.0 if i == bias else l1) else -(z[i] - (0.0 if i == bias else np.sign(z[i]) * l1)) / ((beta + n[i] ** 0.5) / alpha)
    for _ in range(passes):
        for at, y in rows:
            at = [*at, bias]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_equals_plain_one(spark):
    rows = [(i, f"word{i % 7} and {'idiot' if i % 3 == 0 else 'friend'} here {chr(97 + i % 26)}") for i in range(90)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")  # repeated rows count once
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    order = sorted(rows, key=lambda x: xxhash.xxh64_intdigest(f"{x[0]} {x[1]}"))
    want = plain_ftrl([(np.unique(toxicity.features(t)).tolist(), int(i % 3 == 0)) for i, t in order], 5)
    got = toxicity.fit(docs, labels, shards=1)
    assert got["bias"] == pytest.approx(want.pop(1 << toxicity.BITS)) and dict(zip(got["at"].tolist(), got["w"], strict=True)) == pytest.approx(want)
    # One text, so one of four learners has rows: its weights aren't thinned by the others.
    few = toxicity.fit(docs.filter("doc_id = 0").withColumn("text", F.lit("idiot")), labels)
    assert few["bias"] == pytest.approx(plain_ftrl([(np.unique(toxicity.features("idiot")).tolist(), 1)], 5)[1 << toxicity.BITS])


def plain_terms(rows, remove_at=0.95, generalise_at=0.85):
    """Texts with entities and disclosing terms replaced, by counting in Python."""
    texts = [t or "" for _, t in rows]
    words = [set(x.lower() for x in regex.findall(pii.WORD, t)) for t in texts]
    spans = [[x.split(":") for x in plain_spans(t).split(",") if x] for t in texts]
    holders = {}
    for r, (t, found) in enumerate(zip(texts, spans, strict=True)):
        for kind, a, b in found:
            m = t[int(a) : int(b)]
            entity = m.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", m)
            holders.setdefault((kind, entity), set()).add(r)
            if kind == "email":
                holders.setdefault(("domain", entity.rsplit("@", 1)[1]), set()).add(r)
    flagged = [{} for _ in rows]
    for held in holders.values():
        n_e = len(held)
        if n_e >= len(rows):
            continue
        for term in set().union(*(words[r] for r in held)):
            n_t, n_et = sum(term in w for w in words), sum(term in words[r] for r in held)
            p = min(n_et / n_t, 1.0)
            low = (p + 1 / (2 * n_t) - math.sqrt(p * (1 - p) / n_t + 1 / (4 * n_t * n_t))) / (1 + 1 / n_t)
            share = 1 + math.log2(low) / math.log2(len(rows) / n_e) if low > 0 else -1
            if share >= generalise_at:
                for r in held:
                    if term in words[r]:
                        flagged[r][term] = max(flagged[r].get(term, ""), "remove" if share >= remove_at else "generalise")
    out = []
    for t, found, marks in zip(texts, spans, flagged, strict=True):
        cuts = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in found]
        cuts += [(m.start(), m.end(), "" if marks[m.group().lower()] == "remove" else "[TERM]") for m in regex.finditer(pii.WORD, t) if m.group().lower() in marks and not any(a < m.end() and m.start() < b for a, b, _ in cuts)]
        at, parts = 0, []
        for a, b, new in sorted(cuts, key=lambda c: c[:2]):
            if a >= at:
                parts += [t[at:a], new]
            at = max(at, b)
        out.append("".join(parts) + t[at:])
    return out


def test_pii_terms_equal_brute_force(spark):
    r = random.Random(14)
    names, common = [f"name{chr(97 + i)}" for i in range(12)], "the plan was sent from our office by mail today".split()
    rows = []
    for i in range(150):
        who = r.choice(names) if i % 4 == 0 else ""
        rows.append((i, " ".join([who, *r.sample(common, 5), f"{who}@x{len(who) and ord(who[-1]) % 3}.org" if who else "", "10.0.0.7" if i % 11 == 0 else "", r.choice(["", "note", "Étude"])])))
    rows += [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert [got[i] or "" for i, _ in rows] == plain_terms(rows) and sum("[TERM]" in (t or "") for t in got.values()) > 3


def fewest_bins(items, cap):
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = [len(items)]

    def fill(k, room, left):
        if k == len(rest):
            best[0] = min(best[0], 1 + fewest_bins(tuple(left), cap))
            return
        if rest[k] <= room:
            fill(k + 1, room - rest[k], left)
        fill(k + 1, room, [*left, rest[k]])

    fill(0, cap - first, [])
    return best[0]


def test_reduction_costs_no_bin():
    r = random.Random(15)
    threes = above = 0
    for _ in range(300):
        cap = r.choice([10, 13, 20])
        items = sorted((r.randint(1, cap) for _ in range(r.randint(1, 7))), reverse=True)
        counts = {s: items.count(s) for s in items}
        fixed, left = packing.reduce_by_dominance(counts, cap)
        rest = tuple(sorted((s for s, n in left.items() for _ in range(n)), reverse=True))
        want = fewest_bins(tuple(items), cap)
        assert sum(t for t, _ in fixed) + fewest_bins(rest, cap) == want
        threes += sum(len(s) == 3 for _, s in fixed)
        above += sum(t for t, _ in packing.bin_shapes(counts, cap)) > want
    assert threes > 20 and above <= 6


def test_transducer_on_random_merge_lists_and_blocks():
    r, c = random.Random(16), bpe.codec(TOK)

    def whole(data, rank):
        ids = [bytes([x]) for x in data]
        while found := min(((rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank), default=None):
            ids[found[1] : found[1] + 2] = [ids[found[1]] + ids[found[1] + 1]]
        return ids

    for _ in range(1500):
        tokens, merges = [b"a", b"b", b"c"], []
        for _ in range(r.randint(1, 12)):
            pair = (r.choice(tokens), r.choice(tokens))
            if pair not in merges:
                merges.append(pair)
                tokens += [pair[0] + pair[1]] * (pair[0] + pair[1] not in tokens)
        rank, need = {p: i for i, p in enumerate(merges)}, bpe.lookaheads(merges)
        data, block, held, got = bytes(r.choice(b"abc") for _ in range(r.randint(1, 40))), r.randint(1, 6), b"", []
        for k in range(0, len(data), block):
            held, at = held + data[k : k + block], 0
            for t in whole(held, rank):
                if at + len(t) + need[t] > len(held):
                    break
                at += len(t)
                got.append(t)
            held = held[at:]
        assert got + whole(held, rank) == whole(data, rank)
    for _ in range(300):
        data, block = "".join(r.choice(["tion", "the", "ing", "aaaa", "é"]) for _ in range(r.randint(1, 60))).encode(), r.randint(1, 64)
        assert list(c.stream_word(data[k : k + block] for k in range(0, len(data), block))) == c._whole(data)


def test_long_texts_stream(monkeypatch):
    c, tok, r = bpe.codec(TOK), Tokenizer.from_file(TOK), random.Random(17)
    monkeypatch.setattr(bpe, "BLOCK", 64)
    some = ["a", "the", " ", "  ", "\n", "'s", "é", "🙂", "<|endoftext|>", "12", ",", "word.\nNext", "x" * 400, " " * 60]
    for _ in range(300):
        s = "".join(r.choice(some) for _ in range(r.randint(0, 60)))
        want = tok.encode(s, add_special_tokens=False).ids
        got = list(c.stream(s))
        assert np.frombuffer(b"".join(p for _, p in got), "<u4").tolist() == want == [int(x) for n, _ in got for x in n.split(",")]


def test_pipeline_stages_equal_brute_force(spark):
    r = random.Random(18)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(20, 60))) for _ in range(30)]
    for i in range(12):
        w = texts[i].split()
        w[r.randrange(len(w))] = "changed"
        texts.append([texts[i], texts[i].replace(" ", "  "), " ".join(w)][i % 3])
    texts += [f"{t} mail kim{i}@acme.org" for i, t in enumerate(texts[20:26])] + ["12 34", None, ""]
    rows = [(i, t, "aa", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    held = dict(enumerate(texts))
    told = lambda df: {x.doc_id: x.text for x in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, SF)
    assert told(one) == {i: t for i, t in held.items() if t and re.search("[a-z]", t)}
    two = stages["exact_dedup"](spark, one, SF)
    best = {}
    for i, t in told(one).items():
        key = re.sub(r"\s", "", t)
        best[key] = max(best.get(key, (-1, 0)), (len(t), -i))
    assert set(told(two)) == {-i for _, i in best.values()}
    three = stages["minhash_near_dedup"](spark, two, SF)
    sets = {i: set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) for i, t in told(two).items()}
    root = {i: i for i in sets}
    for _ in root:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert set(told(three)) == {i for i in root if root[i] == i} and len(told(three)) < len(told(two))
    four = stages["pii"](spark, three, SF)
    before = sorted(told(three).items())
    assert [t for _, t in sorted(told(four).items())] == plain_terms(before)
    assert all(x.n_chars == len(x.text) for x in four.collect())
    five = stages["best_fit_packing"](spark, four, SF).collect()
    tok = Tokenizer.from_file(TOK)
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in told(four).items()}
    assert sorted(x.doc_id for x in five) == sorted(ids) and all(zlib.crc32(np.array(ids[x.doc_id], "<u4").tobytes()) == x.ids_crc32 for x in five)
    assert len({x.sequence_id for x in five}) >= -(-sum(map(len, ids.values())) // 1024)


def test_pipeline_stages_take_edges(spark, edge, none):
    for docs in (edge, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == edge.columns, name
        assert corpus_pipeline.pack_sequences(spark, docs, SF).count() >= 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "pii", "best_fit_packing"]
