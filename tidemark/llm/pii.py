"""Information-theoretic sanitisation in DataFrame operations only.

Base patterns find the protected entities themselves (e-mail, IP, card, phone).
Over the whole corpus, the pointwise mutual information of a term and an entity
tells how much of the entity's information IC(e) = -log2 p(e) the term gives
away; it is a lower bound, so that rare entities count as well. Terms that disclose too large a share of it are removed, and those that
disclose a smaller but notable share are generalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import hot_keys, join_spread, read_table, settle, store

KINDS = ("email", "ip", "card", "phone")
#: Marks put around matches; in texts they are first replaced by a character of the same length.
_OPEN, _CLOSE, _DOT, _STAND_IN = "\ue000", "\ue001", "\ue002", "\u00a0"
_LOCAL, _LABEL = f"A-Za-z0-9._%+{_DOT}-", "A-Za-z0-9-"
#: A word for statistics.
WORD = r"[\p{L}][\p{L}\p{M}]*"


def _clean(text: Column) -> Column:
    return F.translate(text, _OPEN + _CLOSE + _DOT, _STAND_IN * 3)


def _marked(text: Column, kind: str) -> Column:
    """``text`` with each match of the kind's pattern between marks.

    The expressions match what the plain patterns match, leftmost and without
    overlap, in linear time and without recursion on long runs.
    """
    around = f"{_OPEN}$0{_CLOSE}"
    if kind == "email":
        # Dots that no label follows can't be in a domain; they get a stand-in that a local part may have.
        dotted = F.regexp_replace(text, f"\\.(?![{_LABEL}])", _DOT)
        found = F.regexp_replace(dotted, f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++\\.[{_LABEL}][A-Za-z0-9.-]*+", around)
        return F.translate(found, _DOT, ".")
    if kind == "ip":
        return F.regexp_replace(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", around)
    if kind == "card":
        # A chain of digits with single blanks or hyphens between; its two ends are marked.
        begins = F.regexp_replace(text, r"(?<![0-9])(?<![0-9][ -])(?=[0-9])", _OPEN)
        return F.regexp_replace(begins, r"(?<=[0-9])(?![ -]?[0-9])", _CLOSE)
    return F.regexp_replace(text, r"\+[0-9][ ().0-9-]+[0-9]", around)


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, match>> of the kind's valid matches, in code points."""
    rows = F.transform(F.split(_marked(text, kind), _OPEN), lambda p: F.split(p, _CLOSE))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,match:string>>").alias("out"))

    def add(acc: Column, part: Column) -> Column:
        inside = F.size(part) > 1
        hit = F.struct(acc["at"].alias("start"), (acc["at"] + F.length(part[0])).alias("end"), part[0].alias("match"))
        width = F.length(part[0]) + F.when(inside, F.length(F.get(part, F.lit(1)))).otherwise(0)
        valid = F.when(inside, _holds(part[0], kind)).otherwise(False)
        return F.struct((acc["at"] + width).alias("at"), F.when(valid, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, start, add)["out"]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: x.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, x * 2 - 9).otherwise(x * 2)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(match: Column, kind: str) -> Column:
    if kind == "ip":
        byte = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return match.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$")
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _quick(text: Column, kind: str) -> Column:
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9].?[0-9]"))


_SPANS = "array<struct<start:long,order:int,end:long,kind:string,entity:string>>"


def _spans_of(text: Column, kind: str, order: int) -> Column:
    entity = F.lower if kind in ("email", "ip") else _digits
    spans = F.transform(matches(text, kind), lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind"), entity(m["match"]).alias("entity")))
    return F.when(_quick(text, kind), spans).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """array<struct<start, order, end, kind, entity>> of valid matches of all kinds, sorted by start, then kind."""
    return F.array_sort(F.concat(*[_spans_of(text, kind, order) for order, kind in enumerate(KINDS)]))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def row_key(doc: Column, text: Column) -> Column:
    """256-bit digest of a row's id and text, null id included."""
    return F.unhex(F.sha2(F.concat(F.coalesce(doc.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))), 256))


def held_terms(scanned: DataFrame) -> DataFrame:
    """(row, w, holder, n_e, term): each term of a row's text with each holder of the row; w is how often the row is there.

    A holder is a set of rows that an entity or an e-mail domain occurs in, n_e
    of them. Entities of the same rows have the same counts with every term, so
    they are one holder: a text with many addresses that are nowhere else has
    one, not as many as addresses. Texts meet their holders once a row, and an
    entity of very many rows is spread over tasks.
    """
    carriers = scanned.filter(F.size("base") > 0).groupBy("row").agg(F.count(F.lit(1)).alias("w"), F.first("text").alias("text"), F.first("base").alias("base"))
    names = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["entity"].alias("entity")))
    domains = F.transform(F.filter("base", lambda s: s["kind"] == "email"), lambda s: F.struct(F.lit("domain").alias("kind"), F.substring_index(s["entity"], "@", -1).alias("entity")))
    carriers = store(carriers.withColumn("owned", F.array_distinct(F.concat(names, domains))).drop("base"))
    owned = carriers.select("row", "w", F.explode("owned").alias("e")).select("row", "w", "e.*")
    mark = lambda seed: F.bit_xor(F.xxhash64("row", F.lit(seed)))
    sets = settle(owned.groupBy("kind", "entity").agg(F.sum("w").alias("n_e"), F.count(F.lit(1)).alias("n"), mark(1).alias("x1"), mark(2).alias("x2")))
    met = join_spread(owned, sets.drop("n"), ["kind", "entity"], hot_keys(sets, ["kind", "entity"]), ["row"])
    # A row's holders are bounded by its text, as its entities are.
    held = met.groupBy("row").agg(F.collect_set(F.struct(F.xxhash64("n_e", "x1", "x2").alias("holder"), F.col("n_e"))).alias("holders"))
    texts = carriers.select("row", "w", _terms(F.col("text")).alias("terms")).join(held, "row")
    return texts.select("row", "w", F.explode("holders").alias("h"), "terms").select("row", "w", "h.holder", "h.n_e", F.explode("terms").alias("term"))


def disclosing_terms(held: DataFrame, docs: DataFrame, total: int, remove_at: float, generalise_at: float, z: float) -> DataFrame:
    """(holder, term, action, n) over the corpus; n is in how many rows they are together.

    The share of IC(e) that a term discloses is PMI(e; t) / IC(e), that is
    log2(p(e|t) / p(e)) / -log2 p(e). p(e|t) is the lower end of its Wilson
    interval of ``z`` standard errors, so few documents count for less but
    rare entities are not left out.
    """
    together = held.groupBy("holder", "n_e", "term").agg(F.sum("w").alias("n_et")).filter(F.col("n_e") < total)
    frequency = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n = F.col("n_t")
    p = F.least(F.col("n_et") / n, F.lit(1.0))
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    information = F.log2(F.lit(float(max(1, total))) / F.col("n_e"))
    share = 1 + F.log2(low) / information
    return (
        together.join(frequency, "term").withColumn("share", share).filter(F.col("share") >= generalise_at)
        .select("holder", "term", F.when(F.col("share") >= remove_at, "remove").otherwise("generalise").alias("action"), F.col("n_et").alias("n"))
    )


def _term_spans(text: Column, flagged: Column) -> Column:
    """array<struct<start, order, end, kind, entity>> of the words of ``text`` that the map ``flagged`` has."""
    marked = F.regexp_replace(text, WORD, f"{_OPEN}$0{_CLOSE}")
    rows = F.transform(F.split(marked, _OPEN), lambda p: F.split(p, _CLOSE))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))

    def add(acc: Column, part: Column) -> Column:
        word = F.lower(part[0])
        action = F.when(F.size(part) > 1, F.try_element_at(flagged, word))
        hit = F.struct(acc["at"].alias("start"), F.when(action == "remove", 5).otherwise(4).alias("order"), (acc["at"] + F.length(part[0])).alias("end"), action.alias("kind"), word.alias("entity"))
        width = F.length(part[0]) + F.when(F.size(part) > 1, F.length(F.get(part, F.lit(1)))).otherwise(0)
        return F.struct((acc["at"] + width).alias("at"), F.when(action.isNotNull(), F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, start, add)["out"]


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_at: float = 0.95, generalise_at: float = 0.85, z: float = 1.0) -> DataFrame:
    """One row per input row: doc_id, base and spans (arrays of start, order, end, kind, entity), row.

    base has the entities found by pattern; spans adds terms that disclose one
    of the row's entities or their e-mail domains, of kind 'remove' (share of the entity's information
    of ``remove_at`` or more) or 'generalise' (``generalise_at`` or more), but
    not inside a base span. Null and empty text have none. ``row`` is a
    256-bit digest of id and text; rows that repeat both have the same spans.
    Terms are runs of letters in lower case. Other columns are not read.
    """
    doc, raw = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(doc.alias("doc_id"), _clean(raw).alias("text"), row_key(doc, raw).alias("row"))
    based = rows.select("doc_id", "row", base_spans(F.col("text")).alias("base"), "text")
    # Only texts with an entity are needed again.
    scanned = settle(based.withColumn("text", F.when(F.size("base") > 0, F.col("text"))))
    held = store(held_terms(scanned))
    rules = settle(disclosing_terms(held, rows, scanned.count(), remove_at, generalise_at, z))
    pair = ["holder", "term"]
    hits = join_spread(held.select("row", *pair), rules.drop("n"), pair, hot_keys(rules, pair), ["row"]).groupBy("row", "term").agg(F.max("action").alias("action"))
    flagged = hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("flagged"))
    # A row's flagged terms are terms of its own text: bounded by the text.
    joined = scanned.join(flagged, "row", "left")
    outside = lambda t: ~F.exists(F.col("base"), lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"]))
    terms = F.when(F.col("flagged").isNotNull(), F.filter(_term_spans(F.col("text"), F.col("flagged")), outside))
    spans = F.coalesce(F.array_sort(F.concat("base", terms)), F.col("base"))
    return joined.select("doc_id", "row", "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced: an entity by its kind, a generalised term by [TERM], a removed one by nothing."""
    state = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(
            F.struct(
                F.concat(
                    acc["out"],
                    F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                    F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))),
                ).alias("out"),
                s["end"].alias("at"),
            )
        ),
    )
    return F.concat(state["out"], F.substr(text, (state["at"] + 1).cast("int")))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with private spans replaced in the text.

    Rows without any are as they were, null text stays null, and rows that
    repeat id and text are redacted alike. Columns may have any name.
    """
    found = find_private(docs, id_col, text_col).filter(F.size("spans") > 0).select("row", "spans").dropDuplicates(["row"])
    text = F.col(f"`{text_col}`")
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(every.alias("all"), text.alias("text"), row_key(F.col(f"`{id_col}`").cast("long"), text).alias("row"))
    joined = rows.join(found, "row", "left").withColumn("clean", F.when(F.col("spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("spans"))))
    return joined.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"all.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
