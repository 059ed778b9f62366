"""Personal data by pattern, and terms that reveal it by information content.

Everything is DataFrame expressions.  The base finds e-mail addresses, IP
addresses, payment cards and phone numbers with linear-time forms of their
patterns; the places of matches follow from the lengths of the matches and of the
gaps between them.

The method then protects the found values (entities).  A term discloses an entity
by the information that it gives about it: the surprisal of the entity falls from
``log2(N / n_e)`` to ``log2(n_t / n_et)`` once the term is known, with n_e, n_t and
n_et the documents that hold the entity, the term and both anywhere, and N all
documents.  Every entity is scored, whatever the distance between the two: a term
needs ``MIN_SUPPORT`` distinct supporting texts, or all texts of an entity that
stands in fewer.  A term that lowers the surprisal of an entity, to ``LEFT_BITS`` or
less, is generalised to its kind wherever it stands in any document, unless within a
found value.  The threshold is on what is left to guess, not on a share of
``log2(N / n_e)``, so it means the same at every size of the corpus, and a marked
term stands in at most ``2 ** LEFT_BITS`` times as many documents as hold its entity
too: marks grow in proportion to the corpus.

Defined results: a null text is an empty one; spans of different kinds may
overlap; repeated rows get equal results; copies count as documents but not as
support; an empty table gives an empty result; extra columns, also such as clash
with names used here, stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, durable, need, table, with_hit

MIN_SUPPORT = 3
#: What a disclosing term leaves to guess of an entity: 1 bit is an even chance.
LEFT_BITS = 1.0
#: Letters and digits make a term; shorter ones are left alone.
TERM = r"[\p{L}\p{N}]+"
MIN_TERM = 3

# Leftmost matches of these patterns start at the start of a run of their first class, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPAN = "struct<kind:string,start:long,end:long,value:string>"
#: Elements that one step of a running aggregate appends to; keeps appending linear.
BLOCK, SUMS = 256, 32


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip_ok(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))


def _card_ok(m: Column) -> Column:
    d = _digits(m)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def _phone_ok(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


#: kind, pattern, what a match must satisfy, a cheap condition without which a text has none.
KINDS: tuple[tuple[str, str, Callable[[Column], Column], Callable[[Column], Column]], ...] = (
    ("email", EMAIL, lambda m: F.lit(True), lambda t: F.contains(t, F.lit("@"))),
    ("ip", IP, _ip_ok, lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]")),
    ("card", CARD, _card_ok, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
    ("phone", PHONE, _phone_ok, lambda t: F.contains(t, F.lit("+"))),
)


def running(pieces: Column, at: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """Array of what ``step`` appends to ``state["out"]``, ``state["at"]`` running along, in linear time.

    Appending copies the array, so elements are gathered in blocks.
    """
    none = F.array().cast(f"array<{kind}>")

    def block(state: Column, b: Column) -> Column:
        here = F.transform(F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.size(pieces)) - 1), lambda i: F.get(pieces, i))
        inner = F.aggregate(here, F.struct(state["at"].alias("at"), none.alias("out")), step)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.when(F.size(x["out"]) > 0, F.array_append(state["out"], x["out"])).otherwise(state["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int"))
    start = F.struct(at.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(pieces) > 0, F.aggregate(blocks, start, block, lambda s: F.flatten(s["out"]))).otherwise(none)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sums(lengths: Column) -> Column:
    """Running sums of an array of integers, gathered in blocks."""
    none = F.array().cast("array<int>")

    def block(state: Column, b: Column) -> Column:
        step = lambda t, i: F.struct((t["at"] + F.get(lengths, i)).alias("at"), F.array_append(t["out"], t["at"] + F.get(lengths, i)).alias("out"))
        inner = F.aggregate(F.sequence(b * SUMS, F.least((b + 1) * SUMS, F.size(lengths)) - 1), F.struct(state["at"].alias("at"), none.alias("out")), step)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.array_append(state["out"], x["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / SUMS).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    return F.when(F.size(lengths) > 0, F.aggregate(blocks, start, block, lambda s: F.flatten(s["out"]))).otherwise(none)


def matches(text: Column, kind: str, pattern: str, ok: Callable[[Column], Column]) -> Column:
    """Array of the spans of a pattern whose value is ``ok``, by start."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # A match ends where the gaps and matches up to it end; the text after the last one is left out.
    lengths = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
    span = lambda m, end: F.struct(F.lit(kind).alias("kind"), (end - F.length(m)).cast("long").alias("start"), end.cast("long").alias("end"), m.alias("value"))
    spans = F.zip_with(found, _let(lengths, sums), lambda m, end: F.when(m.isNotNull() & ok(m), span(m, end)))
    return F.filter(spans, lambda s: s.isNotNull())


def find(text: Column, kind: str, pattern: str, ok: Callable[[Column], Column], may: Callable[[Column], Column]) -> Column:
    """Array of spans of one kind, by start."""
    return F.when(may(text), matches(text, kind, pattern, ok)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    return F.concat(*(find(text, *k) for k in KINDS))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def revealing_terms(docs: DataFrame, held: DataFrame, n_docs: int, min_support: int = MIN_SUPPORT, left_bits: float = LEFT_BITS) -> DataFrame:
    """(term) of the terms that reveal an entity.

    ``docs`` has ``text``; ``held`` has (key, text, spans) of the documents with base spans.
    """
    # Copies of a text are alike: take each distinct text once, with its number of copies.
    texts = durable(held.groupBy("key").agg(F.min_by("text", "key").alias("text"), F.min_by("spans", "key").alias("spans"), F.count(F.lit(1)).alias("copies")), "pii-texts")
    mentions = texts.select("key", "copies", F.explode(F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"])))).alias("entity"))
    # Entities of the same texts have equal counts: score them as one, told by sums over their texts.
    mark = lambda seed: F.xxhash64("key", F.lit(seed))
    entities = mentions.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("texts"), F.sum(mark(1).cast("decimal(20,0)")).alias("a"), F.bit_xor(mark(2)).alias("b"))
    entities = entities.select("entity", F.struct("n_e", "texts", "a", "b").alias("same"))
    members = durable(mentions.join(entities, "entity").select("key", "copies", "same").distinct(), "pii-members")
    words = texts.select("key", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).filter(F.length("term") >= MIN_TERM)
    pairs = (
        members.join(words, "key")
        .groupBy("same", "term")
        .agg(F.sum("copies").alias("n_et"), F.count(F.lit(1)).alias("support"))
        .filter(F.col("support") >= F.least(F.lit(min_support), "same.texts"))
    )
    counts = docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).filter(F.length("term") >= MIN_TERM).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n, n_e = F.lit(float(n_docs)), F.col("same.n_e")
    before, left = F.log2(n / n_e), F.log2(F.col("n_t") / F.col("n_et"))
    return pairs.join(counts, "term").filter((left < before) & (left <= left_bits)).select("term").distinct()


def outside(terms: Column, spans: Column) -> Column:
    """The terms, by start, without those that lie within one of the spans; linear in both after a sort."""
    none = F.array().cast(f"array<{SPAN}>")
    order = lambda xs, last: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), F.lit(last).alias("last"), s["end"].alias("end"), s.alias("s")))

    def step(state: Column, x: Column) -> Column:
        free = (x["last"] == 1) & (x["end"] > state["at"])
        return F.struct(F.when(x["last"] == 0, F.greatest(state["at"], x["end"])).otherwise(state["at"]).alias("at"), F.when(free, F.array_append(state["out"], x["s"])).otherwise(state["out"]).alias("out"))

    both = F.array_sort(F.concat(order(spans, 0), order(terms, 1)))
    return F.when(terms.isNull(), none).otherwise(_let(both, lambda b: running(b, F.lit(-1).cast("long"), SPAN, step)))


def term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, terms) with the spans of disclosing terms in each distinct text of ``rows`` that has some.

    ``rows`` has (key, text).  Bitmaps keep words that are no such terms, and texts
    without one, out of the shuffles.
    """
    bits = bitmap_of(terms, "term", "pii-term-bits")
    words = rows.select("key", F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).filter(F.length("term") >= MIN_TERM)
    hits = with_hit(words, words["term"], bits, "hit").filter("hit").join(terms, "term", "left_semi").select("key").distinct()
    texts = with_hit(rows, rows["key"], bitmap_of(hits, "key", "pii-key-bits"), "hit").filter("hit").groupBy("key").agg(F.min_by("text", "key").alias("text"))
    placed = texts.select("key", F.explode(matches(F.col("text"), "term", TERM, lambda w: F.length(w) >= MIN_TERM)).alias("span")).select("key", "span", F.lower("span.value").alias("term"))
    placed = with_hit(placed, placed["term"], bits, "hit").filter("hit").join(terms, "term", "left_semi")
    return durable(placed.groupBy("key").agg(F.collect_list("span").alias("terms")), "pii-marked")


def analyse(docs: DataFrame, **thresholds) -> DataFrame:
    """(doc_id, key, spans, terms): base spans of every row, and spans of disclosing terms.

    ``key`` is the MD5 of the text.
    """
    whole = need(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.md5("text"))
    rows = whole.select("doc_id", "key", "text", base_spans(F.col("text")).alias("spans"))
    found = durable(rows.select("doc_id", "key", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")), "pii-found")
    held = found.filter("text IS NOT NULL").select("key", "text", "spans")
    n_docs = found.count()
    terms = durable(revealing_terms(whole, held, n_docs, **thresholds), "pii-revealing")
    marked = term_spans(whole.select("key", "text"), terms)
    return found.select("doc_id", "key", "spans").join(marked, "key", "left").withColumn("terms", outside(F.col("terms"), F.col("spans")))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; terms become ``[TERM]``.

    All columns stay; ``n_chars``, if there is one, follows the new text.  Only
    texts that a bitmap marks as having spans are joined with them; the others pass
    unshuffled.  Each input row travels as one struct, so its names clash with none.
    """
    found = analyse(docs, **thresholds)
    spans = found.filter("size(spans) + size(terms) > 0").groupBy("key").agg(F.first(F.array_sort(F.transform(F.concat("spans", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))).alias("spans"))
    spans = durable(spans, "pii-replace").withColumnsRenamed({"key": "k"})
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    keyed = row.select("row", "text", F.md5("text").alias("key"))
    keyed = with_hit(keyed, keyed["key"], bitmap_of(spans, "k", "pii-replace-bits"), "hit")
    rows = keyed.filter("hit")
    rows = rows.join(spans, rows["key"] == spans["k"], "left")
    text = F.col("text")

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        mask = F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        fresh = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.array_append(state["out"], mask)).otherwise(state["out"]).alias("out"))

    masked = F.array_join(running(F.col("spans"), F.lit(0).cast("long"), "string", step), "")
    rest = F.substring(text, (F.array_max(F.transform("spans", lambda s: s["end"])) + 1).cast("int"), F.length(text))
    marked = F.col("spans").isNotNull()
    out = rows.select("row", marked.alias("marked"), F.when(marked, F.concat(masked, rest)).alias("new"))
    kind = {f.name: f.dataType for f in docs.schema}
    fresh = {"text": F.col("new"), "n_chars": F.length("new")}
    pick = lambda c: F.when(F.col("marked"), fresh[c.lower()].cast(kind[c])).otherwise(F.col("row")[c]) if c.lower() in fresh else F.col("row")[c]
    plain = keyed.filter("NOT hit").select(*(F.col("row")[c].alias(c) for c in docs.columns))
    return plain.union(out.select(*(pick(c).alias(c) for c in docs.columns)))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analyse(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k[0]) for k in KINDS), F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.concat("spans", "terms")).alias("spans"), F.size("terms").cast("long").alias("n_term")
    )
