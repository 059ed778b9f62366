"""Order Min-Hash fingerprints with DataFrame expressions only.

A text is the row of its tokens: runs of non-space characters, long ones cut into
pieces.  Its k-mers are ``K`` tokens in a row; the second, third ... time that a
k-mer occurs it counts as another one (occurrence numbers), for which hashes are
sorted once and numbered within runs of equal ones.  A numbered k-mer has one place
on the circle of hashes.  Each of ``FUNCTIONS`` functions orders all numbered k-mers
by their way round that circle from a start of its own, takes the ``2`` least of
that order, puts them in text order, and hashes the pair; so a fingerprint changes
with order as with content, as edit distance does.  Starts are evenly spaced: sorted
together with the hashes they show where each order begins, and one sort serves all
functions.  Likeness is the share of equal places of two fingerprints.

Everything about a text is computed within its row, so nothing but the texts
themselves is shuffled, once, to bring each to its successor.

Defined results: a null text is empty; a text of fewer than ``K`` tokens has its
whole row of tokens as the one k-mer, which then is both of a pair; an empty text has
a fingerprint of its own and is like other empty ones only; repeated rows get equal
results; rows with equal ``doc_id`` follow each other in order of their text's hash;
null ids come last in descending order; the next of the last document is the first
one, also for a table of a single row; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import need, table

K = 3
FUNCTIONS = 128
TOKEN = r"\S{1,16}"
#: Low bits of a packed k-mer that hold its position: no array is longer.
POSITION_BITS = 31
LOW = (1 << POSITION_BITS) - 1
#: Rows of one range in the search for each row's successor; ranges at most, and ids of the sample that cuts one.
RANGE_ROWS, MAX_RANGES, SAMPLE = 500, 16_384, 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def _what(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS)


def _packed(value: Column, at: Column) -> Column:
    return value.bitwiseAND(F.lit(~LOW)).bitwiseOR(at.cast("long"))


def numbered_kmers(text: Column, k: int = K) -> Column:
    """Sorted array of the numbered k-mers: a hash in the high bits, the position from 1 in the low ones."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def kmers(t: Column) -> Column:
        n = F.greatest(F.size(t) - (k - 1), F.lit(1))
        return F.sort_array(F.transform(F.sequence(F.lit(1), n), lambda i: _packed(F.xxhash64(*(F.get(t, i - 1 + j) for j in range(k))), i)))

    def number(x: Column, occurrence: Column) -> Column:
        return _packed(F.xxhash64(_what(x), occurrence.cast("int")), _at(x))

    def numbered(p: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (_what(F.get(p, i)) != _what(F.get(p, i - 1))))

        def runs(h: Column) -> Column:
            ends = F.zip_with(h, F.concat(F.slice(h, 2, F.size(h)), F.array(F.size(p))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            return F.flatten(F.transform(ends, lambda r: F.transform(F.sequence(r["a"], r["b"] - 1), lambda i: number(F.get(p, i), i - r["a"]))))

        # Most texts repeat no k-mer: each then is its own first occurrence.
        return F.sort_array(_let(heads, lambda h: F.when(F.size(h) == F.size(p), F.transform(p, lambda x: number(x, F.lit(0)))).otherwise(runs(h))))

    none = F.array().cast("array<bigint>")
    return _let(tokens, lambda t: F.when(F.size(t) == 0, none).otherwise(_let(kmers(t), numbered)))


def fingerprint(text: Column, functions: int = FUNCTIONS, k: int = K) -> Column:
    """Array of ``functions`` (a power of 2) integers."""
    step = (1 << 64) // functions
    starts = F.array(*(F.lit(f * step - (1 << 63)) for f in range(functions)))

    def places(v: Column) -> Column:
        # A start has position 0, so it stands before all k-mers from there on; of the ``p`` entries before start f, f are starts.
        merged = F.sort_array(F.concat(v, starts))
        at = F.filter(F.transform(merged, lambda x, i: F.when(_at(x) == 0, i)), lambda i: i.isNotNull())
        n = F.size(v)

        def place(p: Column, f: Column) -> Column:
            a, b = F.get(v, (p - f) % n), F.get(v, (p - f + 1) % n)
            pair = F.when(_at(a) <= _at(b), F.xxhash64(f, _what(a), _what(b))).otherwise(F.xxhash64(f, _what(b), _what(a)))
            return F.shiftright(pair, 32).cast("int")

        empty = F.transform(F.sequence(F.lit(0), F.lit(functions - 1)), lambda f: F.shiftright(F.xxhash64(f), 32).cast("int"))
        return F.when(n == 0, empty).otherwise(F.transform(at, place))

    return _let(numbered_kmers(text, k), places)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def hexed(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.right(F.concat(F.lit("0" * 7), F.hex(x)), F.lit(8)))), "")


def _words(values: Iterable[str], by: str = ",") -> Column:
    """An array of strings as one literal."""
    return F.split(F.lit(by.join(values)), by)


def with_next(docs: DataFrame, value: Callable[[DataFrame], DataFrame], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Rows in descending order of ``doc_id``, dealt to ranges, with a column of each one's successor.

    ``docs`` has (doc_id, text).  ``value`` adds columns to (doc_id, text, next_text,
    lent, at); what it names ``fp`` comes back as ``next_fp`` of the row before.
    Ranges are cut at quantiles of a sample of the ids, those of one frequent id by the
    hash of the text.  The first row of each range is lent to the range before it as
    well, so every row finds its successor within its range.
    """
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, n // range_rows))
    # Hex digits in whose order ids descend; null ids come after all others.
    order = lambda i: F.coalesce(F.lpad(F.hex(F.bitwise_not(i).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("G" * 16))
    cuts: list[str] = []
    if ranges > 1:
        sample = sorted(r[0] for r in docs.select(order(F.col("doc_id"))).sample(min(1.0, SAMPLE * ranges / n), seed=1).collect())  # about SAMPLE * MAX_RANGES strings at most
        picked = [sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else []
        for key, same in groupby(picked):
            times = len(list(same))
            cuts += [f"{key}{(j << 32) // times:08x}" for j in range(times)]
    width = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    upto = lambda some, key: F.size(F.filter(some, lambda c: c <= key))
    rows = docs.select("doc_id", "text", F.concat(order(F.col("doc_id")), F.md5("text")).alias("at"))
    if cuts:
        heads, block = _words(b[0] for b in blocks), lambda b: F.split(F.get(_words((",".join(b) for b in blocks), ";"), b - 1), ",")
        rows = rows.withColumn("block", upto(heads, F.col("at")))
        rows = rows.withColumn("range", F.when(F.col("block") == 0, 0).otherwise((F.col("block") - 1) * width + upto(block(F.col("block")), F.col("at")))).drop("block")
    else:
        rows = rows.withColumn("range", F.lit(0))
    firsts = {r["range"]: r["first"] for r in rows.groupBy("range").agg(F.min("at").alias("first")).collect()}  # one row a range
    there = sorted(firsts)
    before = {r: there[k - 1] for k, r in enumerate(there)}
    size = max(there, default=0) + 1
    is_first = F.col("at") == F.get(_words(firsts.get(r, "") for r in range(size)), F.col("range"))
    lend_to = F.get(_words(str(before.get(r, 0)) for r in range(size)), F.col("range")).cast("int")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("lent"))
    lent = F.struct(lend_to.alias("range"), F.lit(1).alias("lent"))
    rows = rows.withColumn("g", F.explode(F.when(is_first, F.array(own, lent)).otherwise(F.array(own)))).select("doc_id", "text", "at", "g.range", "g.lent")
    following = Window.partitionBy("range").orderBy("lent", "at")
    rows = value(rows.withColumn("next_text", F.coalesce(F.lead("text").over(following), "text")))
    return rows.withColumn("next_fp", F.coalesce(F.lead("fp").over(following), "fp")).filter("lent = 0")


def edited(text: Column, other: Column) -> Column:
    """The last third of the text's characters replaced by the first as many of the other's."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(other, F.lit(1), third))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))

    def value(rows: DataFrame) -> DataFrame:
        own = F.col("lent") == 0
        rows = rows.withColumn("edited", F.when(own, edited(F.col("text"), F.col("next_text"))))
        return rows.select("doc_id", "range", "lent", "at", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("fp"), F.when(own, fingerprint(F.col("edited"))).alias("edited_fp"))

    return with_next(docs, value).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed(F.col("fp")).alias("fingerprint"),
        hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
