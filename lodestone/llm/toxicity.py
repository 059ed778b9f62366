"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts to Latin
ones, digits and signs that stand for letters to those letters.  The lexicon is
learned from a bounded sample of labelled documents: words and word beginnings
that stand out in toxic ones by log-likelihood ratio, weighted by log odds.  A
document's raw score is the sum of the weights of its matches outside exception
phrases, over a slowly growing function of its length; the threshold that errs
least on the sample becomes score 0.5.

Defined results: a null or empty text scores 0; a null ``doc_id`` is not held
out; a document with conflicting labels, or none, is not learned from; without
any learned term every score is 0; repeated rows score alike; empty in, empty out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, need, small_batches, table

#: Labelled documents that the lexicon is learned from, at most, of each class.
MAX_TOXIC, MAX_CLEAN = 3000, 9000
#: A term's least log-likelihood ratio and least log odds.
MIN_G2, MIN_WEIGHT = 16.0, 2.5
PREFIXES = range(3, 10)
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "ι": "i", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l",
}
STANDINS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
FOLD = str.maketrans(LOOKALIKES | STANDINS)
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish")


def fold(text: str) -> str:
    folded = text.lower().translate(FOLD)
    return folded if folded.isascii() else folded.translate({0x200B: None, 0x200D: None, 0xAD: None})


def words_of(folded: str) -> set[str]:
    import regex

    return set(regex.findall(r"[\p{L}\p{M}\p{N}]+", folded))


def features(words: set[str]) -> set[str]:
    """``=word`` for whole words, ``word`` beginnings bare; a word begins with itself."""
    out = {"=" + w for w in words}
    for w in words:
        out.update(w[:n] for n in PREFIXES if n <= len(w))
    return out


class Lexicon:
    """Terms with weights, exception phrases and the raw score that stands for 0.5."""

    def __init__(self, terms: dict[str, float], threshold: float, exceptions: tuple[str, ...] = EXCEPTIONS):
        self.terms, self.threshold, self.exceptions = terms, threshold, exceptions
        self.machine = None

    def __getstate__(self):
        return {"terms": self.terms, "threshold": self.threshold, "exceptions": self.exceptions, "machine": None}

    def build(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in self.exceptions:
            machine.add_word(fold(phrase), (len(fold(phrase)), 2, None, None))
        for term in {t.lstrip("=") for t in self.terms}:
            machine.add_word(term, (len(term), 1, self.terms.get("=" + term), self.terms.get(term)))
        if len(machine):
            machine.make_automaton()
        self.machine = machine

    def raw(self, text: str) -> float:
        if self.machine is None:
            self.build()
        if not text or not len(self.machine):
            return 0.0
        text = fold(text)
        found, safe = [], []
        for end, (size, kind, whole, begin) in self.machine.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalnum():
                continue
            ends = end + 1 == len(text) or not text[end + 1].isalnum()
            if kind == 2:
                if ends:
                    safe.append((start, end))
            else:
                weight = max(whole if ends and whole else 0.0, begin or 0.0)
                if weight:
                    found.append((start, end, weight))
        best: dict[int, float] = {}  # one weight a word
        for start, end, weight in found:
            if not any(a <= start and end <= b for a, b in safe):
                best[start] = max(best.get(start, 0.0), weight)
        return sum(best.values()) / (1.0 + math.log1p(text.count(" ") / 50.0))

    def score(self, text: str | None) -> float:
        x = self.raw(text or "")
        return x / (x + self.threshold) if x else 0.0


def one_per_cluster(sample: DataFrame, hashes: int = 4) -> list[int]:
    """Ids of the sample (bounded), one for each set of near copies: those that share a min-hash of five-word runs."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                w = (text or "").split()
                runs = {xxhash.xxh64_intdigest(" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))}
                out.append([min((h * m) & 0x7FFFFFFFFFFFFFFF for h in runs) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)[:hashes]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "mins"])

    owner: dict[tuple[int, int], int] = {}
    kept = []
    for r in sorted(sample.select("doc_id", "text").mapInArrow(sketch, "doc_id long, mins array<long>").collect()):
        keys = list(enumerate(r["mins"]))
        if not any(k in owner for k in keys):
            kept.append(r["doc_id"])
        for k in keys:
            owner.setdefault(k, r["doc_id"])
    return kept


def _counts(sample: DataFrame, keep=None) -> DataFrame:
    """(feature, n) over the sample's texts, combined within each batch; only features in the broadcast ``keep``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[str] = Counter()
            for text in batch[0].to_pylist():
                f = features(words_of(fold(text or "")))
                n.update(f if keep is None else f & keep.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["feature", "n"])

    return sample.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def weigh(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms of the lexicon with their log odds; a kept beginning covers itself as a word and all longer ones."""
    scored = []
    for f, t in toxic.items():
        c = clean.get(f, 0)
        weight = math.log((t + 0.5) / (n_toxic + 1.0)) - math.log((c + 0.5) / (n_clean + 1.0))
        if weight < MIN_WEIGHT:
            continue
        e = (t + c) * n_toxic / (n_toxic + n_clean)
        g2 = 2 * (t * math.log(t / e) + (c * math.log(c / (t + c - e)) if c else 0.0))
        if g2 >= MIN_G2:
            scored.append((-round(weight, 2), f[0] != "=", len(f), f, weight))
    out: dict[str, float] = {}
    for _, _, _, f, weight in sorted(scored):
        bare = f.lstrip("=")
        if not any(bare[:n] in out for n in PREFIXES if n < len(bare)) and bare not in out:
            out[f] = weight
    return out


def threshold_of(raw: list[tuple[float, int]]) -> float:
    """The raw score above which predicting toxic errs least (smallest one that does, above 0)."""
    best, at, errors = None, 1.0, sum(y for _, y in raw)
    values = sorted(raw, reverse=True)
    fewest = errors + 1
    for k, (x, y) in enumerate(values):
        if x <= 0:
            break
        errors += -1 if y else 1
        below = values[k + 1][0] if k + 1 < len(values) else 0.0
        if below < x and errors <= fewest:
            fewest, at, best = errors, (x + max(below, 0.0)) / 2, k
    return at if best is not None else 1.0


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learn from the labels whose ``crc32(doc_id) % 5`` is not 0, at most the given numbers of each class."""
    spark = docs.sparkSession
    small_batches(spark)
    known = need(labels, doc_id="long", toxic="int").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).filter("toxic = high").select("doc_id", "toxic")
    # The documents at hand may be part of the labelled ones: the sample is drawn from those that are.
    ids = need(docs, doc_id="long").distinct()
    known = durable(known.join(ids, "doc_id", "left_semi"), "tox-known")
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = known.filter("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(known.filter("toxic = 0").orderBy(*order).limit(max_clean))
    chosen = durable(chosen, "tox-chosen").withColumnRenamed("doc_id", "_id")
    texts = need(docs, doc_id="long", text="string")
    sample = durable(texts.join(F.broadcast(chosen), texts["doc_id"] == F.col("_id")).select("doc_id", "text", "toxic"), "tox-sample")  # bounded by the two maxima
    once = spark.createDataFrame([(i,) for i in one_per_cluster(sample)], "doc_id long")  # at most the two maxima
    sample = durable(sample.join(F.broadcast(once), "doc_id", "left_semi"), "tox-once")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    toxic = {r["feature"]: r["n"] for r in _counts(sample.filter("toxic = 1")).filter("n >= 3").collect()}  # words of at most MAX_TOXIC texts
    keep = spark.sparkContext.broadcast(frozenset(toxic))
    clean = {r["feature"]: r["n"] for r in _counts(sample.filter("toxic = 0"), keep).collect()} if toxic else {}
    lexicon = Lexicon(weigh(toxic, clean, n_toxic, n_clean), 1.0, exceptions)
    raw = score(sample, lexicon, raw=True).select("score", "toxic").collect()
    lexicon.threshold = threshold_of([(r["score"], r["toxic"]) for r in raw])
    return lexicon


def score(rows: DataFrame, lexicon: Lexicon, raw: bool = False) -> DataFrame:
    """Add ``score`` to rows that have ``text`` as one of their columns; all columns but ``text`` stay."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    kept = [c for c in rows.columns if c != "text"]
    schema = rows.select(*kept).schema.add("score", "double")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        get = lex.raw if raw else lex.score
        for batch in batches:
            out = [get(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.float64())], [*kept, "score"])

    return rows.mapInArrow(scores, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the learned lexicon does not predict toxic, with all their columns."""
    lexicon = learn(docs, labels, **options)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index(next(c for c in docs.columns if c.lower() == "text"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in batches:
            yield batch.filter(pa.array([lex.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    rows = docs.withColumn("held_out", held_out(F.col("doc_id")))
    return score(rows, lexicon).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
