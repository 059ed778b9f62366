"""Removal of long repeated substrings by longest-previous-factor arrays.

A byte goes when a string of ``length`` bytes over it also starts in a document
with a smaller ``doc_id``.  Every such string holds exactly one anchor: the
leftmost least hash among its ``GRAM``-byte substrings.  Equal strings have equal
anchors, so they can be brought together by anchor instead of by position, and
only around anchors that more than one distinct text has.

1. Anchors of every text are dealt by hash; those of one text alone end here.
2. Each text's stretches around shared anchors are dealt by anchor.  Their starts are
   put in suffix order, by the next ``length`` bytes and with equal ones by
   ``doc_id``; the nearest starts before and after with a smaller ``doc_id`` give the
   longest previous factor of each, up to ``length``.  Where it reaches ``length``
   the bytes go.
3. Stretches that are equal need one copy there: that of the smallest id.  Equal
   ones in one batch are settled before the shuffle, and of those that arrive only
   the first is kept, so a passage that a third of all documents share costs a task
   its distinct surroundings.

Later exact copies of a text go as a whole and are compared no further.

Defined results: a null text is empty; a null ``doc_id`` is smaller than none and
greater than none, so such rows keep all bytes; rows with the same ``doc_id`` do
not remove each other's bytes; extra columns are not read; empty in, empty out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, durable, need, release, small_batches, table, with_hit

LENGTH = 50
GRAM = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK40 = np.uint64((1 << 40) - 1)
BATCH_DOCS = 512
#: Anchors that a task gathers before it deals them.
DEAL_ANCHORS = 1_000_000
#: Bytes of distinct stretches whose starts are ordered together.
RANK_BYTES = 3_000_000
#: Bytes of text for which one partition of anchors is made, however large the corpus.
PART_BYTES = 128_000_000
#: Rounds of jumps before the search for smaller values takes a stack.
JUMPS = 200


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """Place of the nearest smaller value before each one, or -1."""
    p = np.arange(-1, len(x) - 1)
    left = np.nonzero((p >= 0) & (x[p] >= x))[0] if len(x) else p
    for _ in range(JUMPS):
        if not len(left):
            return p
        # All between p[i] and i are at least x[i], so where x[p[i]] is too, its own place is the next to try.
        p[left] = p[p[left]]
        at = p[left]
        left = left[(at >= 0) & (x[at] >= x[left])]
    stack: list[int] = []
    values = x.tolist()
    for i, v in enumerate(values):
        while stack and values[stack[-1]] >= v:
            stack.pop()
        p[i] = stack[-1] if stack else -1
        stack.append(i)
    return p


def longest_previous_factor(buffer: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each start the longest match with a start of a smaller owner, up to ``length`` (8 or more).

    Previous and next smaller owners in suffix order give the two best rivals: the
    match gets no longer further away in that order.  ``length`` bytes must follow
    each start.
    """
    out = np.zeros(len(starts), dtype=np.int64)
    if not len(starts):
        return out
    b = buffer.astype(np.uint64)
    two = (b[:-1] << np.uint64(8)) | b[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    eight = (four[:-4] << np.uint64(32)) | four[4:]
    offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    words = [eight[starts + o] for o in offsets]
    order = np.lexsort((owner, *reversed(words)))
    o = owner[order]
    before, after = previous_smaller(o), len(o) - 1 - previous_smaller(o[::-1])[::-1]
    for near in (before, after):
        mine = np.nonzero((near >= 0) & (near < len(o)))[0]
        a, b = order[mine], order[near[mine]]
        for offset, word in zip(offsets, words, strict=True):
            differ = word[a] ^ word[b]
            end = differ != 0
            # The first byte that differs; words may overlap, which only compares bytes again.
            at = (differ[end].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(1)
            out[a[end]] = np.maximum(out[a[end]], offset + at)
            a, b = a[~end], b[~end]
        out[a] = length
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of concatenated texts: (text, hash, first start, last start) of each run of strings."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, dtype=d) for d in (np.int64, np.uint64, np.int64, np.int64))
    v = {1: data.astype(np.uint64) + np.uint64(1)}
    power, base = {1: _BASE}, int(_BASE)
    size = 1
    while size * 2 <= gram:
        v[size * 2] = v[size][: n - size * 2 + 1] * power[size] + v[size][size:][: n - size * 2 + 1]
        base = base * base % 2**64
        power[size * 2] = np.uint64(base)
        size *= 2
    h, have = v[size], size
    for part in sorted(v, reverse=True):
        while gram - have >= part:
            m = n - have - part + 1
            h = h[:m] * power[part] + v[part][have : have + m]
            have += part
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    window = length - gram + 1
    low, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < window:
        step = min(span, window - span)
        right, right_at = low[step:], at[step:]
        left, left_at = low[: len(right)], at[: len(right)]
        less = right < left
        low, at = np.where(less, right, left), np.where(less, right_at, left_at)
        span += step
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.arange(len(at))
    inside = text[start] == text[start + length - 1]
    start, at = start[inside], at[inside]
    if not len(start):
        return tuple(np.zeros(0, dtype=d) for d in (np.int64, np.uint64, np.int64, np.int64))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (text[start[1:]] != text[start[:-1]])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(at)) - 1
    return text[start[first]], h[at[first]], start[first], start[last]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without decoding it."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def _pack5(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack5(x: bytes) -> np.ndarray:
    raw = np.zeros((len(x) // 5, 8), dtype=np.uint8)
    raw[:, :5] = np.frombuffer(x, dtype=np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel()


def _by(where: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(value, columns...) for each distinct value of ``where``."""
    order = np.argsort(where, kind="stable")
    cuts = np.nonzero(np.diff(where[order]))[0] + 1
    for k in np.split(order, cuts) if len(order) else []:
        yield (int(where[k[0]]), *(c[k] for c in columns))


def _shared(a: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (a, t) by a, whether a has several t, and whether a row is the first of its a."""
    order = np.lexsort((t, a))
    a, t = a[order], t[order]
    once = np.ones(len(a), dtype=bool)
    once[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    a, t = a[once], t[once]
    head = np.ones(len(a), dtype=bool)
    head[1:] = a[1:] != a[:-1]
    group = np.cumsum(head) - 1
    return a, t, np.bincount(group)[group] > 1 if len(a) else head, head


def shared_anchors(texts: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """(short, anchors) of the anchors that a text shares with another one.

    ``short`` is 40 bits of ``th``, a hash of the text, with the lowest bit set.
    Anchors travel in packed rows, one for each target and DEAL_ANCHORS anchors:
    first by anchor, then, where shared, by text.
    """
    small_batches(texts.sparkSession, BATCH_DOCS)
    named, schema = ["part", "mine", "a", "t"], "part int, mine boolean, a binary, t binary"
    kinds = [pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], named)

    def answers(a: np.ndarray, t: np.ndarray) -> list[tuple]:
        return [(k, True, _pack5(x), _pack5(y)) for k, x, y in _by(((t >> np.uint64(1)) % np.uint64(parts)).astype(np.int64), a, t)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            a, t, many, head = _shared(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            # Shared here: settled for these texts, and one mark (0) for those of other tasks.
            rows = answers(a[many], t[many])
            sent = head | ~many
            a, t = a[sent], np.where(many[sent], np.uint64(0), t[sent])
            return batch_of(rows + [(k, False, _pack5(x), _pack5(y)) for k, x, y in _by((a % np.uint64(parts)).astype(np.int64), a, t)])

        for batch in batches:
            data, offsets = _texts(batch.column("text"))
            text, h, _, _ = anchors(data, offsets, length, gram)
            if len(h):
                t = (np.asarray(batch.column("th")).view(np.uint64)[text] & _MASK40) | np.uint64(1)
                held.append((h & _MASK40, t))
                size += len(h)
            if size >= DEAL_ANCHORS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, t = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for batch in batches:
            own = batch.filter(batch.column("mine"))
            if own.num_rows:
                yield own
            for mine, x, y in zip(*(batch.column(c).to_pylist() for c in named[1:]), strict=True):
                if not mine:
                    a.append(_unpack5(x))
                    t.append(_unpack5(y))
        a, t, many, head = _shared(np.concatenate(a), np.concatenate(t))
        marked = (t[head] == 0)[np.cumsum(head) - 1] if len(a) else many
        keep = (many | marked) & (t > 0)
        if keep.any():
            yield batch_of(answers(a[keep], t[keep]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, t = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for batch in batches:
            a += map(_unpack5, batch.column("a").to_pylist())
            t += map(_unpack5, batch.column("t").to_pylist())
        rows = [(k, _pack5(x)) for k, x in _by(np.concatenate(t).astype(np.int64), np.concatenate(a))]
        for at in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[at : at + 5000]], pa.int64()), pa.array([r[1] for r in rows[at : at + 5000]], pa.binary())], ["short", "a"])

    dealt = texts.select("th", "text").mapInArrow(deal, schema).repartition(parts, "part")
    return dealt.mapInArrow(meet, schema).repartition(parts, "part").mapInArrow(gather, "short long, a binary")


def covered(texts: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """(doc_id, spans): byte ranges to remove, packed pairs of 32-bit start and end; several rows a document.

    ``texts`` has (doc_id, text, a) with the shared anchors of each distinct text.
    """
    small_batches(texts.sparkSession, BATCH_DOCS)
    schema = "anchor long, doc_id long, at binary, stretch binary, done boolean"
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
    named = ["anchor", "doc_id", "at", "stretch", "done"]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch.column("text"))
            text, h, first, last = anchors(data, offsets, length, gram)
            lists = batch.column("a").to_pylist()
            keep = np.zeros(len(h), dtype=bool)
            bounds = np.searchsorted(text, np.arange(len(lists) + 1))
            for k, packed in enumerate(lists):
                lo, hi = bounds[k], bounds[k + 1]
                if lo < hi and packed:
                    keep[lo:hi] = np.isin(h[lo:hi] & _MASK40, _unpack5(packed))
            ids = np.asarray(batch.column("doc_id"))
            best: dict[tuple[int, bytes], int] = {}
            places: dict[tuple[int, int, bytes], list[int]] = {}
            at = np.nonzero(keep)[0]
            at = at[np.argsort(ids[text[at]], kind="stable")]
            raw = data.tobytes()
            for k in at.tolist():
                key = (int(h[k].astype(np.int64)), raw[int(first[k]) : int(last[k]) + length])
                doc = int(ids[text[k]])
                best.setdefault(key, doc)
                places.setdefault((doc, *key), []).append(int(first[k]) - int(offsets[text[k]]))
            rows = []
            for (doc, anchor, stretch), found in places.items():
                over = best[anchor, stretch] < doc
                # What is settled needs no meeting: it goes by document, not to the task of a frequent anchor.
                rows.append((doc if over else anchor, doc, np.array(found, dtype="<i4").tobytes(), np.int32(len(stretch)).tobytes() if over else stretch, over))
            for lo in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[lo : lo + 20_000], strict=True), kinds, strict=True)], named)

    def settle(kinds_of: dict[tuple[int, bytes], tuple[int, list[bytes]]]) -> list[tuple[int, int, int]]:
        """(doc_id, start, end) from the distinct stretches of some anchors, each with its least document and the places there."""
        counts: dict[int, int] = {}
        for anchor, _ in kinds_of:
            counts[anchor] = counts.get(anchor, 0) + 1
        ranked = [(stretch, *kinds_of[anchor, stretch]) for anchor, stretch in kinds_of if counts[anchor] > 1]
        if not ranked:
            return []
        sizes = np.array([len(stretch) for stretch, _, _ in ranked])
        begin = np.cumsum(sizes) - sizes
        inner = sizes - length + 1
        starts = np.repeat(begin - (np.cumsum(inner) - inner), inner) + np.arange(inner.sum())
        buffer = np.frombuffer(b"".join(stretch for stretch, _, _ in ranked), dtype=np.uint8)
        hit = longest_previous_factor(buffer, starts, np.repeat(np.array([doc for _, doc, _ in ranked]), inner), length) >= length
        out = []
        for (_, doc, places), f in zip(ranked, np.split(hit, np.cumsum(inner)[:-1]), strict=True):
            if f.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], f.astype(np.int8), [0]])))
                out += [(doc, p + int(s), p + int(e) - 1 + length) for at in places for p in np.frombuffer(at, dtype="<i4").tolist() for s, e in zip(edge[::2], edge[1::2], strict=True)]
        return out

    def packed(spans: list[tuple[int, int, int]]) -> pa.RecordBatch:
        by: dict[int, list[int]] = {}
        for doc, s, e in spans:
            by.setdefault(doc, []).extend((s, e))
        return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array([np.array(v, dtype="<i4").tobytes() for v in by.values()], pa.binary())], ["doc_id", "spans"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by anchor and document, so the first of a kind has its least document: later ones go whole, at once.
        kinds_of: dict[tuple[int, bytes], tuple[int, list[bytes]]] = {}
        size, last = 0, None
        for batch in batches:
            done = []
            for anchor, doc, at, stretch, over in zip(*(batch.column(c).to_pylist() for c in named), strict=True):
                if over:
                    n = int(np.frombuffer(stretch, dtype=np.int32)[0])
                    done += [(doc, p, p + n) for p in np.frombuffer(at, dtype="<i4").tolist()]
                    continue
                if size > RANK_BYTES and last != anchor:
                    done += settle(kinds_of)
                    kinds_of, size = {}, 0
                last = anchor
                known = kinds_of.get((anchor, stretch))
                if known is None:
                    kinds_of[anchor, stretch] = (doc, [at])
                    size += len(stretch)
                elif doc > known[0]:
                    done += [(doc, p, p + len(stretch)) for p in np.frombuffer(at, dtype="<i4").tolist()]
                else:
                    known[1].append(at)
            if done:
                yield packed(done)
        if spans := settle(kinds_of):
            yield packed(spans)

    dealt = texts.select("doc_id", "text", "a").mapInArrow(stretches, schema)
    return dealt.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(resolve, "doc_id long, spans binary")


def merged(packed: list[bytes]) -> np.ndarray:
    """Disjoint maximal ranges from packed ranges, as rows of (start, end); ranges that touch are one."""
    x = np.frombuffer(b"".join(packed), dtype="<i4").reshape(-1, 2).astype(np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    high = np.maximum.accumulate(x[:, 1])
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:, 0] > high[:-1]
    first = np.nonzero(new)[0]
    return np.stack([x[first, 0], high[np.append(first[1:], len(x)) - 1]], 1)


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Facts (doc_id, n_bytes, sha, first_id) of every row, and (doc_id, spans) lists for the distinct texts."""
    rows = need(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    short = F.xxhash64("text").bitwiseAND(F.lit(int(_MASK40))).bitwiseOR(F.lit(1))
    facts = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"), short.alias("short"))
    facts = durable(facts, "sub-facts")
    firsts = facts.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    facts = durable(facts.join(firsts, "sha"), "sub-ids")
    whole = facts.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-whole // PART_BYTES))
    long = rows.filter((F.octet_length("text") >= length) & F.col("doc_id").isNotNull()).withColumn("th", F.xxhash64("text"))
    shared = durable(shared_anchors(long, length, gram, parts), "sub-anchors")
    release(docs.sparkSession)
    # Lists go to the first document of each text; only then the texts are brought to them, once.
    lists = facts.filter("doc_id = first_id").select("doc_id", "short").distinct().join(shared, "short")
    lists = durable(lists.withColumnsRenamed({"doc_id": "first", "short": "s"}), "sub-lists")
    active = long.withColumn("short", short)
    active = with_hit(active, active["doc_id"], bitmap_of(lists, "first", "sub-active"), "hit").filter("hit").drop("hit")
    active = active.join(lists, (F.col("doc_id") == F.col("first")) & (F.col("short") == F.col("s")))
    spans = covered(active, length, gram, parts).groupBy("doc_id").agg(F.collect_list("spans").alias("spans"))
    spans = durable(spans, "sub-spans")
    release(docs.sparkSession)
    return facts, spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    facts, spans = removed_spans(docs, length, gram)
    rows = need(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    small_batches(docs.sparkSession, BATCH_DOCS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, packed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw, ranges = text.encode(), merged(packed)
                digest, at = hashlib.sha256(), 0
                for s, e in ranges.tolist():
                    digest.update(raw[at:s])
                    at = e
                digest.update(raw[at:])
                out.append((doc, hashlib.sha256(raw).hexdigest(), int((ranges[:, 1] - ranges[:, 0]).sum()), len(ranges), digest.hexdigest()))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["d", "s", "n_removed", "n_spans", "kept"])

    # Only texts that lose something, and false hits of the bitmap, are shuffled.
    rows = with_hit(rows, rows["doc_id"], bitmap_of(spans, "doc_id", "sub-cut-ids"), "hit").filter("hit").drop("hit")
    parts = rows.join(spans, "doc_id").mapInArrow(cut, "d long, s string, n_removed long, n_spans long, kept string").distinct()
    parts = durable(parts, "sub-cut")
    copy = (F.col("n_bytes") >= length) & (F.col("first_id") < F.col("doc_id"))
    copy = F.coalesce(copy, F.lit(False))
    facts = facts.withColumn("copy", copy)
    out = facts.join(parts, (facts["doc_id"] == parts["d"]) & (facts["sha"] == parts["s"]) & ~facts["copy"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
