"""N-gram Jaccard self-join by chosen paths.

A document is the set of its runs of five words.  In each run of the join a set
chooses those of its shingles whose seeded hash is below ``1 / (threshold * n)``;
two sets above the threshold share a chosen one with probability of at least
``1 - 1/e``.  Chosen shingles are buckets.  A bucket of more than ``SPLIT`` sets is
split by shingles that its sets choose under its own seed, ``REPEAT`` times as
likely, so that a pair at the threshold stays together with a probability of
``1 - exp(-REPEAT)``; its parts are split in turn, to any depth, until they are small
or splitting stops to help (the largest part is over half of the whole: near copies
of each other).  What is left is compared by brute force, first by short sketches,
then exactly by whole sets of 64-bit hashes; the runs are repeated until the target
recall.  A sketch has 128 places of one byte; a pair at the threshold whose estimate
is ``SKETCH_MARGIN`` lower is lost, with a chance below 1e-8.

A pair counts in the least bucket that it shares, so nothing has to list pairs to
tell them apart: a task returns sums of links for each document and a spanning forest
of its links, both no longer than its input.  Buckets are compared in pairs of
chunks, bounded in sets and in shingles, so long texts and groups of near copies
spread over tasks of bounded memory.  Equal sets are one representative with a
weight, so copies are never expanded.

Defined results: a text of fewer than five words is one shingle; texts without
words are copies of each other; a null ``doc_id`` row gets a null class and no
links; repeated rows are copies of each other; extra columns are not read (or stay as
they are, where documents are returned); empty in, empty out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bitmap_of, durable, need, release, small_batches, table, with_hit

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: A bucket above this many sets is split, by choices so many times as likely as the first one, while no part is over SHRINK of it.
SPLIT = 4096
REPEAT = 3.0
SHRINK = 0.5
#: A bucket is compared in pairs of chunks of about so many sets, and of so many shingles.
CHUNK = 1024
CHUNK_SHINGLES = 2_000_000
BINS = 128
#: A sketch estimate this much below the threshold still goes to the exact comparison.
SKETCH_MARGIN = 0.25
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word runs."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x) for x in (text or "").split()], dtype=np.uint64)
    if not len(w):
        return w
    k = min(words, len(w))
    run = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for j in range(k):
        run += w[j : len(w) - k + 1 + j] * _M[j % len(_M)]
    return np.unique(mix(run ^ np.uint64(k)))


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold has met with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / -1.0))


def _chosen(s: np.ndarray, seed: np.uint64, times: float) -> np.ndarray:
    """The shingles of a set that it chooses under an odd seed, ``times`` of them on average."""
    # One hash rule for all sizes keeps the choice of a shingle the same in every set.
    limit = np.uint64(min(2**64 - 1, int(2**64 * times / len(s))))
    return s[(s ^ (s >> np.uint64(29))) * seed <= limit]


def paths(s: np.ndarray, runs: int, threshold: float) -> list[int]:
    """The buckets that a set chooses in all runs."""
    if not len(s):
        return []
    out = []
    for r in range(runs):
        seed = mix(np.array([r + 1], dtype=np.uint64) * _M[0])[0] | np.uint64(1)
        out += mix(_chosen(s, seed, 1 / threshold) ^ seed).astype(np.int64).tolist()
    return list(dict.fromkeys(out))


def parts_of(s: np.ndarray, bucket: int, threshold: float, repeat: float) -> list[int]:
    """The parts of a bucket that a set chooses."""
    own = np.array([bucket], dtype=np.int64).view(np.uint64)[0]
    seed = mix(np.array([own], dtype=np.uint64))[0] | np.uint64(1)
    return mix(_chosen(s, seed, repeat / threshold) * _M[1] + own).astype(np.int64).tolist()


def sketch(s: np.ndarray) -> bytes:
    """One byte for each of the bins of the hash space: of its least shingle, 0 if it has none."""
    edges = (np.arange(BINS, dtype=np.uint64) << np.uint64(57)).astype(np.uint64)
    at = np.searchsorted(s, edges)
    after = np.append(at[1:], len(s))
    out = np.zeros(BINS, dtype=np.uint8)
    full = at < after
    out[full] = (s[at[full]] % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def _signature(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def signatures(docs: DataFrame, words: int, threshold: float, runs: int) -> DataFrame:
    """(doc_id, sig, n, paths, sketch) of each document."""
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([_signature(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([paths(s, runs, threshold) for s in sets], pa.list_(pa.int64())),
                    pa.array([sketch(s) for s in sets], pa.binary()),
                ],
                ["doc_id", "sig", "n", "paths", "sketch"],
            )

    return docs.mapInArrow(sign, "doc_id long, sig binary, n long, paths array<long>, sketch binary")


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal (key, i, j) of a sorted partition."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if row[:3] != last:
                if rows:
                    yield last, rows
                last, rows = row[:3], []
            rows.append(row[3:])
    if rows:
        yield last, rows


def _candidates(group: tuple, n: np.ndarray, keys: list[list[int]], part: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(x, later ys) of the pairs that belong to this bucket and chunk pair, by size and least shared key."""
    key, i, j = group
    order = np.argsort(n, kind="stable")
    where: dict[int, list[int]] = {}
    for x in order:
        for k in keys[x]:
            if k < key:
                where.setdefault(k, []).append(int(x))
    shared = {k: np.array(v) for k, v in where.items() if len(v) > 1}
    place = np.empty(len(n), dtype=np.int64)
    place[order] = np.arange(len(n))
    for x in order:
        ok = (place > place[x]) & (n * threshold <= n[x])
        if i != j:
            ok &= part != part[x]
        for k in keys[x]:
            if k in shared:
                ok[shared[k]] = False
        ys = np.nonzero(ok)[0]
        if len(ys):
            yield int(x), ys


def _survivors(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _groups(batches, ["key", "i", "j", "part", "rid", "n", "keys", "sketch"]):
            part, rid, n, keys, sk = zip(*rows, strict=True)
            n, sk, part = np.array(n), np.frombuffer(b"".join(sk), dtype=np.uint8).reshape(-1, BINS), np.array(part)
            keep = np.zeros(len(n), dtype=bool)
            for x, ys in _candidates(group, n, keys, part, threshold):
                both = (sk[ys] > 0) | (sk[x] > 0)
                same = (sk[ys] == sk[x]) & (sk[x] > 0)
                near = ys[same.sum(1) >= (threshold - SKETCH_MARGIN) * both.sum(1)]
                if len(near):
                    keep[x] = True
                    keep[near] = True
            at = np.nonzero(keep)[0]
            if len(at):
                key, i, j = group
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array([i] * len(at), pa.int32()), pa.array([j] * len(at), pa.int32()), pa.array(part[at], pa.int32()), pa.array([rid[k] for k in at], pa.int64())], ["key", "i", "j", "part", "rid"])

    return run


def _links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _groups(batches, ["key", "i", "j", "part", "rid", "m", "keys", "shingles"]):
            part, rid, m, keys, sets = zip(*rows, strict=True)
            sets = [np.frombuffer(s, dtype=np.uint64) for s in sets]
            n, m, part = np.array([len(s) for s in sets]), np.array(m), np.array(part)
            codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, np.int64)
            ends = np.cumsum(n)
            starts = ends - n
            mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, dtype=np.int32)
            links, root = np.zeros(len(n), dtype=np.int64), np.arange(len(n))
            edges = []

            def top(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, ys in _candidates(group, n, keys, part, threshold):
                own = codes[starts[x] : ends[x]]
                mark[own] = 1
                for some in np.array_split(ys, max(1, int(n[ys].sum()) // 4_000_000)):
                    picked = np.concatenate([codes[starts[y] : ends[y]] for y in some])
                    common = np.add.reduceat(mark[picked], np.concatenate([[0], np.cumsum(n[some])[:-1]]))
                    hit = some[common >= threshold * (n[x] + n[some] - common) - 1e-9]
                    if len(hit):
                        links[x] += m[hit].sum()
                        links[hit] += m[x]
                        for y in hit:
                            a, b = top(x), top(int(y))
                            if a != b:
                                root[b] = a
                                edges.append((rid[x], rid[int(y)]))
                mark[own] = 0
            at = np.nonzero(links)[0]
            if len(at):
                a = [rid[k] for k in at] + [e[0] for e in edges]
                b = [None] * len(at) + [e[1] for e in edges]
                w = links[at].tolist() + [0] * len(edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.int64())], ["a", "b", "links"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of the nodes of undirected edges (a, b): label is the least id of the component.

    Labels spread to neighbours and then jump to their label's label; every round
    is written to the shared folder.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "cc-labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("j"), F.col("label").alias("far"))
        new = new.join(jump, new["label"] == jump["j"]).select("id", "old", F.least("label", "far").alias("label"))
        new = durable(new, "cc-labels")
        changed = new.filter("label < old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def whole_sets(known: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The stored rows of ``wanted`` (rid, rep, ...) with their sets as ``shingles``, read again from their texts."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_signature(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "shingles"])

    small_batches(known.sparkSession)
    # Few texts are wanted: a bitmap keeps the others out of the shuffle.
    texts = with_hit(known, known["doc_id"], bitmap_of(wanted, "rep", "jac-wanted-ids"), "hit").filter("hit").select("doc_id", "text")
    texts = texts.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = texts.mapInArrow(whole, "sig binary, shingles binary").select(F.xxhash64("sig").alias("rid"), "shingles").groupBy("rid").agg(F.first("shingles").alias("shingles"))
    return durable(wanted.join(sets, "rid"), "jac-sets")


def split_buckets(members: DataFrame, known: DataFrame, reps: DataFrame, words: int, threshold: float, split: int, repeat: float, shrink: float) -> DataFrame:
    """(key, rid, n, size, total) with each bucket of more than ``split`` sets replaced by its parts, again and again."""
    spark = known.sparkSession
    leaves = members.filter(F.col("size") <= split)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, rid, n, buckets in zip(*(batch.column(c).to_pylist() for c in ("text", "rid", "n", "buckets")), strict=True):
                s = shingles(text, words)
                out += [(b, k, rid, n, _signature(s)) for b in buckets for k in (parts_of(s, b, threshold, repeat) if len(s) else ())]
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["bucket", "key", "rid", "n", "sig"])

    while members.filter(F.col("size") > split).limit(1).count():
        large = members.filter(F.col("size") > split)
        asked = large.groupBy("rid").agg(F.first("n").alias("n"), F.collect_list("key").alias("buckets")).join(reps.select("rid", "rep"), "rid")  # a few buckets a run
        asked = durable(asked.withColumnRenamed("rep", "doc_id"), "jac-asked")
        small_batches(spark)
        texts = with_hit(known, known["doc_id"], bitmap_of(asked, "doc_id", "jac-asked-ids"), "hit").filter("hit").select("doc_id", "text")
        # An id may stand for several texts, or for one several times: only the set that is asked for counts, once.
        parts = texts.join(asked, "doc_id").mapInArrow(chosen, "bucket long, key long, rid long, n long, sig binary")
        parts = durable(parts.filter(F.col("rid") == F.xxhash64("sig")).select("bucket", "key", "rid", "n").distinct(), "jac-parts")
        sizes = parts.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"))
        whole = large.select("key", "size").distinct().withColumnsRenamed({"key": "bucket", "size": "of"})
        tight = sizes.groupBy("bucket").agg(F.max("size").alias("most")).join(whole, "bucket", "right")
        tight = durable(tight.select("bucket", (F.coalesce("most", F.lit(0)) > shrink * F.col("of")).alias("tight")), "jac-tight")
        leaves = leaves.unionByName(large.join(tight.filter("tight").select(F.col("bucket").alias("key")), "key", "left_semi"))
        opened = sizes.filter("size > 1").join(tight.filter("NOT tight").select("bucket"), "bucket")
        members = durable(parts.join(opened, ["bucket", "key"]).select("key", "rid", "n", "size", "total"), "jac-members")
        leaves = leaves.unionByName(members.filter(F.col("size") <= split))
        release(spark)
    return leaves


def jaccard_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, split: int = SPLIT, chunk: int = CHUNK, repeat: float = REPEAT, shrink: float = SHRINK) -> DataFrame:
    """(doc_id, class_id, n_links): the least ``doc_id`` reachable by links, and the other rows within the threshold."""
    spark = docs.sparkSession
    rows = need(docs, doc_id="long", text="string")
    known = rows.filter("doc_id IS NOT NULL")
    signed = durable(signatures(known, words, threshold, runs_for(recall)), "jac-signed").withColumn("rid", F.xxhash64("sig"))
    reps = signed.groupBy("rid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("n").alias("n"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    reps = durable(reps, "jac-reps")
    firsts = reps.select("rid", "n", F.explode("paths").alias("key"))
    sizes = durable(firsts.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).filter("size > 1"), "jac-sizes")
    # Most keys belong to one set only and leave before the shuffle.
    shared = with_hit(firsts, F.col("key"), bitmap_of(sizes, "key", "jac-shared"), "hit").filter("hit").drop("hit")
    members = durable(shared.join(sizes, "key").select("key", "rid", "n", "size", "total"), "jac-members")
    members = split_buckets(members, known, reps, words, threshold, split, repeat, shrink)
    keyed = members.groupBy("rid").agg(F.collect_list("key").alias("keys"))  # a few keys a run
    facts = durable(reps.join(keyed, "rid").select("rid", "n", "m", "rep", "keys", "sketch"), "jac-facts")
    release(spark)
    chunks = F.ceil(F.greatest(F.col("size") / F.lit(chunk), F.col("total") / F.lit(CHUNK_SHINGLES))).cast("int")
    part = F.pmod(F.xxhash64("rid", "key"), chunks.cast("long")).cast("int")
    spread = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    spread = spread.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rid")
    small_batches(spark)

    # Small buckets share tasks; Spark joins small partitions, never parts of a bucket.
    by_bucket = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    sketched = spread.join(facts.select("rid", "n", "keys", "sketch"), "rid").select("key", "i", "j", "part", "rid", "n", "keys", "sketch")
    kept = durable(by_bucket(sketched).mapInArrow(_survivors(threshold), "key long, i int, j int, part int, rid long"), "jac-kept")
    release(spark)
    wanted = durable(kept.select("rid").distinct().join(facts.select("rid", "rep", "m", "keys"), "rid"), "jac-wanted")
    sets = whole_sets(known, wanted, words)
    full = kept.join(sets, "rid").select("key", "i", "j", "part", "rid", "m", "keys", "shingles")
    found = durable(by_bucket(full).mapInArrow(_links(threshold), "a long, b long, links long"), "jac-links")
    release(spark)
    links = found.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    labels = components(found.filter("b IS NOT NULL")).select(F.col("id").alias("rid"), "label")
    named = labels.join(reps.select("rid", "rep"), "rid")
    classes = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = named.join(classes, "label").select("rid", "class_id")
    info = reps.select("rid", "rep", "m").join(named, "rid", "left").join(links.withColumnRenamed("a", "rid"), "rid", "left")
    info = info.select("rid", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = signed.select("doc_id", "rid").join(info, "rid").select("doc_id", "class_id", "n_links")
    return out.unionByName(rows.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns kept, with one row of each class: that with the class's id.

    Each input row travels as one struct, so its names clash with none.
    """
    ids = jaccard_classes(docs, **options).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    ids = durable(ids.agg(F.count_if(F.col("doc_id") == F.col("class_id")).alias("rows"), F.count(F.lit(1)).alias("all_rows")), "jac-ids")
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("own"))
    # Most ids have one row, which stays: only the texts of the others, and of false hits, are shuffled.
    marked = with_hit(row, row["own"], bitmap_of(ids.filter(~F.expr("rows = 1 AND all_rows = 1")), "id", "jac-open"), "hit")
    plain = marked.filter("NOT hit OR own IS NULL").select("row")
    open_rows = marked.filter("hit AND own IS NOT NULL").select("row", "own")
    single = open_rows.join(ids.filter("rows = 1"), F.col("own") == F.col("id"), "left_semi").select("row")
    # Rows that share the id of a kept document are copies of each other, or ambiguous: the least row stays.
    repeated = open_rows.join(ids.filter("rows > 1"), F.col("own") == F.col("id"), "left_semi")
    place = Window.partitionBy("own").orderBy(*(F.col("row")[c].asc_nulls_last() for c in docs.columns))
    repeated = repeated.withColumn("place", F.row_number().over(place)).filter("place = 1").select("row")
    kept = plain.unionByName(single).unionByName(repeated)
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
