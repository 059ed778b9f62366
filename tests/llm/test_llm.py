"""The corpus operators against brute force on small tables, with the edge cases of their docstrings."""

import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, fingerprint, jaccard, licences, mixing, packing, pii, queries, substrings, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string"


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    """Nulls in any column, empty, repeated and long rows, extra columns with clashing names."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["the", "an", "er", "ti", "on", "ß", "é"]) for _ in range(rng.randint(1, 4)))
    base = [" ".join(word() for _ in range(60)) for _ in range(12)]
    texts = [*base, base[0], base[1] + " extra", base[2][40:] + " tail", None, "", " ", "one two", "a" * 30_000, "ab " * 5000, base[3] + "\n" + base[4], base[0]]
    texts += ["mail me at jo.do@mail1.example.com_x@y.org or +1 (555) 123-4567, 4111 1111 1111 1111 and 10.0.0.255.7 300.1.1.1", "Released under the MIT License. Licensed under CC BY-NC 4.0."]
    rows = [(i, x, "en", None if i % 5 == 0 else f"s{i % 3}", len(x) if x else None, "clash", None) for i, x in enumerate(texts)]
    rows += [rows[3], (None, base[5], None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("edge"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(10)] + [(1, 0, 0), (None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vec = [(i, [float(x) for x in np.random.default_rng(i).normal(size=8)], 0) for i in range(120)]
    vec += [(50, vec[50][1], 0), (121, None, 0), (122, [float("nan")] * 8, 0), (123, [1.0], 0), (100, None, 1), (None, [1.0] * 8, 0), (124, [0.5, None] * 4, 0)] + [(200 + i, [1.0] * 8, 0) for i in range(300)]
    spark.createDataFrame(vec, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    page = "é" * 80
    spark.createDataFrame([(1, "u", page), (2, "u\r\nv", page), (None, None, page), (3, None, None), (4, "z", "\r\n\r\nWARC/1.1\r\n" * 20), (5, "z", "\r\n\r\nWARC/1.1\r\n" * 20), (6, "", "short"), (7, "", "short")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, edge, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{edge}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


def docs_of(spark, path):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_edge_tables(spark, edge):
    """Every query answers for every row of the edge tables, with its contract's columns."""
    columns = {
        "op1_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op2_topk": "query_id rank vec_id score",
        "op3_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op4_warc": "page_id payload_bytes payload_digest record_type refers_to",
        "op5_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op6_substring_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op7_toxicity": "doc_id held_out score predicted",
        "op8_mixing": "doc_id size source_size target taken",
        "op9_ngram_jaccard": "doc_id class_id n_links",
        "op10_licences": "doc_id",
    }
    docs = collections.Counter(d for d, _ in docs_of(spark, edge))
    for name, query in queries.QUERIES.items():
        out = query(spark, edge)
        assert out.columns[: len(columns[name].split())] == columns[name].split(), name
        rows = out.collect()
        if name == "op4_warc":
            assert len(rows) == spark.read.parquet(f"{edge}/pages.parquet").count()
        elif name == "op5_packing":
            assert collections.Counter(r["doc_id"] for r in rows if r["piece"] == 0) == docs
        elif name != "op2_topk":
            assert collections.Counter(r["doc_id"] for r in rows) == docs, name
        if name == "op7_toxicity":
            assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_pipeline_on_empty_and_edge(spark, empty, edge):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, edge), "test")
        assert [f.name for f in docs.schema] == [c.split(" ")[0] for c in DOCS.split(", ")]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, edge).count() > 0


def brute_pii(rows):
    """Masked texts of (doc_id, text) rows."""
    terms = {d: s for d, s in brute_terms(rows)}
    out = {}
    for d, t in rows:
        spans = sorted((int(a), int(b), k.upper()) for k, a, b in (s.split(":") for s in [*base_spans(t).split(","), *terms[d].split(",")] if s))
        at, parts = 0, []
        for a, b, k in spans:
            if a >= at:
                parts += [t[at:a], f"[{k}]"]
            at = max(at, b)
        out[d] = "".join(parts) + t[at:]
    return out


def test_pipeline_by_brute_force(spark, sf):
    """Each stage's rows from its own input, and the whole run."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step = lambda name, df: corpus_pipeline.durable(stage[name](spark, df, sf), "test")
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = step("toxicity", docs)
    raw = {d: naive_raw(lexicon, x) for d, x in docs_of(spark, sf)}
    assert rows(kept) == {d: r for d, r in rows(docs).items() if raw[d] < lexicon.threshold}

    single = step("ngram_jaccard", kept)
    classes = brute_links([(d, r["text"] or "") for d, r in rows(kept).items()])
    assert rows(single) == {d: rows(kept)[d] for d, c, _ in classes if d == c}

    clean = step("pii", single)
    masked = brute_pii([(d, r["text"] or "") for d, r in rows(single).items()])
    got = rows(clean)
    assert {d: r["text"] or "" for d, r in got.items()} == masked
    same = [c for c in docs.columns if c not in ("text", "n_chars")]
    assert all(r[c] == rows(single)[d][c] for d, r in got.items() for c in same) and all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"])

    mixed = step("mixing", clean)
    assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect()) == brute_mix(spark, [(d, r["text"], r["source"]) for d, r in got.items()])

    out = step("packing", mixed).collect()
    check_packing([(r["doc_id"], r["text"] or "") for r in mixed.collect()], out, 2)
    digest = lambda some: collections.Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in some)
    assert digest(corpus_pipeline.run(spark, sf).collect()) == digest(out)


def base_spans(t):
    def luhn(d):
        return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0

    n = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(n(m)) <= 19 and luhn(n(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(n(m)) <= 15),
    )
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t) if ok(m))


def test_pii_base(spark, edge, sf):
    for path in (edge, sf):
        want = collections.Counter((d, hashlib.sha256(base_spans(x).encode()).hexdigest()) for d, x in docs_of(spark, path))
        assert collections.Counter((r["doc_id"], r["base_sha256"]) for r in queries.op1_pii(spark, path).collect()) == want


def test_pii_terms_and_masks(spark):
    filler = [f"common words here number{i}" for i in range(40)]
    held = [f"{w} zanzibar j@x.org common words here" for w in ("alpha", "beta", "gamma", "delta")]
    docs = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(filler + held)], "doc_id long, text string, n_chars long")
    out = [r["text"] for r in pii.sanitise(docs).orderBy("doc_id").collect()]
    assert out[:40] == filler
    assert out[40] == "alpha [TERM] [EMAIL] common words here"


def test_pii_terms_of_rare_entities(spark):
    """An entity that stands in one text, or in copies of one, has revealing terms too."""
    filler = [f"common words here number{i}" for i in range(60)]
    held = ["quixby j@x.org common words here"] + ["wuzzle +1 (555) 123-4567 common words here"] * 5
    docs = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(filler + held)], "doc_id long, text string, n_chars long")
    out = [r["text"] for r in pii.sanitise(docs).orderBy("doc_id").collect()]
    assert out == filler + ["[TERM] [EMAIL] common words here"] + ["[TERM] [PHONE] common words here"] * 5


def test_pii_terms_in_all_documents(spark):
    """A revealing term is found far from its entity, masked where the entity is not, and for an entity of many rows."""
    filler = [f"common words here number{i}" for i in range(40)]
    far = "quixby " + "common words here " * 12 + "j@x.org"
    bare = "Quixby common words here"
    often = [f"zanzibar k@y.org common words number{i}" for i in range(20)]  # 20 of 62: no term can have 3 bits
    docs = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(filler + [far, bare] + often)], "doc_id long, text string, n_chars long")
    out = [r["text"] for r in pii.sanitise(docs).orderBy("doc_id").collect()]
    assert out[:40] == filler
    assert out[40] == far.replace("quixby", "[TERM]").replace("j@x.org", "[EMAIL]") and out[41] == "[TERM] common words here"
    assert out[42:] == [x.replace("zanzibar", "[TERM]").replace("k@y.org", "[EMAIL]") for x in often]


def brute_terms(rows):
    """Spans of disclosing terms of each (doc_id, text), by the definition."""
    n = len(rows)
    words = lambda t: {m[0].lower() for m in re.finditer(r"[^\W_]+", t) if len(m[0].lower()) >= 3}
    values = lambda t: {(k, t[int(a) : int(b)]) for k, a, b in (s.split(":") for s in base_spans(t).split(",") if s)}
    n_t = collections.Counter(w for _, t in rows for w in words(t))
    n_e = collections.Counter(e for _, t in rows for e in values(t))
    texts, n_et, support = collections.defaultdict(set), collections.Counter(), collections.defaultdict(set)
    for _, t in rows:
        for e in values(t):
            texts[e].add(t)
            for w in words(t):
                n_et[e, w] += 1
                support[e, w].add(t)
    marked = {w for (e, w), both in n_et.items() if len(support[e, w]) >= min(3, len(texts[e])) and both * 2 >= n_t[w] and both * n > n_t[w] * n_e[e]}
    out = []
    for d, t in rows:
        base = [tuple(map(int, s.split(":")[1:])) for s in base_spans(t).split(",") if s]
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in marked]
        out.append((d, ",".join(f"term:{a}:{b}" for a, b in spans if not any(x <= a and b <= y for x, y in base))))
    return out


def test_pii_terms_by_brute_force(spark, edge, sf):
    """Every disclosure score and every span of a term, also in long texts and for single entities."""
    some = False
    for path in (edge, sf):
        rows = docs_of(spark, path)
        got = collections.Counter((r["doc_id"], ",".join(s for s in r["spans"].split(",") if s.startswith("term:"))) for r in queries.op1_pii(spark, path).collect())
        want = collections.Counter(brute_terms(rows))
        assert got == want
        some |= any(s for _, s in want)
    assert some


def test_pii_clashing_columns(spark):
    """Columns named like the operator's own ones stay as they are."""
    names = ["row", "key", "hit", "k", "spans", "marked", "new", "_key", "_new", "_hit", "_spans"]
    docs = spark.createDataFrame([(1, "mail a@b.org or", 15, *names), (2, "plain words", 11, *names)], "doc_id long, text string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    out = [tuple(r) for r in pii.sanitise(docs).orderBy("doc_id").collect()]
    assert [r[3:] for r in out] == [tuple(names)] * 2 and out[1][:3] == (2, "plain words", 11)
    assert out[0][1].startswith("[TERM] [EMAIL]") and out[0][2] == len(out[0][1])


def test_topk(spark, edge):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{edge}/embeddings.parquet").collect()]
    fine = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, v in fine:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q and len(w) == len(v)))[:5]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for options in ({}, {"shard_rows": 40}, {"shard_rows": 16, "first_round": 1}):
        got = collections.defaultdict(list)
        for r in topk.top_k(spark.read.parquet(f"{edge}/embeddings.parquet"), F.col("id") % 50 == 0, **options).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        assert got == want


def test_cells():
    """Cells of near equal size, also with many equal rows; every row finds the cell that it fell into."""
    rng = np.random.default_rng(3)
    x = rng.integers(-100, 100, (1000, 5))
    x[:300] = 7
    dims, at = topk.cells(x, 16)
    where = topk.cell_of(x, dims, at)
    assert len(dims) == 15 and where.min() >= 0 and where.max() <= 15 and len(set(where[:300].tolist())) == 1
    assert np.bincount(where[300:]).max() < 200
    assert topk.cell_of(x[:0], dims, at).tolist() == [] and topk.cell_of(x, *topk.cells(x[:0], 16)).tolist() == [0] * 1000


def naive_fingerprint(text, functions=128):
    """The two least numbered k-mers of each function's order, in text order."""
    import xxhash

    def signed(b, seed):
        return xxhash.xxh64_intdigest(b, seed)

    def h(*parts):  # a string, an 8-byte or a 4-byte number each
        out = 42
        for p in parts:
            if p is not None:
                out = signed(p.encode() if isinstance(p, str) else p, out)
        return out

    long = lambda v: (v & (2**64 - 1)).to_bytes(8, "little")
    int_ = lambda v: v.to_bytes(4, "little")
    signed33 = lambda v: v - 2**33 if v >= 2**32 else v
    tokens = re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text)
    if not tokens:
        return [h(int_(f)) >> 32 for f in range(functions)]
    seen, numbered = collections.Counter(), []
    for i in range(max(1, len(tokens) - 2)):
        kmer = h(*(tokens[i + j] if i + j < len(tokens) else None for j in range(3))) >> 31
        what = h(long(signed33(kmer)), int_(seen[kmer])) >> 31
        seen[kmer] += 1
        numbered.append((what, i + 1))
    out = []
    for f in range(functions):
        start = ((f * (2**64 // functions) - 2**63) % 2**64) >> 31
        least = sorted(numbered, key=lambda x: ((x[0] - start) % 2**33, x[1]))[:2]
        a, b = sorted([least[0], least[-1]], key=lambda x: x[1])
        out.append(h(int_(f), long(signed33(a[0])), long(signed33(b[0]))) >> 32)
    return out


def test_fingerprint(spark, edge, sf):
    """Every column by brute force, with the edge cases and over a plain table."""
    for path in (edge, sf):
        rows = sorted(((d is None, -(d or 0), hashlib.md5(x.encode()).hexdigest(), d, x) for d, x in docs_of(spark, path)), key=lambda r: r[:3])
        want = collections.Counter()
        hexed = lambda fp: "".join(f"{v:08x}" for v in fp)
        alike = lambda a, b: sum(p == q for p, q in zip(a, b, strict=True)) / 128
        for k, (_, _, _, d, x) in enumerate(rows):
            other, cut = rows[(k + 1) % len(rows)][4], len(x) // 3
            new = x[: len(x) - cut] + other[:cut]
            fp, edited_fp = naive_fingerprint(x), naive_fingerprint(new)
            want[d, len(x), hashlib.sha256(new.encode()).hexdigest(), hexed(fp), hexed(edited_fp), alike(fp, edited_fp), alike(fp, naive_fingerprint(other))] += 1
        got = collections.Counter(tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")) for r in queries.op3_fingerprint(spark, path).collect())
        assert got == want


def test_fingerprint_order_and_numbers(spark):
    x = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    texts = [x, x, x.replace("fourteen", "last"), " ".join(reversed(x.split())), "a b c " * 5, "a b c " * 9]
    fp = [r["fp"] for r in spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", fingerprint.fingerprint(F.col("text")).alias("fp")).orderBy("id").collect()]
    same = lambda a, b: sum(p == q for p, q in zip(fp[a], fp[b], strict=True)) / 128
    assert same(0, 1) == 1 and 0.4 < same(0, 2) < 1 and same(0, 3) == 0 and 0 < same(4, 5) < 1


def test_successors_in_ranges(spark):
    """Small ranges, a frequent id and null ids: the same successors as one sort."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 7, 7, rng.randint(-50, 50), 2**62 + rng.randint(0, 9), -(2**63)]), f"t{rng.randint(0, 150)}") for _ in range(400)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = collections.Counter((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (3, 40, 1000):
        out = fingerprint.with_next(docs, lambda r: r.withColumn("fp", F.array(F.length("text"))), range_rows=size)
        assert collections.Counter((r["doc_id"], r["text"], r["next_text"]) for r in out.collect()) == want


def test_warc(spark, edge):
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in queries.op4_warc(spark, edge).collect()}
    assert got == {(1, 160, "response", None), (2, 160, "revisit", 1), (None, 160, "revisit", 1), (3, 0, "response", None), (4, 280, "response", None), (5, 280, "revisit", 4), (6, 5, "response", None), (7, 5, "response", None)}
    path = warc.shared_path(spark, "test-warc")
    warc.write_warc(warc.page_records(spark.read.parquet(f"{edge}/pages.parquet")), path)
    heads = warc.read_warc(spark, path, payload=False).filter("record_type = 'revisit'").collect()
    assert len(heads) == 3 and all(r["payload"] is None for r in heads)
    assert {r["payload"].decode() for r in warc.read_warc(spark, path).filter("record_id = '<urn:page:4>'").collect()} == {"\r\n\r\nWARC/1.1\r\n" * 20}


def check_packing(docs, out, spare):
    """Pieces by the slow tokenizer, gapless sequences, and hardly more of them than the sum of lengths needs."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for d, x in docs:
        ids = [*slow.encode(x, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[d, k // 4096, k, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in out) // 4096) + spare


def test_packing(spark, edge, sf):
    for path in (edge, sf):
        check_packing(docs_of(spark, path), queries.op5_packing(spark, path).collect(), 1 + (path == edge))


def test_tokens_of_odd_texts():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(packing.tokenizer_path()), packing.tokenizer(packing.tokenizer_path())
    odd = ["", " ", "Ça và İstanbul ΣΑΣ don't we'LL x²½ 12.5 á ẹ́", "<|endoftext|> a<|startoftext|>b <| x", "漢字 かな　全角 ​ x\x85y\x1cz\tq\r\nw", "🙂🙂 á̂", "''s 're'Ve", "\x00 ﻿b", "ǅ ﬁ ẞ ſ"]
    for x in odd:
        assert np.frombuffer(fast.encode(x), dtype="<u4").tolist() == slow.encode(x, add_special_tokens=False).ids, x


def test_plan_uses_every_piece_once():
    rng = random.Random(3)
    for _ in range(20):
        histogram = collections.Counter(rng.choice([rng.randint(1, 100), rng.randint(1, 30)]) for _ in range(rng.randint(0, 300)))
        used = collections.Counter()
        for lengths, n in packing.plan(histogram, 100):
            assert n > 0 and sum(lengths) <= 100
            for x in lengths:
                used[x] += n
        assert used == histogram


def removed(docs, n=50):
    docs = sorted((d, x.encode()) for d, x in docs if d is not None)
    first = {}
    for d, b in docs:
        for p in range(len(b) - n + 1):
            first.setdefault(b[p : p + n], d)
    for d, b in docs:
        cut = np.zeros(len(b) + 1, dtype=np.int8)
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < d:
                cut[p : p + n] = 1
        kept = bytes(c for c, k in zip(b, cut, strict=False) if not k)
        yield d, len(b), int(cut.sum()), int((np.diff(np.concatenate([[0], cut])) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_substrings(spark, edge, sf):
    for path in (edge, sf):
        got = collections.Counter(tuple(r) for r in queries.op6_substring_dedup(spark, path).collect() if r["doc_id"] is not None)
        assert got == collections.Counter(removed(docs_of(spark, path)))


def test_longest_previous_factor():
    rng = random.Random(5)
    for letters, n, length in ((b"ab", 90, 8), (b"abc", 200, 11), (b"a", 60, 16), (b"ab", 300, 50)):
        data = bytes(rng.choice(letters) for _ in range(n))
        buffer = np.frombuffer(data, dtype=np.uint8)
        starts = np.array(sorted(rng.sample(range(n - length + 1), min(40, n - length + 1))))
        owner = np.array([rng.randint(0, 9) for _ in starts])
        lpf = substrings.longest_previous_factor(buffer, starts, owner, length)
        for i, s in enumerate(starts):
            best = 0
            for j, q in enumerate(starts):
                if owner[j] < owner[i]:
                    k = 0
                    while k < length and data[s + k] == data[q + k]:
                        k += 1
                    best = max(best, k)
            assert lpf[i] == best
    assert len(substrings.longest_previous_factor(buffer, starts[:0], owner[:0], 50)) == 0


def test_previous_smaller(monkeypatch):
    rng = np.random.default_rng(2)
    for jumps in (200, 1):
        monkeypatch.setattr(substrings, "JUMPS", jumps)
        for x in (rng.integers(0, 9, 300), np.arange(50), np.arange(50)[::-1], np.append(np.arange(1, 300), 0), np.zeros(20, int), np.zeros(0, int)):
            want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]
            assert substrings.previous_smaller(x).tolist() == want


def test_substrings_of_a_frequent_passage(spark):
    """A passage in every document, whole or in part, between words of its own, and repeats within one document."""
    rng = random.Random(8)
    own = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = own(300)
    docs = [(i, own(rng.randint(0, 90)) + passage[rng.randint(0, 60) : rng.randint(120, 300)] + own(rng.randint(0, 90))) for i in range(150)]
    docs += [(200 + i, x * 2 + x[:70]) for i, (_, x) in enumerate(docs[:20])]
    got = collections.Counter(tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect())
    assert got == collections.Counter(removed(docs))


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "re", "su", "to"]) for _ in range(3))
    bad, rows, labels = ["zogfump", "blarkish", "snozwort"], [], []
    for i in range(400):
        words, toxic = [word() for _ in range(rng.randint(5, 60))], int(i % 4 == 0)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad).replace("o", "0") if i % 8 else rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, known)
    hold = [(x, t) for (i, x), (_, _, t) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((lexicon.score(x) >= 0.5) == (t == 1) for x, t in hold) / len(hold) > 0.97
    assert lexicon.score(None) == 0 and lexicon.score("") == 0
    safe = toxicity.Lexicon({"=trash": 5.0}, 1.0)
    assert toxicity.weigh({"=idiot": 60, "idiot": 80}, {"=idiot": 0, "idiot": 1}, 100, 100).keys() == {"=idiot", "idiot"}
    assert safe.raw("a tr4sh can") == 0 and safe.raw("such trаsh") > 0 and safe.raw("trashy") == 0


def naive_raw(lexicon, text):
    """The raw score by looking at each word for each term."""
    t = toxicity.fold(text)
    at = [m.span() for m in re.finditer(r"[^\W_]+", t)]
    safe = [(m.start(), m.end()) for x in lexicon.exceptions for m in re.finditer(rf"(?<![^\W_]){re.escape(x)}(?![^\W_])", t)]
    total = 0.0
    for a, b in at:
        best = 0.0
        for term, weight in lexicon.terms.items():
            bare = term.lstrip("=")
            if (t[a:b] == bare if term[0] == "=" else t[a:b].startswith(bare)) and not any(x <= a and a + len(bare) <= y for x, y in safe):
                best = max(best, weight)
        total += best
    return total / (1.0 + np.log1p(t.count(" ") / 50.0))


def test_toxicity_by_naive_matcher():
    rng = random.Random(11)
    lexicon = toxicity.Lexicon({"=trash": 5.0, "tra": 2.0, "idiot": 4.0, "=idiot": 6.0, "=clown": 3.0, "scum": 1.5, "=scumbag": 7.0}, 1.0)
    bits = ["trash", "tr4sh", "trashy", "can", "bin", "idiot", "id1ot", "IDIOTIC", "clown", "class", "fish", "scum", "scumbag", "scumbags", "the", "ex-idiot", "nоt", "trаin", "a.b"]
    for _ in range(300):
        text = rng.choice([" ", "  "]).join(rng.choice(bits) + rng.choice(["", "", ".", "!!"]) for _ in range(rng.randint(0, 30)))
        assert abs(lexicon.raw(text) - naive_raw(lexicon, text)) < 1e-9, text
    assert lexicon.raw("you idiot") > 0 and lexicon.raw("you idiotic man") > 0


def test_mixing_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, size long")
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == (10, 30.0) and abs(sum(v[1] for v in got.values()) - 2510) < 1e-6
    assert got[None] == (500, 1500.0) and abs(got["b"][1] - 980 * 2 / 3) < 1e-6  # the null source stops too


def test_mixing_taken(spark, edge):
    got = queries.op8_mixing(spark, edge).collect()
    per = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[r["source"]][0] += r["taken"]
        per[r["source"]][1] += r["size"]
        per[r["source"]][2] = r["target"]
    assert all(k[0] == int(k[2]) and k[2] <= 3 * k[1] for k in per.values())
    assert sorted(map(repr, got)) == sorted(map(repr, queries.op8_mixing(spark, edge).collect()))


def brute_mix(spark, rows):
    """How often each (doc_id, text, source) is in the mix."""
    sizes = {x: len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for _, x, _ in rows}
    key = lambda r: hashlib.md5(f"mix:{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()
    per = collections.Counter()
    for _, x, s in rows:
        per[s] += sizes[x]
    targets = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(per.items()), "source string, size long")).collect()}
    want = collections.Counter()
    for s, total in per.items():
        epochs, left = divmod(int(targets[s]), total) if total else (0, 0)
        groups = collections.defaultdict(list)
        for r in rows:
            if r[2] == s:
                groups[key(r)].append(r)
        for _, same in sorted(groups.items()):
            n = sizes[same[0][1]]
            some = n > 0 and left > 0 and left * 2 >= n
            left = max(0, left - n * len(same))
            want[same[0]] += len(same) * (1 if n == 0 else epochs + some)
    return +want


def test_mixed_documents(spark, edge, sf):
    for path in (edge, sf):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mix_documents(docs).collect()) == brute_mix(spark, rows)


def test_mixed_documents_clashing_columns(spark):
    names = ["row", "again", "_again", "last", "epochs", "p"]
    docs = spark.createDataFrame([(1, "a b c", "s", *names), (2, "d e", None, *names)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and {r[3:] for r in out.collect()} == {tuple(names)}


def brute_links(docs):
    sets, links, root = {}, collections.Counter(), {}
    rows = [(k, d, x.split()) for k, (d, x) in enumerate(docs)]
    for k, _, w in rows:
        sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        root[k] = k

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (a == b) or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = collections.defaultdict(list)
    for k, d, _ in rows:
        least[top(k)].append(d)
    return collections.Counter((d, min(least[top(k)]), links[k]) for k, d, _ in rows)


def test_jaccard(spark, edge, sf):
    for path in (edge, sf):
        docs = [(d, x) for d, x in docs_of(spark, path) if d is not None]
        table = spark.read.parquet(f"{path}/documents.parquet")
        for options in ({}, {"chunk": 3}):
            got = collections.Counter(tuple(r) for r in jaccard.jaccard_classes(table, **options).collect() if r["doc_id"] is not None)
            assert got == brute_links(docs)


def test_jaccard_split_buckets(spark):
    """Buckets split to several levels, and near copies that no split tells apart."""
    base = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join([*base, f"x{i}"])) for i in range(60)] + [(100 + i, f"only {i} here now so") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(df, split=10, chunk=7).collect()}
    assert all(got[i] == (0, 59) for i in range(60)) and all(got[100 + i] == (100 + i, 0) for i in range(20))


def test_jaccard_recall_when_split(spark, sf):
    """Passages that many unlike texts share make large buckets: pairs in them are found at any depth of splits."""
    rng = random.Random(17)
    passage = " ".join(f"p{i}" for i in range(40))
    own = lambda: " ".join(f"z{rng.randint(0, 10**9)}" for _ in range(60))
    texts = [f"{own()} {passage}" for _ in range(120)]
    near = []
    for k, x in enumerate(texts[:60]):
        w = x.split()
        w[rng.randrange(60)] = f"n{k}"
        near.append(" ".join(w))
    docs = list(enumerate([*texts, *near])) + [(1000 + d, x) for d, x in docs_of(spark, sf)]
    want = brute_links(docs)
    total = sum(n * c for (_, _, n), c in want.items())
    assert total >= 120
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for split in (100, 20, 6):
        got = jaccard.jaccard_classes(df, split=split, chunk=8).collect()
        links = {r["doc_id"]: r["n_links"] for r in got}
        assert sum(links.values()) >= 0.995 * total, split
        if sum(links.values()) == total:
            assert collections.Counter(map(tuple, got)) == want


def test_near_copies_clashing_columns(spark):
    names = ["row", "own", "hit", "id", "place", "_id", "_lodestone_hit", "rows"]
    docs = spark.createDataFrame([(1, "a b c d e f g", *names), (2, "a b c d e f g", *names), (3, "other words", *names), (None, "x", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert sorted((r["doc_id"] or 0, *r[2:]) for r in jaccard.drop_near_copies(docs).collect()) == [(d, *names) for d in (0, 1, 3)]


def test_licences(spark, edge):
    scan = licences.Scanner().scan
    got = scan("x\nReleased under the MIT License. Foo. Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.")[1]
    assert [(h[0], h[3]) for h in got] == [("MIT", "exact"), ("CC-BY-NC-4.0", "exact"), ("CC-BY-4.0", "exact")]
    assert [(h[0], h[3]) for h in scan("This code is licensed under the GNU General Public License, version 3")[1]] == [("GPL-3.0", "variant")]
    assert scan("the licence of poets, version 9")[1] == [] and scan(None) == (0, [])
    assert {(r["doc_id"], r["licences"]) for r in queries.op10_licences(spark, edge).filter("n_licences > 0").collect()} == {(24, "CC-BY-NC-4.0,MIT")}


def test_licences_wrapped_and_repeated():
    """Notices over several lines, and two variants of one template in a block."""
    scan = licences.Scanner().scan
    names = lambda text: [(h[0], h[3]) for h in scan(text)[1]]
    assert names("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files") == [("MIT", "exact")]
    assert names("x\nLicensed under the Apache License,\nVersion 2.0.\ny") == [("Apache-2.0", "exact")]
    two = "This code is licensed under the GNU General Public License, version 3. Some other words stand here. This code is licensed under the GNU General Public License, version 3."
    assert names(two) == [("GPL-3.0", "variant")] * 2
    assert names("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and the associated documentation files") == [("MIT", "variant")]


def test_licence_texts():
    """Whole texts, file headers and tags, wrapped, altered, repeated and in a long text."""
    scanner = licences.Scanner()
    names = lambda text: [(h[0], h[3]) for h in scanner.scan(text)[1]]
    bsd2 = " ".join((licences.BSD_OPENING + ":", licences.BSD_SOURCE, licences.BSD_BINARY, licences.BSD_DISCLAIMER))
    bsd3 = " ".join((licences.BSD_OPENING + ":", licences.BSD_SOURCE, licences.BSD_BINARY, licences.BSD_NAMES, licences.BSD_DISCLAIMER))
    wrap = lambda text, n=60: "\n * ".join(textwrap.wrap(text, n, break_long_words=False, break_on_hyphens=False))
    for name, text in {"BSD-2-Clause": bsd2, "BSD-3-Clause": bsd3, "ISC": licences.ISC_GRANT, "Apache-2.0": licences.APACHE_HEADER, "MIT": f"{licences.MIT_GRANT} {licences.MIT_NOTICE} {licences.MIT_DISCLAIMER}"}.items():
        assert names(text) == names(wrap(text)) == names("x " * 30_000 + wrap(text, 40) + " y" * 30_000) == [(name, "exact")]
    assert names(wrap(bsd3.replace("the copyright holder nor", "Acme Rockets nor"))) == [("BSD-3-Clause", "variant")]
    assert names("* " + wrap(licences.BSD_OPENING, 40) + ":") == [("BSD", "exact")]
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    assert names(gpl) == [("GPL-3.0", "exact")] and names(gpl.replace("version 3", "version 2"))[0][0] == "GPL-2.0"
    assert names("// SPDX-License-Identifier: CC-BY-SA-4.0\n# SPDX-License-Identifier: MIT") == [("CC-BY-SA-4.0", "exact"), ("MIT", "exact")]
    assert names("Released under the MIT License. " * 3000) == [("MIT", "exact")] * 3000


def test_licences_by_naive_search():
    """Every exact notice that a plain search for its words finds, in random texts."""
    rng, scanner = random.Random(9), licences.Scanner()
    short = [t for t in licences.TEMPLATES if len(t[1]) < 160]
    patterns = [(n, re.compile(r"(?<![^\W_])" + r"[\W_]+".join(map(re.escape, licences.words(t))) + r"(?![^\W_])(?!\.\d)", re.I)) for n, t in licences.TEMPLATES]
    for _ in range(150):
        parts = [rng.choice(["some words here", "lorem ipsum dolor", "no notice at all", rng.choice(short)[1]]) for _ in range(rng.randint(1, 12))]
        text = rng.choice([" ", "\n", " -- "]).join(parts)
        want, taken = [], []
        for s, e, n in sorted(((m.start(), m.end(), n) for n, p in patterns for m in p.finditer(text)), key=lambda x: (x[0] - x[1], x[0], x[2])):  # the longest stay
            if all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                want.append((s, e, n))
        assert [(h[1], h[2], h[0]) for h in scanner.scan(text)[1] if h[3] == "exact"] == sorted(want)


def test_crowded_bitmap(spark, edge, monkeypatch):
    """Bitmaps full of false hits change no result."""
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    rows = lambda: sorted(map(str, jaccard.drop_near_copies(docs).collect()))
    want = rows()
    monkeypatch.setattr(common, "BITMAP_BITS", 8)
    assert rows() == want
