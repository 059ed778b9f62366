"""Best-fit packing by exact-complement hashing over a length histogram.

The packing is decided on the histogram of piece lengths, which has at most
``capacity`` rows however large the corpus is.  Patterns are multisets of lengths
that fill one sequence.  For the longest remaining length the planner looks up
its gap among single lengths, then pair sums, then triple sums, and takes as many
combinations at once as the counts allow; where no combination fills the gap
exactly it takes the best fitting shorter length and goes on.  Pieces are then
numbered within their length, in salted ranges, and find their place in the
pattern table by binary search.

Defined results: a null or empty text is the end token alone; repeated rows are
packed as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, need, small_batches, table

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers; the memory is emptied when full.
CACHE_WORDS = 300_000
#: Pieces numbered together within one length.
RANK_ROWS = 50_000


class WordTokenizer:
    """Ids of a lower-casing word BPE vocabulary, word by word from a memory.

    Pre-tokens of this vocabulary never contain white space, so a text's ids are
    its words' ids in a row.  Unknown words in common scripts go through a merge
    table in which a trailing space stands for the end of a word; any other word,
    and any with a special token's opening, goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.memory: dict[str, bytes] = {"": b""}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for token, number in spec["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith("</w>") and len(token) > 4
                ranks[bytes(byte[c] for c in (token[:-4] if ends else token)) + b" " * ends] = number
        self.merge = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.common = regex.compile(r"[\x21-ɏͰ-ϿЀ-џ‐-‧]*").fullmatch

    def word(self, word: str) -> bytes:
        if "<|" in word or not self.common(word):
            ids = self.slow.encode(word, add_special_tokens=False).ids
        else:
            if not word.isascii():
                word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
            parts = self.split(word.lower())
            ids = self.merge(" ".join(parts) + " ") if parts else []
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        memory, words = self.memory, text.replace("\n", " ").split(" ")
        try:
            return b"".join([memory[w] for w in words])
        except KeyError:
            if len(memory) > CACHE_WORDS:
                memory.clear()
                memory[""] = b""
            out = []
            for w in words:
                ids = memory.get(w)
                if ids is None:
                    ids = self.word(w)
                    if len(w) < 64:
                        memory[w] = ids
                out.append(ids)
            return b"".join(out)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's token pieces."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for batch in batches:
            out = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return need(docs, doc_id="long", text="string").mapInArrow(pieces, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their multiplicities that use up a histogram of lengths.

    Every step uses up a length or ends at a residual, so there are at most a few
    patterns a distinct length.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def times(lengths: list[int]) -> int:
        need_of: dict[int, int] = {}
        for x in lengths:
            need_of[x] = need_of.get(x, 0) + 1
        return min(int(left[x]) // k for x, k in need_of.items())

    def pair(gap: int, used: list[int]) -> list[int] | None:
        """Two lengths that sum to ``gap``, the larger as large as it can be."""
        if gap < 2:
            return None
        a = np.arange(gap - 1, (gap - 1) // 2, -1)
        a = a[(left[a] > 0) & (left[gap - a] > 0)]
        return next(([int(x), gap - int(x)] for x in a if times([*used, int(x), gap - int(x)])), None)

    whole = (1 << (capacity + 1)) - 1

    def pair_sums() -> int:
        """Bit s is set if two of the lengths left sum to s."""
        lengths = np.nonzero(left)[0].tolist()
        there = sum(1 << x for x in lengths)
        sums = 0
        for x in lengths:
            sums |= there << x
        return sums & whole

    def triple(gap: int, used: list[int]) -> list[int] | None:
        if gap < 3:
            return None
        sums = pair_sums()
        for a in np.nonzero(left[: gap - 1])[0][::-1].tolist():
            if sums >> (gap - a) & 1 and times([*used, a]) and (two := pair(gap - a, [*used, a])):
                return [a, *two]
        return None

    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        used = [top]
        while (gap := capacity - sum(used)) > 0:
            if gap <= capacity and left[gap] and times([*used, gap]):
                used.append(gap)
                break
            if combo := pair(gap, used) or triple(gap, used):
                used += combo
                break
            fits = np.nonzero(left[1 : gap + 1])[0][::-1] + 1
            best = next((int(x) for x in fits if times([*used, int(x)])), None)
            if best is None:
                break
            used.append(best)
        n = times(used)
        for x in used:
            left[x] -= n
        out.append((tuple(used), n))


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first rank, first sequence and offset of each run of places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((taken.get(x, 0), base, offset))
            taken[x] = taken.get(x, 0) + n
            offset += x
        base += n
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    ``pieces`` must be a stored table with columns doc_id, piece, start, length
    and ids_crc32.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    slots = spark.sparkContext.broadcast(_slots(plan(histogram, capacity)))  # a few runs a distinct length
    salts = max(1, -(-max(histogram.values(), default=0) // RANK_ROWS))
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    rows = rows.withColumn("in_salt", F.row_number().over(inside) - 1)
    rows = rows.join(counts, (rows["length"] == counts["l"]) & (rows["salt"] == counts["s"]))
    rows = rows.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("in_salt")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = slots.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.nonzero(np.diff(length[order]))[0] + 1) if len(order) else []:
                first, base, off = runs[int(length[part[0]])]
                k = np.searchsorted(first, rank[part], side="right") - 1
                sequence[part] = base[k] + rank[part] - first[k]
                offset[part] = off[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return rows.mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(durable(token_pieces(docs, path, capacity), "pack-pieces"), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
