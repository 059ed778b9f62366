"""Exact top-k inner products by KD-trees, one for each shard.

Rows are dealt to shards by place: median splits fitted on a bounded sample cut the
space into cells; every row is dealt, and a cell with more rows than a shard should
have is shared out by hash.  In its shard's task the vectors become a KD-tree: median
splits on the widest dimension, a tight bounding box for each node.  A query visits
nodes best first, by the greatest inner product that a node's box allows, and stops
when that cannot beat its k-th best.  Queries search their own shard first.  The
shards' root boxes then bound what the others can give: a query goes on to the most
promising few that may beat its k-th best, which goes with it, and so on in rounds of
more and more shards, until no shard is left that may.  Within a task the shard's
vectors come first and the queries stream past the tree in batches, so memory is
bounded by the shard.

Ties go to the smaller id, so a node whose bound equals the k-th score is still
visited if it has an id small enough; nodes of equal vectors are leaves, however
many.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part; neither do candidates of another dimension than the query's, nor
null ids; repeated rows are candidates of their own, and one query; rows with the
query's id are never its candidates; empty in, empty out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, need, table

TOP = 5
EVERY = 50
SCALE = 256.0
SHARD_ROWS = 4096
LEAF_ROWS = 128
#: Rows of the sample that the cells are fitted on, about, and least rows of it for a cell.
SAMPLE_ROWS, SAMPLE_CELL = 20_000, 16
#: Shards that a query visits in the first round after its own; each further round has so many times more.
ROUND = 4
#: Boxes are broadcast in blocks of this size at most.
BOX_BYTES = 64 << 20


class KDTree:
    """Median splits with tight boxes over integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, x = ids[order], vectors[order]
        self.kids: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        low, high, least = [], [], []

        def build(at: np.ndarray) -> int:
            node = len(self.kids)
            lo, hi = x[at].min(0), x[at].max(0)
            low.append(lo)
            high.append(hi)
            least.append(self.ids[at[0]])
            self.kids.append(None)
            self.rows.append(at)
            spread = hi - lo
            if len(at) > leaf and len(spread) and spread.max() > 0:
                column = x[at, int(spread.argmax())]
                median = np.sort(column)[len(at) // 2]
                left = column < median if (column < median).any() else column <= median
                self.rows[node] = at[:0]
                self.kids[node] = (build(at[left]), build(at[~left]))
            return node

        build(np.arange(len(self.ids)))
        self.x, self.low, self.high, self.least = x, np.stack(low), np.stack(high), least

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Greatest inner product that each node's box allows, by query and node."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own: int, q: np.ndarray, bound: np.ndarray, k: int, kth: tuple[float, int] | None = None) -> list[tuple[float, int]]:
        """The k best (score, id), ids other than ``own``; only such as beat ``kth``."""
        best: list[tuple[float, int]] = []  # a heap of (score, -id), worst first
        worst = (kth[0], -kth[1]) if kth else None
        queue = [(-bound[0], self.least[0], 0)]
        while queue:
            top, least, node = heapq.heappop(queue)
            if worst and (-top, -least) <= worst:
                if -top < worst[0]:
                    break
                continue
            kids = self.kids[node]
            if kids:
                for kid in kids:
                    if not worst or (bound[kid], -self.least[kid]) > worst:
                        heapq.heappush(queue, (-bound[kid], self.least[kid], kid))
                continue
            rows = self.rows[node]
            scores = self.x[rows] @ q
            keep = self.ids[rows] != own
            if worst:
                keep &= scores >= worst[0]
            rows, scores = rows[keep], scores[keep]
            if len(rows) > k:  # rows are in order of id, so a stable sort breaks ties by it
                first = np.argsort(-scores, kind="stable")[:k]
                rows, scores = rows[first], scores[first]
            for r, s in zip(rows, scores, strict=True):
                item = (s, -int(self.ids[r]))
                if worst and item <= worst:
                    continue
                heapq.heappush(best, item)
                if len(best) > k:
                    heapq.heappop(best)
                if len(best) == k and (worst is None or best[0] > worst):
                    worst = best[0]
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def quantised(embedding: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component; null if one is null or not finite."""
    x = embedding.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * F.lit(scale)).cast("long")))


def cells(sample: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimension and value of each inner node of a full binary tree of at least ``n`` cells, in heap order."""
    depth = 0
    while 1 << depth < n and len(sample) >= SAMPLE_CELL << (depth + 1):
        depth += 1
    dims, at = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1, dtype=np.int64)
    held = {0: np.arange(len(sample))}
    for node in range(len(dims)):
        rows = held.pop(node)
        if len(rows):
            x = sample[rows]
            dims[node] = int((x.max(0) - x.min(0)).argmax())
            column = np.sort(x[:, dims[node]])
            above = column[column > column[0]]
            at[node] = column[len(column) // 2] if column[len(column) // 2] > column[0] else above[0] if len(above) else column[0]
        right = sample[rows, dims[node]] >= at[node] if len(rows) else np.zeros(0, dtype=bool)
        held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
    return dims, at


def cell_of(vectors: np.ndarray, dims: np.ndarray, at: np.ndarray) -> np.ndarray:
    node, rows = np.zeros(len(vectors), dtype=np.int64), np.arange(len(vectors))
    for _ in range(len(dims).bit_length()):
        node = 2 * node + 1 + (vectors[rows, dims[node]] >= at[node])
    return node - len(dims)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), dim)


def _pieces(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of equal columns."""
    values = [np.asarray(batch.column(c)) for c in columns]
    change = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for v in values:
        change |= np.diff(v) != 0
    cuts = [0, *(np.nonzero(change)[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            yield batch.slice(a, b - a)


FOUND = "query_id long, qkey long, vec_id long, score long, shard int, dim int, low array<long>, high array<long>"
_KINDS = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.int64())] * 2
_NAMES = ["query_id", "qkey", "vec_id", "score", "shard", "dim", "low", "high"]


def _search(k: int, boxes: bool):
    """Searches of sorted (shard, dim, kind) groups: a shard's rows come before its queries; with ``boxes`` a row of each root box too."""

    def numbers(x: np.ndarray, y: np.ndarray) -> type:
        """Doubles while every sum of products is exact in them."""
        big = lambda a: float(np.abs(a).max()) if a.size else 0.0
        return np.float64 if big(x) * big(y) * max(1, x.shape[1]) < 2**53 else np.int64

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, _KINDS, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts, tree, plain = None, [], None, None

        def ended() -> Iterator[pa.RecordBatch]:
            if boxes and group is not None and (parts or plain is not None):
                x = plain if plain is not None else np.concatenate([p[1] for p in parts])
                yield rows_of([(None, None, None, None, *group, x.min(0).tolist(), x.max(0).tolist())])

        for batch in batches:
            for piece in _pieces(batch, "shard", "dim", "kind"):
                now = (piece.column("shard")[0].as_py(), piece.column("dim")[0].as_py())
                if now != group:
                    yield from ended()
                    group, parts, tree, plain = now, [], None, None
                ids, vectors = np.asarray(piece.column("id")), _matrix(piece.column("q"), now[1])
                if piece.column("kind")[0].as_py() == 0:
                    parts.append((ids, vectors))
                    continue
                if not parts and tree is None:
                    continue
                if tree is None:
                    all_ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    tree, plain, parts = KDTree(all_ids, x), x, []
                as_type = numbers(plain, vectors)
                if tree.x.dtype != as_type:
                    tree.x, tree.low, tree.high = (t.astype(as_type) for t in (tree.x, tree.low, tree.high))
                bounds = tree.bounds(vectors.astype(as_type))
                out = []
                qkey, score, last = (piece.column(c).to_pylist() for c in ("qkey", "kth_score", "kth_id"))
                for i in range(len(ids)):
                    kth = None if score[i] is None else (score[i], last[i])
                    out += [(int(ids[i]), qkey[i], c, int(s), None, None, None, None) for s, c in tree.search(int(ids[i]), vectors[i].astype(as_type), bounds[i], k, kth)]
                yield rows_of(out)
        yield from ended()

    return run


def _dealt(rows: DataFrame, shard_rows: int) -> DataFrame:
    """The rows (id, q, dim) with their shard; shards of about ``shard_rows`` rows by place, stored."""
    spark = rows.sparkSession
    per_dim = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a dimension
    main = max(per_dim, key=lambda d: (per_dim[d], d), default=0)
    n = per_dim.get(main, 0)
    sample = rows.filter(F.col("dim") == main).select("q").sample(min(1.0, SAMPLE_ROWS / max(1, n)), seed=7).toArrow().column("q") if n and main else None  # about SAMPLE_ROWS rows
    x = np.asarray(sample.combine_chunks().flatten(), dtype=np.int64).reshape(len(sample), main) if sample is not None else np.zeros((0, 1), dtype=np.int64)
    tree = spark.sparkContext.broadcast(cells(x, -(-n // shard_rows)))  # at most SAMPLE_ROWS / SAMPLE_CELL cells

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, at = tree.value
        for batch in batches:
            for piece in _pieces(batch, "dim"):
                dim = piece.column("dim")[0].as_py()
                cell = cell_of(_matrix(piece.column("q"), dim), dims, at) if dim == main and dim else np.full(piece.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(cell, pa.int64())], [*piece.schema.names, "cell"])

    placed = durable(rows.mapInArrow(place, "id long, q array<long>, dim int, cell long"), "knn-cells")
    counts = sorted((r["cell"], r["n"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a cell
    base, shares = 0, []
    for cell, rows_there in counts:
        parts = -(-rows_there // shard_rows)
        shares.append((cell, base, parts))
        base += parts
    shares = F.broadcast(spark.createDataFrame(shares, "cell long, base int, parts int"))  # a row a cell
    shard = (F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    return placed.join(shares, "cell").select("id", "q", "dim", shard.alias("shard"))


def _open_shards(asked: DataFrame, boxes: DataFrame) -> DataFrame:
    """(id, qkey, q, dim, shard, bound) of the other shards whose box may beat a query's k-th best.

    ``asked`` has (id, qkey, q, dim, home, kth_score).  All queries are held against
    all boxes, a block of boxes at a time.
    """
    spark = asked.sparkSession
    held = boxes.select("shard", "dim", "low", "high").orderBy("dim", "shard").toLocalIterator()  # streamed, a block in memory at a time
    schema = "id long, qkey long, q array<long>, dim int, shard int, bound long"
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64()]
    out = None
    block: list[tuple] = []
    size = 0

    def against(some: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast({dim: tuple(np.array([b[c] for b in some if b[1] == dim], dtype=np.int64) for c in (0, 2, 3)) for dim in {b[1] for b in some}})

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in _pieces(batch, "dim"):
                    dim = piece.column("dim")[0].as_py()
                    if dim not in shared.value:
                        continue
                    shards, low, high = shared.value[dim]
                    x = _matrix(piece.column("q"), dim)
                    most = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T
                    kth = np.array([-(2**63) if v is None else v for v in piece.column("kth_score").to_pylist()], dtype=np.int64)
                    i, j = np.nonzero((most >= kth[:, None]) & (shards[None, :] != np.asarray(piece.column("home"))[:, None]))
                    if len(i):
                        picked = piece.take(pa.array(i))
                        yield pa.RecordBatch.from_arrays([*(picked.column(c).cast(t) for c, t in zip(("id", "qkey", "q", "dim"), kinds, strict=False)), pa.array(shards[j], pa.int32()), pa.array(most[i, j], pa.int64())], ["id", "qkey", "q", "dim", "shard", "bound"])

        return asked.select("id", "qkey", "q", "dim", "home", "kth_score").mapInArrow(bound, schema)

    for b in held:
        block.append((b["shard"], b["dim"], b["low"], b["high"]))
        size += 16 * max(1, b["dim"])
        if size >= BOX_BYTES:
            out = against(block) if out is None else out.unionByName(against(block))
            block, size = [], 0
    if block or out is None:
        out = against(block) if out is None else out.unionByName(against(block))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, scale: float = SCALE, shard_rows: int = SHARD_ROWS, first_round: int = ROUND) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that satisfies ``is_query`` its k best other rows."""
    spark = vectors.sparkSession
    rows = need(vectors, id="vec_id:long", embedding="array<double>")
    rows = rows.filter("id IS NOT NULL").select("id", quantised(F.col("embedding"), scale).alias("q")).filter("q IS NOT NULL")
    rows = durable(_dealt(rows.withColumn("dim", F.size("q")), shard_rows), "knn-rows")
    shards = max(1, (rows.agg(F.max("shard")).first()[0] or 0) + 1)
    queries = rows.filter(is_query).dropDuplicates(["id", "q"]).withColumn("qkey", F.xxhash64("q"))
    none = F.lit(None).cast("long")
    stored = rows.select("shard", "dim", F.lit(0).alias("kind"), "id", "q", none.alias("qkey"), none.alias("kth_score"), none.alias("kth_id"))
    best = Window.partitionBy("query_id", "qkey").orderBy(F.col("score").desc(), F.col("vec_id").asc())

    def searched(asked: DataFrame, boxes: bool) -> DataFrame:
        asked = asked.select("shard", "dim", F.lit(1).alias("kind"), "id", "q", "qkey", "kth_score", "kth_id")
        # Only shards that are asked are read into trees again.
        there = stored if boxes else stored.join(F.broadcast(asked.select("shard").distinct()), "shard", "left_semi").select(*stored.columns)  # a row a shard
        dealt = there.unionByName(asked).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "dim", "kind")
        return dealt.mapInArrow(_search(k, boxes), FOUND)

    def kept(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "qkey", "vec_id", "score", "rank")

    def with_worst(asked: DataFrame, found: DataFrame) -> DataFrame:
        """The k-th best of each query so far, null with fewer."""
        last = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "qkey", F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))
        return asked.join(last, ["id", "qkey"], "left")

    home = durable(searched(queries.withColumn("kth_score", none).withColumn("kth_id", none), True), "knn-home")
    found = durable(kept(home.filter("shard IS NULL").select("query_id", "qkey", "vec_id", "score")), "knn-found")
    asked = with_worst(queries.select("id", "qkey", "q", "dim", F.col("shard").alias("home")), found)
    left = durable(_open_shards(asked, home.filter("shard IS NOT NULL")), "knn-open") if shards > 1 else None
    take = first_round
    while left is not None and left.limit(1).count():
        turn = F.row_number().over(Window.partitionBy("id", "qkey").orderBy(F.col("bound").desc(), "shard"))
        left = durable(with_worst(left, found).withColumn("turn", turn), "knn-turn")
        more = searched(left.filter(F.col("turn") <= take), False).select("query_id", "qkey", "vec_id", "score")
        found = durable(kept(found.drop("rank").unionByName(more)), "knn-found")
        rest = with_worst(left.filter(F.col("turn") > take).drop("turn", "kth_score", "kth_id"), found)
        left = durable(rest.filter("kth_score IS NULL OR bound >= kth_score").drop("kth_score", "kth_id"), "knn-open")
        take *= ROUND
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
