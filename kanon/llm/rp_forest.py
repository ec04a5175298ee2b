"""Nearest neighbours by a forest of random-projection trees with one shared priority queue (operator 13).

Nearness is the largest inner product. Vectors are scaled by the largest norm M and get one more component
``sqrt(1 - |x|^2 / M^2)``, queries are scaled to length 1 and get 0 there; then the nearest vector by distance is the one
with the largest inner product, and distances can be split by hyperplanes.

1. Exact copies of a vector are one node, named by the smallest id; of its ids only the ``k + 1`` smallest are kept
   (no query can return more of them), so a vector that a third of all rows share is one row from here on.
2. Trees are fitted on at most ``fit_rows`` nodes (by hash of the id, the bounded sample): each level splits at the median along one direction
   of a random orthogonal basis of the tree. Below the fitted leaves every row counts: a leaf that
   holds more than ``leaf_rows`` of all nodes is split further by as many directions through its centre as its count asks
   for, so bins keep their size however many rows there are.
3. Every node is put into one bin of each tree.
4. Search: one priority queue over the nodes of all trees, ordered by the sum of squared distances to the planes that were
   crossed (directions of a tree are orthogonal, so this bounds the distance). Each query opens ``budget``
   bins. The budget is measured: ``calibration`` queries are compared with all rows, and the smallest budget is taken
   that finds ``recall`` of their true neighbours. So it follows the data: few bins where vectors lie in
   groups, many where they fill the space evenly (then no index helps much, and the figures show it).
5. Rerank: queries meet the vectors of an opened bin (a bin that no plane can split is dealt over salts), all
   inner products are computed, and each task hands on the best of each query over its bins. The first bins of each query
   go first: the last of the best that they give is a floor, below which nothing of the other bins is
   handed on. What is returned is computed from the original vectors in
   double precision, one component after the other.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id and
vectors of another length than most; of several vectors of one id the least speaks for it, equal rows count once; with
fewer candidates than ``k`` all are returned; ties go to the smaller id; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from kanon.llm.common import written

#: Nodes beyond k that go on to the exact rerank, so that rounding in the matrix product cannot matter.
SPARE = 4
MAX_BITS = 24
#: Share (one in so many) of a query's bins that give its floor.
HEAD = 8
#: Hits that a task holds before it hands them on.
HELD = 1 << 20


@dataclass
class Tree:
    """Inner nodes are 0, 1, ...; a child below 0 is the leaf ``-1 - child``."""

    planes: np.ndarray  # (inner, d)
    cuts: np.ndarray
    children: np.ndarray  # (inner, 2)
    centres: np.ndarray  # (leaves, d)
    basis: np.ndarray  # (d, d), directions below the leaves
    bits: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # of each leaf

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Fitted leaf of each row of ``x``."""
        at = np.zeros(len(x), np.int64) if len(self.planes) else np.full(len(x), -1)
        while (inner := at >= 0).any():
            rows, node = np.flatnonzero(inner), at[inner]
            right = np.einsum("ij,ij->i", x[rows], self.planes[node]) >= self.cuts[node]
            at[rows] = self.children[node, right.astype(int)]
        return -1 - at

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Leaf and the bits below it as one number."""
        leaf = self.leaves(x)
        side = (x - self.centres[leaf]) @ self.basis.T >= 0
        path = np.zeros(len(x), np.int64)
        for j in range(int(self.bits.max(initial=0))):
            more = self.bits[leaf] > j
            path = np.where(more, path * 2 + side[:, j], path)
        return leaf << MAX_BITS | path


def fit_tree(x: np.ndarray, leaf_rows: int, seed: int) -> Tree:
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    basis = np.linalg.qr(rng.normal(size=(d, d)))[0].T
    below = np.linalg.qr(rng.normal(size=(d, d)))[0].T
    planes, cuts, children, centres = [], [], [], []

    def grow(rows: np.ndarray, depth: int) -> int:
        if len(rows) > leaf_rows:
            for step in range(d):  # a direction along which these rows differ
                along = x[rows] @ basis[(depth + step) % d]
                cut = float(np.median(along))
                right = along >= cut
                if 0 < right.sum() < len(rows):
                    me = len(planes)
                    planes.append(basis[(depth + step) % d])
                    cuts.append(cut)
                    children.append([0, 0])
                    children[me] = [grow(rows[~right], depth + step + 1), grow(rows[right], depth + step + 1)]
                    return me
        centres.append(x[rows].mean(axis=0) if len(rows) else np.zeros(d))
        return -len(centres)

    grow(np.arange(len(x)), 0)
    return Tree(np.array(planes).reshape(-1, d), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), np.array(centres), below)


class Forest:
    """The trees and the search order of a query."""

    def __init__(self, trees: list[Tree], scale: float) -> None:
        self.trees, self.scale = trees, scale

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with their extra component."""
        x = x / self.scale
        return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", x, x)))])

    def bins(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): bin of each row in each tree, the tree in the highest bits."""
        x = self.lifted(x)
        return np.column_stack([t.bins(x) | k << 56 for k, t in enumerate(self.trees)])

    def opened(self, q: np.ndarray) -> Iterator[int]:
        """Bins in the order in which the shared queue gives them out."""
        q = np.append(q / np.sqrt(q @ q), 0.0)
        margin = [(t.planes @ q - t.cuts).tolist() for t in self.trees]
        along = [t.basis @ q for t in self.trees]
        heap: list[tuple[float, int, int, int, int]] = [(0.0, k, 0 if len(t.planes) else -1, 0, 0) for k, t in enumerate(self.trees)]
        while heap:
            cost, k, node, depth, path = heapq.heappop(heap)
            tree = self.trees[k]
            while node >= 0:
                m = margin[k][node]
                near, far = (1, 0) if m >= 0 else (0, 1)
                heapq.heappush(heap, (cost + m * m, k, int(tree.children[node, far]), 0, 0))
                node = int(tree.children[node, near])
            leaf = -1 - node
            bits = int(tree.bits[leaf])
            if depth < bits:
                sides = (along[k][depth:bits] - tree.basis[depth:bits] @ tree.centres[leaf]).tolist()
                for m in sides:
                    bit = int(m >= 0)
                    depth += 1
                    heapq.heappush(heap, (cost + m * m, k, node, depth, path * 2 + 1 - bit))
                    path = path * 2 + bit
            yield k << 56 | leaf << MAX_BITS | path


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _valid(df: DataFrame) -> DataFrame:
    """(vec_id, v): one vector of doubles per id, of the length that most have."""
    v = F.col("embedding").cast("array<double>")
    fine = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = df.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("v is not null").where(fine)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (size[0]["d"] if size else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


def _best_of(scores: np.ndarray, keep: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places of the ``keep`` largest of each row of ``scores``, all that tie with the last one included, as far
    as they reach the row's floor."""
    n = scores.shape[1]
    edge = floor if n <= keep else np.maximum(floor, np.partition(scores, n - keep, axis=1)[:, n - keep])
    return np.nonzero(scores >= edge[:, None])


HIT = StructType([StructField("q", LongType()), StructField("node", LongType()), StructField("score", DoubleType())])


def _hits(q: np.ndarray, node: np.ndarray, scores: np.ndarray, keep: int, floor: np.ndarray | None = None) -> pa.Table:
    scores = np.round(scores, 12)
    a, b = _best_of(scores, keep, np.full(len(q), -np.inf) if floor is None else floor)
    return pa.table({"q": q[a], "node": node[b], "score": scores[a, b]})


def _scored(batches: Iterator[pa.RecordBatch], keep: int, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Inner products within every bin. Rows come sorted by (bin, salt), vectors before queries; a bin's vectors are held while
    its queries pass, and the best of each query are gathered over all bins of the task before they go on."""
    at: tuple[int, int] | None = None
    vectors: list[np.ndarray] = []
    nodes: list[np.ndarray] = []
    parts: list[pa.Table] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        key = [b.column(c).to_numpy() for c in ("bin", "salt", "asks")]
        node, v, floor = b.column("node").to_numpy(), _matrix(b.column("v")), b.column("floor").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        for run in np.split(np.arange(b.num_rows), cuts):
            here = int(key[0][run[0]]), int(key[1][run[0]])
            if here != at:
                at, vectors, nodes = here, [], []
            if not key[2][run[0]]:
                vectors.append(v[run])
                nodes.append(node[run])
                continue
            if not vectors:
                continue
            if len(vectors) > 1:
                vectors, nodes = [np.concatenate(vectors)], [np.concatenate(nodes)]
            for k in range(0, len(run), 512):
                some = run[k : k + 512]
                parts.append(_hits(node[some], nodes[0], v[some] @ vectors[0].T, keep, floor[some]))
                size += parts[-1].num_rows
            if size > held:
                table = _compact(parts, keep)
                if table.num_rows > held // 2:
                    yield from table.to_batches()
                    table = table.slice(0, 0)
                parts, size = [table], table.num_rows
    if parts:
        yield from _compact(parts, keep).to_batches()


def _compact(parts: list[pa.Table], keep: int) -> pa.Table:
    """The ``keep`` best nodes of each query, each once."""
    table = pa.concat_tables(parts)
    q, node, score = (table.column(c).to_numpy() for c in ("q", "node", "score"))
    order = np.lexsort((node, -score, q))
    q, node, score = q[order], node[order], score[order]
    once = np.append(True, (q[1:] != q[:-1]) | (node[1:] != node[:-1]))[: len(q)]
    q, node, score = q[once], node[once], score[once]
    first = np.append(True, q[1:] != q[:-1])[: len(q)]
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    top = place < keep
    return pa.table({"q": q[top], "node": node[top], "score": score[top]})


def _leading(hits: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nodes of each query with the largest scores; a node that several trees found counts once."""
    place = F.dense_rank().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))
    return hits.withColumn("place", place).where(F.col("place") <= keep).groupBy("q", "node").agg(F.max("score").alias("score"))


def nearest(
    embeddings: DataFrame, k: int = 20, queries: Column | None = None, trees: int = 4, leaf_rows: int = 256, fit_rows: int = 1 << 15,
    calibration: int = 64, recall: float = 0.96, seed: int = 42, budget: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of every row for which ``queries`` holds (all if None)."""
    spark = embeddings.sparkSession
    rows = written(_valid(embeddings), "vectors")
    order = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = written(rows.withColumn("n", order).where(F.col("n") <= k + 1).groupBy("v").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    asked = rows if queries is None else rows.where(queries)
    # Each query's node; equal queries are searched once.
    of_query = written(asked.join(nodes.select("v", "node"), "v").select("vec_id", "node"), "queries")
    searched = written(of_query.select("node").distinct().join(nodes.select("node", "v"), "node"), "searched")

    n, norm = nodes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = _fitted(nodes, n, float(norm) ** 0.5, trees, leaf_rows, fit_rows, seed)
    shared = spark.sparkContext.broadcast(forest)  # at most trees * fit_rows / leaf_rows * 2 planes
    keep = k + 1 + SPARE
    if budget is None:
        budget = _calibrated(nodes, searched, shared, keep, calibration, recall)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins = shared.value.bins(_matrix(b.column("v")))
                t = bins.shape[1]
                at = np.repeat(np.arange(b.num_rows), t)
                yield pa.RecordBatch.from_arrays([pa.array(bins.ravel()), b.column("node").take(pa.array(at)), b.column("v").take(pa.array(at))], names=["bin", "node", "v"])

    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                bins = [[x for x, _ in zip(shared.value.opened(q), range(budget), strict=False)] for q in _matrix(part.column("v"))]
                row = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in bins]))
                turn = pa.array([i for y in bins for i in range(len(y))], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([x for y in bins for x in y], pa.int64()), part.column("node").take(row), turn], names=["bin", "node", "turn"])

    index = written(nodes.select("node", "v").mapInArrow(binned, "bin long, node long, v array<double>"), "bins")
    # The queue is walked once; the vectors of the queries are added where they are used.
    wanted = written(searched.mapInArrow(sought, "bin long, node long, turn int"), "opened").join(searched, "node")
    # A bin that no plane splits is dealt over salts; its queries go to each of them.
    hot = index.groupBy("bin").count().where(F.col("count") > 8 * leaf_rows).select("bin", F.ceil(F.col("count") / (4 * leaf_rows)).cast("int").alias("salts"))
    index = index.join(hot, "bin", "left").withColumn("salt", F.coalesce(F.pmod(F.hash("node"), F.col("salts")), F.lit(0))).drop("salts")
    wanted = wanted.join(hot, "bin", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")

    def met(asked: DataFrame) -> DataFrame:
        """Hits of ``asked`` (with ``floor``) in the bins that they open."""
        rows = index.withColumn("asks", F.lit(0)).withColumn("floor", F.lit(None).cast("double")).unionByName(asked.withColumn("asks", F.lit(1)))
        rows = rows.repartition("bin", "salt").sortWithinPartitions("bin", "salt", "asks").select("bin", "salt", "asks", "node", "v", "floor")
        return rows.mapInArrow(lambda batches: _scored(batches, keep), HIT)

    head = max(1, budget // HEAD)
    none = F.lit(float("-inf"))
    best = written(_leading(met(wanted.where(F.col("turn") < head).drop("turn").withColumn("floor", none)), keep), "first")
    if budget > head:
        floor = best.groupBy("q").agg(F.when(F.count("*") >= keep, F.min("score")).otherwise(none).alias("floor"))
        rest = wanted.where(F.col("turn") >= head).drop("turn").join(floor, F.col("node") == F.col("q"), "left").drop("q")
        best = written(_leading(best.unionByName(met(rest.withColumn("floor", F.coalesce("floor", none)))), keep), "leading")

    # Exact measure on the original vectors, then the ids behind each node in the order of the result.
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
    found = best.join(nodes, "node").join(searched.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q").select("q", dot.alias("score"), F.explode("ids").alias("vec_id"))
    ranked = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score"))), 1, k + 1).alias("near"))
    mine = of_query.withColumnRenamed("vec_id", "query_id").join(ranked, F.col("node") == F.col("q"))
    near = F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    return mine.select("query_id", F.posexplode(near).alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _fitted(nodes: DataFrame, n: int, scale: float, trees: int, leaf_rows: int, fit_rows: int, seed: int) -> Forest:
    """Trees on the sample; then every leaf's count over all nodes says how many directions split it further."""
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 20))
    some = nodes if n <= fit_rows else nodes.where(spread < int((1 << 20) * min(1.0, 1.1 * fit_rows / n) + 1))
    sample = some.select("v").orderBy(F.xxhash64("node"), "node").limit(fit_rows)
    forest = Forest([], scale)
    x = forest.lifted(_matrix(sample.toArrow().column("v").combine_chunks()))
    forest.trees = [fit_tree(x, leaf_rows, seed + t) for t in range(trees)]
    for t in forest.trees:
        t.bits = np.zeros(len(t.centres), np.int64)
    shared = nodes.sparkSession.sparkContext.broadcast(forest)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            if b.num_rows:
                for bin_, m in zip(*np.unique(shared.value.bins(_matrix(b.column("v"))), return_counts=True), strict=True):
                    total[int(bin_)] = total.get(int(bin_), 0) + int(m)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["bin", "n"])

    for r in nodes.select("v").mapInArrow(counted, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a row per fitted leaf
        tree = forest.trees[r["bin"] >> 56]
        more = max(0, (-(-r["n"] // leaf_rows) - 1).bit_length())
        tree.bits[(r["bin"] >> MAX_BITS) & 0xFFFFFFFF] = min(more, MAX_BITS, x.shape[1])
    return forest


def _calibrated(nodes: DataFrame, searched: DataFrame, shared, keep: int, calibration: int, recall: float) -> int:
    """Bins that a query must open so that ``recall`` of the true neighbours of the calibration queries are in them."""
    probes = searched.orderBy(F.xxhash64("node"), "node").limit(calibration).collect()
    if not probes:
        return 1
    ids = np.array([r["node"] for r in probes], np.int64)
    vectors = np.array([r["v"] for r in probes], np.float64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                node = b.column("node").to_numpy()
                scores = vectors @ _matrix(b.column("v")).T
                scores[ids[:, None] == node[None, :]] = -np.inf
                yield from _hits(ids, node, scores, keep).to_batches()

    true = _leading(nodes.select("node", "v").mapInArrow(exact, HIT).where("score > double('-infinity')"), keep - 1 - SPARE)
    rows = true.join(nodes.select("node", "v"), "node").select("q", "v").collect()  # calibration * k rows
    want: dict[int, list[list[float]]] = {}
    for r in rows:
        want.setdefault(r["q"], []).append(r["v"])
    places: list[int] = []
    for q, v in zip(ids.tolist(), vectors, strict=True):
        if q in want:
            at = {b: i for i, b in enumerate(shared.value.opened(v), 1)}
            places += np.vectorize(at.__getitem__)(shared.value.bins(np.array(want[q]))).min(axis=1).tolist()
    places.sort()
    return places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)] if places else 1
