"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample of the different vectors: a node splits its sample at the median of the projection on the
difference of two random members. Every different vector is filed in one leaf of each tree. A query keeps one
priority queue for all trees, takes the branch whose cutting planes lie nearest to it again and again, and
stops after a share of the members. That share is measured: for some members of the sample, how far their queues must go to
meet most (TARGET) of their true neighbours there; clustered vectors need little, shapeless ones much. A leaf's members
are compared with the queries that visit it where the leaf lies; each task passes on a query's best few, and those
are measured exactly, in double precision.

Equal vectors are one member with its smallest ids, as many as an answer can hold, so a group of equal vectors of any
size costs one comparison and loses no answer.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids and vectors
of another length than most; repeated rows count once; ties go to the smaller id; fewer candidates give fewer rows.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import checkpointed

#: Trees; vectors of the sample that grows them, about; members of a leaf, about; recall that the measured share aims at; members of the sample that measure it.
TREES, SAMPLE, LEAF, TARGET, PROBES = 8, 20_000, 256, 0.97, 60
#: Comparisons that a task holds before it keeps each query's best again.
HELD = 1 << 19


class Tree:
    """Arrays of nodes; children below 0 are leaves: -1 - number of the leaf."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int):
        random = np.random.default_rng(seed)
        normals, cuts, children = [], [], []
        self.leaves = 0
        todo = [(np.arange(len(sample)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            sides = self._split(sample, rows, random) if len(rows) > leaf else None
            if sides is None:
                number = -1 - self.leaves
                self.leaves += 1
            else:
                normal, cut, low = sides
                number = len(cuts)
                normals.append(normal)
                cuts.append(cut)
                children.append([0, 0])
                todo += [(rows[low], number, 0), (rows[~low], number, 1)]
            if parent is not None:
                children[parent][side] = number
        self.normals, self.cuts = np.array(normals, np.float32).reshape(len(cuts), sample.shape[1]), np.array(cuts, np.float32)
        self.children = np.array(children, np.int64).reshape(-1, 2)
        self.root = 0 if cuts else -1

    @staticmethod
    def _split(sample, rows, random):
        for _ in range(5):
            a, b = sample[random.choice(rows, 2, replace=False)]
            normal = a - b
            length = np.linalg.norm(normal)
            if length > 0:
                normal = normal / length
                at = sample[rows] @ normal
                cut = float(np.median(at))
                low = at < cut
                if 0 < low.sum() < len(rows):
                    return normal, cut, low
        return None

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        node = np.full(len(vectors), self.root)
        while (open_ := np.flatnonzero(node >= 0)).size:
            at = node[open_]
            side = np.einsum("ij,ij->i", vectors[open_], self.normals[at]) >= self.cuts[at]
            node[open_] = self.children[at, side.astype(np.int64)]
        return -1 - node


def usable(vectors: Column) -> Column:
    """Not null, not empty, finite, not zero."""
    bad = F.exists(vectors, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vectors) > 0) & ~bad & F.exists(vectors, lambda x: x != 0), F.lit(False))


def prepare(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, key, vec): the rows that take part, once each; key names equal vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vec")))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if sizes:
        rows = rows.where(F.size("vec") == sizes[0]["n"])
    return rows.select("id", F.xxhash64("vec").alias("key"), "vec")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(key, vec, ids): different vectors with their k + 1 smallest ids; each task passes on that many of a vector at most."""
    order = Window.partitionBy("key").orderBy("id")
    few = rows.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k + 1)
    return few.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_set("id")).alias("ids"))


def sampled(members: DataFrame, sample: int) -> tuple[np.ndarray, int]:
    """About `sample` members as a matrix, and the number of all."""
    total = members.count()
    share = int(1e6 * min(1.0, sample / max(1, total))) + 1
    rows = members.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1_000_000)) < share).select("key", "vec").toPandas().sort_values("key")
    return (np.stack(rows["vec"].to_list()) if len(rows) else np.zeros((0, 1))).astype(np.float32), total


def visits(forest: list[Tree], sizes: list[np.ndarray], x: np.ndarray):
    """(tree, leaf) in the order in which one queue for all trees meets them."""
    queue = [(-np.inf, t, tree.root) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    while queue:
        near, t, node = heapq.heappop(queue)
        if node < 0:
            if sizes[t][-1 - node]:
                yield t, -1 - node
            continue
        tree = forest[t]
        margin = float(x @ tree.normals[node] - tree.cuts[node])
        side = int(margin >= 0)
        heapq.heappush(queue, (near, t, int(tree.children[node, side])))
        heapq.heappush(queue, (max(near, abs(margin)), t, int(tree.children[node, 1 - side])))


def measured_share(forest: list[Tree], sample: np.ndarray, k: int, target: float = TARGET, probes: int = PROBES) -> float:
    """How many members, repeats in other trees included, a queue must meet for each member of the sample to find the target share of true neighbours."""
    leaves = [t.leaf_of(sample) for t in forest]
    sizes = [np.bincount(leaf, minlength=t.leaves) for leaf, t in zip(leaves, forest)]
    needed = []
    for q in np.linspace(0, len(sample) - 1, min(probes, len(sample))).astype(int):
        away = ((sample - sample[q]) ** 2).sum(axis=1)
        away[q] = np.inf
        true = np.argsort(away)[: min(k, len(sample) - 1)]
        where = {(t, int(leaf[n])) for t, leaf in enumerate(leaves) for n in true}
        left, met = set(true.tolist()), 0
        for t, leaf in visits(forest, sizes, sample[q]):
            met += int(sizes[t][leaf])
            if (t, leaf) in where:
                for n in [n for n in left if leaves[t][n] == leaf]:
                    left.discard(n)
                    needed.append(met / len(sample))
            if not left:
                break
    return float(np.quantile(needed, target)) if needed else 1.0


def _best(query: np.ndarray, key: np.ndarray, away: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's `keep` nearest different members."""
    order = np.lexsort((key, query))
    query, key, away = query[order], key[order], away[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (key[1:] != key[:-1])
    query, key, away = query[new], key[new], away[new]
    order = np.lexsort((key, away, query))
    query, key, away = query[order], key[order], away[order]
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(query)]])))
    return query[place < keep], key[place < keep], away[place < keep]


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1).astype(np.float64)


def compared(keep: int):
    """For rows (tree, leaf, kind, key, vec) sorted by these, a leaf's queries (kind 0) before its members (kind 1): (query, key, away) of each query's best few in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, keys, asked = None, np.zeros(0, np.int64), np.zeros((0, 0))
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tree", "leaf", "kind")], axis=1)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
            key, x = batch.column("key").to_numpy(), _vectors(batch.column("vec"))
            for a, b in zip(edges, edges[1:]):
                here = tuple(place[a, :2])
                if place[a, 2] == 0:
                    keys, asked = (np.concatenate([keys, key[a:b]]), np.concatenate([asked, x[a:b]])) if here == leaf else (key[a:b], x[a:b])
                    leaf = here
                elif here == leaf:
                    for k in range(0, len(keys), 1024):
                        some = asked[k : k + 1024]
                        away = (some**2).sum(axis=1)[:, None] + (x[a:b] ** 2).sum(axis=1) - 2 * some @ x[a:b].T
                        least = min(keep, b - a)
                        at = np.argpartition(away, least - 1, axis=1)[:, :least]
                        found[0].append(np.repeat(keys[k : k + 1024], least))
                        found[1].append(key[a:b][at].ravel())
                        found[2].append(np.take_along_axis(away, at, axis=1).ravel())
                        rows += at.size
                        if rows > HELD:
                            found = [[c] for c in _best(*map(np.concatenate, found), keep)]
                            rows = len(found[0][0])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(*map(np.concatenate, found), keep)], names=["query", "key", "away"])

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, share: float | None = None) -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest found, by Euclidean distance.

    is_query: a condition on column id. share: of the members that a queue meets (repeats in other trees included); measured if not given.
    """
    rows = prepare(vectors, id_col, vector_col)
    members = checkpointed(classes(rows, k))
    taken, total = sampled(members, sample)
    forest = [Tree(taken, max(2, round(leaf * len(taken) / total)), seed) for seed in range(trees)] if len(taken) else []
    most = (measured_share(forest, taken, k) if share is None else share) * total
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast(forest)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column("vec").to_numpy(zero_copy_only=False)).astype(np.float32)
                raw = pa.array([v.tobytes() for v in x], pa.binary())
                for t, tree in enumerate(shared.value):
                    n = len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(tree.leaf_of(x)), pa.array(np.ones(n, np.int32)), batch.column("key"), raw], names=["tree", "leaf", "kind", "key", "vec"])

    filed = members.select("key", "vec").mapInArrow(file, "tree int, leaf bigint, kind int, key bigint, vec binary")
    filled = {(r["tree"], r["leaf"]): r["count"] for r in filed.groupBy("tree", "leaf").count().collect()}
    sizes = context.broadcast([np.array([filled.get((t, n), 0) for n in range(tree.leaves)], np.int64) for t, tree in enumerate(forest)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            x = np.stack(batch.column("vec").to_numpy(zero_copy_only=False)).astype(np.float32)
            for key, v in zip(batch.column("key").to_pylist(), x):
                met, raw = 0, v.tobytes()
                for t, n in visits(shared.value, sizes.value, v):
                    out.append((t, n, 0, key, raw))
                    met += int(sizes.value[t][n])
                    if met >= max(most, 2 * k):
                        break
                if len(out) > 20_000:
                    yield _visit_rows(out)
                    out = []
            yield _visit_rows(out)

    asked = checkpointed(rows.where(is_query).select("id", "key", "vec").dropDuplicates(["id", "key"]))
    visited = asked.select("key", "vec").dropDuplicates(["key"]).mapInArrow(walk, "tree int, leaf bigint, kind int, key bigint, vec binary")
    dealt = filed.unionByName(visited).repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "kind")
    near = dealt.mapInArrow(compared(2 * k + 2), "query bigint, key bigint, away double")
    nearest = near.groupBy("query", "key").agg(F.min("away").alias("away"))
    first = Window.partitionBy("query").orderBy("away", "key")
    pairs = nearest.withColumn("place", F.row_number().over(first)).where(F.col("place") <= 2 * k + 2).select("query", "key")

    found = pairs.join(members.select("key", "vec", "ids"), "key").select("query", "ids", F.col("vec").alias("other"))
    queries = asked.select(F.col("key").alias("query"), F.col("id").alias("query_id"), "vec")
    squares = F.zip_with("vec", "other", lambda a, b: (a - b) * (a - b))
    scored = found.join(queries, "query").select("query_id", "ids", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("score"))
    single = scored.select("query_id", "score", F.explode("ids").alias("id")).where("id != query_id")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _visit_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], [], []]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["tree", "leaf", "kind", "key", "vec"])
