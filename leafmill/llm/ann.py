"""Approximate nearest neighbours by vantage-point trees, one per shard.

On unit vectors the Euclidean distance orders as the cosine does and obeys the
triangle inequality. A tree node splits its vectors at the median distance mu
from a vantage point; a query at distance d from it, whose k-th best distance
so far is tau, can skip the inner part if d - f tau > mu and the outer part if
d + f tau < mu. With f = 1 nothing that could be nearer is skipped, so the
search is exact; a smaller f skips more. Queries of a block walk a tree
together, one matrix product for each node.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import common

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 512, 256
#: Rounding of a cosine of unit vectors, and of a small distance made of one.
TIE, NEAR = 1e-12, 1e-6


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither vanish nor overflow."""
    if not len(raw):
        return raw
    out = raw / np.abs(raw).max(axis=1, keepdims=True)
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


def usable(vector: str) -> Column:
    """Not null, not empty, all components finite numbers, not all zero."""
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


class Tree:
    """Flat arrays of a tree over distinct vectors, in leaf order."""

    def __init__(self, unit: np.ndarray, raw: np.ndarray, ids: np.ndarray, id_rows: np.ndarray, nodes: np.ndarray, mu: np.ndarray):
        self.unit, self.raw, self.ids, self.id_rows, self.nodes, self.mu = unit, raw, ids, id_rows, nodes, mu

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        """Equal vectors are one entry with all their ids, ascending; nodes are
        (first row, end row, inner child, outer child), the vantage point being
        the first row of a node that isn't a leaf."""
        vectors = np.ascontiguousarray(vectors, dtype=np.float64) + 0.0
        _, first, entry = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        entry = entry.ravel()
        raw = vectors[first]
        unit = unit_rows(raw)
        order = np.arange(len(raw))
        nodes: list[list[int]] = []
        mus: list[float] = []
        stack = [(0, len(raw), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = me
            nodes.append([lo, hi, -1, -1])
            mus.append(0.0)
            if hi - lo <= leaf:
                continue
            rows = order[lo:hi]
            far = unit[rows] @ unit[rows[(hi - lo) // 2]]
            pick = int(np.argmin(far))  # a vantage point at the edge splits best
            rows[[0, pick]] = rows[[pick, 0]]
            d = distance(unit[rows[1:]] @ unit[rows[0]])
            by = np.argsort(d, kind="stable")
            rows[1:] = rows[1:][by]
            half = (hi - lo - 1) // 2
            mus[me] = float(d[by[half]])
            stack += [(lo + 1 + half, hi, me, 1), (lo + 1, lo + 1 + half, me, 0)]
        place = np.empty(len(raw), dtype=np.int64)
        place[order] = np.arange(len(raw))
        owner = place[entry]
        by = np.lexsort((ids, owner))
        id_rows = np.searchsorted(owner[by], np.arange(len(raw) + 1))
        return cls(unit[order], raw[order], ids[by], id_rows, np.array(nodes, dtype=np.int64), np.array(mus))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, raw=self.raw, ids=self.ids, id_rows=self.id_rows, nodes=self.nodes, mu=self.mu)
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> Tree:
        z = np.load(io.BytesIO(blob))
        return cls(unit_rows(z["raw"]), *(z[c] for c in ("raw", "ids", "id_rows", "nodes", "mu")))

    def walk(self, queries: np.ndarray, reach, visit) -> None:
        """Show each leaf and vantage point to the queries that can't skip it:
        ``visit(who, low, high, cosines)``; ``reach(who)`` is how far around a
        query one must look, as it is known by then."""
        stack: list[tuple[int, np.ndarray, np.ndarray, int, int]] = [(0, np.arange(len(queries)), np.zeros(len(queries)), -1, 0)]
        while stack:
            node, who, d, parent, side = stack.pop()
            if parent >= 0:  # decided late, with the bounds as they are now
                near = reach(who)
                who = who[d - near <= self.mu[parent]] if side == 0 else who[d + near >= self.mu[parent]]
            if not len(who):
                continue
            lo, hi, inner, outer = self.nodes[node]
            if inner < 0:
                if hi > lo:
                    visit(who, lo, hi, queries[who] @ self.unit[lo:hi].T)
                continue
            sims = queries[who] @ self.unit[lo]
            visit(who, lo, lo + 1, sims[:, None])
            d = distance(sims)
            stack += [(outer, who, d, node, 1), (inner, who, d, node, 0)]

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) for the k best distinct vectors of each unit query and
        all that tie with the last of them within rounding."""
        n = len(queries)
        tau = np.full(n, 2.0)
        best = np.full((n, k), -np.inf)

        def offer(who: np.ndarray, lo: int, hi: int, sims: np.ndarray) -> None:
            s = np.concatenate([best[who], sims], axis=1)
            best[who] = -np.partition(-s, k - 1, axis=1)[:, :k]
            tau[who] = np.minimum(tau[who], distance(best[who].min(axis=1)))

        # A dive to each query's own leaf gives a first bound on its k-th distance.
        at = np.zeros(n, dtype=np.int64)
        while True:
            inner = self.nodes[at, 2]
            live = np.flatnonzero(inner >= 0)
            if not len(live):
                break
            node = at[live]
            d = distance((queries[live] * self.unit[self.nodes[node, 0]]).sum(axis=1))
            at[live] = np.where(d < self.mu[node], inner[live], self.nodes[node, 3])
        for leaf in np.unique(at):
            who = np.flatnonzero(at == leaf)
            lo, hi = self.nodes[leaf, :2]
            if hi - lo >= k:
                sims = queries[who] @ self.unit[lo:hi].T
                tau[who] = np.minimum(tau[who], distance(-np.partition(-sims, k - 1, axis=1)[:, k - 1]))
        self.walk(queries, lambda who: factor * tau[who] + NEAR, offer)
        # A second walk, within the final bounds, gathers what is good enough.
        least = best.min(axis=1) - TIE
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def gather(who: np.ndarray, lo: int, hi: int, sims: np.ndarray) -> None:
            q, row = np.nonzero(sims >= least[who][:, None])
            found.append((who[q], row + lo))

        self.walk(queries, lambda who: factor * tau[who] + NEAR, gather)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (at[:0], at[:0])


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of paired rows in double precision, summed in one fixed order."""
    dot = (a * b).sum(axis=1)
    return dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks or [pa.array([], pa.list_(pa.float64()))])
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 0.5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query.

    Every usable row is indexed; rows and queries with null ids, or with null,
    empty, zero or non-finite vectors, take no part, and only vectors of one
    dimension meet. A row of the query's own id is no candidate. Scores are
    cosines of the original vectors in double precision; ties go to smaller
    ids. Fewer candidates than k: all of them. Repeated rows count as often as
    they occur; a query id with several vectors is asked with each of them, and
    equal query rows once. Other columns are ignored; an empty table gives no
    rows. Rows go to shards by id and vector, after equal ones are counted, so
    neither a frequent id nor a frequent vector makes a shard of its own.
    """
    def rows(table: DataFrame) -> DataFrame:
        kept = table.where(F.col(id_col).isNotNull() & usable(vector_col))
        return kept.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))

    # Of equal rows no more than k can be among the k nearest.
    one = rows(vectors).withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long"))))).drop("copies")
    one = common.materialize(one, "vectors")
    ask = common.materialize(rows(queries).drop("copies").withColumn("q", F.monotonically_increasing_id()), "asked")
    n = one.count()
    shards = max(1, math.ceil(n / shard_rows))
    blocks = max(1, math.ceil(ask.count() / block_rows))
    keyed = one.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), "id", "v")

    def build(table: pa.Table) -> pa.Table:
        tree = Tree.build(table.column("id").to_numpy(), _matrix(table.column("v")))
        return pa.table({
            "dim": table.column("dim").slice(0, 1), "shard": table.column("shard").slice(0, 1),
            "tree": pa.array([tree.dump()], pa.binary()),
        })

    def bundle(table: pa.Table) -> pa.Table:
        ids, vectors = np.stack([table.column("q").to_numpy(), table.column("id").to_numpy()]), _matrix(table.column("v"))
        return pa.table({"dim": table.column("dim").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary())})

    index = common.materialize(
        keyed.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary"), "trees", codec="none"
    )
    asked = ask.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")})
    asked = common.materialize(asked.groupBy("dim", "block").applyInArrow(bundle, "dim int, ids binary, vectors binary"), "queries", codec="none")
    # Queries go to the trees, block by block; each tree is sent once and stays.
    none = F.lit(None).cast("binary")
    trees = index.select("dim", "shard", F.lit(0).alias("kind"), "tree", none.alias("ids"), none.alias("vectors"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    visits = asked.select("dim", every, F.lit(1).alias("kind"), none.alias("tree"), "ids", "vectors")

    def nearest_of(tree: Tree, q: np.ndarray, q_ids: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        # Rows of the query's own id are no candidates, so that many more are sought.
        own = np.unique(tree.ids[np.isin(tree.ids, q_ids)], return_counts=True)[1].max(initial=1)
        who, rows = tree.search(unit_rows(raw), min(k + int(own), max(1, len(tree.unit))), factor)
        score = np.concatenate([exact_cosine(raw[who[a : a + 16384]], tree.raw[rows[a : a + 16384]]) for a in range(0, max(len(who), 1), 16384)])
        # Of equal vectors only so many of the smallest ids can matter.
        many = np.minimum(np.diff(tree.id_rows)[rows], k + int(own))
        at = np.repeat(tree.id_rows[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        query, vec, score = np.repeat(who, many), tree.ids[at], np.repeat(score, many)
        keep = q_ids[query] != vec
        query, vec, score = query[keep], vec[keep], score[keep]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (q[query], q_ids[query], vec, score)], names=["q", "query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dim, shard, kind = (batch.column(c)[row].as_py() for c in range(3))
                if kind == 0:
                    tree, of = Tree.load(batch.column(3)[row].as_py()), (dim, shard)
                elif of == (dim, shard):
                    q, q_ids = np.frombuffer(batch.column(4)[row].as_py(), dtype=np.int64).reshape(2, -1)
                    yield nearest_of(tree, q, q_ids, np.frombuffer(batch.column(5)[row].as_py(), dtype=np.float64).reshape(len(q_ids), dim))

    met = trees.unionByName(visits).repartition(common.shuffle_partitions(vectors.sparkSession), "dim", "shard")
    found = met.sortWithinPartitions("dim", "shard", "kind").mapInArrow(search, "q long, query_id long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
