"""Centroid clustering on integers: fast screening, exact decisions.

Vectors become integers (fixed point), and so do centroids. A float32 matrix
product estimates every distance, and a bound on its rounding error makes an
interval of each estimate. A centroid whose interval lies below all others is
nearest, surely; where intervals overlap, the distances to those centroids are
computed once more in exact integers, and the smaller number wins a tie. So the
result is that of integer arithmetic throughout, at the price of one matrix
product for nearly all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common, exact


def error_factor(dim: int) -> float:
    """How far a float32 dot product can be off, as a share of the product of
    the norms: ``dim`` products and sums in any order, fused or not, and the
    rounding of both factors to float32."""
    u = float(np.finfo(np.float32).eps) / 2
    steps = dim + 4
    return steps * u / (1 - steps * u) * (1 + 1e-6)


def exact_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of paired integer rows: int64 where it fits, else Python integers."""
    reach = exact.largest(x) + exact.largest(centres)
    if x.dtype != object and centres.dtype != object and reach * reach * max(1, x.shape[1]) <= exact.LONG:
        d = x - centres
    else:
        d = x.astype(object) - centres.astype(object)
    return (d * d).sum(axis=1)


def estimates(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) ends of intervals that surely hold ``|c|^2 - 2 x.c`` for each
    row and centre: the distance less what all centres share."""
    wide_x, wide_c = x.astype(np.float64), centres.astype(np.float64)
    norm_x = np.sqrt((wide_x**2).sum(axis=1)) * (1 + 1e-9)
    square = (wide_c**2).sum(axis=1)
    norm_c = np.sqrt(square) * (1 + 1e-9)
    with np.errstate(over="ignore", invalid="ignore"):
        dots = (wide_x.astype(np.float32) @ wide_c.astype(np.float32).T).astype(np.float64)
        middle = square - 2 * dots
        # Errors of the product, then those of float64 in the lines above.
        radius = 2 * error_factor(x.shape[1]) * np.outer(norm_x, norm_c) + 1e-12 * (square + 2 * np.abs(dots))
    return middle - radius, middle + radius


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, int]:
    """(number of the nearest centre of each row, rows decided by integers)."""
    low, high = estimates(x, centres)
    known = np.isfinite(low).all(axis=1) & np.isfinite(high).all(axis=1)
    shortlist = (low <= high.min(axis=1, keepdims=True)) | ~known[:, None]
    best = shortlist.argmax(axis=1)
    unsure = np.flatnonzero(shortlist.sum(axis=1) > 1)
    if len(unsure):
        at, c = np.nonzero(shortlist[unsure])
        far = exact_distances(x[unsure[at]], centres[c])
        order = np.argsort(far, kind="stable")  # pairs come by row and number, so ties keep the smaller number first
        order = order[np.argsort(at[order], kind="stable")]
        first = np.searchsorted(at[order], np.arange(len(unsure)))
        best[unsure] = c[order][first]
    return best, len(unsure)


def _centres(centroids: list[list[int]]) -> np.ndarray:
    fits = all(abs(v) < 2**62 for c in centroids for v in c)
    return np.array(centroids, dtype=np.int64 if fits else object)


def seeds(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, in hash order; rows
    without id come last, of equal ids the smaller vector is first."""
    name = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    ranked = rows.select(F.sha2(name.cast("binary"), 256).alias("h"), "x")
    return [list(r["x"]) for r in ranked.orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()]


def move(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: every centroid that has vectors moves to the floor of their mean."""
    centres, dim = _centres(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centres), dtype=object), np.zeros((len(centres), dim), dtype=object)
        for batch in batches:
            for _, _, x in exact.matrices(batch.column(0)):
                number, _ = nearest(x, centres)
                for c in np.unique(number).tolist():
                    mine = x[number == c]
                    count[c] += len(mine)
                    total[c] += exact.column_sums(mine)
        used = np.flatnonzero(count)
        a, b = np.repeat(used, dim + 1), np.tile(np.arange(-1, dim), len(used))
        yield exact.digits([np.full(len(a), dim), a, b], np.concatenate([count[used][:, None], total[used]], axis=1).ravel())

    sums = exact.collect(rows.select("x").mapInArrow(run, exact.SCHEMA))
    moved = list(centroids)
    for c in range(len(centroids)):
        n = sums.get((dim, c, -1), 0)
        if n:
            moved[c] = [sums[dim, c, j] // n for j in range(dim)]
    return moved


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, seed: int = 1, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every
    vector of ``dim`` finite components, as integers ``floor(scale * x)``.

    ``distance`` is the exact squared distance to the nearest centroid (null
    beyond 38 digits), the inertias its sums, ``centroid`` the integers. Other
    vectors take no part. Repeated rows stay and count as often as they occur,
    null ids stay, other columns are ignored; fewer than k vectors make fewer
    centroids, an empty table gives no rows. Tasks send k sums of their vectors
    to the driver's aggregate, and a cluster of any size needs no task of its own.
    """
    kept = vectors.where(exact.finite(vector_col) & (F.size(vector_col) == dim))
    rows = common.materialize(kept.select(F.col(id_col).cast("long").alias("id"), exact.fixed_point(vector_col, scale, 0).alias("x")), "clustering")
    schema = "vec_id long, cluster int, distance decimal(38,0)"
    centroids = seeds(rows, k, seed)
    if not centroids:
        return rows.sparkSession.createDataFrame([], schema + ", cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<decimal(38,0)>")
    for _ in range(rounds):
        centroids = move(rows, centroids)
    centres = _centres(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, who, x in exact.matrices(batch.column(1)):
                number, _ = nearest(x, centres)
                far = [int(v) for v in exact_distances(x, centres[number])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(who)),
                        pa.array(number.astype(np.int32)),
                        pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0)),
                    ],
                    names=["vec_id", "cluster", "distance"],
                )

    found = common.materialize(rows.mapInArrow(assign, schema), "clusters")
    # One row for each of at most k clusters: small enough to be sent everywhere.
    totals = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()
    inertia = None if any(r["cluster_inertia"] is None for r in totals) else sum(int(r["cluster_inertia"]) for r in totals)
    report = [(r["cluster"], r["cluster_inertia"], None if inertia is None else Decimal(inertia), [Decimal(v) for v in centroids[r["cluster"]]]) for r in totals]
    known = rows.sparkSession.createDataFrame(report, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid array<decimal(38,0)>")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
