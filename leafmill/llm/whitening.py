"""Embedding whitening from an exact integer scatter matrix.

Components become integers (fixed point). Over the distinct vectors x of a
table, n and the sums S come first; then, with the integer shift S // n
subtracted, sums and cross-products of the remainders as arbitrary-precision
integers. ``n * XtX - S St`` is the same for every shift and is formed exactly;
only the finished matrix, divided by n^2 with one rounding, becomes floats and
goes to ``eigh``. Nothing cancels, however far from zero the vectors lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common, exact


@dataclass
class Axes:
    """The fit for vectors of one dimension: ``axes`` (dimension x kept) map
    centred vectors to whitened ones."""

    n: int
    sums: list[int]
    shift: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: int64 where its squares' sum fits, else Python integers."""
        y = exact.shifted(x, self.shift)
        rest = [s - self.n * h for s, h in zip(self.sums, self.shift, strict=True)]
        bound = self.n * exact.largest(y) + max(map(abs, rest), default=0)
        kind = np.int64 if y.dtype != object and bound * bound * max(1, len(rest)) <= exact.LONG else object
        return y.astype(kind) * self.n - np.array(rest, dtype=kind)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64) @ self.axes


def decompose(n: int, sums: list[int], shift: list[int], products: np.ndarray, kept: int) -> Axes:
    """Axes from exact sums; ``products``: cross-products of ``x - shift``.

    An axis whose eigenvalue is zero within rounding carries nothing to scale:
    its coordinates are NaN, and it explains 0.
    """
    rest = np.array([s - n * h for s, h in zip(sums, shift, strict=True)], dtype=object)
    scatter = products * n - rest[:, None] * rest[None, :]
    # An integer over an integer is rounded once.
    covariance = np.array([[v / (n * n) for v in row] for row in scatter.tolist()], dtype=np.float64)
    trace = sum(scatter.diagonal().tolist()) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:kept]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    flat = values <= len(sums) * np.finfo(np.float64).eps * max(float(values.max(initial=0)), 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        axes = np.where(flat, np.nan, vectors / np.sqrt(np.where(flat, 1.0, values)))
        explained = np.where(flat, 0.0, values / trace) if trace else np.zeros(len(values))
    return Axes(n, sums, shift, axes, values, explained)


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: float, offset: int) -> DataFrame:
    """(id, x) of the rows that take part."""
    whole = exact.fixed_point(vector_col, scale, offset)
    return vectors.where(exact.finite(vector_col)).select(F.col(id_col).cast("long").alias("id"), whole.alias("x"))


def fit(vectors: DataFrame, kept: int = 16, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, offset: int = 0) -> dict[int, Axes]:
    """{dimension: Axes} over the distinct integer vectors of the table.

    Copies count once, so a vector of a third of all rows weighs as any other;
    they are combined before the shuffle. Vectors of another length are fitted
    by themselves. The driver receives sums only: for each dimension d about
    d^2 / 2 numbers.
    """
    rows = integers(vectors, id_col, vector_col, scale, offset)
    distinct = common.materialize(rows.where(F.size("x") > 0).select("x").distinct(), "whitening")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for dim, who, x in exact.matrices(batch.column(0)):
                n, s = total.get(dim, (0, 0))
                total[dim] = (n + len(who), s + exact.column_sums(x))
        for dim, (n, s) in total.items():
            yield exact.digits([np.full(dim + 1, dim), np.arange(-1, dim), np.zeros(dim + 1)], np.concatenate([[n], s]))

    first = exact.collect(distinct.mapInArrow(count, exact.SCHEMA))
    sizes = {dim: n for (dim, a, _), n in first.items() if a < 0}
    sums = {dim: [first[dim, a, 0] for a in range(dim)] for dim in sizes}
    shift = {dim: [s // sizes[dim] for s in sums[dim]] for dim in sizes}

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in exact.matrices(batch.column(0)):
                total[dim] = total.get(dim, 0) + exact.cross_products(exact.shifted(x, shift[dim]))
        for dim, products in total.items():
            a, b = np.triu_indices(dim)
            yield exact.digits([np.full(len(a), dim), a, b], products[a, b])

    second = exact.collect(distinct.mapInArrow(multiply, exact.SCHEMA))
    model: dict[int, Axes] = {}
    for dim, n in sizes.items():
        products = np.array([[second[dim, min(a, b), max(a, b)] for b in range(dim)] for a in range(dim)], dtype=object)
        model[dim] = decompose(n, sums[dim], shift[dim], products, kept)
    for dim, error in identity_errors(distinct, model).items():
        model[dim].identity_error = error
    return model


def identity_errors(distinct: DataFrame, model: dict[int, Axes]) -> dict[int, float]:
    """Largest entry of the whitened vectors' covariance minus the identity, as
    measured over the distinct vectors; axes that carry nothing are left out."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in exact.matrices(batch.column(0)):
                z = model[dim].whiten(model[dim].deviations(x))
                total[dim] = total.get(dim, 0) + z.T @ z
        for dim, products in total.items():
            a, b = np.triu_indices(len(products))
            columns = [pa.array(np.full(len(a), dim, np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(products[a, b])]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "a", "b", "value"])

    summed = distinct.mapInArrow(measure, "dim int, a int, b int, value double").groupBy("dim", "a", "b").agg(F.sum("value").alias("value"))
    out: dict[int, float] = dict.fromkeys(model, 0.0)
    for r in summed.where(~F.isnan("value")).collect():
        error = abs(r["value"] / model[r["dim"]].n - (r["a"] == r["b"]))
        out[r["dim"]] = max(out[r["dim"]], error)
    return out


def transform(vectors: DataFrame, model: dict[int, Axes], id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, offset: int = 0) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error), one row for
    each row that takes part.

    ``deviation`` is the exact sum of ``(n x - S)^2`` (null beyond 38 digits),
    ``whitened`` and ``explained`` arrays with an entry for each component, null
    in ``whitened`` where a component carries nothing. Rows whose vector is null
    or holds null or non-finite entries take no part; empty vectors have no
    components; repeated rows and null ids stay; other columns are ignored; an
    empty table gives no rows. ``scale`` and ``offset`` as in ``fit``.
    """
    schema = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, who, x in exact.matrices(batch.column(1)):
                if not dim:
                    continue
                m = model[dim]
                far = m.deviations(x)
                total = [int(v) for v in (far * far).sum(axis=1)]
                z = m.whiten(far)
                width = z.shape[1]
                ends = pa.array(np.arange(len(who) + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(who)),
                        pa.array(np.full(len(who), m.n)),
                        pa.array([Decimal(v) if v < 10**38 else None for v in total], pa.decimal128(38, 0)),
                        pa.ListArray.from_arrays(ends, pa.array(z.ravel(), mask=np.isnan(z.ravel()))),
                        pa.ListArray.from_arrays(ends, pa.array(np.tile(m.explained, len(who)))),
                        pa.array(np.full(len(who), m.identity_error)),
                    ],
                    names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return integers(vectors, id_col, vector_col, scale, offset).mapInArrow(run, schema)
