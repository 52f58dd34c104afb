"""Sums of integers of any size, as Spark aggregates of long columns.

Python tasks add up what they hold as arbitrary-precision integers and emit
each sum as digits to base 2^40, the last one signed. Spark adds digits as
longs, which stay exact up to 2^22 tasks of equal sign, and the driver puts
them together again. What reaches the driver is one row for each place and
digit, whatever the number of vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 40
SCHEMA = "dim int, a int, b int, digit int, value long"
LONG = 2**63 - 1


def finite(vector: str) -> Column:
    """Not null, and no component null, NaN or infinite."""
    c = F.col(vector)
    each = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & each, F.lit(False))


def fixed_point(vector: str, scale: float, offset: int) -> Column:
    """floor(scale * component) + offset as longs; beyond a long's range its end."""
    most = F.lit(LONG - abs(offset))
    whole = lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x.cast("double")), -most), most)
    return F.transform(F.col(vector), lambda x: whole(x) + F.lit(offset).cast("long"))


def matrices(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, int64 matrix) for each length of vector in a batch."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        out.append((int(dim), rows, flat.astype(np.int64, copy=False).reshape(len(rows), dim)))
    return out


def largest(values: np.ndarray) -> int:
    """Greatest absolute value, also of the smallest long."""
    return max(int(values.max()), -int(values.min())) if values.size else 0


def shifted(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """``x - shift``: int64 where that surely fits, else Python integers."""
    if largest(x) + max(map(abs, shift), default=0) < LONG:
        return x - np.array(shift, dtype=np.int64)
    return x.astype(object) - np.array(shift, dtype=object)


def column_sums(y: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as Python integers."""
    if y.dtype != object and largest(y) * len(y) <= LONG:
        return y.sum(axis=0).astype(object)
    return y.astype(object).sum(axis=0)


def cross_products(y: np.ndarray) -> np.ndarray:
    """Exact ``y.T @ y`` as Python integers.

    Entries are cut into digits so short that products and their sums over a
    block of 2^12 rows stay below 2^53; then a float64 product is exact.
    """
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for at in range(0, len(y), 1 << 12):
        block, parts = y[at : at + (1 << 12)], []
        while block.size and largest(block) >= 1 << 20:
            low = block & ((1 << 20) - 1)
            parts.append(low.astype(np.float64))
            block = (block - low) >> 20
        parts.append(block.astype(np.float64))
        for i, p in enumerate(parts):
            for j, q in enumerate(parts):
                total = total + ((p.T @ q).astype(np.int64).astype(object) << (20 * (i + j)))
    return total


def digits(keys: list[np.ndarray], values: np.ndarray) -> pa.RecordBatch:
    """Rows of ``SCHEMA`` for integers at places ``keys`` (dim, a, b)."""
    out: list[list[np.ndarray]] = []
    left = np.asarray(values, dtype=object)
    keys = [np.asarray(k, dtype=np.int32) for k in keys]
    place = 0
    while len(left):
        done = np.array([-(1 << (DIGIT - 1)) <= v < 1 << (DIGIT - 1) for v in left])
        low = np.where(done, left, left & ((1 << DIGIT) - 1))
        out.append([*keys, np.full(len(left), place, np.int32), low.astype(np.int64)])
        left, keys, place = (left >> DIGIT)[~done], [k[~done] for k in keys], place + 1
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int32)] * 4 + [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "a", "b", "digit", "value"])


def collect(parts: DataFrame) -> dict[tuple[int, int, int], int]:
    """{(dim, a, b): exact sum} of what the tasks emitted by ``digits``."""
    summed = parts.groupBy("dim", "a", "b", "digit").agg(F.sum("value").alias("value"))
    out: dict[tuple[int, int, int], int] = {}
    for r in summed.collect():
        key = (r["dim"], r["a"], r["b"])
        out[key] = out.get(key, 0) + (r["value"] << (DIGIT * r["digit"]))
    return out
