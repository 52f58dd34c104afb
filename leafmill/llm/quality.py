"""Quality classifier: histogram gradient-boosted trees over text statistics.

Trees are grown level by level on binned features with second-order gradients
of the logistic loss, then laid out in flat arrays (feature, threshold, value;
children of node i at 2i + 1 and 2i + 2), which numpy walks for a whole batch
at a time, one step per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common, statistics, units

#: The model is fitted on at most this many labelled documents.
SAMPLE_ROWS = 8_000


@dataclass
class Forest:
    """Flattened trees of one depth; row t of each array is tree t."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 2.0, least: float = 2.0) -> Forest:
    """Boost ``trees`` trees. No rows, or one class only: a constant score."""
    nodes, leaves = 2 ** (depth + 1) - 1, 2**depth - 1
    p = (float(y.sum()) + 1) / (len(y) + 2)
    forest = Forest(float(np.log(p / (1 - p))), *(np.zeros((0, nodes), dtype=d) for d in (np.int64, np.float64, np.float64)), depth)
    if len(np.unique(y)) < 2:
        return forest
    n, k = x.shape
    grid = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0, method="lower")
    binned = np.stack([np.searchsorted(grid[:, j], x[:, j], side="left") for j in range(k)], axis=1)
    flat = binned + np.arange(k) * bins
    total = np.full(n, forest.base)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        feature, threshold, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (k * bins) + flat).ravel()
            g = np.bincount(at, np.repeat(grad, k), width * k * bins).reshape(width, k, bins).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, k), width * k * bins).reshape(width, k, bins).cumsum(axis=2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
            gain[(h < least) | (h_all - h < least)] = -1
            gain = gain[:, :, :-1].reshape(width, -1)
            pick = gain.argmax(axis=1)
            split = gain[np.arange(width), pick] > 1e-6
            feature[first : first + width] = np.where(split, pick // (bins - 1), 0)
            cut = grid[pick % (bins - 1), pick // (bins - 1)]
            threshold[first : first + width] = np.where(split, cut, np.inf)
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        g = np.bincount(node, grad, nodes)
        h = np.bincount(node, hess, nodes)
        value[leaves:] = rate * (g / (h + l2))[leaves:]
        total += value[node]
        out.append((feature, threshold, value))
    stack = [np.stack(c) for c in zip(*out, strict=True)]
    return Forest(forest.base, stack[0], stack[1], stack[2], depth)


def _feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, y, x): statistics of each labelled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in units.slices(batch.column(2)):
                x = statistics.features(texts)
                flat = pa.array(x.ravel())
                size = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.ListArray.from_arrays(size, flat)],
                    names=["doc_id", "y", "x"],
                )

    return docs.mapInArrow(run, "doc_id long, y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    Only statistics of the text enter; at most ``rows`` feature rows come to
    the driver. Of several rows of one id the one of smallest text hash counts.
    Without labels of both kinds every score is the same.
    """
    chosen = common.labelled_sample(labels, label, modulus, held_out, rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = common.one_text_each(text.join(F.broadcast(chosen), "doc_id"))  # at most ``rows`` ids
    found = _feature_rows(joined.select("doc_id", "y", "text")).orderBy(F.xxhash64("doc_id")).limit(rows).toArrow()
    y = found.column("y").to_numpy().astype(np.float64)
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(len(y), len(statistics.NAMES))
    return fit(x, y)


def scores(texts: pa.Array, forest: Forest) -> np.ndarray:
    out = [forest.score(statistics.features(part)) for _, part in units.slices(texts)]
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) of every row; null text scores as an empty one, equal
    texts score alike, repeated rows and null ids stay, an empty table gives no
    rows, other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores(batch.column(1), forest))], names=["doc_id", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """Rows of at least ``threshold``, with all their columns as they were,
    whatever their names; null texts count as empty ones, repeated rows stay."""
    return units.filter_rows(docs, lambda texts: scores(texts, forest) >= threshold)
