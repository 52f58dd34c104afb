"""Connected components of a link table: links are contracted where they lie,
then labels propagate with jumps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import common

#: Links that are contracted at once, and up to which a task takes all of them.
HELD = 1 << 20


def local_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n indices over links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join what a task's links join, each to the least node."""

    def star(held: list[np.ndarray]) -> pa.RecordBatch:
        ends, flat = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        i, j = flat.reshape(2, -1)
        root = local_labels(i, j, len(ends))
        apart = root != np.arange(len(ends))
        return pa.RecordBatch.from_arrays([pa.array(ends[apart]), pa.array(ends[root[apart]])], names=["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        if sum(x.shape[1] for x in held) >= HELD:
            yield star(held)
            held = []
    if held:
        yield star(held)


def contract(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) that join the same nodes: stars within each task."""
    return links.select("a", "b").mapInArrow(_stars, "a long, b long")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all links that come, which are HELD at most."""
    held = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches if batch.num_rows]
    if held:
        ends, flat = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        root = local_labels(*flat.reshape(2, -1), len(ends))
        yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(ends[root])], names=["node", "label"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over ``links``.

    ``links`` has columns ``a`` and ``b`` of longs; direction, repeats and
    self-links don't matter, null ends are ignored. Links are contracted as
    they come and again by their larger node, so that what one task found is
    one hop wide. If HELD or fewer are left, one task finishes them. Otherwise
    each round takes the least label among a node and its neighbours, and the
    label of that label, and is written to the scratch folder, until nothing
    changes. No links give no rows.
    """
    ends = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    stars = contract(contract(ends).repartition(common.shuffle_partitions(links.sparkSession), "a"))
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    edges = common.materialize(stars.select(ways.alias("e")).select("e.a", "e.b").distinct(), "edges")
    if edges.count() <= 2 * HELD:  # each link stands in both directions
        one = edges.where("a > b").coalesce(1).mapInArrow(_roots, "node long, label long")
        labels = common.materialize(one, "labels")
        common.discard(edges)
        return labels
    labels = common.materialize(
        edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")),
        "labels",
    )
    while True:
        near = (
            edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("lb").alias("lb"))
        )
        step = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "lb").alias("mid")
        )
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = common.materialize(
            step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")), "labels"
        )
        changed = new.where(F.col("old") != F.col("label")).limit(1).count()
        common.discard(labels)
        kept = new
        labels = new.select("node", "label")
        labels._leafmill_path = kept._leafmill_path
        if not changed:
            common.discard(edges)
            return labels
