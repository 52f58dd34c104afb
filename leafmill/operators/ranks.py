"""Places within groups of any size.

One group may hold a third of all rows, and a window over it would sort them in
one task. Here the order's whole range is cut into slices at the values of a
bounded sample; rows are numbered within their group and slice, and the sizes
of a group's earlier slices are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES, SAMPLE = 64, 4096


def sliced(table: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``table`` with ``name``, the number of the slice that each row's
    ``order`` lies in; equal orders share a slice.

    Slices begin at values of the rows of the smallest hashes of the order, at
    most ``SAMPLE`` rows, of which ``SLICES`` come into the plan as a constant:
    every task cuts alike, whenever it runs.
    """
    marked = table.withColumn("lm_order", F.struct(*[c.alias(f"c{k}") for k, c in enumerate(order)]))
    kind = marked.schema["lm_order"].dataType
    seen = marked.select("lm_order").orderBy(F.xxhash64("lm_order")).limit(SAMPLE)
    step = max(1, SAMPLE // SLICES)
    sampled = seen.agg(F.sort_array(F.collect_list("lm_order")).alias("s"))
    cuts = sampled.select(F.expr(f"filter(s, (x, i) -> i % {step} = 0)").alias("s")).first()["s"]
    constant = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, kind.fields, strict=True)]) for cut in cuts])
    constant = constant.cast(f"array<{kind.simpleString()}>")
    return marked.withColumn(name, _upto(constant, len(cuts), F.col("lm_order"))).drop("lm_order")


def _upto(cuts: Column, n: int, value: Column) -> Column:
    """How many of ``n`` ascending ``cuts`` are at most ``value``, by halving
    steps: a row meets seven of 64 cuts."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]).cast("array<int>")

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by <= n) & (F.get(cuts, at + by - 1) <= value), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def with_place(table: DataFrame, keys: list[str], order: list[Column], name: str, descending: bool = False) -> DataFrame:
    """``table`` with ``name``, each row's place (from 1) in its group by
    ``order``, whose columns must tell rows apart if places are to be certain.
    The sample only says where to cut: places are exact for any cuts."""
    kept = F.struct(*[c.alias(f"c{k}") for k, c in enumerate(order)])
    ordered = sliced(table, order, "lm_slice").withColumn("lm_order", kept)
    way = F.desc if descending else F.asc
    within = Window.partitionBy(*keys, "lm_slice").orderBy(way("lm_order"))
    placed = ordered.withColumn("lm_row", F.row_number().over(within))
    sizes = ordered.groupBy(*keys, "lm_slice").agg(F.count(F.lit(1)).alias("lm_n"))
    earlier = Window.partitionBy(*keys).orderBy(way("lm_slice")).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("lm_before", F.coalesce(F.sum("lm_n").over(earlier), F.lit(0))).drop("lm_n")
    same = F.col("a.lm_slice") == F.col("b.lm_slice")
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = placed.alias("a").join(bases.alias("b"), same)
    return joined.select(*[F.col(f"a.{c}") for c in table.columns], (F.col("lm_row") + F.col("lm_before")).alias(name))
