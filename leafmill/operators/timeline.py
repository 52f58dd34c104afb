"""Sessions of events, and events joined to what was known at their time.

Both follow one key's rows in time, and one key may hold a third of all rows.
The time is cut into slices at values of a bounded sample; a key's rows meet by
slice, and only a row or two of each slice are carried on to the next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.ranks import sliced


def _joined(a: DataFrame, b: DataFrame, on: list[str]) -> Column:
    same = F.lit(True)
    for c in on:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return same


def sessions(events: DataFrame, key: list[str], time: str, gap: str, value: str | None = None) -> DataFrame:
    """(key, session_start, session_end, events[, total]): runs of a key's events
    of which each follows the one before by no more than ``gap`` (an interval,
    such as "30 minutes"); start and end are those of the first and last event.

    Null keys are one key, events without time are in no session, equal times
    are of one session. Sessions are found within slices of time; those that may
    go on beyond their slice, the first and last of each key there, are then
    joined along the slices.
    """
    order = F.col(time)
    whole = sliced(events.where(order.isNotNull()), [order], "lm_slice")
    within = Window.partitionBy(*key, "lm_slice").orderBy(time)
    span = F.expr(f"INTERVAL {gap}")
    opens = F.coalesce(order > F.lag(time).over(within) + span, F.lit(True))
    numbered = whole.withColumn("lm_opens", opens.cast("int")).withColumn("lm_run", F.sum("lm_opens").over(within))
    total = F.sum(value) if value else F.lit(None).cast("double")
    runs = numbered.groupBy(*key, "lm_slice", "lm_run").agg(F.min(time).alias("s"), F.max(time).alias("e"), F.count(F.lit(1)).alias("n"), total.alias("t"))
    last = Window.partitionBy(*key, "lm_slice")
    runs = runs.withColumn("lm_edge", (F.col("lm_run") == 1) | (F.col("lm_run") == F.max("lm_run").over(last)))
    done = runs.where(~F.col("lm_edge")).select(*key, "s", "e", "n", "t")
    # At most two runs of each key and slice.
    along = Window.partitionBy(*key).orderBy("s", "lm_slice", "lm_run")
    edges = runs.where("lm_edge").withColumn("lm_opens", F.coalesce(F.col("s") > F.lag("e").over(along) + span, F.lit(True)).cast("int"))
    # Between the first and last run of a slice there are others, which part them.
    edges = edges.withColumn("lm_group", F.sum("lm_opens").over(along))
    joined = edges.groupBy(*key, "lm_group").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    out = done.unionByName(joined.select(*key, "s", "e", "n", "t"))
    shown = [F.col("s").alias("session_start"), F.col("e").alias("session_end"), F.col("n").alias("events")]
    return out.select(*key, *shown, *([F.col("t").alias("total")] if value else []))


def as_of(events: DataFrame, versions: DataFrame, key: list[str], time: str, values: list[str], tie: str | None = None) -> DataFrame:
    """``events`` with ``values`` of the latest of ``versions`` of their key at
    or before their ``time``, nulls where there is none.

    Of versions of one time the greatest ``tie`` counts. Events without time or
    key have no version, and such versions count for nobody. No event is
    compared with more than the rows of its own slice; each slice hands its
    last version of a key to the slices after it.
    """
    held = F.struct(*[F.col(v).alias(v) for v in values])
    rank = F.col(tie) if tie else F.lit(0)
    known = F.col(time).isNotNull()
    for k in key:
        known &= F.col(k).isNotNull()
    right = versions.where(known).select(*key, F.col(time).alias("lm_t"), F.lit(0).alias("lm_side"), rank.alias("lm_tie"), held.alias("lm_v"))
    row = F.struct(*[F.col(c).alias(c) for c in events.columns])
    nothing = F.lit(None)
    left = events.select(*key, F.col(time).alias("lm_t"), F.lit(1).alias("lm_side"), nothing.cast(right.schema["lm_tie"].dataType).alias("lm_tie"), nothing.cast(right.schema["lm_v"].dataType).alias("lm_v"), row.alias("lm_row"))
    both = left.unionByName(right.withColumn("lm_row", nothing.cast(left.schema["lm_row"].dataType)))
    cut = sliced(both, [F.col("lm_t")], "lm_slice")
    within = Window.partitionBy(*key, "lm_slice").orderBy("lm_t", "lm_side", "lm_tie").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn("lm_here", F.last("lm_v", ignorenulls=True).over(within)).where("lm_side = 1")
    order = F.struct("lm_t", "lm_tie")
    ends = cut.groupBy(*key, "lm_slice").agg(F.max_by(F.when(F.col("lm_side") == 0, F.col("lm_v")), F.when(F.col("lm_side") == 0, order)).alias("lm_end"))
    before = Window.partitionBy(*key).orderBy("lm_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*key, "lm_slice", F.last("lm_end", ignorenulls=True).over(before).alias("lm_before"))
    met = local.alias("a").join(carried.alias("b"), _joined(local, carried, [*key, "lm_slice"]), "left")
    found = F.coalesce(F.col("a.lm_here"), F.col("b.lm_before"))
    usable = F.col("a.lm_t").isNotNull()
    for k in key:
        usable &= F.col(f"a.{k}").isNotNull()
    return met.select("a.lm_row.*", *[F.when(usable, found[v]).alias(v) for v in values])
