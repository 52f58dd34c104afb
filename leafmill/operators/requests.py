"""Batches of requests in which one key may be asked for more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_requests(requests: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the last request of each key, the others).

    Last by ``requested_at`` where there is such a column, then by the other
    columns. The others come once each, with ``times`` and the error code
    "superseded"; of equal requests one stands and the rest are among them. An
    aggregate finds the last, so a key of very many requests meets in no task.
    """
    rest = [c for c in requests.columns if c not in key]
    order = sorted(rest, key=lambda c: (c != "requested_at", c))
    top = requests.groupBy(*key).agg(F.max(F.struct(*(order or key))).alias("lm_last"))
    kept = top.select(*key, *[F.col(f"lm_last.{c}").alias(c) for c in rest])
    same = F.lit(True)
    for k in key:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    counted = requests.groupBy(*requests.columns).agg(F.count(F.lit(1)).alias("times"))
    last = F.struct(*[F.col(f"r.{c}").alias(c) for c in (order or key)]).eqNullSafe(F.col("t.lm_last"))
    left = F.col("times") - F.when(last, 1).otherwise(0)
    others = counted.alias("r").join(top.alias("t"), same).select("r.*", left.alias("lm_left")).where("lm_left > 0")
    return kept, others.withColumns({"times": F.col("lm_left"), "error_code": F.lit("superseded")}).drop("lm_left")
