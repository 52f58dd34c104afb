"""Listening progress: the last write per user and document wins.

Events: user_id, document_id, ts, event_id, segment_number, position_seconds,
playback_speed, ended, parts. Ties in time go to the larger event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

KEY = ["user_id", "document_id"]


def transition(events: DataFrame) -> DataFrame:
    """What each event saves: at the end of the last part the document is
    complete, at the end of another part the next one begins at 0."""
    last = F.col("segment_number") >= F.col("parts")
    return events.withColumns(
        {
            "current_segment_number": F.when(F.col("ended") & ~last, F.col("segment_number") + 1).otherwise(F.col("segment_number")),
            "position_seconds": F.when(F.col("ended"), 0.0).otherwise(F.col("position_seconds")),
            "completed": F.col("ended") & last,
        }
    ).select(*KEY, "ts", "event_id", "current_segment_number", "position_seconds", "playback_speed", "completed")


def latest(saved: DataFrame) -> DataFrame:
    """Newest row per key: an aggregate, so a hot key combines map-side."""
    rest = [c for c in saved.columns if c not in KEY]
    row = F.max(F.struct("ts", "event_id", *[c for c in rest if c not in ("ts", "event_id")])).alias("r")
    return saved.groupBy(*KEY).agg(row).select(*KEY, *[F.col(f"r.{c}").alias(c) for c in rest])


def history(saved: DataFrame) -> DataFrame:
    """Each write with its number per key, newest first."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("ts"), F.desc("event_id"))
    return saved.withColumn("version", F.row_number().over(order))


BUCKETS = 64


def _versions(spark: SparkSession, state_path: str, before: int | None = None) -> dict[int, list[str]]:
    """For each bucket of keys the folders of its finished versions, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(state_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = {f.getPath().getParent().getName() for f in fs.globStatus(path(f"{state_path}/batch=*/_SUCCESS")) or ()}
    found: dict[int, list[tuple[int, str]]] = {}
    for f in fs.globStatus(path(f"{state_path}/batch=*/bucket=*")) or ():
        batch, bucket = f.getPath().getParent().getName(), int(f.getPath().getName().split("=")[1])
        number = int(batch.split("=")[1])
        if batch in done and (before is None or number < before):
            found.setdefault(bucket, []).append((number, f.getPath().toString()))
    return {k: [p for _, p in sorted(v)] for k, v in found.items()}


def current(spark: SparkSession, state_path: str, schema: StructType) -> DataFrame:
    """The state that ``stream_latest`` keeps, as of its last finished batch."""
    paths = [v[-1] for v in _versions(spark, state_path).values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_latest(events: DataFrame, state_path: str, checkpoint: str, available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the latest progress in folders ``batch=N/bucket=K`` of a path.

    Keys are dealt to buckets by hash. Each micro-batch reduces to one row per
    key and rewrites only the buckets that it touches, each from its version
    before; a bucket's versions before that one are deleted. A batch that runs
    again writes the same folders anew from the same versions, so restarts
    neither lose nor double events.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        of_key = F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")
        new = latest(transition(batch)).persist()
        touched = [r["bucket"] for r in new.select(of_key.alias("bucket")).distinct().collect()]  # at most ``buckets``
        versions = _versions(spark, state_path, before=number)
        old = [versions[k][-1] for k in touched if k in versions]
        whole = latest(spark.read.schema(new.schema).parquet(*old).unionByName(new)) if old else new
        whole.withColumn("bucket", of_key).write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/batch={number}")
        new.unpersist()
        path = spark._jvm.org.apache.hadoop.fs.Path
        for k in touched:
            for gone in versions.get(k, [])[:-1]:
                path(gone).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path(gone), True)

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="3 seconds")).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type, with a watermark when streaming."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def parse_saved(text: Column) -> Column:
    """Saved progress from JSON; null where it doesn't parse."""
    return F.from_json(text, "segmentNumber int, positionSeconds double, playbackSpeed double, completed boolean", {"mode": "PERMISSIVE"})
