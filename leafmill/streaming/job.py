"""Preparing page texts as a job that can stop anywhere and go on.

Pages arrive as a stream. Each micro-batch takes the unfinished ones through
cleaning, settles them, brings their documents' counts and status up to date,
and saves pages and documents together in the graph store, under the number of
the batch. A batch that runs again after a stop finds its number there and does
nothing, or does not find it and does all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.functions import chars
from leafmill.operators.lifecycle import complete_embedded
from leafmill.operators.requests import last_requests
from leafmill.sources.graph import Graph

SOURCE = "page-texts"
_STATES = ("completed", "failed")


def settle(pages: DataFrame) -> DataFrame:
    """Unfinished embedded pages with clean text, complete or failed."""
    text = chars.strip(chars.normalize_lookalikes(F.coalesce("extracted_text", F.lit(""))))
    return complete_embedded(pages.withColumn("extracted_text", text))


def changes(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Per document how many pages came and how the counts of states moved;
    ``old`` and ``new``: id, document_id, processing_status."""
    was = None if old is None else old.select("id", F.col("processing_status").alias("lm_was"))
    both = new.withColumn("lm_was", F.lit(None).cast("string")) if was is None else new.join(was, "id", "left")
    moved = {f"{s}_pages": F.sum((F.col("processing_status") == s).cast("long") - F.coalesce((F.col("lm_was") == s).cast("long"), F.lit(0))) for s in _STATES}
    return both.groupBy(F.col("document_id").alias("id")).agg(F.count_if(F.col("lm_was").isNull()).alias("seen_pages"), *[c.alias(n) for n, c in moved.items()])


COUNTS = ("seen_pages", "completed_pages", "failed_pages")


def refreshed(stored: DataFrame | None, moved: DataFrame) -> DataFrame:
    """(id, the counts, status, error_message) of the documents that moved."""
    if stored is not None:
        before = stored.select("id", *[F.col(c).alias(f"lm_{c}") for c in COUNTS])
        added = {c: F.col(c) + F.coalesce(f"lm_{c}", F.lit(0)) for c in COUNTS}
        moved = moved.join(before, "id", "left").withColumns(added).drop(*[f"lm_{c}" for c in COUNTS])
    failed, n = F.col("failed_pages") > 0, F.col("failed_pages")
    message = F.concat(n.cast("string"), F.when(n == 1, " page").otherwise(" pages"), F.lit(" still need attention."))
    status = F.when(failed, "failed").when(F.col("completed_pages") == F.col("seen_pages"), "text_ready").otherwise("extracting_text")
    return moved.select("id", *COUNTS, status.alias("status"), F.when(failed, message).alias("error_message"))


def apply(graph: Graph, batch: DataFrame, number: int, now: Column | None = None) -> None:
    """One batch of pages (id, document_id, page_number, extraction_method,
    extracted_text, processing_status; of one id the last by requested_at, if
    there is such a column, counts). Reads and rewrites only the buckets that
    the batch's pages and documents lie in."""
    manifest = graph.manifest()
    if number <= manifest.applied.get(SOURCE, -1):
        return
    last, _ = last_requests(batch.where(F.col("id").isNotNull()), ["id"])
    pages = settle(last.drop("requested_at")).persist()
    try:
        stored = [graph.read(t, manifest, graph.touched(f)) for t, f in (("pages", pages.select("id")), ("documents", pages.select(F.col("document_id").alias("id"))))]
        moved = changes(stored[0], pages.select("id", "document_id", "processing_status"))
        graph.save({"pages": pages, "documents": refreshed(stored[1], moved)}, F.current_timestamp() if now is None else now, SOURCE, number)
    finally:
        pages.unpersist()


def prepare(graph: Graph, pages: DataFrame, checkpoint: str, now: Column | None = None) -> StreamingQuery:
    """Run over all pages that are there, batch by batch, and stop."""
    writer = pages.writeStream.foreachBatch(lambda batch, number: apply(graph, batch, number, now))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
