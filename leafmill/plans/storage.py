"""Upserts, deletes, moves and integrity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans import shared
from leafmill.plans.catalogue import query
from leafmill.sources import fixtures as fx
from leafmill.sources import graph, store

_CUT = "TIMESTAMP '1996-06-01 00:00:00'"


@query(
    f"""WITH {fx.RECORDINGS_SQL}, n AS (SELECT id, status || '*' AS status, updated_at FROM recordings WHERE created_at >= {_CUT}
      UNION ALL SELECT id, 'older' AS status, created_at - INTERVAL '1' DAY AS updated_at FROM recordings WHERE created_at >= {_CUT}),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, status DESC) r FROM n) WHERE r = 1)
    SELECT id, status, updated_at FROM k UNION ALL SELECT id, status, updated_at FROM recordings WHERE id NOT IN (SELECT id FROM k)"""
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = fx.recordings(spark, sf_dir).select("id", "status", "updated_at", "created_at")
    new = old.where(f"created_at >= {_CUT}")
    rows = new.selectExpr("id", "concat(status, '*') AS status", "updated_at").unionByName(
        new.selectExpr("id", "'older' AS status", "created_at - INTERVAL '1' DAY AS updated_at")
    )
    return store.upsert(old.drop("created_at"), rows, ["id"])


_GONE = "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 0"


def _deleted(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    gone = fx.table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"))
    return store.delete_documents(gone, fx.recordings(spark, sf_dir), fx.pages(spark, sf_dir), fx.segments(spark, sf_dir))


@query(
    f"""WITH {fx.RECORDINGS_SQL}, gone AS ({_GONE}) SELECT id, CASE WHEN library_document_id NOT IN (SELECT id FROM gone) THEN library_document_id END AS library_document_id
    FROM recordings WHERE id NOT IN (SELECT id FROM gone)"""
)
def delete_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)["documents"].select("id", "library_document_id")


@query(f"WITH {fx.PAGES_SQL}, gone AS ({_GONE}) SELECT document_id, page_number FROM pages_ WHERE document_id NOT IN (SELECT id FROM gone)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deleted(spark, sf_dir)["pages"].select("document_id", "page_number")


#: The time of a change, so that a query and its twin agree on it.
_NOW = "TIMESTAMP '2030-01-01 00:00:00'"


@query(
    f"""WITH {fx.RECORDINGS_SQL}, m AS (SELECT *, coalesce(user_id = 3 AND status = 'ready', false) AS mine FROM recordings)
    SELECT id, CASE WHEN mine THEN 'Collected' ELSE title END AS title, CASE WHEN mine THEN 1 ELSE library_document_id END AS library_document_id,
    CASE WHEN mine THEN {_NOW} ELSE updated_at END AS updated_at FROM m"""
)
def rename_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder renamed, then another asked for with a blank title, which changes nothing."""
    docs, now = fx.recordings(spark, sf_dir), F.expr(_NOW)
    members = fx.recordings(spark, sf_dir).where("user_id = 3 AND status = 'ready'").select("id")
    others = fx.recordings(spark, sf_dir).where("user_id = 4").select("id")
    renamed = store.rename_folder(docs, members, F.lit("  Collected \n"), F.lit(1).cast("long"), now)
    blank = store.rename_folder(renamed, others, F.lit(" \t "), F.lit(2).cast("long"), now)
    return blank.select("id", "title", "library_document_id", "updated_at")


_STEM = "CASE WHEN original_filename IS NULL THEN 'Recording' ELSE regexp_replace(original_filename, '\\.[^.]+$', '') END"


@query(
    f"""WITH {fx.RECORDINGS_SQL} SELECT id, CASE WHEN id % 13 = 0 THEN coalesce(recording_title, {_STEM}) ELSE recording_title END AS recording_title,
    CASE WHEN id % 13 = 0 THEN 'Shelf 2' ELSE title END AS title, CASE WHEN id % 13 = 0 THEN CAST(id % 5 AS BIGINT) ELSE library_document_id END AS library_document_id,
    CASE WHEN id % 13 = 0 THEN {_NOW} ELSE updated_at END AS updated_at FROM recordings"""
)
def assign_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every move is asked for twice; the later request counts."""
    asked = fx.recordings(spark, sf_dir).where("id % 13 = 0").withColumn("k", F.explode(F.array(F.lit(2), F.lit(1))))
    moves = asked.selectExpr("id", "CAST(CASE WHEN k = 2 THEN id % 5 ELSE 7 END AS BIGINT) AS folder_id", "concat('Shelf ', k) AS folder_title", "timestamp_seconds(k) AS requested_at")
    return store.assign_folder(fx.recordings(spark, sf_dir), moves, F.expr(_NOW)).select("id", "recording_title", "title", "library_document_id", "updated_at")


_ASKED_ID = "o_orderkey + CASE WHEN o_orderkey % 21 = 0 THEN 1000000000 ELSE 0 END AS id"
_ASKED_TITLE = "CASE WHEN o_orderkey % 5 = 0 AND k = 2 THEN '  ' ELSE concat(' Name ', k, ' ') END AS title"


@query(
    f"""WITH {fx.RECORDINGS_SQL}, asked AS (SELECT {_ASKED_ID}, k, {_ASKED_TITLE} FROM orders, (VALUES (1), (2), (3)) v(k) WHERE o_orderkey % 3 = 0),
    good AS (SELECT id, max(k) AS k FROM asked WHERE trim(title) <> '' AND id < 1000000000 GROUP BY id)
    SELECT r.id, CASE WHEN g.id IS NULL THEN recording_title ELSE 'Name ' || g.k END AS recording_title, CASE WHEN g.id IS NULL THEN updated_at ELSE {_NOW} END AS updated_at,
    coalesce(e.n, 0) AS refused FROM recordings r LEFT JOIN good g ON g.id = r.id
    LEFT JOIN (SELECT id, count(*) - count(DISTINCT CASE WHEN trim(title) <> '' THEN 1 END) AS n FROM asked GROUP BY id) e ON e.id = r.id"""
)
def rename_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests for each third recording, some blank, some for nobody;
    with the number of refused requests."""
    asked = fx.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    asked = asked.selectExpr(_ASKED_ID, _ASKED_TITLE, "timestamp_seconds(k) AS requested_at")
    done, refused = store.rename_recordings(fx.recordings(spark, sf_dir), asked, F.expr(_NOW))
    n = refused.groupBy("id").agg(F.count(F.lit(1)).alias("refused"))
    return done.select("id", "recording_title", "updated_at").join(n, "id", "left").withColumn("refused", F.coalesce("refused", F.lit(0).cast("long")))


@query(
    f"""WITH {fx.RECORDINGS_SQL}, {fx.PAGES_SQL}, {fx.SEGMENTS_SQL}, p AS (SELECT document_id || '/' || page_number AS id, document_id, processing_status FROM pages_),
    d AS (SELECT 'document' AS entity, CAST(id AS VARCHAR) AS id, CASE WHEN id % 5 = 0 THEN 'ready' ELSE status END AS status, title, CASE WHEN id % 5 = 0 THEN 2 ELSE 1 END AS version FROM recordings
      UNION ALL SELECT 'document', CAST(id + 2000000000 AS VARCHAR), 'uploaded', NULL, 2 FROM recordings WHERE id % 5 = 0),
    q AS (SELECT 'page', id, CASE WHEN document_id % 10 = 0 THEN 'completed' ELSE processing_status END, NULL, CASE WHEN document_id % 10 = 0 THEN 2 ELSE 1 END FROM p),
    s AS (SELECT 'segment', document_id || '/' || segment_number, processing_status, NULL, 1 FROM segments)
    SELECT entity, id, status, title, TIMESTAMP '2030-01-01 00:00:00' + INTERVAL '1' DAY * version AS updated_at FROM (SELECT * FROM d UNION ALL SELECT * FROM q UNION ALL SELECT * FROM s)"""
)
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, pages and segments saved; then a batch of changed and new
    documents, half of them with pages and none with segments; then it again."""
    g = graph.Graph(spark, shared.folder(spark), buckets=16)
    text = lambda c: F.col(c).cast("string")
    docs = fx.recordings(spark, sf_dir).select(text("id").alias("id"), "status", "title")
    pages = fx.pages(spark, sf_dir, dealt=True).selectExpr("concat(document_id, '/', page_number) AS id", "document_id", "processing_status AS status")
    segments = fx.segments(spark, sf_dir).selectExpr("concat(document_id, '/', segment_number) AS id", "document_id", "processing_status AS status")
    day = lambda k: F.lit(f"2030-01-{k + 1:02d} 00:00:00").cast("timestamp")
    g.save({"documents": docs, "pages": pages, "segments": segments}, day(1), "query", 1)
    some = fx.recordings(spark, sf_dir).where("id % 5 = 0")
    changed = some.select(text("id").alias("id"), F.lit("ready").alias("status"))
    new = some.select((F.col("id") + 2_000_000_000).cast("string").alias("id"), F.lit("uploaded").alias("status"))
    batch = {"documents": changed.unionByName(new), "pages": pages.where("document_id % 10 = 0").withColumn("status", F.lit("completed")), "segments": segments.limit(0)}
    for _ in range(2):
        g.save(batch, day(2), "query", 2)
    null = F.lit(None).cast("string").alias("title")
    parts = [g.read("documents").select(F.lit("document").alias("entity"), "id", "status", "title", "updated_at")]
    parts += [g.read(t).select(F.lit(t[:-1]).alias("entity"), "id", "status", null, "updated_at") for t in ("pages", "segments")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    f"""WITH {fx.PAGES_SQL}, {fx.RECORDINGS_SQL}, {fx.SEGMENTS_SQL}, r AS (
      SELECT 'page' AS entity, CAST(document_id AS VARCHAR) || '/' || page_number AS id, unnest(list_filter([
        CASE WHEN rotation_degrees NOT IN (0, 90, 180, 270) THEN 'rotation' END,
        CASE WHEN NOT coalesce(crop_right IS NOT NULL AND crop_left >= 0 AND crop_left < crop_right AND crop_right <= 1 AND crop_top >= 0 AND crop_top < crop_bottom AND crop_bottom <= 1, false) THEN 'crop' END],
        lambda x: x IS NOT NULL)) AS rule FROM pages_)
    SELECT entity, id, rule FROM r UNION ALL SELECT 'document', CAST(id AS VARCHAR), 'language' FROM recordings WHERE target_language NOT IN ('cantonese', 'mandarin', 'english')
    UNION ALL SELECT 'segment', CAST(document_id AS VARCHAR) || '/' || segment_number, 'duration' FROM segments WHERE segment_number % 7 = 0
    UNION ALL SELECT 'progress', CAST(event_id AS VARCHAR), 'playback_speed' FROM events WHERE CAST(event_id % 40 AS DOUBLE) / 10 NOT BETWEEN 0.5 AND 3"""
)
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fx.pages(spark, sf_dir).withColumn("id", F.concat_ws("/", "document_id", "page_number"))
    docs = fx.recordings(spark, sf_dir).withColumns({"source_type": F.lit("pdf"), "id": F.col("id").cast("string")})
    found = [store.violations(pages, store.page_rules()).withColumn("entity", F.lit("page")), store.violations(docs, store.document_rules()).withColumn("entity", F.lit("document"))]
    segments = fx.segments(spark, sf_dir).withColumns({"id": F.concat_ws("/", "document_id", "segment_number"), "duration_seconds": F.when(F.col("segment_number") % 7 == 0, -1.0).otherwise(1.0)})
    saved = fx.table(spark, sf_dir, "events").selectExpr("CAST(event_id AS STRING) AS id", "1 AS current_segment_number", "0D AS position_seconds", "CAST(event_id % 40 AS DOUBLE) / 10 AS playback_speed")
    found += [store.violations(segments, store.segment_rules()).withColumn("entity", F.lit("segment")), store.violations(saved, store.progress_rules()).withColumn("entity", F.lit("progress"))]
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


@query(
    f"""WITH {fx.PAGES_SQL}, w AS (SELECT o_orderkey AS document_id, CAST(o_orderkey % 5 + 1 AS INT) AS page_number FROM orders)
    SELECT w.document_id, w.page_number, p.processing_status, CASE WHEN p.document_id IS NULL THEN 'page_not_found' END AS error_code
    FROM w LEFT JOIN pages_ p ON p.document_id = w.document_id AND p.page_number = w.page_number"""
)
def find_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS document_id", "CAST(o_orderkey % 5 + 1 AS INT) AS page_number")
    return store.find_page(fx.pages(spark, sf_dir), wanted).select("document_id", "page_number", "processing_status", "error_code")


@query(
    f"""WITH {fx.PAGES_SQL}, {fx.SEGMENTS_SQL} SELECT document_id, page_number, 0 AS source_ordinal FROM pages_ UNION ALL SELECT document_id, page_number, 1 FROM segments
    UNION ALL SELECT document_id, page_number, 2 FROM pages_ WHERE processing_status = 'failed'"""
)
def concat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, segments = fx.pages(spark, sf_dir), fx.segments(spark, sf_dir)
    key = ["document_id", "page_number"]
    return store.concat_sources(pages.select(*key), segments.select(*key), pages.where("processing_status = 'failed'").select(*key))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.duplicates(fx.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    f"""WITH {fx.RECORDINGS_SQL} SELECT id, library_document_id FROM recordings WHERE library_document_id IS NOT NULL AND library_document_id NOT IN (SELECT id FROM recordings)"""
)
def orphan_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = fx.recordings(spark, sf_dir).select(F.col("id").alias("library_document_id"))
    return store.orphans(fx.recordings(spark, sf_dir), parents, ["library_document_id"]).select("id", "library_document_id")
